"""Exact repeats: every byte that a 400-byte string covers which also starts elsewhere, and passages of over 50 words that other documents hold.

Both are one search over strings of a fixed number of units, which are bytes or words, by suffix order:

* Winnowing gives each string an anchor that depends on the string alone: the rightmost least hash of its first
  positions. Strings of one anchor lie side by side; what they cover is the anchor's stretch. The units that every
  string of an anchor holds, from the anchor on, are its context: equal strings have equal anchors and contexts, so
  an anchor whose context occurs once repeats nothing, and contexts deal the suffixes to independent groups.
* A group whose stretches are all equal repeats whole. Stretches of other groups are cut into PARTS by the place of the
  anchor in a string, each with a longer context of its own, and grouped anew: most of them now repeat whole or not at
  all. In the groups that are left the distinct parts are sorted as suffixes by a difference cover (suffixes.py: sampled triples, recursion on names, merging of the rest), many
  groups in one string, and neighbours in that order are compared over the string's length, unit by unit.
* A group of more than CROWD stretches is first split in two by the place of the anchor in a string, either half with
  a longer context, again and again; at the last a context is the whole string. So no task grows with a group.

Rows of equal texts are one text with a number of copies, and what a batch holds of one stretch is one row. Contexts
and whole stretches and parts are told apart by 64-bit hashes, strings of unlike stretches by their units (words by hashes).

Defined cases: null text is empty; texts shorter than the length lose nothing; rows of equal texts, also of
one id, are documents of their own and so repeat each other; a very long text is searched in blocks, within one task;
a cut inside a character keeps the bytes that are left; an empty table gives no rows; columns other than doc_id and
text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkveil.llm.common import BROADCAST_BYTES, drop_written, guarded, mix64, range_hashes, small_batches, table, trimmed, utf8_slices, written
from inkveil.llm.suffixes import suffix_order


class Unit(NamedTuple):
    """Whether strings are of words or bytes, their length, the positions that an anchor is chosen among, units hashed for
    that, and whether a string counts that its own document alone repeats."""

    words: bool
    length: int
    first: int
    gram: int
    inside: bool

    @property
    def context(self) -> int:
        """Units after an anchor that every string with this anchor holds."""
        return self.length - self.first


BYTES, PASSAGES = Unit(False, 400, 192, 8, True), Unit(True, 51, 26, 3, False)
#: Positions of a block in which anchors are looked for; stretches of a group that one task sorts; units of one sorted string, on average and at most.
BLOCK, CROWD, SORTED, SORTED_MOST = 1 << 21, 1024, 1 << 19, 1 << 20
#: Parts of a stretch.
PARTS = 8
_PLACE = 24  # low bits that hold a position within a block, to choose among equal hashes
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def symbols(raw: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The units of all texts, the texts' offsets in them, and the first byte of each unit and the byte after it."""
    if not unit.words:
        at = np.arange(len(raw))
        return raw, offsets, at, at + 1
    inside = np.concatenate([~_SPACE[raw], [False]])
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:]
    at = np.flatnonzero(begin[:-1])
    edges = np.flatnonzero(~inside | first)
    to = edges[np.searchsorted(edges, at, side="right")]
    return range_hashes(raw, at, to), np.searchsorted(at, offsets), at, to


def _leasts(sym: np.ndarray, unit: Unit) -> np.ndarray:
    """For each position the one, of those from it on among which an anchor is chosen, of the rightmost least hash."""
    n = len(sym) - unit.gram + 1
    grams = np.zeros(n, np.uint64)
    for k in range(unit.gram):
        x = sym[k : n + k].astype(np.uint64)
        grams = mix64(grams) + x if unit.words else grams | x << np.uint64(8 * k)
    low = np.uint64((1 << _PLACE) - 1)
    least = (mix64(grams) & ~low) | (low - np.arange(n, dtype=np.uint64))
    width = 1
    while 2 * width <= unit.first:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < unit.first:
        least = np.minimum(least[: len(least) - (unit.first - width)], least[unit.first - width :])
    return (low - (least & low)).astype(np.int64)


def anchors(sym: np.ndarray, offsets: np.ndarray, unit: Unit = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all strings within a text, and the anchor of each."""
    size = np.maximum(np.diff(offsets) - unit.length + 1, 0)
    starts = np.repeat(offsets[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out = np.empty_like(starts)
    for x in range(0, len(sym), BLOCK):
        i, j = np.searchsorted(starts, [x, x + BLOCK])
        if i < j:
            out[i:j] = x + _leasts(sym[x : x + BLOCK + unit.first + unit.gram], unit)[starts[i:j] - x]
    return starts, out


def text_key(df: DataFrame) -> DataFrame:
    return df.select("*", F.xxhash64("text").alias("k"), F.octet_length("text").alias("n_bytes"))


RUN = np.dtype([("k", "<i8"), ("n", "<i4"), ("x", "<i4"), ("y", "<i4")])
TASK_BYTES = 16 << 20  # of runs that one task merges
PLACE = np.dtype([("k", "<i8"), ("n", "<i4"), ("at", "<i4")])


def stretches(texts: DataFrame, unit: Unit) -> DataFrame:
    """h (of the context), s (of the whole stretch), low and high (how far before the anchor its strings start), c (times it occurs,
    or documents that hold it), and of each place: k, n_bytes, doc (an id of the text), at (the anchor). A row a stretch and batch."""
    small_batches(texts.sparkSession)
    names = ["h", "s", "low", "high", "c", "k", "n_bytes", "doc", "at"]

    def run(batches):
        for b in batches:
            _, which, m = np.unique(np.stack([b.column(i).to_numpy() for i in (0, 1)], 1), axis=0, return_index=True, return_counts=True)
            b = b.take(pa.array(which))
            sym, offsets, _, _ = symbols(*utf8_slices(b.column(2)), unit)
            starts, anchor = anchors(sym, offsets, unit)
            new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, np.int64)
            at, first = anchor[new], starts[new]
            last = starts[np.append(new[1:], len(starts)) - 1] if len(new) else first
            h = range_hashes(sym, at, at + unit.context)
            low, high = at - last, at - first
            s = mix64(range_hashes(sym, first, last + unit.length) + (low << 16 | high).astype(np.uint64))
            of = np.searchsorted(offsets, at, side="right") - 1
            order = np.lexsort((of, s, h))
            h, s, low, high, at, of = (x[order] for x in (h, s, low, high, at, of))
            if len(h):
                new = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]))
                count = m[of] if unit.inside else np.where(np.append(True, new[1:] | (of[1:] != of[:-1])), m[of], 0)
                new = np.flatnonzero(new)
                c = np.minimum(np.add.reduceat(count, new), 2)
            else:
                new = c = np.zeros(0, np.int64)
            place = np.empty(len(h), PLACE)
            place["k"], place["n"], place["at"] = b.column(0).to_numpy()[of], b.column(1).to_numpy()[of], at - offsets[of]
            ends = np.append(new, len(h))[1:]
            raw = place.tobytes()
            size = PLACE.itemsize
            more = [raw[size * (x + 1) : size * y] if y > x + 1 else None for x, y in zip(new.tolist(), ends.tolist())]
            flat = [h[new].view(np.int64), s[new].view(np.int64), *[x.astype(np.int32) for x in (low[new], high[new], c)], place["k"][new], place["n"][new], place["at"][new]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, flat), pa.array(more, pa.binary())], names)

    long_enough = texts.filter(F.col("n_bytes") >= unit.length * (1 + unit.words) - unit.words)
    return long_enough.select("k", "n_bytes", "text").mapInArrow(trimmed(run), "h long, s long, low int, high int, c int, k long, n_bytes int, at int, more binary")


def light(df: DataFrame, lists: str, width: int) -> DataFrame:
    """df, to be broadcast if its lists, of entries of width bytes, are small by their sum; else the join shuffles."""
    rows, entries = df.agg(F.count("*"), F.sum(F.size(lists))).first()
    return F.broadcast(df) if 64 * rows + width * (entries or 0) <= BROADCAST_BYTES else df


PIECE = "g long, s long, x int, y int, low int, high int, c int, text long, data binary"


def needed(texts: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """k, n_bytes, text, need (a list of structs of columns) of each text that rows (k, n_bytes, columns) name, once for all its copies."""
    by_text = written(rows.groupBy("k", "n_bytes").agg(F.collect_list(F.struct(*columns)).alias("need")), "repeat-need")
    # Only texts that are named meet their lists by a shuffle.
    some = texts.join(guarded(by_text.select("k", "n_bytes"), 40), ["k", "n_bytes"], "left_semi")
    one = some.select("k", "n_bytes", "doc_id").groupBy("k", "n_bytes").agg(F.min("doc_id").alias("doc"))
    one = written(one.join(by_text, ["k", "n_bytes"]), "repeat-texts")
    joined = some.join(one, ["k", "n_bytes"]).filter(F.col("doc_id").eqNullSafe(F.col("doc")))
    out = joined.select("k", "n_bytes", "text", "need")
    out.written_at, out.keys = one.written_at, by_text
    return out


def parts(texts: DataFrame, mixed: DataFrame, unit: Unit) -> DataFrame:
    """g (the part's context), s (of the part), root (the stretch), x to y (the part's range of starts before the anchor), low to high (what
    the stretch has of it), c, and a place: k, n_bytes, at; of every part of the mixed stretches, each read from one text."""
    source = needed(texts, mixed, "h", "s", "low", "high", "c", "at")
    width = -(-unit.first // PARTS)
    names = ["g", "s", "root", "x", "y", "low", "high", "c", "k", "n_bytes", "at"]

    def run(batches):
        for b in batches:
            sym, starts, _, _ = symbols(*utf8_slices(b.column(2)), unit)
            need = b.column(3)
            flat, of = need.flatten(), np.repeat(np.arange(len(b)), np.diff(need.offsets.to_numpy()))
            h, s, low, high, c, at = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6))
            first, last = low // width, high // width
            n = last - first + 1
            i = np.repeat(np.arange(len(h)), n)
            x = (np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[i]) * width
            y = np.minimum(x + width, unit.first) - 1
            lo, hi, here = np.maximum(low[i], x), np.minimum(high[i], y), starts[of[i]] + at[i]
            g = mix64(range_hashes(sym, here - x, here - y + unit.length) ^ mix64(h[i].view(np.uint64) + x.astype(np.uint64)))
            part = mix64(range_hashes(sym, here - hi, here - lo + unit.length) ^ mix64(g + (lo << 16 | hi).astype(np.uint64)))
            numbers = [g.view(np.int64), part.view(np.int64), s[i], *[v.astype(np.int32) for v in (x, y, lo, hi, c[i])]]
            rest = pa.array(of[i])
            yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), *[b.column(j).take(rest) for j in (0, 1)], pa.array(at[i].astype(np.int32))], names)

    out = written(source.mapInArrow(trimmed(run), "g long, s long, root long, x int, y int, low int, high int, c int, k long, n_bytes int, at int"), "repeat-parts")
    drop_written(source, source.keys)
    return out


def pieces(texts: DataFrame, mixed: DataFrame, unit: Unit) -> DataFrame:
    """Of mixed parts their units, read from one text each, as PIECE: g (the group), s, x to y (the group's range of starts before
    the anchor), low to high (the part's own), c, text (a hash of the text that holds it), data."""
    source = needed(texts, mixed, "g", "s", "x", "y", "low", "high", "c", "at")

    def run(batches):
        for b in batches:
            sym, starts, _, _ = symbols(*utf8_slices(b.column(2)), unit)
            cols = [[] for _ in range(9)]
            for i, (k, need) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist())):
                for r in need:
                    at = int(starts[i]) + r["at"]
                    data = sym[at - r["high"] : at - r["low"] + unit.length]
                    for c, v in zip(cols, (r["g"], r["s"], r["x"], r["y"], r["low"], r["high"], r["c"], k, data.tobytes())):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["g", "s", "x", "y", "low", "high", "c", "text", "data"])

    out = written(source.mapInArrow(trimmed(run), PIECE).dropDuplicates(["g", "s"]), "repeat-pieces")
    drop_written(source, source.keys)
    return out


def _type(unit: Unit):
    return np.dtype(np.uint64 if unit.words else np.uint8)


def halves(crowd: DataFrame, unit: Unit) -> DataFrame:
    """Pieces of crowded groups in two groups each, by the half of the group's range; each has the context of its half."""

    def run(batches):
        size = _type(unit).itemsize
        for b in batches:
            cols = [[] for _ in range(9)]
            for r in b.to_pylist():
                mid = (r["x"] + r["y"]) // 2
                for x, y in ((r["x"], mid), (mid + 1, r["y"])):
                    low, high = max(r["low"], x), min(r["high"], y)
                    if low <= high:  # the anchor is at high units of the piece; strings from x to y before it hold what follows
                        context = r["data"][size * (r["high"] - x) : size * (r["high"] - y + unit.length)]
                        data = r["data"][size * (r["high"] - high) : size * (r["high"] - low + unit.length)]
                        g = int.from_bytes(hashlib.blake2b(context, digest_size=8, key=f"{r['g']}:{x}:{y}".encode()).digest(), "little", signed=True)
                        for c, v in zip(cols, (g, r["s"], x, y, low, high, r["c"], r["text"], data)):
                            c.append(v)
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["g", "s", "x", "y", "low", "high", "c", "text", "data"])

    return crowd.mapInArrow(trimmed(run), PIECE)


def repeated_starts(data: list[bytes], c: np.ndarray, text: np.ndarray, group: np.ndarray, unit: Unit) -> list[np.ndarray]:
    """Of each piece, a mark for each string that repeats among the pieces: by their suffix order and the comparison of neighbours."""
    parts = [np.frombuffer(x, _type(unit)) for x in data]
    size = np.array([len(p) for p in parts])
    flat = np.concatenate(parts)
    names = np.unique(flat, return_inverse=True)[1] + 1 if unit.words else flat.astype(np.int64) + 1
    begin = np.cumsum(size + 1) - size - 1
    t = np.empty(size.sum() + len(parts), np.int64)
    t[np.arange(len(flat)) + np.repeat(np.arange(len(parts)), size)] = names
    t[begin + size] = names.max() + 1  # an end larger than all; strings never reach it
    of = np.repeat(np.arange(len(parts)), size + 1)
    order = suffix_order(t)
    order = order[order - begin[of[order]] <= size[of[order]] - unit.length]  # where strings start
    a, b = order[:-1], order[1:]
    same = np.flatnonzero((t[a] == t[b]) & (t[a + unit.length - 1] == t[b + unit.length - 1]) & (group[of[a]] == group[of[b]]))
    for k in range(1, unit.length - 1):
        if not len(same):
            break
        same = same[t[a[same] + k] == t[b[same] + k]]
    new = np.ones(len(order), bool)
    new[same + 1] = False
    run = np.flatnonzero(new)
    if unit.inside:
        often = np.add.reduceat(c[of[order]], run) > 1
    else:
        texts = text[of[order]]
        often = (np.maximum.reduceat(c[of[order]], run) > 1) | (np.minimum.reduceat(texts, run) != np.maximum.reduceat(texts, run))
    marks = np.zeros(len(t), bool)
    marks[order] = often[np.cumsum(new) - 1]
    return [marks[x : x + n - unit.length + 1] for x, n in zip(begin, size)]


def sorted_groups(pieces_: DataFrame, unit: Unit) -> DataFrame:
    """s, f, t: starts, from f to t before the anchor, of strings of a stretch that repeat; pieces dealt by whole groups."""
    total = pieces_.agg(F.sum(F.length("data"))).first()[0] or 0
    buckets = max(8, -(-total // (_type(unit).itemsize * SORTED)))
    names = ["s", "f", "t"]

    def run(table_: pa.Table) -> pa.Table:
        g = table_.column("g").to_numpy()
        by = np.argsort(g, kind="stable")
        table_ = table_.take(pa.array(by))
        g, s, high = g[by], table_.column("s").to_numpy(), table_.column("high").to_numpy()
        data, c, text = table_.column("data").to_pylist(), table_.column("c").to_numpy(), table_.column("text").to_numpy()
        upto = np.cumsum([len(x) // _type(unit).itemsize + 1 for x in data])
        out: list[list] = [[], [], []]
        at = 0
        while at < len(data):  # whole groups, as many as one sorted string holds
            used = upto[at - 1] if at else 0
            end = max(int(np.searchsorted(upto, used + SORTED_MOST)), int(np.searchsorted(g, g[at], side="right")))
            if end < len(data):
                end = max(int(np.searchsorted(g, g[end])), int(np.searchsorted(g, g[at], side="right")))
            for i, marks in zip(range(at, end), repeated_starts(data[at:end], c[at:end], text[at:end], g[at:end], unit)):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
                for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    for o, v in zip(out, (int(s[i]), int(high[i]) - x, int(high[i]) - y + 1)):
                        o.append(v)
            at = end
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names)

    return pieces_.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets))).groupBy("bucket").applyInArrow(run, "s long, f int, t int")


def spans(docs: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """k, n_bytes, starts, ends, written: the maximal repeated runs, in units, of each text that has any."""
    texts = text_key(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = written(stretches(texts, unit), "repeat-stretches")
    often = rows.groupBy("h").agg(F.sum("c").alias("times")).filter("times > 1").select("h")
    suspect = written(rows.join(often, "h"), "repeat-suspects")
    drop_written(rows)
    place = [F.first(c).alias(c) for c in ("k", "n_bytes", "at")]  # of one row, the same for all three
    kinds = written(suspect.groupBy("h", "s", "low", "high").agg(F.least(F.sum("c"), F.lit(2)).cast("int").alias("c"), *place), "repeat-kinds")
    groups = written(kinds.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("h"), "repeat-groups")
    mixed = kinds.join(groups, "h")
    cut = parts(texts, mixed, unit)
    once = F.sum("c") if unit.inside else F.when((F.max("c") > 1) | (F.min("k") != F.max("k")), 2).otherwise(1)
    sorts = cut.groupBy("g", "s", "x", "y", "low", "high").agg(F.least(once, F.lit(2)).cast("int").alias("c"), *place)
    sorts = written(sorts, "repeat-sorts")
    left = written(sorts.groupBy("g").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("g"), "repeat-left")
    # A stretch or part that occurs twice repeats whole, whatever else its group holds.
    whole = kinds.filter("c > 1").select("s", F.col("high").alias("f"), F.col("low").alias("t"))
    found = [sorts.filter("c > 1").select("s", F.col("high").alias("f"), F.col("low").alias("t"))]
    gone = [suspect, kinds, groups, cut, sorts, left]
    level = pieces(texts, sorts.join(left, "g"), unit)
    while not level.isEmpty():
        crowds = guarded(written(level.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("g"), "repeat-crowds"), 16)
        found.append(written(sorted_groups(level.join(crowds, "g", "left_anti"), unit), "repeat-found"))
        if crowds.isEmpty():
            gone += [level, found[-1]]
            break
        split = written(halves(level.join(crowds, "g", "left_semi"), unit), "repeat-pieces")
        # Where a half is one place, its context is the whole string: all of a group are equal.
        ends = split.filter("x = y")
        n = F.sum("c") if unit.inside else F.when((F.max("c") > 1) | (F.min("text") != F.max("text")), 2).otherwise(1)
        twice = written(ends.groupBy("g").agg(n.alias("n")).filter("n > 1").select("g"), "repeat-ends")
        found.append(written(ends.join(twice, "g").select("s", F.col("high").alias("f"), F.col("low").alias("t")), "repeat-found"))
        last, level = level, written(split.filter("x < y"), "repeat-pieces")
        drop_written(last, split, twice)
        gone += found[-2:]
    by_part = found[0]
    for f in found[1:]:
        by_part = by_part.unionByName(f)
    ranges = whole.unionByName(by_part.join(cut.select("s", "root"), "s").select(F.col("root").alias("s"), "f", "t"))
    ranges = written(ranges.groupBy("s").agg(F.collect_list(F.struct("f", "t")).alias("ranges")).withColumnRenamed("s", "of"), "repeat-ranges")
    hit = suspect.join(light(ranges, "ranges", 8), F.col("s") == F.col("of")).select("k", "n_bytes", "at", "more", "ranges")

    places = suspect.agg(F.sum(1 + F.coalesce(F.length("more"), F.lit(0)) / PLACE.itemsize)).first()[0] or 0
    buckets = max(16, int(4 * places * RUN.itemsize // TASK_BYTES))

    def spread(batches):
        """bucket, runs: each run at each place, packed, a row a batch and bucket of texts."""
        for b in batches:
            n = np.diff(b.column(4).offsets.to_numpy())
            flat = b.column(4).flatten()
            more = b.column(3).to_pylist()
            own = np.empty(len(b), PLACE)
            own["k"], own["n"], own["at"] = (b.column(i).to_numpy() for i in (0, 1, 2))
            extra = np.array([len(m) // PLACE.itemsize if m else 0 for m in more], np.int64)
            place = np.concatenate([own, np.frombuffer(b"".join(m for m in more if m), PLACE)])
            row = np.concatenate([np.arange(len(b)), np.repeat(np.arange(len(b)), extra)])
            i = np.repeat(np.arange(len(row)), n[row])
            r = np.arange(len(i)) - np.repeat(np.cumsum(n[row]) - n[row], n[row]) + (np.cumsum(n) - n)[row[i]]
            f, t = (flat.field(j).to_numpy(zero_copy_only=False)[r] for j in (0, 1))
            at = place["at"][i]
            out = np.empty(len(i), RUN)
            out["k"], out["n"], out["x"], out["y"] = place["k"][i], place["n"][i], at - f, at - t + unit.length
            to = (mix64(out["k"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64) if len(out) else np.zeros(0, np.int64)
            order = np.argsort(to, kind="stable")
            out, to = out[order], to[order]
            new = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else to
            ends = np.append(new, len(to))[1:]
            yield pa.RecordBatch.from_arrays([pa.array(to[new]), pa.array([out[v:w].tobytes() for v, w in zip(new, ends)], pa.binary())], ["bucket", "runs"])

    def run(t: pa.Table) -> pa.Table:
        r = np.frombuffer(b"".join(t.column("runs").to_pylist()), RUN)
        r = r[np.lexsort((r["x"], r["n"], r["k"]))]
        text = np.append(True, (r["k"][1:] != r["k"][:-1]) | (r["n"][1:] != r["n"][:-1]))
        row, x, y = np.cumsum(text) - 1, r["x"].astype(np.int64), r["y"].astype(np.int64)
        reach = np.maximum.accumulate(y + (row << 32)) - (row << 32)  # texts in turn
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (x[1:] > reach[:-1])))
        ends = reach[np.append(new[1:], len(row)) - 1]
        cuts = pa.array(np.searchsorted(row[new], np.arange(row[-1] + 2)).astype(np.int32))
        return pa.table([pa.array(r["k"][text]), pa.array(r["n"][text]), *[pa.ListArray.from_arrays(cuts, pa.array(v.astype(np.int32))) for v in (x[new], ends)]], ["k", "n_bytes", "starts", "ends"])

    each = hit.mapInArrow(trimmed(spread), "bucket long, runs binary").groupBy("bucket").applyInArrow(run, "k long, n_bytes int, starts array<int>, ends array<int>")
    out = written(each, "repeat-spans")
    drop_written(ranges, *gone)
    return out


def merged(starts: list[int] | None, ends: list[int] | None) -> list[tuple[int, int]]:
    """Runs in order, overlapping and touching ones as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts or (), ends or ())):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def in_bytes(raw: bytes, starts: list[int] | None, ends: list[int] | None, unit: Unit) -> list[tuple[int, int]]:
    """Runs of units as runs of bytes."""
    if not starts or not unit.words:
        return merged(starts, ends)
    data = np.frombuffer(raw, np.uint8)
    _, _, first, last = symbols(data, np.array([0, len(data)]), unit)
    return [(int(first[x]), int(last[y - 1])) for x, y in merged(starts, ends)]


def keep(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in runs:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]]) if runs else raw


def with_spans(docs: DataFrame) -> DataFrame:
    """docs, null texts as empty, with starts and ends of what goes, and p_starts and p_ends of passages in words; null where there are none."""
    docs = docs.drop("k", "n_bytes", "starts", "ends", "p_starts", "p_ends")  # columns of our own names
    d = text_key(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    d = d.join(light(spans(docs), "starts", 8), ["k", "n_bytes"], "left")
    passages = spans(docs, PASSAGES).withColumnsRenamed({"starts": "p_starts", "ends": "p_ends"})
    return d.join(light(passages, "p_starts", 8), ["k", "n_bytes"], "left")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, n_chars with the repeats and the passages cut out; what a cut leaves of a character goes, too."""

    def run(batches):
        for b in batches:
            text, *lists = (b.column(i).to_pylist() for i in (1, 4, 5, 6, 7))
            kept = []
            for t, s, e, ps, pe in zip(text, *lists):
                raw = t.encode() if s or ps else b""
                runs = merged(s, e) + in_bytes(raw, ps, pe, PASSAGES)
                kept.append(keep(raw, merged(*zip(*runs))).decode("utf-8", "ignore") if runs else t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), b.column(2), b.column(3), pa.array([len(t) for t in kept], pa.int64())], ["doc_id", "text", "lang", "source", "n_chars"])

    d = with_spans(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "text", "lang", "source", "starts", "ends", "p_starts", "p_ends")
    return d.mapInArrow(trimmed(run), "doc_id long, text string, lang string, source string, n_chars long")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; beside them n_passage_bytes, bytes of passages of over 50 words that other documents hold, of whatever length in bytes."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"]

    def run(batches):
        for b in batches:
            i, text, starts, ends, p_starts, p_ends = (c.to_pylist() for c in b.columns)
            raw = [t.encode() for t in text]
            runs = [merged(s, e) for s, e in zip(starts, ends)]
            kept = [keep(*x) for x in zip(raw, runs)]
            passages = [sum(y - x for x, y in in_bytes(t, s, e, PASSAGES)) for t, s, e in zip(raw, p_starts, p_ends)]
            cols = [[len(r) for r in raw], [len(r) - len(k) for r, k in zip(raw, kept)], [len(s) for s in runs], [hashlib.sha256(k).hexdigest() for k in kept], passages]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.string() if n == "kept_sha256" else pa.int64()) for n, c in zip(names[1:], cols)]], names)

    docs = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "starts", "ends", "p_starts", "p_ends")
    return docs.mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long")


QUERIES, ORACLES = {"op6_repeats": op6_repeats}, {}
