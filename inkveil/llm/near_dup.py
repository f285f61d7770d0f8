"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

Texts of equal shingle sets are one class, so exact copies cost one signature. Each of several orders sorts the
signatures, beginning at another of their values. Classes that share an order's first few values form a region of
it; within a region they stand in that order, so that neighbours have the longest common prefixes, and are compared
by their signatures, nearest first. The depth follows the region: a crowded one, of more than REGION classes, is
searched first by the deeper prefixes that neighbours within a window share.

First each class is confirmed against one likely partner, on whole sets that are sent once or twice. Links give
components by label propagation with pointer jumping. Then all likely pairs that are in two components still are
confirmed, so that no link is lost: those of a region within one task, those of a crowded region in pairs of blocks.

The similarity is 0.8 unless told otherwise; op5 takes 0.85. Orders and depth follow from it, so that a pair at
the threshold shares no region with probability 1e-5 at most, and is passed over by the comparison of signatures
with 1e-6 at most. Shingles and words are told apart by 64-bit hashes.

Defined cases: null, empty and blank texts have empty sets and stay alone; a text of fewer than five words is
one shingle; very long texts are taken whole; rows of a null id never become a component's name unless all are
null; rows that repeat an id are documents of their own, and one_of_each keeps one row of a component, by id and
then by a hash of its text; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkveil.llm.common import drop_written, guarded, mix64, range_hashes, small_batches, table, trimmed, utf8_slices, written

WORDS, PERCENT = 5, 80
HASHES = 64
#: Most that a pair at the threshold may miss: every region; the comparison of signatures.
NO_REGION, NO_MATCH = 1e-5, 1e-6
SEED = 97
#: Classes of a region that one task compares.
REGION = 2048
#: Neighbours of a class in a crowded region's order that it is compared with; partners that one task confirms a class with.
WINDOW, LEAVES = 64, 512
#: Random rounds of a crowded region; rows of a block in them, and of the sample of the largest component it meets.
ROUNDS, BLOCK, SAMPLE = 3, 256, 64
#: Ids up to this number are sent to every executor (16 MB); beyond it the join shuffles. Bytes of sets in a task.
BROADCAST_IDS, TASK_BYTES = 2_000_000, 24 << 20
_MULTIPLIERS = (np.random.default_rng(SEED).integers(1, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Plan(NamedTuple):
    """Orders of the signatures' values, values of a region, equal values that a linked pair has at least."""

    percent: int
    orders: int
    depth: int
    least: int


def plan(percent: int) -> Plan:
    """The deepest regions whose orders fit the signature, at a similarity of percent."""
    t = percent / 100
    orders = lambda d: math.ceil(math.log(NO_REGION) / math.log1p(-(t**d)))
    depth = max(d for d in range(1, HASHES) if orders(d) * d <= HASHES)
    below, least = 0.0, 0
    while (below := below + math.comb(HASHES, least) * t**least * (1 - t) ** (HASHES - least)) <= NO_MATCH:
        least += 1
    return Plan(percent, orders(depth), depth, least)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted within each, and the offsets of the texts in them."""
    n = len(offsets) - 1
    raw = _LOWER[raw]
    inside = np.concatenate([~_SPACE[raw], [False]])
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:]
    at = np.flatnonzero(begin[:-1])
    edges = np.flatnonzero(~inside | first)
    to = edges[np.searchsorted(edges, at, side="right")]
    words = range_hashes(raw, at, to)
    upto = np.searchsorted(at, offsets)
    count = np.diff(upto)
    size = np.minimum(count, WORDS)  # a shorter text is one shingle as a whole
    shingles = np.where(count > 0, count - size + 1, 0)
    text = np.repeat(np.arange(n), shingles)
    starts = upto[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    h = np.zeros(len(text), np.uint64)
    for k in range(WORDS):
        use = k < size[text]
        h = np.where(use, mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(starts + k, max(len(words) - 1, 0))] + np.uint64(k + 1)), h) if len(words) else h
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[keep], text[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x HASHES smallest hash values; texts without shingles get the largest value."""
    n = len(offsets) - 1
    out = np.full((n, HASHES), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        at = offsets[:-1][some]
        for k, a in enumerate(_MULTIPLIERS):
            out[some, k] = np.minimum.reduceat((h * a) >> np.uint64(32), at)
    return out


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text), n, key (of the set; null if it is empty), sig (HASHES big-endian values) of every document."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            h, o = shingle_sets(*utf8_slices(b.column(2)))
            sig = signatures(h, o).astype(">u4").tobytes()
            n, w = np.diff(o), 4 * HASHES
            keys = [hashlib.blake2b(h[x:y].tobytes(), digest_size=16).digest() if y > x else None for x, y in zip(o[:-1], o[1:])]
            sigs = [sig[w * i : w * i + w] if k else None for i, k in enumerate(keys)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "h", "n", "key", "sig"])

    return docs.select("doc_id", text_hash(), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(trimmed(run), "doc_id long, h long, n long, key binary, sig binary")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")


def in_order(p: Plan) -> Column:
    """The signature as its order o reads it: from the order's first value on, round to the one before."""
    at = (4 * p.depth * F.col("o")).cast("int")
    return F.concat(F.substring(F.col("sig"), at + 1, F.lit(4 * HASHES)), F.substring(F.col("sig"), F.lit(1), at))


def forest(reps: DataFrame, p: Plan) -> DataFrame:
    """region, o (its order), size, key: the classes of every region of two and more."""
    orders = F.array(*[F.struct(F.lit(o).cast("byte").alias("o"), F.xxhash64(F.lit(o), F.substring("sig", 1 + 4 * p.depth * o, 4 * p.depth)).alias("region")) for o in range(p.orders)])
    rows = reps.select("key", F.explode(orders).alias("x")).select("key", "x.o", "x.region")
    sizes = rows.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1")
    return rows.join(sizes, "region").select("region", "o", "size", "key")


def likely(region: np.ndarray, n: np.ndarray, sig: np.ndarray, label: np.ndarray, plan: Plan, seen: np.ndarray | None = None, most: int | None = None):
    """Pairs of rows of one region and two labels, given in its order, whose sizes and signatures leave the threshold in reach; nearest first.

    Labels may change between what it yields. Pairs of two seen rows are passed over, and rows further apart than most.
    """
    for d in range(1, min(len(region), most + 1 if most else len(region))):
        i = np.flatnonzero(region[:-d] == region[d:])
        if not len(i):
            break
        i = i[label[i] != label[i + d]]
        if seen is not None:
            i = i[~(seen[i] & seen[i + d])]
        i = i[100 * np.minimum(n[i], n[i + d]) >= plan.percent * np.maximum(n[i], n[i + d])]
        i = i[(sig[i] == sig[i + d]).sum(axis=1) >= plan.least]
        if len(i):
            yield i, i + d


def _signatures(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), ">u4").astype(np.uint32).reshape(-1, HASHES)


def by_region(compare, most: int | None = None, again: int = 0):
    """compare, for mapInArrow, on each region of rows that come in its order; on runs of most rows, each with again rows of the one before, where a region has more."""

    def run(batches):
        kept = None
        for b in batches:
            t = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            region = t.column("region").to_numpy()
            if not len(region):
                continue
            cut = int(np.searchsorted(region == region[-1], True))
            if cut:
                yield from compare(t.slice(0, cut))
            kept = t.slice(cut).combine_chunks()
            if most and len(kept) > most:
                yield from compare(kept)
                kept = kept.slice(len(kept) - again)
        if kept is not None and len(kept):
            yield from compare(kept)

    return trimmed(run)


def partners(members: DataFrame, plan: Plan, window: int | None = None) -> DataFrame:
    """a, b: each class b of a region with one likely partner a there, of a smaller key: the smallest, so that regions agree."""

    def compare(t: pa.Table):
        keys = t.column("key").to_pylist()
        rank = np.empty(len(t), np.int64)
        rank[sorted(range(len(t)), key=keys.__getitem__)] = np.arange(len(t))
        best = rank.copy()
        for i, j in likely(t.column("region").to_numpy(), t.column("n").to_numpy(), _signatures(t.column("sig")), rank, plan, most=window):
            low = np.minimum(rank[i], rank[j])
            best[i] = np.minimum(best[i], low)
            best[j] = np.minimum(best[j], low)
        at, of = np.flatnonzero(best < rank), np.argsort(rank)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([keys[of[x]] for x in best[at]], pa.binary()), pa.array([keys[x] for x in at], pa.binary())], ["a", "b"])

    rows = members.select("region", "key", "n", "sig", in_order(plan).alias("order"))
    rows = rows.repartition("region") if window is None else rows.repartitionByRange("region", "order", "key")
    rows = rows.sortWithinPartitions("region", "order", "key").select("region", "key", "n", "sig")
    return rows.mapInArrow(by_region(compare, window and REGION, window or 0), "a binary, b binary")


def starred(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """region, key, n, sig, label: each partner with its classes as a region for confirmed(); a crowd of them in several."""
    some = guarded(pairs.groupBy("a").agg(F.count("*").alias("m")).filter(F.col("m") > LEAVES))
    split = F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("m", F.lit(1)) / LEAVES))
    rows = pairs.join(some, "a", "left").select("a", "b", F.xxhash64("a", split).alias("region"))
    rows = rows.select("region", F.col("b").alias("key")).unionByName(rows.select("region", F.col("a").alias("key")).distinct())
    return rows.join(reps.select("key", "n", "sig"), "key").select("region", "key", "n", "sig", F.xxhash64("key").alias("label"))


def neighbours(members: DataFrame, plan: Plan) -> DataFrame:
    """region, key, n, sig, label: the members of a region that have a likely partner there in another component; pairs never become rows."""

    def compare(t: pa.Table):
        seen = np.zeros(len(t), bool)
        for i, j in likely(t.column("region").to_numpy(), t.column("n").to_numpy(), _signatures(t.column("sig")), t.column("label").to_numpy(), plan, seen):
            seen[i] = seen[j] = True
        return t.filter(pa.array(seen)).combine_chunks().to_batches()

    return members.select("region", "key", "n", "sig", "label").repartition("region").sortWithinPartitions("region", "sig").mapInArrow(by_region(compare), "region long, key binary, n long, sig binary, label long")


def confirmed(docs: DataFrame, reps: DataFrame, need: DataFrame, plan: Plan) -> DataFrame:
    """a, b, written: of the likely pairs whose sets reach the threshold, links that span all their components in each task. need goes."""
    spark = docs.sparkSession
    if need.isEmpty():
        drop_written(need)
        return written(spark.createDataFrame([], "a binary, b binary"), "near-links")
    ids = reps.join(need.select("key").distinct(), "key").select("doc")
    total, size = ids.count(), need.agg(F.sum("n")).first()[0]
    wanted = ids.select(F.col("doc").alias("want")).distinct()
    wanted = F.broadcast(wanted) if total <= BROADCAST_IDS else wanted
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(wanted, texts.doc_id.eqNullSafe(F.col("want")), "left_semi")
    small_batches(spark)

    def sets(batches):
        for b in batches:
            h, o = shingle_sets(*utf8_slices(b.column(0)))
            raw = [h[x:y].tobytes() for x, y in zip(o[:-1], o[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary()), pa.array(raw, pa.binary())], ["key", "set"])

    made = written(texts.select("text").mapInArrow(trimmed(sets), "key binary, set binary").dropDuplicates(["key"]), "near-sets")
    buckets = max(8, -(-8 * (size or 0) // TASK_BYTES))
    bucket = F.pmod(F.xxhash64("region"), F.lit(buckets)).alias("bucket")
    held = need.join(made, "key").select(bucket, "region", "key", "n", "sig", "label", "set")

    def check(t: pa.Table) -> pa.Table:
        keys, region = t.column("key").to_pylist(), t.column("region").to_numpy()
        sig = _signatures(t.column("sig"))
        order = np.lexsort((sig[:, 0], region))
        s = {k: np.frombuffer(v, np.uint64) for k, v in zip(keys, t.column("set").to_pylist())}
        start = np.unique(t.column("label").to_numpy()[order], return_inverse=True)[1]
        out, up, label = [], np.arange(len(start)), start.copy()

        def root(k):
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for i, j in likely(region[order], t.column("n").to_numpy()[order], sig[order], label, plan):
            found = len(out)
            for u, v in zip(i.tolist(), j.tolist()):
                p, q = root(label[u]), root(label[v])
                if p == q:  # linked already: a further link changes no component
                    continue
                a, b = keys[order[u]], keys[order[v]]
                x, y = s[a], s[b]
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= plan.percent * (len(x) + len(y) - both):
                    up[max(p, q)] = min(p, q)
                    out.append((a, b))
            if len(out) > found:
                while (up != up[up]).any():
                    up = up[up]
                label[:] = up[start]
        return pa.table([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["a", "b"])

    links = written(held.groupBy("bucket").applyInArrow(check, "a binary, b binary"), "near-links")
    drop_written(made, need)
    return links


def components(links: DataFrame) -> DataFrame:
    """key, label, written: the smallest key of each linked key's component."""
    edges = written(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "near-edges")
    step = written(edges.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("key"), F.lit(True).alias("moved"), F.least("x", "y").alias("label")), "near-labels")
    while not step.filter("moved").isEmpty():
        labels = step.select("key", "label")
        near = edges.join(labels.select(F.col("key").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("least")).withColumnRenamed("x", "key")
        moved = labels.join(near, "key").select("key", F.col("label").alias("was"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("further"))
        moved = moved.join(jump, "label", "left").select("key", "was", F.least("label", F.coalesce("further", "label")).alias("label"))
        last, step = step, written(moved.select("key", (F.col("was") != F.col("label")).alias("moved"), "label"), "near-labels")
        drop_written(last)
    drop_written(edges)
    return step


def crossings(docs: DataFrame, reps: DataFrame, crowded: DataFrame, links: DataFrame, plan: Plan) -> DataFrame:
    """links, and those between components that share a crowded region.

    What lies outside a region's largest component is compared in random blocks, each with a sample of that
    component, for a few rounds. Then every pair of classes of two components is compared, in pairs of blocks;
    a region of one component has none.
    """
    if crowded.isEmpty():
        return links
    half = REGION // 2
    rows = written(crowded.select("region", "key").join(reps.select("key", "n", "sig"), "key"), "near-crowded")
    for turn in range(ROUNDS + 1):
        labels = components(links)
        named = rows.join(labels.select("key", "label"), "key", "left").withColumn("label", F.xxhash64(F.coalesce("label", "key")))
        counts = named.groupBy("region", "label").agg(F.count("*").alias("m"))
        main = counts.groupBy("region").agg(F.max(F.struct("m", "label")).alias("x"), F.sum("m").alias("size")).filter("x.m < size")
        main = main.select("region", F.col("x.label").alias("main"), F.col("x.m").alias("m"), F.ceil((F.col("size") - F.col("x.m")) / (BLOCK if turn < ROUNDS else half)).alias("b"))
        named = written(named.join(guarded(main), "region").withColumn("outside", F.col("label") != F.col("main")), "near-named")
        drop_written(labels)
        if named.isEmpty():
            drop_written(named)
            break
        dealt = F.xxhash64("key", F.lit(turn))
        block = F.pmod(dealt, F.col("b"))
        if turn < ROUNDS:
            sampled = named.filter("outside").withColumn("task", F.struct(block.alias("i"), F.lit(0).cast("long").alias("j")))
            sample = named.filter(~F.col("outside") & (F.pmod(dealt, F.greatest(F.floor(F.col("m") / SAMPLE), F.lit(1))) == 0))
            each = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("b") - 1), lambda i: F.struct(i.alias("i"), F.lit(0).cast("long").alias("j"))))
            parts = sampled.unionByName(sample.withColumn("task", each))
        else:  # blocks 0 to b - 1 lie outside the largest component, all further ones in it: block pairs i < j with i < b
            last = F.col("b") + F.ceil(F.col("m") / half) - 1
            own = F.when(F.col("outside"), block).otherwise(F.col("b") + F.pmod(dealt, F.ceil(F.col("m") / half)))
            meets = F.sequence(F.lit(0).cast("long"), F.when(F.col("outside"), last).otherwise(F.col("b") - 1))
            pairs = named.withColumn("own", own).withColumn("meets", meets)
            pair = F.transform(F.filter("meets", lambda k: k != F.col("own")), lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j")))
            parts = pairs.withColumn("task", F.explode(pair))
        parts = parts.withColumn("region", F.xxhash64("region", "task.i", "task.j", F.lit(turn)))
        need = written(neighbours(parts, plan), "near-need")
        drop_written(named)
        links = joined(links, confirmed(docs, reps, need, plan))
    drop_written(rows)
    return links


def joined(links: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables as one; they go."""
    out = written(links.unionByName(more), "near-links")
    drop_written(links, more)
    return out


def grouped(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, h, n, component_id, first (whether its row is the one that a component keeps) of every document."""
    p = plan(percent)
    docs = docs.select("doc_id", "text")
    seen = written(profiles(docs), "near-profiles")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    reps = written(seen.filter("n > 0").groupBy("key").agg(F.min(row).alias("row"), F.first("n").alias("n"), F.first("sig").alias("sig")).select("key", F.col("row.doc_id").alias("doc"), "row", "n", "sig"), "near-classes")
    places = written(forest(reps, p), "near-forest")
    small, crowded = (places.filter(F.col("size") <= REGION), places.filter(F.col("size") > REGION))
    placed = lambda rows: rows.join(reps.select("key", "n", "sig"), "key")
    pairs = partners(placed(small), p)
    if not crowded.isEmpty():
        pairs = pairs.unionByName(partners(placed(crowded), p, WINDOW))
    pairs = written(pairs.distinct(), "near-pairs")
    links = confirmed(docs, reps, written(starred(pairs, reps), "near-need"), p)
    drop_written(pairs)
    labels = components(links)
    named = placed(small.select("region", "key")).join(labels.select("key", "label"), "key", "left").withColumn("label", F.xxhash64(F.coalesce("label", "key")))
    need = written(neighbours(named, p), "near-need")
    drop_written(labels)
    links = crossings(docs, reps, crowded, joined(links, confirmed(docs, reps, need, p)), p)
    labels = components(links)
    named = labels.select("key", "label").join(reps.select("key", "row"), "key")
    firsts = written(named.groupBy("label").agg(F.min("row").alias("first")), "near-firsts")
    classes = reps.select("key", "row").join(written(named.join(firsts, "label").select("key", "first"), "near-named"), "key", "left")
    classes = written(classes.select("key", F.coalesce("first", "row").alias("first")), "near-components")
    drop_written(links, labels, firsts, places, reps)
    # Texts without a set meet no class; keys of their own keep them from one task.
    own = F.coalesce("key", F.to_binary(F.hex(F.xxhash64("doc_id", "h")), F.lit("hex")))
    out = seen.select("doc_id", "h", "n", own.alias("key")).join(classes, "key", "left")
    is_first = F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h")))
    return out.select("doc_id", "h", "n", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), is_first.alias("first"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    out = grouped(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text, lang, source, n_chars of the rows that stay: one of each component, and all whose text has no words."""
    found = written(grouped(docs, percent), "near-found")
    gone = written(found.filter("not first").select(F.col("doc_id").alias("i"), F.col("h").alias("k")).distinct(), "near-gone")
    repeated = written(found.filter("first and n > 0").groupBy("doc_id", "h").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("doc_id").alias("i"), F.col("h").alias("k")), "near-repeated")
    drop_written(found)
    kept = docs.select("doc_id", "text", "lang", "source", "n_chars", text_hash())
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k"))
    kept = kept.join(guarded(gone), same, "left_anti")
    once = kept.join(guarded(repeated), same, "left_anti")
    if not repeated.isEmpty():
        once = once.unionByName(kept.join(guarded(repeated), same, "left_semi").dropDuplicates(["doc_id", "h"]))
    return once.drop("h")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85)


QUERIES, ORACLES = {"op5_near_duplicates": op5_near_duplicates}, {}
