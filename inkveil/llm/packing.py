"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

A document's ids and the end id are cut at multiples of the sequence length; what is left over is shorter
than a sequence. Documents are dealt by a hash of their id and text to groups of bounded size on average; in each
group the pieces go, largest first, each to the first open sequence that has room. A tree whose inner nodes hold
the larger of their two children's room finds that sequence in logarithmic time.

Ids never leave the worker that made them: a piece's checksum is taken there, and only lengths are shuffled.

Defined cases: null or empty text is a document of the end id alone; rows that repeat an id are documents of
their own, and rows that repeat id and text share a group, where equal pieces are placed one after another; a very
long text is cut into whole sequences and a rest; an empty table gives no rows; columns other than doc_id and text
are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkveil.llm.common import range_hashes, small_batches, table, trimmed

LENGTH, END_ID = 4096, 2
#: Documents and text bytes of a group, on average: some thousands of sequences, a few MB in a task.
GROUP_ROWS, GROUP_BYTES = 8192, 64 << 20
#: Entries of word parts that a worker keeps, twice over; one batch may add to them.
MAX_PARTS = 150_000


class WordIds:
    """The ids of texts, as little-endian bytes, by a table of word parts.

    The tokenizer drops white space, cuts what is left by a pattern and merges within a part only. Texts of
    printable ASCII and Latin-1 letters are lower-cased and cut here as that pattern cuts them; their unseen
    parts go, many in one call, through the tokenizer's own merges, and the end-of-word mark of its tokens
    tells where a part's ids end. Other texts are cut at spaces, over which nothing is joined, and those of
    their words that hold other characters go through the whole tokenizer.
    """

    PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
    PART = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-zß-öø-ÿ0-9\s]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.all = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            bare = json.load(f)
        end = bare["model"].get("end_of_word_suffix")
        self.specials = tuple(t["content"] for t in bare["added_tokens"])
        self.ends = np.zeros(1 + max(bare["model"]["vocab"].values()), bool)
        self.ends[[i for k, i in bare["model"]["vocab"].items() if end and k.endswith(end)]] = True
        self.bare = Tokenizer.from_str(json.dumps(bare | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        self.parts: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}
        # The tokenizer's letters for bytes: printable bytes stand for themselves, the others for 256 and up.
        others = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.letter = {b: chr(256 + i) for i, b in enumerate(others)}
        self.fast = bool(end)
        probes = ["It's ÀÉ'ßx42--y don't!!", "A1b2 x'll.y ÿ 3", "a|b_c~ L'Été, Straße'S\nx''s 'd9"]
        self.fast = self.fast and self.batch(probes) == [self.whole(t) for t in probes]

    def whole(self, text: str) -> bytes:
        return np.array(self.all.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, text: str) -> bool:
        return self.fast and bool(self.PLAIN.fullmatch(text)) and not ("<" in text and any(s in text for s in self.specials))

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(parts), 256):
            some = parts[i : i + 256]
            spelt = " ".join(p if p.isascii() else "".join(self.letter.get(b) or chr(b) for b in p.encode()) for p in some)
            ids = np.array(self.bare.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            raw = ids.tobytes()
            out += [raw[x:y] for x, y in zip(cuts, cuts[1:])]
            if len(out) != i + len(some):
                raise ValueError(f"the tokenizer's pieces of {len(some)} parts end {len(out) - i} times")
        return out

    def batch(self, texts: list[str]) -> list[bytes]:
        plain = [self.plain(t) for t in texts]
        # An apostrophe may begin a part of its own; such texts are cut by the pattern, the others by byte classes.
        quoted = [p and "'" in t for t, p in zip(texts, plain)]
        out: list[bytes] = [b""] * len(texts)
        dense = [i for i, (p, q) in enumerate(zip(plain, quoted)) if p and not q]
        for i, x in zip(dense, self.dense([texts[i] for i in dense])):
            out[i] = x
        words: dict[str, bytes] = {}
        for i, (t, p, q) in enumerate(zip(texts, plain, quoted)):
            if not p or q:
                cut = t.replace("\n", " ").split(" ")
                new = [w for w in dict.fromkeys(cut) if w not in words]
                whole = [w for w in new if not self.plain(w)]
                words.update((w, self.whole(w)) for w in whole)
                odd = [w for w in new if w not in words]
                for w, x in zip(odd, self.dense(odd, [self.PART.findall(w.lower()) if "'" in w else None for w in odd])):
                    words[w] = x
                out[i] = b"".join(map(words.__getitem__, cut))
        return out

    def dense(self, texts: list[str], given: list[list[str] | None] | None = None) -> list[bytes]:
        """Ids of plain texts. given: a text's parts, where they have been cut already."""
        if not texts:
            return []
        if given and any(given):
            texts = [" ".join(g) if g else t for t, g in zip(texts, given)]
        raw = np.frombuffer("\n".join(texts).encode() + b"\n", np.uint8).copy()
        lengths = np.fromiter((len(t.encode()) if not t.isascii() else len(t) for t in texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
        raw[(raw >= 65) & (raw <= 90)] += 32
        high = np.flatnonzero((raw >= 0x80) & (raw <= 0x9E))
        raw[high[raw[high - 1] == 0xC3]] += 32
        kind = BYTE_KIND[raw]
        edge = np.empty(len(raw), bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= kind == 2
        if given and any(given):  # what was cut is kept apart by the spaces alone
            edge[1:] &= (kind[1:] == 0) | (kind[:-1] == 0) | ~np.repeat([g is not None and bool(g) for g in given], lengths + 1)[1:]
        at = np.flatnonzero(edge)
        to = np.append(at[1:], len(raw))
        real = kind[at] != 0
        at, to = at[real], to[real]
        if not len(at):
            return [b""] * len(texts)
        keys, first, inverse = np.unique(range_hashes(raw, at, to), return_index=True, return_inverse=True)
        keys = keys.tolist()
        found = list(map(self.parts.get, keys))
        unseen = [i for i, x in enumerate(found) if x is None]
        if unseen:
            if len(self.parts) >= MAX_PARTS:  # two generations: what is still in use comes back from the old one
                self.old, self.parts = self.parts, {}
            fresh = []
            for i in unseen:
                found[i] = self.old.get(keys[i])
                if found[i] is None:
                    fresh.append(i)
                else:
                    self.parts[keys[i]] = found[i]
            data = raw.tobytes()
            for i, x in zip(fresh, self.encode_parts([data[at[first[i]] : to[first[i]]].decode() for i in fresh])):
                found[i] = self.parts[keys[i]] = x
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        begins = np.cumsum(sizes) - sizes
        n = sizes[inverse]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begins[inverse] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        cuts = (4 * upto[np.searchsorted(at, offsets)]).tolist()
        return [ids[x:y] for x, y in zip(cuts, cuts[1:])]


#: Of the bytes of lower-cased plain text: 0 white space, 1 letters, 2 digits, 3 signs.
BYTE_KIND = np.full(256, 3, np.uint8)
BYTE_KIND[[9, 10, 13, 32]] = 0
BYTE_KIND[97:123] = BYTE_KIND[0x80:] = 1
BYTE_KIND[48:58] = 2


_WORDS: dict[str, WordIds] = {}


def pieces(docs: DataFrame, path: str | None, length: int, end_id: int) -> DataFrame:
    """doc_id, h (of its text), start, length, ids_crc32, doc_tokens of every piece."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "h", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        import public_tokenizers

        at = path or public_tokenizers.path("word_bpe_49k.json")
        words = _WORDS.get(at) or _WORDS.setdefault(at, WordIds(at))
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[list] = [[] for _ in names]
            texts = words.batch(b.column(2).to_pylist())
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts):
                ids = memoryview(t + end)
                total = len(ids) // 4
                for s in range(0, total, length):
                    x = ids[4 * s : 4 * (s + length)]
                    for c, v in zip(out, (i, h, s, len(x) // 4, zlib.crc32(x), total)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(trimmed(run), ", ".join(f"{n} long" for n in names))


class Tournament:
    """The room of each bin in the leaves; the first bin with room for a size in O(log n)."""

    def __init__(self, bins: int, room: int):
        self.n = 1 << max(0, (bins - 1).bit_length())
        self.best = [room] * (2 * self.n)

    def place(self, size: int) -> tuple[int, int]:
        """The bin that takes the size, and the room that it had."""
        best, i = self.best, 1
        while i < self.n:
            i *= 2
            if best[i] < size:
                i += 1
        room = best[i]
        best[i] -= size
        at = i - self.n
        while i > 1:
            i //= 2
            new = max(best[2 * i], best[2 * i + 1])
            if best[i] == new:
                break
            best[i] = new
        return at, room


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """bin and offset of each size; sizes come in descending order."""
    tree = Tournament(max(1, len(sizes)), room)
    placed = [tree.place(s) for s in sizes.tolist()]
    return np.array([b for b, _ in placed], np.int64), np.array([room - left for _, left in placed], np.int64)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(1, -(-rows // GROUP_ROWS), -(-(size or 0) // GROUP_BYTES))
    dealt = pieces(docs, path, length, end_id).withColumn("group", F.pmod(F.xxhash64("doc_id", "h"), F.lit(groups)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(t: pa.Table) -> pa.Table:
        col = {c: t.column(c).to_numpy() for c in ("start", "length", "ids_crc32", "doc_tokens", "h", "group")}
        ids = t.column("doc_id")
        order = np.lexsort((col["ids_crc32"], col["start"], col["h"], ids.fill_null(-1).to_numpy(), -col["length"]))
        bins, offsets = first_fit_decreasing(col["length"][order], length)
        cols = [ids.take(pa.array(order)), *[pa.array(col[c][order]) for c in names[1:5]], pa.array((col["group"][:1] << 32) + bins), pa.array(offsets)]
        return pa.table(cols, names)

    return dealt.groupBy("group").applyInArrow(run, ", ".join(f"{n} long" for n in names))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES, ORACLES = {"op2_packing": op2_packing}, {}
