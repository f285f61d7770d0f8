"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a fixed number of statistics of its bytes, words and lines, brought near to normal by logs and
logits. Of both classes the sums and the products of pairs are added up over all labelled training rows,
partition by partition; shrunk covariances and their Cholesky factors come from those sums. A score is the
logistic of the difference of the two log densities, by Mahalanobis distances, plus the log ratio of classes.

Defined cases: null text is empty; an empty text has statistics like any other and so a score; labels that
are null are left out; several labels of a document count each, and so do labelled rows that repeat an id; very long
texts are read whole; without labels of both classes every score is the share of label 1, or 0.5 if there are none;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkveil.llm.common import guarded, mix64, range_hashes, small_batches, table, trimmed, utf8_slices, written

FOLDS, THRESHOLD = 5, 0.3
#: Weight of the pooled covariance in a class's own, and of the diagonal added to it.
POOLED, RIDGE = 0.2, 0.05

_BYTES = np.arange(256)
_SETS = {
    "space": np.isin(_BYTES, [32, 9, 10, 11, 12, 13]),
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "stop": np.isin(_BYTES, [ord(c) for c in ".?"]),
    "comma": np.isin(_BYTES, [ord(c) for c in ",;:'\"()-"]),
    "sign": np.isin(_BYTES, [ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]),
    "line": _BYTES == 10,
    "high": _BYTES >= 128,
}
FEATURES = ("log_bytes", "log_words", "word_length", "space", "upper", "lower", "digit", "stop", "comma", "sign", "line", "high", "same_as_before", "distinct_words", "distinct_lines", "short_words", "long_words", "line_length", "words_ending_in_signs", "capitals_first")


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text raw[offsets[i]:offsets[i + 1]]."""
    n = len(offsets) - 1
    size = np.diff(offsets)

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    counts = {k: per_text(s[raw]) for k, s in _SETS.items()}
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True  # a text's first byte, and the end
    same = np.zeros(len(raw), bool)
    same[1:] = raw[1:] == raw[:-1]
    same &= ~first[:-1]

    def runs(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end and text of each run between gaps."""
        inside = np.concatenate([~gap, [False]])
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | first[1:]
        stop = ~inside | first
        at = np.flatnonzero(begin[:-1])
        edges = np.flatnonzero(stop)
        to = edges[np.searchsorted(edges, at, side="right")] if len(at) else at
        return at, to, np.searchsorted(offsets, at, side="right") - 1

    def distinct(at: np.ndarray, to: np.ndarray, text: np.ndarray) -> np.ndarray:
        h = range_hashes(raw, at, to) + mix64(text.astype(np.uint64) + np.uint64(1))
        _, i = np.unique(h, return_index=True)
        return np.bincount(text[i], minlength=n)

    at, to, text = runs(_SETS["space"][raw])
    words = np.bincount(text, minlength=n)
    length = to - at
    one = lambda m: np.bincount(text[m], minlength=n)
    lat, lto, ltext = runs(raw == 10)
    lines = np.bincount(ltext, minlength=n)
    share = lambda a, b: (a + 0.5) / (b + 1.0)
    logit = lambda p: np.log(p / (1.0 + 1e-9 - np.minimum(p, 1 - 1e-6)))
    cols = [np.log1p(size), np.log1p(words), np.log((size - counts["space"] + 1.0) / (words + 1.0))]
    cols += [logit(share(counts[k], size)) for k in ("space", "upper", "lower", "digit", "stop", "comma", "sign", "line", "high")]
    cols += [logit(share(per_text(same), size)), np.log(share(distinct(at, to, text), words)), np.log(share(distinct(lat, lto, ltext), lines))]
    last = raw[np.maximum(to - 1, 0)] if len(at) else np.zeros(0, np.uint8)
    start = raw[at] if len(at) else np.zeros(0, np.uint8)
    cols += [logit(share(one(length <= 3), words)), logit(share(one(length > 12), words)), np.log((size + 1.0) / (lines + 1.0)), logit(share(one(_SETS["sign"][last]), words)), logit(share(one(_SETS["upper"][start]), words))]
    return np.stack(cols, axis=1) if n else np.zeros((0, len(FEATURES)))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, x (array of FEATURES) of every document."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            raw, offsets = utf8_slices(b.column(2))
            x = statistics(raw, offsets)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], ["doc_id", "held_out", "x"])

    held = F.coalesce(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(trimmed(run), "doc_id long, held_out boolean, x array<double>")


def moments(rows: DataFrame, d: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """label -> number, sum, sum of products; rows: label, x. Each partition adds up its own; the driver gets a number fixed by d."""

    def run(batches):
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy().reshape(-1, d)
            for c in np.unique(y):
                z = np.concatenate([np.ones((int((y == c).sum()), 1)), x[y == c]], axis=1)
                acc[int(c)] = acc.get(int(c), 0) + z.T @ z
        for c, m in acc.items():
            k = m.size
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, c, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(m.ravel())], ["label", "i", "v"])

    got = rows.mapInArrow(trimmed(run), "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for c in {r.label for r in got}:
        m = np.zeros((d + 1) ** 2)
        for r in got:
            if r.label == c:
                m[r.i] = r.v
        m = m.reshape(d + 1, d + 1)
        out[c] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


class Discriminant:
    """Class means, Cholesky factors of the shrunk covariances, and log weights."""

    def __init__(self, stats: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = POOLED, ridge: float = RIDGE):
        total = sum(s[0] for s in stats.values())
        self.flat = None
        if not (stats.get(0) and stats.get(1)):
            self.flat = stats[1][0] / total if stats.get(1) else (0.0 if total else 0.5)
            return
        mean = {c: s[1] / s[0] for c, s in stats.items()}
        cov = {c: s[2] / s[0] - np.outer(mean[c], mean[c]) for c, s in stats.items()}
        both = sum(stats[c][0] * cov[c] for c in (0, 1)) / total
        scale = np.diag(both) + 1e-6
        self.parts = []
        for c in (0, 1):
            s = (1 - pooled) * cov[c] + pooled * both
            factor = np.linalg.cholesky(s + ridge * np.diag(scale))
            self.parts.append((mean[c], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(stats[c][0] / total)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        log = [w - 0.5 * (det + (((x - m) @ inv.T) ** 2).sum(axis=1)) for m, inv, det, w in self.parts]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    d = len(FEATURES)
    x = written(features(docs), "quality-features")
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("label in (0, 1)")
    model = Discriminant(moments(x.filter("not held_out").join(known, "doc_id").select("label", "x"), d))

    def run(batches):
        for b in batches:
            s = model.scores(b.column(2).flatten().to_numpy().reshape(-1, d))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return x.mapInArrow(trimmed(run), "doc_id long, held_out boolean, score double, predicted int")


def fit(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """The model from the labelled training rows of docs alone."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("label in (0, 1)")
    near = guarded(known.select("doc_id").distinct())
    x = features(docs.select("doc_id", "text").join(near, "doc_id", "left_semi")).filter("not held_out")
    return Discriminant(moments(x.join(known, "doc_id").select("label", "x"), len(FEATURES)))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, n_chars of the documents that are predicted 1."""
    model = fit(docs, labels)
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            good = model.scores(statistics(*utf8_slices(b.column(1)))) >= THRESHOLD
            yield b.filter(pa.array(good))

    return docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(trimmed(run), "doc_id long, text string, lang string, source string, n_chars long")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES, ORACLES = {"op4_quality": op4_quality}, {}
