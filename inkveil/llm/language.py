"""Language identification by Bayesian fusion of text, markup, address and host.

Text likelihoods are multinomial over hashed byte trigrams, learnt from documents whose language is given.
From the text alone each page gets a first posterior. Grouped sums of these over declared languages,
address suffixes, domains and hosts give what a declared language says, and a prior for each host that is
smoothed towards its domain, its suffix and the whole: Dirichlet counts, level by level. A page's own share is
taken out of the sums of every level and of what its declared language says, so that no evidence counts twice.

Defined cases: a null or broken address has no host and takes the prior of the whole; null html is empty and
leaves priors and nothing else; very long pages are read whole, and their text counts for MOST_TRIGRAMS at most; an
unknown or missing declared language is a value like any other; ties go to the first language in order; equal pages
give equal results, also of one id; without labelled documents there are no languages, and lang is null; an empty
table gives no rows; other columns are ignored, whatever their names. Languages are those of the sample's documents;
of more than MOST_LANGUAGES, those with the most text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkveil.llm.common import guarded, small_batches, table, trimmed, utf8_slices, written

#: Trigram classes; documents learnt from (a bound, spread over the table by hash); weight of a dependent
#: trigram against an independent one, and the most trigrams that a text may count for.
CLASSES, SAMPLE_ROWS, TEMPER, MOST_TRIGRAMS = 1 << 15, 8000, 0.3, 400.0
#: Languages that are told apart at most.
MOST_LANGUAGES = 200
#: Dirichlet weights of the level above, for suffixes, domains and hosts, and of one declared language.
STRENGTH, DECLARED_STRENGTH = (20.0, 10.0, 5.0), 1.0


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram class and text of each trigram of lower-cased letters within a text."""
    low = raw.astype(np.uint32)
    low[(raw >= 65) & (raw <= 90)] += 32
    low[~(((low >= 97) & (low <= 122)) | (low >= 128))] = 32
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = (text[2:] == text[:-2]) & (code != 0x202020)
    return ((code[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64), text[2:][inside]


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities, languages x CLASSES, from a hash sample of about sample_rows documents."""
    small_batches(docs.sparkSession)
    known = docs.filter("lang is not null and text is not null")
    n = known.count()
    if n > sample_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 20)) < int((1 << 20) * sample_rows / n) + 1)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            c, text = trigrams(*utf8_slices(b.column(1)))
            for lang in set(langs):
                mine = (langs == lang)[text]
                sums[lang] = sums.get(lang, 0) + np.bincount(c[mine], minlength=CLASSES)
        for lang, s in sums.items():
            i = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i)), pa.array(i.astype(np.int32)), pa.array(s[i].astype(np.int64))], ["lang", "i", "n"])

    rows = known.select("lang", "text").mapInArrow(trimmed(run), "lang string, i int, n long").groupBy("lang", "i").agg(F.sum("n").alias("n"))
    got = rows.groupBy("lang").agg(F.collect_list("i").alias("i"), F.collect_list("n").alias("n")).collect()
    got = sorted(got, key=lambda r: (-sum(r.n), r.lang))[:MOST_LANGUAGES]
    langs = sorted(r.lang for r in got)
    counts = np.full((len(langs), CLASSES), 0.1)
    for r in got:
        counts[langs.index(r.lang), r.i] += r.n
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)) if langs else counts


def _address(url: Column) -> tuple[Column, Column, Column]:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(host, F.lit("")), F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), F.nullif(F.regexp_extract(host, r"([^.]+)$", 1), F.lit(""))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, probability, text_lang, declared, host of every page."""
    langs, logs = learn(docs)
    k = len(langs)
    host, domain, suffix = _address(F.col("url"))
    html = F.coalesce(F.col("html"), F.lit(""))
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&[#A-Za-z0-9]+;", " ")
    seen = pages.select("page_id", host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), declared.alias("declared"), text.alias("text"))
    if not k:
        return seen.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    small_batches(pages.sparkSession)
    names = ["page_id", "host", "domain", "suffix", "declared", "text_lang", "evidence", *[f"p{i}" for i in range(k)]]

    def run(batches):
        for b in batches:
            raw, offsets = utf8_slices(b.column(5))
            n = len(offsets) - 1
            c, of = trigrams(raw, offsets)
            sums = np.stack([np.bincount(of, weights=logs[i][c], minlength=n) for i in range(k)], axis=1)
            count = np.bincount(of, minlength=n)
            evidence = sums * (TEMPER * np.minimum(1.0, MOST_TRIGRAMS / np.maximum(count, 1)))[:, None]
            evidence -= evidence.max(axis=1, keepdims=True)
            post = np.exp(evidence)
            post /= post.sum(axis=1, keepdims=True)
            best = [langs[i] for i in evidence.argmax(axis=1)]
            rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(evidence.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(best), rows, *[pa.array(post[:, i]) for i in range(k)]], names)

    schema = "page_id long, host string, domain string, suffix string, declared string, text_lang string, evidence array<double>, " + ", ".join(f"p{i} double" for i in range(k))
    first = written(seen.mapInArrow(trimmed(run), schema), "lang-first")
    sums = lambda tag: [F.sum(f"p{i}").alias(f"{tag}{i}") for i in range(k)]
    arr = lambda tag: F.array(*[F.col(f"{tag}{i}") for i in range(k)])
    whole = first.agg(*sums("s")).first()
    mass = F.array(*[F.lit(float(whole[i] or 0.0) + 1.0) for i in range(k)])
    none = F.array(*[F.lit(0.0)] * k)
    of = lambda counts: F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    def smooth(counts: Column, above: Column, strength: float) -> Column:
        return F.zip_with(counts, above, lambda c, p: (c + strength * p) / (of(counts) + strength))

    def level(*keys: str) -> DataFrame:
        return first.filter(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(*sums("s")).select(*keys, arr("s").alias(f"{keys[-1]}_n"))

    # One row a host: its sums, and those of the levels above it.
    low = first.filter(F.col("host").isNotNull()).groupBy("host").agg(F.first("domain").alias("domain"), F.first("suffix").alias("suffix"), *sums("s")).select("host", "domain", "suffix", arr("s").alias("host_n"))
    low = low.join(level("suffix"), "suffix", "left").join(level("suffix", "domain"), ["suffix", "domain"], "left").select(F.col("host").alias("at"), "host_n", "domain_n", "suffix_n")
    low = guarded(written(low, "lang-hosts"), 64 + 24 * k)
    said = guarded(written(first.groupBy("declared").agg(*sums("s")).select(F.col("declared").alias("says"), arr("s").alias("said_n")), "lang-declared"), 64 + 8 * k)
    # A page without a host meets none; keys of their own keep such pages from one task.
    key = F.coalesce("host", F.concat(F.lit("\0"), F.pmod(F.xxhash64("page_id", "declared"), F.lit(4096)).cast("string")))
    out = first.join(low, key == F.col("at"), "left").join(said, F.col("declared") == F.col("says"), "left")
    own = arr("p")
    minus = lambda col: F.zip_with(F.coalesce(col, none), own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    rest = F.zip_with(mass, own, lambda a, b: F.greatest(a - b, F.lit(1e-9)))
    out = out.withColumn("rest", rest).withColumn("prior", F.transform("rest", lambda x: x / of(F.col("rest"))))
    for tag, strength in zip(("suffix_n", "domain_n", "host_n"), STRENGTH):
        out = out.withColumn(tag, minus(F.col(tag))).withColumn("prior", smooth(F.col(tag), F.col("prior"), strength))
    # P(declared | language): the declared value's mass over the language's whole mass, smoothed by its overall share.
    out = out.withColumn("said_n", minus(F.col("said_n")))
    share = F.greatest(of(F.col("said_n")), F.lit(1.0)) / of(F.col("rest"))
    says = F.zip_with("said_n", "rest", lambda a, t: F.log((a + DECLARED_STRENGTH * share) / (t + DECLARED_STRENGTH)))
    score = F.zip_with(F.zip_with("evidence", F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b), says, lambda a, b: a + b)
    out = out.withColumn("score", score).withColumn("top", F.array_max("score"))
    total = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names_col = F.array(*[F.lit(x) for x in langs])
    return out.select("page_id", F.element_at(names_col, F.array_position("score", F.col("top")).cast("int")).alias("lang"), (1 / total).alias("probability"), "text_lang", "declared", "host")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


QUERIES, ORACLES = {"op1_language": op1_language}, {}
