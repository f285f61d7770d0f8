"""Each stage of the pipeline, and all in a row, against plain Python on a small table with planted cases."""

import collections
import random

import pytest

import corpus_pipeline
from inkveil.llm import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join(f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.randint(0, 999)}" for _ in range(n))


def changed(text, words):
    w = text.split()
    for i in words:
        w[i] = f"other{i}"
    return " ".join(w)


PASSAGE = prose(777, 60)
A = prose(1)
ROWS = [
    (1, A, "s0"), (2, A, "s1"), (3, changed(A, [50]), "s0"), (4, changed(A, [20, 60]), "s0"),  # exact, near by 0.92 and 0.85
    (5, prose(2), "s0"), (6, f"{prose(3)} {PASSAGE} {prose(4)}", "s1"), (7, f"{prose(5)}\n{PASSAGE}\n{prose(6)}", None),
    (None, changed(prose(8), [3]), "s1"), (9, prose(8), "s1"), (None, prose(9), "s1"),  # a null id that goes, and one that stays
    (11, prose(11), "s0"), (11, prose(12), "s0"), (11, prose(11), "s0"),  # a repeated id of two texts, one of them twice
    (13, "", "s0"), (14, None, None), (15, " \t", "s0"), (16, "short text", "s1"), (17, "short text", "s1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in ROWS], SCHEMA).repartition(3)


def shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_near(rows, percent=80):
    sets, up = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return collections.Counter(root(i) if sets[i] else -1 - i for i in range(len(rows)))


def test_near_dup_stage(spark, docs):
    got = corpus_pipeline.near_dup_stage(spark, docs, "")
    assert got.columns == COLUMNS
    rows = [(r.doc_id, r.text, r.source) for r in got.collect()]
    assert len(rows) == len(plain_near(ROWS))  # one row a component, and each text without words
    assert all(n == 1 for n in plain_near(rows).values())
    texts = collections.Counter(t for _, t, _ in rows)
    assert texts[A] == 1 and texts[prose(9)] == 1 and texts[prose(11)] == 1 and texts[prose(12)] == 1 and texts["short text"] == 1
    assert {i for i, t, _ in rows if t == prose(8) or t == changed(prose(8), [3])} == {9}  # a null id names no component


def test_repeats_stage(spark, docs):
    got = corpus_pipeline.repeats_stage(spark, docs, "")
    assert got.columns == COLUMNS
    raw = [(t or "") for _, t, _ in ROWS]
    strings = collections.Counter(b[s : s + 400] for b in map(str.encode, raw) for s in range(len(b) - 399))
    runs = collections.Counter(w for t in raw for w in {tuple(t.split()[s : s + 51]) for s in range(len(t.split()) - 50)})

    def plain(t):
        b, gone = t.encode(), bytearray(len(t.encode()))
        for s in range(len(b) - 399):
            if strings[b[s : s + 400]] > 1:
                gone[s : s + 400] = b"\1" * 400
        ends, at = [], 0
        for w in t.split():
            at = t.index(w, at)
            ends.append((at, at + len(w)))
            at += len(w)
        for s in range(len(ends) - 50):
            if runs[tuple(t.split()[s : s + 51])] > 1:
                gone[ends[s][0] : ends[s + 50][1]] = b"\1" * (ends[s + 50][1] - ends[s][0])
        return bytes(x for x, y in zip(b, gone) if not y).decode()

    want = collections.Counter((i, plain(t or "")) for i, t, _ in ROWS)
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert want[(5, prose(2))] == 1 and (6, f"{prose(3)} {PASSAGE} {prose(4)}") not in want


def test_mixing_stage(spark, docs):
    sizes = collections.Counter()
    for _, t, s in ROWS:
        sizes[s] += len((t or "").split())
    got = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.mixing_stage(spark, docs, "").collect()]
    taken = collections.Counter()
    for _, t, s in got:
        taken[s] += len(t.split())
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), (3, 1, 2)))
    want, free, left = {}, dict(weights), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] > 2 * sizes[s]]
        if not over:
            want |= {s: level * w for s, w in free.items()}
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
            del free[s]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3, (s, taken[s], want[s])
    by = collections.Counter()
    for i, t, s in got:
        by[i, s] += len(t.split())
    for (i, s), n in by.items():
        assert n <= 2 * sum(len((t or "").split()) for j, t, x in ROWS if (j, x) == (i, s))
    assert {" ".join((t or "").split())[:10] for _, t, _ in got} <= {" ".join((t or "").split())[:10] for _, t, _ in ROWS}


def test_quality_stage_and_run(spark, tmp_path):
    junk = [(100 + i, "$$$ BUY now!!! " * (i % 5 + 1), "s0") for i in range(40)]
    clean = [(200 + i, prose(1000 + i, 60), "s1") for i in range(40)]
    rows = [*ROWS, *junk, *clean]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 200), 0) for i, _, _ in [*junk, *clean]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    kept = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    assert kept.columns == COLUMNS
    scored = quality.classify(docs, labels).filter("predicted = 1")
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids == collections.Counter(r.doc_id for r in scored.collect())
    assert not any(100 <= (i or 0) < 140 for i in ids) and all(200 + i in ids for i in range(40))
    step = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        step = stage(spark, step, str(tmp_path))
        step.write.parquet(f"{tmp_path}/{k}")
        step = spark.read.parquet(f"{tmp_path}/{k}")
    order = lambda d: sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in d.collect())
    whole = order(corpus_pipeline.run(spark, str(tmp_path)))
    assert whole == order(step) and all(200 + i in {r[0] for r in whole} for i in range(40))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
