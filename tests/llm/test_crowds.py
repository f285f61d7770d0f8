"""Near-duplicates in crowded regions against brute force: chains, stars and lookalikes of one template."""

import random

import pytest

from inkveil.llm import near_dup


def shingles(text):
    w = text.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def components(texts, percent):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if 100 * both >= percent * (len(x) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def template(seed, n=150):
    r = random.Random(seed)
    return [f"w{r.randint(0, 9999)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    r, out = random.Random(4), []
    base = template(1)
    for k in range(150):  # near copies of one template, some of them too far from most others
        w = list(base)
        for _ in range(r.choice([1, 1, 2, 3, 5, 8])):
            w[r.randint(0, len(w) - 1)] = f"x{r.randint(0, 99999)}"
        out.append(" ".join(w))
    chain = template(2)
    for k in range(40):  # a chain: each one word further from the first
        chain[3 * k % len(chain)] = f"c{k}"
        out.append(" ".join(chain))
    half = template(3, 80)
    out += [" ".join(half + template(100 + k, 70)) for k in range(60)]  # a common half, linked with nothing
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("region", "window", "block"), [(2048, 64, 256), (8, 2, 4)])
def test_no_link_is_lost(spark, monkeypatch, texts, region, window, block):
    for name, v in (("REGION", region), ("WINDOW", window), ("BLOCK", block), ("SAMPLE", 4), ("LEAVES", 5)):
        monkeypatch.setattr(near_dup, name, v)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = [r.component_id for r in near_dup.near_duplicates(docs, 85).orderBy("doc_id").collect()]
    want = components(texts, 85)
    assert got == want and 60 < len(set(want)) < len(texts)
