"""Models against plain Python and numpy: language fusion, quadratic discriminant, long texts' tokens, pruned search."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from inkveil.llm import language, quality, token_counts, vectors

WORDS = {"en": "the and of that with from this have were which", "fr": "les des une que dans pour avec sont cette nous", "de": "der die und das nicht mit eine sich auch werden"}


def sentence(lang, n, seed):
    w = WORDS[lang].split()
    return " ".join(w[(seed * 7 + i * i + i) % len(w)] for i in range(n))


def classes_of(text):
    """Trigram classes of a text: lower-case letters, other bytes as blanks, none of blanks alone."""
    raw = text.encode()
    at, _ = language.trigrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return at.tolist()


def plain_identify(pages, docs):
    langs = sorted({lang for _, lang, t in docs if lang and t is not None})
    logs = {}
    for lang in langs:
        counts = np.full(language.CLASSES, 0.1)
        for _, x, t in docs:
            if x == lang and t is not None:
                for c in classes_of(t):
                    counts[c] += 1
        logs[lang] = np.log(counts / counts.sum())
    rows = []
    for page, url, html in pages:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        host = m[1].lower() if m else None
        domain = ".".join(host.split(".")[-2:]) if host and "." in host else None
        suffix = host.split(".")[-1] if host else None
        said = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", html or "", re.I)
        text = re.sub(r"<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&[#A-Za-z0-9]+;", " ", html or "", flags=re.I | re.S)
        c = classes_of(text)
        e = np.array([logs[lang][c].sum() for lang in langs]) * language.TEMPER * min(1, language.MOST_TRIGRAMS / max(len(c), 1))
        e -= e.max()
        rows.append((page, host, domain, suffix, said[1].lower() if said else "", e, np.exp(e) / np.exp(e).sum()))
    k, out = len(langs), {}
    mass = sum(r[6] for r in rows) + 1
    for page, host, domain, suffix, said, e, own in rows:
        rest = mass - own
        total = lambda f: np.maximum(sum((r[6] for r in rows if f(r)), np.zeros(k)) - own, 0)
        prior = rest / rest.sum()
        if host:
            sums = [total(lambda r: r[3] == suffix), total(lambda r: domain and r[3] == suffix and r[2] == domain) if domain else np.zeros(k), total(lambda r: r[1] == host)]
        else:
            sums = [np.zeros(k)] * 3
        for c, strength in zip(sums, language.STRENGTH):
            prior = (c + strength * prior) / (c.sum() + strength)
        s = total(lambda r: r[4] == said)
        share = max(s.sum(), 1.0) / rest.sum()
        says = np.log((s + language.DECLARED_STRENGTH * share) / (rest + language.DECLARED_STRENGTH))
        score = e + np.log(prior) + says
        p = np.exp(score - score.max())
        out[page] = (langs[int(score.argmax())], float((p / p.sum()).max()), langs[int(e.argmax())])
    return out


def test_language_is_plain_fusion(spark):
    docs = [(i, lang, sentence(lang, 30, i)) for i, lang in enumerate(["en", "fr", "de"] * 4)] + [(90, None, "x"), (91, "en", None)]
    pages = [(i, f"https://www.a{i % 2}.example.fr/{i}", f"<html lang='fr'><p>{sentence('fr', 20, i)}</p>") for i in range(8)]
    pages += [(10 + i, f"http://b{i % 3}.example.com", f"<HTML lang=en><script>var les</script>{sentence('en', 20, i)}") for i in range(6)]
    pages += [(30, "https://www.a0.example.fr/x", "<html lang=fr>ok"), (31, "http://b0.example.com", "<html lang=en>ok"), (32, None, "<b>ok</b>"), (33, "nonsense", None), (34, "https://de", sentence("de", 5, 1))]
    schema = "doc_id long, lang string, text string"
    got = language.identify(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, host int").repartition(3), spark.createDataFrame(docs, schema)).collect()
    want = plain_identify(pages, docs)
    for r in got:
        lang, p, text = want[r.page_id]
        assert (r.lang, r.text_lang) == (lang, text) and math.isclose(r.probability, p, rel_tol=1e-9), r
    by = {r.page_id: r for r in got}
    assert by[30].lang == "fr" and by[31].lang == "en" and by[30].text_lang == by[31].text_lang  # the same text: host and markup decide
    none = language.identify(spark.createDataFrame([(1, "https://a.b", "x")], "page_id long, url string, html string"), spark.createDataFrame([], schema)).first()
    assert none.lang is None and none.host == "a.b"
    assert language.identify(spark.createDataFrame([], "page_id long, url string, html string"), spark.createDataFrame(docs, schema)).count() == 0


def test_quality_is_a_plain_discriminant(spark):
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(["alpha", "Beta", "gamma,", "delta."], 40)) for _ in range(60)]
    bad = [" ".join(rng.choice(["$$$", "BUY", "now!!!", "1234"], rng.integers(1, 60))) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate([*good, *bad])] + [(500, None), (501, ""), (7, good[7])]
    labels = [(i, int(i < 60), 0) for i in range(120)] + [(3, 1, 0), (4, None, 0), (999, 1, 0)]
    got = quality.classify(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, x int").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    stats = lambda t: quality.statistics(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    x = [(y, stats(t)) for i, t in docs if not held(i) for j, y, _ in labels if j == i and y is not None]
    parts, every = [], np.zeros((len(quality.FEATURES),) * 2)
    of = {c: np.array([v for y, v in x if y == c]) for c in (0, 1)}
    for c in (0, 1):
        every += np.cov(of[c].T, bias=True) * len(of[c]) / len(x)
    for c in (0, 1):
        s = (1 - quality.POOLED) * np.cov(of[c].T, bias=True) + quality.POOLED * every
        s += quality.RIDGE * np.diag(np.diag(every) + 1e-6)
        parts.append((of[c].mean(axis=0), np.linalg.inv(s), np.linalg.slogdet(s)[1], math.log(len(of[c]) / len(x))))
    text = {}
    for i, t in docs:
        text.setdefault(i, t)
    for r in got:
        v = stats(text[r.doc_id])
        log = [w - 0.5 * (det + (v - m) @ inv @ (v - m)) for m, inv, det, w in parts]
        want = 1 / (1 + math.exp(min(max(log[0] - log[1], -700), 700)))
        assert r.held_out == held(r.doc_id) and abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.3), r
    right = [r.predicted == int(r.doc_id < 60) for r in got if r.held_out and r.doc_id < 120]
    assert len(right) > 10 and sum(right) / len(right) > 0.95
    assert quality.classify(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_long_unspaced_text(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    c, sp = token_counts.counter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    part = "".join("的一是不了人我在"[(i * i + i // 7) % 8] for i in range(3000)) + "internationalization" * 50 + "a" * 700
    for chunk in (64, 999):
        assert c.tokens(part, chunk=chunk) == len(sp.encode(part, num_threads=1))
    maps = [token_counts.ChunkMap(c.machine, part[i : i + 97]) for i in range(0, len(part), 97)]
    left, at, n = token_counts.composed(maps), token_counts.FIRST, 0
    for m in maps:  # composing is applying one after another
        at, k = m.apply(at)
        n += k
    assert (left.end, left.tokens) == (at, n)
    long = part * 200
    assert c.tokens(long) > 0 and len(long) > 900_000


@pytest.mark.parametrize("blocks", [(64, 16, 2), (4096, 1024, 32)])
def test_nearest_over_blocks(spark, monkeypatch, blocks):
    for name, n in zip(("CODE_BLOCK", "QUERY_BLOCK", "GROUP"), blocks):
        monkeypatch.setattr(vectors, name, n)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 24))
    x[300:360] = x[300]  # a large class of equal vectors
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(900, None, "c"), (950, [0.0] * 24, "c"), (1000, [float("nan")] * 24, "c"), (1050, [1.0], "c")]
    got = collections.defaultdict(list)
    for r in vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string").repartition(4), every=20).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    n, hit, total = np.linalg.norm(x, axis=1), 0, 0
    for q in range(0, 900, 20):
        s = (x * x[q]).sum(axis=1) / (n * n[q])
        want = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:5]
        mine = [v for _, v, _ in sorted(got[q])]
        assert all(abs(sc - s[v]) < 1e-12 for _, v, sc in got[q]) and len(mine) == 5
        hit, total = hit + len(set(want) & set(mine)), total + 5
    assert set(got) == set(range(0, 900, 20)) and hit / total >= 0.95
    assert sorted(got[300])[0][1] == 301
    assert vectors.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
