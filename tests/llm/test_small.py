"""Operators against brute force and round trips on small tables with nulls, ties, empty texts, clashing columns."""

import collections
import hashlib
import json

import numpy as np
import pytest

from inkveil.llm import licenses, mixing, mpeg_audio, near_dup, packing, quality, repeats, suffixes, token_counts, vectors

BASE = " ".join(f"word{i}" for i in range(120))
TEXTS = [BASE, BASE, BASE + " tail", BASE.replace("word60", "other"), "", None, "short text", "short text", "a" * 1000, "Ünïcode – 日本 🙂 l'été don't", "x\n\n y  z", "Licensed under CC BY-NC 4.0.", " \t\n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i < 11 else None, t, "en", None if i % 3 else f"s{i % 2}", 0, i, i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h long, k long").repartition(3)


@pytest.mark.parametrize("crowd", [1024, 1])
def test_repeats(docs, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)  # 1: groups are split to the last
    raw = [(t or "").encode() for t in TEXTS]
    c = collections.Counter(b[s : s + 400] for b in raw for s in range(len(b) - 399))
    want = []
    for b in raw:
        m = bytearray(len(b))
        for s in range(len(b) - 399):
            if c[b[s : s + 400]] > 1:
                m[s : s + 400] = b"\1" * 400
        want.append(hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest())
    got = [hashlib.sha256(repeats.keep((r.text or "").encode(), repeats.merged(r.starts, r.ends))).hexdigest() for r in repeats.with_spans(docs).collect()]
    assert sorted(got) == sorted(want)


def test_suffix_order():
    rng = np.random.default_rng(2)
    for n in [*range(12), *rng.integers(12, 80, 60)]:
        for most in (1, 2, 5, 300):
            t = rng.integers(1, most + 1, n)
            assert suffixes.suffix_order(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
    with pytest.raises(ValueError):
        suffixes.suffix_order(np.ones(suffixes.MOST, np.int8))


@pytest.mark.parametrize("crowd", [1024, 1])
def test_passages(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    """Passages of over 50 words against every window of 51, by documents."""
    shared = " ".join(f"w{i % 7}{i}" for i in range(51))
    texts = [f"a b {shared} c", f"{shared}\n\nd", shared.replace(" ", "\t"), " ".join(f"w{i % 7}{i}" for i in range(50)), " ".join(["x"] * 200), f"q {shared} r {shared}", None, "", "twice " * 60, "twice " * 60]
    words = [(t or "").split() for t in texts]
    held = collections.Counter(w for ws in words for w in {tuple(ws[s : s + 51]) for s in range(len(ws) - 50)})
    want = []
    for ws in words:
        m = [False] * len(ws)
        for s in range(len(ws) - 50):
            if held[tuple(ws[s : s + 51])] > 1:
                m[s : s + 51] = [True] * 51
        want.append("".join(w for w, x in zip(ws, m) if not x))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sorted(repeats.with_spans(docs).collect(), key=lambda r: r.doc_id)
    assert ["".join(repeats.keep(r.text.encode(), repeats.in_bytes(r.text.encode(), r.p_starts, r.p_ends, repeats.PASSAGES)).decode().split()) for r in rows] == want
    assert want[4] != "" and want[0] == "abc" and want[8] == ""


def test_near_duplicates(docs):
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect() if r.doc_id is not None}
    assert [got[i].component_id for i in range(11)] == [0, 0, 0, 0, 4, 5, 6, 6, 8, 9, 10]
    assert got[0].n_shingles == 116 and got[4].n_shingles == 0 and got[6].n_shingles == 1 and got[4].kept


def test_packing(docs):
    rows = packing.pack(docs, length=64).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_word_ids():
    import public_tokenizers

    w = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t or "" for t in TEXTS] + ["x<|endoftext|>y", "\x1c \x85 a\tb", "It's 'tis O'Neil's"]
    assert w.batch(texts) == [w.whole(t) for t in texts]


def test_token_counts():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.counter(path)
    for t in [t or "" for t in TEXTS] + ["  a  b ", "▁x", "<s>", "=" * 999, "a b\tc\r\n"]:
        n = len(sp.encode(t, num_threads=1))
        assert c.tokens(t) == n and c.tokens(t, chunk=7) == n


def test_mixing(docs):
    rows = mixing.take(docs).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.taken <= 2 * r.size for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 2
    assert sorted(map(str, rows)) == sorted(map(str, mixing.take(docs).collect()))


def test_mpeg_round_trip_and_resync():
    for t in TEXTS:
        p = mpeg_audio.padded((t or "").encode())
        m = mpeg_audio.encode(p)
        x = mpeg_audio.parse(m)
        assert x["payload"] == p and not x["bad_checks"] and not x["skipped"] and x["vbr"]["frames"] == x["frames"]
        json.dumps(x["offsets"])
    m = mpeg_audio.encode(bytes(range(256)) * 64)
    whole, broken = mpeg_audio.parse(m), mpeg_audio.parse(m[:900] + b"\xff\xfbjunk" + m[900:])
    assert broken["skipped"] and broken["frames"] >= whole["frames"] - 2
    assert mpeg_audio.parse(b"")["seconds"] == 0.0


def test_mpeg_foreign_streams(spark):
    """Layers I and II, VBRI, ID3v2.2, delays: streams put together by hand."""
    M = mpeg_audio
    frame = lambda h, body=b"": (h.to_bytes(4) + body).ljust(M.header_fields(h)["length"], b"\0")
    one, two = 0xFFFF << 16 | 5 << 12 | 3 << 6, 0xFFFD << 16 | 4 << 12 | 1 << 10  # Layer I 44.1 kHz mono, Layer II 48 kHz, unprotected
    assert M.header_fields(one)["length"] == (12 * 160000 // 44100) * 4 and M.header_fields(two)["length"] == 144 * 64000 // 48000
    a = M.parse(frame(one) * 5)
    assert (a["layer"], a["frames"], a["samples"], a["seconds"], a["checks"]) == (1, 5, 1920, 1920 / 44100, 0)
    guarded = one & ~(1 << 16)
    crc = M.frame_crc(guarded.to_bytes(4)[2:] + bytes(16))
    x = M.parse(frame(guarded, crc.to_bytes(2)) * 3 + frame(guarded, b"\1\1"))
    assert (x["checks"], x["bad_checks"]) == (4, 1)
    tag = b"TT2" + (6).to_bytes(3) + b"\0title"
    b = M.parse(b"ID3\x02\0\0" + M._synchsafe(len(tag)) + tag + b"junk" + frame(two) * 4)
    assert b["tags"] == {"TIT2": "title"} and (b["layer"], b["frames"], b["samples"], b["skipped"]) == (2, 4, 4608, 4)
    assert M.parse(frame(two & ~(1 << 16)) * 4)["unchecked"] == 4
    three = 0xFFFB << 16 | 9 << 12
    n = M.header_fields(three)["length"]
    vbri = bytes(32) + b"VBRI" + (1).to_bytes(2) + (1105).to_bytes(2) + bytes(2) + (9 * n).to_bytes(4) + (8).to_bytes(4) + b"".join(v.to_bytes(2) for v in (2, 1, 2, 4)) + (4 * n).to_bytes(2) * 2
    c = M.parse(frame(three, vbri) + frame(three) * 8)
    assert (c["frames"], c["vbr"]["frames"], c["vbr"]["toc"], c["samples"]) == (8, 8, [4 * n, 4 * n], 8 * 1152)
    assert [o for _, o in c["offsets"]] == [n * i for i in range(1, 9)] and c["played_seconds"] == (8 * 1152 - 1105) / 44100
    xing = bytes(32) + b"Xing" + (1).to_bytes(4) + (3).to_bytes(4) + b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3)
    d = M.parse(frame(three, xing) + frame(three) * 3)
    assert d["frames"] == 3 and d["played_seconds"] == (3 * 1152 - 1576) / 44100 and d["seconds"] == 3 * 1152 / 44100
    rows = spark.createDataFrame([(1, frame(one) * 5), (2, None), (3, b"\xff" * 50)], "doc_id long, media binary")
    got = M.probe(rows).orderBy("doc_id").collect()
    assert [(r.frames, r.layer, len(r.offsets)) for r in got] == [(5, 1, 5), (0, 0, 0), (0, 0, 0)]


def test_mpeg_digest_row():
    for t in (None, "", "x" * 64, "é" * 5000):
        raw = (t or "").encode()
        n, size, sha, tail, media, media_sha, feature = mpeg_audio.digest_row(t)
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = json.loads(feature)
        assert (n, size, sha) == (len(raw), len(want), hashlib.sha256(want).hexdigest()) and x["bad_checks"] == x["skipped"] == 0
        assert x["frames"] == x["vbr_frames"] == x["seek_points"] == x["checks"] - 1 and x["samples"] == 1152 * x["frames"]


def test_quality_flat_and_scores(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(11)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, labels).collect())


def test_nearest(spark):
    x = np.random.default_rng(0).standard_normal((300, 16)).round(3)
    rows = [(i, x[i % 150].tolist()) for i in range(300)] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16)]
    got = collections.defaultdict(list)
    for r in sorted(vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    y = np.array([r[1] for r in rows[:300]])
    y = y / np.linalg.norm(y, axis=1)[:, None]
    for q in range(0, 300, 50):
        s = np.round(y @ y[q], 12)
        want = [i for i in sorted(range(300), key=lambda i: (-s[i], i)) if i != q][:5]
        assert got[q] == want
    assert set(got) == set(range(0, 300, 50))


def test_licenses(docs):
    assert [r.license for r in licenses.scan(docs).collect() if r.license] == ["CC-BY-NC-4.0"]


def test_empty(docs):
    none = docs.limit(0)
    for f in (licenses.scan, mixing.take, near_dup.near_duplicates, packing.pack, token_counts.token_counts, repeats.with_spans, mpeg_audio.encode_texts):
        assert f(none).count() == 0, f


def test_near_copies_of_one_template(spark):
    words = [f"term{i}" for i in range(150)]
    at = lambda i: (i * 7919) % 150
    rows = [(i, " ".join(words[: at(i)] + [f"own{i}"] + words[at(i) + 1 :])) for i in range(6000)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).select("component_id", "kept").collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_near_duplicates_from_80_percent(spark):
    # 96 shingles each; two changed words take 5 each: Jaccard 86 / 106
    base = [f"term{i}" for i in range(100)]
    other = [*base[:30], "x", *base[31:60], "y", *base[61:]]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id long, text string")
    assert near_dup.plan(85)[1:] == (16, 4, 39)
    assert [r.component_id for r in near_dup.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 1]
    assert [r.component_id for r in near_dup.near_duplicates(docs, 85).orderBy("doc_id").collect()] == [1, 2]


def test_wrapped_and_commented_licenses(spark):
    import textwrap

    s = licenses.SENTENCES
    wrap = lambda mark, *ids: "\n".join(mark + x for i in ids for x in [*textwrap.wrap(s[i], 72), ""])
    texts = [
        (wrap("", "mit-grant", "mit-notice", "mit-warranty"), "MIT"),
        (wrap(" * ", "gpl3-free", "gpl-warranty"), "GPL-3.0-or-later"),
        (wrap("# ", "bsd-redistribution") + "# 3. " + wrap("# ", "bsd-endorse")[2:], "BSD-3-Clause"),
        (wrap("// ", "isc-grant"), "ISC"),
        (wrap("/* ", "apache-header") + wrap("   ", "apache-disclaimer"), "Apache-2.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v.\n * 2.0. If", "MPL-2.0"),
        (" ".join(s[i] for i in ("mit-grant", "mit-notice", "mit-warranty")), "MIT"),
        (wrap("", "bsd-redistribution") + "1. " + wrap("", "bsd-source") + "2. " + wrap("", "bsd-binary") + wrap("", "bsd-warranty"), "BSD-2-Clause"),
        (wrap("# ", "lgpl21-free", "lgpl-warranty"), "LGPL-2.1-or-later"),
        (wrap("", "agpl3-free"), "AGPL-3.0-or-later"),
        ("x. Licensed under the MIT License, see LICENSE.", "MIT"),
        (wrap("", "apache-header", "apache-copy") + "    http://www.apache.org/licenses/LICENSE-2.0\n\n" + wrap("", "apache-disclaimer", "apache-limits"), "Apache-2.0"),
        ("A heading\nReleased under the MIT License.", "MIT"),
        ("It is not released under the MIT License.", None),
        ("Released under\n\nthe MIT License.", None),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    assert [r.license for r in licenses.scan(rows).orderBy("doc_id").collect()] == [want for _, want in texts]


def test_mixed_keeps_sources_apart(spark):
    rows = [(1, "a b c d", "en", s, 7) for s in ("p", "q", None)] + [(i, "w " * i, "en", "p", 2 * i) for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = collections.Counter()
    for r in mixing.take(docs).collect():
        want[r.source] += r.taken
    got = collections.Counter()
    for r in mixing.mixed(docs).collect():
        got[r.source] += len(r.text.split())
    assert +got == +want
