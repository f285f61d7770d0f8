"""Faster ways and passes in reading order against the plain ones."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from inkveil.functions.patterns import KINDS
from inkveil.operators import bulk as B, detect as D, evaluate as E, grading as H, reading as O, redact as R
from inkveil.plans import catalog
from inkveil.sources import truth as S

PIECES = "1|12|123|1234|12345678|12345679|1234567890|٣|/|-| | |.|,|€|EUR|Sk|SK|@|a|x_|á|www.|http://|sk|info|+421|0|02/|905| mája |2020-01-02|1.1.2020|LV č. |parc. č. |Oddiel: Sro, Vložka č. |V-|Cb/|T/|%|\n|a@b.sk|x.eu|850315/0018|SK24 1100 0000 0026 1234 5678|000123-1234567899/1100|Ján|5,- €".split("|")
KNOWN = ("Ján", "12345679", "2020-01-02", "a@b.sk", None)


def texts(n):
    pick = random.Random(7)
    return ["".join(pick.choice(PIECES) for _ in range(pick.randint(1, 14))) for _ in range(n)]


def test_faster_places_and_single_types():
    names = D.Names()
    for x in texts(3000):
        every = D.spans_of(x, KNOWN, names)
        for t, k in KINDS.items():
            assert k.spans(x) == [m.span() for m in k.pattern.finditer(x)], (t, x)
        for t in (*KINDS, "MENO"):
            assert D.spans_of_types(x, KNOWN, names, frozenset([t])) == [s for s in every if s[2] == t], (t, x)


def test_other_types_are_not_looked_for(monkeypatch):
    asked = []
    scan = D.scan
    monkeypatch.setattr(D, "scan", lambda text, kinds: asked.extend(kinds) or scan(text, kinds))
    D.spans_of_types("Dňa 1.1.2020 Ján, a@b.sk, 12345679", KNOWN, D.Names(), frozenset(["DATUM"]))
    assert set(asked) == {"DATUM"}


def test_many_texts_at_once_are_found_as_one_by_one(monkeypatch):
    monkeypatch.setattr(B, "MOST_CHARS", 500)
    pick = random.Random(11)
    pieces = [*PIECES, "ß", "ŉ", "İ", "😀", "Kováčovej", "Mária", "\u2028", "\x1f", "123", "/1234", "22-3333333/1234-44/5555", "1 000,00 €", "12-345/"]
    some = ["".join(pick.choice(pieces) for _ in range(pick.randint(0, 25))) for _ in range(4000)] + [None, "", "a" * 2000, None]
    known = [pick.choice([list(KNOWN), ["Ján", "Mária Kováčová", "ß"], [f"x{i}" for i in range(40)] + ["Ján"], [], None]) for _ in some]
    names = D.Names()
    one_by_one = [None if t is None else D.spans_of(t, tuple(k or ()), names) for t, k in zip(some, known)]
    got = B.arrays(some, known, D.Names())
    got.validate(full=True)
    assert got.equals(D.as_array(some, one_by_one)) and len(got.values) > 1000
    for t in (*KINDS, "MENO"):
        only = [r and [s for s in r if s[2] == t] for r in one_by_one]
        assert B.arrays(some, known, D.Names(), frozenset([t])).equals(D.as_array(some, only)), t
    assert B.arrays([], [], D.Names()).to_pylist() == [] and B.arrays([None, ""], [None, None], D.Names()).to_pylist() == [None, []]


def test_detection_takes_texts_together(monkeypatch):
    monkeypatch.setattr(D, "scan", None)  # the way text by text
    found = D.found(pa.array(["Ján 12345679", None]), pa.array([["Ján"], None], pa.list_(pa.string()))).to_pylist()
    assert [(c["type"], c["group_key"]) for c in found[0]] == [("MENO", "entity:0"), ("ICO", "12345679")] and found[1] is None


def test_terms_alone_are_found_without_addresses(monkeypatch):
    asked = []
    others = B.Chunk._others
    monkeypatch.setattr(B.Chunk, "_others", lambda self, t: asked.append(t) or others(self, t))
    texts = ["Predávajúci Ján, www.x.sk, a@b.sk", "x.eu Ján"]
    assert [len(x) for x in B.arrays(texts, [["Ján"]] * 2, D.Names(), frozenset(["MENO"])).to_pylist()] == [1, 1] and not asked
    assert B.arrays(texts, [["x.eu"]] * 2, D.Names(), frozenset(["MENO"])).to_pylist() == [[], []] and "URL" in asked


def test_texts_are_made_by_methods_the_jvm_compiles(spark):
    S.carrier(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_counts_are_those_of_the_spans(spark):
    u = units(spark)
    same(D.counted(u, "known", ["www.x.sk"]), R.spans(u, "known", ["www.x.sk"]).groupBy("type", "auto").agg(F.count("*").alias("n"), F.sum("start").alias("starts")))
    assert D.counted(u.limit(0), "known").count() == 0


def test_keys_are_dealt_by_their_size(spark, tmp_path):
    spark.range(200_000).selectExpr("id as o_custkey", "id as o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    keys = spark.read.parquet(f"{tmp_path}/orders.parquet")
    assert S.spread(keys).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism


def test_counts_and_terms_carry_no_more_than_they_need(spark):
    plan = plan_of(catalog.QUERIES["resolved_counts"](spark, "/root/testdata/sf0.001"))
    assert "Generate" not in plan and "MapInArrow" in plan


UNITS = "doc_id int, unit_seq int, location string, text string, known array<string>"


def units(spark, parts=3):
    words = ["Ján Novák", "a@b.sk", "12345679", "12345670", "Nováka", "850315/0019", "1.1.2020", "12345679-1543039117/1100", "", "  a \t", "www.x.sk"]
    pick = random.Random(3)
    rows = [(i % 7 if i % 9 else None, i // 7, pick.choice(["body", "header", None]), None if i % 13 == 0 else " ".join(pick.choice(words) for _ in range(5)), ["Ján Novák", "12345679"]) for i in range(140)]
    return spark.createDataFrame(rows, UNITS).repartition(parts)


def same(a, b):
    assert sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect())) and b.count() > 0


def test_reading_order_is_the_plain_way(spark):
    u = units(spark)
    found = R.spans(u, "known")
    told = found.filter("type in ('MENO', 'ICO') and doc_id > 1").select("doc_id", "type", "group_key", F.when(F.col("auto"), "suppress").otherwise("force").alias("action"))
    columns = ["unit_seq", "location", "type", "surface", "start", "end", "auto", "group_key", "snippet", "label"]
    plain = found.dropna(subset=["doc_id"])  # decisions on no document don't join
    read = u.dropna(subset=["doc_id"])
    same(O.labels(read, columns, "known", decisions=told), R.label(R.decide(plain, told)).select("doc_id", *columns))
    d = R.decide(found)
    k = R.label(d)
    same(O.redacted(u, "known"), R.redacted(u, "known"))
    same(O.report_rows(u, "known"), R.report_rows(k))
    review = R.review_rows(d)
    same(O.review(u, "known"), R.review_order(review))
    same(O.occurrences(read, "known"), R.occurrence_lists(R.label(R.decide(plain))).join(R.groups(R.label(R.decide(plain))), ["doc_id", "label"]))
    same(O.report_text(read, "known"), R.report_text(R.label(R.decide(plain)), R.decide(plain)))
    before = review.filter("doc_id > 2").withColumn("ticked", F.col("count") > 1).dropDuplicates(["doc_id", "type", "group_key"])
    same(O.carried(read, before, "known").drop("place"), R.carried(R.review_rows(R.decide(plain)), before))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_queries_of_labels_deal_units_once_and_broadcast_nothing(spark):
    for name in ("labels", "redacted_text", "report_rows", "review_rows", "review_order", "report_texts", "occurrences", "decisions", "build_decisions"):
        plan = plan_of(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "Window" not in plan and "Join" not in plan and "BroadcastExchange" not in plan, name


def test_spans_without_places_stay_apart(spark):
    d = spark.createDataFrame([(1, None, None), (1, None, None), (1, 3, 5), (1, 4, 9), (2, -5, -9), (2, -5, -9)], "doc_id long, start int, end int")
    assert sorted(map(repr, (tuple(r) for r in E.merged(d).select("doc_id", "start", "end").collect()))) == sorted(map(repr, [(1, None, None), (1, None, None), (1, 3, 9), (2, -5, -9), (2, -5, -9)]))


def test_grading_in_one_pass_is_the_plain_way(spark):
    pick = random.Random(5)
    surfaces = ["Novák", "Novákov dom", "12345670", "a@b.sk", "dom", "", None]
    truth = [(i % 6, pick.choice(surfaces), pick.choice(["MENO", "ICO", "DECOY", None]), *pick.choice([(True, False), (False, True), (False, False), (True, True)]), pick.choice(["body", "header"])) for i in range(60)]
    t = spark.createDataFrame(truth, "doc_id int, surface string, type string, auto_redact boolean, should_flag boolean, part string")
    docs = lambda n: spark.createDataFrame([(i % n, pick.choice(["document_xml", "text_layer", "xmp", "annotations", None]), pick.choice(["Novákov dom 12345670 Novákovi patrí dom", "Novák a@b.sk dom dom", "", None])) for i in range(20)], "doc_id int, part string, text string")
    o, r = docs(7), docs(5)
    review = t.filter("should_flag").select("doc_id", "surface").limit(9).localCheckpoint()
    g = H.entries(t)
    same(H.leaks(g, r), E.leaks(t, r))
    same(H.rates(g, r, review), E.rates(t, r, review))
    same(H.retention(g, o, r), E.retention(t, o, r))
    same(H.collisions(g), E.collisions(t))
    files = spark.createDataFrame([(i, i == 3) for i in range(7)], "doc_id int, must_refuse boolean")
    outs = spark.createDataFrame([(i, None if i != 2 else "bad") for i in (0, 1, 2, 4)], "path int, error string")
    same(H.run_eval(g, files, o, r, outs), E.run_eval(t, files, o, r, outs))
    gathered = g.groupBy("doc_id").agg(F.flatten(F.collect_list("entries")).alias("entries"))
    same(H.greedy(o, gathered), E.greedy(o, t))


def test_grading_sends_no_table_to_every_task(spark):
    for name in ("rates_by_type", "baseline_matrix", "leaks_of_null", "leaks_of_engine", "retention_of_null", "gt_collisions"):
        assert "BroadcastHashJoin" not in plan_of(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")), name
