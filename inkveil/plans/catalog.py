"""Queries of the redaction engine by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkveil.functions import patterns as P, text as T
from inkveil.operators import detect as D, evaluate as E, grading as H, reading as O, redact as R
from inkveil.sources import docx as X, files as FI, generator as G, truth as S

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Checks in plain arithmetic, a second time and for both engines: the truth's side of the checksums.
_d = lambda c, i: f"cast(substr({c}, {i}, 1) as int)"
_ICO_SUM = "((" + " + ".join(f"{8 - i} * {_d('ico', i + 1)}" for i in range(7)) + ") % 11)"
_PLAIN = "replace(iban, ' ', '')"
CHECKS = {
    "rc": "cast(replace(rc, '/', '') as bigint) % 11 = 0",
    "ico": f"{_d('ico', 8)} = CASE {_ICO_SUM} WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 11 - {_ICO_SUM} END",
    "iban": f"((cast(substr({_PLAIN}, 5, 10) as bigint) % 97) * {pow(10, 16, 97)} + (cast(substr({_PLAIN}, 15, 10) as bigint) % 97) * {pow(10, 6, 97)} + cast('2820' || substr({_PLAIN}, 3, 2) as bigint)) % 97 = 1",
    "acc": "(" + " + ".join(f"{w} * {_d('acc', i + 1)}" for i, w in enumerate([10, 5, 8, 4, 2, 1])) + ") % 11 = 0 AND (" + " + ".join(f"{w} * {_d('acc', i + 8)}" for i, w in enumerate([6, 3, 7, 9, 10, 5, 8, 4, 2, 1])) + ") % 11 = 0",
}
_DUCK_NAME = "[" + ", ".join(f"'{n}'" for n in S.NAMES) + f"][cast(1 + k % {len(S.NAMES)} as int)]"
_EDGED = ", ".join(f"'{n}'" for n in S.EDGED)
_ENTITY = "CASE WHEN surface = 'Kováčovej' THEN 'entity:1' ELSE 'entity:0' END"
_CARRIER = f"c AS ({S.carrier_sql('orders', _DUCK_NAME)})"
_FOUND = _CARRIER + ", t AS (" + " UNION ALL ".join(f"SELECT doc_id, unit_seq, location, text, '{S.TYPES[f]}' AS type, {f} AS surface, strpos(text, {f}) - 1 AS start, {CHECKS.get(f, 'true')} AS auto, lower(regexp_replace({f}, '[\\s\u00a0]', '', 'g')) AS group_key FROM c" for f in S.FIELDS)
_FOUND += "".join(f" UNION ALL SELECT doc_id, unit_seq, location, text, 'MENO', surface, 12 + o, true, {_ENTITY} FROM (SELECT *, {s} AS surface, {o} AS o FROM c WHERE {w})" for s, o, w in (("'Ján'", 0, "name = 'Ján Novák'"), ("'Novák'", 4, "name = 'Ján Novák'"), ("'Novák'", 1, f"name in ({_EDGED})"), ("name", 0, "name in ('Nováka', 'Kováčovej', 'Novákovcov')"))) + ")"
_SPANS = _FOUND + ", f AS (SELECT doc_id, unit_seq, location, text, type, surface, cast(start as int) AS start, cast(start + length(surface) as int) AS \"end\", auto, group_key FROM t)"
_SNIP = "trim(regexp_replace(substr(text, greatest(start - 40, 0) + 1, \"end\" + 40 - greatest(start - 40, 0)), '[\\s\u00a0]+', ' ', 'g'))"


def _labels(where: str) -> str:
    return f", k AS (SELECT *, min(lpad(cast(unit_seq as varchar), 12, '0') || lpad(cast(start as varchar), 8, '0')) OVER (PARTITION BY doc_id, type, group_key) AS first FROM f WHERE {where}), l AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, type ORDER BY first, group_key) AS n FROM k), m AS (SELECT *, '[' || type || '_' || n || ']' AS label FROM l)"


_LABELLED = _SPANS + _labels("auto")


def _found(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    return R.spans(S.carrier(spark, sf_dir), "known", only=only or None)


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The carriers' ground truth, a unit a document: what the fields are, and a decoy."""
    entry = lambda t, surface, ok: F.struct(surface.alias("surface"), F.lit(t).alias("type"), F.coalesce(ok, F.lit(False)).alias("auto_redact"), F.coalesce(~ok, F.lit(False)).alias("should_flag"), F.lit("body").alias("part"))
    rows = [entry(t, F.col(f), F.expr(CHECKS.get(f, "true"))) for f, t in S.TYPES.items()]
    rows += [entry("ORDER_NO", F.lit("123/2024"), F.lit(None).cast("boolean"))]
    return S.carrier(spark, sf_dir).select(F.col("unit_seq").alias("doc_id"), F.array(*rows).alias("entries"))


def _surfaces(units: DataFrame) -> DataFrame:
    return units.select(F.col("unit_seq").alias("doc_id"), F.lit("document_xml").alias("part"), "text")


_LABEL = "[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\."
_EMAIL_RE2 = f"\\b[A-Za-z0-9._%+-]+@{_LABEL}[A-Za-z]{{2,}}\\b"
_URL_RE2 = f"\\b(?:https?://(?:www\\.)?|www\\.){_LABEL}[A-Za-z]{{2,}}\\b|\\b{_LABEL}(?:sk|cz|com|eu|org|net|info|biz|edu|gov|io|dev)\\b"


@query(f"SELECT lang, count(*) AS n, cast(sum(length(e)) as bigint) AS chars FROM (SELECT lang, unnest(regexp_extract_all(text, '{_EMAIL_RE2}')) AS e FROM documents) GROUP BY lang")
def email_by_lang(spark, sf_dir):
    d = D.candidates(_read(spark, sf_dir, "documents").select("lang", "text"), {"EMAIL": P.SECOND["EMAIL"]}, "text", "x")
    return d.select("lang", F.explode("x").alias("x")).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("x.surface")).alias("chars"))


@query(f"SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_URL_RE2}')) AS u FROM pages) GROUP BY page_id")
def url_pages(spark, sf_dir):
    d = D.candidates(_read(spark, sf_dir, "pages").select("page_id", "html"), {"URL": P.SECOND["URL"]}, "html", "x")
    return d.select("page_id", F.explode("x").alias("x")).groupBy("page_id").agg(F.count("*").alias("n"))


@query("SELECT page_id, d AS surface FROM (SELECT page_id, unnest(regexp_extract_all(html, '\\b\\d{10}\\b')) AS d FROM pages)")
def dic_pages(spark, sf_dir):
    d = D.candidates(_read(spark, sf_dir, "pages").select("page_id", "html"), {"DIC": P.FIRST["DIC"]}, "html", "x")
    return d.select("page_id", F.explode("x").alias("x")).select("page_id", "x.surface")


_PLACED = "SELECT doc_id, m[i] AS surface, cast(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as int) AS start FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{0}') AS m, string_split_regex(text, '{0}') AS p FROM documents))"


@query(_PLACED.replace("{0}", _EMAIL_RE2))
def email_spans(spark, sf_dir):
    d = D.candidates(_read(spark, sf_dir, "documents").select("doc_id", "text"), {"EMAIL": P.SECOND["EMAIL"]}, "text", "x")
    return d.select("doc_id", F.explode("x").alias("x")).select("doc_id", "x.surface", "x.start")


@query(f"SELECT cast(sum(len(regexp_extract_all(text, '{_URL_RE2}'))) as bigint) AS found, cast(sum(len(regexp_extract_all(regexp_replace(text, '{_EMAIL_RE2}', ' @ ', 'g'), '{_URL_RE2}'))) as bigint) AS kept FROM documents")
def url_in_email(spark, sf_dir):
    """Addresses found, and those that are no part of an e-mail."""
    docs = _read(spark, sf_dir, "documents").select("text")
    found = D.candidates(docs, {"URL": P.SECOND["URL"]}, "text", "x")
    return D.detect(found).agg(F.coalesce(F.sum(F.size("x")), F.lit(0)).alias("found"), F.coalesce(F.sum(F.size(F.filter("cands", lambda c: c.type == "URL"))), F.lit(0)).alias("kept"))


_NUMBERS = "len(regexp_extract_all({0}, '\\b\\d{10}\\b'))"


@query(f"WITH {_CARRIER} SELECT unit_seq, {_NUMBERS.replace('{0}', 'text')} AS found, {_NUMBERS.replace('{0}', 'regexp_replace(text, acc, chr(35))')} AS kept FROM c")
def resolve_contain(spark, sf_dir):
    """Tax numbers found, and those that lie in no account number."""
    found = D.candidates(S.carrier(spark, sf_dir).select("unit_seq", "text"), {"DIC": P.FIRST["DIC"]}, "text", "x")
    return D.detect(found).select("unit_seq", F.size("x").cast("long").alias("found"), F.size(F.filter("cands", lambda c: c.type == "DIC")).cast("long").alias("kept"))


@query(f"WITH {_SPANS} SELECT unit_seq, start, 2 AS claims, 'ICO' AS type, auto FROM f WHERE type = 'ICO'")
def resolve_precedence(spark, sf_dir):
    """Spans that a name and a company number claim, and who keeps them: the number, and what is doubtful stays so."""
    d = D.contested(S.carrier(spark, sf_dir).select("unit_seq", "text", "known"), "known", "cands")
    return d.select("unit_seq", F.explode("cands").alias("c")).select("unit_seq", "c.start", "c.claims", "c.type", "c.auto")


@query("SELECT doc_id % 50 AS doc_id, bool_or(trim(text) <> '') AS text_layer FROM documents GROUP BY doc_id % 50")
def text_layers(spark, sf_dir):
    return FI.text_layers(_read(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("doc_id"), "text"))


_ENDS = "CASE p_partkey % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.PDF' WHEN 2 THEN '.txt' ELSE '' END"


@query(f"SELECT min(p_partkey) AS seq, path, regexp_replace(path, '([.][a-zA-Z]+)$', '_anon\\1') AS out, regexp_replace(path, '[.][a-zA-Z]+$', '') || '_anon_report.txt' AS report FROM (SELECT p_partkey, 'in/f' || p_partkey % 500 || {_ENDS} AS path FROM part) WHERE p_partkey % 4 < 2 GROUP BY path")
def intake_and_export(spark, sf_dir):
    """Files taken in once each, and where their results go."""
    files = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.expr(f"'in/f' || p_partkey % 500 || {_ENDS}").alias("path"))
    taken = FI.intake(files)
    return taken.join(FI.exported(taken.withColumn("status", F.lit("written"))), "path")


for _f, _t in S.TYPES.items():
    def _one(spark, sf_dir, t=_t):
        """Resolved spans of one type on the carriers."""
        return _found(spark, sf_dir, t).select("unit_seq", "surface", "start", "end", "auto")

    QUERIES[f"detect_{_t.lower()}"] = _one
    ORACLES[f"detect_{_t.lower()}"] = f"WITH {_SPANS} SELECT unit_seq, surface, start, \"end\", auto FROM f WHERE type = '{_t}'"


@query(f"WITH {_SPANS} SELECT unit_seq, surface, start, group_key FROM f WHERE type = 'MENO'")
def known_entities(spark, sf_dir):
    return _found(spark, sf_dir, "MENO").select("unit_seq", "surface", "start", "group_key")


@query(f"WITH {_SPANS} SELECT type, auto, count(*) AS n, cast(sum(start) as bigint) AS starts FROM f GROUP BY type, auto")
def resolved_counts(spark, sf_dir):
    return D.counted(S.carrier(spark, sf_dir), "known")


_STEM = "regexp_replace(translate(lower(w), 'áéíóúýĺŕ', 'aeiouylr'), '^(.{3,}?)(?:" + "|".join(T.ENDINGS) + ")$', '\\1')"


@query(f"SELECT w, {_STEM} AS s, count(*) AS n FROM (SELECT unnest(string_split({_DUCK_NAME}, ' ')) AS w FROM (SELECT o_orderkey AS k FROM orders)) GROUP BY w")
def stems(spark, sf_dir):
    d = S.carrier(spark, sf_dir).select(F.explode(F.split("name", " ")).alias("w"))
    return d.groupBy("w").agg(F.count("*").alias("n")).withColumn("s", T.stem(F.col("w")))


@query(f"WITH {_LABELLED} SELECT doc_id, unit_seq, start, label FROM m")
def labels(spark, sf_dir):
    return O.labels(S.carrier(spark, sf_dir), ["unit_seq", "start", "label"], "known")


def _redacted_sql() -> str:
    pick = lambda t: f"max(CASE WHEN type = '{t}' THEN label END)"
    picks = ", ".join(f"{pick(t)} AS l_{f}" for f, t in S.TYPES.items())
    cols = ", ".join(f"coalesce(l_{f}, {f}) AS {f}" for f in S.FIELDS)
    name = f"CASE WHEN name = 'Ján Novák' THEN l_name || ' ' || l_name WHEN name IN ({_EDGED}) THEN replace(name, 'Novák', l_name) WHEN l_name IS NOT NULL THEN l_name ELSE name END AS name"
    return f"WITH {_LABELLED}, p AS (SELECT unit_seq, {pick('MENO')} AS l_name, {picks} FROM m GROUP BY unit_seq), r AS (SELECT c.doc_id, c.unit_seq, {name}, {cols} FROM c LEFT JOIN p USING (unit_seq)) SELECT doc_id, unit_seq, {S.TEXT} AS text FROM r"


@query(_redacted_sql())
def redacted_text(spark, sf_dir):
    return O.redacted(S.carrier(spark, sf_dir), "known").select("doc_id", "unit_seq", "text")


@query(f"WITH {_LABELLED} SELECT doc_id, label, type, n AS n, count(*) AS occurrences, string_agg(DISTINCT location, ', ' ORDER BY location) AS locations FROM m GROUP BY doc_id, label, type, n")
def report_rows(spark, sf_dir):
    return O.report_rows(S.carrier(spark, sf_dir), "known")


@query(f"WITH {_SPANS} SELECT doc_id, unit_seq, location, type, surface, start, {_SNIP} AS snippet FROM f WHERE NOT auto")
def low_confidence(spark, sf_dir):
    return R.low_confidence(R.decide(_found(spark, sf_dir)))


@query(f"WITH {_SPANS} SELECT doc_id, type, group_key, CASE WHEN auto THEN 'auto' ELSE 'review' END AS bucket, first(surface ORDER BY unit_seq, start) AS text, first({_SNIP} ORDER BY unit_seq, start) AS snippet, string_agg(DISTINCT location, ',' ORDER BY location) AS locations, count(*) AS count FROM f GROUP BY doc_id, type, group_key, auto")
def review_rows(spark, sf_dir):
    return O.review(S.carrier(spark, sf_dir), "known").drop("place")


_ACTIONS = "doc_id % 2 = 0 AND type = 'MENO'"


@query(f"WITH {_SPANS}{_labels(f'(auto AND NOT ({_ACTIONS})) OR (NOT auto AND type = {chr(39)}ICO{chr(39)})')} SELECT doc_id, unit_seq, start, label FROM m")
def decisions(spark, sf_dir):
    found = _found(spark, sf_dir, "MENO", "ICO")
    d = found.filter(f"({_ACTIONS}) or type = 'ICO'").select("doc_id", "type", "group_key", F.when(F.col("type") == "ICO", "force").otherwise("suppress").alias("action"))
    return O.labels(S.carrier(spark, sf_dir), ["unit_seq", "start", "label"], "known", decisions=d)


_NOTE = R.NOTICE.replace("'", "''")
_HEAD = f"'{R.TITLE}' || chr(10) || chr(10) || '" + _NOTE.replace("\n", "' || chr(10) || '") + f"' || chr(10) || '" + R.REDACTED.replace("\n", "' || chr(10) || '") + "'"
_LOW = "'" + R.LOW_CONFIDENCE.replace("\n", "' || chr(10) || '") + "'"


@query(f"WITH {_LABELLED}, r AS (SELECT doc_id, label, type, n, type || ' | ' || label || ' | ' || count(*) || ' | ' || string_agg(DISTINCT location, ', ' ORDER BY location) AS row FROM m GROUP BY doc_id, label, type, n), a AS (SELECT doc_id, string_agg(chr(10) || row, '' ORDER BY type, n) AS rows FROM r GROUP BY doc_id), b AS (SELECT doc_id, string_agg(chr(10) || type || ' | ' || surface || ' | ' || location, '' ORDER BY unit_seq, start) AS rows FROM f WHERE NOT auto GROUP BY doc_id) SELECT doc_id, {_HEAD} || coalesce(a.rows, '') || chr(10) || chr(10) || {_LOW} || coalesce(b.rows, chr(10) || '(none)') || chr(10) AS report FROM a FULL JOIN b USING (doc_id)")
def report_texts(spark, sf_dir):
    return O.report_text(S.carrier(spark, sf_dir), "known")


@query(f"WITH {_LABELLED} SELECT doc_id, label, count(*) AS n, string_agg(unit_seq || ':' || start || ':' || location || ':' || surface, ',' ORDER BY unit_seq, start) AS places, first({_SNIP} ORDER BY unit_seq, start) AS context, first(group_key ORDER BY unit_seq, start) AS group_key FROM m GROUP BY doc_id, label")
def occurrences(spark, sf_dir):
    """Every place of each label, its first context, and the group it stands for."""
    places = F.array_join(F.transform("places", lambda x: F.concat_ws(":", x.unit_seq.cast("string"), x.start.cast("string"), x.location, x.surface)), ",")
    return O.occurrences(S.carrier(spark, sf_dir), "known").select("doc_id", "label", F.size("places").cast("long").alias("n"), places.alias("places"), "context", "group_key")


_REVIEW = "v AS (SELECT doc_id, type, group_key, CASE WHEN auto THEN 'auto' ELSE 'review' END AS bucket, first(surface ORDER BY unit_seq, start) AS text FROM f GROUP BY doc_id, type, group_key, auto)"


@query(f"WITH {_SPANS}, {_REVIEW} SELECT doc_id, bucket, type, text, row_number() OVER (PARTITION BY doc_id ORDER BY bucket, type, text, group_key) AS place FROM v")
def review_order(spark, sf_dir):
    return O.review(S.carrier(spark, sf_dir), "known").select("doc_id", "bucket", "type", "text", "place")


@query(f"WITH {_SPANS}, {_REVIEW} SELECT doc_id, type, group_key, CASE WHEN bucket = 'auto' THEN 'suppress' ELSE 'force' END AS action FROM v WHERE (bucket = 'auto' AND type = 'EMAIL') OR (bucket = 'review' AND type = 'IBAN')")
def build_decisions(spark, sf_dir):
    """A reviewer unticks every e-mail and ticks every doubtful account; other groups keep what they had."""
    units = S.carrier(spark, sf_dir)
    before = O.review(units, "known", only=["EMAIL", "IBAN"]).withColumn("ticked", F.col("type") == "IBAN")
    return R.build_decisions(O.carried(units, before, "known"))


@query(f"WITH {_CARRIER} SELECT unit_seq, 'Predávajúci' AS surface, cast(0 as int) AS start, 'entity:5' AS group_key FROM c")
def extra_terms(spark, sf_dir):
    """A reviewer's own term joins the known entities, as the last of them."""
    s = R.spans(S.carrier(spark, sf_dir), "known", [" Predávajúceho ", " ", "Predávajúci"], only=["MENO"])
    return s.filter("start = 0").select("unit_seq", "surface", "start", "group_key")


@query(f"WITH {_SPANS} SELECT unit_seq AS doc_id, surface, type, 'document_xml' AS found_in, 'body' AS gt_parts, 'other' AS kind FROM f WHERE auto AND type <> 'MENO'")
def leaks_of_null(spark, sf_dir):
    return H.leaks(_truth(spark, sf_dir), _surfaces(S.carrier(spark, sf_dir)))


def _redacted(spark, sf_dir):
    return _surfaces(O.redacted(S.carrier(spark, sf_dir), "known"))


@query("SELECT cast(0 as bigint) AS n")
def leaks_of_engine(spark, sf_dir):
    return H.leaks(_truth(spark, sf_dir), _redacted(spark, sf_dir)).agg(F.count("*").alias("n"))


@query(f"WITH {_SPANS}, x AS (SELECT type, auto FROM f WHERE type <> 'MENO' UNION ALL SELECT 'ORDER_NO', NULL FROM c), g AS (SELECT type, count(*) FILTER (auto) AS a, count(*) FILTER (NOT auto) AS b, count(*) FILTER (auto IS NULL) AS d FROM x GROUP BY type) SELECT type, a AS auto_total, a AS auto_removed, d AS decoy_total, d AS decoy_kept, b AS flag_total, b AS flag_kept, b AS flag_in_review, CASE WHEN a > 0 THEN 1.0::DOUBLE END AS recall, CASE WHEN d > 0 THEN 1.0::DOUBLE END AS decoy_survival, CASE WHEN b > 0 THEN 1.0::DOUBLE END AS flag_survival FROM g")
def rates_by_type(spark, sf_dir):
    low = R.low_confidence(R.decide(_found(spark, sf_dir, *D.DOUBTFUL))).select(F.col("unit_seq").alias("doc_id"), "surface")
    return H.rates(_truth(spark, sf_dir), _redacted(spark, sf_dir), low)


#: What each known-bad redactor must fail.
EXPECTED = {"null": {"leak_ok"}, "scorch": {"retention_ok", "decoy_ok", "flag_ok"}, "empty_output": {"retention_ok", "decoy_ok", "flag_ok"}, "refuse_all": {"coverage_ok"}, "greedy": {"flag_ok"}, "corrupt_output": {"integrity_ok"}, "overeager_refusal": {"unexpected_ok", "flag_ok"}}


def _files(spark, sf_dir):
    """The carriers' files, a unit each, and files without text that must be refused."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.lit(False).alias("must_refuse")).unionByName(o.filter("o_orderkey % 100 = 0").select((-1 - F.col("o_orderkey")).alias("doc_id"), F.lit(True).alias("must_refuse")))


@query(" UNION ALL ".join(f"SELECT '{b}' AS baseline, " + ", ".join(f"{str(g not in bad).lower()} AS {g}" for g in E.GATES) + ", false AS passed" for b, bad in EXPECTED.items()))
def baseline_matrix(spark, sf_dir):
    t, o, files = _truth(spark, sf_dir), _surfaces(S.carrier(spark, sf_dir)), _files(spark, sf_dir)
    out = None
    for b in E.BASELINES:
        texts, outputs = E.baseline(b, o, t, files, H.greedy)
        row = H.run_eval(t, files, o, texts, outputs).withColumn("baseline", F.lit(b))
        out = row if out is None else out.unionByName(row)
    return out


_STATUS = "SELECT k AS doc_id, CASE WHEN k % 100 = 0 THEN CASE WHEN k % 3 = 0 THEN 'unexpected' ELSE 'refused' END WHEN k % 7 = 0 THEN 'missing' WHEN k % 11 = 0 THEN 'broken' ELSE 'graded' END AS status FROM (SELECT o_orderkey AS k FROM orders)"


def _statuses(spark, sf_dir):
    """Files named by order; some have no output, some one named _anon, some one that doesn't open."""
    k = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    files = k.select(F.concat("k", F.lit(".docx")).alias("doc_id"), (F.col("k") % 100 == 0).alias("must_refuse"))
    made = k.filter("(k % 100 = 0 and k % 3 = 0) or (k % 100 <> 0 and k % 7 <> 0)")
    name = F.concat("k", F.when(F.col("k") % 2 == 0, "_anon.docx").otherwise(".docx"))
    outputs = made.select(name.alias("path"), F.when((F.col("k") % 11 == 0) & (F.col("k") % 100 != 0), "bad").alias("error"))
    return E.classified(files, outputs).withColumn("doc_id", F.split_part("doc_id", F.lit("."), F.lit(1)).cast("long"))


@query(_STATUS)
def run_status(spark, sf_dir):
    return _statuses(spark, sf_dir).select("doc_id", "status")


@query(f"SELECT doc_id FROM ({_STATUS}) WHERE status = 'refused'")
def refused_docs(spark, sf_dir):
    return _statuses(spark, sf_dir).filter("status = 'refused'").select("doc_id")


@query(f"SELECT count(*) FILTER (status IN ('missing', 'broken', 'graded')) AS due, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'missing') = 0 AS coverage_ok FROM ({_STATUS})")
def coverage(spark, sf_dir):
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return _statuses(spark, sf_dir).agg(n("missing", "broken", "graded").alias("due"), n("missing").alias("missing"), (n("missing") == 0).alias("coverage_ok"))


@query(f"WITH {_SPANS} SELECT (SELECT count(*) FROM orders) AS files, cast(0 as bigint) AS text_layer, cast(0 as bigint) AS scrub, (SELECT count(*) FROM f WHERE auto AND type <> 'MENO') AS other, 'FAIL' AS verdict, cast(1 as int) AS exit_code")
def leak_verdict(spark, sf_dir):
    """The leak verdict on files that nothing was taken from."""
    return E.leak_verdict(H.leaks(_truth(spark, sf_dir), _surfaces(S.carrier(spark, sf_dir))), _read(spark, sf_dir, "orders"))


@query(f"WITH {_CARRIER} SELECT cast(count(*) as bigint) AS docs, true AS all_kept FROM c")
def retention_of_null(spark, sf_dir):
    """Nothing taken: each document keeps each of its other words."""
    o = _surfaces(S.carrier(spark, sf_dir))
    return H.retention(_truth(spark, sf_dir), o, o).agg(F.count("*").alias("docs"), F.bool_and(F.col("kept") == F.col("total")).alias("all_kept"))


_MADE = 240


def made(spark, n: int = _MADE):
    """Generated documents, through the engine: truth (without places and firms, which it leaves), files, originals, redacted parts, outputs."""
    docs = G.generate(spark, n)
    units = G.units_of(docs)
    labelled = R.label(R.decide(R.spans(units, "known")))
    written = X.write_docx(docs.filter("format = 'docx'").select(F.col("source_file").alias("path"), "content"), labelled)
    parts = X.parsed(written).select(F.col("path").alias("doc_id"), F.explode("parts").alias("part", "text"))
    pages = R.redact(units.filter("location = 'page'"), labelled).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit_seq", "text"))).alias("t"))
    pages = pages.select("doc_id", F.lit("text_layer").alias("part"), F.array_join(F.transform("t", lambda x: x.text), "\n").alias("text"))
    outputs = docs.filter("not must_be_refused").select(F.col("source_file").alias("path"), F.lit(None).cast("string").alias("error"))
    return E.checked(G.truth_of(docs).filter(~F.col("type").isin(*E.CLASS_A))), G.files_of(docs), G.originals_of(docs), parts.unionByName(pages), outputs


@query(f"SELECT cast({_MADE + 1} as bigint) AS files, cast(0 as bigint) AS text_layer, cast(0 as bigint) AS scrub, cast(0 as bigint) AS other, 'PASS' AS verdict, cast(0 as int) AS exit_code")
def generated_leaks(spark, sf_dir):
    """The leak verdict on generated documents, DOCX read, rewritten and read again."""
    truth, files, _, redacted, _ = made(spark)
    return E.leak_verdict(E.leaks(truth, redacted), files)


@query("SELECT " + ", ".join(f"true AS {g}" for g in (*E.GATES, "passed")))
def generated_gates(spark, sf_dir):
    """All verdicts on generated documents."""
    truth, files, originals, redacted, outputs = made(spark)
    return E.run_eval(truth, files, originals, redacted, outputs)


@query("WITH s AS (SELECT o_custkey AS doc_id, cast(o_orderkey % 400 as int) AS start, cast(o_orderkey % 400 + 1 + o_orderkey % 23 as int) AS e FROM orders), g AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s), h AS (SELECT *, sum(CASE WHEN start <= r THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT doc_id, min(start) AS start, max(e) AS \"end\" FROM h GROUP BY doc_id, k")
def merge_islands(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    return E.merged(o.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 400).cast("int").alias("start"), (F.col("o_orderkey") % 400 + 1 + F.col("o_orderkey") % 23).cast("int").alias("end")))




@query("WITH e AS (SELECT 'f' || p_partkey AS path, sha256(p_name) AS h FROM part WHERE p_partkey % 10 <> 1), a AS (SELECT 'f' || p_partkey AS path, sha256(CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE p_name END) AS h FROM part WHERE p_partkey % 10 <> 2) SELECT coalesce(e.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'MISSING' WHEN e.path IS NULL THEN 'UNEXPECTED' ELSE 'CHANGED' END AS status FROM e FULL JOIN a ON e.path = a.path WHERE e.path IS NULL OR a.path IS NULL OR e.h <> a.h")
def manifest_verify(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    path = F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path")
    e = p.filter("p_partkey % 10 <> 1").select(path, F.sha2("p_name", 256).alias("sha256"))
    a = p.filter("p_partkey % 10 <> 2").select(path, F.sha2(F.when(F.col("p_partkey") % 7 == 0, "x").otherwise(F.col("p_name")), 256).alias("sha256"))
    return E.manifest_diff(e, a)


@query("SELECT cast(0 as bigint) AS n")
def gt_collisions(spark, sf_dir):
    return H.collisions(_truth(spark, sf_dir)).agg(F.count("*").alias("n"))
