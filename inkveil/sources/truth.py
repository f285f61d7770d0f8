"""Ground-truth files and carriers: text made of key columns, by SQL that other engines read, too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TRUTH = "source_file string, doc_type string, seed long, text_layer boolean, must_be_refused boolean, entities array<struct<entity_id:string,canonical:string,category:string,variants:array<string>>>, pii array<struct<id:string,surface:string,type:string,auto_redact:boolean,should_flag:boolean,location:struct<surface_part:string,detail:map<string,string>>,entity_id:string,grammatical_case:string,valid_checksum:boolean>>"

def _turns(*options: str) -> str:
    """One of the options after another, by k."""
    return "CASE " + " ".join(f"WHEN k % {len(options)} = {i} THEN {o}" for i, o in enumerate(options)) + " END"


def _pad(n: str, width: int) -> str:
    return f"lpad(cast({n} as string), {width}, '0')"


_GAP = _turns("' '", "chr(160)", "' '")
EDGED = ["*Novák*", "‹Novák›", "§Novák…", "|Novák_", "·Novák−"]
NAMES = ["Ján Novák", "Nováka", "Kováčovej", "Novákovcov", "Kováčska", *EDGED]
#: Of orders: doc_id, unit_seq, location, text; the same text in Spark and DuckDB, with every shape of every type in turn. o_orderkey is k.
FIELDS = {
    "rc": f"{_pad('50 + k % 50', 2)} || {_pad('1 + k % 12 + ' + _turns('0', '50', '20', '70'), 2)} || {_pad('1 + k % 28', 2)} || '/' || {_pad('k * 7919 % 10000', 4)}",
    "ico": _pad("(k * 7919 + 12345678) % 100000000", 8),
    "dic": "cast(2020000000 + k * 31 % 9999999 as string)",
    "icdph": "'SK' || cast(2120000000 + k * 37 % 9999999 as string)",
    "iban": _turns(f"'SK' || {_pad('k % 97', 2)} || ' 1100 0000 0026 1234 ' || {_pad('k % 10000', 4)}", f"'SK' || {_pad('k % 97', 2)} || '1100000000261234' || {_pad('k % 10000', 4)}"),
    "acc": f"{_pad('k * 13 % 1000000', 6)} || '-' || cast(1543039117 + k as string) || '/1100'",
    "email": _turns("'user' || cast(k as string) || '@example.sk'", "'j.n+' || cast(k as string) || '@mail-1.example.com'", "'a_b' || cast(k as string) || '@x-.eu'"),
    "tel": _turns(f"'+421' || {_GAP} || '9' || {_pad('k % 100', 2)} || {_GAP} || {_pad('k * 7 % 1000', 3)} || ' ' || {_pad('k * 11 % 1000', 3)}", f"'09' || {_pad('k % 100', 2)} || ' ' || {_pad('k * 7 % 1000', 3)} || {_GAP} || {_pad('k * 11 % 1000', 3)}", f"'02/' || {_pad('k % 1000', 3)} || {_GAP} || {_pad('k * 7 % 1000', 3)} || ' ' || {_pad('k * 11 % 1000', 3)}"),
    "url": _turns("'www.firma' || cast(k % 1000 as string) || '.sk'", "'https://firma' || cast(k % 1000 as string) || '.example.com'", "'http://www.firma' || cast(k % 1000 as string) || '.museum'", "'firma' || cast(k % 1000 as string) || '.eu'"),
    "datum": _turns("cast(1 + k % 28 as string) || '. mája ' || cast(1990 + k % 30 as string)", "cast(1 + k % 28 as string) || '.' || cast(1 + k % 12 as string) || '.' || cast(1990 + k % 30 as string)", f"{_pad('1 + k % 28', 2)} || '.' || {_GAP} || {_pad('1 + k % 12', 2)} || '. ' || cast(1990 + k % 30 as string)", f"cast(1990 + k % 30 as string) || '-' || {_pad('1 + k % 12', 2)} || '-' || {_pad('1 + k % 28', 2)}", f"cast(1 + k % 28 as string) || '.' || {_GAP} || 'decembra' || {_GAP} || cast(1990 + k % 30 as string)"),
    "suma": f"cast(1 + k % 999 as string) || {_GAP} || {_pad('k * 3 % 1000', 3)} || " + _turns("',00 €'", "',50' || chr(160) || 'EUR'", "',- €'", "' Sk'"),
    "lv": f"'LV č.' || {_GAP} || cast(1 + k % 9999 as string)",
    "parc": _turns("'parc. č. ' || cast(1 + k % 9999 as string) || '/' || cast(1 + k % 99 as string)", f"'parc. č.' || {_GAP} || cast(1 + k % 9999 as string)", "'parcela registra „C“ KN č. ' || cast(1 + k % 9999 as string) || '/' || cast(1 + k % 99 as string)", "'parcela registra „E“ KN č. ' || cast(1 + k % 9999 as string) || '/' || cast(1 + k % 99 as string)"),
    "orsr": f"'Oddiel: ' || {_turns(*[repr(x) for x in ('Sro', 'Sa', 'Pš', 'Dr')])} || ', Vložka č.' || {_GAP} || cast(100 + k % 90000 as string) || '/' || {_turns(*[repr(x) for x in 'VBTNZ'])}",
    "spis": _turns(*[f"'{x}-' || cast(1 + k % 9999 as string) || '/2024'" for x in "VZPXR"], *[f"cast(1 + k % 99 as string) || '{x}/' || cast(1 + k % 999 as string) || '/2025'" for x in ("Cb", "Ro", "Er", "C", "T", "D")]),
}
TYPES = {"rc": "RODNE_CISLO", "ico": "ICO", "dic": "DIC", "icdph": "IC_DPH", "iban": "IBAN", "acc": "BANKOVY_UCET", "email": "EMAIL", "tel": "TELEFON", "url": "URL", "datum": "DATUM", "suma": "SUMA", "lv": "LV", "parc": "PARCELA", "orsr": "ORSR_VLOZKA", "spis": "SPISOVA_ZNACKA"}
TEXT = "'Predávajúci ' || name || ', nar. č. ' || rc || '; IČO: ' || ico || ', DIČ: ' || dic || ', IČ DPH: ' || icdph || '. Účet ' || iban || ' alebo ' || acc || '; píšte na ' || email || ', volajte ' || tel || ', web ' || url || '. Dňa ' || datum || ' cena ' || suma || '; ' || lv || ', ' || parc || ', ' || orsr || ', sp. zn. ' || spis || '; bod 4.2 Obj. č. 123/2024.'"
NAME = "element_at(array(" + ", ".join(f"'{n}'" for n in NAMES) + f"), cast(1 + k % {len(NAMES)} as int))"


def carrier_sql(orders: str, name: str) -> str:
    fields = ", ".join(f"{e} AS {f}" for f, e in FIELDS.items())
    return f"SELECT c AS doc_id, k AS unit_seq, loc AS location, {TEXT} AS text, name, {', '.join(FIELDS)} FROM (SELECT o_custkey AS c, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'header' ELSE 'body' END AS loc, {name} AS name, {fields} FROM (SELECT *, o_orderkey AS k FROM {orders}) o) s"


#: Bytes of keys, as Spark estimates them, of one task: some 25,000 rows.
KEY_BYTES = 64 << 10


def spread(keys: DataFrame) -> DataFrame:
    """Narrow key rows dealt to tasks by their size: what is made of the keys is much wider than their files.

    The number of cores alone won't do: Spark counts two as long as no executor has registered.
    """
    size = int(str(keys._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return keys.repartition(max(keys.sparkSession.sparkContext.defaultParallelism, -(-size // KEY_BYTES)), "o_orderkey")


#: Bytes of code beyond which the JVM interprets a method, ever.
HUGE_METHOD = 8000


def carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with known entities, made of orders; one document a customer.

    The fields in one generated method are beyond what the JVM compiles. The limit, left set in the session, has Spark split such methods.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(limit, str(min(HUGE_METHOD, int(spark.conf.get(limit)))))
    made = spark.sql(carrier_sql("{orders}", NAME), orders=spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")))
    # A company's number is among the known entities: a name and a number claim one span.
    return made.withColumn("known", F.array(F.lit("Ján Novák"), F.lit("Mária Kováčová"), F.lit(" "), F.col("ico")))


def _truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRUTH).option("multiLine", True).option("pathGlobFilter", "*.gt.json").json(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (file name), must_be_refused, surface, type, auto_redact, should_flag, part of every entry of the *.gt.json files."""
    d = _truth(spark, path)
    return d.select(F.col("source_file").alias("doc_id"), "must_be_refused", F.explode("pii").alias("p")).select("doc_id", "must_be_refused", "p.surface", "p.type", "p.auto_redact", "p.should_flag", F.col("p.location.surface_part").alias("part"))


def read_truth_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, doc_type, must_refuse, known (names among the entities, in order) of every *.gt.json file, with entries or not."""
    names = F.transform(F.filter("entities", lambda e: e.category == "MENO"), lambda e: e.canonical)
    return _truth(spark, path).select(F.col("source_file").alias("doc_id"), "doc_type", F.col("must_be_refused").alias("must_refuse"), F.coalesce(names, F.array().cast("array<string>")).alias("known"))


def known_lines(text: Column) -> Column:
    """A reviewer's text as known entities: its lines, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))), lambda x: x != "")
