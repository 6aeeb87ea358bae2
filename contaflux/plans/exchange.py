"""Queries of statement files, signed calls, rules and vectors, with their DuckDB twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contaflux.functions import canonical, embed, signatures, vectors
from contaflux.operators import conditions
from contaflux.plans.base import ORACLES, QUERIES, add, add_raw
from contaflux.plans.domain import sql
from contaflux.sources import statements
from contaflux.sources.shared import shared_folder

# Statement files ----------------------------------------------------------------------

_MOST_MOVEMENTS = 50_000  # of one statement file
_BAD_DATE, _BAD_AMOUNT = "id % 97 = 0", "id % 89 = 0 AND id % 97 <> 0"


def _files(t: DataFrame) -> str:
    """Movements as statement files of two banks: semicolons after a byte order mark, and commas in
    another order of columns. Some dates don't exist, some amounts are words. A folder by bank gets no
    file from a task that has no rows: one with nothing but a header would be a reject."""
    folder = shared_folder(t.sparkSession, "statements")
    amount = F.when(F.expr(_BAD_AMOUNT), "n/a").otherwise(F.replace(F.format_string("%.2f", "amount"), F.lit("."), F.lit(",")))
    day = lambda f: F.when(F.expr(_BAD_DATE), "31/02/2026").otherwise(F.date_format("date", f))
    one = t.where("id % 2 = 0").select(day("dd/MM/yyyy").alias("﻿Data"), F.concat(F.lit('"'), "description", F.lit('"; ')).alias("Descrição"), amount.alias("Valor"), F.col("id").alias("Ref"))
    other = t.where("id % 2 = 1").select(F.col("id").alias("ref"), amount.alias("VALOR"), day("yyyy-MM-dd").alias("data"), F.col("description").alias("descrição"))
    for name, rows, sep in (("a", one, ";"), ("b", other, ",")):
        rows.withColumn("bank", F.lit(name)).write.partitionBy("bank").option("header", True).option("sep", sep).option("escape", '"').option("maxRecordsPerFile", _MOST_MOVEMENTS).csv(f"{folder}/{name}")
    return f"{folder}/*/bank=*/*.csv"


_MAPPING = {"date": "Data", "description": "Descrição", "amount": "Valor", "reference": "Ref"}


def _read(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    return statements.read(t.sparkSession, _files(t), _MAPPING)


add("src_02_statement_rows", "bank_transaction", lambda t: _read(t)[0].select("date", "description", "amount", "reference"), f"SELECT date, CASE WHEN id % 2 = 0 THEN concat('\"', description, '\";') ELSE description END AS description, CAST(printf('%.2f', amount) AS DOUBLE) AS amount, CAST(id AS VARCHAR) AS reference FROM bank_transaction WHERE NOT ({_BAD_DATE}) AND NOT ({_BAD_AMOUNT})")
add("src_03_dialects", "bank_transaction", lambda t: statements.records(t.sparkSession, _files(t)).groupBy("delimiter").agg(F.count("*").alias("n")), "SELECT CASE WHEN id % 2 = 0 THEN ';' ELSE ',' END AS delimiter, count(*) AS n FROM bank_transaction GROUP BY 1")
add("fil_25_rejects", "bank_transaction", lambda t: _read(t)[1].select("reason", F.array_join(F.array_sort(F.filter("fields", lambda f: f.rlike(r"^\d+$"))), ",").alias("ids")), f"SELECT CASE WHEN {_BAD_DATE} THEN 'date \"31/02/2026\"' ELSE 'amount \"n/a\"' END AS reason, CAST(id AS VARCHAR) AS ids FROM bank_transaction WHERE {_BAD_DATE} OR {_BAD_AMOUNT}")
add("snk_01_export_lines", "bank_transaction", lambda t: statements.export_lines(t.select("id", "date", F.concat("description", F.when(F.col("id") % 5 == 0, ' "x"; y').otherwise("")).alias("description"), "amount", "reference", F.lit("CSV").alias("source"))), f"""SELECT CAST(0 AS INTEGER) AS n, '﻿{';'.join(statements.EXPORTED)}' AS line
UNION ALL SELECT CAST(n AS INTEGER), concat_ws(';', id, strftime(date, '%d/%m/%Y'), CASE WHEN id % 5 = 0 THEN concat('"', description, ' ""x""; y"') ELSE description END, replace(printf('%.2f', amount), '.', ','), '', coalesce(reference, ''), '', 'CSV', '', '') FROM (SELECT *, row_number() OVER (ORDER BY date DESC, id) AS n FROM bank_transaction) WHERE n <= {statements.MOST_EXPORTED}""")

# Canonical JSON and signatures --------------------------------------------------------

_JSON = """CASE WHEN event_id % 2 = 0 THEN concat('{"type" : "', event_type, '", "user":{"value":', cast(floor(value * 100) AS bigint), ', "id": ', user_id, '.0}, "props": ', props, '}')
ELSE concat('{"props":', props, ',"user":{"id":', user_id, ',"value":', cast(floor(value * 100) AS bigint), 'e0},"type":"', event_type, '"}') END"""
add_raw("jsn_03_canonical", "events", lambda e: e.select("event_id", canonical.canonical(F.expr(_JSON)).alias("text"), canonical.digest(F.expr(_JSON)).alias("hash")), """SELECT event_id, text, sha256(text) AS hash FROM (SELECT event_id, concat('{"props":', replace(props, ' ', ''), ',"type":"', event_type, '","user":{"id":', user_id, ',"value":', cast(floor(value * 100) AS bigint), '}}') AS text FROM events)""")

_BODY = "concat(event_id, '|', event_type, '|', props)"


def _pad_sql(key: str, pad: int) -> str:
    """A key of up to a block's length (ASCII), filled up and each byte xor pad, as hexadecimal."""
    return f"list_aggregate(list_transform(range(1, 65), lambda i: printf('%02x', xor(CASE WHEN i <= length({key}) THEN ord(substr({key}, CAST(i AS INTEGER), 1)) ELSE 0 END, {pad}))), 'string_agg', '')"


_HMAC = "sha256(unhex(outer_pad) || unhex(sha256(unhex(inner_pad) || encode({0}))))"
_KEYED = f"SELECT n_nationkey, n_name, {_pad_sql('n_name', 0x36)} AS inner_pad, {_pad_sql('n_name', 0x5C)} AS outer_pad FROM nation"
_TENANT_SQL = "concat('NATION_', user_id % 25)"


def _signed(e: DataFrame, scheme: str = "sha256") -> DataFrame:
    rows = e.withColumn("body", F.expr(_BODY)).withColumn("key", F.expr(_TENANT_SQL))
    return rows.withColumn("signature", signatures.signed(F.col("key"), F.col("body"), scheme))


add_raw("jsn_05_signed", "events", lambda e: _signed(e, "sha256-base64").select("event_id", "signature", signatures.hmac(F.col("key"), F.col("body")).alias("digest")), f"SELECT event_id, base64(unhex(digest)) AS signature, digest FROM (SELECT event_id, {_HMAC.format(_BODY)} AS digest FROM events JOIN ({_KEYED}) ON n_name = {_TENANT_SQL})")


def _checked(e: DataFrame) -> DataFrame:
    """Signatures as they arrive: some are missing, some were made over another body or written otherwise."""
    sent = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("value") < 10, F.concat(F.lit(" "), "signature")).when(F.col("value") > 150, F.substring("signature", 8, 64)).when(F.col("event_type") == "view", signatures.signed(F.col("key"), F.col("props"), "prefixed")).otherwise(F.col("signature"))
    return _signed(e, "prefixed").select("event_id", signatures.fault(F.col("key"), F.col("body"), sent, "prefixed").alias("fault"))


add_raw("jsn_06_faults", "events", _checked, f"""SELECT event_id, CASE WHEN sent IS NULL THEN 'malformed' WHEN sent <> digest THEN 'mismatch' END AS fault FROM (SELECT event_id, {_HMAC.format(_BODY)} AS digest,
CASE WHEN event_type = 'error' THEN NULL WHEN value < 10 OR value > 150 OR event_type <> 'view' THEN {_HMAC.format(_BODY)} ELSE {_HMAC.format('props')} END AS sent FROM events JOIN ({_KEYED}) ON n_name = {_TENANT_SQL})""")

_PROVIDER = "CASE n_nationkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'signup' WHEN 3 THEN 'purchase' ELSE 'refund' END"


def _routed(spark, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    tenants = nation.select(F.col("n_nationkey").alias("tenant_id"), F.expr(_PROVIDER).alias("provider"), F.col("n_name").alias("secret"))
    calls = _signed(spark.read.parquet(f"{sf_dir}/events.parquet")).select("event_id", F.col("event_type").alias("provider"), "body", "signature")
    return signatures.routed(calls, tenants).select("event_id", "provider", F.col("tenant_id").cast("long").alias("tenant_id"))


QUERIES["join_28_routed"] = _routed
ORACLES["join_28_routed"] = f"""WITH keyed AS ({_KEYED}), tenants AS (SELECT *, {_PROVIDER} AS provider FROM keyed), calls AS (SELECT event_id, event_type AS provider, {_BODY} AS body, {_HMAC.format(_BODY)} AS signature FROM events JOIN keyed ON n_name = {_TENANT_SQL})
SELECT c.event_id, c.provider, CAST(min(t.n_nationkey) AS BIGINT) AS tenant_id FROM calls c LEFT JOIN tenants t ON t.provider = c.provider AND c.signature = {_HMAC.format('c.body')} GROUP BY c.event_id, c.provider"""

# Rules from users ---------------------------------------------------------------------

_RULES = """SELECT n_nationkey AS id, cast(n_regionkey * 10 AS int) AS priority, n_nationkey % 7 <> 0 AS active, CASE n_nationkey % 5
WHEN 0 THEN concat('{"type":"RECIBO","total":{"ge":', n_nationkey * 15000, '}}') WHEN 1 THEN concat('{"any":[{"supplier":"', n_nationkey, '7"},{"not":{"total":{"lt":', 480000 - n_nationkey, '}}}],"type":{"ne":"RECIBO"}}')
WHEN 2 THEN concat('{"doc_date":{"ge":"', 1992 + n_nationkey % 6, '-06-30"},"type":{"in":["NOTA_CREDITO","RECIBO"]}}') WHEN 3 THEN concat('{"all":[{"type":"RECIBO"},{"total":{"above":', n_nationkey, '}}]}') ELSE concat('{"number":{"ends":"', n_nationkey, '"}}') END AS conditions FROM nation"""
_HOLDS = """CASE r.id % 5 WHEN 0 THEN d.type = 'RECIBO' AND d.total >= r.id * 15000 WHEN 1 THEN (contains(concat('customer ', d.party_id), concat(r.id, '7')) OR d.total >= 480000 - r.id) AND d.type <> 'RECIBO'
WHEN 2 THEN d.doc_date >= CAST(concat(1992 + r.id % 6, '-06-30') AS DATE) AND d.type IN ('NOTA_CREDITO', 'RECIBO') WHEN 3 THEN false ELSE suffix(lower(d.doc_number), CAST(r.id AS VARCHAR)) END"""


def _split(columns: str) -> list[str]:
    """The expressions of a list of columns, cut at the names they are given."""
    return [c.strip(", ") for c in re.split(r"(?<= AS id),|(?<= AS priority),|(?<= AS active),", columns)]


def _ruled(spark, sf_dir: str):
    docs = QUERIES["prj_01_rule_documents"](spark, sf_dir)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    columns = _RULES.removeprefix("SELECT ").removesuffix(" FROM nation")
    return conditions.first_matching(docs, nation.selectExpr(*_split(columns)))


add("prj_01_rule_documents", "fiscal_document", lambda d: d.select("id", "type", "total", "doc_date", F.concat(F.lit("Customer "), "party_id").alias("supplier"), F.col("doc_number").alias("number")), "SELECT id, type, total, doc_date, concat('Customer ', party_id) AS supplier, doc_number AS number FROM fiscal_document")
QUERIES["udf_01_user_rules"] = lambda spark, sf_dir: _ruled(spark, sf_dir)[0].select("id", F.col("rule_id").cast("long").alias("rule_id"))
ORACLES["udf_01_user_rules"] = f"""WITH {sql('fiscal_document')}, rules AS (SELECT id, priority FROM ({_RULES}) WHERE active)
SELECT d.id, CAST(arg_min(r.id, (-r.priority, r.id)) AS BIGINT) AS rule_id FROM fiscal_document d LEFT JOIN rules r ON {_HOLDS} GROUP BY d.id"""
QUERIES["udf_01_rule_problems"] = lambda spark, sf_dir: spark.createDataFrame(_ruled(spark, sf_dir)[1], "id long, path string, problem string")
ORACLES["udf_01_rule_problems"] = f"SELECT CAST(id AS BIGINT) AS id, '$.all[1].total.above' AS path, 'no such operator: above' AS problem FROM ({_RULES}) WHERE active AND id % 5 = 3"

# Chunk vectors ------------------------------------------------------------------------


def _embedded(d: DataFrame) -> DataFrame:
    embed.register(d.sparkSession)
    return d.sparkSession.sql("SELECT doc_id, chunk, pos AS bucket, round(col, 6) AS weight FROM (SELECT d.doc_id, e.chunk, posexplode(e.vector) FROM {d} d, LATERAL embed(d.text) e) WHERE col > 0", d=d.select("doc_id", "text"))


add_raw("str_14_embed", "documents", _embedded, """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)), '\\s+'), lambda x: x <> '') AS words FROM documents),
c AS (SELECT doc_id, i // 64 AS chunk, array_to_string(words[i + 1 : i + 80], ' ') AS content FROM (SELECT doc_id, words, unnest(range(0, len(words), 64)) AS i FROM w)),
t AS (SELECT doc_id, chunk, CAST(('0x' || substr(sha1(token), 3, 2)) AS INTEGER) AS bucket FROM (SELECT doc_id, chunk, unnest(regexp_split_to_array(strip_accents(lower(content)), '[^a-z0-9]+')) AS token FROM c) WHERE length(token) BETWEEN 2 AND 24),
n AS (SELECT doc_id, chunk, bucket, count(*) AS k FROM t GROUP BY ALL)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, bucket, round(k / sqrt(sum(k * k) OVER (PARTITION BY doc_id, chunk)), 6) AS weight FROM n""")
_ASKED = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
add_raw("src_20_json_vectors", "embeddings", lambda e: e.select("vec_id", embed.of_json(F.to_json("embedding")).alias("v")).select("vec_id", F.size("v").alias("n"), F.round(vectors.cosine(F.col("v"), F.array(*map(F.lit, _ASKED))), 5).alias("score")), f"SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_cosine_similarity(CAST(CAST(embedding AS VARCHAR[]) AS DOUBLE[]), {_ASKED}::DOUBLE[]), 5) AS score FROM embeddings")
