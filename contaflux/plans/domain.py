"""Domain views over the star-schema tables: each is one projection that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (table, condition, [(column, expression)]). The expressions are plain SQL of both engines.
VIEWS: dict[str, tuple[str, str, list[tuple[str, str]]]] = {
    "fiscal_document": ("orders", "true", [
        ("id", "o_orderkey"), ("tenant_id", "o_custkey % 4"), ("party_id", "o_custkey"), ("total", "o_totalprice"), ("doc_date", "cast(o_orderdate AS date)"),
        ("due_date", "cast(o_orderdate + INTERVAL 30 DAY AS date)"), ("doc_number", "concat('FT ', year(o_orderdate), '/', o_orderkey)"),
        ("type", "CASE WHEN o_orderkey % 20 = 0 THEN 'NOTA_CREDITO' WHEN o_orderstatus = 'F' THEN 'FATURA_EMITIDA' WHEN o_orderstatus = 'O' THEN 'FATURA_RECEBIDA' ELSE 'RECIBO' END"),
        ("status", "CASE WHEN o_orderkey % 7 = 0 THEN 'ARQUIVADO' WHEN o_orderkey % 3 = 0 THEN 'NOVO' WHEN o_orderkey % 3 = 1 THEN 'EM_REVISAO' ELSE 'APROVADO' END"),
        ("file_hash", "concat('h', o_orderkey % 9000)"),
        ("counterparty", "CASE WHEN o_orderkey % 4 = 0 THEN concat('MOV ', o_custkey) WHEN o_orderkey % 4 = 1 THEN concat('Fornecedor ', o_custkey, ' Lda') WHEN o_orderkey % 4 = 2 THEN NULL ELSE 'Pag. Obrigado' END")]),
    "expense": ("orders", "true", [
        ("id", "o_orderkey"), ("tenant_id", "o_custkey % 4"), ("amount", "CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice + 100 ELSE o_totalprice END"), ("date", "cast(o_orderdate AS date)"),
        ("description", "CASE WHEN o_orderkey % 6 = 0 THEN concat('Despesa ft ', year(o_orderdate), '/', o_orderkey, ' ') ELSE 'Despesa' END"), ("status", "CASE WHEN o_orderkey % 5 = 0 THEN 'REJECTED' ELSE 'APPROVED' END"),
        ("document_id", "CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE NULL END")]),
    "invoice": ("orders", "true", [
        ("id", "o_orderkey"), ("tenant_id", "o_custkey % 4"), ("number", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('FR ', o_orderkey) END"), ("amount", "o_totalprice"),
        ("date", "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE cast(o_orderdate AS date) END"), ("customer", "concat('Cliente ', o_custkey)"), ("document_id", "CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey ELSE NULL END")]),
    "document_item": ("lineitem", "true", [
        ("document_id", "l_orderkey"), ("line", "l_linenumber"), ("account_id", "l_partkey"), ("quantity", "l_quantity"), ("total", "l_extendedprice"), ("discount", "l_discount"),
        ("tax_rate", "CASE WHEN l_tax < 0.02 THEN 0.0 WHEN l_tax < 0.04 THEN 6.0 WHEN l_tax < 0.06 THEN 13.0 ELSE 23.0 END")]),
    "bank_transaction": ("orders", "true", [
        ("id", "o_orderkey"), ("tenant_id", "o_custkey % 4"), ("amount", "CASE WHEN o_orderkey % 2 = 0 THEN -o_totalprice ELSE o_totalprice END"),
        ("date", "cast(o_orderdate + (o_orderkey % 10) * INTERVAL 5 DAY AS date)"), ("reference", "CASE WHEN o_orderkey % 3 = 0 THEN concat(' ft ', year(o_orderdate), '/', o_orderkey, ' ') ELSE NULL END"),
        ("description", "CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 1 THEN concat('TRF PAG FT ', year(o_orderdate), '/', o_orderkey, ' OBRIGADO') ELSE concat('MOV ', o_custkey) END")]),
    "payable": ("orders", "true", [
        ("id", "o_orderkey"), ("tenant_id", "o_custkey % 4"), ("party_id", "o_custkey"), ("document_id", "o_orderkey"), ("amount", "o_totalprice"), ("due_date", "cast(o_orderdate + INTERVAL 30 DAY AS date)"),
        ("status", "CASE o_orderpriority WHEN '1-URGENT' THEN 'OVERDUE' WHEN '2-HIGH' THEN 'TO_PAY' WHEN '3-MEDIUM' THEN 'SCHEDULED' WHEN '5-LOW' THEN 'PAID' ELSE 'CANCELLED' END"),
        ("approved", "o_orderkey % 4 <> 0")]),
    "party": ("customer", "true", [
        ("id", "c_custkey"), ("name", "c_name"), ("type", "CASE WHEN c_custkey % 2 = 0 THEN 'FORNECEDOR' ELSE 'CLIENTE' END"), ("segment", "c_mktsegment"), ("balance", "c_acctbal"),
        ("iban", "concat('PT50', lpad(cast(c_custkey AS varchar(20)), 21, '0'))"), ("nif8", "cast(20000000 + c_custkey AS varchar(20))"), ("flagged", "c_custkey % 17 = 0"),
        ("email", "concat('p', c_custkey % 700, '@example.com')"), ("phone", "concat('+351 9', lpad(cast(c_custkey % 900 AS varchar(20)), 8, '0'))")]),
    "deal": ("orders", "true", [
        ("id", "o_orderkey"), ("contact_id", "o_custkey"), ("value", "o_totalprice"), ("expected", "cast(o_orderdate AS date)"),
        ("stage", "CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'WON' ELSE 'LOST' END WHEN o_orderpriority = '1-URGENT' THEN 'NEGOTIATION' WHEN o_orderpriority = '2-HIGH' THEN 'PROPOSAL' WHEN o_orderpriority = '3-MEDIUM' THEN 'QUALIFIED' ELSE 'LEAD' END")]),
    "suggestion": ("orders", "true", [
        ("id", "o_orderkey"), ("tenant_id", "o_custkey % 4"), ("tx_id", "o_orderkey % 5000"), ("document_id", "o_orderkey"), ("score", "(o_orderkey % 50) / 50.0"),
        ("match_type", "CASE o_orderkey % 3 WHEN 0 THEN 'STRONG' WHEN 1 THEN 'MEDIUM' ELSE 'WEAK' END"), ("status", "CASE o_orderkey % 7 WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'REJECTED' ELSE 'PENDING' END"), ("created_at", "o_orderdate")]),
    "contact": ("customer", "true", [
        ("id", "c_custkey"), ("tenant_id", "c_custkey % 4"), ("name", "concat('Contact ', c_custkey % 97)"), ("type", "CASE c_custkey % 3 WHEN 0 THEN 'COMPANY' WHEN 1 THEN 'PERSON' ELSE 'LEAD' END"), ("active", "c_custkey % 6 <> 0"),
        ("nif", "concat('50000', lpad(cast(c_custkey % 1000 AS varchar(20)), 4, '0'))"), ("email", "concat('Mail', c_custkey % 700, '@Example.com')"), ("city", "CASE c_custkey % 3 WHEN 0 THEN 'Lisboa' WHEN 1 THEN 'Porto' ELSE NULL END"),
        ("parent_id", "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey - c_custkey % 10 END")]),
    "activity": ("events", "true", [
        ("id", "event_id"), ("tenant_id", "user_id % 4"), ("type", "event_type"), ("contact_id", "user_id"), ("deal_id", "CASE WHEN event_id % 3 = 0 THEN event_id % 100 ELSE NULL END"), ("assignee", "user_id % 7"),
        ("due", "CASE WHEN event_id % 5 <> 0 THEN ts ELSE NULL END"), ("completed_at", "CASE WHEN event_id % 4 = 0 THEN ts ELSE NULL END"), ("created_at", "ts"),
        ("metadata", "concat('{\"source\":\"', CASE WHEN event_id % 3 = 0 THEN 'hubspot' ELSE 'pipedrive' END, '\"}')")]),
    "schedule": ("orders", "true", [
        ("id", "o_orderkey"), ("tenant_id", "o_custkey % 4"), ("party_id", "o_custkey"), ("amount", "o_totalprice"), ("due_date", "cast(o_orderdate AS date)"),
        ("status", "CASE o_orderkey % 5 WHEN 0 THEN 'PAID' WHEN 1 THEN 'CANCELLED' ELSE 'PENDING' END"), ("recurrence", "CASE o_orderkey % 7 WHEN 0 THEN 'DAILY' WHEN 1 THEN 'WEEKLY' WHEN 2 THEN 'MONTHLY' WHEN 3 THEN 'QUARTERLY' WHEN 4 THEN 'YEARLY' ELSE NULL END"), ("step", "o_orderkey % 3 + 1")]),
    "iban_change": ("orders", "true", [
        ("id", "o_orderkey"), ("party_id", "o_custkey"), ("old_iban", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('PT50', lpad(cast(o_orderkey AS varchar(20)), 21, '0')) END"),
        ("new_iban", "concat('PT50', lpad(cast(o_custkey + (o_orderkey % 2) AS varchar(20)), 21, '0'))"), ("created_at", "cast(o_orderdate AS date)")]),
    "creditor": ("customer", "true", [
        ("id", "c_custkey"), ("tenant_id", "c_custkey % 4"), ("name", "CASE WHEN c_custkey % 29 = 0 THEN '' WHEN c_custkey % 31 = 0 THEN repeat('N', 80) ELSE concat('A & B <', c_custkey, '>') END"), ("flagged", "c_custkey % 17 = 0"), ("verified", "c_custkey % 3 = 0"),
        ("nif", "cast(500000000 + c_custkey AS varchar(20))"),
        ("iban", "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'PT50000' WHEN c_custkey % 7 = 0 THEN concat('DE', lpad(cast(98 - (c_custkey * 1000000 + 131400) % 97 AS varchar(20)), 2, '0'), lpad(cast(c_custkey AS varchar(20)), 18, '0')) ELSE concat('PT', lpad(cast(98 - (c_custkey * 1000000 + 252900) % 97 AS varchar(20)), 2, '0'), lpad(cast(c_custkey AS varchar(20)), 21, '0')) END")]),
    "journal": ("lineitem", "true", [("account_id", "l_partkey"), ("debit", "CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_extendedprice END"), ("credit", "CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0.0 END"), ("date", "cast(l_shipdate AS date)")]),
    "account": ("part", "true", [("id", "p_partkey"), ("code", "concat(CASE WHEN p_size % 3 = 0 THEN '7' ELSE '6' END, p_size)"), ("name", "p_type"), ("active", "p_size % 10 <> 0")]),
    "employee": ("customer", "true", [("id", "c_custkey"), ("name", "c_name"), ("period", "c_nationkey"), ("gross", "cast(floor(abs(c_acctbal) * 50) / 100 AS decimal(12,2))")]),
    "audit": ("events", "true", [("id", "event_id"), ("tenant_id", "user_id % 10"), ("action", "event_type"), ("created_at", "ts"), ("user_id", "user_id"), ("value", "value")]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, condition, columns = VIEWS[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet").where(condition)
    return rows.selectExpr(*(f"{e} AS {c}" for c, e in columns))


def sql(name: str) -> str:
    """The view as a common table expression."""
    source, condition, columns = VIEWS[name]
    return f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns)} FROM {source} WHERE {condition})"


def with_views(names: str, query: str) -> str:
    return f"WITH {', '.join(sql(n) for n in names.split())} {query}"
