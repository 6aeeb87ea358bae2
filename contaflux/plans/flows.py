"""Queries of payments, suppliers, orders, anomalies, search and state changes, with their DuckDB twins."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contaflux.functions.money import ANOMALY_WEIGHTS
from contaflux.operators import anomalies, boards, extraction, filing, fulltext, parties, retrieval, states
from contaflux.plans.base import ORACLES, QUERIES, TODAY, YEAR, add, add_raw, cents, euro
from contaflux.sources import bank, orders, sepa

_NOW = datetime.datetime(1997, 1, 1, 12)

# SEPA ---------------------------------------------------------------------------------

_READY = "SELECT y.id, y.amount, c.name, c.iban, c.nif, y.party_id FROM payable y LEFT JOIN creditor c ON c.id = y.party_id WHERE y.approved AND y.status IN ('TO_PAY', 'SCHEDULED')"
_FAULT = "CASE WHEN iban IS NULL THEN 'iban missing' WHEN party_id % 11 = 0 THEN 'iban invalid' WHEN name = '' THEN 'name missing' WHEN length(name) > 70 THEN 'name too long' END"
_SHOWN = "concat('A &amp; B &lt;', party_id, '&gt;')"
_XML = f"concat('<CdtTrfTxInf><PmtId><EndToEndId>', id, '</EndToEndId></PmtId><Amt><InstdAmt Ccy=\"EUR\">', printf('%.2f', amount), '</InstdAmt></Amt>', CASE WHEN id % 2 = 0 THEN '<CdtrAgt><FinInstnId><BIC>BCOMPTPL</BIC></FinInstnId></CdtrAgt>' ELSE '' END, '<Cdtr><Nm>', {_SHOWN}, '</Nm></Cdtr><CdtrAcct><Id><IBAN>', iban, '</IBAN></Id></CdtrAcct>', CASE WHEN id % 3 = 0 THEN '<RmtInf><Ustrd>Fatura &amp; recibo</Ustrd></RmtInf>' ELSE '' END, '</CdtTrfTxInf>')"
_SENT = f"SELECT id, party_id, fault IS NULL AS valid, fault, CASE WHEN fault IS NULL THEN {_XML} END AS xml, {cents('amount')} AS c, CASE WHEN id % 4 = 1 THEN 'one' WHEN id % 4 = 2 THEN 'two' ELSE 'bad' END AS instruction FROM (SELECT *, {_FAULT} AS fault FROM ({_READY}))"


def _transfers(y: DataFrame, c: DataFrame) -> DataFrame:
    who = c.select(F.col("id").alias("party_id"), "name", "iban")
    rows = y.where("approved AND status IN ('TO_PAY', 'SCHEDULED')").join(who, "party_id", "left")
    instruction = F.when(F.col("id") % 4 == 1, "one").when(F.col("id") % 4 == 2, "two").otherwise("bad")
    return sepa.transfers(rows.select("id", "amount", "name", "iban", F.when(F.col("id") % 2 == 0, " bcomptpl ").alias("bic"), F.when(F.col("id") % 3 == 0, "Fatura & recibo").alias("remittance"), instruction.alias("instruction")))


def _debtors(y: DataFrame) -> DataFrame:
    rows = [("one", "Casa & Filhos", "PT50000201231234567890154", None, TODAY), ("two", "Casa", "PT77003506510000000000739", "abcdptpl", TODAY), ("bad", "Casa", "PT00", None, TODAY)]
    return y.sparkSession.createDataFrame(rows, "instruction string, name string, iban string, bic string, execution date")


_HEADS = f"""SELECT instruction, n, {euro('c')} AS control_sum, concat('<PmtInfId>', instruction, '</PmtInfId><PmtMtd>TRF</PmtMtd><BtchBookg>true</BtchBookg><NbOfTxs>', n, '</NbOfTxs><CtrlSum>', printf('%.2f', c / 100.0), '</CtrlSum><PmtTpInf><SvcLvl><Cd>SEPA</Cd></SvcLvl></PmtTpInf><ReqdExctnDt>{TODAY}</ReqdExctnDt><Dbtr><Nm>',
CASE instruction WHEN 'one' THEN 'Casa &amp; Filhos' ELSE 'Casa' END, '</Nm></Dbtr><DbtrAcct><Id><IBAN>', CASE instruction WHEN 'one' THEN 'PT50000201231234567890154' ELSE 'PT77003506510000000000739' END, '</IBAN></Id></DbtrAcct><DbtrAgt><FinInstnId><BIC>', CASE instruction WHEN 'two' THEN 'ABCDPTPL' ELSE '' END, '</BIC></FinInstnId></DbtrAgt>') AS head
FROM (SELECT instruction, count(*) AS n, sum(c) AS c FROM ({_SENT}) WHERE valid AND instruction <> 'bad' GROUP BY instruction)"""
add("snk_03_sepa_transfers", "payable creditor", lambda y, c: _transfers(y, c).select("id", "valid", "fault", "xml"), f"SELECT id, valid, fault, xml FROM ({_SENT})")
add("snk_04_sepa_instructions", "payable creditor", lambda y, c: sepa.instructions(_transfers(y, c), _debtors(y)), _HEADS)
add("snk_02_sepa_message", "payable creditor", lambda y, c: sepa.message(_transfers(y, c), _debtors(y), "MSG-1", "Casa", datetime.datetime(1997, 1, 1, 9, 30)).select("place.instruction", "place.part", "place.row", "line"), f"""SELECT '' AS instruction, -1 AS part, CAST(0 AS BIGINT) AS "row", concat('<?xml version="1.0" encoding="UTF-8"?>', chr(10), '<Document xmlns="{sepa.NAMESPACE}" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><CstmrCdtTrfInitn><GrpHdr><MsgId>MSG-1</MsgId><CreDtTm>1997-01-01T09:30:00</CreDtTm><NbOfTxs>', count(*), '</NbOfTxs><CtrlSum>', printf('%.2f', sum(c) / 100.0), '</CtrlSum><InitgPty><Nm>Casa</Nm></InitgPty></GrpHdr>') AS line FROM ({_SENT}) WHERE valid AND instruction <> 'bad'
UNION ALL SELECT instruction, 0, 0, '<PmtInf>' || head FROM ({_HEADS}) UNION ALL SELECT instruction, 1, id, xml FROM ({_SENT}) WHERE valid AND instruction <> 'bad' UNION ALL SELECT instruction, 2, 0, '</PmtInf>' FROM ({_HEADS}) UNION ALL SELECT chr(65535), 3, 0, '</CstmrCdtTrfInitn></Document>'""")
add("snk_05_sepa_csv", "payable creditor", lambda y, c: sepa.csv_lines(y.withColumn("description", F.when(F.col("id") % 2 == 0, 'Renda; "x" y')), c, TODAY), f"""SELECT id, concat_ws(';', '{TODAY}', id, replace(printf('%.2f', amount), '.', ','), coalesce(name, ''), coalesce(nif, ''), coalesce(iban, ''), '', CASE WHEN id % 2 = 0 THEN '"Renda; ""x"" y"' ELSE '' END) AS line FROM ({_READY})""")
_NET = "CASE WHEN gross <= 920 THEN 0 WHEN gross <= 1400 THEN 0.13 WHEN gross <= 2200 THEN 0.18 WHEN gross <= 3200 THEN 0.23 ELSE 0.28 END"
add("snk_06_payroll_sepa", "employee creditor", lambda e, c: sepa.payroll_transfers(boards.payroll_lines(e), c.select("id", "name", "iban")).select("id", "valid", "fault", "cents"), f"SELECT id, fault IS NULL AS valid, fault, c AS cents FROM (SELECT e.id, CASE WHEN c.iban IS NULL THEN 'iban missing' WHEN c.id % 11 = 0 THEN 'iban invalid' WHEN c.name = '' THEN 'name missing' WHEN length(c.name) > 70 THEN 'name too long' WHEN net <= 0 THEN 'amount' END AS fault, CAST(net * 100 AS BIGINT) AS c FROM (SELECT id, gross - CAST(round(gross * CAST({_NET} AS DECIMAL(5,4)), 2) AS DECIMAL(12,2)) - CAST(round(gross * CAST(0.11 AS DECIMAL(5,4)), 2) AS DECIMAL(12,2)) AS net FROM employee) e LEFT JOIN creditor c ON c.id = e.id)")

# Statements and orders ----------------------------------------------------------------

_CODES = ["OPBD", "CLBD", "PRCD"]


def _statements(d: DataFrame) -> DataFrame:
    bal = lambda code, amount: F.concat(F.lit(f"<Bal><Tp><CdOrPrtry><Cd>{code}</Cd></CdOrPrtry></Tp><Amt Ccy='EUR'>"), amount, F.lit("</Amt></Bal>"))
    first = bal("OPBD", F.lit("1.000,50"))
    return d.select("id", F.concat(F.lit("<Stmt>"), F.when(F.col("id") % 3 == 0, F.concat(first, bal("CLBD", F.col("id").cast("string")))).when(F.col("id") % 3 == 1, first).otherwise(""), F.lit("</Stmt>")).alias("xml"))


add("src_05_closing_balance", "fiscal_document", lambda d: bank.closing_balance(_statements(d)), "SELECT id, CAST(CASE id % 3 WHEN 0 THEN id WHEN 1 THEN 1000.5 END AS DOUBLE) AS balance FROM fiscal_document")
add("prj_19_camt_rows", "bank_transaction", lambda t: bank.as_movements(t.select("date", "amount", F.when(F.col("id") % 3 == 0, "Renda").alias("remittance"), F.when(F.col("id") % 2 == 0, F.lit(" ")).otherwise("Loja").alias("counterparty"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("E"), "id")).alias("end_to_end_id"), F.lit("B").alias("bank_ref"))).select("date", "amount", "description", "reference"), "SELECT date, amount, CASE WHEN id % 3 = 0 THEN 'Renda' WHEN id % 2 = 1 THEN 'Loja' WHEN id % 5 <> 0 THEN concat('E', id) ELSE 'Movimento CAMT' END AS description, CASE WHEN id % 5 <> 0 THEN concat('E', id) ELSE 'B' END AS reference FROM bank_transaction")
add("join_23_new_camt_rows", "bank_transaction", lambda t: parties.new_rows(t.select("tenant_id", F.concat(F.lit("E"), F.col("id") % 4000).alias("import_hash")), t.where("id % 4000 < 100").select("tenant_id", F.concat(F.lit("E"), F.col("id") % 4000).alias("import_hash")), ["tenant_id", "import_hash"]), "SELECT DISTINCT tenant_id, concat('E', id % 4000) AS import_hash FROM bank_transaction WHERE (tenant_id, id % 4000) NOT IN (SELECT (tenant_id, id % 4000) FROM bank_transaction WHERE id % 4000 < 100)")
add("prj_18_mapping", "bank_transaction", lambda t: bank.mapped(t, bank.effective_mapping({"amount": "AMOUNT", "text": "Description"}, {"amountColumn": "id", "dateColumn": "DATE", "balanceColumn": ""})), "SELECT amount, description AS text, date FROM bank_transaction")


def _orders(d: DataFrame) -> DataFrame:
    body = F.format_string('{"id":%d,"number":"N%d","total":"%.2f","date_paid":"1996-05-01T10:00:00","billing":{"company":"%s","first_name":"Ana","last_name":"Sá","email":" Mail%d@EXAMPLE.com ","vat_number":%s},"line_items":[{"id":1,"name":"x","quantity":2,"subtotal":"10.00","total":"9.00","sku":"S"},{"id":2,"name":"y","quantity":0,"total":"z"}]}',
        F.col("id"), F.col("id") % 9000, F.col("total"), F.when(F.col("id") % 2 == 0, "Loja").otherwise(""), F.col("id") % 1000, F.when(F.col("id") % 3 == 0, F.concat(F.lit('"50000'), F.lpad((F.col("id") % 2000).cast("string"), 4, "0"), F.lit('"'))).otherwise("null"))
    return orders.parsed(d.select("tenant_id", F.when(F.col("id") % 17 == 0, "no json").otherwise(body).alias("json")))


add("src_16_orders", "fiscal_document", lambda d: _orders(d).select("tenant_id", "order_id", "number", "total", "date", "customer", "email"), "SELECT tenant_id, id AS order_id, concat('N', id % 9000) AS number, CAST(printf('%.2f', total) AS DOUBLE) AS total, DATE '1996-05-01' AS date, CASE WHEN id % 2 = 0 THEN 'Loja' ELSE 'Ana Sá' END AS customer, concat('mail', id % 1000, '@example.com') AS email FROM fiscal_document WHERE id % 17 <> 0")
add("src_16_new_orders", "fiscal_document", lambda d: orders.new_orders(_orders(d), d.where("id % 9000 < 500").select("tenant_id", F.concat(F.lit("N"), F.col("id") % 9000).alias("number")).distinct()).select("tenant_id", "order_id"), "SELECT tenant_id, max(id) AS order_id FROM fiscal_document WHERE id % 17 <> 0 AND (tenant_id, id % 9000) NOT IN (SELECT (tenant_id, id % 9000) FROM fiscal_document WHERE id % 9000 < 500) GROUP BY tenant_id, id % 9000")
add("src_16_order_items", "fiscal_document", lambda d: orders.order_items(_orders(d)).select("order_id", "line", "price", "total", "code"), "SELECT id AS order_id, k AS line, CASE k WHEN 1 THEN 5.0 ELSE 0.0 END AS price, CASE k WHEN 1 THEN 9.0 ELSE 0.0 END AS total, CASE k WHEN 1 THEN 'S' END AS code FROM fiscal_document, (VALUES (1), (2)) v(k) WHERE id % 17 <> 0")
_CUSTOMER = "(SELECT min(id) FROM contact c WHERE c.active AND c.tenant_id = d.tenant_id AND {})"
add("join_24_order_customers", "fiscal_document contact", lambda d, c: orders.with_customers(_orders(d), c).select("order_id", "party_id"), "SELECT d.id AS order_id, coalesce(a.p, b.p) AS party_id FROM fiscal_document d LEFT JOIN (SELECT tenant_id, nif, min(id) AS p FROM contact WHERE active GROUP BY 1, 2) a ON a.tenant_id = d.tenant_id AND d.id % 3 = 0 AND a.nif = concat('50000', lpad(CAST(d.id % 2000 AS VARCHAR), 4, '0')) LEFT JOIN (SELECT tenant_id, lower(email) AS e, min(id) AS p FROM contact WHERE active GROUP BY 1, 2) b ON b.tenant_id = d.tenant_id AND b.e = concat('mail', d.id % 1000, '@example.com') WHERE d.id % 17 <> 0")

# Suppliers ----------------------------------------------------------------------------


def _known(c: DataFrame) -> DataFrame:
    number = F.when(F.col("id") % 3 == 0, F.concat(F.lit("DE"), F.lpad(F.col("id").cast("string"), 9, "0"))).otherwise(F.concat(F.lit("5"), F.lpad(F.col("id").cast("string"), 8, "0")))
    return c.select("id", "tenant_id", number.alias("nif"), F.when(F.col("id") % 3 == 0, "DE").otherwise("PT").alias("country"))


def _asked(d: DataFrame) -> DataFrame:
    k = F.col("party_id")
    return d.select("id", "tenant_id", F.when(F.col("id") % 5 == 0, "DE").when(F.col("id") % 5 == 4, "").otherwise("PT").alias("country"), F.when(F.col("id") % 5 == 1, F.concat(F.lit("5"), F.lpad(k.cast("string"), 8, "0"))).alias("nif"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("DE"), F.lpad(k.cast("string"), 9, "0"))).when(F.col("id") % 5 == 2, F.concat(F.lit("XX"), F.lpad(k.cast("string"), 8, "0"))).alias("vat"), F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.5).alias("confidence"), F.lit(" Loja ").alias("supplier"), F.lit("PT50000201231234567890154").alias("iban"))


_RESOLVED = """SELECT id, tenant_id, party_id, CASE WHEN id % 5 = 0 AND party_id % 3 = 0 THEN party_id WHEN id % 5 = 1 AND party_id % 3 <> 0 THEN party_id WHEN id % 5 = 2 THEN (CASE WHEN party_id % 3 <> 0 THEN party_id END) END AS found, CASE WHEN id % 5 = 0 THEN true WHEN id % 5 = 1 THEN CASE WHEN r < 2 THEN 0 ELSE 11 - r END = party_id % 10 ELSE false END AS valid
FROM (SELECT *, (5 * 9 + sum_digits) % 11 AS r FROM (SELECT id, tenant_id, party_id, list_sum(list_transform(range(1, 8), lambda i: CAST(substr(lpad(CAST(party_id AS VARCHAR), 8, '0'), i, 1) AS INTEGER) * (9 - i))) AS sum_digits FROM fiscal_document))"""
add("join_15_suppliers", "fiscal_document contact", lambda d, c: parties.resolved(_asked(d), _known(c)), f"SELECT id, found AS party_id, valid, NOT (valid AND id % 2 = 0) AS review FROM ({_RESOLVED})")


def _new_suppliers(d: DataFrame, c: DataFrame) -> DataFrame:
    asked = _asked(d)
    return parties.new_suppliers(asked, parties.resolved(asked, _known(c)))


add("join_16_new_suppliers", "fiscal_document contact", lambda d, c: _new_suppliers(d, c).groupBy("tenant_id", "country", "name", "iban").agg(F.count("*").alias("n"), F.countDistinct("nif").alias("numbers")), f"""SELECT tenant_id, country, 'Loja' AS name, 'PT50000201231234567890154' AS iban, count(*) AS n, count(DISTINCT nif) AS numbers FROM (
SELECT tenant_id, CASE WHEN id % 5 = 0 THEN 'DE' ELSE 'PT' END AS country, CASE WHEN id % 5 = 0 THEN concat('DE', lpad(CAST(party_id AS VARCHAR), 9, '0')) WHEN id % 5 = 1 AND valid THEN concat('5', lpad(CAST(party_id AS VARCHAR), 8, '0')) END AS nif, min(id) AS first
FROM ({_RESOLVED}) WHERE found IS NULL GROUP BY tenant_id, 2, 3, CASE WHEN id % 5 = 0 OR (id % 5 = 1 AND valid) THEN NULL ELSE id END) GROUP BY tenant_id, country""")
add("join_17_checked_ibans", "fiscal_document creditor iban_change", lambda d, c, h: parties.checked_ibans(d.select("id", "party_id", F.when(F.col("id") % 3 == 0, "PT00").when(F.col("id") % 3 == 1, F.concat(F.lit("PT50"), F.lpad(F.col("party_id").cast("string"), 21, "0"))).otherwise("PT50000201231234567890154").alias("iban"), F.when(F.col("id") % 2 == 0, "PT1").alias("previous_iban")), c, h).select("id", F.array_join("reasons", ",").alias("reasons"), "flagged"), """SELECT d.id, concat_ws(',', CASE WHEN NOT valid THEN 'iban_invalid_format' END, CASE WHEN NOT seen THEN 'iban_not_in_party_history' END, CASE WHEN d.id % 2 = 0 AND NOT mine THEN 'iban_changed_since_last_doc' END) AS reasons, NOT valid OR NOT seen AS flagged
FROM (SELECT f.id, i, CASE f.id % 3 WHEN 0 THEN false WHEN 2 THEN true ELSE CAST(concat(substr(i, 5), '252950') AS HUGEINT) % 97 = 1 END AS valid, coalesce(i = c.iban, false) AS mine, coalesce(i = c.iban, false) OR coalesce(list_contains(h.known, i), false) AS seen
FROM (SELECT id, party_id, CASE id % 3 WHEN 0 THEN 'PT00' WHEN 1 THEN concat('PT50', lpad(CAST(party_id AS VARCHAR), 21, '0')) ELSE 'PT50000201231234567890154' END AS i FROM fiscal_document) f LEFT JOIN creditor c ON c.id = f.party_id
LEFT JOIN (SELECT party_id, list(new_iban) AS known FROM (SELECT *, row_number() OVER (PARTITION BY party_id ORDER BY created_at DESC, id DESC) AS r FROM iban_change) WHERE r <= 25 GROUP BY party_id) h ON h.party_id = f.party_id) d""")
add("join_21_imports", "contact", lambda c: parties.imported(c.select("id", "tenant_id", F.when(F.col("id") % 9 != 0, F.col("name")).alias("name"), F.when(F.col("id") % 2 == 0, "500000000").alias("nif"), F.concat(F.lit("MAIL"), F.col("id") % 900, F.lit("@example.com")).alias("email")), c.where("id % 2 = 1 OR id <= 40").withColumn("nif", F.when(F.col("id") == 4, "500000000"))), """SELECT i.id, CASE WHEN i.id % 9 = 0 THEN 'failed' WHEN p IS NULL THEN 'created' WHEN (p <> 4 AND i.id % 2 = 0) THEN 'merged' ELSE 'skipped' END AS outcome, CASE WHEN i.id % 9 <> 0 THEN p END AS contact_id
FROM (SELECT c.id, coalesce(CASE WHEN c.id % 2 = 0 AND c.tenant_id = 0 THEN 4 END, b.p) AS p FROM contact c LEFT JOIN (SELECT tenant_id, lower(email) AS e, min(id) AS p FROM contact WHERE active AND (id % 2 = 1 OR id <= 40) GROUP BY 1, 2) b ON b.tenant_id = c.tenant_id AND b.e = concat('mail', c.id % 900, '@example.com')) i""")
add("agg_18_recurring_pending", "fiscal_document", lambda d: parties.recurring(d.where("id % 20 = 0"), 3, d.where("id % 20 = 1")), "SELECT party_id, count(*) AS n FROM fiscal_document WHERE id % 20 < 2 GROUP BY party_id HAVING count(*) >= 3")
add("stm_08_recurring_from", "fiscal_document", lambda d: parties.recurring_from(d).select("id", "recurring"), "SELECT id, count(*) OVER (PARTITION BY party_id ORDER BY doc_date, id ROWS UNBOUNDED PRECEDING) >= 3 AS recurring FROM fiscal_document")
add("dml_14_flagged", "creditor", lambda c: parties.flagged(c, c.where("id % 19 = 0").select(F.col("id").alias("party_id"), F.lit("fraud").alias("reason")))[0].select("id", "flagged", "risk"), "SELECT id, flagged OR id % 19 = 0 AS flagged, CASE WHEN id % 19 = 0 THEN 80 ELSE 0 END AS risk FROM creditor")
add("dml_14_blacklisted", "creditor", lambda c: parties.flagged(c, c.where("id % 19 = 0").select(F.col("id").alias("party_id"), F.lit("fraud").alias("reason")))[1], "SELECT iban, 'fraud' AS reason FROM creditor WHERE id % 19 = 0 AND iban IS NOT NULL GROUP BY iban")
add("set_03_tags", "contact", lambda c: c.select("id", F.array_join(parties.tags_united(F.when(F.col("id") % 3 != 0, F.array(F.lit("a"), F.col("type"))), F.array(F.lit("b"), F.lit("COMPANY"))), ",").alias("tags")), "SELECT id, CASE WHEN id % 3 = 0 THEN 'b,COMPANY' ELSE concat('a,', type, ',b,COMPANY') END AS tags FROM contact")
add("set_04_known_ibans", "iban_change creditor", lambda h, c: parties.latest(h, "party_id", "created_at").select("party_id", F.col("new_iban").alias("iban")).unionByName(c.where("iban IS NOT NULL").select(F.col("id").alias("party_id"), "iban")).distinct(), "SELECT party_id, new_iban AS iban FROM (SELECT *, row_number() OVER (PARTITION BY party_id ORDER BY created_at DESC, id DESC) AS r FROM iban_change) WHERE r <= 25 UNION SELECT id, iban FROM creditor WHERE iban IS NOT NULL")

# VAT breakdowns -----------------------------------------------------------------------


def _breakdown(d: DataFrame, i: DataFrame) -> DataFrame:
    rows = "array<struct<rate:double,base:double,tax:double>>"
    docs = d.select("id", F.when(F.col("id") % 4 == 0, F.array(F.struct(F.lit(23.0).alias("rate"), F.col("total").alias("base"), F.lit(1.0).alias("tax")))).otherwise(F.array().cast(rows)).alias("explicit"), F.lit(23.0).alias("tax"), F.when(F.col("id") % 3 != 0, 100.0).otherwise(0.0).alias("net"))
    price = F.col("total") / F.col("quantity")
    lines = i.where("document_id % 4 < 2").select("document_id", F.col("tax_rate").cast("double").alias("rate"), "quantity", F.when(F.col("line") != 3, price).alias("price"), (F.col("discount") * 100).alias("discount"), F.when(F.col("line") == 1, F.col("total") * (1 + F.col("tax_rate").cast("double") / 100)).when(F.col("line") == 2, F.col("total")).when(F.col("line") == 3, F.col("total")).alias("line_total"), F.col("_metadata.row_index").alias("position"))
    return extraction.breakdown(docs, lines)


_BREAKDOWN = """SELECT id AS document_id, 23.0::DOUBLE AS rate, total AS base, 1.0::DOUBLE AS tax FROM fiscal_document WHERE id % 4 = 0
UNION ALL SELECT document_id, rate, round(sum(b), 2), round(sum(b * rate / 100), 2) FROM (SELECT document_id, CAST(tax_rate AS DOUBLE) AS rate, greatest(0, CASE line WHEN 3 THEN total / (1 + CAST(tax_rate AS DOUBLE) / 100) ELSE total END - discount * 100) AS b FROM document_item WHERE document_id % 4 = 1 AND document_id IN (SELECT id FROM fiscal_document)) GROUP BY 1, 2
UNION ALL SELECT id, 23.0, 100.0, 23.0 FROM fiscal_document WHERE id % 4 <> 0 AND id % 3 <> 0 AND (id % 4 <> 1 OR id NOT IN (SELECT document_id FROM document_item))"""
_ROUNDED = "SELECT document_id, rate, CAST(round(base) AS BIGINT) AS base, CAST(round(tax) AS BIGINT) AS tax FROM ({})"
add("agg_16_breakdown", "fiscal_document document_item", lambda d, i: _breakdown(d, i).select("document_id", "rate", F.round("base").cast("long").alias("base"), F.round("tax").cast("long").alias("tax")), _ROUNDED.format(_BREAKDOWN))
_VLINES = "SELECT document_id, CAST(tax_rate AS DOUBLE) + CASE WHEN line = 4 THEN 1 ELSE 0 END AS rate, total AS base, floor(total * CAST(tax_rate AS DOUBLE) + 0.5) / 100.0::DOUBLE + CASE WHEN line = 5 THEN 0.5 ELSE 0 END AS tax, line FROM document_item"
add("agg_17_checked_breakdown", "document_item fiscal_document", lambda i, d: extraction.checked_breakdown(i.select("document_id", (F.col("tax_rate").cast("double") + F.when(F.col("line") == 4, 1).otherwise(0)).alias("rate"), F.col("total").alias("base"), (F.floor(F.col("total") * F.col("tax_rate").cast("double") + 0.5) / 100 + F.when(F.col("line") == 5, 0.5).otherwise(0.0)).alias("tax")), d.select(F.col("id").alias("document_id"), F.when(F.col("id") % 2 == 0, 5.0).alias("total_tax"))), f"""SELECT document_id, {euro(f"sum({cents('base')})")} AS base, {euro(f"sum({cents('tax')})")} AS tax, {euro(f"sum({cents('base')}) + sum({cents('tax')})")} AS gross, count(*) FILTER (line IN (4, 5)) AS wrong_lines,
document_id % 2 = 0 AND abs(sum({cents('tax')}) / 100.0::DOUBLE - 5) > 0.02 + 1e-9 AND document_id IN (SELECT id FROM fiscal_document) AS wrong_total FROM ({_VLINES}) GROUP BY document_id""")

# Totals, anomalies --------------------------------------------------------------------

add("agg_05_journal_sums", "journal", boards.account_sums, f"SELECT account_id, {euro(f'sum({cents("debit")})')} AS debit, {euro(f'sum({cents("credit")})')} AS credit FROM journal GROUP BY account_id")
add("agg_06_expense_total", "expense", lambda e: boards.expense_total(e, YEAR), f"SELECT {euro(f'sum({cents("amount")})')} AS total FROM expense WHERE status <> 'REJECTED' AND year(date) = {YEAR}")


#: Documents with what their upload (events) and vector (embeddings) of the same number say.
_FILED = f"""SELECT o_orderkey AS id, o_custkey % 4 AS tenant_id, o_custkey AS party_id, concat('FT ', year(o_orderdate), '/', month(o_orderdate), '/', o_custkey) AS number, concat('h', o_orderkey) AS file_hash,
coalesce(floor(value + 0.5), o_totalprice) AS total, cast(o_orderdate AS date) AS doc_date, cast(500000000 + o_custkey AS varchar(20)) AS nif, concat('PT50', o_custkey + CASE WHEN floor(o_totalprice) % 9 = 0 THEN 1 ELSE 0 END) AS iban,
ts AS uploaded, user_id AS ip, embedding AS vector, label AS supplier FROM orders LEFT JOIN events ON event_id = o_orderkey LEFT JOIN embeddings ON vec_id = o_orderkey"""
_TAXED = "SELECT l_orderkey AS document_id, l_extendedprice AS base, l_tax AS rate, CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1 - l_discount) * l_tax ELSE l_extendedprice * l_tax END AS tax FROM lineitem"
_KNOWN = "SELECT c_custkey AS party_id, concat('PT50', c_custkey) AS iban FROM customer WHERE c_acctbal > 0"
_BURSTS = (4, 6 * 3600)


def _signals(spark, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "events", "embeddings", "lineitem", "customer")}
    filed, taxed, known = (spark.sql(_named(q, tables), **tables) for q in (_FILED, _TAXED, _KNOWN))
    filed = filed.withColumnRenamed("uploaded", "at")
    return anomalies.signals(filed, taxed, known, filed.select("id", "supplier", "vector"), TODAY, burst=_BURSTS, sigma=2.0, drift=0.95)


def _named(query: str, tables: dict[str, DataFrame]) -> str:
    """The query over frames instead of tables."""
    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables)})\b", r"\1 {\2}", query)


_SUM = "list_sum(list_transform(range(1, 9), lambda i: CAST(substr(nif, i, 1) AS INTEGER) * (10 - i))) % 11"
_STEP = f"list_transform(vector, lambda x: CAST(round(x::DOUBLE * 1048576) AS BIGINT))"
_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]))"
_RANGE = f"count(*) OVER (PARTITION BY ip ORDER BY epoch_us(uploaded) RANGE BETWEEN {_BURSTS[1] * 1000000} PRECEDING AND CURRENT ROW)"
_SIGNALS = f"""WITH filed AS ({_FILED}), taxed AS ({_TAXED}), known AS ({_KNOWN}), steps AS (SELECT id, supplier, {_STEP} AS v FROM filed WHERE supplier IS NOT NULL AND len(vector) > 0),
sums AS (SELECT supplier, list(s ORDER BY i) AS s, any_value(n) AS n FROM (SELECT supplier, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT supplier, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM steps) GROUP BY supplier, i) GROUP BY supplier),
rest AS (SELECT id, v, list_transform(range(1, len(s) + 1), lambda i: s[i] - v[i]) AS r FROM steps JOIN sums USING (supplier) WHERE n >= 3),
signals AS (
SELECT id, 'DUPLICATE_NUMBER' AS signal FROM filed WHERE (tenant_id, number) IN (SELECT (tenant_id, number) FROM filed GROUP BY tenant_id, number HAVING count(DISTINCT file_hash) > 1)
UNION ALL SELECT document_id, 'INCONSISTENT_TAX' FROM taxed GROUP BY document_id HAVING abs(sum({cents('tax')} - {cents('base * rate')})) > count(*)
UNION ALL SELECT id, 'IBAN_MISMATCH' FROM filed WHERE party_id IN (SELECT party_id FROM known) AND iban NOT IN (SELECT iban FROM known WHERE known.party_id = filed.party_id)
UNION ALL SELECT a.id, 'DUPLICATE_AMOUNT' FROM filed a WHERE EXISTS (SELECT 1 FROM filed b WHERE b.id <> a.id AND b.tenant_id = a.tenant_id AND b.party_id = a.party_id AND {cents('b.total')} = {cents('a.total')} AND abs(epoch_us(a.uploaded) - epoch_us(b.uploaded)) <= 86400000000)
UNION ALL SELECT id, 'MISSING_NIF' FROM filed WHERE CAST(right(nif, 1) AS INTEGER) <> CASE WHEN {_SUM} < 2 THEN 0 ELSE 11 - {_SUM} END
UNION ALL SELECT id, 'BURST_UPLOAD' FROM (SELECT id, {_RANGE} AS n FROM filed WHERE uploaded IS NOT NULL) WHERE n > {_BURSTS[0]}
UNION ALL SELECT id, 'SUSPICIOUS_TOTAL' FROM (SELECT *, count(*) OVER w AS n, sum({cents('total')}) OVER w AS s, sum(CAST({cents('total')} AS HUGEINT) * {cents('total')}) OVER w AS q FROM filed WINDOW w AS (PARTITION BY party_id ORDER BY doc_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE n >= 3 AND sqrt(greatest(q::DOUBLE / n - (s::DOUBLE / n) * (s::DOUBLE / n), 0)) > 0 AND {cents('total')} - s::DOUBLE / n > 2.0 * sqrt(greatest(q::DOUBLE / n - (s::DOUBLE / n) * (s::DOUBLE / n), 0))
UNION ALL SELECT id, 'DATE_ANOMALY' FROM filed WHERE doc_date > DATE '{TODAY}' + 30 OR doc_date < DATE '{TODAY}' - INTERVAL 2 YEAR
UNION ALL SELECT id, 'ROUND_AMOUNTS' FROM (SELECT id, count(*) OVER (PARTITION BY tenant_id, date_trunc('month', doc_date)) AS n FROM filed WHERE {cents('total')} % 100 = 0) WHERE n >= 2
UNION ALL SELECT id, 'STRUCTURE_DRIFT' FROM rest WHERE round(1 - {_DOT.format('v', 'r')} / sqrt({_DOT.format('v', 'v')} * {_DOT.format('r', 'r')}), 6) > 0.95)"""
_WEIGHED = f"""{_SIGNALS}, scored AS (SELECT f.id, coalesce(sum(CASE signal {' '.join(f"WHEN '{k}' THEN {v}" for k, v in ANOMALY_WEIGHTS.items())} END), 0) AS score, count(signal) = 0 AS clean FROM filed f LEFT JOIN (SELECT DISTINCT * FROM signals) s ON s.id = f.id GROUP BY f.id)"""
QUERIES["agg_22_signals"] = lambda spark, sf_dir: _signals(spark, sf_dir).select("id", F.array_join("signals", ",").alias("signals"))
ORACLES["agg_22_signals"] = f"{_SIGNALS} SELECT f.id, coalesce(string_agg(DISTINCT signal, ',' ORDER BY signal), '') AS signals FROM filed f LEFT JOIN signals s ON s.id = f.id GROUP BY f.id"
QUERIES["agg_22_anomalies"] = lambda spark, sf_dir: boards.anomalies(_signals(spark, sf_dir))
ORACLES["agg_22_anomalies"] = f"{_WEIGHED} SELECT id, CAST(score AS INTEGER) AS score, CASE WHEN score >= 50 THEN 'CRITICAL' WHEN score >= 30 THEN 'HIGH' WHEN score >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN score >= 50 THEN 'block' WHEN score >= 30 THEN 'review' WHEN score >= 15 THEN 'flag' ELSE 'ignore' END AS action, clean FROM scored"
QUERIES["agg_23_anomaly_summary"] = lambda spark, sf_dir: boards.anomaly_summary(boards.anomalies(_signals(spark, sf_dir)))
ORACLES["agg_23_anomaly_summary"] = f"{_WEIGHED} SELECT count(*) AS scanned, count(*) FILTER (clean) AS clean, count(*) FILTER (NOT clean) AS flagged FROM scored"
add("win_07_supplier_outliers", "fiscal_document", lambda d: boards.supplier_outliers(d, 2.0), f"""SELECT id, party_id, total FROM (SELECT *, count(*) OVER w AS n, sum({cents('total')}) OVER w AS s, sum(CAST({cents('total')} AS HUGEINT) * {cents('total')}) OVER w AS q FROM fiscal_document WINDOW w AS (PARTITION BY party_id ORDER BY doc_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE n >= 3 AND sqrt(greatest(q::DOUBLE / n - (s::DOUBLE / n) * (s::DOUBLE / n), 0)) > 0 AND {cents('total')} - s::DOUBLE / n > 2.0 * sqrt(greatest(q::DOUBLE / n - (s::DOUBLE / n) * (s::DOUBLE / n), 0))""")
add_raw("win_08_same_total", "events", lambda e: boards.same_total(e.select(F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("party_id"), F.round(F.col("value") / 20).alias("total"), F.col("ts").alias("at"))).select("id", "n"), "SELECT event_id AS id, count(*) OVER (PARTITION BY user_id % 40, round(value / 20) ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM events")

# Search -------------------------------------------------------------------------------

_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', {})), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"
add("fil_06_search_vector", "fiscal_document", lambda d: d.select("id", F.array_join(F.array_sort(retrieval.search_vector(F.col("doc_number"), F.col("counterparty"), F.col("type"))), " ").alias("vector")), f"SELECT id, array_to_string(list_sort({_WORDS.format('doc_number, counterparty, type')}), ' ') AS vector FROM fiscal_document")


def _searched(d: DataFrame, query: str) -> DataFrame:
    """Written once as an index, of which only the query's postings are read."""
    return fulltext.written(d, "doc_id", F.col("text")).search(query).withColumnRenamed("doc", "doc_id")


_ALTERNATIVES = '"of the" ing -and or licensed or "und die" -zu or "de la" que'
_TOGETHER = 'the and -"of the" on'
_PLACES = {w: f"list_filter(range(len(w)), lambda i: w[i + 1] = '{w}')" for w in ("of", "the", "ing", "and", "licensed", "und", "die", "zu", "de", "la", "que", "on")}
_TEXT_WORDS = f"SELECT doc_id, {', '.join(f'{e} AS {w}_' for w, e in _PLACES.items())} FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents)"


def _row_sql(a: str, b: str) -> str:
    return f"len(list_intersect({a}_, list_transform({b}_, lambda x: x - 1))) > 0"


def _series_sql(a: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, least(len({a}_), 256) + 1), lambda j: 1.0::DOUBLE / (j * j))), 0)"


def _near_sql(a: str, b: str) -> str:
    near = f"list_filter({b}_[1:256], lambda y: abs(x - y) <= 100 AND x <> y)"
    return f"coalesce(list_sum(flatten(list_transform({a}_[1:256], lambda x: list_transform({near}, lambda y: ln(1 - sqrt(0.01::DOUBLE / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(x - y) / 1.5::DOUBLE - 2)))))))), 0)"


_MANY = [w for w in _PLACES if w != "on"]
_FOUND = f"""SELECT doc_id, round(({' + '.join(map(_series_sql, _MANY))}) * (0.1::DOUBLE / 1.64493406685::DOUBLE / {len(_MANY)}), 6) AS rank FROM ({_TEXT_WORDS})
WHERE ({_row_sql('of', 'the')} AND len(ing_) > 0 AND len(and_) = 0) OR len(licensed_) > 0 OR ({_row_sql('und', 'die')} AND len(zu_) = 0) OR ({_row_sql('de', 'la')} AND len(que_) > 0)"""
_BOTH = [("the", "and"), ("the", "on"), ("and", "on"), ("of", "the"), ("of", "and"), ("of", "on")]
_FOUND_TOGETHER = f"SELECT doc_id, round(1 - exp({' + '.join(_near_sql(a, b) for a, b in _BOTH)}), 6) AS rank FROM ({_TEXT_WORDS}) WHERE len(the_) > 0 AND len(and_) > 0 AND len(on_) > 0 AND NOT {_row_sql('of', 'the')}"
add_raw("fil_05_full_text", "documents", lambda d: _searched(d, _ALTERNATIVES), _FOUND)
add_raw("fil_05_words_together", "documents", lambda d: _searched(d, _TOGETHER), _FOUND_TOGETHER)
add_raw("fil_06_postings", "documents", lambda d: fulltext.written(d, "doc_id", F.col("text")).all_postings().select(F.col("doc").alias("doc_id"), "word", F.size("at").alias("n"), F.element_at("at", 1).alias("first"), F.element_at("at", -1).alias("last")), """SELECT doc_id, word, CAST(count(*) AS INTEGER) AS n, CAST(min(i) AS INTEGER) AS first, CAST(max(i) AS INTEGER) AS last FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents)) GROUP BY doc_id, word""")
add_raw("srt_02_rank_page", "documents", lambda d: fulltext.page(_searched(d, _TOGETHER), 2, 50, "doc_id"), f"SELECT doc_id, rank FROM ({_FOUND_TOGETHER}) ORDER BY rank DESC, doc_id LIMIT 50 OFFSET 50")
_QUERY = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]


def _lists(e: DataFrame) -> list[DataFrame]:
    """Two rankings of vectors: by cosine to a query, and by their label."""
    a = retrieval.nearest(e, _QUERY, 60).select(F.col("vec_id").alias("key"), (F.row_number().over(_order("score")) - 1).cast("long").alias("rank"))
    b = e.orderBy(F.desc("label"), "vec_id").limit(60).select(F.col("vec_id").alias("key"), (F.row_number().over(_order("label", "vec_id")) - 1).cast("long").alias("rank"))
    return [a, b]


def _order(column: str, key: str = "vec_id"):
    from pyspark.sql import Window

    return Window.orderBy(F.desc(column), key)  # of a search's short list


_NEAR = f"SELECT vec_id AS key, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS rank FROM (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), [{', '.join(map(str, _QUERY))}]::DOUBLE[]), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 60)"
_LABEL = "SELECT vec_id AS key, row_number() OVER (ORDER BY label DESC, vec_id) - 1 AS rank FROM (SELECT vec_id, label FROM embeddings ORDER BY label DESC, vec_id LIMIT 60)"
add_raw("win_03_ranks", "embeddings", lambda e: _lists(e)[0], _NEAR)
add_raw("set_01_ranked_union", "embeddings", lambda e: retrieval.ranked(*_lists(e)), f"SELECT key, row_number() OVER (ORDER BY l, rank, key) - 1 AS rank FROM (SELECT *, 0 AS l FROM ({_NEAR}) UNION ALL SELECT *, 1 FROM ({_LABEL}))")
add_raw("srt_07_fused_top", "embeddings", lambda e: retrieval.fused_top(10, *_lists(e)), f"SELECT key, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS score, count(*) AS lists FROM (SELECT * FROM ({_NEAR}) UNION ALL SELECT * FROM ({_LABEL})) GROUP BY key ORDER BY score DESC, key LIMIT 10")
add_raw("snk_12_context", "embeddings", lambda e: retrieval.context(_lists(e)[0].select("rank", F.concat(F.lit("snippet "), F.col("key") % 40, F.lit(" "), F.repeat(F.lit("x"), 120)).alias("content")), 300).select("rank", "used"), f"""SELECT rank, CAST(used AS BIGINT) AS used FROM (SELECT rank, sum(length(content)) OVER (ORDER BY rank) AS used FROM (SELECT rank, content, row_number() OVER (PARTITION BY left(content, 100) ORDER BY rank) AS r FROM (SELECT rank, concat('snippet ', key % 40, ' ', repeat('x', 120)) AS content FROM ({_NEAR}))) WHERE r = 1) WHERE used <= 1200""")
_TEXTS = "concat('Total: 1.234,56 EUR, ', id, ',50 e 10,00', CASE WHEN id % 2 = 0 THEN ' e 3,05' ELSE '' END)"
add("agg_28_text_money", "fiscal_document", lambda d: retrieval.money_stats(d.select("id", F.concat(F.lit("Total: 1.234,56 EUR, "), "id", F.lit(",50 e 10,00"), F.when(F.col("id") % 2 == 0, " e 3,05").otherwise("")).alias("text")), "id"), """SELECT id, len(a) AS n, CAST(list_sum(a) AS DOUBLE) / 100 AS total, CAST(list_min(a) AS DOUBLE) / 100 AS least, CAST(list_max(a) AS DOUBLE) / 100 AS most, CAST(list_sort(a)[len(a) // 2 + 1] AS DOUBLE) / 100 AS median FROM (SELECT id, CASE WHEN id % 2 = 0 THEN [123456, id * 100 + 50, 1000, 305] ELSE [123456, id * 100 + 50, 1000] END AS a FROM fiscal_document)""")

# State changes ------------------------------------------------------------------------

add("dml_04_approved", "payable", states.scheduled, "SELECT id, CASE WHEN status IN ('PAID', 'CANCELLED') THEN 'conflict' WHEN approved THEN 'unchanged' ELSE 'approved' END AS outcome, CASE WHEN NOT approved AND status = 'TO_PAY' THEN 'SCHEDULED' ELSE status END AS status, approved OR status NOT IN ('PAID', 'CANCELLED') AS approved FROM payable")
add("dml_04_paid_with_reason", "payable", lambda p: states.paid(p, p.where("id % 5 = 0").select(F.col("id").alias("payable_id"), (F.col("amount") + F.when(F.col("id") % 10 == 0, 1.0).otherwise(0.0)).alias("amount"), F.when(F.col("id") % 20 == 0, "rounding").alias("reason")), TODAY), f"SELECT id, CASE WHEN NOT approved THEN 'rejected' WHEN id % 10 = 0 AND id % 20 <> 0 THEN 'difference' ELSE 'paid' END AS outcome, CASE WHEN approved AND (id % 10 <> 0 OR id % 20 = 0) THEN DATE '{TODAY}' END AS paid_at FROM payable WHERE id % 5 = 0")
add("dml_05_pay_event", "payable", lambda p: states.paid_events(p.select("id", "status"), p.where("id % 3 = 0").select("id"), TODAY), f"SELECT id, CASE WHEN id % 3 = 0 THEN 'PAID' ELSE status END AS status, CASE WHEN id % 3 = 0 AND status <> 'PAID' THEN DATE '{TODAY}' END AS paid_at FROM payable")
add("dml_06_removed", "fiscal_document", lambda d: states.removed(d.select("id", "status"), d.where("id % 6 = 0").select("id"), "status", "ARQUIVADO"), "SELECT id, CASE WHEN id % 6 = 0 THEN 'ARQUIVADO' ELSE status END AS status FROM fiscal_document")


def _periods(e: DataFrame) -> DataFrame:
    return e.select("period").distinct().select("period", F.when(F.col("period") % 3 == 0, "CLOSED").otherwise("DRAFT").alias("status"))


add("dml_07_regenerated", "employee", lambda e: states.regenerated(e.where("id % 2 = 0").select("period", "id", F.lit("old").alias("run")), _periods(e), e.where("id % 5 = 0").select("period", "id", F.lit("new").alias("run"))), "SELECT period, id, 'old' AS run FROM employee WHERE id % 2 = 0 AND period % 3 = 0 UNION ALL SELECT period, id, 'new' FROM employee WHERE id % 5 = 0 AND period % 3 <> 0")
add("dml_07_closed", "employee", lambda e: states.closed(_periods(e), e.where("period < 10").select("period")), "SELECT DISTINCT period, 'CLOSED' AS status, CASE WHEN period % 3 = 0 THEN 'conflict' ELSE 'closed' END AS outcome FROM employee WHERE period < 10")
add("dml_08_imputed", "expense", lambda e: states.imputed(e.select("id", (F.col("id") % 9).alias("vehicle_id"), "amount", "date")), "SELECT id, kind, CASE WHEN kind = 'maintenance' THEN id % 9 END AS vehicle_id, amount, date FROM expense, (VALUES ('expense'), ('maintenance')) v(kind)")
add("dml_11_single_default", "contact", lambda c: states.single_default(c.select("id", "tenant_id", (F.col("id") % 10 == 0).alias("is_default")), c.where("id IN (5, 9, 6)").select("id")).select("id", "is_default"), "SELECT id, CASE tenant_id WHEN 1 THEN id = 5 WHEN 2 THEN id = 6 ELSE id % 10 = 0 END AS is_default FROM contact")


def _moved(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = d.select("id", "stage", F.lit(50).alias("probability"), F.lit(None).cast("timestamp").alias("won_at"), F.lit(_NOW).alias("lost_at"))
    moves = d.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "WON").otherwise("PROPOSAL").alias("to"), F.when(F.col("id") % 5 == 0, (F.col("id") % 200).cast("int")).alias("probability"))
    return states.moved_stages(rows, moves, dict(boards.STAGES), _NOW)


_MOVE = "(SELECT id, stage, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'WON' ELSE 'PROPOSAL' END END AS t FROM deal)"
add("dml_16_moved_stages", "deal", lambda d: _moved(d)[0].select("id", "stage", "probability", F.col("won_at").isNotNull().alias("won"), F.col("lost_at").isNotNull().alias("lost")), f"SELECT id, coalesce(t, stage) AS stage, CAST(CASE WHEN t IS NOT NULL AND id % 5 = 0 THEN least(id % 200, 100) WHEN t IS NULL OR t = stage THEN 50 WHEN t = 'WON' THEN 100 ELSE 60 END AS INTEGER) AS probability, t IS NOT NULL AND t <> stage AND t = 'WON' AS won, t IS NULL OR t = stage AS lost FROM {_MOVE}")
add("dml_16_stage_notes", "deal", lambda d: _moved(d)[1], f"SELECT id AS deal_id, 'NOTE' AS type, concat('Stage change: ', stage, ' → ', t) AS subject FROM {_MOVE} WHERE t IS NOT NULL AND t <> stage")
add("dml_17_completed", "activity", lambda a: states.completed(a, a.where("id % 3 = 0").select("id").unionByName(a.where("id % 6 = 0").select("id")).unionByName(a.where("id < 50").select((-F.col("id") - 1).alias("id")))), "SELECT (SELECT count(*) FROM activity WHERE id % 3 = 0) + (SELECT count(*) FROM activity WHERE id < 50) AS requested, (SELECT count(*) FROM activity WHERE id % 3 = 0 AND completed_at IS NULL) AS completed, (SELECT count(*) FROM activity WHERE id % 3 = 0 AND completed_at IS NOT NULL) + (SELECT count(*) FROM activity WHERE id < 50) AS missing")
add("dml_18_import_outcomes", "contact", lambda c: states.outcomes(parties.imported(c.select("id", "tenant_id", F.when(F.col("id") % 9 != 0, F.col("name")).alias("name"), F.lit(None).cast("string").alias("nif"), F.lower("email").alias("email")), c.where("id % 2 = 1"))), "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN c.id % 9 = 0 THEN 'failed' WHEN b.e IS NULL THEN 'created' ELSE 'skipped' END AS outcome FROM contact c LEFT JOIN (SELECT DISTINCT tenant_id, lower(email) AS e FROM contact WHERE active AND id % 2 = 1) b ON b.tenant_id = c.tenant_id AND b.e = lower(c.email)) GROUP BY outcome")


def _versions(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    before = d.select("id", "type", F.lit("Loja").alias("supplier"), "party_id", F.lit("Outras").alias("category"), F.lit("PT").alias("country"), F.lit(False).alias("recurring"), F.col("doc_date").alias("date"))
    after = before.withColumns({"category": F.when(F.col("id") % 5 == 0, "Rendas").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("category")), "date": F.date_add("date", 0)})
    return before, after


add("dml_19_refiled", "fiscal_document", lambda d: filing.refiled(*_versions(d)), "SELECT id, concat('/Despesas/rendas', strftime(doc_date, '/%Y/%m')) AS folder FROM fiscal_document WHERE id % 5 = 0")


def _edits(i: DataFrame) -> DataFrame:
    columns = ["document_id", "line", "quantity", "total", "tax_rate"]
    rows = i.select(*columns)
    added = rows.where("line = 1 AND document_id % 3 = 0").withColumns({"line": F.lit(99), "action": F.lit("add")})
    changed = rows.where("line = 2").withColumns({"total": F.col("total") + 1, "action": F.lit("update")})
    gone = rows.where("line = 3").withColumn("action", F.lit("remove"))
    return states.edited_items(rows, added.unionByName(changed).unionByName(gone))


add("dml_20_edited_items", "document_item", lambda i: _edits(i).select("document_id", "line", "total"), "SELECT document_id, line, CASE WHEN line = 2 THEN total + 1 ELSE total END AS total FROM document_item WHERE line <> 3 UNION ALL SELECT document_id, 99, total FROM document_item WHERE line = 1 AND document_id % 3 = 0")
add("dml_10_folders", "fiscal_document", lambda d: filing.folders(d.select(F.concat(F.lit("Arquivo/"), "type", F.lit("/"), F.col("party_id") % 9, F.date_format("doc_date", "/yyyy/MM")).alias("folder"))), "SELECT DISTINCT path, parent, CAST(depth AS INTEGER) AS depth FROM (SELECT 'Arquivo' AS path, NULL AS parent, 1 AS depth FROM fiscal_document UNION ALL SELECT concat('Arquivo/', type), 'Arquivo', 2 FROM fiscal_document UNION ALL SELECT concat('Arquivo/', type, '/', party_id % 9), concat('Arquivo/', type), 3 FROM fiscal_document)")
