"""Queries of lists, pages and lookups, with their DuckDB twins."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contaflux.functions import text
from contaflux.operators import lists, parties
from contaflux.plans.base import TODAY, add, euro
from contaflux.plans.base import cents as sql_cents

_FIRST, _LAST = datetime.date(1996, 1, 1), datetime.date(1996, 6, 30)
_NOW = datetime.datetime(2024, 1, 15)
_IN = f"BETWEEN DATE '{_FIRST}' AND DATE '{_LAST}'"


add("fil_01_tenant", "contact", lambda c: lists.of_tenant(c, 1).select("id", "tenant_id"), "SELECT id, tenant_id FROM contact WHERE tenant_id = 1")
add("fil_03_tenant_on_write", "contact", lambda c: lists.for_tenant(c.where("tenant_id = 2").withColumn("tenant_id", F.when(F.col("id") % 3 != 0, F.col("tenant_id"))), 2).select("id", "tenant_id"), "SELECT id, CAST(2 AS BIGINT) AS tenant_id FROM contact WHERE tenant_id = 2")
add("fil_04_documents", "fiscal_document", lambda d: lists.documents(lists.of_tenant(d, 1), kind="RECIBO", first=datetime.date(1995, 1, 1), last=datetime.date(1996, 12, 31)).select("id", "total"), "SELECT id, total FROM fiscal_document WHERE tenant_id = 1 AND status <> 'ARQUIVADO' AND type = 'RECIBO' AND doc_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
add("fil_04_document_search", "fiscal_document", lambda d: lists.documents(d, status="ARQUIVADO", text="fornecedor 1").select("id"), "SELECT id FROM fiscal_document WHERE status = 'ARQUIVADO' AND (contains(lower(doc_number), 'fornecedor 1') OR contains(lower(counterparty), 'fornecedor 1') OR contains(lower(file_hash), 'fornecedor 1'))")
add("fil_08_bank", "bank_transaction", lambda t: lists.movements(t, text="TRF").where("amount > 0").select("id", "amount"), "SELECT id, amount FROM bank_transaction WHERE description ILIKE '%trf%' AND amount > 0")
add("fil_08_bank_days", "bank_transaction", lambda t: lists.movements(lists.of_tenant(t, 3), first=_FIRST, last=_LAST, text="ft 1996").select("id"), f"SELECT id FROM bank_transaction WHERE tenant_id = 3 AND date {_IN} AND (contains(lower(description), 'ft 1996') OR contains(lower(coalesce(reference, '')), 'ft 1996'))")
add("fil_09_payables", "payable", lambda p: lists.payables(p, TODAY, approved_only=True, overdue_only=True, status="PAID").select("id", "amount"), f"SELECT id, amount FROM payable WHERE approved AND status IN ('TO_PAY', 'OVERDUE') AND due_date < DATE '{TODAY}'")
add("fil_09_payables_due", "payable", lambda p: lists.payables(p, TODAY, status="SCHEDULED", first=_FIRST, last=_LAST).select("id"), f"SELECT id FROM payable WHERE status = 'SCHEDULED' AND due_date {_IN}")
add("fil_10_schedules", "schedule", lambda s: lists.between(lists.narrowed(s, status="PENDING"), "due_date", _FIRST, _LAST).select("id"), f"SELECT id FROM schedule WHERE status = 'PENDING' AND due_date {_IN}")
add("fil_11_parties", "contact", lambda c: lists.searched(lists.narrowed(c, active=True), "PORTO", ["name", "email", "city"], ["nif"]).select("id"), "SELECT id FROM contact WHERE active AND (contains(lower(name), 'porto') OR contains(lower(email), 'porto') OR contains(lower(coalesce(city, '')), 'porto') OR contains(nif, 'PORTO'))")
add("fil_12_accounts", "account", lambda a: lists.searched(lists.narrowed(a, active=True), "62", ["name"], ["code"]).select("id", "code"), "SELECT id, code FROM account WHERE active AND (contains(lower(name), '62') OR contains(code, '62'))")
add("fil_13_contacts", "contact", lambda c: lists.searched(lists.narrowed(c, type=["COMPANY", "LEAD"], active=True), "mail12", ["name", "email"], ["nif"]).select("id"), "SELECT id FROM contact WHERE type IN ('COMPANY', 'LEAD') AND active AND (contains(lower(name), 'mail12') OR contains(lower(email), 'mail12') OR contains(nif, 'mail12'))")
add("fil_14_deals", "deal", lambda d: lists.narrowed(d, stage="PROPOSAL", contact_id=None).where("contact_id % 2 = 0").select("id", "value"), "SELECT id, value FROM deal WHERE stage = 'PROPOSAL' AND contact_id % 2 = 0")
add("fil_15_activities", "activity", lambda a: lists.narrowed(a, assignee=3).where("completed_at IS NULL").select("id", "type"), "SELECT id, type FROM activity WHERE assignee = 3 AND completed_at IS NULL")
_PENDING = f"SELECT id, due < TIMESTAMP '{_NOW}' AS overdue, CAST(ceil((epoch_us(due) - epoch_us(TIMESTAMP '{_NOW}')) / 8.64e10) AS BIGINT) AS days FROM activity WHERE completed_at IS NULL AND "
add("fil_16_pending", "activity", lambda a: lists.pending_activities(a, _NOW).select("id", "overdue", "days"), _PENDING + "due IS NOT NULL ORDER BY due, id LIMIT 500")
add("fil_16_overdue", "activity", lambda a: lists.pending_activities(a, _NOW, only_overdue=True).select("id", "overdue", "days"), _PENDING + f"due < TIMESTAMP '{_NOW}' ORDER BY due, id LIMIT 500")
add("fil_17_suggestions", "suggestion", lambda s: lists.narrowed(s, status="PENDING", match_type="WEAK").select("id", "score"), "SELECT id, score FROM suggestion WHERE status = 'PENDING' AND match_type = 'WEAK'")
add("fil_18_sync_history", "activity", lambda a: lists.sync_history(a, "hubspot", 2, 100).select("id"), "SELECT id FROM (SELECT * FROM activity ORDER BY created_at DESC, id LIMIT 100 OFFSET 100) WHERE id % 3 = 0")
add("fil_21_calendar", "schedule", lambda s: lists.calendar_events(s, _FIRST, _LAST, datetime.date(1996, 3, 1)).select("id", "days", "status"), f"SELECT id, CAST(date_diff('day', DATE '1996-03-01', due_date) AS INTEGER) AS days, CASE WHEN status = 'PENDING' AND due_date < DATE '1996-03-01' THEN 'OVERDUE' ELSE status END AS status FROM schedule WHERE due_date {_IN}")
add("fil_22_schedule_window", "schedule", lambda s: lists.schedule_window(s, _FIRST, _LAST).select("id"), f"SELECT id FROM schedule WHERE due_date {_IN} OR (recurrence IS NOT NULL AND due_date <= DATE '{_LAST}')")
add("fil_23_uploads", "fiscal_document", lambda d: d.where(lists.valid_upload(F.when(F.col("id") % 3 == 0, ".PDF").when(F.col("id") % 3 == 1, ".exe").otherwise(".png"), F.when(F.col("id") % 2 == 0, "application/pdf").otherwise("text/plain"), F.col("id") * 2000)).select("id"), "SELECT id FROM fiscal_document WHERE id % 3 <> 1 AND id % 2 = 0 AND id * 2000 BETWEEN 1 AND 20971520")
add("fil_26_iban_history", "iban_change", lambda h: lists.page(lists.narrowed(h, party_id=[1, 2, 4, 5]), [F.desc("created_at"), F.asc("id")], 1, 20).select("id", "party_id"), "SELECT id, party_id FROM iban_change WHERE party_id IN (1, 2, 4, 5) ORDER BY created_at DESC, id LIMIT 20")
add("fil_27_latest", "document_item", lambda i: lists.page(i, [F.desc("total"), F.asc("document_id"), F.asc("line")], 1, 100).select("document_id", "line", "total"), "SELECT document_id, line, total FROM document_item ORDER BY total DESC, document_id, line LIMIT 100")
add("fil_28_employees", "employee", lambda e: lists.page(e, [F.asc("name"), F.asc("id")], 2, 50).select("id", "name"), "SELECT id, name FROM employee ORDER BY name, id LIMIT 50 OFFSET 50")
add("fil_30_accounts", "account", lambda a: lists.page(lists.narrowed(a, active=True), [F.asc("code"), F.asc("id")], 1, 1000, 500).select("id", "code"), "SELECT id, code FROM account WHERE active ORDER BY code, id LIMIT 500")
add("agg_26_page_count", "bank_transaction", lambda t: lists.page_count(lists.movements(t, text="mov"), 50), "SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM bank_transaction WHERE contains(lower(description), 'mov') OR contains(lower(coalesce(reference, '')), 'mov')")
add("agg_27_count", "fiscal_document", lambda d: lists.documents(d, text="ft 1996/1").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM fiscal_document WHERE status <> 'ARQUIVADO' AND contains(lower(doc_number), 'ft 1996/1')")
add("agg_31_payable_kpis", "payable", lists.kpis, f"""SELECT {euro(f"sum(CASE WHEN status IN ('TO_PAY', 'OVERDUE') THEN {sql_cents('amount')} ELSE 0 END)")} AS to_pay, {euro(f"sum(CASE WHEN status = 'OVERDUE' THEN {sql_cents('amount')} ELSE 0 END)")} AS overdue, {euro(f"sum(CASE WHEN approved THEN {sql_cents('amount')} ELSE 0 END)")} AS approved FROM payable""")
add("join_06_payables_with", "payable party fiscal_document", lambda y, p, d: lists.with_parent(lists.with_parent(y, p, "party_id", ["name"], "party"), d.where("id % 2 = 0"), "document_id", ["doc_number"], "document").select("id", F.col("party.name").alias("party"), F.col("document.doc_number").alias("document")), "SELECT y.id, p.name AS party, CASE WHEN y.document_id % 2 = 0 THEN d.doc_number END AS document FROM payable y LEFT JOIN party p ON p.id = y.party_id LEFT JOIN fiscal_document d ON d.id = y.document_id")
add("join_07_two_accounts", "document_item account", lambda i, a: lists.with_parent(lists.with_parent(i.withColumn("other_id", F.col("account_id") + 1), a.where("active"), "account_id", ["code"], "first"), a, "other_id", ["code"], "second").select("document_id", "line", F.col("first.code").alias("first"), F.col("second.code").alias("second")), "SELECT i.document_id, i.line, a.code AS first, b.code AS second FROM document_item i LEFT JOIN account a ON a.id = i.account_id AND a.active LEFT JOIN account b ON b.id = i.account_id + 1")
add("join_08_by_rank", "suggestion fiscal_document", lambda s, d: lists.by_rank(s.select("id", F.col("score").alias("rank")), d, 3, 40).select("id", "doc_number", "rank"), "SELECT id, doc_number, rank FROM (SELECT id, score AS rank FROM suggestion ORDER BY score DESC, id LIMIT 40 OFFSET 80) JOIN fiscal_document USING (id)")
add("join_09_document_with", "fiscal_document party", lambda d, p: lists.with_parent(d, p.where("id % 3 = 0"), "party_id", ["name", "type"], "party").select("id", "party.name", "party.type"), "SELECT d.id, p.name, p.type FROM fiscal_document d LEFT JOIN party p ON p.id = d.party_id AND p.id % 3 = 0")
add("join_11_latest_nested", "contact deal", lambda c, d: lists.with_latest(c, d, "contact_id", [F.desc("value")], ["value"], "deals").select("id", F.size("deals").alias("n"), F.array_join(F.transform("deals", lambda x: x["id"].cast("string")), ",").alias("deals")), "SELECT c.id, CAST(count(d.id) AS INTEGER) AS n, coalesce(string_agg(CAST(d.id AS VARCHAR), ',' ORDER BY d.r), '') AS deals FROM contact c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY value DESC, id) AS r FROM deal) WHERE r <= 20) d ON d.contact_id = c.id GROUP BY c.id")
add("join_13_period_counts", "employee", lambda e: lists.with_count(e.select(F.col("period").alias("id")).distinct(), e.where("id % 50 = 0"), "period", "items"), "SELECT period AS id, count(CASE WHEN id % 50 = 0 THEN 1 END) AS items FROM employee GROUP BY period")
add("join_19_tree", "contact", lambda c: lists.with_children(c.select("id", "parent_id"), "parent_id").select("id", "parent_id", F.size("children").alias("n"), F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children")), "SELECT c.id, c.parent_id, CAST(count(k.id) AS INTEGER) AS n, coalesce(string_agg(CAST(k.id AS VARCHAR), ',' ORDER BY k.id), '') AS children FROM contact c LEFT JOIN contact k ON k.parent_id = c.id GROUP BY c.id, c.parent_id")
add("srt_03_nulls_last", "activity", lambda a: lists.page_nulls_last(a, "due", ["created_at", "id"], 9000, 200).select("id"), "SELECT id FROM activity ORDER BY due ASC NULLS LAST, created_at, id LIMIT 200 OFFSET 9000")
add("srt_04_by_score", "suggestion", lambda s: lists.page(s, [F.desc("score"), F.desc("created_at"), F.asc("id")], 2, 100).select("id", "score"), "SELECT id, score FROM suggestion ORDER BY score DESC, created_at DESC, id LIMIT 100 OFFSET 100")
add("srt_08_recent", "fiscal_document", lambda d: lists.recent(d, 25).select("id", "rank", "score"), "SELECT id, CAST(r - 1 AS INTEGER) AS rank, round(1.0::DOUBLE / (r + 60), 9) AS score FROM (SELECT id, row_number() OVER (ORDER BY doc_date DESC, id DESC) AS r FROM fiscal_document) WHERE r <= 25")
add("srt_09_calendar", "schedule", lambda s: lists.page(lists.schedule_window(s, _FIRST, _LAST), [F.asc("due_date"), F.asc("id")], 1, 200).select("id", "due_date"), f"SELECT id, due_date FROM schedule WHERE due_date {_IN} OR (recurrence IS NOT NULL AND due_date <= DATE '{_LAST}') ORDER BY due_date, id LIMIT 200")
add("srt_10_newest", "bank_transaction", lambda t: lists.page(t, [F.desc("date"), F.asc("id")], 1, 1000, 1000).select("id"), "SELECT id FROM bank_transaction ORDER BY date DESC, id LIMIT 1000")
add("srt_11_preview", "bank_transaction", lambda t: lists.page(t, [F.asc("id")], 1, 20).select("id", "amount"), "SELECT id, amount FROM bank_transaction ORDER BY id LIMIT 20")
add("prj_01_document_view", "fiscal_document", lambda d: lists.document_view(d.withColumn("total", F.col("total").cast("decimal(12,2)"))).select("id", "total", "type"), "SELECT id, CAST(CAST(total AS DECIMAL(12,2)) AS DOUBLE) AS total, type FROM fiscal_document")
add("prj_03_suggestion_view", "suggestion bank_transaction", lambda s, t: lists.suggestion_view(s, t.where("id % 2 = 0")).select("id", "status", "movement.amount", "movement.description", "movement.date"), "SELECT s.id, s.status, coalesce(t.amount, 0) AS amount, coalesce(t.description, '') AS description, t.date FROM suggestion s LEFT JOIN bank_transaction t ON t.id = s.tx_id AND t.id % 2 = 0")
_PT = "replace(replace(replace(CASE WHEN {0} < 10000 THEN printf('%.2f', {0}) ELSE format('{{:,.2f}}', {0}) END, ',', ';'), '.', ','), ';', '.')"
add("prj_04_document_snippet", "fiscal_document", lambda d: d.select("id", lists.document_snippet(F.col("file_hash"), F.col("doc_number"), F.col("doc_date"), F.col("total"), F.col("type"), F.col("status"), supplier=F.col("counterparty")).alias("snippet")),
    f"SELECT id, concat('Documento: ', file_hash, CASE WHEN counterparty IS NULL THEN '' ELSE concat(chr(10), 'Fornecedor: ', counterparty) END, chr(10), 'Numero: ', doc_number, chr(10), 'Data: ', strftime(doc_date, '%Y-%m-%d'), chr(10), 'Total: ', {_PT.format('total')}, ' EUR', chr(10), 'Tipo: ', type, chr(10), 'Estado: ', status) AS snippet FROM fiscal_document")
add("prj_05_payable_snippet", "payable", lambda p: p.select("id", lists.payable_snippet(F.when(F.col("id") % 2 == 0, F.lit("Renda")), F.col("amount"), F.col("due_date"), F.col("status")).alias("snippet")),
    f"SELECT id, concat('PayableItem:', CASE WHEN id % 2 = 0 THEN concat(chr(10), 'Descricao: Renda') ELSE '' END, chr(10), 'Valor: ', {_PT.format('amount')}, ' EUR', chr(10), 'Vencimento: ', strftime(due_date, '%Y-%m-%d'), chr(10), 'Estado: ', status) AS snippet FROM payable")
add("prj_06_embedding_text", "fiscal_document", lambda d: d.select("id", lists.embedding_text(F.col("file_hash"), F.col("counterparty"), F.col("doc_number"), F.col("doc_date"), F.col("total"), F.col("type"), F.when(F.col("id") % 2 == 0, F.lit('{"supplierNif":"500000000","atcud":7}'))).alias("text")),
    "SELECT id, concat_ws(chr(10), file_hash, 'Fornecedor: ' || counterparty, 'Documento: ' || doc_number, strftime(doc_date, 'Data: %Y-%m-%d'), printf('Total: %.2f EUR', total), 'Tipo: ' || type, CASE WHEN id % 2 = 0 THEN concat('NIF: 500000000', chr(10), 'ATCUD: 7') END) AS text FROM fiscal_document")
add("prj_07_snapshot_snippet", "fiscal_document", lambda d: d.select("id", lists.document_snippet(F.col("file_hash"), F.col("doc_number"), F.col("doc_date"), F.floor("total").cast("string"), F.col("type"), F.col("status"), formatted=False).alias("snippet")), "SELECT id, concat('Documento: ', file_hash, chr(10), 'Numero: ', doc_number, chr(10), 'Data: ', strftime(doc_date, '%Y-%m-%d'), chr(10), 'Total: ', CAST(floor(total) AS BIGINT), ' EUR', chr(10), 'Tipo: ', type, chr(10), 'Estado: ', status) AS snippet FROM fiscal_document")


def _raw(c: DataFrame) -> DataFrame:
    return c.select("id", F.create_map(F.lit("full"), F.col("name"), F.lit("kind"), F.col("type"), F.lit("mail"), F.when(F.col("id") % 4 == 0, "").otherwise(F.col("email")), F.lit("land"), F.when(F.col("id") % 5 == 0, "ES")).alias("raw"))


add("prj_08_mapped", "contact", lambda c: lists.projected(_raw(c), {"full": "name", "kind": "type", "mail": "email", "land": "country"}, {"PERSON": "INDIVIDUAL"}).select("id", "name", "type", "email", "country"), "SELECT id, name, CASE WHEN type = 'PERSON' THEN 'INDIVIDUAL' ELSE 'COMPANY' END AS type, CASE WHEN id % 4 <> 0 THEN email END AS email, CASE WHEN id % 5 = 0 THEN 'ES' ELSE 'Portugal' END AS country FROM contact")
add("prj_09_unwrapped", "contact", lambda c: c.select("id", lists.unwrapped(F.when(F.col("id") % 5 == 0, F.array().cast("array<struct<value:string,primary:boolean>>")).otherwise(F.array(F.struct(F.col("name").alias("value"), F.lit(False).alias("primary")), F.struct(F.col("email").alias("value"), (F.col("id") % 2 == 0).alias("primary"))))).alias("value")), "SELECT id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 2 = 0 THEN email ELSE name END AS value FROM contact")


def _itemised(d: DataFrame, i: DataFrame) -> DataFrame:
    told = d.withColumn("metadata", F.concat(F.lit('{"extraction":{"lineItems":[{"description":"a","lineTotal":"'), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise("none"), F.lit('"},{"description":"b","lineTotal":"1.5"}]}}')))
    return lists.items_of(told, i.where("document_id % 4 = 0").withColumn("description", F.lit("stored"))).select("document_id", "line", "description", "total")


add("prj_10_items", "fiscal_document document_item", _itemised, "SELECT document_id, line, 'stored' AS description, total FROM document_item WHERE document_id % 4 = 0 UNION ALL SELECT id, k, CASE k WHEN 1 THEN 'a' ELSE 'b' END, CASE WHEN k = 2 THEN 1.5 WHEN id % 2 = 0 THEN CAST(id AS DOUBLE) END FROM fiscal_document, (VALUES (1), (2)) v(k) WHERE id NOT IN (SELECT document_id FROM document_item WHERE document_id % 4 = 0)")
add("win_05_iban_changed", "iban_change", lambda h: parties.changed_since(h).select("id", "changed"), "SELECT id, coalesce(new_iban <> lag(new_iban) OVER (PARTITION BY party_id ORDER BY created_at, id), false) AS changed FROM iban_change")
add("win_06_latest", "iban_change", lambda h: parties.latest(h, "party_id", "created_at").select("party_id", "r", "id"), "SELECT party_id, CAST(r AS INTEGER) AS r, id FROM (SELECT *, row_number() OVER (PARTITION BY party_id ORDER BY created_at DESC, id DESC) AS r FROM iban_change) WHERE r <= 25")
add("str_26_lookup", "fiscal_document", lambda d: d.where(F.contains("doc_number", text.asked_number(F.lit("mostra a ft: 1996/1 por favor")))).select("id", "doc_number"), "SELECT id, doc_number FROM fiscal_document WHERE contains(doc_number, 'FT 1996/1')")
