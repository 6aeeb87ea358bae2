"""Queries of the library's own operators, by name, with their DuckDB twins."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contaflux.functions import dates, fiscal, money, text, vectors
from contaflux.operators import lists as listed
from contaflux.operators import boards, extraction, filing, parties, reconcile, retrieval, states, tax
from contaflux.plans import exchange as exchange_queries  # noqa: F401  registers its queries
from contaflux.plans import fields as field_queries  # noqa: F401
from contaflux.plans import flows as flow_queries  # noqa: F401
from contaflux.plans import lists as list_queries  # noqa: F401
from contaflux.plans import streams as stream_queries  # noqa: F401
from contaflux.plans.base import ORACLES, QUERIES, TODAY, YEAR, add, add_raw, cents, euro, round2
from contaflux.plans.domain import with_views
from contaflux.sources import sepa
from contaflux.streaming import events as streams

# Value added tax and income tax -------------------------------------------------------

_GROSS_TAX = cents(round2("gross * rate / (rate + 100)"))
_LINES = f"""SELECT rate, type IN ('FATURA_EMITIDA', 'NOTA_CREDITO', 'NOTA_DEBITO') AS output, sign * ({cents("gross")} - {_GROSS_TAX}) AS base, sign * {_GROSS_TAX} AS tax
FROM (SELECT d.type, coalesce(i.total, d.total) AS gross, CAST(coalesce(i.tax_rate, 0.0) AS DOUBLE) AS rate, CASE WHEN d.type = 'NOTA_CREDITO' THEN -1 ELSE 1 END AS sign
FROM fiscal_document d LEFT JOIN document_item i ON i.document_id = d.id)"""
add("agg_01_vat_by_rate", "fiscal_document document_item", tax.vat_by_rate,
    f"""SELECT rate, {euro("sum(CASE WHEN output THEN base ELSE 0 END)")} AS output_base, {euro("sum(CASE WHEN output THEN tax ELSE 0 END)")} AS output_tax,
    {euro("sum(CASE WHEN NOT output THEN base ELSE 0 END)")} AS input_base, {euro("sum(CASE WHEN NOT output THEN tax ELSE 0 END)")} AS input_tax, count(*) AS document_count,
    CASE WHEN abs(rate) <= .05 THEN 'exempt' WHEN abs(rate - 6) <= .05 THEN 'reduced' WHEN abs(rate - 13) <= .05 THEN 'intermediate' WHEN abs(rate - 23) <= .05 THEN 'normal' ELSE 'other' END AS kind
    FROM ({_LINES}) GROUP BY rate""")  # fmt: skip
_OUT, _IN = "sum(CASE WHEN output THEN tax ELSE 0 END)", "sum(CASE WHEN NOT output THEN tax ELSE 0 END)"
add("agg_03_vat_totals", "fiscal_document document_item", tax.vat_totals, f"SELECT {euro(_OUT)} AS output_tax, {euro(_IN)} AS input_tax, {euro(f'{_OUT} - {_IN}')} AS payable, {euro('sum(base)')} AS base FROM ({_LINES})")
_ACCOUNTS = f"""SELECT account_id, code, name, {euro("d")} AS debit, {euro("c")} AS credit, {euro("d - c")} AS net FROM
(SELECT account_id, sum({cents("debit")}) AS d, sum({cents("credit")}) AS c FROM journal WHERE date >= DATE '{YEAR}-01-01' AND date < DATE '{YEAR + 1}-01-01' GROUP BY account_id)
JOIN account ON account.id = account_id WHERE active AND code LIKE '6%'"""
add("agg_04_expense_accounts", "journal account", lambda j, a: tax.expense_accounts(j, a, YEAR), _ACCOUNTS)
add("agg_04_income_tax", "journal account", lambda j, a: tax.income_tax(j, a, YEAR),
    f"""SELECT {euro("p")} AS total, floor(p * 21 / 100 + 0.5) / 100.0::DOUBLE AS income_tax, floor(p * 10 / 100 + 0.5) / 100.0::DOUBLE AS autonomous_tax
    FROM (SELECT CAST(sum(greatest({cents("net")}, 0)) AS BIGINT) AS p FROM ({_ACCOUNTS}))""")  # fmt: skip
add("srt_06_top_accounts", "journal account", lambda j, a: tax.top_accounts(j, a, YEAR), f"SELECT * FROM ({_ACCOUNTS}) WHERE debit > 0 ORDER BY debit DESC, account_id LIMIT 10")
add("agg_14_document_totals", "document_item", tax.document_totals,
    f"""SELECT document_id, {euro("n")} AS net, {euro("t")} AS tax, {euro("n + t")} AS total FROM
    (SELECT document_id, sum({cents("total")}) AS n, sum({cents("total * CAST(tax_rate AS DOUBLE) / 100")}) AS t FROM document_item GROUP BY document_id)""")  # fmt: skip

# Boards and key figures ---------------------------------------------------------------

_STAGES = ", ".join(f"({i}, '{s}', {p})" for i, (s, p) in enumerate(boards.STAGES))
add("agg_07_pipeline_stats", "deal", boards.pipeline_stats,
    f"""SELECT CAST(place AS INTEGER) AS place, s.stage, coalesce(n, 0) AS deals, {euro("coalesce(c, 0)")} AS total, floor(CAST(coalesce(c, 0) AS DOUBLE) * probability / 100 + 0.5) / 100.0::DOUBLE AS weighted
    FROM (VALUES {_STAGES}) s(place, stage, probability) LEFT JOIN (SELECT stage, count(*) AS n, sum({cents("value")}) AS c FROM deal GROUP BY stage) d ON d.stage = s.stage""")  # fmt: skip
add("agg_08_deal_board", "deal", boards.board_tops, "SELECT stage, CAST(r AS INTEGER) AS rank, id, value FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY value DESC, id) AS r FROM deal WHERE stage <> 'LOST') WHERE r <= 3")
_START = datetime.date(1996, 1, 1)
_MONTHS = ", ".join(f"('1996-0{m}')" for m in range(1, 7))
_PROBABILITY = "CASE stage " + " ".join(f"WHEN '{s}' THEN {p}" for s, p in boards.STAGES) + " END"
add("agg_09_forecast", "deal", lambda d: boards.forecast(d, _START),
    f"""SELECT m.month, coalesce(n, 0) AS deals, {euro("coalesce(c, 0)")} AS total, {euro("coalesce(w, 0)")} AS weighted FROM (VALUES {_MONTHS}) m(month) LEFT JOIN
    (SELECT strftime(expected, '%Y-%m') AS month, count(*) AS n, sum({cents("value")}) AS c, sum(CAST(floor(value * {_PROBABILITY} + 0.5) AS BIGINT)) AS w FROM deal WHERE stage NOT IN ('WON', 'LOST') GROUP BY 1) d ON d.month = m.month""")  # fmt: skip
add("agg_09_win_rate", "deal", boards.win_rate, "SELECT won, lost, CASE WHEN won + lost > 0 THEN floor(won * 10000 / (won + lost) + 0.5) / 10000.0::DOUBLE ELSE 0.0 END AS win_rate FROM (SELECT count(*) FILTER (stage = 'WON') AS won, count(*) FILTER (stage = 'LOST') AS lost FROM deal)")
add("agg_10_payables_open", "payable", lambda p: boards.payables_open(p, TODAY), f"SELECT count(*) AS n, {euro(f'sum({cents("amount")})')} AS total, {euro(f"sum(CASE WHEN status = 'OVERDUE' OR due_date < DATE '{TODAY}' THEN {cents('amount')} ELSE 0 END)")} AS overdue FROM payable WHERE status IN ('TO_PAY', 'SCHEDULED', 'OVERDUE')")
add("agg_10_payables_by_party", "payable", boards.payables_by_party, f"SELECT party_id, count(*) AS n, {euro(f"sum(CASE WHEN status IN ('TO_PAY', 'SCHEDULED', 'OVERDUE') THEN {cents('amount')} ELSE 0 END)")} AS open_total, min(due_date) AS first_due FROM payable GROUP BY party_id")
_IN, _OUT = (f"sum(CASE WHEN amount {o} 0 THEN {cents('abs(amount)')} ELSE 0 END)" for o in "><")
add("agg_11_bank_flow", "bank_transaction", boards.bank_flow, f"SELECT tenant_id, {euro(_IN)} AS money_in, {euro(_OUT)} AS money_out, {euro(f'{_IN} - {_OUT}')} AS net FROM bank_transaction GROUP BY tenant_id")
add("agg_12_document_counts", "fiscal_document", boards.document_counts, f"SELECT type, {euro(f'sum({cents("total")})')} AS total, count(*) FILTER (status IN ('NOVO', 'EM_REVISAO')) AS to_review, count(*) AS n FROM fiscal_document WHERE status <> 'ARQUIVADO' GROUP BY type")
_RATE = "CASE WHEN gross <= 920 THEN 0 WHEN gross <= 1400 THEN 0.13 WHEN gross <= 2200 THEN 0.18 WHEN gross <= 3200 THEN 0.23 ELSE 0.28 END"
_PAY = f"""SELECT id, period, gross, CAST(round(gross * CAST({_RATE} AS DECIMAL(5,4)), 2) AS DECIMAL(12,2)) AS tax, CAST(round(gross * CAST(0.11 AS DECIMAL(5,4)), 2) AS DECIMAL(12,2)) AS employee,
CAST(round(gross * CAST(0.2375 AS DECIMAL(5,4)), 2) AS DECIMAL(12,2)) AS employer FROM employee"""
add("mth_14_payroll_lines", "employee", boards.payroll_lines, f"SELECT *, CAST(gross - tax - employee AS DECIMAL(12,2)) AS net FROM ({_PAY})")
add("agg_13_payroll_totals", "employee", boards.payroll_totals, f"SELECT period, count(*) AS n, {', '.join(f'CAST(sum({c}) AS DECIMAL(18,2)) AS {c}' for c in ('gross', 'tax', 'employee', 'employer'))}, CAST(sum(gross - tax - employee) AS DECIMAL(18,2)) AS net FROM ({_PAY}) GROUP BY period")
add("agg_24_outliers", "fiscal_document", lambda d: boards.outliers(d, 2.0),
    f"""SELECT id, party_id, total, round(z, 3) AS z FROM (SELECT id, d.party_id, total, ({cents("total")} - mean) / spread AS z FROM fiscal_document d JOIN
    (SELECT party_id, s / n AS mean, sqrt(greatest(q / n - (s / n) * (s / n), 0.0)) AS spread, n FROM (SELECT party_id, count(*) AS n, CAST(sum(c) AS DOUBLE) AS s, CAST(sum(c * c) AS DOUBLE) AS q
      FROM (SELECT party_id, CAST({cents("total")} AS HUGEINT) AS c FROM fiscal_document) GROUP BY party_id) WHERE n >= 3) m ON m.party_id = d.party_id WHERE spread > 0) WHERE abs(z) > 2.0""")  # fmt: skip
add("srt_01_payables_page", "payable", lambda p: boards.pages(p.where("status = 'TO_PAY'").select("id", "due_date", "amount"), [F.col("due_date").asc_nulls_last(), "id"], 2, 50), "SELECT id, due_date, amount FROM payable WHERE status = 'TO_PAY' ORDER BY due_date NULLS LAST, id LIMIT 50 OFFSET 50")

# Reconciliation -----------------------------------------------------------------------

_KEY = "lower(trim(regexp_replace(strip_accents(coalesce({}, '')), '\\s+', ' ', 'g')))"
_ENTITIES = {
    "doc": "SELECT 'doc' AS kind, id AS entity_id, tenant_id, total AS b, doc_date AS entity_date, doc_number AS number, counterparty AS words, id AS document_id FROM fiscal_document",
    "exp": "SELECT 'exp' AS kind, id AS entity_id, tenant_id, amount AS b, date AS entity_date, NULL AS number, description AS words, document_id FROM expense",
    "inv": "SELECT 'inv' AS kind, id AS entity_id, tenant_id, amount AS b, date AS entity_date, number, customer AS words, document_id FROM invoice",
    "pay": "SELECT 'pay' AS kind, id AS entity_id, tenant_id, amount AS b, due_date AS entity_date, NULL AS number, NULL AS words, document_id FROM payable",
}


def _matches(*kinds: str) -> str:
    """Every pair of a tenant by the tiers in their order."""
    tokens = "list_filter(string_split({}, ' '), lambda t: length(t) >= 4)"
    tier = "CASE WHEN ref <> '' AND ref = number THEN 0 WHEN length(number) >= 3 AND contains(bank, number) THEN 1 WHEN length(ref) >= 3 AND contains(words, ref) THEN 2 WHEN abs(a - b) < 0.01 AND (days IS NULL OR days <= 30) THEN 3 END"
    weak = f"round(least(0.9, 0.3 + CASE WHEN days IS NULL THEN 0.3 WHEN days <= 3 THEN 0.5 WHEN days <= 7 THEN 0.4 ELSE 0.3 END + CASE WHEN bank = '' OR words = '' THEN 0 WHEN contains(bank, words) OR contains(words, bank) THEN 0.2 WHEN list_has_any({tokens.format('bank')}, {tokens.format('words')}) THEN 0.1 ELSE 0 END), 2)"
    return f"""SELECT tx_id, kind, entity_id, document_id, CASE tier WHEN 0 THEN 'STRONG' WHEN 3 THEN 'WEAK' ELSE 'MEDIUM' END AS match_type, CAST(CASE tier WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.8 ELSE {weak} END AS DOUBLE) AS score
FROM (SELECT *, {tier} AS tier FROM (SELECT *, abs(date_diff('day', date, entity_date)) AS days FROM
 (SELECT id AS tx_id, tenant_id, abs(amount) AS a, date, {_KEY.format("reference")} AS ref, {_KEY.format("description")} AS bank FROM bank_transaction) t
 JOIN (SELECT kind, entity_id, document_id, tenant_id, abs(b) AS b, entity_date, {_KEY.format("number")} AS number, {_KEY.format("words")} AS words FROM ({" UNION ALL ".join(_ENTITIES[k] for k in kinds)})) d
 ON t.tenant_id = d.tenant_id AND (abs(a - b) < 0.01 OR (ref <> '' AND ref = number) OR (length(number) >= 3 AND contains(bank, number)) OR (length(ref) >= 3 AND contains(words, ref))))) WHERE tier IS NOT NULL"""


def _entities(d: DataFrame, kind: str) -> DataFrame:
    if kind == "doc":
        return reconcile.entities(d, "doc", amount="total", date="doc_date", reference="doc_number", description="counterparty", document="id")
    if kind == "exp":
        return reconcile.entities(d, "exp", amount="amount", date="date", description="description", document="document_id")
    if kind == "inv":
        return reconcile.entities(d, "inv", amount="amount", date="date", reference="number", description="customer", document="document_id")
    return reconcile.entities(d, "pay", amount="amount", date="due_date", document="document_id")


_CANDIDATES = f"SELECT tx_id, document_id, match_type, score FROM ({_matches('doc')})"
_BEST = f"SELECT tx_id, document_id, match_type, score FROM (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY score DESC, document_id) AS r FROM ({_CANDIDATES})) WHERE r = 1"
add("join_01_candidates", "bank_transaction fiscal_document", reconcile.candidates, _CANDIDATES)
add("agg_20_suggestions", "bank_transaction fiscal_document", reconcile.suggestions, _BEST)
add("agg_19_match_histogram", "bank_transaction fiscal_document", lambda t, d: reconcile.histogram(reconcile.suggestions(t, d)), f"SELECT match_type, count(*) AS n FROM ({_BEST}) GROUP BY match_type")
add("join_03_open_transactions", "bank_transaction fiscal_document", lambda t, d: reconcile.open_transactions(t, reconcile.suggestions(t, d)).select("id", "amount"), f"SELECT id, amount FROM bank_transaction WHERE id NOT IN (SELECT tx_id FROM ({_BEST}))")
add("join_02_tiers", "bank_transaction expense invoice", lambda t, e, i: reconcile.matches(t, _entities(e, "exp").unionByName(_entities(i, "inv"))), _matches("exp", "inv"))
_GROUPED = f"SELECT * EXCLUDE (r), max(CASE WHEN kind = 'doc' THEN score END) OVER (PARTITION BY tx_id) AS doc FROM (SELECT *, row_number() OVER (PARTITION BY tx_id, kind ORDER BY score DESC, entity_id) AS r FROM ({_matches('doc', 'pay')}) WHERE kind <> 'pay' OR document_id IS NOT NULL) WHERE r = 1"
add("join_04_payable_rule", "bank_transaction fiscal_document payable", lambda t, d, p: reconcile.best_of(reconcile.matches(t, _entities(d, "doc").unionByName(_entities(p.where("id % 3 <> 1"), "pay")))),
    f"SELECT * EXCLUDE (doc) FROM ({_GROUPED}) WHERE kind <> 'pay' OR doc IS NULL OR score > doc".replace("FROM payable", "FROM payable WHERE id % 3 <> 1"))


def _decided(s: DataFrame) -> DataFrame:
    return reconcile.decided(s, s.where("id % 5 < 2").select("id", (F.col("id") % 5 == 0).alias("accept")))


_DECIDED = """SELECT id, tx_id, document_id, CASE WHEN status <> 'PENDING' THEN status WHEN id = winner THEN 'ACCEPTED' WHEN winner IS NOT NULL OR id % 5 = 1 THEN 'REJECTED' ELSE 'PENDING' END AS status
FROM (SELECT *, min(CASE WHEN status = 'PENDING' AND id % 5 = 0 THEN id END) OVER (PARTITION BY tx_id) AS winner FROM suggestion)"""
add("dml_01_accept", "suggestion", lambda s: _decided(s).select("id", "tx_id", "document_id", "status"), _DECIDED)
add("dml_01_reconciled", "suggestion bank_transaction", lambda s, t: reconcile.reconciled(t, _decided(s), F.lit(TODAY)).select("id", "reconciled_at"), f"SELECT id, CASE WHEN id IN (SELECT tx_id FROM ({_DECIDED}) WHERE status = 'ACCEPTED') THEN DATE '{TODAY}' END AS reconciled_at FROM bank_transaction")
add("dml_02_reject", "suggestion", lambda s: reconcile.decided(s, s.where("id % 4 = 1").select("id", F.lit(False).alias("accept"))).select("id", "status"), "SELECT id, CASE WHEN status = 'PENDING' AND id % 4 = 1 THEN 'REJECTED' ELSE status END AS status FROM suggestion")
add("join_05_payables_of", "suggestion payable", lambda s, p: reconcile.payables_of(_decided(s), p), f"SELECT s.id AS suggestion_id, payable_id FROM ({_DECIDED}) s LEFT JOIN (SELECT document_id, min(id) AS payable_id FROM payable WHERE status <> 'PAID' GROUP BY document_id) p ON p.document_id = s.document_id WHERE s.status = 'ACCEPTED'")

# Parties ------------------------------------------------------------------------------

_CLUSTER_SQL = """, k AS (SELECT id, nif8 AS nif, lower(trim(email)) AS email, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')) AS name, right(regexp_replace(phone, '\\D', '', 'g'), 9) AS phone FROM party),
c1 AS (SELECT id, 'nif' AS reason, 1.0 AS score, min(id) OVER (PARTITION BY nif) AS cluster, count(*) OVER (PARTITION BY nif) AS n FROM k),
l1 AS (SELECT * FROM k WHERE id NOT IN (SELECT id FROM c1 WHERE n > 1)), c2 AS (SELECT id, 'email' AS reason, 0.95 AS score, min(id) OVER (PARTITION BY email) AS cluster, count(*) OVER (PARTITION BY email) AS n FROM l1),
l2 AS (SELECT * FROM l1 WHERE id NOT IN (SELECT id FROM c2 WHERE n > 1)), c3 AS (SELECT id, 'name' AS reason, 0.7 AS score, min(id) OVER (PARTITION BY name) AS cluster, count(*) OVER (PARTITION BY name) AS n FROM l2),
l3 AS (SELECT * FROM l2 WHERE id NOT IN (SELECT id FROM c3 WHERE n > 1)), c4 AS (SELECT id, 'phone' AS reason, 0.9 AS score, min(id) OVER (PARTITION BY phone) AS cluster, count(*) OVER (PARTITION BY phone) AS n FROM l3)
SELECT id, reason, CAST(score AS DOUBLE) AS score, cluster FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4) WHERE n > 1"""
add("join_20_contact_clusters", "party", parties.contact_clusters, None)
ORACLES["join_20_contact_clusters"] = with_views("party", "@").replace(" @", _CLUSTER_SQL)


def _blacklist(p: DataFrame) -> DataFrame:
    return p.where("id % 23 = 0").select("iban")


_IBAN_OK = "(CAST(concat(substr(iban, 5), '2529', substr(iban, 3, 2)) AS HUGEINT) % 97 = 1)"
_RISK = """SELECT id, CAST(CASE WHEN iban IS NULL THEN 0 ELSE least(greatest((CASE WHEN iban IN (SELECT iban FROM creditor WHERE id % 23 = 0 AND iban IS NOT NULL) THEN 60 ELSE 0 END) + (CASE WHEN id % 11 = 0 THEN 30 ELSE 0 END) + greatest(coalesce(changes, 0) - 3, 0) * 5 + (CASE WHEN iban LIKE 'PT%' THEN 0 ELSE 10 END) - (CASE WHEN verified THEN 40 ELSE 0 END), 0), 100) END AS INTEGER) AS risk
FROM creditor LEFT JOIN (SELECT party_id, count(*) AS changes FROM iban_change WHERE old_iban IS NOT NULL AND created_at >= DATE '1997-01-01' - INTERVAL 90 DAY GROUP BY party_id) h ON h.party_id = creditor.id"""
add("mth_16_iban_risk", "creditor iban_change", lambda p, h: parties.iban_risk(p, _blacklist(p), parties.recent_changes(h, TODAY)), f"SELECT id, risk, CASE WHEN risk > 70 THEN 'block' WHEN risk > 30 THEN 'review' ELSE 'allow' END AS advice FROM ({_RISK})")
add("agg_25_recent_changes", "iban_change", lambda h: parties.recent_changes(h, TODAY), f"SELECT party_id, count(*) AS changes FROM iban_change WHERE old_iban IS NOT NULL AND created_at >= DATE '{TODAY}' - INTERVAL 90 DAY GROUP BY party_id")
_RUN = """SELECT y.id, y.party_id, y.amount, CASE WHEN p.iban IS NULL THEN 'missing' WHEN p.flagged THEN 'flagged' WHEN p.id % 23 = 0 THEN 'blacklisted' END AS skipped
FROM payable y LEFT JOIN party p ON p.id = y.party_id WHERE y.approved AND y.status IN ('TO_PAY', 'SCHEDULED')"""
add("join_14_payment_run", "payable party", lambda y, p: parties.payment_run(y, p, _blacklist(p)), _RUN)
add("agg_15_payment_counters", "payable party", lambda y, p: parties.payment_counters(parties.payment_run(y, p, _blacklist(p))), f"SELECT coalesce(skipped, 'kept') AS outcome, count(*) AS n, {euro(f'sum({cents("amount")})')} AS control_sum FROM ({_RUN}) GROUP BY 1")
add("agg_18_recurring", "fiscal_document", parties.recurring, "SELECT party_id, count(*) AS n FROM fiscal_document GROUP BY party_id HAVING count(*) >= 3")
add("join_12_relation_counts", "party deal fiscal_document", parties.with_counts, "SELECT p.id, p.name, coalesce(a.n, 0) AS deals, coalesce(b.n, 0) AS documents FROM party p LEFT JOIN (SELECT contact_id, count(*) AS n FROM deal GROUP BY 1) a ON a.contact_id = p.id LEFT JOIN (SELECT party_id, count(*) AS n FROM fiscal_document GROUP BY 1) b ON b.party_id = p.id")
add("join_25_exact_copies", "fiscal_document", parties.exact_copies, "SELECT id, tenant_id, first_id FROM (SELECT id, tenant_id, min(id) OVER (PARTITION BY tenant_id, file_hash) AS first_id FROM fiscal_document WHERE status <> 'ARQUIVADO') WHERE id <> first_id")
add("join_22_new_rows", "bank_transaction fiscal_document", lambda t, d: parties.new_rows(t.select(F.col("id")), d.where("id % 2 = 0").select("id"), ["id"]), "SELECT DISTINCT id FROM bank_transaction WHERE id NOT IN (SELECT id FROM fiscal_document WHERE id % 2 = 0)")

# Scalars ------------------------------------------------------------------------------

_DIGIT = "(" + " + ".join(f"CAST(substr(n, {i}, 1) AS INTEGER) * {10 - i}" for i in range(1, 9)) + ") % 11"
add("fid_01_nif_check_digit", "party", lambda p: p.select("id", fiscal.nif_check_digit(F.col("nif8")).alias("digit")), f"SELECT id, CASE WHEN r < 2 THEN 0 ELSE 11 - r END AS digit FROM (SELECT id, {_DIGIT.replace('substr(n', 'substr(nif8')} AS r FROM party)")
add("fid_04_iban_valid", "party", lambda p: p.select("id", fiscal.iban_valid(F.col("iban")).alias("valid")), f"SELECT id, {_IBAN_OK} AS valid FROM party")
add("str_15_masked_iban", "party", lambda p: p.select("id", text.masked_iban(F.col("iban")).alias("masked")), "SELECT id, concat(left(iban, 4), '••••', right(iban, 4)) AS masked FROM party")
add("str_01_reference_key", "bank_transaction", lambda t: t.select("id", text.reference_key(F.col("reference")).alias("key")), f"SELECT id, {_KEY.format('reference')} AS key FROM bank_transaction")
add("jsn_02_row_hash", "bank_transaction", lambda t: t.select("id", vectors.row_hash(F.col("date").cast("timestamp"), F.col("amount"), F.col("description"), F.col("reference")).alias("hash")), "SELECT id, sha256(concat(strftime(date, '%Y-%m-%dT00:00:00.000Z'), '|', printf('%.2f', amount), '|', trim(description), '|', coalesce(trim(reference), ''))) AS hash FROM bank_transaction")
add("dat_06_month_totals", "fiscal_document", lambda d: d.groupBy(dates.month_key(F.col("doc_date")).alias("month")).agg(F.count("*").alias("n"), (F.sum(money.cents(F.col("total"))) / F.lit(100.0)).alias("total")), f"SELECT strftime(doc_date, '%Y-%m') AS month, count(*) AS n, {euro(f'sum({cents("total")})')} AS total FROM fiscal_document GROUP BY 1")
add("dat_07_months_later", "fiscal_document", lambda d: d.select("id", dates.months_later(F.col("doc_date"), 1).alias("next")), "SELECT id, CAST(date_trunc('month', doc_date) + INTERVAL 1 MONTH + (day(doc_date) - 1) * INTERVAL 1 DAY AS DATE) AS next FROM fiscal_document")
add("dat_08_recurrences", "payable", lambda p: p.select("id", F.explode(dates.recurrences(F.col("due_date"), 3, F.lit(datetime.date(1998, 12, 31)), 6)).alias("due")), """SELECT id, due FROM (WITH RECURSIVE steps AS (SELECT id, due_date AS due, 1 AS k FROM payable UNION ALL SELECT id, CAST(date_trunc('month', due) + INTERVAL 3 MONTH + (day(due) - 1) * INTERVAL 1 DAY AS DATE), k + 1 FROM steps WHERE k < 6) SELECT id, due FROM steps WHERE due <= DATE '1998-12-31')""")
add("dat_10_business_days", "fiscal_document", lambda d: d.select("id", dates.business_days_later(F.col("doc_date"), 2).alias("due")), "SELECT id, CAST(doc_date + CASE isodow(doc_date) WHEN 4 THEN 4 WHEN 5 THEN 4 WHEN 6 THEN 3 ELSE 2 END * INTERVAL 1 DAY AS DATE) AS due FROM fiscal_document")
add("dat_12_days_until", "payable", lambda p: p.select("id", dates.days_until(F.col("due_date"), F.lit(datetime.date(1997, 1, 1))).alias("days")), "SELECT id, CAST(date_diff('day', DATE '1997-01-01', due_date) AS BIGINT) AS days FROM payable")
add("mth_02_line_tax", "document_item", lambda i: i.select("document_id", "line", money.vat_from_base(F.col("total"), F.col("tax_rate")).alias("tax"), money.base_from_gross(F.col("total"), F.col("tax_rate")).alias("base")), f"SELECT document_id, line, {round2('total * CAST(tax_rate AS DOUBLE) / 100')} AS tax, {round2('total - ' + round2('total * CAST(tax_rate AS DOUBLE) / (CAST(tax_rate AS DOUBLE) + 100)'))} AS base FROM document_item")
add_raw("str_13_chunks", "documents", lambda d: retrieval.chunked(d).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars")), """SELECT doc_id, count(*) AS chunks, CAST(sum(length(c)) AS BIGINT) AS chars FROM
(SELECT doc_id, unnest(list_transform(range(0, len(w), 64), lambda s: array_to_string(w[s + 1:s + 80], ' '))) AS c FROM (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS w FROM documents)) GROUP BY doc_id""")  # fmt: skip
add_raw("fil_07_keyword_search", "documents", lambda d: retrieval.keyword_search(d, ["licensed", "version"], ["text", "source"]).select("doc_id"), "SELECT doc_id FROM documents WHERE (contains(lower(text), 'licensed') OR contains(lower(source), 'licensed')) AND (contains(lower(text), 'version') OR contains(lower(source), 'version'))")
add_raw("jsn_01_text_hash", "documents", lambda d: d.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash")), "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
add_raw("agg_30_term_vectors", "conversations", lambda c: retrieval.term_vectors(c, ["conv_id", "turn"]).withColumn("weight", F.round("weight", 6)), """SELECT conv_id, turn, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)), 6) AS weight FROM
(SELECT conv_id, turn, CAST(('0x' || substr(sha1(w), 3, 2)) AS INTEGER) AS bucket, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM conversations) WHERE w <> '' GROUP BY 1, 2, 3)""")  # fmt: skip
_QUERY = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
_VECTOR = f"[{', '.join(map(str, _QUERY))}]::DOUBLE[]"
add_raw("srt_05_nearest", "embeddings", lambda e: retrieval.nearest(e, _QUERY, 20), f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VECTOR}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")


def _fusion(e: DataFrame) -> DataFrame:
    """Two rankings of all vectors, from the newest and from the oldest."""
    newest = e.agg(F.max("vec_id").alias("top"))
    a = e.join(F.broadcast(newest)).select(F.col("vec_id").alias("key"), (F.col("top") - F.col("vec_id")).cast("long").alias("rank"))
    b = e.where(F.col("label") % 2 == 0).select(F.col("vec_id").alias("key"), F.col("vec_id").cast("long").alias("rank"))  # even labels have a rank in both
    return retrieval.fused(a, b)


add_raw("join_26_rank_fusion", "embeddings", _fusion, """SELECT key, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS score, count(*) AS lists FROM
(SELECT vec_id AS key, (SELECT max(vec_id) FROM embeddings) - vec_id AS rank FROM embeddings UNION ALL SELECT vec_id, vec_id FROM embeddings WHERE label % 2 = 0) GROUP BY key""")  # fmt: skip

# Audit chain and payments files -------------------------------------------------------


def _transfers(y: DataFrame, p: DataFrame) -> DataFrame:
    who = p.select(F.col("id").alias("party_id"), "name", "iban")
    return sepa.transfers(y.where("approved AND status = 'TO_PAY'").join(who, "party_id").select("id", "amount", "name", "iban", F.lit("Fatura & recibo").alias("remittance")))


add("snk_03_sepa_fragments", "payable party", lambda y, p: _transfers(y, p).select("id", "valid", "xml"), f"""SELECT y.id, {_IBAN_OK} AND amount > 0 AS valid, CASE WHEN {_IBAN_OK} AND amount > 0 THEN concat('<CdtTrfTxInf><PmtId><EndToEndId>', y.id, '</EndToEndId></PmtId><Amt><InstdAmt Ccy="EUR">', printf('%.2f', amount), '</InstdAmt></Amt><Cdtr><Nm>', name, '</Nm></Cdtr><CdtrAcct><Id><IBAN>', iban,
'</IBAN></Id></CdtrAcct><RmtInf><Ustrd>Fatura &amp; recibo</Ustrd></RmtInf></CdtTrfTxInf>') END AS xml FROM payable y JOIN party p ON p.id = y.party_id WHERE approved AND status = 'TO_PAY'""")  # fmt: skip
add("snk_04_sepa_header", "payable party", lambda y, p: sepa.header(_transfers(y, p)), f"SELECT count(*) AS n, {euro(f'coalesce(sum({cents("amount")}), 0)')} AS control_sum FROM payable y JOIN party p ON p.id = y.party_id WHERE approved AND status = 'TO_PAY' AND amount > 0 AND {_IBAN_OK}")

# Event windows ------------------------------------------------------------------------

add_raw("stm_04_rate_limited", "events", lambda e: streams.rate_limited(e, "user_id", "1 hour", 1), "SELECT date_trunc('hour', ts) AS start, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
add_raw("stm_12_bursts", "events", lambda e: streams.bursts(e, "user_id", 1, "60 minutes", "30 minutes"), """SELECT start, user_id, count(*) AS n FROM (SELECT user_id, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1, 2 HAVING count(*) > 1""")
add_raw("stm_13_sessions", "events", lambda e: streams.sessions(e, "user_id", "2 hours"), """SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, user_id, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s""")  # fmt: skip
add_raw("stm_10_once", "events", lambda e: streams.once(e.select("user_id", "event_type"), ["user_id", "event_type"]), "SELECT DISTINCT user_id, event_type FROM events")

# Filing, states, more filters ---------------------------------------------------------

add("dml_03_approve", "fiscal_document", states.approved, "SELECT id, CASE WHEN status IN ('NOVO', 'EM_REVISAO') THEN 'approved' WHEN status = 'APROVADO' THEN 'unchanged' ELSE 'conflict' END AS outcome, CASE WHEN status IN ('NOVO', 'EM_REVISAO') THEN 'APROVADO' ELSE status END AS status FROM fiscal_document")
add("dml_18_outcomes", "fiscal_document", lambda d: states.outcomes(states.approved(d)), "SELECT CASE WHEN status IN ('NOVO', 'EM_REVISAO') THEN 'approved' WHEN status = 'APROVADO' THEN 'unchanged' ELSE 'conflict' END AS outcome, count(*) AS n FROM fiscal_document GROUP BY 1")
add("dml_15_payables_from", "fiscal_document payable", lambda d, p: states.payables_from(d, p.where("id % 2 = 0")), "SELECT id AS document_id, party_id, total AS amount, due_date, 'TO_PAY' AS status FROM fiscal_document WHERE type = 'FATURA_RECEBIDA' AND status <> 'ARQUIVADO' AND id NOT IN (SELECT document_id FROM payable WHERE id % 2 = 0)")
add("dml_04_pay", "payable", lambda p: states.paid(p, p.where("id % 5 = 0").select(F.col("id").alias("payable_id"), (F.col("amount") + F.when(F.col("id") % 10 == 0, 1.0).otherwise(0.0)).alias("amount")), TODAY), f"SELECT id, CASE WHEN NOT approved THEN 'rejected' WHEN id % 10 = 0 THEN 'difference' ELSE 'paid' END AS outcome, CASE WHEN approved AND id % 10 <> 0 THEN DATE '{TODAY}' END AS paid_at FROM payable WHERE id % 5 = 0")
add("dml_13_iban_history", "party", lambda p: states.iban_history(p.where("id % 3 <> 0").withColumn("iban", F.when(F.col("id") % 5 == 0, F.lit("PT00")).otherwise(F.lower("iban"))), p), "SELECT id, iban AS new_iban, CASE WHEN id % 3 <> 0 THEN 'PT00' END AS old_iban FROM party WHERE id % 3 = 0 OR id % 5 = 0")
add("dml_09_repoint", "deal", lambda d: states.repointed(d.select("id", "contact_id"), d.where("contact_id % 10 = 0").select(F.col("contact_id").alias("old_id"), (F.col("contact_id") + 1).alias("new_id")).distinct(), "contact_id"), "SELECT id, CASE WHEN contact_id % 10 = 0 THEN contact_id + 1 ELSE contact_id END AS contact_id FROM deal")
add("snk_09_upsert", "party", lambda p: states.upserted(p.where("id % 2 = 0").select("id", "name"), p.select("id", F.lit("new").alias("name")), ["id"]), "SELECT id, CASE WHEN id % 2 = 0 THEN name ELSE 'new' END AS name FROM party")
add("fil_20_rules", "fiscal_document", lambda d: filing.first_rule(_filed(d), _rules(d.sparkSession)).select("id", "rule_id", "folder"), """SELECT id, CAST(CASE WHEN type = 'RECIBO' AND party_id % 5 = 0 THEN 3 WHEN type = 'RECIBO' THEN 2 WHEN party_id % 7 = 0 THEN 1 END AS INTEGER) AS rule_id,
CASE WHEN type = 'RECIBO' AND party_id % 5 = 0 THEN concat('Vip/', strftime(doc_date, '%Y')) WHEN type = 'RECIBO' THEN concat('Recibos/', strftime(doc_date, '%Y/%m')) WHEN party_id % 7 = 0 THEN 'Sete/_Outro_' ELSE concat('Inbox/', strftime(doc_date, '%Y/%m')) END AS folder FROM fiscal_document""")  # fmt: skip
add("prj_15_file_names", "fiscal_document", lambda d: d.select("id", filing.file_name(F.concat(F.lit("Águas & Cª "), "party_id"), F.col("doc_date"), F.col("doc_number"), F.col("id"), "pdf").alias("name")), "SELECT id, concat('AGUAS-C-', party_id, '_', strftime(doc_date, '%Y-%m-%d'), '_FT-', year(doc_date), '-', id, '.pdf') AS name FROM fiscal_document")
add("prj_02_parties", "party", lambda p: p.select("id", "name", text.masked_iban(F.col("iban")).alias("iban"), text.phone_key(F.col("phone")).alias("phone")), "SELECT id, name, concat(left(iban, 4), '••••', right(iban, 4)) AS iban, right(regexp_replace(phone, '\\D', '', 'g'), 9) AS phone FROM party")
add("str_36_extract", "fiscal_document", lambda d: d.select("id", extraction.fields(F.concat(F.lit("Fornecedor\nNIF: 500 000 000\nFatura "), "doc_number", F.lit("\nData: "), F.date_format("doc_date", "dd/MM/yyyy"), F.lit("\nIVA 23% 12,30\nTotal: EUR "), F.replace(F.format_string("%.2f", "total"), F.lit("."), F.lit(",")))).alias("f")).select("id", "f.nif", "f.number", "f.date", "f.total", "f.tax", "f.type", "f.confidence"),
    "SELECT id, '500000000' AS nif, doc_number AS number, doc_date AS date, CAST(printf('%.2f', total) AS DOUBLE) AS total, CAST(12.3 AS DOUBLE) AS tax, 'FATURA_RECEBIDA' AS type, CAST(0.85 AS DOUBLE) AS confidence FROM fiscal_document")
add("win_05_previous", "fiscal_document", lambda d: listed.previous(d, "party_id", ["doc_date", "id"]), "SELECT id, lag(id) OVER (PARTITION BY party_id ORDER BY doc_date, id) AS previous_id FROM fiscal_document")
add("join_10_nested_items", "document_item", lambda i: listed.nested(i, "document_id", ["line"]).select("document_id", "n", F.array_join(F.transform("items", lambda x: x["line"].cast("string")), ",").alias("lines")), "SELECT document_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM document_item GROUP BY document_id")


def _nearest_rank(p: DataFrame) -> DataFrame:
    return boards.nearest_ranks(p, "status", "due_date", {"p50": 0.5, "p95": 0.95})


add("agg_34_nearest_rank", "payable", _nearest_rank, "SELECT status, list_sort(list(due_date))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] AS p50, list_sort(list(due_date))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS p95 FROM payable GROUP BY status")
add("set_06_missing", "fiscal_document payable", lambda d, p: listed.missing(d, p.where("status = 'PAID'")), "SELECT id FROM fiscal_document WHERE id NOT IN (SELECT id FROM payable WHERE status = 'PAID')")
add("dat_09_schedule_status", "payable", lambda p: p.select("id", dates.schedule_status(F.col("status"), F.col("due_date"), F.lit(TODAY)).alias("now")), f"SELECT id, CASE WHEN status IN ('PAID', 'CANCELLED') THEN status WHEN due_date < DATE '{TODAY}' THEN 'OVERDUE' ELSE 'SCHEDULED' END AS now FROM payable")


def _filed(d: DataFrame) -> DataFrame:
    return d.select("id", "type", F.concat(F.lit("Supplier "), F.col("party_id") % 7, F.lit("x")).alias("supplier"), F.lit("500000000").alias("nif"), F.concat(F.lit("a@d"), F.col("party_id") % 5, F.lit(".pt")).alias("email"), F.lit("text").alias("text"), F.col("doc_date").alias("date"))


def _rules(spark: SparkSession) -> DataFrame:
    schema = "id int, priority int, active boolean, type string, supplier string, nif string, domain string, keywords array<string>, pattern string"
    rows = [(1, 5, True, None, "supplier 0X", None, None, None, "Sete/{Outro}"), (2, 10, True, "RECIBO", None, "500000000", None, ["TEX", "no"], "Recibos/{Ano}/{Mes}"), (3, 20, True, "RECIBO", None, None, "D0.pt", None, "Vip/{Ano}"), (4, 99, False, None, None, None, None, None, "Never")]
    return spark.createDataFrame(rows, schema)
