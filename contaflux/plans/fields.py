"""Queries of texts, dates, amounts and identifiers, with their DuckDB twins."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contaflux.functions import dates, fiscal, money, text, vectors
from contaflux.operators import boards, extraction, filing
from contaflux.plans.base import add, add_raw

DOC = "fiscal_document"


def case(name: str, column: Callable[[], Column], sql: str, alias: str = "value", views: str = DOC) -> None:
    """A query of one column, built when the query runs, over the ids of a view."""
    add(name, views, lambda d: d.select("id", column().alias(alias)), f"SELECT id, {sql} AS {alias} FROM {views}")


def pick(*values: str | None) -> Column:
    """One of the values, by the id."""
    return F.get(F.array(*map(F.lit, values)), (F.col("id") % len(values)).cast("int"))


def of(*values) -> str:
    """The same in SQL, of results."""
    shown = ["NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in values]
    return "CASE id % {} {} END".format(len(values), " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(shown)))


def shown(value: Column, *columns: str, between: str = "|") -> Column:
    """Columns of a struct as one text; the struct is worked out once."""
    return fiscal.bound(value, lambda v: F.concat_ws(between, *(v[c].cast("string") for c in columns)))


# Texts --------------------------------------------------------------------------------

_KIND = lambda s: F.concat_ws(":", s["type"], s["confidence"].cast("string"))
case("str_30_classified", lambda: _KIND(filing.classified(pick("ft_1.pdf", "nc_1.pdf", "x.pdf", "x.pdf", "x.pdf"), pick("contrato", "contrato", "contrato", "contrato", "nada"), pick(None, "FS", "NC", None, None))), of("FATURA_RECEBIDA:0.8", "FATURA_SIMPLIFICADA:0.95", "NOTA_CREDITO:0.95", "CONTRATO:0.65", "UNIDENTIFIED:0.1"))
case("str_31_text_type", lambda: text.text_type(pick("Nota de crédito e fatura", "DEBIT NOTE", "recibo de fatura", "Rechnung 5", "nada", "pré-faturado")), of("NOTA_CREDITO", "NOTA_DEBITO", "RECIBO", "FATURA_RECEBIDA", None, None))
case("str_38_qr_line", lambda: extraction.qr_line(pick("x\nA:500000000*B:1\ny", "A:1*", None)), of("A:500000000*B:1", None, None))
case("str_42_first_object", lambda: extraction.first_object(pick('x {"a":"}{"} y', "<think>{}</think>```json\n{\"b\":{\"c\":1}}```", "none", '{"open":')), of('{"a":"}{"}', '{"b":{"c":1}}', None, None))
case("str_45_remittance", lambda: text.remittance(pick("Renda", None, "", "x"), F.col("doc_number"), pick("AB-1", None)), "concat(CASE id % 4 WHEN 0 THEN 'Renda | ' WHEN 3 THEN 'x | ' ELSE '' END, 'fat: ', doc_number, CASE WHEN id % 2 = 0 THEN ' | atcud: AB-1' ELSE '' END)")
case("str_10_filing_folder", lambda: filing.filing_folder(F.col("doc_date"), pick("Loja", None), pick("Rendas/Casa", "Outras", None), pick("PT", "ES", None, "FR"), F.col("id") % 3 == 0), """CASE WHEN id % 4 IN (1, 3) THEN concat('/Estrangeiras/', CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'Fornecedor/loja' WHEN id % 3 = 0 THEN 'Despesa/rendas-casa' WHEN id % 3 = 1 THEN 'Despesa/outras' ELSE 'Geral' END, strftime(doc_date, '/%Y/%m'))
WHEN id % 3 = 0 AND id % 2 = 0 THEN concat('/Fornecedores/loja', strftime(doc_date, '/%Y/%m')) WHEN id % 3 = 0 THEN concat('/Despesas/rendas-casa', strftime(doc_date, '/%Y/%m')) WHEN id % 3 = 1 THEN concat('/Despesas/outras', strftime(doc_date, '/%Y/%m')) END""")

# Dates --------------------------------------------------------------------------------

add("dat_04_quarter", DOC, lambda d: d.where((F.col("doc_date") >= dates.quarter_start(1996, 4)) & (F.col("doc_date") < dates.quarter_end(1996, 4))).select("id", "doc_date"), "SELECT id, doc_date FROM fiscal_document WHERE doc_date >= DATE '1996-10-01' AND doc_date < DATE '1997-01-01'")
add("dat_07_steps", "schedule", lambda s: s.select("id", dates.stepped(F.col("due_date"), F.col("recurrence"), F.col("step").cast("int")).alias("next")), """SELECT id, CAST(CASE recurrence WHEN 'DAILY' THEN due_date + step * INTERVAL 1 DAY WHEN 'WEEKLY' THEN due_date + 7 * step * INTERVAL 1 DAY
WHEN 'MONTHLY' THEN date_trunc('month', due_date) + step * INTERVAL 1 MONTH + (day(due_date) - 1) * INTERVAL 1 DAY WHEN 'QUARTERLY' THEN date_trunc('month', due_date) + 3 * step * INTERVAL 1 MONTH + (day(due_date) - 1) * INTERVAL 1 DAY
WHEN 'YEARLY' THEN date_trunc('month', due_date) + 12 * step * INTERVAL 1 MONTH + (day(due_date) - 1) * INTERVAL 1 DAY END AS DATE) AS next FROM schedule""")
case("dat_11_default_due", lambda: dates.default_due(F.col("doc_date")), "CAST(doc_date + INTERVAL 30 DAY AS DATE)")
case("dat_14_date_slug", lambda: dates.date_slug(F.col("doc_date")), "strftime(doc_date, '%Y-%m-%d')")

# Amounts ------------------------------------------------------------------------------

add("mth_05_tax_fits", "document_item", lambda i: i.select("document_id", "line", money.tax_fits(F.col("total"), F.col("tax_rate").cast("double"), F.floor(F.col("total") * F.col("tax_rate").cast("double") + 0.5) / 100 + F.when(F.col("line") > 1, 0.05).otherwise(0.0)).alias("fits")), "SELECT document_id, line, line = 1 AS fits FROM document_item")
_TRIO = lambda: money.money_trio(*(F.get(F.array(*(F.lit(v).cast("double") for v in values)), (F.col("id") % 8).cast("int")) for values in ([123.0, 123.0, None, 123.0, 123.0, None, 0.0, 50.0], [23.0, None, 23.0, 23.0, 1.0, None, 23.0, 60.0], [100.0, 100.0, 100.0, None, None, None, None, None])))
case("mth_11_money_trio", lambda: shown(_TRIO(), "total", "tax", "net", "hint"), of("123.0|23.0|100.0|reconciled_from_pair", "123.0|23.0|100.0|reconciled_partial", "123.0|23.0|100.0|reconciled_partial", "123.0|23.0|100.0|reconciled_partial", "123.0|reconciled_partial", "", "23.0|reconciled_partial", "50.0|60.0|reconciled_from_total_only"))
add("mth_12_net", DOC, lambda d: d.select("id", money.net_of(F.col("total"), money.vat_from_gross(F.when(F.col("type") != "RECIBO", F.col("total")), F.lit(23.0))).alias("net")), "SELECT id, CASE WHEN type <> 'RECIBO' THEN floor(greatest(total - floor(total * 23.0::DOUBLE / 123.0::DOUBLE * 100 + 0.5) / 100.0::DOUBLE, 0) * 100 + 0.5) / 100.0::DOUBLE END AS net FROM fiscal_document")
add("mth_13_line_total", "document_item", lambda i: i.select("document_id", "line", money.line_total(F.col("quantity"), F.col("total") / F.col("quantity"), F.col("discount") * F.col("total") * 20).alias("net")), "SELECT document_id, line, greatest(0.0, floor((quantity * (total / quantity) - discount * total * 20) * 100 + 0.5) / 100.0::DOUBLE) AS net FROM document_item")
case("mth_20_confidence", lambda: money.presence([(pick("5", None), 0.2), (F.col("total"), 0.2), (F.col("doc_number"), 0.15), (pick("", "x", None), 0.1)]), "round(0.35 + CASE WHEN id % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN id % 3 = 1 THEN 0.1 ELSE 0 END, 4)::DOUBLE")
_STAGES = '[{"key":"LEAD","defaultProbability":15},{"key":"DEMO","label":"Demo","defaultProbability":35}]'
add("mth_23_probability", "deal", lambda d: d.select("id", boards.probability(F.when(F.col("id") % 5 == 0, "DEMO").otherwise(F.col("stage")), F.when(F.col("id") % 7 == 0, (F.col("id") % 300).cast("int") - 50), F.lit(_STAGES)).alias("probability")), "SELECT id, CAST(CASE WHEN id % 7 = 0 THEN least(greatest(id % 300 - 50, 0), 100) WHEN id % 5 = 0 THEN 35 ELSE CASE stage WHEN 'LEAD' THEN 15 WHEN 'QUALIFIED' THEN 40 WHEN 'PROPOSAL' THEN 60 WHEN 'NEGOTIATION' THEN 80 WHEN 'WON' THEN 100 ELSE 0 END END AS INTEGER) AS probability FROM deal")
case("jsn_14_stage_list", lambda: F.array_join(F.transform(boards.stage_list(pick(_STAGES, None, "[]", '[{"key":"won","label":"Ganho"}]')), lambda s: F.concat(s["key"], F.lit("="), s["probability"].cast("string"))), ","), of("LEAD=15,DEMO=35,QUALIFIED=40,PROPOSAL=60,NEGOTIATION=80,WON=100,LOST=0", *["LEAD=20,QUALIFIED=40,PROPOSAL=60,NEGOTIATION=80,WON=100,LOST=0"] * 2, "WON=100,LEAD=20,QUALIFIED=40,PROPOSAL=60,NEGOTIATION=80,LOST=0"))
case("agg_29_money_sum", lambda: money.money_sum(F.array(F.col("total"), F.lit(0.105), F.lit(float("nan")), F.lit(None).cast("double"), F.lit(float("inf")))), "floor((total + 0.105) * 100 + 0.5) / 100.0::DOUBLE")
case("prj_12_patched", lambda: extraction.patched(F.col("counterparty"), pick(None, "new", None)), "CASE WHEN id % 3 = 1 THEN 'new' ELSE counterparty END")

# Identifiers and fiscal payloads ------------------------------------------------------

_IBAN = lambda: fiscal.iban_parsed(pick("PT77 0035 0651 0000 0000 0073 9", "PT50000201231234567890154", "", "DE89370400440532013000", "GB00"))
case("fid_05_iban_parts", lambda: shown(_IBAN(), "status", "bank", "branch", "account", "nib_digits", "nib_valid"), of("valid|0035|0651|00000000007|39|true", "invalid|0002|0123|12345678901|54|false", "unknown", "valid", "invalid"))
_VAT = lambda: fiscal.foreign_vat(pick("VAT No: DE 123456789; total", "CIF: ESB1234567X", "our EL123456789", "PT500000000", "GB123456789 and FR12345678901", "x"))
case("fid_06_foreign_vat", lambda: shown(_VAT(), "country", "value", between=":"), of("DE:DE123456789", "ES:ESB1234567X", "GR:EL123456789", "", "GB:GB123456789", ""))
case("fid_07_tax_id", lambda: fiscal.tax_id_valid(pick("PT", "PT", "DE", "FR", "XX"), pick("500000000", "500000001", None, None, None), pick(None, None, "DE123456789", "FR1", "XX123")), of(True, False, True, False, False))
_QR = "A:500000000*B:999999990*C:PT*D:FT*E:N*F:20260315*G:FT 2026/1*H:J66S9FDD-1*I1:PT*I7:100.00*I8:{}*N:{}*O:{}*Q:abcd*R:1234"
_QRS = [_QR.format("23.00", "23.00", "123.00"), _QR.format("13.00", "13.00", "150.00"), "A:123*H:X*O:5", "nothing"]
_CHECKED = lambda: fiscal.qr_checked(pick(*_QRS))
case("fid_08_qr_checked", lambda: fiscal.bound(_CHECKED(), lambda x: F.concat_ws("|", F.array_join(x["errors"], ","), F.array_join(x["warnings"], ","))), of("|", "vat_line|sum", "issuer_nif,document_type,document_date,atcud|unique_id,certificate", ""))
_LINES = lambda: F.transform(F.flatten(F.transform(fiscal.qr_breakdown(pick("A:1*I1:PT*I2:5*I7:100.00*I8:23.00*J1:PT-AC*J3:10*J4:0.4", "A:1*K1:PT-MA*K5:7", "A:1")), fiscal.region_lines)), lambda x: F.concat_ws(":", x["kind"], x["rate"].cast("string"), x["base"].cast("string"), x["tax"].cast("string")))
case("fid_09_region_lines", lambda: F.array_join(_LINES(), ","), of("exempt:0.0:5.0:0.0,normal:23.0:100.0:23.0,reduced:4.0:10.0:0.4", "intermediate:12.0:7.0:0.0", ""))
_FLAT = lambda: F.transform(fiscal.flat_breakdown(fiscal.qr_breakdown(pick("A:1*I1:PT*I3:10*I7:100.00*I8:23.00*J1:PT-AC*J3:10*J4:0.4", "A:1"))), lambda x: F.concat_ws(":", x["rate"].cast("string"), x["base"].cast("string"), x["tax"].cast("string")))
case("fid_10_flat_breakdown", lambda: F.array_join(_FLAT(), ","), of("4.0:10.0:0.0,23.0:100.0:23.0,5.0:10.0:0.4", ""))
_FORM = lambda: fiscal.qr_form(pick("A:500000000*D:NC*H:ABCDEF-1*O:5*N:1", "A:500000000*D:RC*G:RC 1*O:5", "A:5*D:ZZ", "x"))
case("prj_14_qr_form", lambda: shown(_FORM(), "type", "number", "nif", "total", "tax"), of("outro|ABCDEF-1|500000000|5.0|1.0", "recibo|RC 1|500000000|5.0", "fatura_recebida|5", ""))
_FROM_QR = lambda: fiscal.qr_document(pick(*_QRS))
case("jsn_12_qr_document", lambda: shown(_FROM_QR(), "type", "number", "date", "customer_nif", "total", "tax", "net", "confidence"), of("FATURA_RECEBIDA|FT 2026/1|2026-03-15|123.0|23.0|100.0|0.95", "FATURA_RECEBIDA|FT 2026/1|2026-03-15|150.0|13.0|137.0|0.95", "FATURA_RECEBIDA|X|5.0|5.0|0.95", ""))

# Rules over the tables' own texts, dates and amounts ------------------------------------

_ACCENTS = f"translate(regexp_replace({{0}}, '[\u0300-\u036f]', '', 'g'), '{text.MARKED}', '{text.PLAIN}')"
_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\s+', '_', 'g'), '[^a-z0-9_.-]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), ''), '_')"


def rule(name: str, table: str, key: str, column: Callable[[], Column], sql: str) -> None:
    """A query of one column over a whole table, and the rule in SQL."""
    add_raw(name, table, lambda d: d.select(key, column().alias("value")), f"SELECT {key}, {sql} AS value FROM {table}")


def whole(column: Column) -> Column:
    """What a rule makes of a whole text, by its hash."""
    return F.sha2(column, 256)


def table_sql(value: str, table: dict, otherwise: str = "NULL") -> str:
    return f"CASE {value} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())} ELSE {otherwise} END"


def first_sql(value: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    return f"CASE {' '.join(f"WHEN regexp_matches({value}, '{p}') THEN '{k}'" for k, p in rules)} ELSE {otherwise} END"


_TEXT = lambda: F.col("text")
_NULLS = "CASE WHEN doc_id % 11 <> 0 THEN text END"  # a rule for null is part of each
_SOME = lambda: F.expr(_NULLS)
rule("str_02_category_key", "documents", "doc_id", lambda: whole(text.category_key(_SOME())), f"sha256(lower({_ACCENTS.format(f"coalesce({_NULLS}, '')")}))")
rule("str_03_name_key", "documents", "doc_id", lambda: whole(text.name_key(_SOME())), f"sha256(trim(regexp_replace(lower({_ACCENTS.format(f"coalesce({_NULLS}, '')")}), '[^a-z0-9]+', ' ', 'g')))")
rule("str_05_path_slug", "documents", "doc_id", lambda: whole(text.path_slug(_TEXT())), f"sha256({_SLUG.format('text')})")
rule("str_06_category_slug", "pages", "page_id", lambda: text.category_slug(F.col("url")), _SLUG.format("replace(coalesce(url, ''), '/', '-')"))
_COUNTRY = "CASE lang WHEN 'es' THEN ' pt ' WHEN 'fr' THEN 'PT' WHEN 'de' THEN NULL ELSE upper(lang) END"
rule("str_11_origin", "documents", "doc_id", lambda: text.origin_label(F.expr(_COUNTRY)), f"CASE WHEN coalesce({_COUNTRY}, '') = '' THEN '' WHEN upper(trim({_COUNTRY})) = 'PT' THEN 'Nacional' ELSE 'Estrangeira' END")
_STOPPED = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TERMS = f"list_concat(list_filter(regexp_split_to_array(lower({_ACCENTS.format('text')}), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOPPED})), list_transform(regexp_extract_all(text, '\\b[A-Z0-9/-]{{3,}}\\b|\\b\\d{{2,}}\\b'), lambda w: lower(w)))"
add_raw("str_12_search_terms", "conversations", lambda d: d.select("conv_id", "turn", F.array_join(text.search_terms(F.col("text"), 10_000), ",").alias("value")), f"SELECT conv_id, turn, array_to_string(list_filter(t, lambda w, i: list_position(t, w) = i), ',') AS value FROM (SELECT conv_id, turn, {_TERMS} AS t FROM conversations)")
rule("str_17_csv_escape", "documents", "doc_id", lambda: whole(text.csv_escaped(_SOME())), f"""sha256(CASE WHEN regexp_matches({_NULLS}, '[";\\r\\n]') THEN concat('"', replace({_NULLS}, '"', '""'), '"') ELSE {_NULLS} END)""")
_NAME = "concat(CASE WHEN o_orderkey % 9 = 0 THEN '../' ELSE '' END, o_custkey, CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE '.' END, o_orderstatus, o_orderkey)"
rule("str_18_extension", "orders", "o_orderkey", lambda: text.extension(F.expr(_NAME)), f"CASE WHEN contains({_NAME}, '..') OR regexp_matches({_NAME}, '[/\\\\]') THEN '' ELSE regexp_extract(lower({_NAME}), '(\\.[a-z0-9]{{1,5}})$', 1) END")
_MIME = "concat(CASE WHEN value < 40 THEN 'IMAGE/' ELSE 'application/' END, CASE event_type WHEN 'click' THEN 'png' WHEN 'view' THEN 'pdf' WHEN 'error' THEN 'Jpg' WHEN 'signup' THEN 'msword' END)"
rule("str_19_mime_extension", "events", "event_id", lambda: text.mime_extension(F.expr(_MIME)), table_sql(f"lower({_MIME})", text.EXTENSIONS, "''"))
_GROUPED = "CASE WHEN abs({0}) < 10000 THEN replace(translate(format('{{:,.2f}}', {0}), ',.', '.,'), '.', '') ELSE translate(format('{{:,.2f}}', {0}), ',.', '.,') END"
rule("str_20_pt_amount", "orders", "o_orderkey", lambda: money.pt_amount(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice - 113000 ELSE o_totalprice END").cast("decimal(14,2)").cast("double")), _GROUPED.format("CAST(CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice - 113000 ELSE o_totalprice END AS DECIMAL(14,2)) AS DOUBLE)"))
add_raw("str_22_currency", "conversations", lambda d: d.select("conv_id", "turn", text.currency(F.concat("text", F.lit(" "), F.expr(_MONEY))).alias("value")), "SELECT conv_id, turn, " + first_sql("concat(text, ' ', {0})", text.CURRENCIES, "'EUR'").replace("{0}", "CASE conv_id % 5 WHEN 0 THEN '£' WHEN 1 THEN 'USD 5' WHEN 2 THEN 'sfr. 7' WHEN 3 THEN 'XGBP' ELSE '' END") + " AS value FROM conversations")
_MONEY = "CASE conv_id % 5 WHEN 0 THEN '£' WHEN 1 THEN 'USD 5' WHEN 2 THEN 'sfr. 7' WHEN 3 THEN 'XGBP' ELSE '' END"
rule("str_23_locale", "documents", "doc_id", lambda: text.locale(F.upper("lang")), f"CASE WHEN coalesce(lang, '') <> '' THEN {table_sql('upper(lang)', text.LOCALES, 'concat(lower(upper(lang)), chr(45), upper(lang))')} END")
add_raw("str_25_intent", "conversations", lambda d: d.select("conv_id", "turn", text.intent(F.col("text")).alias("value")), f"SELECT conv_id, turn, {first_sql('lower(text)', text.INTENTS, chr(39) + 'GENERAL' + chr(39))} AS value FROM conversations")
_CODED = "concat(text, ' atcud', CASE WHEN doc_id % 4 = 0 THEN '' ELSE ': ' END, upper(md5(text)), '-', doc_id)"
rule("str_26_atcud_asked", "documents", "doc_id", lambda: text.asked_atcud(F.expr(_CODED)), f"nullif(regexp_extract({_CODED}, '(?i)\\bATCUD[:\\s#]*([A-Z0-9-]+)', 1), '')")
rule("str_35_category_known", "part", "p_partkey", lambda: filing.known_category(F.expr("CASE WHEN p_size % 5 = 0 THEN 'Rendas' WHEN p_size % 5 = 1 THEN p_type WHEN p_size % 5 = 2 THEN 'Outras' END")), f"coalesce(CASE WHEN p_size % 5 = 0 THEN 'Rendas' WHEN p_size % 5 = 1 THEN p_type WHEN p_size % 5 = 2 THEN 'Outras' END IN ({', '.join(f"'{c}'" for c in filing.CATEGORIES)}), false)")
_LABEL = "concat(CASE o_orderpriority WHEN '1-URGENT' THEN 'Nota de Crédito' WHEN '2-HIGH' THEN 'debit-note' WHEN '3-MEDIUM' THEN 'Fatura ' WHEN '5-LOW' THEN 'proof of payment ' ELSE 'guia  transporte' END, CASE WHEN o_orderkey % 3 = 0 THEN cast(o_orderkey AS varchar(20)) ELSE '' END)"
_PLAINED = f"regexp_replace(regexp_replace({_ACCENTS.format(_LABEL)}, '[\\s_-]+', '_', 'g'), '\\W', '', 'g')"
_KNOWN_LABELS = {word: kind for kind, words_ in text.LABEL_TYPES.items() for word in words_.split()}
rule("str_32_label_type", "orders", "o_orderkey", lambda: text.label_type(F.expr(_LABEL)), f"CASE WHEN {_PLAINED} <> '' THEN coalesce({table_sql(f'upper({_PLAINED})', _KNOWN_LABELS)}, {first_sql(f'lower({_PLAINED})', text.LOOSE_TYPES, 'NULL')}) END")

# Dates and amounts as texts of the tables
_DAYS = "CASE o_orderkey % 5 WHEN 0 THEN {iso} WHEN 1 THEN {dmy} WHEN 2 THEN {dots} WHEN 3 THEN {short} ELSE concat({year}, '-02-30') END"
_SPARK_DAYS = _DAYS.format(iso="date_format(o_orderdate, 'yyyy-MM-dd')", dmy="date_format(o_orderdate, 'd/M/yyyy')", dots="date_format(o_orderdate, 'dd.MM.yyyy')", short="date_format(o_orderdate, 'dd-MM-yy')", year="year(o_orderdate)")
rule("dat_01_bank_date", "orders", "o_orderkey", lambda: dates.bank_date(F.expr(_SPARK_DAYS)), "CASE o_orderkey % 5 WHEN 3 THEN CAST(o_orderdate - INTERVAL 0 DAY AS DATE) + CASE WHEN year(o_orderdate) < 2000 THEN INTERVAL 100 YEAR ELSE INTERVAL 0 YEAR END WHEN 4 THEN NULL ELSE o_orderdate END::DATE")
_SAID = "CASE l_linenumber % 3 WHEN 0 THEN {iso} WHEN 1 THEN {dmy} ELSE {mdy} END"
_SPARK_SAID = _SAID.format(iso="date_format(l_shipdate, 'yyyy-M-d')", dmy="date_format(l_shipdate, 'd/M/yyyy')", mdy="date_format(l_shipdate, 'M.d.yyyy')")
_HOME = "CASE WHEN l_returnflag = 'R' THEN 'US' WHEN l_returnflag = 'A' THEN 'PT' END"
add_raw("dat_02_invoice_date", "lineitem", lambda d: d.select("l_orderkey", "l_linenumber", dates.invoice_date(F.expr(_SPARK_SAID), F.expr(_HOME)).alias("v")).select("l_orderkey", "l_linenumber", "v.date", "v.ambiguous"), """SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 THEN CAST(l_shipdate AS DATE) ELSE CAST(try_strptime(printf('%04d-%02d-%02d', y, CASE WHEN us OR (a <= 12 AND b > 12) THEN a ELSE b END, CASE WHEN us OR (a <= 12 AND b > 12) THEN b ELSE a END), '%Y-%m-%d') AS DATE) END AS date, k <> 0 AND a <= 12 AND b <= 12 AS ambiguous
FROM (SELECT *, l_linenumber % 3 AS k, year(l_shipdate) AS y, l_returnflag = 'R' AS us, CASE WHEN l_linenumber % 3 = 1 THEN day(l_shipdate) ELSE month(l_shipdate) END AS a, CASE WHEN l_linenumber % 3 = 1 THEN month(l_shipdate) ELSE day(l_shipdate) END AS b FROM lineitem)""")
rule("dat_03_qr_date", "orders", "o_orderkey", lambda: dates.qr_date(F.expr("concat(CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE '' END, date_format(o_orderdate, 'yyyyMMdd'), CASE WHEN o_orderkey % 7 = 0 THEN '0' ELSE '' END)")), "CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END")
_ASKING = "concat('quanto gastei {0} ', CASE o_custkey % 5 WHEN 0 THEN 'este mês' WHEN 1 THEN 'no proximo mes' WHEN 2 THEN 'o mês passado' WHEN 3 THEN concat('em ', month(o_orderdate) + 3, '/', year(o_orderdate) + 10) ELSE 'hoje' END)"
add_raw("dat_05_month_phrase", "orders", lambda d: d.select("o_orderkey", dates.month_phrase(F.expr(_ASKING), F.col("o_orderdate").cast("date")).alias("v")).select("o_orderkey", "v.start", "v.end"), """SELECT o_orderkey, CAST(s AS DATE) AS start, CAST(s + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS "end" FROM (SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN date_trunc('month', o_orderdate) WHEN 1 THEN date_trunc('month', o_orderdate) + INTERVAL 1 MONTH WHEN 2 THEN date_trunc('month', o_orderdate) - INTERVAL 1 MONTH
WHEN 3 THEN CASE WHEN month(o_orderdate) + 3 <= 12 AND year(o_orderdate) + 10 > 2000 THEN make_date(year(o_orderdate) + 10, month(o_orderdate) + 3, 1)::TIMESTAMP END END AS s FROM orders)""")
rule("dat_13_calendar_date", "orders", "o_orderkey", lambda: dates.calendar_date(F.expr("concat(year(o_orderdate), '-', lpad(month(o_orderdate), 2, '0'), '-', CASE WHEN o_orderkey % 9 = 0 THEN cast(day(o_orderdate) AS string) ELSE lpad(1 + o_custkey % 31, 2, '0') END)")), "CASE WHEN o_orderkey % 9 = 0 AND day(o_orderdate) < 10 THEN NULL ELSE CAST(try_strptime(concat(strftime(o_orderdate, '%Y-%m-'), CASE WHEN o_orderkey % 9 = 0 THEN day(o_orderdate) ELSE 1 + o_custkey % 31 END), '%Y-%m-%d') AS DATE) END")
_REGION = "CASE l_returnflag WHEN 'R' THEN 'pt-ac ' WHEN 'A' THEN 'MA' END"
_KIND_OF = "CASE l_linenumber WHEN 1 THEN 'normal' WHEN 2 THEN 'reduced' WHEN 3 THEN 'intermediate' WHEN 4 THEN 'exempt' ELSE l_linestatus END"
add_raw("mth_04_rates", "lineitem", lambda d: d.select("l_orderkey", "l_linenumber", money.region_of(F.expr(_REGION)).alias("region"), money.rate_of(F.expr(_KIND_OF), money.region_of(F.expr(_REGION))).alias("rate")), f"SELECT l_orderkey, l_linenumber, region, CASE {' '.join(f"WHEN region = '{r}' AND kind = '{k}' THEN {v}" for r, rates in money.VAT_RATES.items() for k, v in rates.items())} WHEN kind = 'exempt' THEN 0.0 END::DOUBLE AS rate FROM (SELECT *, {_KIND_OF} AS kind, CASE l_returnflag WHEN 'R' THEN 'AC' WHEN 'A' THEN 'MA' ELSE 'PT' END AS region FROM lineitem)")
_RATE = "floor(l_quantity / 2) + l_tax / 2"
add_raw("mth_06_bucket_kind", "lineitem", lambda d: d.select("l_orderkey", "l_linenumber", money.bucket_kind(F.expr(_RATE)).alias("kind")), f"SELECT l_orderkey, l_linenumber, CASE WHEN abs(r) <= 0.05 THEN 'exempt' WHEN abs(r - 6) <= 0.05 THEN 'reduced' WHEN abs(r - 13) <= 0.05 THEN 'intermediate' WHEN abs(r - 23) <= 0.05 OR abs(r - 16) <= 0.05 OR abs(r - 22) <= 0.05 THEN 'normal' ELSE 'other' END AS kind FROM (SELECT *, {_RATE} AS r FROM lineitem)")


def _written(separators: str) -> Callable[[], Column]:
    """A total as people write it, by the order's priority."""
    return lambda: F.expr(f"""CASE o_orderpriority WHEN '1-URGENT' THEN concat(translate(format_number(o_totalprice, 2), ',.', '{separators}'), ' €') WHEN '2-HIGH' THEN concat('EUR ', replace(format_string('%.2f', -o_totalprice), '.', '{separators[1]}'))
WHEN '3-MEDIUM' THEN cast(cast(floor(o_totalprice) AS bigint) AS string) WHEN '5-LOW' THEN o_orderstatus ELSE concat(cast(o_custkey AS string), '{separators[1]}5') END""")


rule("mth_07_bank_amount", "orders", "o_orderkey", lambda: money.bank_amount(_written(".,")()), "CASE o_orderpriority WHEN '1-URGENT' THEN CAST(printf('%.2f', o_totalprice) AS DOUBLE) WHEN '2-HIGH' THEN -CAST(printf('%.2f', o_totalprice) AS DOUBLE) WHEN '3-MEDIUM' THEN floor(o_totalprice) WHEN '5-LOW' THEN NULL ELSE o_custkey + 0.5 END::DOUBLE")
rule("mth_08_invoice_amount", "orders", "o_orderkey", lambda: money.invoice_amount(_written(",.")()), "CASE o_orderpriority WHEN '1-URGENT' THEN CAST(printf('%.2f', o_totalprice) AS DOUBLE) WHEN '2-HIGH' THEN -CAST(printf('%.2f', o_totalprice) AS DOUBLE) WHEN '3-MEDIUM' THEN floor(o_totalprice) WHEN '5-LOW' THEN NULL ELSE o_custkey + 0.5 END::DOUBLE")
rule("mth_09_model_number", "orders", "o_orderkey", lambda: money.model_number(_written(".,")()), "CASE o_orderpriority WHEN '1-URGENT' THEN CAST(printf('%.2f', o_totalprice) AS DOUBLE) WHEN '2-HIGH' THEN -CAST(printf('%.2f', o_totalprice) AS DOUBLE) WHEN '3-MEDIUM' THEN floor(o_totalprice) WHEN '5-LOW' THEN NULL ELSE o_custkey * 10 + 5 END::DOUBLE")
rule("mth_10_qr_amount", "orders", "o_orderkey", lambda: money.qr_amount(F.expr("concat(CASE WHEN o_orderkey % 3 = 0 THEN replace(format_string('%.2f', o_totalprice), '.', ',') WHEN o_orderkey % 3 = 1 THEN concat('  ', format_string('%.2f', -o_totalprice)) ELSE o_orderpriority END, o_orderstatus)")), "CASE WHEN o_orderkey % 3 = 0 THEN CAST(printf('%.2f', o_totalprice) AS DOUBLE) WHEN o_orderkey % 3 = 1 THEN -CAST(printf('%.2f', o_totalprice) AS DOUBLE) ELSE CAST(left(o_orderpriority, 1) AS DOUBLE) END")
_NUMBERED = "CASE WHEN event_id % 6 = 0 THEN 'NaN' WHEN event_id % 6 = 1 THEN '-Infinity' WHEN event_id % 6 = 2 THEN event_type WHEN event_id % 6 = 3 THEN concat(' ', event_id, 'e2 ') WHEN event_id % 6 = 4 THEN NULL ELSE cast(event_id AS varchar(20)) END"
rule("prj_11_finite_number", "events", "event_id", lambda: money.finite_number(F.expr(_NUMBERED)), "CASE event_id % 6 WHEN 3 THEN event_id * 100.0 WHEN 5 THEN event_id END::DOUBLE")
rule("mth_18_hamming", "orders", "o_orderkey", lambda: F.round(vectors.hamming(F.bin(F.col("o_orderkey") + 65536), F.bin(F.col("o_custkey") * 7 + 65536)), 4), "round(hamming(bin(o_orderkey + 65536), bin(o_custkey * 7 + 65536)) / 17.0::DOUBLE, 4)")
rule("mth_21_answer_confidence", "events", "event_id", lambda: money.answer_confidence(F.expr("CASE WHEN event_type = 'view' THEN 'LOOKUP' ELSE upper(event_type) END"), F.floor(F.col("value") / 10), F.expr("CASE WHEN user_id % 2 = 0 THEN 'anthropic' ELSE 'other' END")), "round(least(0.98, 0.7 + CASE WHEN user_id % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN floor(value / 10) >= 3 THEN 0.1 ELSE 0 END + CASE WHEN event_type = 'view' THEN 0.05 ELSE 0 END), 4)::DOUBLE")
rule("mth_22_risk_maps", "events", "event_id", lambda: F.concat_ws("/", money.severity(F.col("value") / 4), money.risk_level(F.col("value")), money.risk_action(money.risk_level(F.col("value")))), "concat_ws('/', CASE WHEN value / 4 >= 25 THEN 'CRITICAL' WHEN value / 4 >= 20 THEN 'HIGH' WHEN value / 4 >= 10 THEN 'MEDIUM' ELSE 'LOW' END, CASE WHEN value >= 50 THEN 'CRITICAL' WHEN value >= 30 THEN 'HIGH' WHEN value >= 15 THEN 'MEDIUM' ELSE 'LOW' END, CASE WHEN value >= 50 THEN 'block' WHEN value >= 30 THEN 'review' WHEN value >= 15 THEN 'flag' ELSE 'ignore' END)")

# Identifiers and payloads written from the tables
_NIF = "concat(CASE WHEN c_custkey % 4 = 0 THEN 'PT ' ELSE '' END, c_nationkey % 10, lpad(cast(c_custkey * 7919 % 100000000 AS varchar(20)), 8, '0'))"
_DIGITS = f"right({_NIF}, 9)"
_SUM9 = f"list_sum(list_transform(range(1, 9), lambda i: CAST(substr({_DIGITS}, CAST(i AS INTEGER), 1) AS INTEGER) * (10 - i))) % 11"
_CLASS_SQL = f"CASE WHEN left({_DIGITS}, 1) IN ('1', '2', '3') THEN 'pessoa_singular' WHEN left({_DIGITS}, 2) = '45' THEN 'nao_residente' WHEN left({_DIGITS}, 1) = '5' THEN 'pessoa_coletiva' WHEN left({_DIGITS}, 1) = '6' THEN 'administracao_publica' WHEN left({_DIGITS}, 2) IN ('70', '71', '72', '74', '75', '77', '78', '79') THEN 'heranca_ou_fundo' WHEN left({_DIGITS}, 1) IN ('8', '9') THEN 'irregular_ou_outro' END"
add_raw("fid_02_nif_class", "customer", lambda d: d.select("c_custkey", fiscal.nif_class(fiscal.nif_plain(F.expr(_NIF))).alias("kind"), fiscal.nif_valid(F.expr(_NIF)).alias("valid")), f"SELECT c_custkey, {_CLASS_SQL} AS kind, {_CLASS_SQL} IS NOT NULL AND CAST(right({_NIF}, 1) AS INTEGER) = CASE WHEN {_SUM9} < 2 THEN 0 ELSE 11 - {_SUM9} END AS valid FROM customer")
_FINAL = "CASE c_nationkey % 5 WHEN 0 THEN '999 999 990' WHEN 1 THEN NULL WHEN 2 THEN concat('PT', repeat('0', c_custkey % 10)) ELSE cast(c_custkey AS varchar(20)) END"
rule("fid_03_final_consumer", "customer", "c_custkey", lambda: fiscal.final_consumer(F.expr(_FINAL)), f"regexp_replace(upper(coalesce({_FINAL}, '')), '^PT|[\\s.\\-]', '', 'g') IN ({', '.join(f"'{x}'" for x in fiscal.FINAL_CONSUMER)})")
_TENANT = "CASE WHEN c_custkey % 3 = 0 THEN concat('35', lpad(cast(c_custkey AS varchar(20)), 9, '5')) WHEN c_custkey % 3 = 1 THEN concat('PT ', c_custkey, ' ', c_nationkey) END"
rule("fid_12_tenant_nif", "customer", "c_custkey", lambda: fiscal.tenant_nif(F.expr(_TENANT)), "CASE WHEN c_custkey % 3 = 0 THEN lpad(cast(c_custkey AS varchar(20)), 9, '5') WHEN c_custkey % 3 = 1 THEN concat(c_custkey, c_nationkey) ELSE '' END")
_PAYLOAD = "concat('A:', 500000000 + o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('*G:FT ', o_orderkey) END, '*O:', cast(cast(floor(o_totalprice) AS bigint) AS varchar(20)), CASE WHEN o_orderkey % 5 = 0 THEN '*A:1*Q:' ELSE '' END)"
rule("str_40_qr_field", "orders", "o_orderkey", lambda: F.concat_ws("|", *(fiscal.qr_field(F.expr(_PAYLOAD), k) for k in "GAOQ")), "concat_ws('|', CASE WHEN o_orderkey % 4 <> 0 THEN concat('FT ', o_orderkey) END, 500000000 + o_custkey, CAST(floor(o_totalprice) AS BIGINT))")
add_raw("src_06_qr_fields", "orders", lambda d: d.select("o_orderkey", fiscal.qr_fields(F.expr(_PAYLOAD)).alias("m")).select("o_orderkey", F.col("m")["A"].alias("a"), F.col("m")["G"].alias("g"), F.col("m")["O"].alias("o"), F.size("m").alias("n")), "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '1' ELSE CAST(500000000 + o_custkey AS VARCHAR) END AS a, CASE WHEN o_orderkey % 4 <> 0 THEN concat('FT ', o_orderkey) END AS g, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS o, CAST(2 + CASE WHEN o_orderkey % 4 <> 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n FROM orders")
rule("str_39_qr_likely", "orders", "o_orderkey", lambda: fiscal.qr_likely(F.expr(f"substring({_PAYLOAD}, 1 + o_custkey % 3, 8 + o_orderkey % 20)")), f"length(substr({_PAYLOAD}, CAST(1 + o_custkey % 3 AS BIGINT), CAST(8 + o_orderkey % 20 AS BIGINT))) >= 10 AND (regexp_matches(substr({_PAYLOAD}, CAST(1 + o_custkey % 3 AS BIGINT), CAST(8 + o_orderkey % 20 AS BIGINT)), '(^|\\*)A:\\d{{9}}') OR (contains(substr({_PAYLOAD}, CAST(1 + o_custkey % 3 AS BIGINT), CAST(8 + o_orderkey % 20 AS BIGINT)), 'A:') AND contains(substr({_PAYLOAD}, CAST(1 + o_custkey % 3 AS BIGINT), CAST(8 + o_orderkey % 20 AS BIGINT)), '*')))")
_ATCUD = "concat(CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE '' END, left(lower(hex(o_custkey * 104729 + 16777216)), CAST(4 + o_custkey % 5 AS INT)), '-', CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '' END, o_orderkey)"
add_raw("str_41_atcud", "orders", lambda d: d.select("o_orderkey", fiscal.atcud(F.expr(_ATCUD)).alias("v")).select("o_orderkey", "v.code", "v.sequence"), f"SELECT o_orderkey, CASE WHEN ok THEN split_part(u, '-', 1) END AS code, CASE WHEN ok THEN split_part(u, '-', 2) END AS sequence FROM (SELECT o_orderkey, u, regexp_matches(u, '^[A-Z0-9]{{6,10}}-\\d{{1,20}}$') AS ok FROM (SELECT o_orderkey, upper(trim({_ATCUD})) AS u FROM orders))")
rule("snk_07_qr_payload", "orders", "o_orderkey", lambda: fiscal.qr_payload(F.create_map(F.lit("a"), F.col("o_orderkey").cast("string"), F.lit("g"), F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("o"), F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")))), "concat('A:', o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN concat('*G:', o_orderstatus) ELSE '' END, CASE WHEN o_custkey % 3 <> 0 THEN concat('*O:', o_orderpriority) ELSE '' END)")

_FILED_AS = "concat(CASE event_type WHEN 'click' THEN 'ft_' WHEN 'view' THEN 'Recibo ' WHEN 'error' THEN 'guia-' WHEN 'signup' THEN 'nc' ELSE 'extrato' END, event_id, CASE WHEN user_id % 3 = 0 THEN ' contrato' ELSE '' END, '.pdf')"
add_raw("str_27_name_type", "events", lambda d: d.select("event_id", filing.name_type(F.expr(_FILED_AS)).alias("v")).select("event_id", "v.type", "v.confidence"), f"SELECT event_id, {first_sql(f'upper({_FILED_AS})', [(k, p) for k, p, _ in filing.NAME_TYPES], 'NULL')} AS type, CASE {' '.join(f"WHEN regexp_matches(upper({_FILED_AS}), '{p}') THEN {c}" for _, p, c in filing.NAME_TYPES)} END::DOUBLE AS confidence FROM events")
_CODE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'FT' WHEN '2-HIGH' THEN 'nc' WHEN '3-MEDIUM' THEN concat('F', o_orderstatus) WHEN '5-LOW' THEN 'RG' END"
rule("str_28_qr_class", "orders", "o_orderkey", lambda: filing.qr_class(F.expr(_CODE))["type"], f"CASE WHEN coalesce({_CODE}, '') <> '' THEN {table_sql(f'upper({_CODE})', filing.QR_CLASSES, chr(39) + 'FATURA_RECEBIDA' + chr(39))} END")
rule("str_33_qr_type", "orders", "o_orderkey", lambda: fiscal.qr_type(F.expr(_CODE)), table_sql(f"upper({_CODE})", fiscal.QR_TYPES))
_SPOKEN = "concat(text, CASE doc_id % 9 WHEN 0 THEN ' Extrato' WHEN 1 THEN ' FATURA simplificada' WHEN 2 THEN ' Nota de Crédito' WHEN 3 THEN ' guia de remessa' WHEN 4 THEN ' invoice, recibo' ELSE '' END)"
_SAYS = lambda words_: " OR ".join(f"contains(low, '{w}')" for w in words_)
add_raw("str_29_keyword_type", "documents", lambda d: d.select("doc_id", filing.keyword_type(F.expr(_SPOKEN)).alias("v")).select("doc_id", "v.type", "v.confidence"), f"""SELECT doc_id, split_part(k, ':', 1) AS type, CAST(split_part(k, ':', 2) AS DOUBLE) AS confidence FROM (SELECT doc_id, CASE WHEN {_SAYS(filing.INVOICE_WORDS)} THEN CASE WHEN contains(low, 'recibo') THEN 'FATURA_RECIBO:0.7' WHEN contains(low, 'simplificada') THEN 'FATURA_SIMPLIFICADA:0.75' ELSE 'FATURA_RECEBIDA:0.65' END
{' '.join(f"WHEN {_SAYS(w)} THEN '{k}:{c}'" for k, w, c in filing.KEYWORD_TYPES)} ELSE 'OUTRO:0.3' END AS k FROM (SELECT doc_id, lower(coalesce({_SPOKEN.replace('concat(text,', "concat(coalesce(text, ''),")}, '')) AS low FROM documents))""")
_SPENT = "concat(p_type, ' ', p_name, CASE p_size % 7 WHEN 0 THEN ' Restaurante' WHEN 1 THEN ' GASÓLEO' WHEN 2 THEN ' Serviços' WHEN 3 THEN ' Portagem' WHEN 4 THEN ' 62.2.1' ELSE '' END)"
rule("str_34_expense_category", "part", "p_partkey", lambda: filing.expense_category(F.expr(_SPENT)), f"CASE {' '.join(f"WHEN contains(lower({_ACCENTS.format(_SPENT)}), '{h}') THEN '{c}'" for h, c in filing.CATEGORY_HINTS)} END")

# Readings of a language model ---------------------------------------------------------

_ANSWERS = ['```json\n{"supplier":" Loja ","total":"1.234,56","taxAmount":23,"confidence":1.7,"notes":["a","b","c","d","e","f"],"lineItems":[{"description":"x","quantity":"2"},{}],"ivaBreakdown":[{"rate":23,"base":"100","tax":"23"},{"rate":6}],"cashDiscountRate":"2,5 %"}\n```', '{"total":12.34,"supplier":"","discountAmount":-1}', "no json"]
_READ = lambda: extraction.reading(pick(*_ANSWERS))
case("jsn_08_reading", lambda: F.concat_ws("|", *(_READ()[c].cast("string") for c in ("supplier", "total", "taxAmount", "confidence", "cashDiscountRate", "discountAmount")), F.size(_READ()["notes"]).cast("string"), F.size(_READ()["lineItems"]).cast("string"), F.size(_READ()["ivaBreakdown"]).cast("string")), of("Loja|1234.56|23.0|1.0|2.5|5|1|1", "12.34", ""))
case("jsn_09_usable", lambda: extraction.usable(F.get(F.array(*(F.lit(v).cast("double") for v in (5.0, None, 2e6, 5.0, None))), (F.col("id") % 5).cast("int")), pick("O:5.00", "", "", "A:1*O:20260315", None), F.col("id") % 5 == 4), of(True, False, False, False, True))
case("jsn_09_usable_fallback", lambda: extraction.usable_fallback(F.get(F.array(*(F.lit(v).cast("double") for v in (0.5, 0.0, 0.5, 0.5))), (F.col("id") % 4).cast("int")), F.lit(False), F.lit(None).cast("double"), F.lit(None).cast("double"), pick(None, None, "A:1*B:2*C:3*D:4", None), F.lit("PT5"), pick("Loja", "Loja", " ", None)), of(True, False, True, False))
_HINTS = lambda: extraction.provenance(F.array(F.lit("x"), pick("ai:gemini/flash", "ai:solo", "y"), F.lit("source:pdf_text")))
case("jsn_13_provenance", lambda: F.concat_ws("|", _HINTS()["provider"], _HINTS()["model"], _HINTS()["source"]), of("gemini|flash|pdf_text", "solo|pdf_text", "pdf_text"))
_STATUS = lambda: extraction.extraction_status(F.get(F.array(F.lit(0.5), F.lit(0.0), F.lit(0.9)), (F.col("id") % 3).cast("int")), F.col("id") % 2 == 0)
case("dml_12_extraction_status", lambda: F.concat_ws("|", _STATUS()["status"], _STATUS()["warning"]), "CASE WHEN id % 3 <> 1 AND id % 2 = 0 THEN 'EM_REVISAO' ELSE 'EM_REVISAO|no_signal' END")
_META = lambda: extraction.metadata(F.struct(F.col("id").alias("id")), F.array(pick("date_ambiguous:1/2/2026", "other")), F.concat(F.lit("text "), F.col("id")))
case("prj_13_metadata", lambda: F.concat_ws("|", F.get_json_object(_META(), "$.extraction.id"), F.get_json_object(_META(), "$.needsReview"), F.get_json_object(_META(), "$.preview")), "concat(id, '|', CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END, '|text ', id)")
case("prj_16_filing_metadata", lambda: F.array_join(F.array_sort(F.transform(F.map_entries(filing.filing_metadata(F.create_map(F.lit("folder"), F.lit("old"), F.lit("by"), F.lit("me")), "folder", pick("new", None))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ","), of("by=me,folder=new", "by=me"))


def _side(d: DataFrame, name: str) -> Column:
    """A reading for the merges: what it knows depends on the id."""
    some = lambda k, v: F.when(F.col("id") % k != 0, v)
    ai = name == "ai"
    return F.struct(
        some(3 if ai else 2, F.lit(f"{name} supplier")).alias("supplier"), F.lit(None).cast("string").alias("customer"), some(5, F.lit("500000000")).alias("supplier_nif"), F.lit(None).cast("string").alias("customer_nif"),
        some(4 if ai else 7, F.lit(f"{name} 1")).alias("number"), some(2, F.lit("2026-03-15")).alias("date"), some(3, F.lit("PT50")).alias("iban"), F.lit("EUR").alias("currency"),
        some(6 if ai else 5, F.lit(123.0)).alias("total"), some(2 if ai else 3, F.lit(23.0)).alias("tax"), F.lit(None).cast("double").alias("net"),
        (F.lit(0.5) + (F.col("id") % 4) * 0.1 if ai else F.lit(0.45)).alias("confidence"), (F.col("id") % 11 == 0).alias("partial"),
    )


def _told(s: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(s[c].cast("string"), F.lit("-")) for c in ("supplier", "number", "date", "total", "tax", "net")), F.format_string("%.2f", s["confidence"]))


_X = {k: f"CASE WHEN id % {m} <> 0 THEN {v} END" for k, (m, v) in {"as_": (3, "'ai supplier'"), "rs": (2, "'rx supplier'"), "an": (4, "'ai 1'"), "rn": (7, "'rx 1'"), "d": (2, "'2026-03-15'"), "at": (6, "123.0"), "rt": (5, "123.0"), "ax": (2, "23.0"), "rx": (3, "23.0")}.items()}
_F = "concat_ws('|', coalesce({s}, '-'), coalesce({n}, '-'), coalesce({d}, '-'), coalesce(CAST({t} AS VARCHAR), '-'), coalesce(CAST({x} AS VARCHAR), '-'), coalesce(CAST({e} AS VARCHAR), '-'), printf('%.2f', {c}))"
_MERGED = f"""SELECT id, {_F.format(s='s', n='n', d='d', t='t', x='x', e='CASE WHEN used AND t IS NOT NULL AND x IS NOT NULL THEN 100.0 END', c='CASE WHEN used THEN least(0.95, CASE WHEN rt IS NOT NULL AND t IS NOT NULL AND (id % 5 <> 0 OR n IS NOT NULL) AND d IS NOT NULL THEN greatest(c, 0.9) ELSE c END) ELSE least(0.39, c) END')} AS value
FROM (SELECT id, used, {_X['d']} AS d, {_X['rt']} AS rt, greatest(0.45, 0.5 + (id % 4) * 0.1) AS c, CASE WHEN used THEN coalesce({_X['as_']}, {_X['rs']}) ELSE {_X['rs']} END AS s, CASE WHEN used THEN coalesce({_X['an']}, {_X['rn']}) ELSE {_X['rn']} END AS n,
CASE WHEN used THEN coalesce({_X['at']}, {_X['rt']}) ELSE {_X['rt']} END AS t, CASE WHEN used THEN coalesce({_X['ax']}, {_X['rx']}) ELSE {_X['rx']} END AS x FROM (SELECT id, id % 11 <> 0 AND id % 4 >= 1 AS used FROM fiscal_document))"""
add("jsn_10_merged_reading", DOC, lambda d: extraction.merged_reading(d.select("id", _side(d, "ai").alias("ai"), _side(d, "rx").alias("rx"))).select("id", _told(F.col("fields")).alias("value")), _MERGED)
_QR_MERGED = f"""SELECT id, CASE WHEN id % 13 = 0 THEN {_F.format(s=_X['rs'], n=_X['rn'], d=_X['d'], t=_X['rt'], x=_X['rx'], e='NULL', c='0.45')} ELSE {_F.format(s='s', n='n', d='d', t='t', x='x', e='CASE WHEN t IS NOT NULL AND x IS NOT NULL THEN 100.0 END', c='least(0.99, CASE WHEN rt IS NOT NULL AND aat IS NOT NULL THEN greatest(c, 0.95) ELSE c END)')} END AS value
FROM (SELECT id, {_X['d']} AS d, {_X['rt']} AS rt, {_X['at']} AS aat, greatest(0.45, 0.5 + (id % 4) * 0.1) AS c, coalesce({_X['rs']}, {_X['as_']}) AS s, coalesce({_X['rn']}, {_X['an']}) AS n, coalesce({_X['rt']}, {_X['at']}) AS t, coalesce({_X['rx']}, {_X['ax']}) AS x FROM fiscal_document)"""
add("jsn_11_merged_qr", DOC, lambda d: extraction.merged_qr(d.select("id", F.when(F.col("id") % 13 != 0, _side(d, "ai")).alias("ai"), _side(d, "rx").alias("qr"))).select("id", _told(F.col("fields")).alias("value")), _QR_MERGED)


def _parties(d: DataFrame) -> DataFrame:
    return d.select(
        "id", pick("Minha Empresa Lda", "Fornecedor SA", "Fornecedor SA", "minha empresa lda e filhos", "X").alias("supplier"), pick("Outro", "Minha Empresa Lda", "Outro", "Outro", None).alias("customer"),
        pick("111111111", "500000000", "222222222", None, "500000000").alias("supplier_nif"), pick("333333333", "444444444", None, "", None).alias("customer_nif"), pick("A:111111111*B:500000000", None, None, None, None).alias("qr"),
    )


add("fid_11_party_swap", DOC, lambda d: extraction.party_swap(_parties(d), "PT500000000", "Minha Empresa Lda").select("id", "supplier", "customer", "supplier_nif", "customer_nif", "swapped"), f"""SELECT id, {of('Outro', 'Minha Empresa Lda', 'Fornecedor SA', 'Outro', 'X')} AS supplier, {of('Minha Empresa Lda', 'Fornecedor SA', 'Outro', 'minha empresa lda e filhos', None)} AS customer,
{of('333333333', '444444444', '222222222', '', '500000000')} AS supplier_nif, {of('111111111', '500000000', None, None, None)} AS customer_nif, {of('qr_b_matches_tenant_nif', 'supplier_nif_eq_tenant_nif', None, 'supplier_name_eq_tenant_name', None)} AS swapped FROM fiscal_document""")
add_raw("str_31_text_types", "documents", lambda d: d.select("doc_id", text.text_type(F.col("text")).alias("type"), text.currency(F.col("text")).alias("currency")), r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\b(nota\s*(de\s*)?cr[eé]dito|credit\s*note|gutschrift(-srechnung)?|avoir)\b') THEN 'NOTA_CREDITO' WHEN regexp_matches(text, '(?i)\b(nota\s*(de\s*)?d[eé]bito|debit\s*note|belastungsanzeige)\b') THEN 'NOTA_DEBITO'
WHEN regexp_matches(text, '(?i)\b(recibo|receipt|quittung|quittance|ricevuta|reçu)\b') THEN 'RECIBO' WHEN regexp_matches(text, '(?i)\b(fatura(\s*recebida)?|factura|facture|invoice|rechnung|fattura|nota\s*de\s*encomenda)\b') THEN 'FATURA_RECEBIDA' END AS type,
CASE WHEN regexp_matches(text, '\bGBP\b|£') THEN 'GBP' WHEN regexp_matches(text, '\bUSD\b|\$') THEN 'USD' WHEN regexp_matches(text, '(?i)\bCHF\b|\bSFr\.?\b') THEN 'CHF' ELSE 'EUR' END AS currency FROM documents""")
