"""Values that are known by hand, for the functions whose queries run over the tables."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from contaflux.functions import dates, fiscal, money, text, vectors
from contaflux.operators import filing

CASES = {}


def pick(*values):
    """One of the values, by the id."""
    return F.get(F.array(*map(F.lit, values)), (F.col("id") % len(values)).cast("int"))


def of(*values):
    return list(values)


def case(name, column, expected):
    CASES[name] = (column, expected)


_DATE = lambda: dates.invoice_date(pick("2026-3-5", "05/03/2026", "03/15/2026", "31.02.2026", "5-3-2026", "x"), pick("PT", "US", None, "PT", "PT", "PT"))
_MONTH = lambda: dates.month_phrase(pick("quanto este mês?", "no proximo mes", "o mês passado", "em 02/2024", "em 13/2024", "hoje"), F.lit(datetime.date(2026, 1, 31)))
case("str_02_category_key", lambda: text.category_key(pick("Refeições", "ÁGUA Fria", None)), of("refeicoes", "agua fria", ""))
case("str_03_name_key", lambda: text.name_key(pick("  João & Filhos, Lda.", "", None, "ÉVORA-Sul")), of("joao filhos lda", "", "", "evora sul"))
case("str_05_path_slug", lambda: text.path_slug(pick("Águas do Porto", "a__b  c", "//", "_x_")), of("guas_do_porto", "a_b_c", "_", "x"))
case("str_06_category_slug", lambda: text.category_slug(pick("Rendas/Casa", "Outras", None)), of("rendas-casa", "outras", "_"))
case("str_11_origin", lambda: text.origin_label(pick("PT", " pt ", "ES", "", None)), of("Nacional", "Nacional", "Estrangeira", "", ""))
case("str_12_search_terms", lambda: F.array_join(text.search_terms(pick("Quanto gastei na EDP em FT 2026/12?", "mostra faturas", "Energia energia 77")), ","), of("gastei,edp,2026,2026/12", "", "energia,77"))
case("str_17_csv_escape", lambda: text.csv_escaped(pick('a"b', "a;b", "plain", "x\ny")), of('"a""b"', '"a;b"', "plain", '"x\ny"'))
case("str_18_extension", lambda: text.extension(pick("a.PDF", "../x.pdf", "noext", "a.", "long.abcdef", "a.b.Jpg")), of(".pdf", "", "", "", "", ".jpg"))
case("str_19_mime_extension", lambda: text.mime_extension(pick("application/pdf", "IMAGE/JPG", "text/plain", None)), of(".pdf", ".jpg", "", ""))
case("str_20_pt_amount", lambda: money.pt_amount(F.get(F.array(F.lit(1234.5), F.lit(12345.678), F.lit(0.5)), (F.col("id") % 3).cast("int"))), of("1234,50", "12.345,68", "0,50"))
case("str_22_currency", lambda: text.currency(pick("total £5", "USD 5", "SFr. 10", "10 EUR")), of("GBP", "USD", "CHF", "EUR"))
case("str_23_locale", lambda: F.concat_ws("/", text.locale(text.currency_country(pick("GBP", "USD", "CHF", "EUR"))), text.locale(pick("PT", "IE", "BR", None))), of("en-GB/pt-PT", "us-US/en-IE", "ch-CH/br-BR", ""))
case("str_25_intent", lambda: text.intent(pick("Qual o TOTAL?", "mostra a fatura ft 1", "comparar meses", "há algo estranho?", "explica isto", "proximo mês", "há duplicados?", "estado atual", "que tipo é", "exporta csv", "bom dia")), of("AGGREGATION", "LOOKUP", "COMPARISON", "ANOMALY", "EXPLANATION", "PREDICTION", "DUPLICATE_CHECK", "STATUS", "CLASSIFY", "EXPORT", "GENERAL"))
case("str_26_atcud_asked", lambda: text.asked_atcud(pick("qual o ATCUD: ABCD1234-9?", "nada")), of("ABCD1234-9", None))
case("str_32_label_type", lambda: text.label_type(pick("Nota de Crédito", "debit-note", "Reçu", "Fatura-Recibo n.º FT 2026/1", "fatura emitida", "packing slip", "??", None, "order", "proof of payment")), of("NOTA_CREDITO", "NOTA_DEBITO", "RECIBO", "RECIBO", "FATURA_EMITIDA", "GUIA_TRANSPORTE", None, None, "ENCOMENDA", "COMPROVATIVO"))
case("str_35_category_known", lambda: filing.known_category(pick("Rendas", "rendas", None, "Outras")), of(True, False, False, True))
case("str_39_qr_likely", lambda: fiscal.qr_likely(pick("A:500000000*B:1", "fatura A: 1 * 2", "A:12", "sem nada de nada")), of(True, True, False, False))
case("str_40_qr_field", lambda: F.concat_ws("|", fiscal.qr_field(pick("A:5*O:12.5*H:", "O:1*A:2", "x"), "O"), fiscal.qr_field(pick("A:5*O:12.5*H:", "O:1*A:2", "x"), "A")), of("12.5|5", "1|2", ""))
case("str_41_atcud", lambda: F.concat_ws("|", fiscal.atcud(pick("J66S9FDD-1", "abcdef-123", "SHORT-1", "ABCDEFG-"))["code"], fiscal.atcud(pick("J66S9FDD-1", "abcdef-123", "SHORT-1", "ABCDEFG-"))["sequence"]), of("J66S9FDD|1", "ABCDEF|123", "", ""))
case("dat_01_bank_date", lambda: F.date_format(dates.bank_date(pick("2026-03-15", "15/03/26", "31.02.2026", "1-3-2026", "x")), "yyyy-MM-dd"), of("2026-03-15", "2026-03-15", None, "2026-03-01", None))
case("dat_02_invoice_date", lambda: F.concat_ws("|", F.date_format(_DATE()["date"], "yyyy-MM-dd"), _DATE()["ambiguous"].cast("string")), of("2026-03-05|false", "2026-05-03|true", "2026-03-15|false", "false", "2026-03-05|true", "false"))
case("dat_03_qr_date", lambda: dates.qr_date(pick("20260315", "20269999", "2026", None)), of("2026-03-15", "2026-99-99", None, None))
case("dat_05_month_phrase", lambda: F.concat_ws("|", F.date_format(_MONTH()["start"], "yyyy-MM-dd"), F.date_format(_MONTH()["end"], "yyyy-MM-dd")), of("2026-01-01|2026-01-31", "2026-02-01|2026-02-28", "2025-12-01|2025-12-31", "2024-02-01|2024-02-29", "", ""))
case("dat_13_calendar_date", lambda: F.date_format(dates.calendar_date(pick("2024-02-29", "2023-02-29", "2024-2-9", "x")), "yyyy-MM-dd"), of("2024-02-29", None, None, None))
case("mth_04_rates", lambda: F.concat_ws("/", money.region_of(pick("PT-AC", "ma", "XX", None)), money.rate_of(pick("normal", "reduced", "exempt", "odd"), money.region_of(pick("PT-AC", "ma", "XX", None))).cast("string")), of("AC/16.0", "MA/5.0", "PT/0.0", "PT"))
case("mth_06_bucket_kind", lambda: money.bucket_kind(F.get(F.array(*map(F.lit, [0.0, 6.04, 13.0, 23.0, 16.0, 22.0, 9.0])), (F.col("id") % 7).cast("int"))), of("exempt", "reduced", "intermediate", "normal", "normal", "normal", "other"))
case("mth_07_bank_amount", lambda: money.bank_amount(pick("1.234,56 €", "-45,90", "abc", "EUR 5")), of(1234.56, -45.9, None, 5.0))
case("mth_08_invoice_amount", lambda: money.invoice_amount(pick("1.234,56", "1,234.56", "1.234", "12,5", "x")), of(1234.56, 1234.56, 1234.0, 12.5, None))
case("mth_09_model_number", lambda: money.model_number(pick("1.234", "12,34", "12.5", "1.234,56")), of(1234.0, 12.34, 125.0, 1234.56))
case("mth_10_qr_amount", lambda: money.qr_amount(pick("12,5", "7.25x", "x", None)), of(12.5, 7.25, None, None))
case("mth_18_hamming", lambda: F.round(vectors.hamming(pick("0000", "0101", "11"), pick("0001", "1010", "11")), 4), of(0.25, 1.0, 0.0))
case("prj_11_finite_number", lambda: money.finite_number(pick("1.5", " 2e3 ", "NaN", "Infinity", "x", None)), of(1.5, 2000.0, None, None, None, None))
case("fid_02_nif_class", lambda: F.concat_ws(":", fiscal.nif_class(pick("123456789", "450000001", "500000000", "600000001", "720000001", "999999990", "400000000")), fiscal.nif_valid(pick("123456789", "450000001", "500000000", "600000001", "720000001", "999999990", "400000000")).cast("string")), of("pessoa_singular:true", "nao_residente:true", "pessoa_coletiva:true", "administracao_publica:true", "heranca_ou_fundo:false", "irregular_ou_outro:true", "false"))
case("fid_03_final_consumer", lambda: fiscal.final_consumer(pick("", "0", "999 999 990", "500000000", None)), of(True, True, True, False, True))
case("fid_12_tenant_nif", lambda: fiscal.tenant_nif(pick("PT 500 000 000", "35500000000", "12", None)), of("500000000", "500000000", "12", ""))
case("src_06_qr_fields", lambda: F.concat_ws("|", fiscal.qr_fields(pick("a:1*A:2*B:x:y", "none"))["A"], fiscal.qr_fields(pick("a:1*A:2*B:x:y", "none"))["B"]), of("2|x:y", ""))

_KIND = lambda s: F.concat_ws(":", s["type"], s["confidence"].cast("string"))
case("str_27_name_type", lambda: _KIND(filing.name_type(pick("ft_2026.pdf", "Fatura.pdf", "nc 12.pdf", "dua.pdf", "guia-1.pdf", "contrato.pdf", "foto.png", "extrato.pdf", "fs 1.pdf", "encomenda.pdf"))), of("FATURA_RECEBIDA:0.8", "FATURA_RECEBIDA:0.8", "NOTA_CREDITO:0.75", "DUA_IMPORTACAO:0.9", "GUIA_TRANSPORTE:0.75", "CONTRATO:0.85", "", "EXTRATO_BANCARIO:0.85", "FATURA_SIMPLIFICADA:0.8", "ENCOMENDA:0.8"))
case("str_28_qr_class", lambda: _KIND(filing.qr_class(pick("FT", "fs", "FR", "NC", "ND", "RC", "ZZ", None))), of("FATURA_RECEBIDA:0.95", "FATURA_SIMPLIFICADA:0.95", "FATURA_RECIBO:0.95", "NOTA_CREDITO:0.95", "NOTA_DEBITO:0.95", "RECIBO_PAGAMENTO:0.95", "FATURA_RECEBIDA:0.95", ""))
case("str_29_keyword_type", lambda: _KIND(filing.keyword_type(pick("Factura recibo", "INVOICE 1", "fatura simplificada", "recibo", "nota de crédito", "bank statement", "guia de remessa", "remuneração", "bom dia"))), of("FATURA_RECIBO:0.7", "FATURA_RECEBIDA:0.65", "FATURA_SIMPLIFICADA:0.75", "RECIBO_PAGAMENTO:0.65", "NOTA_CREDITO:0.7", "EXTRATO_BANCARIO:0.75", "GUIA_TRANSPORTE:0.7", "RECIBO_VENCIMENTO:0.7", "OUTRO:0.3"))
case("str_33_qr_type", lambda: fiscal.qr_type(pick("FT", "fr", "NC", "ND", "RG", "XX")), of("FATURA_RECEBIDA", "FATURA_RECEBIDA", "NOTA_CREDITO", "NOTA_DEBITO", "RECIBO", None))
case("str_34_expense_category", lambda: filing.expense_category(pick("Restaurante O Mar", "GASÓLEO", "Hotel Central", "Portagem A1", "Toner", "62.2.1 Honorários", "MEO fibra", "Arrendamento", "Seguro", "62.2.4")), of("Refeições", "Combustível", "Alojamento", "Deslocações", "Material de escritório", "Serviços/FSE", "Comunicações", "Rendas", None, "Refeições"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_golden(spark, name):
    column, expected = CASES[name]
    got = [r[0] for r in spark.range(len(expected)).coalesce(1).orderBy("id").select(column()).collect()]
    assert got == [v if not isinstance(v, bool) else v for v in expected]


def test_rules_of_scores(spark):
    row = spark.range(1).select(money.answer_confidence(F.lit("LOOKUP"), F.lit(3), F.lit("anthropic")), money.answer_confidence(F.lit("X"), F.lit(2), F.lit("o")), money.severity(F.lit(20)), money.risk_level(F.lit(50)), money.risk_action(money.risk_level(F.lit(15)))).first()
    assert tuple(row) == (0.95, 0.7, "HIGH", "CRITICAL", "flag")


def test_lists_of_items_and_missing_keys(spark):
    from contaflux.operators import boards, lists

    items = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "c"), (2, 1, "x"), (None, 1, "n")], "doc long, line int, text string")
    got = {r["doc"]: (r["n"], [tuple(i) for i in r["items"]]) for r in lists.nested(items, "doc", ["line", "text"], most=2).collect()}
    assert got == {1: (3, [(1, "a"), (2, "b")]), 2: (1, [(1, "x")])}  # a null parent is none
    keys = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert sorted((r[0] for r in lists.missing(keys(1, 2, None), keys(2, 2, 3, None)).collect()), key=str) == [1, None]
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 4), (3, "b", 1), (4, "a", None)], "id long, g string, at int")
    assert {r["id"]: r["previous_id"] for r in lists.previous(rows, "g", ["at", "id"]).collect()} == {1: 2, 2: 4, 3: None, 4: None}
    assert [r["id"] for r in lists.page_nulls_last(rows, "at", ["id"], 1, 3).collect()] == [2, 1, 4]
    ranks = boards.nearest_ranks(rows, "g", "at", {"half": 0.5, "all": 1.0}).collect()
    assert {r["g"]: (r["half"], r["all"]) for r in ranks} == {"a": (5, 5), "b": (1, 1)}
    nets = spark.createDataFrame([(123.0, 23.0), (10.0, 12.0), (None, 1.0), (1.0, None), (0.305, 0.1)], "t double, x double").select(money.net_of(F.col("t"), F.col("x"))).collect()
    assert [r[0] for r in nets] == [100.0, 0.0, None, None, 0.21]


def test_balanced_objects_against_letter_by_letter():
    import random
    import time

    from contaflux.operators.extraction import balanced

    def plain(text):
        start = text.find("{")
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)) if start >= 0 else ():
            c = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return text[start : i + 1]
        return None

    rng = random.Random(3)
    for _ in range(20000):
        text = "".join(rng.choice('{}"\\a\n') for _ in range(rng.randint(0, 14)))
        assert balanced(text) == plain(text), repr(text)
    assert balanced("<think>{}</think>x{1}<think>") == "{1}" and balanced(None) is None
    began = time.time()
    for text in ("<think>" * 300_000, "{" * 2_000_000, '{"' + "a" * 2_000_000, '{"' + "\\" * 1_000_001, "{" + '"a"' * 500_000):
        assert balanced(text) is None
    assert time.time() - began < 15
