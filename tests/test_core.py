"""The library's own operators: every query against its DuckDB twin, golden values, files and streams."""

from __future__ import annotations

import datetime
import itertools
import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from contaflux.functions import dates, fiscal, money, text, vectors
from contaflux.operators import audit, boards, extraction, lists, parties, reconcile, retrieval, tax
from contaflux.plans import registry
from contaflux.sources import bank, sepa
from contaflux.streaming import events as streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, int):
        return f"{v:.6f}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:19]
    try:
        return f"{float(v):.6f}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    if name not in registry.ORACLES:
        assert columns
        return
    cursor = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())
    assert len(rows) == len(want)
    assert rows == want


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def values(spark, build, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r["x"] for r in rows.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def test_amount_parsers(spark):
    assert values(spark, money.bank_amount, ["-45,90", "1.500,00", " 2 500,00 € ", "x", ""]) == [-45.9, 1500.0, 2500.0, None, None]
    assert values(spark, money.invoice_amount, ["1.234,56", "1,234.56", "1.234", "12,5", "1234.56"]) == [1234.56, 1234.56, 1234.0, 12.5, 1234.56]
    assert values(spark, money.model_number, ["12,50", "1.234", "12.5", "1.234,56"]) == [12.5, 1234.0, 125.0, 1234.56]
    assert one(spark, money.round2(F.lit(-2.505))) == -2.5
    assert values(spark, lambda v: money.pt_amount(v.cast("double")), ["1234.5", "12345.678"]) == ["1234,50", "12.345,68"]


def test_identifiers(spark):
    ibans = ["PT50000201231234567890154", "PT77003506510000000000739", "PT50 0002 0123 1234 5678 9015 5", "", None]
    assert values(spark, fiscal.iban_valid, ibans) == [True, True, False, False, False]
    assert values(spark, fiscal.nif_valid, ["PT 500 000 000", "123456789", "500000001", None]) == [True, True, False, False]
    assert values(spark, text.masked_iban, ["PT50000201231234567890154", "short"]) == ["PT50••••0154", "short"]


def test_fiscal_qr(spark):
    raw = "A:500000000*B:123456789*C:PT*D:FT*E:N*F:20260315*G:FT2026/1*H:J66S9FDD-1*I1:PT*I7:100.00*I8:23.00*N:23.00*O:123.00*Q:abcd*R:1234"
    got = spark.createDataFrame([(raw,), ("Q:x",), (None,), ("A:1*a:2:3",)], "r string").select(fiscal.qr_parsed(F.col("r")).alias("p"), fiscal.qr_breakdown(F.col("r")).alias("b")).collect()
    p = got[0]["p"]
    assert (p["issuer_nif"], p["total"], p["total_tax"], p["document_date"]) == ("500000000", 123.0, 23.0, "2026-03-15")
    assert got[0]["b"][0]["region"] == "PT" and got[0]["b"][0]["base_normal"] == 100.0 and got[0]["b"][0]["tax_normal"] == 23.0
    assert got[1]["p"] is None and got[2]["p"] is None and got[3]["p"]["issuer_nif"] == "2:3"


def test_dates(spark):
    assert [str(d) for d in values(spark, dates.bank_date, ["2026-03-15", "15/03/2026", "15-03-26", "31.02.2026"])] == ["2026-03-15", "2026-03-15", "2026-03-15", "None"]
    jan31 = F.lit(datetime.date(2026, 1, 31))
    assert [str(d) for d in one(spark, dates.recurrences(jan31, 1, F.lit(datetime.date(2026, 5, 1))))] == ["2026-01-31", "2026-03-03", "2026-04-03"]
    assert str(one(spark, dates.business_days_later(F.lit(datetime.date(2026, 3, 13)), 2))) == "2026-03-17"


def test_text_keys(spark):
    assert values(spark, text.name_key, ["  Águas & Cª, Lda. "]) == ["aguas c lda"]
    assert values(spark, text.path_slug, ["A b/C", "///"]) == ["a_bc", "_"]
    assert values(spark, lambda v: text.filled(v, {"Ano": F.lit("2026")}), ["{Ano}/{Mes}"]) == ["2026/_Mes_"]
    assert values(spark, text.search_terms, ["Qual o total da fatura FT-12 de março"])[0] == ["total", "marco", "ft-12"]
    assert values(spark, text.search_terms, ["ver ABCdef hoje 2026"])[0] == ["ver", "abcdef", "hoje", "2026"]


def test_vat_golden(spark):
    docs = spark.createDataFrame([(1, "FATURA_EMITIDA", 123.0), (2, "FATURA_RECEBIDA", 226.0), (3, "FATURA_EMITIDA", 61.5), (4, "NOTA_CREDITO", 12.3)], "id int, type string, total double")
    items = spark.createDataFrame([(1, 123.0, 23.0), (2, 226.0, 13.0), (3, 61.5, 23.0), (4, 12.3, 23.0)], "document_id int, total double, tax_rate double")
    got = {r["rate"]: r for r in tax.vat_by_rate(docs, items).collect()}
    assert (got[23.0]["output_base"], got[23.0]["output_tax"], got[23.0]["document_count"]) == (140.0, 32.2, 3)
    assert (got[13.0]["input_base"], got[13.0]["input_tax"]) == (200.0, 26.0)


def test_income_tax_golden(spark):
    day = datetime.date(2026, 2, 1)
    journal = spark.createDataFrame([(1, 1000.0, 0.0, day), (2, 500.0, 100.0, day), (3, 200.0, 50.0, day)], "account_id int, debit double, credit double, date date")
    accounts = spark.createDataFrame([(1, "62", "a", True), (2, "63", "b", True), (3, "68", "c", True)], "id int, code string, name string, active boolean")
    r = tax.income_tax(journal, accounts, 2026).first()
    assert (r["total"], r["income_tax"], r["autonomous_tax"]) == (1550.0, 325.5, 155.0)


def test_match_tiers(spark):
    day = datetime.date(2026, 1, 1)
    tx = [(1, 1, 10.0, day, " REF-999", "x"), (2, 1, 77.0, day, None, "TRF 12345 OBRIGADO"), (3, 1, 150.50, day, None, "m"), (4, 1, 33.0, datetime.date(2026, 4, 1), None, "m")]
    docs = [(1, 1, 99.0, day, "ref-999"), (2, 1, 500.0, day, "12345"), (3, 1, 150.49, day, "zz9"), (4, 1, 33.0, day, "zz8"), (5, 2, 150.50, day, "other tenant")]
    got = reconcile.candidates(
        spark.createDataFrame(tx, "id int, tenant_id int, amount double, date date, reference string, description string"), spark.createDataFrame(docs, "id int, tenant_id int, total double, doc_date date, doc_number string")
    )
    assert sorted((r["tx_id"], r["document_id"], r["match_type"], r["score"]) for r in got.collect()) == [(1, 1, "STRONG", 1.0), (2, 2, "MEDIUM", 0.85), (3, 3, "WEAK", 0.8)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_forecast_golden(spark):
    deals = spark.createDataFrame([(1, 1, 1000.0, datetime.date(2026, 3, 9), "QUALIFIED")], "id int, contact_id int, value double, expected date, stage string")
    got = boards.forecast(deals, datetime.date(2026, 3, 1)).orderBy("month").collect()
    assert len(got) == 6 and got[0]["weighted"] == 400.0 and got[1]["deals"] == 0


def test_contact_passes_are_greedy(spark):
    rows = [(1, "9", "a@x", "Ana", "1"), (2, "9", "b@x", "Rui", "2"), (3, "7", "a@x", "Eva", "3"), (4, "6", "c@x", "Eva", "3")]
    got = parties.contact_clusters(spark.createDataFrame(rows, "id int, nif8 string, email string, name string, phone string"))
    assert sorted((r["id"], r["reason"]) for r in got.collect()) == [(1, "nif"), (2, "nif"), (3, "name"), (4, "name")]


def test_merge_fills_only_what_is_empty(spark):
    master = spark.createDataFrame([(1, " ", "m@x")], "id int, name string, email string")
    duplicates = spark.createDataFrame([(1, 8, "Late", "d@x"), (1, 7, "", "e@x"), (1, 9, "Later", None)], "master_id int, id int, name string, email string")
    assert tuple(parties.merged(master, duplicates, ["name", "email"]).first()) == (1, "Late", "m@x")


def test_chain_finds_tampering(spark):
    rows = spark.createDataFrame([(t, i, datetime.datetime(2026, 1, 1, 0, i % 7), f"p{i}") for t in range(3) for i in range(20)], "tenant_id long, id long, created_at timestamp, payload string")
    log = rows.join(audit.appended(rows), ["tenant_id", "id"])
    assert audit.broken(log).count() == 0
    bad = log.withColumn("payload", F.when((F.col("tenant_id") == 1) & (F.col("id") == 5), "forged").otherwise(F.col("payload")))
    assert [tuple(r) for r in audit.broken(bad).collect()] == [(1, 5)]
    got = {r["tenant_id"]: r for r in audit.verified(bad).collect()}
    assert got[1]["first_broken"] == 5 and got[0]["broken"] == 0


def test_bank_csv(spark, tmp_path):
    path = tmp_path / "bank.csv"
    path.write_text("Data;Descrição;Valor;Saldo;Referência\n15/03/2026;A;-45,90;1234,56;R1\n16/03/2026;B;1500,00;;R2\n31/02/2026;C;1,00;;\n17/03/2026;D;-200,00;;\n", encoding="utf-8")
    rows, rejects = bank.csv_rows(spark, str(path), {"date": "data", "description": "Descrição", "amount": "VALOR", "balance": "Saldo", "reference": "Referência"})
    got = rows.orderBy("date").collect()
    assert [r["amount"] for r in got] == [-45.9, 1500.0, -200.0] and got[0]["balance"] == 1234.56 and got[2]["reference"] is None
    assert rejects.count() == 1 and len({r["import_hash"] for r in got}) == 3
    bank.write_csv(rows, str(tmp_path / "out"))
    body = "".join(p.read_bytes().decode() for p in Path(tmp_path / "out").glob("*.csv"))
    assert "17/03/2026;D;-200,00" in body and "\r\n" in body


def test_camt(spark, tmp_path):
    entry = "<Ntry><Amt Ccy='EUR'>12.50</Amt><CdtDbtInd>DBIT</CdtDbtInd><BookgDt><Dt>2026-03-15</Dt></BookgDt><NtryDtls><TxDtls><Refs><EndToEndId>E1</EndToEndId></Refs><RltdPties><Cdtr><Nm>Loja</Nm></Cdtr></RltdPties></TxDtls></NtryDtls></Ntry>"
    (tmp_path / "s.xml").write_text(f"<Document><Stmt>{entry}{entry.replace('12.50', 'x')}</Stmt></Document>")
    got = bank.camt_rows(spark, str(tmp_path / "s.xml")).collect()
    assert len(got) == 1 and float(got[0]["amount"]) == -12.5 and got[0]["counterparty"] == "Loja" and got[0]["end_to_end_id"] == "E1"


def test_sepa(spark):
    rows = spark.createDataFrame([(1, 10.0, "A & B", "PT50000201231234567890154", "x" * 200), (2, 5.0, "C", "PT00", "y")], "id int, amount double, name string, iban string, remittance string")
    got = sepa.transfers(rows)
    assert tuple(sepa.header(got).first()) == (1, 10.0)
    assert "A &amp; B" in got.where("id = 1").first()["xml"] and "x" * 141 not in got.first()["xml"]


def test_vectors_and_context(spark):
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in v.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]
    results = spark.createDataFrame([(0, "a" * 30), (1, "a" * 30), (2, "b" * 20), (3, "c")], "rank int, content string")
    assert [r["rank"] for r in retrieval.context(results, 10).orderBy("rank").collect()] == [0]


def test_streams_equal_batches(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(rows.schema).parquet(str(source))
    query = streams.bursts(stream, "user_id", 1, "60 minutes", "30 minutes").writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.table("bursts").collect()}
    assert got == {tuple(r) for r in streams.bursts(rows, "user_id", 1, "60 minutes", "30 minutes").collect()}


def test_every_order_is_a_bank_movement(spark):
    from contaflux.plans import domain

    bank_rows = domain.view(spark, SF, "bank_transaction")
    assert bank_rows.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    bare = bank_rows.where("id % 3 = 2")  # amount-only movements
    assert bare.count() > 0 and bare.where("reference IS NOT NULL OR description NOT LIKE 'MOV %'").count() == 0
    # Candidates by amount alone, against brute force.
    docs = [(d["id"], d["tenant_id"], d["total"], d["doc_date"]) for d in domain.view(spark, SF, "fiscal_document").select("id", "tenant_id", "total", "doc_date").collect()]
    found = {r["tx_id"] for r in reconcile.candidates(bare, domain.view(spark, SF, "fiscal_document")).select("tx_id").collect()}
    want = {t["id"] for t in bare.collect() if any(t["tenant_id"] == tenant and abs(abs(t["amount"]) - total) < 0.005 and abs((t["date"] - day).days) <= 30 for _, tenant, total, day in docs)}
    assert want and want <= found


def test_nearest_rank_holds_no_group_as_one_array(spark):
    rows = [("A", 10), ("A", 10), ("A", 20), ("A", 30), ("A", None), ("B", 5), ("C", None), *(("D", i // 3) for i in range(100))]
    got = registry._nearest_rank(spark.createDataFrame(rows, "status string, due_date int"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    want = {}
    for status in "ABCD":
        v = sorted(d for s, d in rows if s == status and d is not None)
        want[status] = (v[math.floor(len(v) * 0.5)], v[min(math.floor(len(v) * 0.95), len(v) - 1)]) if v else (None, None)
    assert {r["status"]: (r["p50"], r["p95"]) for r in got.collect()} == want


def golden(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_match_tiers_golden(spark):
    day = datetime.date(2026, 3, 1)
    tx = "id long, tenant_id long, amount double, date date, reference string, description string"
    ent = "id long, tenant_id long, amount double, date date, ref string, text string, document_id long"
    cases = [  # movement (amount, date, reference, description), entity (amount, date, reference, text), wanted
        ((5.0, day, " ref-999 ", "x"), (9.0, day, "REF-999", None), ("STRONG", 1.0)),
        ((5.0, day, "A-1", "x"), (5.0, None, "B-2", None), ("WEAK", 0.6)),
        ((5.0, day, None, "PAG 12345 LOJA"), (9.0, day, "12345", None), ("MEDIUM", 0.85)),
        ((5.0, day, "FT 77", "x"), (9.0, day, None, "pagamento da ft 77 hoje"), ("MEDIUM", 0.8)),
        ((5.0, day, None, "AB"), (5.0, day, "AB", None), ("WEAK", 0.8)),
        ((-5.0, day, None, "compra na loja azul"), (5.0, day + datetime.timedelta(3), None, "LOJA azul"), ("WEAK", 0.9)),
        ((5.0, day, None, "compra Lisboa"), (5.0, day + datetime.timedelta(4), None, "Lisboa centro"), ("WEAK", 0.8)),
        ((5.0, day, None, "x y"), (5.0, day + datetime.timedelta(8), None, "zz"), ("WEAK", 0.6)),
        ((5.0, day, None, "x"), (5.0, day + datetime.timedelta(47), None, None), None),
        ((150.50, day, None, "x"), (150.49, day, None, None), ("WEAK", 0.8)),
        ((100.01, day, None, "x"), (100.00, day, None, None), None),
    ]
    txs = spark.createDataFrame([(i, i, *c[0]) for i, c in enumerate(cases)], tx)
    ents = spark.createDataFrame([(100 + i, i, *c[1], None) for i, c in enumerate(cases)], ent)
    found = reconcile.matches(txs, reconcile.entities(ents, "x", amount="amount", date="date", description="text", reference="ref", document="document_id"))
    got = {r["tx_id"]: (r["match_type"], r["score"]) for r in found.collect()}
    assert got == {i: c[2] for i, c in enumerate(cases) if c[2]}
    assert reconcile.matches(txs.limit(0), reconcile.entities(ents, "x", amount="amount", date="date")).count() == 0


def test_decisions_on_suggestions(spark):
    rows = spark.createDataFrame([(1, 7, 70, "PENDING"), (2, 7, 71, "PENDING"), (3, 8, 72, "ACCEPTED"), (4, 9, 73, "PENDING"), (5, 9, 74, "PENDING")], "id long, tx_id long, document_id long, status string")
    after = reconcile.decided(rows, spark.createDataFrame([(2, True), (3, False), (5, False), (5, False)], "id long, accept boolean"))
    assert {r["id"]: r["status"] for r in after.collect()} == {1: "REJECTED", 2: "ACCEPTED", 3: "ACCEPTED", 4: "PENDING", 5: "REJECTED"}


def test_tenant_guards(spark):
    rows = spark.createDataFrame([(1, 1), (2, None)], "id long, tenant_id long")
    assert [r["tenant_id"] for r in lists.for_tenant(rows, 1).orderBy("id").collect()] == [1, 1]
    with pytest.raises(Exception, match="another tenant"):
        lists.for_tenant(rows.withColumn("tenant_id", F.lit(2).cast("long")), 1).collect()
    with pytest.raises(ValueError):
        lists.of_tenant(rows, None)


def test_sepa_rejects_what_is_too_long(spark):
    rows = spark.createDataFrame([(1, 1.0, "N" * 71, "PT50000201231234567890154", ""), (2, -1.0, "A", "PT50000201231234567890154", None), (3, 1.0, " ", "PT50.0002.0123.1234.5678.9015.4", None)], "id int, amount double, name string, iban string, remittance string")
    assert {r["id"]: r["fault"] for r in sepa.transfers(rows).collect()} == {1: "name too long", 2: "amount", 3: "name missing"}
    with pytest.raises(ValueError):
        sepa.message(rows, rows, "m" * 36, "p", datetime.datetime(2026, 1, 1))


def test_search_as_people_type_it(spark):
    assert retrieval.web_query('a "b c" -d or e') == [[["a"], ["b", "c"], ["-d"]], [["e"]]]
    assert retrieval.web_query("  or ") == []
    rows = spark.createDataFrame([(1, "alfa beta"), (2, "beta gama"), (3, None)], "id int, text string").withColumn("v", retrieval.search_vector(F.col("text")))
    assert [r["id"] for r in retrieval.full_text(rows, "beta -gama", "v", ["text"]).collect()] == [1]
    assert retrieval.full_text(rows, '"', "v", ["text"]).count() == 0


def test_chunks_split_a_text_once(spark):
    df = spark.range(1).select(text.chunks(F.lit("a b c")).alias("c"), text.chunks(F.col("id").cast("string")).alias("d"))
    assert df.select("d")._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert df.first()["c"] == ["a b c"] and spark.range(1).select(text.chunks(F.lit(None).cast("string")).alias("c")).first()["c"] == []


def test_clusters_read_their_input_once(spark):
    plan = parties.contact_clusters(spark.read.parquet(f"{SF}/customer.parquet").selectExpr("c_custkey AS id", "c_name AS nif8", "c_name AS email", "c_name AS name", "c_name AS phone"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 1 and "Join" not in plan


def test_effective_mapping_and_missing_columns(spark):
    assert bank.effective_mapping({"date": "Data"}, {"dateColumn": "x", "amountColumn": "Valor"}) == {"date": "Data", "amount": "Valor"}
    with pytest.raises(ValueError, match="nope"):
        bank.mapped(spark.range(1), {"a": "nope"})


def test_breakdown_rounds_half_cents_as_sql_does(spark, duck):
    docs = spark.sql("SELECT id, CAST(array() AS array<struct<rate:double,base:double,tax:double>>) AS explicit, 23.0D AS tax, 100.0D AS net FROM range(5)")
    amounts = [4.75, 7.75, 15.25, 36.25, 39.75]  # 6 % of each ends in half a cent
    lines = spark.createDataFrame([(i, 6.0, 3.0, a / 3.0, 0.0, a * (1 + 6.0 / 100)) for i, a in enumerate(amounts)], "document_id long, rate double, quantity double, price double, discount double, line_total double")
    got = {r.document_id: (r.base, r.tax) for r in extraction.breakdown(docs, lines).collect()}
    assert got == {i: (a, duck.execute("SELECT round(?::DOUBLE * 6.0 / 100, 2)", [a]).fetchone()[0]) for i, a in enumerate(amounts)}


def test_breakdown_adds_lines_in_their_order(spark):
    amounts = [41342.93, 29799.86, 86915.46]  # 6 % of their sum is 9483.495 or just under it, by the order
    orders = list(itertools.permutations(range(3)))
    docs = spark.sql("SELECT id, CAST(array() AS array<struct<rate:double,base:double,tax:double>>) AS explicit, 23.0D AS tax, 100.0D AS net FROM range(6)")
    rows = [(i, 6.0, 1.0, a, 0.0, a, order.index(j)) for i, order in enumerate(orders) for j, a in enumerate(amounts)]
    lines = spark.createDataFrame(rows, "document_id long, rate double, quantity double, price double, discount double, line_total double, position long")
    want = {}
    for i, order in enumerate(orders):
        base = part = 0.0
        for j in order:
            base, part = base + amounts[j], part + amounts[j] * 6.0 / 100
        want[i] = (math.floor(base * 100 + 0.5) / 100, math.floor(part * 100 + 0.5) / 100)
    assert len({t for _, t in want.values()}) == 2
    for dealt in (lines, lines.repartition(7, "position"), lines.orderBy(F.desc("position"))):
        assert {r.document_id: (r.base, r.tax) for r in extraction.breakdown(docs, dealt).collect()} == want
    free = [extraction.breakdown(docs, x.drop("position")).select("base", "tax").distinct().count() for x in (lines, lines.repartition(5))]
    assert free == [1, 1]  # without positions one order holds for all
