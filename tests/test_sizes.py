"""What steps cost that grow with their tables: read from plans and from what is shuffled."""

import datetime

from pyspark.sql import functions as F

from contaflux.functions import fiscal
from contaflux.operators import anomalies, extraction, reconcile
from contaflux.streaming import state


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_have_a_needles_shape(spark):
    rows = spark.createDataFrame([("trf pag ft 1996/123456 obrigado",), ("mov 123456",), ("",), (None,), ("ß1/𝄞 22/333333",)], "text string")
    got = [r[0] for r in rows.select(reconcile.windows(F.col("text"), ["0.000000"])).collect()]
    assert got == [["6/123456"], [], [], None, ["2/333333"]]
    many = [f"{'a' * i}{'.' * (8 - i)}"[:7] + "0" for i in range(8)] + [f"{i:b}".zfill(6).replace("1", "a") + "00" for i in range(40)]
    assert len(rows.select(reconcile.windows(F.col("text"), many)).first()[0]) > 4  # the last letter alone decides


def test_contained_is_what_contains_says(spark):
    needles = [(1, 1, "ft 1996/1234567"), (1, 2, "1996/12"), (1, 3, "abc"), (1, 4, "ab"), (1, 5, "ção nº 77"), (2, 6, "ft 1996/1234567"), (1, 7, None), (1, 8, "\n\n12345678"), (1, 9, "𝄞𝄞𝄞")]
    texts = [(1, 1, "x ft 1996/12345678 ft 1996/12345678"), (1, 2, "abcabc"), (2, 3, "ft 1996/1234567"), (1, 4, "a ção nº 77 b"), (1, 5, None), (1, 6, "\n\n\n12345678"), (1, 7, "𝄞𝄞𝄞𝄞"), (1, 8, "ab")]
    got = reconcile.contained(spark.createDataFrame(needles, "tenant int, nid int, needle string"), spark.createDataFrame(texts, "tenant int, tid int, text string"))
    want = [(n, t) for a, n, needle in needles for b, t, text in texts if a == b and needle and text and len(needle) >= 3 and needle in text]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pairs_are_hashed_not_sorted(spark):
    day = datetime.date(2026, 1, 1)
    bank = spark.createDataFrame([(i, 1, a, day, None, "x") for i, a in enumerate((0.07, 0.08, 0.15, 0.159, 7.995, 8.0, 100.0, -100.0))], "id long, tenant_id int, amount double, date date, reference string, description string")
    against = reconcile.entities(bank.withColumn("amount", F.col("amount") + 0.0), "doc", amount="amount", date="date")
    found = reconcile.matches(bank, against)
    assert "SortAggregate" not in plan_of(found)
    amounts = {r["id"]: abs(r["amount"]) for r in bank.collect()}
    want = sorted((a, b) for a in amounts for b in amounts if abs(amounts[a] - amounts[b]) < 0.01)
    assert sorted((r["tx_id"], r["entity_id"]) for r in found.collect()) == want


def test_fields_look_at_the_text_once(spark):
    rows = spark.createDataFrame([("NIF: 500 000 000\nFT 2026/1\n01/02/2026\nIVA 23% 1.234,50\nTotal: EUR 6.601,90",)], "text string")
    found = rows.select(extraction.fields(F.col("text")).alias("f"))
    assert plan_of(found).count("amount due") == 1
    f = found.first()["f"]
    assert (f["nif"], f["number"], f["total"], f["tax"], f["confidence"]) == ("500000000", "FT 2026/1", 6601.9, 1234.5, 0.85)


def test_payload_pairs_are_split_once(spark):
    rows = spark.createDataFrame([("A:1* a :2*b:x:y*:z*c*B:",), (None,), ("",), ("A:1\n*A:",)], "raw string")
    fields = rows.select(fiscal.qr_fields(F.col("raw")).alias("f"))
    assert plan_of(fields).count("substring_index") == 1
    assert [r["f"] for r in fields.collect()] == [{"A": "2", "": "z", "B": ""}, {}, {}, {"A": ""}]


def test_signals_are_bits_of_a_number(spark):
    day, kind = datetime.date(2026, 1, 1), "id long, tenant_id int, party_id int, number string, file_hash string, total double, doc_date date, nif string, iban string, at timestamp, ip string"
    docs = spark.createDataFrame([(i, 1, 1, None, "h", 1.5, d, n, None, None, None) for i, d, n in ((1, day, "500000000"), (1, day, "500000001"), (2, day, "500000000"), (None, day, "1"), (None, day, None), (3, None, "1"), (4, datetime.date(1990, 1, 1), None))], kind)
    items = spark.createDataFrame([(9, 100.0, 0.23, 1.0), (2, 100.0, 0.23, 1.0)], "document_id long, base double, rate double, tax double")
    none = spark.createDataFrame([], "id long, supplier int, vector array<double>")
    got = anomalies.signals(docs, items, spark.createDataFrame([], "party_id int, iban string"), none, day)
    assert "ObjectHashAggregate" not in plan_of(got).split("Union")[0]
    assert sorted(((r["id"] or 0), r["signals"]) for r in got.collect()) == [(0, []), (0, []), (1, ["MISSING_NIF"]), (1, ["MISSING_NIF"]), (2, ["INCONSISTENT_TAX"]), (3, ["MISSING_NIF"]), (4, ["DATE_ANOMALY", "MISSING_NIF"])]


def test_many_vectors_of_a_supplier_are_parts(spark):
    rows = spark.createDataFrame([(i, i % 3, [float(i % 7), float(i % 5), 1.0]) for i in range(40)] + [(100, 8, [1.0, 1.0, 1.0])], "id long, supplier int, vector array<double>")
    want = sorted(map(tuple, anomalies.drifts(rows).collect()))
    assert len(want) == 40
    for most in (1, 4, 13):
        assert sorted(map(tuple, anomalies.drifts(rows, most).collect())) == want


def test_a_key_asks_its_state_once():
    calls = []

    class Grant:
        value = (1, 0)
        exists = lambda self: calls.append("exists") or self.value is not None
        get = lambda self: calls.append("get") or self.value
        update = lambda self, value: calls.append("update") or setattr(self, "value", value)
        clear = lambda self: calls.append("clear") or setattr(self, "value", None)

    class Handle:
        registerTimer = lambda self, at: calls.append("register")
        deleteTimer = lambda self, at: calls.append("delete")

    tokens = state.Tokens(1_000_000, [])
    tokens.grant, tokens.handle = Grant(), Handle()
    rows = [{"id": i, "at": i * 400_000, "use": i % 3 == 0} for i in range(2, 50)]
    got = [(r["grant_id"], r["use_id"], r["outcome"]) for r in tokens.handleInputRows(("k",), iter(rows), None)]
    assert got[:3] == [(1, None, "replaced"), (2, 3, "used"), (4, None, "replaced")]
    assert len(calls) <= 5 and tokens.grant.value == (49, 49 * 400_000)


def test_stores_are_set_for_streams_only(spark):
    before = {name: spark.conf.get(name, None) for name in state._STORES}
    with state.stateful(spark):
        assert all(spark.conf.get(name) == value for name, value in state._STORES.items())
        assert spark.conf.get("spark.sql.streaming.join.stateFormatVersion") == "3"
    assert {name: spark.conf.get(name, None) for name in state._STORES} == before
