"""Each signal of an anomaly alone, on rows that have it and rows that just don't."""

from __future__ import annotations

import datetime

import pytest

from contaflux.operators import anomalies, boards

NOW = datetime.date(2026, 6, 1)
DOCS = "id long, tenant_id long, party_id long, number string, file_hash string, total double, doc_date date, nif string, iban string, at timestamp, ip string"


def doc(id, tenant=1, party=1, number=None, hash="h", total=10.5, date=NOW, nif="500000000", iban=None, seconds=None, ip=None):
    at = None if seconds is None else datetime.datetime(2026, 6, 1) + datetime.timedelta(seconds=seconds)
    return (id, tenant, party, number, hash, total, date, nif, iban, at, ip)


@pytest.fixture
def frame(spark):
    return lambda *docs: spark.createDataFrame(list(docs), DOCS)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_numbers_and_amounts_twice(frame):
    docs = frame(doc(1, number="A", hash="x"), doc(2, number="A", hash="y"), doc(3, tenant=2, number="A", hash="z"), doc(4, number="B"), doc(5, number="B"), doc(6, number=" ", hash="p"), doc(7, number=" ", hash="q"), doc(8), doc(9, hash="r"))
    assert ids(anomalies.duplicate_numbers(docs)) == [1, 2]
    day = 86400
    docs = frame(doc(1, seconds=0), doc(2, seconds=day), doc(3, seconds=2 * day + 1), doc(4, party=2, seconds=5), doc(5, total=10.504, seconds=3 * day), doc(6, total=None, seconds=0), doc(7), doc(8, total=9.0, seconds=1), doc(9, total=9.0, seconds=1))
    assert ids(anomalies.duplicate_amounts(docs)) == [1, 2, 3, 5, 8, 9]


def test_tax_ibans_and_tax_numbers(spark, frame):
    items = spark.createDataFrame([(1, 100.0, 0.23, 23.0), (1, 10.0, 0.06, 0.61), (2, 100.0, 0.23, 23.02), (3, 100.0, 0.23, None), (4, 100.0, 0.23, 22.9), (4, 100.0, 0.23, 23.1)], "document_id long, base double, rate double, tax double")
    assert ids(anomalies.inconsistent_tax(items)) == [2]  # rounding of a cent a line is none; errors that cancel out are none
    known = spark.createDataFrame([(1, "PT50 0001"), (1, "pt500002"), (2, None), (3, " ")], "party_id long, iban string")
    docs = frame(doc(1, iban="pt50-0001"), doc(2, iban="PT500003"), doc(3, party=2, iban="PT9"), doc(4), doc(5, iban=""), doc(6, party=3, iban="PT9"), doc(7, party=9, iban="PT9"))
    assert ids(anomalies.unknown_ibans(docs, known)) == [2]
    assert ids(anomalies.missing_nifs(frame(doc(1), doc(2, nif="500000001"), doc(3, nif=None), doc(4, nif="PT 500 000 000")))) == [2, 3]


def test_bursts_of_one_address(frame):
    docs = [doc(i, seconds=55 + i, ip="a") for i in range(12)] + [doc(100 + i, seconds=30 * i, ip="b") for i in range(12)] + [doc(200 + i, seconds=1, ip=None) for i in range(12)] + [doc(300, ip="a")]
    assert ids(anomalies.bursts(frame(*docs), most=10, seconds=60)) == [10, 11]  # over the edge of a minute
    assert ids(anomalies.bursts(frame(*docs), most=2, seconds=60)) == [*range(2, 12), *range(102, 112)]


def test_dates_and_round_totals(frame):
    days = [(1, 30), (2, 31), (3, -730), (4, -731), (5, 0)]
    docs = frame(*(doc(i, date=NOW + datetime.timedelta(days=d)) for i, d in days), doc(6, date=None))
    assert ids(anomalies.odd_dates(docs, NOW)) == [2, 4]
    may = datetime.date(2026, 5, 3)
    docs = frame(doc(1, total=10.0), doc(2, total=20.0), doc(3, total=20.01), doc(4, total=30.0, date=may), doc(5, tenant=2, total=30.0), doc(6, total=None))
    assert ids(anomalies.round_amounts(docs)) == [1, 2]


def test_drift_leaves_the_row_itself_out(spark):
    near = [(i, "s", [1.0, 0.1 * i, 0.0]) for i in range(4)]
    rows = [*near, (9, "s", [0.0, 0.0, 1.0]), (20, "t", [1.0, 0.0]), (21, "t", [0.0, 1.0]), (30, "u", [1.0]), (31, "u", [-1.0]), (32, "u", [0.0]), (40, None, [1.0]), (41, "s", None), (42, "s", []), (43, "s", [float("nan"), 1.0, 1.0])]
    got = {r["id"]: r["distance"] for r in anomalies.drifts(spark.createDataFrame(rows, "id long, supplier string, vector array<float>")).collect()}
    assert set(got) == {0, 1, 2, 3, 9, 30, 31} and got[9] == 1.0 and max(got[i] for i in range(4)) < 0.2 and got[30] == got[31] == 2.0


def test_all_signals_of_a_document(spark, frame):
    docs = frame(doc(1, number="A", hash="x", total=5.0), doc(2, number="A", hash="y", total=6.0, nif=None, date=datetime.date(2020, 1, 1)), doc(3), doc(3))
    items = spark.createDataFrame([(1, 1.0, 0.23, 9.0), (77, 1.0, 0.23, 9.0)], "document_id long, base double, rate double, tax double")
    none = spark.createDataFrame([], "party_id long, iban string"), spark.createDataFrame([], "id long, supplier string, vector array<float>")
    got = anomalies.signals(docs, items, *none, NOW)
    assert sorted((r["id"], tuple(r["signals"])) for r in got.collect()) == [(1, ("DUPLICATE_NUMBER", "INCONSISTENT_TAX")), (2, ("DATE_ANOMALY", "DUPLICATE_NUMBER", "MISSING_NIF")), (3, ()), (3, ())]
    assert {r["id"]: (r["score"], r["level"]) for r in boards.anomalies(got).collect()} == {1: (55, "CRITICAL"), 2: (50, "CRITICAL"), 3: (0, "LOW")}
    assert anomalies.signals(docs.limit(0), items, *none, NOW).count() == 0
