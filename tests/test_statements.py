"""Statement files of mixed dialects, their rejects, and exports."""

from __future__ import annotations

import datetime

import pytest

from contaflux.plans import exchange
from contaflux.sources import bank, statements

MAPPING = {"date": "data", "description": "Descrição", "amount": "VALOR", "balance": "saldo", "reference": "Ref"}
FILES = {
    "a.csv": "﻿Data;Descrição;Valor;Saldo;Ref\r\n01/02/2026;Café; -1.234,56 €;10,00;R1\r\n\r\n2026-02-03;\"a;b\nc\";5;;  \r\n".encode(),
    "b.csv": 'Ref,Data,"Descrição",VALOR\nX,05-02-26,"said ""hi"", twice",7\nY,31/02/2026,bad,1\nZ,06.02.2026,worse,abc\nW,07/02/2026\n'.encode(),
    "c.csv": "Data\tDescrição\tValor\textra\n08/02/2026\tçã\t1,5\tx\ttoo\tlong\n".encode("cp1252"),
    "d.csv": b" \n\n",
    "e.csv": b"Date;What;Sum\n01/01/2026;x;1\n02/01/2026;y;2\n",
    "f.csv": b"Data;Descri\xc3\xa7\xc3\xa3o;Valor\n",
}
DAY = lambda d, m=2: datetime.date(2026, m, d)


def written(tmp_path, files):
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    return str(tmp_path)


def test_a_folder_of_mixed_files(spark, tmp_path):
    rows, rejects = statements.read(spark, written(tmp_path, FILES), MAPPING)
    got = {(r["file"][-5:], r["line"]): (r["date"], r["description"], r["amount"], r["balance"], r["reference"]) for r in rows.collect()}
    assert got == {
        ("a.csv", 2): (DAY(1), "Café", -1234.56, 10.0, "R1"), ("a.csv", 4): (DAY(3), "a;b\nc", 5.0, None, None),
        ("b.csv", 2): (DAY(5), 'said "hi", twice', 7.0, None, "X"), ("c.csv", 2): (DAY(8), "çã", 1.5, None, None),
    }
    assert {(r["file"][-5:], r["line"], r["reason"]) for r in rejects.collect()} == {
        ("b.csv", 3, 'date "31/02/2026"'), ("b.csv", 4, 'amount "abc"'), ("b.csv", 5, 'amount ""'), ("d.csv", 0, "empty file"),
        ("e.csv", 0, "no column data, descrição, valor"), ("f.csv", 0, "no rows"),
    }
    raw = {r["file"][-5:]: r["raw"] for r in rows.where("file LIKE '%c.csv'").collect()}
    assert raw["c.csv"] == {"Data": "08/02/2026", "Descrição": "çã", "Valor": "1,5", "extra": "x"}
    assert rows.select("import_hash").distinct().count() == 4


def test_without_a_header_by_debit_and_credit(spark, tmp_path):
    path = written(tmp_path, {"g.csv": b"01/02/2026;rent;500,00;\n02/02/2026;pay;;1.000,5\n03/02/2026;nil\n"})
    rows, rejects = statements.read(spark, path, {"date": "Col1", "description": "col2", "debit": "COL3", "credit": "Col4"}, header=False)
    assert sorted((r["line"], r["description"], r["amount"]) for r in rows.collect()) == [(1, "rent", -500.0), (2, "pay", 1000.5), (3, "nil", 0.0)]
    assert rejects.count() == 0
    rows, _ = statements.read(spark, written(tmp_path, {"g.csv": b"2026-02-01,x,\"1,234.5\"\n"}), {"date": "col1", "description": "col2", "amount": "col3"}, header=False, decimal=".", thousand=",")
    assert [r["amount"] for r in rows.collect()] == [1234.5]


@pytest.mark.parametrize("mapping", [None, {}, {"date": "a", "description": "b"}, {"date": "a", "amount": "c"}, {"date": "a", "description": "b", "debit": "c"}, {"date": " ", "description": "b", "amount": "c"}])
def test_a_mapping_that_cannot_do(spark, tmp_path, mapping):
    with pytest.raises(ValueError, match="no column mapped"):
        statements.read(spark, str(tmp_path), mapping)


def test_dialects():
    assert [statements.delimiter(x) for x in ("a;b,c", "a,b,c;d", "a\tb", "one", "")] == [";", ",", "\t", ";", ";"]
    assert statements.decoded("é".encode("utf-16")) == "é" and statements.decoded(b"\xe9") == "é"
    sep, names, found, wrong = statements.parsed(b'a;b\n"open;1\n')
    assert (sep, names, wrong) == (";", ["a", "b"], None) and found == [(2, ["open;1\n"])]


def test_an_export_is_one_ordered_file(spark, tmp_path):
    rows = [(i, datetime.date(2026, 1, 1 + i % 3), f'say "{i}"; ok' if i == 4 else f"m{i}", -1234.5 + i, None if i % 2 else f"R{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "id int, date date, description string, amount double, reference string").repartition(4)
    statements.export(df, str(tmp_path / "out"), most=6)
    files = list((tmp_path / "out").glob("part-*"))
    assert len(files) == 1
    raw = files[0].read_bytes().decode()
    lines = raw.removesuffix("\r\n").split("\r\n")
    assert lines[0] == "﻿" + ";".join(statements.EXPORTED)
    assert [line.split(";")[0] for line in lines[1:]] == ["2", "5", "1", "4", "7", "0"]
    assert lines[4] == '4;02/01/2026;"say ""4""; ok";-1230,50;;R4;;;;'
    back, rejects = statements.read(spark, str(tmp_path / "out"), {"date": "Data", "description": "Descrição", "amount": "Valor", "reference": "Referência"})
    assert back.count() == 6 and rejects.where("reason <> 'empty file'").count() == 0


def test_an_entry_of_several_transactions(spark, tmp_path):
    details = lambda n: f"<TxDtls><Refs><EndToEndId>E{n}</EndToEndId></Refs><RltdPties><Dbtr><Nm>D{n}</Nm></Dbtr></RltdPties><RmtInf><Ustrd>U{n}</Ustrd></RmtInf></TxDtls>"
    (tmp_path / "s.xml").write_text(f'<Document><Stmt><Ntry><Amt Ccy="EUR">1.234,50</Amt><CdtDbtInd>CRDT</CdtDbtInd><BookgDt><Dt>2026-01-02</Dt></BookgDt><NtryDtls>{details(1)}{details(2)}</NtryDtls></Ntry></Stmt></Document>')
    (entry,) = bank.camt_rows(spark, str(tmp_path / "s.xml")).collect()
    assert (float(entry["amount"]), entry["end_to_end_id"], entry["counterparty"], entry["remittance"], entry["transactions"]) == (1234.5, "E1", "D1", "U1", 2)


def test_statement_files_of_tasks_without_rows(spark):
    """Filtered tables often leave a first task without rows."""
    t = spark.range(3, 40).selectExpr("id", "1.5D AS amount", "DATE'2026-01-02' AS date", "'x' AS description")
    t = spark.range(0).selectExpr("id", "1.5D AS amount", "DATE'2026-01-02' AS date", "'x' AS description").repartition(1).unionByName(t)
    rows = statements.records(spark, exchange._files(t))
    assert rows.where("wrong IS NOT NULL").count() == 0
    assert {r["delimiter"]: r["count"] for r in rows.groupBy("delimiter").count().collect()} == {";": 18, ",": 19}


def test_a_file_is_parsed_record_by_record():
    import tracemalloc

    raw = "Data;Descrição;Valor\n".encode() + b"01/02/2026;some words of a movement;1,5\n" * 100_000
    tracemalloc.start()
    sep, names, found, n, wrong = statements.streamed(raw)
    assert sum(1 for _ in found) == n == 100_000 and (sep, names[0], wrong) == (";", "Data", None)
    assert tracemalloc.get_traced_memory()[1] < len(raw) + (4 << 20)
    tracemalloc.stop()
