"""Bank statements as CSV, each file in its own dialect, with what can't be read kept aside.

Files come through Spark's binary reader, so any store that Spark reads will do, and each is parsed by
one task, record by record: a statement is a file of one account, not a table. A file tells its own delimiter, byte
order mark and encoding; quotes may hold delimiters and line ends; rows may be short or long.
"""

from __future__ import annotations

import codecs
import csv
import io
import itertools
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contaflux.functions.dates import bank_date
from contaflux.functions.money import bank_amount
from contaflux.functions.vectors import row_hash

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DELIMITERS = ";,\t"
#: A file of more bytes is a reject as a whole; tasks hold one file.
MOST_BYTES = 64 << 20
#: Bytes that are looked at at once to tell an encoding.
CHUNK = 1 << 20
#: An export has the newest movements, up to so many.
MOST_EXPORTED = 10_000
EXPORTED = ["ID", "Data", "Descrição", "Valor", "Saldo", "Referência", "Contraparte", "Origem", "Lote", "Importado em"]


def delimiter(line: str) -> str:
    """The delimiter of a file by its first line: the one that is there most often, ; wins ties."""
    counts = [line.count(d) for d in DELIMITERS]
    return DELIMITERS[counts.index(max(counts))] if max(counts) else ";"


def encoding(raw: bytes) -> tuple[str, str]:
    """UTF-8 with or without a mark, UTF-16 with one, else Windows-1252; and what to do about errors."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16", "replace"
    decoder = codecs.getincrementaldecoder("utf-8-sig")()
    try:
        for a in range(0, len(raw), CHUNK):
            decoder.decode(raw[a : a + CHUNK])
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return "cp1252", "replace"
    return "utf-8-sig", "strict"


def decoded(raw: bytes) -> str:
    return raw.decode(*encoding(raw))


def _lines(raw: bytes, form: tuple[str, str]) -> io.TextIOWrapper:
    return io.TextIOWrapper(io.BytesIO(raw), form[0], form[1], newline="")


def _each(raw: bytes, form: tuple[str, str], sep: str) -> Iterator[tuple[int, list[str]]]:
    """The records that aren't blank, one at a time, with the line on which each begins."""
    csv.field_size_limit(MOST_BYTES)
    line, reader = 1, csv.reader(_lines(raw, form), delimiter=sep)
    for fields in reader:
        if any(f.strip() for f in fields):
            yield line, fields
        line = reader.line_num + 1


def streamed(raw: bytes, header: bool = True) -> tuple[str, list[str], Iterator[tuple[int, list[str]]], int, str | None]:
    """(delimiter, names, (line, fields) one at a time, how many, what is wrong with the file).

    The file is read through once for what must be known beforehand and then again for its records,
    so that neither its text nor its records are held as a whole."""
    form = encoding(raw)
    first = next((x for line in _lines(raw, form) for x in line.splitlines() if x.strip()), None)
    if first is None:
        return ";", [], iter(()), 0, "empty file"
    sep, n, most, names = delimiter(first), 0, 0, []
    try:
        for _, fields in _each(raw, form, sep):
            names = fields if not n else names
            n, most = n + 1, max(most, len(fields))
    except csv.Error as error:
        return sep, [], iter(()), 0, f"unreadable: {error}"
    names = [x.strip().strip('"') for x in names] if header else [f"Col{i + 1}" for i in range(most)]
    skipped = 1 if header else 0
    return sep, names, itertools.islice(_each(raw, form, sep), skipped, None), n - skipped, None


def parsed(raw: bytes, header: bool = True) -> tuple[str, list[str], list[tuple[int, list[str]]], str | None]:
    """(delimiter, names, [(line, fields)], what is wrong with the file). Lines count from 1 and
    are those on which records begin; blank lines are no records. Without a header names are Col1 ..."""
    sep, names, found, _, wrong = streamed(raw, header)
    return sep, names, list(found), wrong


_RECORD = "file string, line long, delimiter string, names array<string>, fields array<string>, wrong string"


def records(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """file, line, delimiter, names (the file's columns), fields and wrong of every record of the
    files of path. A file that has none, or can't be read, has one row that says so in wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # one file at a time
                file, size, raw = (batch.column(i)[row].as_py() for i in range(3))
                sep, names, found, known, wrong = streamed(raw, header) if raw is not None else (";", [], iter(()), 0, f"larger than {MOST_BYTES} bytes: {size}")
                if not known:
                    found, wrong = iter([(0, [])]), wrong or "no rows"
                while part := list(itertools.islice(found, 10_000)):
                    n, strings = len(part), pa.list_(pa.string())
                    columns = [pa.array([file] * n), pa.array([p[0] for p in part], pa.int64()), pa.array([sep] * n), pa.array([names] * n, strings), pa.array([p[1] for p in part], strings), pa.array([wrong] * n, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "line", "delimiter", "names", "fields", "wrong"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.when(F.col("length") <= MOST_BYTES, F.col("content")).alias("content")).mapInArrow(run, _RECORD)


def read(spark: SparkSession, path: str | list[str], mapping: dict[str, str] | None, header: bool = True, decimal: str = ",", thousand: str = ".") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of the statement files of path.

    mapping names the columns of date, description, amount (or debit and credit), balance and
    reference, in any case; without a header they are Col1, Col2 ... rows: file, line, date,
    description, amount (credit less debit), balance, reference (null if blank), raw (all fields by
    name) and import_hash. rejects: file, line, reason and fields, of a row whose date or amount
    can't be read, or of a whole file (line 0) that is empty or lacks a mapped column. A
    mapping that can't do for any file is a ValueError before anything is read."""
    mapping = {k: v.strip().lower() for k, v in (mapping or {}).items() if v and v.strip()}
    lacking = [k for k in ("date", "description") if k not in mapping]
    if "amount" not in mapping and not {"debit", "credit"} <= mapping.keys():
        lacking.append("amount, or debit and credit")
    if lacking:
        raise ValueError(f"no column mapped for {'; '.join(lacking)}")
    every = records(spark, path, header).withColumn("__known", F.transform("names", lambda n: F.lower(F.trim(n))))
    needed = [mapping[k] for k in ("date", "description", *(("amount",) if "amount" in mapping else ("debit", "credit")))]
    absent = F.filter(F.array(*map(F.lit, needed)), lambda n: ~F.array_contains("__known", n))
    field = lambda k: F.get("fields", F.array_position("__known", mapping[k]).cast("int") - 1) if k in mapping else F.lit(None).cast("string")
    field = _where_there(field, mapping)
    number = lambda k: bank_amount(field(k), decimal, thousand)
    amount = number("amount") if "amount" in mapping else F.coalesce(number("credit"), F.lit(0.0)) - F.coalesce(number("debit"), F.lit(0.0))
    every = every.withColumns({"__absent": absent, "date": bank_date(field("date")), "amount": amount})
    told = F.when(F.col("wrong").isNotNull(), F.col("wrong")).when(F.size("__absent") > 0, F.concat(F.lit("no column "), F.array_join("__absent", ", ")))
    told = told.when(F.col("date").isNull(), F.concat(F.lit('date "'), F.coalesce(field("date"), F.lit("")), F.lit('"'))).when(F.col("amount").isNull(), F.concat(F.lit('amount "'), F.coalesce(field("amount"), F.lit("")), F.lit('"')))
    every = every.withColumn("reason", told)
    last = F.map_from_entries(F.transform(F.array_distinct("names"), lambda n: F.struct(n, F.coalesce(F.get("fields", F.array_position("names", n).cast("int") - 1), F.lit("")))))
    rows = every.where("reason IS NULL").select(
        "file", "line", "date", F.trim(F.coalesce(field("description"), F.lit(""))).alias("description"), "amount", number("balance").alias("balance"), F.nullif(F.trim(field("reference")), F.lit("")).alias("reference"), last.alias("raw")
    )
    rows = rows.withColumn("import_hash", row_hash(F.col("date").cast("timestamp"), F.col("amount"), F.col("description"), F.col("reference")))
    whole = (F.size("__absent") > 0) & F.col("wrong").isNull()
    bad = every.where("reason IS NOT NULL").select("file", F.when(whole, F.lit(0).cast("long")).otherwise(F.col("line")).alias("line"), "reason", F.when(~whole, F.col("fields")).alias("fields"))
    return rows, bad.distinct()


def _where_there(field, mapping):
    """A mapped column that the file lacks, or a short row's field, is null."""
    return lambda k: F.when(F.array_contains("__known", mapping[k]), field(k)) if k in mapping else F.lit(None).cast("string")


def escaped(value: Column) -> Column:
    """A field of an export: in quotes, doubled inside, if it has a quote, a semicolon or a line end."""
    s = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(s.rlike('["\n;]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def export_lines(transactions: DataFrame, most: int = MOST_EXPORTED) -> DataFrame:
    """n and line of an export: the header after a byte order mark, then the newest movements, up to
    `most` (a limit of the format), ties by id. What the columns of EXPORTED need and
    transactions (id, date, description, amount ...) lacks is left blank."""
    have = lambda c, f=lambda x: x: f(F.col(c)) if c in transactions.columns else F.lit(None).cast("string")
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    euro = lambda c: F.when(~F.isnan(c.cast("double")), F.replace(F.format_string("%.2f", c.cast("double")), F.lit("."), F.lit(",")))
    fields = [have("id"), have("date", day), have("description"), have("amount", euro), have("balance", euro), have("reference"), have("counterparty"), have("source"), have("batch"), have("created_at", day)]
    newest = transactions.orderBy(F.desc("date"), "id").limit(most)
    rows = newest.withColumn("n", F.row_number().over(Window.orderBy(F.desc("date"), "id")))  # of `most` rows
    lines = rows.select("n", F.concat_ws(";", *map(escaped, fields)).alias("line"))
    head = transactions.sparkSession.createDataFrame([(0, "﻿" + ";".join(EXPORTED))], "n int, line string")
    return head.unionByName(lines)


def export(transactions: DataFrame, path: str, most: int = MOST_EXPORTED) -> None:
    """Writes export_lines() as one file in the folder path, in order, lines ended by CR LF."""
    export_lines(transactions, most).coalesce(1).sortWithinPartitions("n").select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)
