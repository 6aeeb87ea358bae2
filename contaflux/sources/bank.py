"""Bank statements: CSV with a column mapping, and ISO 20022 statements in XML; and their export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contaflux.functions.dates import bank_date
from contaflux.functions.money import bank_amount
from contaflux.functions.vectors import row_hash


def delimiter(spark: SparkSession, path: str) -> str:
    """; or , by which is more frequent in the first line that is not blank; ; wins ties."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    line = first[0][0] if first else ""
    return "," if line.count(",") > line.count(";") else ";"


def csv_rows(spark: SparkSession, path: str, mapping: dict[str, str], decimal: str = ",", thousand: str = ".") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of CSV files with a header. mapping: date, description, amount or
    debit and credit, balance, reference to column names (any case). A row with an
    unreadable date or amount is a reject; an empty reference is null."""
    raw = spark.read.option("header", True).option("sep", delimiter(spark, path)).option("mode", "PERMISSIVE").csv(path)
    have = {c.strip("﻿ ").lower(): c for c in raw.columns}
    column = lambda k: F.col(f"`{have[mapping[k].lower()]}`") if k in mapping and mapping[k].lower() in have else F.lit(None).cast("string")
    number = lambda k: bank_amount(column(k), decimal, thousand)
    amount = number("amount") if "amount" in mapping else F.coalesce(number("credit"), F.lit(0.0)) - F.coalesce(number("debit"), F.lit(0.0))
    parsed = raw.select(bank_date(column("date")).alias("date"), F.trim(column("description")).alias("description"), amount.alias("amount"), number("balance").alias("balance"), F.nullif(F.trim(column("reference")), F.lit("")).alias("reference"))
    good = F.col("date").isNotNull() & F.col("amount").isNotNull()
    rows = parsed.where(good).withColumn("import_hash", row_hash(F.col("date").cast("timestamp"), F.col("amount"), F.col("description"), F.col("reference")))
    return rows, parsed.where(~good)


ENTRY = (
    "Amt struct<_Ccy:string,_VALUE:string>, CdtDbtInd string, BookgDt struct<Dt:string,DtTm:string>, AcctSvcrRef string, "
    "NtryDtls array<struct<TxDtls:array<struct<Refs:struct<AcctSvcrRef:string,EndToEndId:string,TxId:string,InstrId:string>,RltdPties:struct<Cdtr:struct<Nm:string>,CdtrAcct:struct<Id:struct<IBAN:string>>,Dbtr:struct<Nm:string>,DbtrAcct:struct<Id:struct<IBAN:string>>>,RmtInf:struct<Ustrd:array<string>>>>>>"
)


def camt_rows(spark: SparkSession, path: str) -> DataFrame:
    """A row for each entry of ISO 20022 statements; entries without a date or a readable amount are left
    out. Of an entry of several transactions the amount is the entry's and the references, the party
    and the remittance are those of the first; transactions says how many there are."""
    raw = spark.read.format("xml").option("rowTag", "Ntry").schema(ENTRY).load(path)
    every = F.flatten(F.filter(F.transform(F.coalesce("NtryDtls", F.array().cast(raw.schema["NtryDtls"].dataType)), lambda d: d["TxDtls"]), lambda t: t.isNotNull()))
    raw = raw.withColumn("__n", F.size(every)).withColumn("__tx", F.get(every, F.lit(0)))
    tx = "__tx"
    debit = F.col("CdtDbtInd") == "DBIT"
    told = F.col("Amt._VALUE")
    amount = F.abs(F.when(F.contains(told, F.lit(",")), F.replace(F.replace(told, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(told).try_cast("decimal(14,2)"))
    rows = raw.select(
        F.coalesce(F.try_to_date(F.col("BookgDt.Dt"), "yyyy-MM-dd"), F.try_to_date(F.left(F.col("BookgDt.DtTm"), F.lit(10)), "yyyy-MM-dd")).alias("date"),
        F.when(debit, -amount).otherwise(amount).cast("decimal(14,2)").alias("amount"),
        F.coalesce(F.col("Amt._Ccy"), F.lit("EUR")).alias("currency"),
        F.coalesce(F.col(f"{tx}.Refs.AcctSvcrRef"), F.col("AcctSvcrRef")).alias("bank_ref"),
        F.col(f"{tx}.Refs.EndToEndId").alias("end_to_end_id"),
        F.coalesce(F.col(f"{tx}.Refs.TxId"), F.col(f"{tx}.Refs.InstrId")).alias("tx_id"),
        F.when(debit, F.col(f"{tx}.RltdPties.Cdtr.Nm")).otherwise(F.col(f"{tx}.RltdPties.Dbtr.Nm")).alias("counterparty"),
        F.when(debit, F.col(f"{tx}.RltdPties.CdtrAcct.Id.IBAN")).otherwise(F.col(f"{tx}.RltdPties.DbtrAcct.Id.IBAN")).alias("counterparty_iban"),
        F.get(F.col(f"{tx}.RmtInf.Ustrd"), F.lit(0)).alias("remittance"),
        F.col("__n").alias("transactions"),
    )
    return rows.where("date IS NOT NULL AND amount IS NOT NULL")


def write_csv(transactions: DataFrame, path: str) -> None:
    """Semicolons, CRLF, dd/MM/yyyy and decimal commas, newest first within each file."""
    rows = transactions.select(F.date_format("date", "dd/MM/yyyy").alias("Data"), F.col("description").alias("Descrição"), F.replace(F.format_string("%.2f", "amount"), F.lit("."), F.lit(",")).alias("Valor"), F.col("reference").alias("Referência"), F.col("date").alias("__d"))
    rows.sortWithinPartitions(F.desc("__d")).drop("__d").write.mode("overwrite").option("header", True).option("sep", ";").option("lineSep", "\r\n").csv(path)


BALANCE = "Tp struct<CdOrPrtry:struct<Cd:string>,Cd:string>, Amt struct<_Ccy:string,_VALUE:string>"


def closing_balance(statements: DataFrame) -> DataFrame:
    """(id, balance) of statements (id, xml): the first balance of code CLBD, else the first one;
    a decimal comma is taken as one; null without any."""
    parsed = F.from_xml("xml", f"struct<Bal:array<struct<{BALANCE.replace('Tp struct', 'Tp:struct').replace('Amt struct', 'Amt:struct')}>>>", {"rowTag": "Stmt"})
    rows = statements.select("id", parsed["Bal"].alias("b"))
    closing = F.get(F.filter("b", lambda x: F.coalesce(x["Tp"]["CdOrPrtry"]["Cd"], x["Tp"]["Cd"]) == "CLBD"), F.lit(0))
    raw = F.coalesce(closing, F.get("b", F.lit(0)))["Amt"]["_VALUE"]
    plain = F.when(F.contains(raw, F.lit(",")), F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(raw)
    return rows.select("id", plain.try_cast("double").alias("balance"))


def as_movements(entries: DataFrame) -> DataFrame:
    """camt_rows() as bank movements: the description is the remittance, else the counterparty, else
    the end-to-end or transaction id, else a fixed text; the reference is the end-to-end id, else
    the bank's."""
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in entries.columns else F.lit(None).cast("string")
    description = F.coalesce(some("remittance"), some("counterparty"), some("end_to_end_id"), some("tx_id"), F.lit("Movimento CAMT"))
    reference = F.coalesce(some("end_to_end_id"), some("tx_id"), some("bank_ref"))
    out = entries.select("date", F.col("amount").cast("double").alias("amount"), description.alias("description"), reference.alias("reference"))
    return out.withColumn("import_hash", row_hash(F.col("date").cast("timestamp"), F.col("amount"), F.col("description"), F.col("reference")))


def effective_mapping(nested: dict[str, str] | None, flat: dict[str, str] | None) -> dict[str, str]:
    """A column mapping in which nested entries win over flat ones like dateColumn."""
    old = {k.removesuffix("Column"): v for k, v in (flat or {}).items() if v}
    return {**old, **{k: v for k, v in (nested or {}).items() if v}}


def mapped(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """rows under the target names of a saved mapping (target to source, sources in any case); a
    source that isn't there is an error that names it."""
    have = {c.lower(): c for c in rows.columns}
    missing = sorted(v for v in mapping.values() if v.lower() not in have)
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return rows.select(*(F.col(f"`{have[v.lower()]}`").alias(k) for k, v in mapping.items()))
