"""SEPA credit transfers: ISO 20022 fragments, instructions and whole messages, and the CSV form."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contaflux.functions.fiscal import iban_plain, iban_valid
from contaflux.functions.money import cents
from contaflux.functions.text import csv_escaped, xml_escaped

NAME_LENGTH, ID_LENGTH, TEXT_LENGTH = 70, 35, 140
#: The message's namespace. Fixed value.
NAMESPACE = "urn:iso:std:iso:20022:tech:xsd:pain.001.001.03"
#: Columns of the CSV form. Fixed values.
CSV_COLUMNS = ["Data Execução", "EndToEndId", "Valor (EUR)", "Nome Credor", "NIF", "IBAN", "Referência", "Descrição"]


def tag(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), F.lit(value) if isinstance(value, str) else value, F.lit(f"</{name}>"))


def fault(transfer_id: Column, amount: Column, name: Column, iban: Column) -> Column:
    """Why a transfer can't be sent, the first of several; null if it can. Nothing that names or
    identifies is ever cut."""
    plain_id, plain_name = F.coalesce(F.trim(transfer_id), F.lit("")), F.coalesce(F.trim(name), F.lit(""))
    return (
        F.when(plain_id == "", "id missing").when(F.length(plain_id) > ID_LENGTH, "id too long")
        .when(iban_plain(iban) == "", "iban missing").when(~iban_valid(iban), "iban invalid")
        .when(plain_name == "", "name missing").when(F.length(plain_name) > NAME_LENGTH, "name too long")
        .when(~F.coalesce((amount > 0) & ~F.isnan(amount) & (amount < 1e13), F.lit(False)), "amount")
    )


def fragment(transfer_id: Column, amount: Column, name: Column, iban: Column, remittance: Column, bic: Column | None = None) -> Column:
    """A CdtTrfTxInf element of a transfer without a fault. The bank's code and the text are left
    out where they are empty; the text alone is cut, to what the format allows."""
    text = lambda x: F.coalesce(F.trim(x), F.lit(""))
    some = lambda x, column: F.when(x != "", column).otherwise("")
    code = F.upper(text(bic)) if bic is not None else F.lit("")
    agent = F.concat(F.lit("<CdtrAgt><FinInstnId><BIC>"), xml_escaped(code), F.lit("</BIC></FinInstnId></CdtrAgt>"))
    money = F.concat(F.lit('<Amt><InstdAmt Ccy="EUR">'), F.format_string("%.2f", cents(amount) / F.lit(100.0)), F.lit("</InstdAmt></Amt>"))
    told = F.concat(F.lit("<RmtInf><Ustrd>"), xml_escaped(F.left(text(remittance), F.lit(TEXT_LENGTH))), F.lit("</Ustrd></RmtInf>"))
    return F.concat(
        F.lit("<CdtTrfTxInf>"), tag("PmtId", tag("EndToEndId", xml_escaped(text(transfer_id)))), money, some(code, agent), tag("Cdtr", tag("Nm", xml_escaped(text(name)))),
        tag("CdtrAcct", tag("Id", tag("IBAN", iban_plain(iban)))), some(text(remittance), told), F.lit("</CdtTrfTxInf>"),
    )


def transfers(payments: DataFrame) -> DataFrame:
    """id, valid, fault, xml (null with a fault) and cents of payments (id, amount, name, iban,
    remittance, and bic if there is one)."""
    wrong = fault(F.col("id").cast("string"), F.col("amount"), F.col("name"), F.col("iban"))
    bic = F.col("bic") if "bic" in payments.columns else None
    xml = fragment(F.col("id").cast("string"), F.col("amount"), F.col("name"), F.col("iban"), F.col("remittance"), bic)
    kept = [c for c in ("instruction",) if c in payments.columns]
    return payments.select("id", *kept, wrong.isNull().alias("valid"), wrong.alias("fault"), F.when(wrong.isNull(), xml).alias("xml"), cents(F.col("amount")).alias("cents"))


def header(rows: DataFrame) -> DataFrame:
    """Number of valid transfers and their control sum."""
    return rows.where("valid").agg(F.count("*").alias("n"), (F.coalesce(F.sum("cents"), F.lit(0)) / F.lit(100.0)).alias("control_sum"))


def instructions(rows: DataFrame, debtors: DataFrame) -> DataFrame:
    """(instruction, n, control_sum, head): the opening of a PmtInf element for each instruction of
    transfers() with valid ones. debtors: instruction, name, iban, bic, execution (a date). An
    instruction whose debtor has no valid account or name, or whose own id is too long, is left out."""
    sums = rows.where("valid").groupBy("instruction").agg(F.count("*").alias("n"), F.sum("cents").alias("c"))
    good = iban_valid(F.col("iban")) & (F.coalesce(F.trim("name"), F.lit("")) != "") & F.length("instruction").between(1, ID_LENGTH)
    both = sums.join(debtors.where(good), "instruction")
    money = F.format_string("%.2f", F.col("c") / F.lit(100.0))
    head = F.concat(
        tag("PmtInfId", xml_escaped(F.col("instruction"))), tag("PmtMtd", "TRF"), tag("BtchBookg", "true"), tag("NbOfTxs", F.col("n").cast("string")), tag("CtrlSum", money),
        F.lit("<PmtTpInf><SvcLvl><Cd>SEPA</Cd></SvcLvl></PmtTpInf>"), tag("ReqdExctnDt", F.date_format("execution", "yyyy-MM-dd")), tag("Dbtr", tag("Nm", xml_escaped(F.trim("name")))),
        tag("DbtrAcct", tag("Id", tag("IBAN", iban_plain(F.col("iban"))))), tag("DbtrAgt", tag("FinInstnId", tag("BIC", xml_escaped(F.upper(F.trim(F.coalesce("bic", F.lit("")))))))),
    )
    return both.select("instruction", "n", (F.col("c") / F.lit(100.0)).alias("control_sum"), head.alias("head"))


def message(rows: DataFrame, debtors: DataFrame, message_id: str, party: str, created: datetime.datetime) -> DataFrame:
    """The lines of a whole message, as (place, line): place orders them, so a file is written by
    a range partition and no task holds all transfers. rows: transfers() with an instruction."""
    if not message_id or len(message_id) > ID_LENGTH or not party or len(party) > NAME_LENGTH:
        raise ValueError("the message's id or party is missing or too long")
    heads = instructions(rows, debtors)
    total = heads.agg(F.sum("n").alias("n"), F.sum(cents(F.col("control_sum"))).alias("c")).where("n > 0")
    opening = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<Document xmlns="{NAMESPACE}" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><CstmrCdtTrfInitn><GrpHdr>'),
        tag("MsgId", xml_escaped(F.lit(message_id))), tag("CreDtTm", f"{created:%Y-%m-%dT%H:%M:%S}"), tag("NbOfTxs", F.col("n").cast("string")), tag("CtrlSum", F.format_string("%.2f", F.col("c") / F.lit(100.0))),
        tag("InitgPty", tag("Nm", xml_escaped(F.lit(party)))), F.lit("</GrpHdr>"),
    )
    place = lambda i, part, row: F.struct(i.alias("instruction"), F.lit(part).alias("part"), row.alias("row"))
    none = F.lit("")
    parts = [
        total.select(place(none, -1, F.lit(0).cast("long")).alias("place"), opening.alias("line")),
        heads.select(place(F.col("instruction"), 0, F.lit(0).cast("long")).alias("place"), F.concat(F.lit("<PmtInf>"), "head").alias("line")),
        rows.where("valid").join(heads.select("instruction"), "instruction", "left_semi").select(place(F.col("instruction"), 1, F.col("id").cast("long")).alias("place"), F.col("xml").alias("line")),
        heads.select(place(F.col("instruction"), 2, F.lit(0).cast("long")).alias("place"), F.lit("</PmtInf>").alias("line")),
        total.select(place(F.lit("￿"), 3, F.lit(0).cast("long")).alias("place"), F.lit("</CstmrCdtTrfInitn></Document>").alias("line")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def csv_lines(payables: DataFrame, parties: DataFrame, execution: datetime.date) -> DataFrame:
    """(id, line) of the CSV form of approved open payables; who gets the money is looked up and
    may be missing, and no fraud check applies, unlike in the message."""
    ready = payables.where(F.col("approved") & F.col("status").isin("TO_PAY", "SCHEDULED"))
    who = parties.select(F.col("id").alias("party_id"), "name", "nif", "iban")
    rows = ready.join(who, "party_id", "left")
    text = lambda c: csv_escaped(F.coalesce(F.col(c) if c in rows.columns else F.lit(""), F.lit("")))
    money = F.replace(F.format_string("%.2f", "amount"), F.lit("."), F.lit(","))
    return rows.select("id", F.concat_ws(";", F.lit(f"{execution:%Y-%m-%d}"), F.col("id").cast("string"), money, text("name"), text("nif"), text("iban"), text("payment_ref"), text("description")).alias("line"))


def csv_header(spark: SparkSession) -> str:
    return ";".join(CSV_COLUMNS)


def payroll_transfers(lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """transfers() of net salaries: lines (id, net), accounts (id, name, iban). Employees without an
    account come out with a fault; a caller sends nothing while there is one."""
    rows = lines.join(accounts, "id", "left").select("id", F.col("net").cast("double").alias("amount"), "name", "iban", F.lit("Vencimento").alias("remittance"))
    return transfers(rows)
