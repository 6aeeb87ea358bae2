"""VAT and income tax over documents, items and ledger lines."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contaflux.functions.money import cents, vat_class, vat_from_gross

OUTPUT = ["FATURA_EMITIDA", "NOTA_CREDITO", "NOTA_DEBITO"]
CORPORATE_RATE, AUTONOMOUS_RATE = 21, 10


def vat_lines(documents: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each item, or for a document without items: rate, signed gross cents and
    tax cents, and whether it is output. Items are gross; credit notes count negative; a
    document without items takes the rate 0."""
    lines = documents.select(F.col("id").alias("document_id"), "type", F.col("total").alias("header")).join(items.select("document_id", "total", "tax_rate"), "document_id", "left")
    gross = F.coalesce("total", "header")
    rate = F.coalesce("tax_rate", F.lit(0.0))
    sign = F.when(F.col("type") == "NOTA_CREDITO", -1).otherwise(1)
    tax = cents(vat_from_gross(gross, rate))
    return lines.select(rate.alias("rate"), (F.col("type").isin(OUTPUT)).alias("output"), (sign * (cents(gross) - tax)).alias("base"), (sign * tax).alias("tax"))


def vat_by_rate(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Bases and taxes of output and input by rate; document_count counts lines."""
    side = lambda c, output: (F.sum(F.when(F.col("output") == output, F.col(c)).otherwise(0)) / F.lit(100.0))
    by_rate = vat_lines(documents, items).groupBy("rate").agg(
        side("base", True).alias("output_base"), side("tax", True).alias("output_tax"), side("base", False).alias("input_base"), side("tax", False).alias("input_tax"), F.count("*").alias("document_count")
    )
    return by_rate.withColumn("kind", vat_class(F.col("rate")))


def vat_totals(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Output, input and payable tax of all lines."""
    out, inn = F.sum(F.when(F.col("output"), F.col("tax")).otherwise(0)), F.sum(F.when(~F.col("output"), F.col("tax")).otherwise(0))
    return vat_lines(documents, items).agg((out / F.lit(100.0)).alias("output_tax"), (inn / F.lit(100.0)).alias("input_tax"), ((out - inn) / F.lit(100.0)).alias("payable"), (F.sum("base") / F.lit(100.0)).alias("base"))


def document_totals(items: DataFrame) -> DataFrame:
    """net, tax and total of each document from its items, taken as net."""
    net, tax = F.sum(cents(F.col("total"))), F.sum(cents(F.col("total") * F.col("tax_rate") / 100))
    return items.groupBy("document_id").agg((net / F.lit(100.0)).alias("net"), (tax / F.lit(100.0)).alias("tax"), ((net + tax) / F.lit(100.0)).alias("total"))


def expense_accounts(journal: DataFrame, accounts: DataFrame, year: int) -> DataFrame:
    """debit, credit and net of each active account of class 6 with lines in the year."""
    lines = journal.where((F.col("date") >= F.lit(datetime.date(year, 1, 1))) & (F.col("date") < F.lit(datetime.date(year + 1, 1, 1))))
    kept = accounts.where(F.col("active") & F.col("code").startswith("6")).select(F.col("id").alias("account_id"), "code", "name")
    sums = lines.groupBy("account_id").agg(F.sum(cents(F.col("debit"))).alias("d"), F.sum(cents(F.col("credit"))).alias("c"))
    return sums.join(kept, "account_id").select("account_id", "code", "name", (F.col("d") / F.lit(100.0)).alias("debit"), (F.col("c") / F.lit(100.0)).alias("credit"), ((F.col("d") - F.col("c")) / F.lit(100.0)).alias("net"))


def income_tax(journal: DataFrame, accounts: DataFrame, year: int) -> DataFrame:
    """The taxable sum of positive nets, the income tax and the autonomous tax on it."""
    positive = F.sum(F.greatest(cents(F.col("net")), F.lit(0)))
    sums = expense_accounts(journal, accounts, year).agg(F.coalesce(positive, F.lit(0)).alias("p"))
    share = lambda rate: F.floor(F.col("p") * rate / 100 + 0.5) / F.lit(100.0)
    return sums.select((F.col("p") / F.lit(100.0)).alias("total"), share(CORPORATE_RATE).alias("income_tax"), share(AUTONOMOUS_RATE).alias("autonomous_tax"))


def top_accounts(journal: DataFrame, accounts: DataFrame, year: int, n: int = 10) -> DataFrame:
    """The n accounts with the largest debit over 0, ties by account."""
    return expense_accounts(journal, accounts, year).where("debit > 0").orderBy(F.desc("debit"), "account_id").limit(n)
