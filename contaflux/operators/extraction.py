"""Fields of an invoice's text: number, date, tax number, totals, accounts, and how sure they are."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from contaflux.functions.dates import bank_date
from contaflux.functions.fiscal import bound, iban_valid, nif_valid, qr_field, qr_parsed, tenant_nif
from contaflux.functions.money import VAT_TOLERANCE, amount_signs, cents, model_number, money_trio, plain_amount, round2, tax_fits, vat_class
from contaflux.functions.text import currency, text_type

_NUMBER = r"(?i)\b((?:FT|FR|FS|NC|ND|RC|RG)\s?[A-Z0-9]*\s?\d*/\d+)"
_LABELLED_NIF = r"(?i)(?:NIF|NIPC|contribuinte)\D{0,12}((?:PT)?\s?\d{3}\s?\d{3}\s?\d{3})"
_DATE = r"\b(\d{4}-\d{2}-\d{2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{4})\b"
_TOTAL = r"(?i)(?:total(?:\s+a\s+pagar|\s+geral)?|amount due)\s*:?\s*(?:EUR|€)?\s*([\d.,]+\d)"
_TAX = r"(?i)(?:IVA|VAT|imposto)[^\d\n]{0,20}(?:\d{1,2}\s?%)?[^\d\n]{0,8}([\d.,]+\d)"
_IBAN = r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b"


def some(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def qr_line(text: Column) -> Column:
    """The first line that looks like a fiscal QR payload."""
    return F.get(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"A:\d{9}") & F.contains(x, F.lit("*"))), F.lit(0))


def fields(text: Column) -> Column:
    """A struct of what the text holds; a QR payload wins over what is printed. confidence:
    .2 and .15 for each field found, .85 at most, .95 with a payload. The text, what is found in it
    and the fields are each bound, as they are used many times over."""
    return bound(text, lambda t: bound(_printed(t), lambda p: bound(_told(t, p), lambda x: _fields(t, p["qr"], x))))


def _printed(text: Column) -> Column:
    found = {"nif": _LABELLED_NIF, "number": _NUMBER, "date": _DATE}
    first = lambda pattern: F.regexp_extract(text, pattern, 1)
    return F.struct(qr_parsed(qr_line(text)).alias("qr"), *(first(p).alias(c) for c, p in found.items()), amount_signs(first(_TOTAL)).alias("total"), amount_signs(first(_TAX)).alias("tax"))


def _told(text: Column, printed: Column) -> Column:
    qr, printed_or_null = printed["qr"], lambda c: F.nullif(printed[c], F.lit(""))
    naked = F.get(F.filter(F.regexp_extract_all(text, F.lit(r"\b(\d{9})\b"), F.lit(1)), nif_valid), F.lit(0))
    return F.struct(
        F.coalesce(qr["issuer_nif"], F.regexp_replace(printed_or_null("nif"), r"\s", ""), naked).alias("nif"), F.coalesce(qr["unique_doc_id"], printed_or_null("number")).alias("number"),
        F.coalesce(qr["document_date"].try_cast("date"), bank_date(printed_or_null("date"))).alias("date"),
        F.coalesce(qr["total"], plain_amount(printed["total"])).alias("total"), F.coalesce(qr["total_tax"], plain_amount(printed["tax"])).alias("tax"),
    )


def _fields(text: Column, qr: Column, told: Column) -> Column:
    iban = F.get(F.filter(F.regexp_extract_all(text, F.lit(_IBAN), F.lit(1)), iban_valid), F.lit(0))
    names = ["nif", "number", "date", "total", "tax"]
    hits = sum((F.when(told[c].isNotNull(), 0.15).otherwise(0.0) for c in names), F.lit(0.2))
    return F.struct(
        *(told[c].alias(c) for c in names), F.greatest(told["total"] - told["tax"], F.lit(0.0)).alias("net"), iban.alias("iban"), currency(text).alias("currency"), text_type(text).alias("type"),
        F.when(qr.isNotNull(), 0.95).otherwise(F.round(F.least(hits, F.lit(0.85)), 2)).alias("confidence"),
    )


def patched(old: Column, new: Column) -> Column:
    """An additive patch: what is new and not null wins."""
    return F.coalesce(new, old)


def breakdown(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(document_id, rate, base, tax): the VAT breakdown of documents (id, explicit: an array of
    rate, base and tax, tax, net) by the first way that gives any row:

    the explicit rows; else items (document_id, rate, quantity, price, discount, line_total)
    added up by rate, each line total taken as net or gross by which the quantity and price
    explain within max(.05, 1 %), gross where they don't; else one row from tax and net.
    Items without a rate, or with neither total nor price, don't count; null documents give none.
    A base is freed of what multiplying and dividing left behind its eighth decimal, so that half
    cents round by the amounts and not by the way they were come by. Lines are added up in the order
    of their position, where items has that column, and of their bases: sums of doubles depend on it.
    """
    told = documents.where(F.size("explicit") > 0).select(F.col("id").alias("document_id"), F.inline("explicit")).select("document_id", "rate", "base", "tax")
    rest = documents.where(F.coalesce(F.size("explicit"), F.lit(0)) <= 0)
    share = 1 + F.col("rate") / 100
    gross = F.coalesce("quantity", F.lit(1.0)) * F.col("price")
    near = F.greatest(F.lit(0.05), gross * share * 0.01)
    net_line = F.col("price").isNotNull() & (F.coalesce("quantity", F.lit(1.0)) > 0) & (F.abs(F.col("line_total") - gross * share) > near) & (F.abs(F.col("line_total") - gross) <= near)
    base = F.when(F.col("line_total").isNull(), gross).when(net_line, F.col("line_total")).otherwise(F.col("line_total") / share)
    lines = items.where("rate IS NOT NULL").withColumn("__base", F.greatest(F.lit(0.0), F.round(base, 8) - F.greatest(F.coalesce("discount", F.lit(0.0)), F.lit(0.0)))).where("__base IS NOT NULL")
    order = Window.partitionBy("document_id", "rate").orderBy(*(["position"] if "position" in items.columns else []), "__base")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = lines.join(rest.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("document_id", "rate", F.sum("__base").over(so_far).alias("base"), F.sum(F.col("__base") * F.col("rate") / 100).over(so_far).alias("tax"), F.lead(F.lit(1)).over(order).isNull().alias("last"))
    by_rate = sums.where("last").select("document_id", "rate", round2(F.col("base")).alias("base"), round2(F.col("tax")).alias("tax"))
    none = rest.join(by_rate.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti").where("net > 0 AND tax >= 0")
    single = none.select(F.col("id").alias("document_id"), F.round(F.col("tax") / F.col("net") * 100, 2).alias("rate"), F.round("net", 2).alias("base"), F.round("tax", 2).alias("tax"))
    return told.unionByName(by_rate).unionByName(single)


def checked_breakdown(lines: DataFrame, expected: DataFrame, tolerance: float = VAT_TOLERANCE) -> DataFrame:
    """(document_id, base, tax, gross, wrong_lines, wrong_total) of VAT lines (document_id, rate,
    base, tax) against expected (document_id, total_tax; null: not known): a line is wrong if an
    amount is negative, its rate is none of the mainland's, or its tax isn't the rate's; an exempt
    line must have no tax."""
    exempt = F.col("rate") == 0
    off = F.when(exempt, F.col("tax") != 0).otherwise(~vat_class(F.col("rate")).isin("reduced", "intermediate", "normal") | ~tax_fits(F.col("base"), F.col("rate"), F.col("tax")))
    bad = F.coalesce((F.col("base") < 0) | (F.col("rate") < 0) | (F.col("tax") < 0) | off, F.lit(True))
    sums = lines.groupBy("document_id").agg(F.sum(cents(F.col("base"))).alias("b"), F.sum(cents(F.col("tax"))).alias("t"), F.count_if(bad).alias("wrong_lines"))
    rows = sums.join(expected.select("document_id", "total_tax"), "document_id", "left")
    euros = lambda c: c / F.lit(100.0)
    return rows.select("document_id", euros(F.col("b")).alias("base"), euros(F.col("t")).alias("tax"), euros(F.col("b") + F.col("t")).alias("gross"), "wrong_lines", F.coalesce(F.abs(euros(F.col("t")) - F.col("total_tax")) > tolerance + 1e-9, F.lit(False)).alias("wrong_total"))


def party_swap(rows: DataFrame, own_nif: str, own_name: str) -> DataFrame:
    """rows (supplier, customer, supplier_nif, customer_nif, qr) with supplier and customer changed
    places where the supplier is the tenant itself, and the reason in swapped (else null):

    the payload's issuer, or without one the supplier's number, is the tenant's; the payload's
    buyer is the tenant and so is the supplier by number or name; or the names are alike. Without
    any customer data nothing changes.
    """
    nif, name = tenant_nif(F.lit(own_nif)), F.lit(own_name.lower().strip())
    supplier = F.lower(F.trim(F.coalesce("supplier", F.lit(""))))
    there = (F.coalesce("customer", F.lit("")) != "") | (tenant_nif(F.col("customer_nif")) != "")
    digits = lambda letter: F.nullif(F.regexp_extract(F.coalesce("qr", F.lit("")), rf"(?:^|\*){letter}:(\d+)", 1), F.lit(""))
    issuer = F.when(digits("A").isNotNull(), tenant_nif(digits("A"))).otherwise(tenant_nif(F.col("supplier_nif")))
    buyer = F.when((tenant_nif(digits("B")) != "999999990") & (F.length(tenant_nif(digits("B"))) == 9), tenant_nif(digits("B")))
    alike = (F.length(name) >= 5) & (F.length(supplier) >= 5) & ((name == supplier) | (F.contains(name, supplier) & (F.length(supplier) >= 8)) | (F.contains(supplier, name) & (F.length(name) >= 8)))
    by_buyer = F.coalesce(buyer == nif, F.lit(False)) & ((tenant_nif(F.col("supplier_nif")) == nif) | alike)
    reason = F.when(there, F.when(issuer == nif, "supplier_nif_eq_tenant_nif").when(by_buyer, "qr_b_matches_tenant_nif").when(alike, "supplier_name_eq_tenant_name"))
    out = rows.withColumn("swapped", F.when(nif != "", reason))
    turn = F.col("swapped").isNotNull()
    first = F.col("swapped") == "supplier_nif_eq_tenant_nif"
    other = F.when(first, F.nullif(tenant_nif(F.col("customer_nif")), F.lit(""))).otherwise(F.col("customer_nif"))
    mine = F.when(first, issuer).otherwise(F.col("supplier_nif"))
    return out.withColumns(
        {"supplier": F.when(turn, F.col("customer")).otherwise(F.col("supplier")), "customer": F.when(turn, F.col("supplier")).otherwise(F.col("customer")), "supplier_nif": F.when(turn, other).otherwise(F.col("supplier_nif")), "customer_nif": F.when(turn, mine).otherwise(F.col("customer_nif"))}
    )


def usable(total: Column, qr: Column, partial: Column) -> Column:
    """Whether a model's reading can stand: a partial one is judged elsewhere; else it needs a
    total of a million at most, and a payload whose total doesn't look like a date."""
    o = qr_field(qr, "O")
    dated = o.rlike(r"^\d{8}(?:\.|$)") & (F.left(o, F.lit(4)).try_cast("int") >= 2010)
    return F.coalesce(partial, F.lit(False)) | (F.coalesce(total.isNotNull() & ~F.isnan(total) & (total <= 1_000_000), F.lit(False)) & ~F.coalesce(dated, F.lit(False)))


def usable_fallback(confidence: Column, partial: Column, total: Column, net: Column, qr: Column, iban: Column, *texts: Column) -> Column:
    """Whether a reading holds anything to go on: some text, a positive amount, an account number, or a payload of four fields."""
    o = qr_field(qr, "O")
    dated = F.coalesce(o.rlike(r"^\d{8}(?:\.|$)") & (F.left(o, F.lit(4)).try_cast("int") >= 2010), F.lit(False))
    said = [F.coalesce(F.trim(t) != "", F.lit(False)) for t in texts]
    signs = [F.coalesce(total > 0, F.lit(False)), F.coalesce(net > 0, F.lit(False)), F.coalesce(F.length(F.trim(iban)) >= 5, F.lit(False)), F.coalesce(F.length(F.regexp_replace(qr, r"[^*]", "")) >= 3, F.lit(False))]
    any_of = reduce(lambda a, b: a | b, [*said, *signs])
    return ~F.coalesce(partial, F.lit(False)) & F.coalesce(confidence > 0, F.lit(False)) & ~F.coalesce(total > 1_000_000, F.lit(False)) & ~dated & any_of


#: What a model's answer holds; numbers may be written as texts.
READING = (
    "supplier string, customer string, supplierNif string, customerNif string, docNumber string, docDate string, currency string, iban string, documentType string, "
    "netAmount string, taxAmount string, total string, confidence double, notes array<string>, suggestedCategory string, cashDiscountRate string, discountAmount string, "
    "ivaBreakdown array<struct<rate:string,base:string,tax:string>>, lineItems array<struct<description:string,code:string,quantity:string,unitPrice:string,vatRate:string,discount:string,lineTotal:string>>"
)


def reading(answer: Column, most_items: int = 50, most_notes: int = 5) -> Column:
    """A model's JSON answer as a struct of typed fields: texts trimmed and empty ones null,
    numbers parsed, rows without any value left out, at most so many items and notes,
    confidence within 0 to 1 and a discount rate within 0 to 100 (else null). Unreadable
    JSON gives a struct of nulls."""
    return bound(F.from_json(first_object(answer), READING), lambda r: _typed(r, most_items, most_notes))


def _typed(r: Column, most_items: int, most_notes: int) -> Column:
    text = lambda c: F.nullif(F.trim(r[c]), F.lit(""))
    taxes = F.filter(F.transform(r["ivaBreakdown"], lambda x: F.struct(*(model_number(x[c]).alias(c) for c in ("rate", "base", "tax")))), lambda x: x["rate"].isNotNull() & x["base"].isNotNull() & x["tax"].isNotNull())
    numbers = ["quantity", "unitPrice", "vatRate", "discount", "lineTotal"]
    items = F.transform(r["lineItems"], lambda x: F.struct(F.nullif(F.left(F.trim(x["description"]), F.lit(500)), F.lit("")).alias("description"), F.nullif(F.left(F.trim(x["code"]), F.lit(80)), F.lit("")).alias("code"), *(model_number(x[c]).alias(c) for c in numbers)))
    items = F.slice(F.filter(items, lambda x: F.coalesce(x["description"], x["code"], *(x[c].cast("string") for c in numbers)).isNotNull()), 1, most_items)
    rate, off = F.replace(F.regexp_replace(r["cashDiscountRate"], r"[\s%]", ""), F.lit(","), F.lit(".")).try_cast("double"), model_number(r["discountAmount"])
    some = lambda a: F.when(F.size(a) > 0, a)
    return F.struct(
        *(text(c).alias(c) for c in ("supplier", "customer", "supplierNif", "customerNif", "docNumber", "docDate", "currency", "iban", "documentType")),
        *(model_number(r[c]).alias(c) for c in ("netAmount", "taxAmount", "total")),
        F.when(r["confidence"].isNotNull(), F.least(F.greatest(r["confidence"], F.lit(0.0)), F.lit(1.0))).alias("confidence"), F.slice(r["notes"], 1, most_notes).alias("notes"), F.left(text("suggestedCategory"), F.lit(200)).alias("suggestedCategory"),
        F.when(rate.between(0, 100), rate).alias("cashDiscountRate"), F.when(off >= 0, off).alias("discountAmount"), some(taxes).alias("ivaBreakdown"), some(items).alias("lineItems"),
    )


#: A whole string, closed or not, or a brace.
_MARK = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}]', re.S)


def balanced(text: str | None) -> str | None:
    """The first balanced JSON object of a text. Braces are looked at, not letters: what lies between
    them is skipped by the regular expression, and each part of a text is read once."""
    if not text:
        return None
    kept, at = [], 0
    while (opened := text.find("<think>", at)) >= 0 and (closed := text.find("</think>", opened)) >= 0:
        kept.append(text[at:opened])
        at = closed + len("</think>")
    text = "".join(kept) + text[at:]
    start, depth = text.find("{"), 0
    for mark in _MARK.finditer(text, start) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(mark[0], 0)
        if not depth:
            return text[start : mark.end()]
    return None


def first_object(texts: Column) -> Column:
    """The first balanced JSON object of each text, braces inside strings and what is between
    <think> tags aside; null without one. Counting braces is no regular expression."""

    def run(column: pd.Series) -> pd.Series:
        return column.map(balanced, na_action="ignore")

    return F.pandas_udf(run, StringType())(texts)


FIELDS = ["supplier", "customer", "supplier_nif", "customer_nif", "number", "date", "iban", "currency"]
AMOUNTS = ["total", "tax", "net"]
LEAST_AI = 0.6


def merged_reading(rows: DataFrame) -> DataFrame:
    """rows (ai: a struct of FIELDS, AMOUNTS, confidence, partial; rx: the same of the regular
    expressions) with one struct ``fields``: the model's values win where they are there, if it is
    sure enough (LEAST_AI) and its answer was whole; else the expressions' stand and confidence is
    .39 at most. Where both totals agree and a number and date are known it is .9 at least; .95 at
    most. Amounts are reconciled afterwards."""
    ai, rx = F.col("ai"), F.col("rx")
    used = ~F.coalesce(ai["partial"], F.lit(False)) & F.coalesce(ai["confidence"] >= LEAST_AI, F.lit(False))
    pick = {c: F.when(used, F.coalesce(ai[c], rx[c])).otherwise(rx[c]) for c in [*FIELDS, *AMOUNTS]}
    agree = F.coalesce(F.abs(rx["total"] - pick["total"]) < 0.01, F.lit(False)) & F.coalesce(pick["supplier_nif"], pick["number"]).isNotNull() & pick["date"].isNotNull()
    best = F.greatest(F.coalesce(rx["confidence"], F.lit(0.0)), F.coalesce(ai["confidence"], F.lit(0.0)))
    confidence = F.when(used, F.least(F.lit(0.95), F.when(agree, F.greatest(best, F.lit(0.9))).otherwise(best))).otherwise(F.least(F.lit(0.39), best))
    money = money_trio(pick["total"], pick["tax"], pick["net"])
    amounts = {c: F.when(used, money[c]).otherwise(pick[c]) for c in AMOUNTS}
    return rows.withColumn("fields", F.struct(*(pick[c].alias(c) for c in FIELDS), *(amounts[c].alias(c) for c in AMOUNTS), confidence.alias("confidence"), F.when(used, "ai").otherwise("regex").alias("source")))


def merged_qr(rows: DataFrame) -> DataFrame:
    """rows (qr, ai: structs of FIELDS, AMOUNTS and confidence) with ``fields``: the payload's
    values stand, the model fills what it doesn't tell; amounts are reconciled; confidence is the
    larger one, .95 where both totals agree, .99 at most. Without a model's answer the payload's
    fields stay as they are."""
    qr, ai = F.col("qr"), F.col("ai")
    money = money_trio(*(F.coalesce(qr[c], ai[c]) for c in AMOUNTS))
    agree = F.coalesce(F.abs(ai["total"] - qr["total"]) < 0.01, F.lit(False))
    confidence = F.least(F.lit(0.99), F.greatest(qr["confidence"], F.coalesce(ai["confidence"], F.lit(0.0)), F.when(agree, 0.95).otherwise(0.0)))
    with_ai = F.struct(*(F.coalesce(qr[c], ai[c]).alias(c) for c in FIELDS), *(money[c].alias(c) for c in AMOUNTS), confidence.alias("confidence"))
    return rows.withColumn("fields", F.when(ai.isNotNull(), with_ai).otherwise(F.struct(*(qr[c].alias(c) for c in [*FIELDS, *AMOUNTS, "confidence"]))))


def provenance(hints: Column) -> Column:
    """Provider and model of the first hint like ai:provider/model, and the source of source:..."""
    named = lambda prefix: F.get(F.filter(hints, lambda h: F.startswith(h, F.lit(prefix))), F.lit(0))
    ai = F.substring(named("ai:"), 4, 1000)
    return F.struct(F.nullif(F.split_part(ai, F.lit("/"), F.lit(1)), F.lit("")).alias("provider"), F.nullif(F.split_part(ai, F.lit("/"), F.lit(2)), F.lit("")).alias("model"), F.nullif(F.substring(named("source:"), 8, 1000), F.lit("")).alias("source"))


REVIEW = ["date_ambiguous", "iban_invalid", "iban_truncated", "supplier_review"]


def metadata(fields_: Column, warnings: Column, text: Column, most: int = 4000) -> Column:
    """JSON of what was extracted, its warnings, whether they call for a review, and the text's beginning as a preview."""
    review = F.exists(warnings, lambda w: F.split_part(w, F.lit(":"), F.lit(1)).isin(REVIEW))
    return F.to_json(F.struct(fields_.alias("extraction"), warnings.alias("warnings"), review.alias("needsReview"), F.left(text, F.lit(most)).alias("preview")))


def extraction_status(confidence: Column, found: Column) -> Column:
    """A struct of the status after extraction, always a review, and a warning where nothing was found."""
    return F.struct(F.lit("EM_REVISAO").alias("status"), F.when(~F.coalesce(found, F.lit(False)) | (F.coalesce(confidence, F.lit(0.0)) <= 0), "no_signal").alias("warning"))
