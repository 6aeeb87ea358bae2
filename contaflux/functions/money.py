"""Money: half-up rounding towards plus infinity, VAT arithmetic, locale amounts, payroll lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: VAT percentages by region and kind, and monthly withholding brackets. Fixed values.
VAT_RATES = {"PT": {"normal": 23.0, "intermediate": 13.0, "reduced": 6.0}, "AC": {"normal": 16.0, "intermediate": 9.0, "reduced": 4.0}, "MA": {"normal": 22.0, "intermediate": 12.0, "reduced": 5.0}}
WITHHOLDING = [(920, 0.0), (1400, 0.13), (2200, 0.18), (3200, 0.23)]
WITHHOLDING_TOP = 0.28
EMPLOYEE_SHARE, EMPLOYER_SHARE = 0.11, 0.2375
VAT_TOLERANCE = 0.02


def cents(x: Column) -> Column:
    """x in hundredths, halves rounded up, as a long: sums of it are exact in any order."""
    return F.floor(x * 100 + 0.5).cast("long")


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / F.lit(100.0)


def vat_from_base(base: Column, rate: Column) -> Column:
    return round2(base * rate / 100)


def vat_from_gross(gross: Column, rate: Column) -> Column:
    return round2(gross * rate / (rate + 100))


def base_from_gross(gross: Column, rate: Column) -> Column:
    return round2(gross - vat_from_gross(gross, rate))


def vat_class(rate: Column, region: str = "PT") -> Column:
    """exempt, reduced, intermediate or normal for a rate within .05 of the region's; else other."""
    out = F.when(F.abs(rate) <= 0.05, "exempt")
    for kind in ("reduced", "intermediate", "normal"):
        out = out.when(F.abs(rate - VAT_RATES[region][kind]) <= 0.05, kind)
    return out.otherwise("other")


def line_total(quantity: Column, price: Column, discount: Column) -> Column:
    return F.greatest(F.lit(0.0), round2(quantity * price - F.coalesce(discount, F.lit(0.0))))


def net_of(total: Column, tax: Column) -> Column:
    """What is left of a total without its tax, in cents, 0 at least; null where either is null."""
    return F.when(total.isNotNull() & tax.isNotNull(), round2(F.greatest(total - tax, F.lit(0.0))))


def tax_fits(base: Column, rate: Column, tax: Column) -> Column:
    return F.abs(tax - vat_from_base(base, rate)) <= VAT_TOLERANCE + 1e-9


def bank_amount(text: Column, decimal: str = ",", thousand: str = ".") -> Column:
    """An amount of a bank statement: currency signs and separators out, then the longest
    number that the rest begins with; null where it begins with none."""
    plain = F.regexp_replace(text, r"[\s€$£]|EUR", "")
    if thousand:
        plain = F.replace(plain, F.lit(thousand), F.lit(""))
    if decimal != ".":
        plain = F.replace(plain, F.lit(decimal), F.lit("."))
    return F.regexp_extract(plain, r"^[+-]?(?:\d+\.?\d*|\.\d+)", 0).try_cast("double")


def invoice_amount(text: Column) -> Column:
    """An amount of an invoice: the last separator is the decimal one, but a single separator
    with exactly three digits after it groups thousands."""
    return plain_amount(amount_signs(text))


def amount_signs(text: Column) -> Column:
    """The digits, separators and minus signs of a text."""
    return F.regexp_replace(text, r"[^\d.,-]", "")


def plain_amount(plain: Column) -> Column:
    """invoice_amount() of amount_signs(), which are looked at a dozen times."""
    single = F.length(F.regexp_replace(plain, r"[^.,]", "")) == 1
    thousands = single & plain.rlike(r"[.,]\d{3}$")
    comma_last = F.length(plain) - F.instr(F.reverse(plain), ",") > F.length(plain) - F.instr(F.reverse(plain), ".")
    comma = (F.instr(plain, ",") > 0) & ((F.instr(plain, ".") == 0) | comma_last)
    decimal = F.when(comma, F.replace(F.replace(plain, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(plain, F.lit(","), F.lit("")))
    return F.when(thousands, F.regexp_replace(plain, "[.,]", "")).otherwise(decimal).try_cast("double")


def model_number(text: Column) -> Column:
    """A number that a language model wrote: a single separator is decimal only before exactly two digits."""
    plain = F.regexp_replace(text, r"[^\d.,-]", "")
    single = F.length(F.regexp_replace(plain, r"[^.,]", "")) == 1
    grouped = F.regexp_replace(plain, "[.,]", "")
    return F.when(single & ~plain.rlike(r"[.,]\d{2}$"), grouped).when(single, F.replace(plain, F.lit(","), F.lit("."))).otherwise(invoice_amount(text).cast("string")).try_cast("double")


def qr_amount(text: Column) -> Column:
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), r"^\s*[+-]?\d*\.?\d+", 0).try_cast("double")


def withholding_rate(gross: Column, configured: Column | None = None) -> Column:
    """A configured rate (over 1: in percent), else by bracket of the gross salary."""
    by_bracket = F.lit(WITHHOLDING_TOP)
    for upper, rate in reversed(WITHHOLDING):
        by_bracket = F.when(gross <= upper, F.lit(rate)).otherwise(by_bracket)
    if configured is None:
        return by_bracket
    return F.coalesce(F.when(configured > 1, configured / 100).otherwise(configured), by_bracket)


def pt_amount(x: Column) -> Column:
    """Two decimals after a comma, thousands grouped by a point from five digits on."""
    grouped = F.translate(F.format_number(x, 2), ",.", ".,")
    return F.when(F.abs(x) < 10000, F.replace(grouped, F.lit("."), F.lit(""))).otherwise(grouped)


def money_sum(values: Column) -> Column:
    """The sum of an array's finite values, rounded once; of none it is 0."""
    finite = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return round2(F.aggregate(finite, F.lit(0.0), lambda a, v: a + v))


def region_of(code: Column) -> Column:
    """PT, AC or MA of a region's code (PT-AC and PT-MA are islands); PT for what is unknown."""
    plain = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return F.when(plain.isin("AC", "PT-AC"), "AC").when(plain.isin("MA", "PT-MA"), "MA").otherwise("PT")


def rate_of(kind: Column, region: Column) -> Column:
    """The VAT percentage of a kind in a region (PT, AC, MA); exempt is 0, an unknown kind null."""
    out = F.when(kind == "exempt", 0.0)
    for name, rates in VAT_RATES.items():
        for which, rate in rates.items():
            out = out.when((region == name) & (kind == which), rate)
    return out


def bucket_kind(rate: Column) -> Column:
    """The kind of a rate on the mainland; the normal rates of the islands are normal too."""
    main = vat_class(rate)
    island = (F.abs(rate - VAT_RATES["AC"]["normal"]) <= 0.05) | (F.abs(rate - VAT_RATES["MA"]["normal"]) <= 0.05)
    return F.when((main == "other") & island, "normal").otherwise(main)


def finite_number(s: Column) -> Column:
    """A text as a finite number, else null."""
    x = F.trim(s).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def plausible(x: Column) -> Column:
    """x unless it is no amount: not positive, the placeholder 1, or over a million."""
    return F.when((x > 0) & (x != 1) & (x <= 1_000_000), x)


def money_trio(total: Column, tax: Column, net: Column, breakdown: Column | None = None) -> Column:
    """A struct of total, tax, net and a hint that says where they come from.

    A breakdown (array of rate, base, tax) of which every base and tax is plausible wins. Else
    implausible amounts are dropped, and of what is left total and tax come before total and
    net, and these before tax and net; the third is derived. breakdown may be null.
    """
    total, tax, net = plausible(total), plausible(tax), plausible(net)
    two = lambda x: round2(x)
    known = (F.when(total.isNotNull(), 1).otherwise(0) + F.when(tax.isNotNull(), 1).otherwise(0) + F.when(net.isNotNull(), 1).otherwise(0))
    hint = F.when(known == 3, "reconciled_from_pair").when(known > 0, "reconciled_partial")
    none = F.lit(None).cast("double")
    out = F.struct(
        two(F.coalesce(total, tax + net)).alias("total"),
        two(F.coalesce(tax, F.when((total - net).isNotNull(), F.greatest(total - net, F.lit(0.0))))).alias("tax"),
        two(F.when(total.isNotNull() & tax.isNotNull(), F.greatest(total - tax, F.lit(0.0))).otherwise(net)).alias("net"),
        hint.alias("hint"),
    )
    # A tax above its total leaves no net that adds up: the pair is kept, the net is not.
    off = F.abs(out["total"] - (out["net"] + out["tax"])) > 0.05
    only = F.struct(two(F.coalesce(total, none)).alias("total"), two(F.coalesce(tax, none)).alias("tax"), F.when(total - tax >= 0, two(total - tax)).alias("net"), F.lit("reconciled_from_total_only").alias("hint"))
    safe = F.when(off & total.isNotNull(), only).when(off, F.struct(none.alias("total"), F.when(tax.isNotNull(), two(tax)).alias("tax"), F.when(tax.isNull(), two(net)).alias("net"), F.lit("reconciled_from_tax_only").alias("hint"))).otherwise(out)
    if breakdown is None:
        return safe
    fits = F.coalesce((F.size(breakdown) > 0) & F.forall(breakdown, lambda r: plausible(r["base"]).isNotNull() & plausible(r["tax"]).isNotNull()), F.lit(False))
    base, part = F.aggregate(breakdown, F.lit(0.0), lambda a, r: a + r["base"]), F.aggregate(breakdown, F.lit(0.0), lambda a, r: a + r["tax"])
    whole = F.struct(two(two(base) + two(part)).alias("total"), two(part).alias("tax"), two(F.greatest(two(base + part) - two(part), F.lit(0.0))).alias("net"), F.lit("reconciled_from_breakdown").alias("hint"))
    return F.when(fits, whole).otherwise(safe)


#: What each signal adds to a document's anomaly score, and from which score on a level holds. Fixed values.
ANOMALY_WEIGHTS = {
    "DUPLICATE_NUMBER": 30, "INCONSISTENT_TAX": 25, "IBAN_MISMATCH": 25, "DUPLICATE_AMOUNT": 20, "MISSING_NIF": 15,
    "BURST_UPLOAD": 15, "SUSPICIOUS_TOTAL": 10, "DATE_ANOMALY": 5, "ROUND_AMOUNTS": 3, "STRUCTURE_DRIFT": 3,
}
RISK_LEVELS = [("CRITICAL", 50, "block"), ("HIGH", 30, "review"), ("MEDIUM", 15, "flag")]


def severity(weight: Column) -> Column:
    return F.when(weight >= 25, "CRITICAL").when(weight >= 20, "HIGH").when(weight >= 10, "MEDIUM").otherwise("LOW")


def risk_level(score: Column) -> Column:
    out = F.lit("LOW")
    for name, least, _ in reversed(RISK_LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def risk_action(level: Column) -> Column:
    out = F.lit("ignore")
    for name, _, action in RISK_LEVELS:
        out = F.when(level == name, action).otherwise(out)
    return out


def presence(weights: Sequence[tuple[Column, float]], most: float = 1.0) -> Column:
    """The sum of the weights of what is there (not null, empty or 0), most at most."""
    there = [F.when(F.coalesce(c.cast("string"), F.lit("")).isin("", "0", "0.0"), 0.0).otherwise(w) for c, w in weights]
    return F.round(F.least(sum(there, F.lit(0.0)), F.lit(most)), 4)


def answer_confidence(intent: Column, sources: Column, provider: Column) -> Column:
    """How far an answer is trusted: by the provider, three sources or more, and direct lookups; .98 at most."""
    more = F.when(provider == "anthropic", 0.1).otherwise(0.0) + F.when(sources >= 3, 0.1).otherwise(0.0) + F.when(intent == "LOOKUP", 0.05).otherwise(0.0)
    return F.round(F.least(F.lit(0.98), 0.7 + more), 4)
