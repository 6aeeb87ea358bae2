"""Dates: bank formats, quarters, recurrences that overflow months, business days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bank_date(s: Column) -> Column:
    """yyyy-MM-dd, dd/MM/yyyy, dd-MM-yyyy or dd.MM.yyyy, years of two digits in this century; impossible dates are null."""
    s = F.trim(s)
    plain = F.regexp_replace(F.regexp_replace(s, "[.-]", "/"), r"^(\d{1,2}/\d{1,2})/(\d{2})$", "$1/20$2")
    return F.coalesce(F.try_to_date(s, "yyyy-MM-dd"), F.try_to_date(plain, "d/M/yyyy"))


def quarter_start(year: int, quarter: int) -> Column:
    return F.make_date(F.lit(year), F.lit(3 * quarter - 2), F.lit(1))


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def months_later(d: Column, months: Column | int) -> Column:
    """The same day so many months later; days that the month lacks run over into the next."""
    return F.date_add(F.add_months(F.trunc(d, "MM"), months), F.dayofmonth(d) - 1)


def recurrences(first: Column, months: int, last: Column, most: int = 12) -> Column:
    """The dates of a recurrence, each from the one before (so an overflow stays), at most so many."""
    out = F.array(first)
    for _ in range(most - 1):
        out = F.concat(out, F.array(months_later(F.element_at(out, -1), months)))
    return F.filter(out, lambda d: d <= last)


def business_days_later(d: Column, days: int) -> Column:
    """So many days later, Saturdays and Sundays not counted."""
    span = F.sequence(F.date_add(d, 1), F.date_add(d, 2 * days + 4))
    return F.element_at(F.filter(span, lambda x: F.weekday(x) < 5), days)


def days_until(due: Column, now: Column) -> Column:
    return F.ceil((F.unix_micros(due.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 8.64e10)


def schedule_status(status: Column, due: Column, today: Column) -> Column:
    return F.when(status.isin("PAID", "CANCELLED"), status).when(due < today, F.lit("OVERDUE")).otherwise(F.lit("SCHEDULED"))


def quarter_end(year: int, quarter: int) -> Column:
    """The first day after a quarter."""
    return F.add_months(quarter_start(year, quarter), 3)


def qr_date(s: Column) -> Column:
    """yyyyMMdd as yyyy-MM-dd, without a look at the calendar; null for anything else."""
    shape = r"^(\d{4})(\d{2})(\d{2})$"
    return F.when(F.trim(s).rlike(shape), F.regexp_replace(F.trim(s), shape, "$1-$2-$3"))


_INVOICE = r"^(?:(\d{4})-(\d{1,2})-(\d{1,2})|(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}))$"


def invoice_date(s: Column, country: Column) -> Column:
    """A struct of date and ambiguous of yyyy-M-d or d/M/yyyy; the month comes first for US, and
    where only the second number can be a day. Impossible dates are null."""
    part = lambda i: F.regexp_extract(s, _INVOICE, i).try_cast("int")
    first, second = part(4), part(5)
    turned = (F.coalesce(country, F.lit("")) == "US") | ((first <= 12) & (second > 12))
    month, day = F.when(turned, first).otherwise(second), F.when(turned, second).otherwise(first)
    made = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    date = F.when(part(1).isNotNull(), made(part(1), part(2), part(3))).when(first.isNotNull(), made(part(6), month, day))
    return F.struct(date.alias("date"), F.coalesce((first <= 12) & (second <= 12), F.lit(False)).alias("ambiguous"))


def month_phrase(query: Column, today: Column) -> Column:
    """A struct of the first and last day of the month that a question speaks of: this, the next
    or the last month, or MM/yyyy of this century; null if it speaks of none."""
    month = lambda d: F.struct(F.trunc(d, "MM").cast("date").alias("start"), F.last_day(d).alias("end"))
    said = r"\b(\d{1,2})[/-](\d{4})\b"
    m, y = F.regexp_extract(query, said, 1).try_cast("int"), F.regexp_extract(query, said, 2).try_cast("int")
    named = F.when(m.between(1, 12) & (y > 2000) & (y < 2100), F.make_date(y, m, F.lit(1)))
    return (
        F.when(query.rlike(r"\b(?:este mes|mes corrente|mes atual|este m[êe]s)\b"), month(today))
        .when(query.rlike(r"\b(?:proximo mes|pr[óo]ximo m[êe]s)\b"), month(F.add_months(F.trunc(today, "MM"), 1)))
        .when(query.rlike(r"\b(?:mes passado|m[êe]s passado)\b"), month(F.add_months(F.trunc(today, "MM"), -1)))
        .when(named.isNotNull(), month(named))
    )


def default_due(d: Column) -> Column:
    return F.date_add(d, 30)


def calendar_date(s: Column) -> Column:
    """A date that is written yyyy-MM-dd and is in the calendar, else null."""
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))


def date_slug(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def stepped(d: Column, kind: Column, interval: Column) -> Column:
    """The next date of a recurrence: DAILY, WEEKLY, MONTHLY, QUARTERLY or YEARLY, interval of them later."""
    n = F.coalesce(interval, F.lit(1))
    months = months_later(d, F.when(kind == "MONTHLY", n).when(kind == "QUARTERLY", 3 * n).otherwise(12 * n))
    return F.when(kind == "DAILY", F.date_add(d, n)).when(kind == "WEEKLY", F.date_add(d, 7 * n)).when(kind.isin("MONTHLY", "QUARTERLY", "YEARLY"), months)
