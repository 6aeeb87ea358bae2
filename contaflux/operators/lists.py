"""Lists of a tenant's rows: filters, pages, lookups of related rows, and what a list shows."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contaflux.functions.money import cents, pt_amount
from contaflux.functions.text import labelled

#: Statuses of a payable that is still to be paid.
UNPAID = ["TO_PAY", "OVERDUE"]
#: Files that may be uploaded: extensions, MIME types and bytes. Fixed values.
EXTENSIONS = [".pdf", ".jpg", ".jpeg", ".png", ".doc", ".docx"]
MOST_BYTES = 20 * 1024 * 1024


def of_tenant(rows: DataFrame, tenant: int) -> DataFrame:
    """The rows of one tenant; a missing tenant is an error, not all rows."""
    if tenant is None:
        raise ValueError("no tenant")
    return rows.where(F.col("tenant_id") == tenant)


def for_tenant(rows: DataFrame, tenant: int) -> DataFrame:
    """rows to be written, with their tenant: null becomes the given one, another one fails the job."""
    if tenant is None:
        raise ValueError("no tenant")
    foreign = F.raise_error(F.concat(F.lit("a row of another tenant: "), F.col("tenant_id").cast("string")))
    kind = dict(rows.dtypes)["tenant_id"]
    return rows.withColumn("tenant_id", F.when(F.col("tenant_id").isNull() | (F.col("tenant_id") == tenant), F.lit(tenant).cast(kind)).otherwise(foreign.cast(kind)))


def narrowed(rows: DataFrame, **equal) -> DataFrame:
    """rows whose columns equal the given values; None is no condition, a list is any of it."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name).isin(value) if isinstance(value, (list, tuple)) else F.col(name) == F.lit(value))
    return rows


def between(rows: DataFrame, column: str, first=None, last: datetime.date | None = None) -> DataFrame:
    """rows from the first to the end of the last day; a null date is in no range."""
    if first is not None:
        rows = rows.where(F.col(column) >= F.lit(first))
    if last is not None:
        rows = rows.where(F.col(column) < F.lit(last + datetime.timedelta(days=1)))
    return rows


def searched(rows: DataFrame, text: str | None, folded: list[str], exact: list[str] = ()) -> DataFrame:
    """rows that hold text in one of the columns, in any case in the folded ones."""
    if not text:
        return rows
    hits = [F.contains(F.lower(F.col(c)), F.lit(text.lower())) for c in folded] + [F.contains(F.col(c), F.lit(text)) for c in exact]
    return rows.where(reduce(lambda a, b: a | b, (F.coalesce(h, F.lit(False)) for h in hits)))


def documents(rows: DataFrame, *, status: str | None = None, kind: str | None = None, party: int | None = None, first=None, last=None, text: str | None = None) -> DataFrame:
    """Documents by type, party, day and text; archived ones only where their status is asked for."""
    rows = narrowed(rows, status=status, type=kind, party_id=party) if status else narrowed(rows.where("status <> 'ARQUIVADO'"), type=kind, party_id=party)
    return searched(between(rows, "doc_date", first, last), text, ["doc_number", "counterparty", "file_hash"])


def movements(rows: DataFrame, *, first=None, last=None, text: str | None = None, source: str | None = None) -> DataFrame:
    """Bank movements by day, source and text in description, reference or counterparty (those that there are)."""
    rows = narrowed(between(rows, "date", first, last), source=source)
    return searched(rows, text, [c for c in ("description", "reference", "counterparty") if c in rows.columns])


def payables(rows: DataFrame, today: datetime.date, *, status: str | None = None, party: int | None = None, approved_only: bool = False, overdue_only: bool = False, first=None, last=None) -> DataFrame:
    """Payables by status, party and due date; overdue_only takes the place of status and dates."""
    rows = narrowed(rows, party_id=party)
    rows = rows.where("approved") if approved_only else rows
    if overdue_only:
        return rows.where((F.col("due_date") < F.lit(today)) & F.col("status").isin(UNPAID))
    return between(narrowed(rows, status=status), "due_date", first, last)


def pending_activities(rows: DataFrame, now: datetime.datetime, only_overdue: bool = False, most: int = 500) -> DataFrame:
    """Open activities with a due time, soonest first, at most so many: overdue, and days until due rounded up."""
    due = F.col("due") < F.lit(now)
    rows = rows.where(F.col("completed_at").isNull() & (due if only_overdue else F.col("due").isNotNull()))
    days = F.ceil((F.unix_micros(F.col("due").cast("timestamp")) - F.unix_micros(F.lit(now))) / F.lit(8.64e10))
    return rows.withColumns({"overdue": due, "days": days}).orderBy("due", "id").limit(most)


def sync_history(rows: DataFrame, source: str, page: int, size: int) -> DataFrame:
    """A page of the history, newest first, of which only the rows of one source (in the JSON
    metadata) are shown: the page is cut first, so it can be short."""
    cut = rows.orderBy(F.desc("created_at"), "id").offset((page - 1) * size).limit(size)
    return cut.where(F.get_json_object("metadata", "$.source") == source)


def calendar_events(rows: DataFrame, first: datetime.date, last: datetime.date, today: datetime.date) -> DataFrame:
    """Events due in a window, with days until due; a pending one of the past is OVERDUE."""
    days = F.datediff("due_date", F.lit(today))
    status = F.when((F.col("status") == "PENDING") & (days < 0), "OVERDUE").otherwise(F.col("status"))
    return between(rows, "due_date", first, last).withColumns({"days": days, "status": status})


def schedule_window(rows: DataFrame, first: datetime.date, last: datetime.date) -> DataFrame:
    """Schedules due in a window, and recurring ones that begin before its end."""
    inside = (F.col("due_date") >= F.lit(first)) & (F.col("due_date") <= F.lit(last))
    return rows.where(inside | (F.col("recurrence").isNotNull() & (F.col("due_date") <= F.lit(last))))


def valid_upload(extension: Column, mime: Column, size: Column) -> Column:
    """Whether a file may be uploaded: its extension and MIME type are known and it is not empty or too large."""
    kind = mime.startswith("image/") | mime.isin("application/pdf", "application/msword") | mime.startswith("application/vnd.openxmlformats")
    return F.coalesce(F.lower(extension).isin(EXTENSIONS) & kind & size.between(1, MOST_BYTES), F.lit(False))


def page(rows: DataFrame, order: list[Column], number: int, size: int, most: int = 200) -> DataFrame:
    """A page of rows in an order, which must end in a unique column; size is at most ``most``."""
    size = min(size, most)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int) -> DataFrame:
    """total rows, and pages of size of them."""
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def with_parent(rows: DataFrame, parents: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """rows with a struct of the columns of the row that key names in parents (by id), null
    where it names none. id must be unique in parents."""
    side = parents.select(F.col("id").alias("__id"), F.struct("id", *columns).alias(name))
    return rows.join(side, F.col(key) == F.col("__id"), "left").drop("__id")


def with_latest(parents: DataFrame, children: DataFrame, key: str, order: list[Column], columns: list[str], name: str, most: int = 20) -> DataFrame:
    """parents with an array of structs of the first so many children in an order (ties by id), at
    least empty. At most ``most`` rows a parent are gathered."""
    top = children.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order, "id"))).where(F.col("__r") <= most)
    lists = top.groupBy(F.col(key).alias("__id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "id", *columns))), lambda x: F.struct(x["id"].alias("id"), *(x[c].alias(c) for c in columns))).alias(name))
    out = parents.join(lists, F.col("id") == F.col("__id"), "left").drop("__id")
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(lists.schema[name].dataType)))


def with_count(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """parents with how many children name them."""
    counts = children.groupBy(F.col(key).alias("__id")).agg(F.count("*").alias(name))
    return parents.join(counts, F.col("id") == F.col("__id"), "left").drop("__id").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def with_children(rows: DataFrame, parent: str) -> DataFrame:
    """Rows of a tree (id, parent) with how many children each has and the sorted ids of them.
    An account has a handful of children, so the arrays are short."""
    below = rows.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("__id")).agg(F.array_sort(F.collect_list("id")).alias("children"))
    out = rows.join(below, F.col("id") == F.col("__id"), "left").drop("__id")
    return out.withColumn("children", F.coalesce("children", F.array().cast("array<long>")))


def by_rank(ranked: DataFrame, rows: DataFrame, number: int, size: int) -> DataFrame:
    """The rows of a page of ranked (id, rank), in its order: only the page's ids are looked up."""
    ids = ranked.orderBy(F.desc("rank"), "id").offset((number - 1) * size).limit(size)
    return rows.join(F.broadcast(ids), "id").orderBy(F.desc("rank"), "id")  # a page of ids


def recent(rows: DataFrame, most: int, shift: int = 60) -> DataFrame:
    """The latest documents with a score that falls with their place."""
    top = rows.orderBy(F.desc("doc_date"), F.desc("id")).limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("doc_date"), F.desc("id")))  # of a short list
    return top.withColumn("rank", place - 1).withColumn("score", F.round(1 / (F.col("rank") + shift + 1), 9))


def document_view(rows: DataFrame) -> DataFrame:
    """Documents as they are shown: without file keys and hashes, amounts as doubles."""
    hidden = [c for c in ("file_key", "file_hash") if c in rows.columns]
    return rows.drop(*hidden).withColumn("total", F.col("total").cast("double"))


def suggestion_view(found: DataFrame, transactions: DataFrame) -> DataFrame:
    """Suggestions with their movement as a struct; amounts and texts of a missing one are 0 and empty."""
    side = transactions.select(F.col("id").alias("__id"), "amount", "description", "date")
    rows = found.join(side, F.col("tx_id") == F.col("__id"), "left")
    movement = F.struct(F.col("tx_id").alias("id"), F.coalesce("amount", F.lit(0.0)).alias("amount"), F.coalesce("description", F.lit("")).alias("description"), F.col("date").alias("date"))
    return rows.select("id", "status", "match_type", "score", "document_id", movement.alias("movement"))


def document_snippet(name: Column, number: Column, date: Column, total: Column, kind: Column, status: Column, *, supplier: Column | None = None, nif: Column | None = None, formatted: bool = True) -> Column:
    """What a document tells an answer, a line for each known field."""
    none = F.lit(None).cast("string")
    money = F.concat(pt_amount(total) if formatted else total.cast("string"), F.lit(" EUR"))
    return labelled(("Documento: ", name), ("Fornecedor: ", supplier if supplier is not None else none), ("NIF: ", nif if nif is not None else none), ("Numero: ", number), ("Data: ", F.date_format(date, "yyyy-MM-dd")), ("Total: ", money), ("Tipo: ", kind), ("Estado: ", status))


def payable_snippet(description: Column, amount: Column, due: Column, status: Column) -> Column:
    return F.concat(F.lit("PayableItem:\n"), labelled(("Descricao: ", description), ("Valor: ", F.concat(pt_amount(amount), F.lit(" EUR"))), ("Vencimento: ", F.date_format(due, "yyyy-MM-dd")), ("Estado: ", status)))


def embedding_text(name: Column, supplier: Column, number: Column, date: Column, total: Column, kind: Column, metadata: Column) -> Column:
    """What of a document is embedded, with two fields of its JSON metadata."""
    return labelled(
        ("", name), ("Fornecedor: ", supplier), ("Documento: ", number), ("Data: ", F.date_format(date, "yyyy-MM-dd")), ("Total: ", F.concat(F.format_string("%.2f", total), F.lit(" EUR"))),
        ("Tipo: ", kind), ("NIF: ", F.get_json_object(metadata, "$.supplierNif")), ("ATCUD: ", F.get_json_object(metadata, "$.atcud")),
    )


def items_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(document_id, line, description, total) of documents (id, metadata): stored items, and for
    documents without any those of the JSON metadata, numbered from 1; unreadable numbers are null."""
    schema = "array<struct<description:string,lineTotal:string>>"
    stored = items.select("document_id", "line", "description", "total")
    without = docs.join(items.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti")
    told = without.select(F.col("id").alias("document_id"), F.posexplode(F.from_json(F.get_json_object("metadata", "$.extraction.lineItems"), schema)).alias("at", "i"))
    number = F.col("i.lineTotal").try_cast("double")
    return stored.unionByName(told.select("document_id", (F.col("at") + 1).alias("line"), F.col("i.description").alias("description"), F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number).alias("total")))


def unwrapped(values: Column) -> Column:
    """Of an array of (value, primary) the primary's value, else the first one's; null of none."""
    return F.coalesce(F.get(F.filter(values, lambda x: x["primary"]), F.lit(0))["value"], F.get(values, F.lit(0))["value"])


def projected(rows: DataFrame, fields: dict[str, str], kinds: dict[str, str] | None = None, kind_default: str = "COMPANY") -> DataFrame:
    """rows (id, raw: a map of text) under the target names of a mapping (source to target);
    empty texts are null, the type goes through kinds, and an unmapped country is Portugal.
    Two sources of one target: the first of the mapping."""
    targets: dict[str, Column] = {}
    for source, target in fields.items():
        targets.setdefault(target, F.nullif(F.try_element_at(F.col("raw"), F.lit(source)), F.lit("")))
    kind = F.lit(None).cast("string")
    for name, value in (kinds or {}).items():
        kind = F.when(targets.get("type", F.lit(None)) == name, F.lit(value)).otherwise(kind)
    targets["type"] = F.coalesce(kind, F.lit(kind_default))
    targets["country"] = F.coalesce(targets.get("country", F.lit(None).cast("string")), F.lit("Portugal"))
    return rows.select("id", *(c.alias(name) for name, c in targets.items()))


def kpis(rows: DataFrame) -> DataFrame:
    """What is to be paid (with what is overdue), overdue, and approved, in all."""
    total = lambda condition: F.coalesce(F.sum(F.when(condition, cents(F.col("amount")))), F.lit(0)) / F.lit(100.0)
    return rows.agg(total(F.col("status").isin(UNPAID)).alias("to_pay"), total(F.col("status") == "OVERDUE").alias("overdue"), total(F.col("approved")).alias("approved"))


def nested(items: DataFrame, parent: str, columns: list[str], most: int = 1000) -> DataFrame:
    """A row for each parent with n, how many items it has, and items, the first `most` of them by the
    columns (structs). A parent with more keeps its count; the rest is left to a page of its own, so
    that no row grows without end."""
    by = Window.partitionBy(parent).orderBy(*columns)
    counts = items.groupBy(parent).agg(F.count("*").alias("n"))
    first = items.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= most)
    lists = first.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("items"))
    return counts.join(lists, parent)


def missing(rows: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """The keys of rows that known hasn't got. A null key is known to nobody and stays."""
    return rows.select(key).join(known.select(key).distinct(), key, "left_anti")


def page_nulls_last(rows: DataFrame, column: str, then: list[str], offset: int, size: int) -> DataFrame:
    """A page in the order of a column, nulls at the end, then of the others."""
    return rows.orderBy(F.asc_nulls_last(column), *then).offset(offset).limit(size)


def previous(rows: DataFrame, by: str, order: list[str], key: str = "id") -> DataFrame:
    """key and previous_<key>: the row before of the same group, null for its first."""
    return rows.select(key, F.lag(key).over(Window.partitionBy(by).orderBy(*order)).alias(f"previous_{key}"))
