"""State changes as snapshots: a transition is a projection of the rows it applies to."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Allowed changes of a document's status. Fixed values.
APPROVABLE = ["NOVO", "EM_REVISAO"]


def approved(documents: DataFrame) -> DataFrame:
    """New status and outcome of approving every document: approved, unchanged or conflict."""
    outcome = F.when(F.col("status").isin(APPROVABLE), "approved").when(F.col("status") == "APROVADO", "unchanged").otherwise("conflict")
    return documents.select("id", outcome.alias("outcome"), F.when(F.col("status").isin(APPROVABLE), "APROVADO").otherwise(F.col("status")).alias("status"))


def outcomes(changed: DataFrame) -> DataFrame:
    return changed.groupBy("outcome").agg(F.count("*").alias("n"))


def payables_from(documents: DataFrame, payables: DataFrame) -> DataFrame:
    """New payables of received invoices that have none yet; due 30 days after the date where no due date is known."""
    fresh = documents.where("type = 'FATURA_RECEBIDA' and status <> 'ARQUIVADO'").join(payables.select(F.col("document_id").alias("id")), "id", "left_anti")
    return fresh.select(F.col("id").alias("document_id"), "party_id", F.col("total").alias("amount"), F.coalesce("due_date", F.date_add("doc_date", 30)).alias("due_date"), F.lit("TO_PAY").alias("status"))


def scheduled(payables: DataFrame) -> DataFrame:
    """Approving payables: TO_PAY ones become SCHEDULED, paid and cancelled ones are a conflict, others stay."""
    outcome = F.when(F.col("status").isin("PAID", "CANCELLED"), "conflict").when(F.col("approved"), "unchanged").otherwise("approved")
    return payables.select("id", outcome.alias("outcome"), F.when((outcome == "approved") & (F.col("status") == "TO_PAY"), "SCHEDULED").otherwise(F.col("status")).alias("status"), (F.col("approved") | (outcome == "approved")).alias("approved"))


def paid(payables: DataFrame, payments: DataFrame, today: datetime.date) -> DataFrame:
    """Payables after payments (payable_id, amount, and a reason where there is one): paid within a
    cent, or with another amount if a reason is given; difference otherwise; rejected if not approved."""
    reason = F.max("reason") if "reason" in payments.columns else F.lit(None).cast("string")
    sums = payments.groupBy("payable_id").agg(F.sum("amount").alias("paid"), reason.alias("reason"))
    rows = payables.join(sums, F.col("id") == F.col("payable_id"))
    outcome = F.when(~F.col("approved"), "rejected").when((F.abs(F.col("paid") - F.col("amount")) <= 0.01) | (F.coalesce("reason", F.lit("")) != ""), "paid").otherwise("difference")
    return rows.select("id", outcome.alias("outcome"), F.when(outcome == "paid", F.lit(today)).alias("paid_at"))


def iban_history(before: DataFrame, after: DataFrame) -> DataFrame:
    """A history row for each party (id, iban) that is new or whose account changed."""
    old = before.select("id", F.col("iban").alias("old_iban"))
    rows = after.select("id", F.col("iban").alias("new_iban")).join(old, "id", "left")
    return rows.where(~F.upper(F.regexp_replace("new_iban", r"\s", "")).eqNullSafe(F.upper(F.regexp_replace("old_iban", r"\s", ""))))


def repointed(children: DataFrame, moved: DataFrame, column: str) -> DataFrame:
    """children whose parent in column was merged (moved: old_id, new_id) now name the new one."""
    rows = children.join(moved.select(F.col("old_id").alias("__o"), F.col("new_id").alias("__n")), F.col(column) == F.col("__o"), "left")
    return rows.withColumn(column, F.coalesce("__n", column)).drop("__o", "__n")


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing rows and, of incoming, those whose key is new."""
    return existing.unionByName(incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"))


def paid_events(events: DataFrame, ids: DataFrame, today: datetime.date) -> DataFrame:
    """Payment events after those of ids (id) are paid: a second time changes nothing."""
    rows = events.join(ids.select("id", F.lit(True).alias("__pay")).distinct(), "id", "left")
    turn = F.col("__pay") & (F.col("status") != "PAID")
    paid_at = F.col("paid_at") if "paid_at" in events.columns else F.lit(None).cast("date")
    return rows.withColumns({"paid_at": F.when(turn, F.lit(today)).otherwise(paid_at), "status": F.when(turn, "PAID").otherwise(F.col("status"))}).drop("__pay")


def removed(rows: DataFrame, ids: DataFrame, column: str, value) -> DataFrame:
    """rows of which those named in ids (id) are marked as gone by a value in a column; none is deleted."""
    gone = ids.select("id", F.lit(True).alias("__gone")).distinct()
    return rows.join(gone, "id", "left").withColumn(column, F.when(F.col("__gone"), F.lit(value)).otherwise(F.col(column))).drop("__gone")


def regenerated(items: DataFrame, periods: DataFrame, fresh: DataFrame) -> DataFrame:
    """Payroll items (period, id ...) after fresh ones were made: periods (period, status) in DRAFT lose
    their old items and get the fresh ones, closed ones keep theirs."""
    draft = periods.where("status = 'DRAFT'").select("period")
    return items.join(draft, "period", "left_anti").select(*items.columns).unionByName(fresh.join(draft, "period", "left_semi").select(*items.columns))


def closed(periods: DataFrame, ids: DataFrame) -> DataFrame:
    """(period, status, outcome) of closing periods: DRAFT ones become CLOSED, others are a conflict."""
    rows = periods.join(ids.select("period").distinct(), "period", "left_semi")
    return rows.select("period", F.lit("CLOSED").alias("status"), F.when(F.col("status") == "DRAFT", "closed").otherwise("conflict").alias("outcome"))


def imputed(costs: DataFrame) -> DataFrame:
    """Two rows of each cost of a vehicle (id, vehicle_id, amount, date): an expense and a maintenance entry."""
    kinds = F.array(F.struct(F.lit("expense").alias("kind"), F.lit(None).cast("long").alias("of")), F.struct(F.lit("maintenance").alias("kind"), F.col("vehicle_id").cast("long").alias("of")))
    return costs.withColumn("k", F.explode(kinds)).select("id", "k.kind", F.col("k.of").alias("vehicle_id"), "amount", "date")


def single_default(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """rows (id, tenant_id, is_default) after the chosen (id) became their tenant's default: of a tenant
    with a chosen row only that (the smallest id of several) is one, other tenants stay as they are."""
    new = rows.join(chosen.select("id").distinct(), "id", "left_semi").groupBy("tenant_id").agg(F.min("id").alias("__new"))
    return rows.join(new, "tenant_id", "left").withColumn("is_default", F.when(F.col("__new").isNotNull(), F.col("id") == F.col("__new")).otherwise(F.col("is_default"))).drop("__new")


def moved_stages(deals: DataFrame, moves: DataFrame, defaults: dict[str, int], now: datetime.datetime) -> tuple[DataFrame, DataFrame]:
    """(deals, notes) after moves (id, to, probability): the stage changes, the probability is the given
    one within 0 to 100, else the stage's default; WON and LOST are timed and other stages clear both
    times. A move to the same stage changes at most the probability and leaves no note."""
    table = F.create_map(*(F.lit(x) for pair in defaults.items() for x in pair))
    rows = deals.join(moves.dropDuplicates(["id"]).select("id", "to", F.col("probability").alias("__p")), "id", "left")
    told = F.when(F.col("__p").isNotNull(), F.least(F.greatest(F.col("__p"), F.lit(0)), F.lit(100)))
    change = F.col("to").isNotNull() & (F.col("to") != F.col("stage"))
    after = rows.withColumns({
        "probability": F.when(change, F.coalesce(told, F.try_element_at(table, F.col("to")))).otherwise(F.coalesce(told, F.col("probability"))),
        "won_at": F.when(change, F.when(F.col("to") == "WON", F.lit(now))).otherwise(F.col("won_at")),
        "lost_at": F.when(change, F.when(F.col("to") == "LOST", F.lit(now))).otherwise(F.col("lost_at")),
        "stage": F.when(change, F.col("to")).otherwise(F.col("stage")),
    })
    notes = rows.where(change).select(F.col("id").alias("deal_id"), F.lit("NOTE").alias("type"), F.concat(F.lit("Stage change: "), "stage", F.lit(" → "), "to").alias("subject"))
    return after.drop("to", "__p"), notes


def completed(activities: DataFrame, ids: DataFrame) -> DataFrame:
    """How many distinct ids were asked for, how many of them were open and are now complete, and how many were not."""
    asked = ids.select("id").distinct()
    open_ = activities.where("completed_at IS NULL").select("id", F.lit(1).alias("__open"))
    rows = asked.join(open_, "id", "left")
    return rows.agg(F.count("*").alias("requested"), F.count("__open").alias("completed"), (F.count("*") - F.count("__open")).alias("missing"))


def edited_items(items: DataFrame, edits: DataFrame) -> DataFrame:
    """Items (document_id, line, quantity, price, discount, tax_rate) after edits with the same columns
    and an action: add and update put a row in its place, remove takes it out."""
    keys = ["document_id", "line"]
    kept = items.join(edits.select(*keys), keys, "left_anti").select(*items.columns)
    return kept.unionByName(edits.where("action IN ('add', 'update')").select(*items.columns))

