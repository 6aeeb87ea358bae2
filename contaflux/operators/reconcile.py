"""Reconciliation of bank movements with documents, expenses, invoices and payables, set at a time.

Tiers for a pair, the first that fits: equal references (1.0), a document number inside the
bank text (.85), the bank's reference inside the entity's text (.80), or nearly equal amounts
within 30 days (.6 to .9). Each tier finds its pairs by an equi join (normalised reference;
the last letters of a number; cents), so no pair of tables is ever multiplied out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contaflux.functions.money import cents
from contaflux.functions.text import reference_key

DAYS = 30
LEAST_NEEDLE, GRAM, MOST_SHAPES = 3, 8, 32
_CLASSES = {"a": "[a-z]", "0": "[0-9]", ".": "[^a-z0-9]"}
#: Amounts meet in buckets of so many cents; only those at an edge are looked up in two.
BUCKET = 8
#: Score and label by tier.
TIERS = [("STRONG", 1.0), ("MEDIUM", 0.85), ("MEDIUM", 0.8), ("WEAK", None)]


def entities(rows: DataFrame, kind: str, *, amount: str, date: str, description: str | None = None, reference: str | None = None, document: str | None = None) -> DataFrame:
    """One long frame of what a movement may pay: tenant_id, kind, entity_id, reference (its own
    number, which is also looked for in the bank text), amount, date, description and the
    document_id that stands behind it. Rows without an amount take no part."""
    column = lambda c: F.col(c) if c else F.lit(None).cast("string")
    return rows.where(F.col(amount).isNotNull()).select(
        "tenant_id", F.lit(kind).alias("kind"), F.col("id").alias("entity_id"), column(reference).alias("reference"), F.col(amount).alias("amount"),
        F.col(date).alias("date"), column(description).alias("description"), (F.col(document) if document else F.lit(None).cast("long")).alias("document_id"),
    )


def weak_score(days: Column, bank: Column, text: Column) -> Column:
    """Of nearly equal amounts: by days apart (null: no date), and by what the texts share."""
    by_date = F.when(days.isNull(), 0.3).when(days <= 3, 0.5).when(days <= 7, 0.4).otherwise(0.3)
    tokens = lambda s: F.filter(F.split(s, " "), lambda t: F.length(t) >= 4)
    told = (bank != "") & (text != "")
    by_text = F.when(told & (F.contains(bank, text) | F.contains(text, bank)), 0.2).when(told & F.arrays_overlap(tokens(bank), tokens(text)), 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(0.9), 0.3 + by_date + by_text), 2)


def shape(s: Column) -> Column:
    """A text letter by letter: a for a to z, 0 for a digit, a dot for anything else."""
    return F.regexp_replace(F.translate(s, "bcdefghijklmnopqrstuvwxyz123456789", "a" * 25 + "0" * 9), "[^a0]", ".")


def windows(text: Column, shapes: list[str]) -> Column:
    """The distinct stretches of a text, overlapping ones too, that have one of the shapes (all of one
    length). Of more than MOST_SHAPES only the last letter's is looked at, which gives more stretches."""
    if len(shapes) > MOST_SHAPES:
        ends = {"." * (len(s) - 1) + _CLASSES[s[-1]] for s in shapes}
    else:
        ends = {"".join(_CLASSES[c] for c in s) for s in shapes}
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'|'.join(sorted(ends))}))"), F.lit(1)))


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(nid, tid) where a needle (tenant, nid, needle) lies inside a text (tenant, tid, text).

    Every text that contains a needle contains its last letters: of long needles the last
    GRAM, which tell most, of short ones the last three. A window of a text can only be a
    needle's end if it has the shape of one, so windows of other shapes are no keys. Shapes that
    there are (3 ** GRAM at most) are told to the tasks; lengths of needles that there are none of are left out.
    """
    size = F.when(F.length("needle") >= GRAM, GRAM).when(F.length("needle") >= LEAST_NEEDLE, LEAST_NEEDLE)
    ends = needles.select(shape(F.right("needle", size)).alias("end")).distinct().where("end IS NOT NULL").collect()
    out = None
    for size, least, most in ((GRAM, GRAM, None), (LEAST_NEEDLE, LEAST_NEEDLE, GRAM - 1)):
        shapes = [r["end"] for r in ends if len(r["end"]) == size]
        if not shapes:
            continue
        long_enough = F.length("needle") >= least if most is None else F.length("needle").between(least, most)
        some = needles.where(long_enough).withColumn("gram", F.right("needle", F.lit(size)))
        hay = texts.withColumn("gram", F.explode(windows(F.col("text"), shapes)))
        found = hay.join(some, ["tenant", "gram"]).where(F.contains("text", "needle")).select("nid", "tid")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else needles.crossJoin(texts.limit(0)).select("nid", "tid")


def matches(transactions: DataFrame, against: DataFrame) -> DataFrame:
    """(tx_id, kind, entity_id, document_id, match_type, score) of the pairs of a tenant that
    have a tier: the first tier of each pair, even where a later one would score more.

    transactions: id, tenant_id, amount, date, reference, description; against: entities().
    Null references, texts and dates match nothing by themselves; an entity without a date can
    still match by its amount.
    """
    bank = transactions.select(F.col("id").alias("tx_id"), F.col("tenant_id").alias("tenant"), F.abs("amount").alias("bank_amount"), F.col("date").alias("bank_date"), reference_key(F.col("reference")).alias("bank_ref"), reference_key(F.col("description")).alias("bank_text"))
    who = ["kind", "entity_id", "document_id"]
    those = against.select(F.col("tenant_id").alias("tenant"), F.struct(*who).alias("e"), F.abs("amount").alias("amount"), F.col("date").alias("entity_date"), reference_key(F.col("reference")).alias("number"), reference_key(F.col("description")).alias("entity_text"))
    tier = lambda n: [F.lit(n).alias("tier"), F.lit(None).cast("double").alias("weak")]
    strong = bank.where("bank_ref <> ''").join(those, (bank["tenant"] == those["tenant"]) & (F.col("bank_ref") == F.col("number"))).select("tx_id", "e", *tier(0))
    numbers = those.select("tenant", F.col("e").alias("nid"), F.col("number").alias("needle"))
    inside = contained(numbers, bank.select("tenant", F.col("tx_id").alias("tid"), F.col("bank_text").alias("text")))
    inside = inside.select(F.col("tid").alias("tx_id"), F.col("nid").alias("e"), *tier(1))
    told = contained(bank.select("tenant", F.col("tx_id").alias("nid"), F.col("bank_ref").alias("needle")), those.select("tenant", F.col("e").alias("tid"), F.col("entity_text").alias("text")))
    told = told.select(F.col("nid").alias("tx_id"), F.col("tid").alias("e"), *tier(2))
    bucket = lambda c: F.floor(c / BUCKET)
    near = bank.withColumn("cents", cents(F.col("bank_amount"))).withColumn("key", F.explode(F.array_distinct(F.array(bucket(F.col("cents") - 1), bucket(F.col("cents") + 1)))))
    keyed = those.withColumn("key", bucket(cents(F.col("amount"))))
    days = F.abs(F.unix_micros(F.col("bank_date").cast("timestamp")) - F.unix_micros(F.col("entity_date").cast("timestamp"))) / F.lit(8.64e10)
    weak = near.join(keyed, (near["tenant"] == keyed["tenant"]) & (near["key"] == keyed["key"])).withColumn("days", days)
    weak = weak.where((F.abs(F.col("bank_amount") - F.col("amount")) < 0.01) & (F.col("days").isNull() | (F.col("days") <= DAYS)))
    weak = weak.select("tx_id", "e", F.lit(3).alias("tier"), weak_score(F.col("days"), F.col("bank_text"), F.col("entity_text")).alias("weak"))
    every = strong.unionByName(inside).unionByName(told).unionByName(weak).select("tx_id", *(F.col(f"e.{c}").alias(c) for c in who), "tier", "weak")
    # Minima of numbers are hashed as they come; one of a struct would sort all pairs first.
    best = every.groupBy("tx_id", *who).agg(F.min("tier").alias("tier"), F.min("weak").alias("weak"))
    of_tier = lambda i: F.element_at(F.array(*(F.lit(t[i]) for t in TIERS)), F.col("tier") + 1)
    return best.select("tx_id", *who, of_tier(0).alias("match_type"), F.coalesce(of_tier(1), "weak").alias("score"))


def candidates(transactions: DataFrame, documents: DataFrame) -> DataFrame:
    """(tx_id, document_id, match_type, score) of movements and documents (id, tenant_id, total,
    doc_date, doc_number, and counterparty where they have it: without it texts share nothing)."""
    told = "counterparty" if "counterparty" in documents.columns else None
    rows = entities(documents, "doc", amount="total", date="doc_date", reference="doc_number", description=told, document="id")
    return matches(transactions, rows).select("tx_id", "document_id", "match_type", "score")


def best_of(found: DataFrame) -> DataFrame:
    """Of matches() the best of each movement and kind, ties by entity_id. A payable counts only
    with a document, and only where it beats the movement's best document."""
    order = Window.partitionBy("tx_id", "kind").orderBy(F.desc("score"), "entity_id")
    found = found.where((F.col("kind") != "pay") | F.col("document_id").isNotNull())
    best = found.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    best = best.withColumn("__doc", F.max(F.when(F.col("kind") == "doc", F.col("score"))).over(Window.partitionBy("tx_id")))
    return best.where((F.col("kind") != "pay") | F.col("__doc").isNull() | (F.col("score") > F.col("__doc"))).drop("__doc")


def suggestions(transactions: DataFrame, documents: DataFrame) -> DataFrame:
    """The best document of each movement, ties by document id."""
    order = Window.partitionBy("tx_id").orderBy(F.desc("score"), "document_id")
    return candidates(transactions, documents).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("match_type").agg(F.count("*").alias("n"))


def open_transactions(transactions: DataFrame, found: DataFrame) -> DataFrame:
    """Movements without a suggestion. found: tx_id, and if it has a status only PENDING and
    ACCEPTED ones count; movements with reconciled_at, where there is such a column, are done."""
    busy = found.where(F.col("status").isin("PENDING", "ACCEPTED")) if "status" in found.columns else found
    rows = transactions.where(F.col("reconciled_at").isNull()) if "reconciled_at" in transactions.columns else transactions
    return rows.join(busy.select(F.col("tx_id").alias("id")), "id", "left_anti")


def decided(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Suggestions (id, tx_id, status ...) after decisions (id, accept): an accepted pending one
    is ACCEPTED and the other pending ones of its movement are REJECTED; a refused pending one
    is REJECTED. Others, and decisions on what isn't pending, change nothing. Of two accepted
    ones of a movement the smaller id holds."""
    pending = F.col("status") == "PENDING"
    rows = found.join(decisions.dropDuplicates(["id"]), "id", "left")
    winner = F.min(F.when(pending & F.col("accept"), F.col("id"))).over(Window.partitionBy("tx_id"))
    rows = rows.withColumn("__winner", winner)
    after = F.when(pending & (F.col("id") == F.col("__winner")), "ACCEPTED").when(pending & (F.col("__winner").isNotNull() | ~F.coalesce("accept", F.lit(True))), "REJECTED").otherwise(F.col("status"))
    return rows.withColumn("status", after).drop("__winner", "accept")


def reconciled(transactions: DataFrame, after: DataFrame, when: Column) -> DataFrame:
    """Movements with reconciled_at: when, for those that have an accepted suggestion."""
    done = after.where("status = 'ACCEPTED'").select(F.col("tx_id").alias("id"), F.lit(True).alias("__done")).distinct()
    return transactions.join(done, "id", "left").withColumn("reconciled_at", F.when(F.col("__done"), when)).drop("__done")


def payables_of(after: DataFrame, payables: DataFrame) -> DataFrame:
    """(suggestion_id, payable_id) for accepted suggestions (id, document_id, status): the first
    payable of the document that isn't paid, by id; none where there is none."""
    first = payables.where("status <> 'PAID'").groupBy("document_id").agg(F.min("id").alias("payable_id"))
    return after.where("status = 'ACCEPTED'").select(F.col("id").alias("suggestion_id"), "document_id").join(first, "document_id", "left").select("suggestion_id", "payable_id")
