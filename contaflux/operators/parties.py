"""Parties and contacts: duplicates, fraud risk, payment eligibility, merges."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contaflux.functions.fiscal import iban_plain, iban_valid, nif_plain, nif_valid, tax_id_valid, vat_plain
from contaflux.functions.money import cents
from contaflux.functions.text import name_key, phone_key


PASSES = [("nif", 1.0), ("email", 0.95), ("name", 0.7), ("phone", 0.9)]


def contact_clusters(contacts: DataFrame) -> DataFrame:
    """(id, reason, score, cluster): passes by tax number, e-mail, name and phone; who is in
    a cluster of an earlier pass takes no part in later ones; a cluster needs two members
    and is named by its smallest id.

    One frame goes through all passes: a window by the key (rows without one, or already in a
    cluster, lie apart by their id) tells how many share it, so nothing is read or joined twice.
    """
    keys = {"nif": F.col("nif8"), "email": F.lower(F.trim("email")), "name": name_key(F.col("name")), "phone": phone_key(F.col("phone"))}
    rows = contacts.select("id", *(c.alias(name) for name, c in keys.items()), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("double").alias("score"), F.lit(None).cast(dict(contacts.dtypes)["id"]).alias("cluster"))
    for name, score in PASSES:
        free = F.col("reason").isNull() & F.col(name).isNotNull() & (F.col(name) != "")
        same = Window.partitionBy(F.when(free, F.col(name)), F.when(~free, F.col("id")))
        rows = rows.withColumns({"__n": F.count("*").over(same), "__least": F.min("id").over(same)})
        found = free & (F.col("__n") > 1)
        rows = rows.withColumns({"cluster": F.when(found, F.col("__least")).otherwise(F.col("cluster")), "score": F.when(found, F.lit(score)).otherwise(F.col("score")), "reason": F.when(found, F.lit(name)).otherwise(F.col("reason"))}).drop("__n", "__least")
    return rows.where("reason IS NOT NULL").select("id", "reason", "score", "cluster")


def recent_changes(history: DataFrame, today: datetime.date, days: int = 90) -> DataFrame:
    """(party_id, changes): how many rows with an account before (old_iban) each party has in the last days."""
    rows = history.where(F.col("old_iban").isNotNull() & (F.col("created_at") >= F.date_sub(F.lit(today), days)))
    return rows.groupBy("party_id").agg(F.count("*").alias("changes"))


def iban_risk(parties: DataFrame, blacklist: DataFrame, changes: DataFrame) -> DataFrame:
    """risk 0 to 100 and the advice of each party (id, iban, verified). blacklist: iban; changes:
    party_id, changes (as recent_changes()). Without an account the risk is 0."""
    listed = blacklist.select(iban_plain(F.col("iban")).alias("b")).distinct()
    rows = parties.withColumn("p", iban_plain(F.col("iban"))).join(listed, F.col("p") == F.col("b"), "left").join(changes, parties["id"] == changes["party_id"], "left")
    n = F.coalesce("changes", F.lit(0))
    risk = F.when(F.col("b").isNotNull(), 60).otherwise(0) + F.when(~iban_valid(F.col("p")), 30).otherwise(0) + F.greatest(n - 3, F.lit(0)) * 5 + F.when(~F.col("p").startswith("PT"), 10).otherwise(0)
    risk = risk - F.when(F.coalesce("verified", F.lit(False)), 40).otherwise(0)
    risk = F.when(F.col("p") == "", 0).otherwise(F.least(F.greatest(risk, F.lit(0)), F.lit(100))).cast("int")
    return rows.select("id", risk.alias("risk"), F.when(risk > 70, "block").when(risk > 30, "review").otherwise("allow").alias("advice"))


def payment_run(payables: DataFrame, parties: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Approved open payables with their creditor: kept, or skipped with the first reason of missing, flagged, blacklisted."""
    ready = payables.where(F.col("approved") & F.col("status").isin("TO_PAY", "SCHEDULED"))
    who = parties.select(F.col("id").alias("party_id"), "name", iban_plain(F.col("iban")).alias("iban"), "flagged")
    listed = blacklist.select(iban_plain(F.col("iban")).alias("b")).distinct()
    rows = ready.join(who, "party_id", "left").join(listed, F.col("iban") == F.col("b"), "left")
    reason = F.when(F.coalesce("iban", F.lit("")) == "", "missing").when(F.col("flagged"), "flagged").when(F.col("b").isNotNull(), "blacklisted")
    return rows.select("id", "party_id", "amount", reason.alias("skipped"))


def payment_counters(run: DataFrame) -> DataFrame:
    """How many payments go out, their control sum, and how many were skipped by reason."""
    return run.groupBy(F.coalesce("skipped", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"), (F.sum(cents(F.col("amount"))) / F.lit(100.0)).alias("control_sum"))


def recurring(documents: DataFrame, least: int = 3, pending: DataFrame | None = None) -> DataFrame:
    """Parties with so many documents, those about to be written (pending: party_id) included."""
    rows = documents.select("party_id") if pending is None else documents.select("party_id").unionByName(pending.select("party_id"))
    return rows.groupBy("party_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def recurring_from(documents: DataFrame, least: int = 3) -> DataFrame:
    """documents (id, party_id, doc_date) with recurring: whether the party had so many by then, this one included."""
    order = Window.partitionBy("party_id").orderBy("doc_date", "id").rowsBetween(Window.unboundedPreceding, 0)
    return documents.withColumn("recurring", F.count("*").over(order) >= least)


def with_counts(parties: DataFrame, deals: DataFrame, documents: DataFrame) -> DataFrame:
    """Parties with how many deals and documents each has."""
    a = deals.groupBy(F.col("contact_id").alias("id")).agg(F.count("*").alias("deals"))
    b = documents.groupBy(F.col("party_id").alias("id")).agg(F.count("*").alias("documents"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return parties.select("id", "name").join(a, "id", "left").join(b, "id", "left").select("id", "name", zero("deals").alias("deals"), zero("documents").alias("documents"))


def exact_copies(documents: DataFrame) -> DataFrame:
    """Documents of a tenant that share a file hash with an earlier one, archived ones aside."""
    order = Window.partitionBy("tenant_id", "file_hash").orderBy("id")
    return documents.where("status <> 'ARQUIVADO'").withColumn("first_id", F.first("id").over(order)).where("id <> first_id").select("id", "tenant_id", "first_id")


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows, one of each key, whose key does not exist yet (for idempotent appends)."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def merged(master: DataFrame, duplicates: DataFrame, columns: list[str]) -> DataFrame:
    """master rows whose empty columns are filled from duplicates (master_id, id, ...), smallest id first."""
    filled = duplicates.groupBy("master_id").agg(*(F.min(F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) != "", F.struct("id", F.col(c).alias("v")))).getField("v").alias(f"__{c}") for c in columns))
    rows = master.join(filled, F.col("id") == F.col("master_id"), "left").drop("master_id")
    for c in columns:
        rows = rows.withColumn(c, F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.col(f"__{c}"))).drop(f"__{c}")
    return rows


def latest(history: DataFrame, key: str, when: str, most: int = 25) -> DataFrame:
    """The latest rows of each key, ties by id, with their place r."""
    order = Window.partitionBy(key).orderBy(F.desc(when), F.desc("id"))
    return history.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)


def changed_since(history: DataFrame) -> DataFrame:
    """history (party_id, id, new_iban, created_at) with changed: whether the account differs from
    that of the party's row before; of a first row it does not."""
    order = Window.partitionBy("party_id").orderBy("created_at", "id")
    plain = iban_plain(F.col("new_iban"))
    return history.withColumn("changed", F.coalesce(plain != F.lag(plain).over(order), F.lit(False)))


def checked_ibans(documents: DataFrame, parties: DataFrame, history: DataFrame) -> DataFrame:
    """documents (id, party_id, iban, previous_iban) with the reasons against their account, and
    flagged: not valid; not among the party's own and its 25 latest; other than on the document
    before (a reason, but no flag). Reasons are in this order; an unknown party knows none."""
    own = parties.select(F.col("id").alias("party_id"), F.nullif(iban_plain(F.col("iban")), F.lit("")).alias("__own"))
    known = latest(history, "party_id", "created_at").groupBy("party_id").agg(F.collect_set(iban_plain(F.col("new_iban"))).alias("__known"))  # 25 at most
    rows = documents.withColumn("__iban", iban_plain(F.col("iban"))).join(own, "party_id", "left").join(known, "party_id", "left")
    mine = F.coalesce(F.col("__own") == F.col("__iban"), F.lit(False))
    seen = mine | F.coalesce(F.array_contains("__known", F.col("__iban")), F.lit(False))
    other = F.coalesce(iban_plain(F.col("previous_iban")) != F.col("__iban"), F.lit(False)) & (F.coalesce("previous_iban", F.lit("")) != "") & ~mine
    valid = iban_valid(F.col("__iban"))
    reasons = F.filter(F.array(F.when(~valid, "iban_invalid_format"), F.when(~seen, "iban_not_in_party_history"), F.when(other, "iban_changed_since_last_doc")), lambda x: x.isNotNull())
    return rows.select("id", "party_id", reasons.alias("reasons"), (~valid | ~seen).alias("flagged"))


LEAST_CONFIDENCE = 0.8


def resolved(documents: DataFrame, parties: DataFrame) -> DataFrame:
    """documents (id, tenant_id, country, nif, vat, confidence) with the party_id of their supplier
    (null: none is known), valid: whether the tax number is, and review: whether someone must look.

    A party (id, tenant_id, nif, country) of the tenant is found by the tax number, else by the
    VAT number with the country, else by the country and a number that holds the VAT number
    without its prefix; ties by the smallest id. The last step joins by the number's last letters.
    """
    nif, vat = nif_plain(F.col("nif")), vat_plain(F.col("vat"))
    country = F.upper(F.coalesce(F.nullif(F.col("country"), F.lit("")), F.when(vat != "", F.left(vat, F.lit(2))), F.lit("PT")))
    rows = documents.select("id", "tenant_id", country.alias("c"), F.nullif(nif, F.lit("")).alias("n"), F.nullif(vat, F.lit("")).alias("v"), "confidence", F.when(F.length(vat) >= 4, F.substring(vat, 3, 40)).alias("tail"))
    who = parties.select("tenant_id", F.col("country").alias("c"), F.col("nif").alias("n"), F.col("id").alias("p"))
    by_nif = who.groupBy("tenant_id", "n").agg(F.min("p").alias("p1"))
    by_vat = who.groupBy("tenant_id", "c", F.col("n").alias("v")).agg(F.min("p").alias("p2"))
    out = rows.join(by_nif, ["tenant_id", "n"], "left").join(by_vat, ["tenant_id", "c", "v"], "left")
    # A number that holds the tail has its last two letters somewhere: these pairs of letters are the keys.
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("n") - 1, F.lit(1))), lambda i: F.substring("n", i, F.lit(8))))
    tails = out.where("p1 IS NULL AND (p2 IS NULL OR left(v, 2) <> c) AND length(tail) >= 2").select("id", "tenant_id", "c", "tail", F.left("tail", F.lit(8)).alias("k"))
    short = F.length("k")
    hay = who.where("n IS NOT NULL").select("tenant_id", "c", "n", "p", F.explode(pairs).alias("w"))
    sizes = tails.select(short.alias("size")).distinct()
    keyed = hay.join(F.broadcast(sizes), F.length("w") >= F.col("size")).select("tenant_id", "c", "n", "p", F.expr("left(w, size)").alias("k")).distinct()  # eight sizes at most
    held = tails.join(keyed, ["tenant_id", "c", "k"]).where(F.contains("n", "tail")).groupBy("id").agg(F.min("p").alias("p3"))
    out = out.join(held, "id", "left")
    valid = tax_id_valid(F.col("c"), F.col("n"), F.col("v"))
    party = F.coalesce("p1", F.when(F.left("v", F.lit(2)) == F.col("c"), F.col("p2")), "p3")
    return out.select("id", party.alias("party_id"), F.coalesce(valid, F.lit(False)).alias("valid"), (~F.coalesce((F.col("confidence") > LEAST_CONFIDENCE) & valid, F.lit(False))).alias("review"))


def new_suppliers(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Parties to be made for documents (id, tenant_id, supplier, country, nif, vat, iban) that
    resolved() gave none: one of each tenant, country and tax number. Name (200 letters, or that
    it is unknown) and account (only a valid one) are those of the smallest id."""
    rows = documents.join(found.where("party_id IS NULL").select("id", "valid"), "id")
    vat = vat_plain(F.col("vat"))
    country = F.upper(F.coalesce(F.nullif(F.col("country"), F.lit("")), F.when(vat != "", F.left(vat, F.lit(2))), F.lit("PT")))
    number = F.when(country == "PT", F.when(F.col("valid"), nif_plain(F.col("nif")))).otherwise(F.nullif(vat, F.lit("")))
    name = F.coalesce(F.nullif(F.left(F.trim("supplier"), F.lit(200)), F.lit("")), F.lit("Fornecedor por identificar"))
    made = rows.select("id", "tenant_id", country.alias("country"), number.alias("nif"), name.alias("name"), F.when(iban_valid(F.col("iban")), iban_plain(F.col("iban"))).alias("iban"))
    known = made.where("nif IS NOT NULL").groupBy("tenant_id", "country", "nif").agg(F.min_by(F.struct("name", "iban"), "id").alias("x")).select("tenant_id", "country", "nif", "x.name", "x.iban")
    return known.unionByName(made.where("nif IS NULL").select("tenant_id", "country", "nif", "name", "iban"))


def imported(incoming: DataFrame, contacts: DataFrame, overwrite: bool = False) -> DataFrame:
    """(id, outcome, contact_id) of rows to import (id, tenant_id, name, nif, email): failed without
    a name; merged where a contact of the tenant has the tax number, or an active one the e-mail
    (any case), if there is anything to fill or overwrite is set; else skipped; else created."""
    by_nif = contacts.where("nif IS NOT NULL AND nif <> ''").groupBy("tenant_id", "nif").agg(F.min("id").alias("a"))
    by_mail = contacts.where("active AND email IS NOT NULL AND email <> ''").groupBy("tenant_id", F.lower("email").alias("mail")).agg(F.min("id").alias("b"))
    rows = incoming.withColumn("mail", F.lower(F.trim("email"))).withColumn("nif", F.when(nif_valid(F.col("nif")), nif_plain(F.col("nif"))))
    rows = rows.join(by_nif, ["tenant_id", "nif"], "left").join(by_mail, ["tenant_id", "mail"], "left").withColumn("contact_id", F.coalesce("a", "b"))
    have = contacts.select(F.col("id").alias("contact_id"), F.col("nif").alias("h_nif"), F.col("email").alias("h_mail"))
    rows = rows.join(have, "contact_id", "left")
    fills = (F.coalesce("h_nif", F.lit("")) == "") & F.col("nif").isNotNull() | (F.coalesce("h_mail", F.lit("")) == "") & (F.coalesce("mail", F.lit("")) != "")
    outcome = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "failed").when(F.col("contact_id").isNull(), "created").when(F.lit(overwrite) | fills, "merged").otherwise("skipped")
    return rows.select("id", outcome.alias("outcome"), F.when(outcome.isin("merged", "skipped"), F.col("contact_id")).alias("contact_id"))


def flagged(parties: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parties, blacklist) after flags (party_id, reason): a flagged party has risk 80 and flagged
    set, and its account is listed once with the first reason."""
    first = flags.groupBy("party_id").agg(F.min("reason").alias("reason"))
    rows = parties.join(first, F.col("id") == F.col("party_id"), "left").drop("party_id")
    after = rows.withColumns({"flagged": F.col("flagged") | F.col("reason").isNotNull(), "risk": F.when(F.col("reason").isNotNull(), 80).otherwise(F.lit(0))})
    listed = rows.where("reason IS NOT NULL AND iban IS NOT NULL").groupBy(iban_plain(F.col("iban")).alias("iban")).agg(F.min("reason").alias("reason"))
    return after.drop("reason"), listed


def tags_united(master: Column, duplicate: Column) -> Column:
    """The master's tags, then those of the duplicate that it lacks; nulls are empty."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(master, none), F.coalesce(duplicate, none))
