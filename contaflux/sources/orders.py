"""Orders of a web shop, as JSON: documents, their items and their customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = (
    "id long, number string, status string, currency string, total string, date_paid string, "
    "billing struct<email:string,first_name:string,last_name:string,company:string,vat_number:string,nif:string>, "
    "line_items array<struct<id:long,name:string,quantity:double,subtotal:string,total:string,sku:string>>"
)


def parsed(raw: DataFrame) -> DataFrame:
    """Orders of raw (tenant_id, json), one row each; what isn't JSON, or has no id, is left out."""
    rows = raw.select("tenant_id", F.from_json("json", ORDER).alias("o")).where("o.id IS NOT NULL")
    billing = F.col("o.billing")
    full = F.nullif(F.trim(F.concat_ws(" ", billing["first_name"], billing["last_name"])), F.lit(""))
    return rows.select(
        "tenant_id", F.col("o.id").alias("order_id"), F.coalesce(F.col("o.number"), F.col("o.id").cast("string")).alias("number"), F.col("o.status").alias("status"),
        F.coalesce(F.col("o.currency"), F.lit("EUR")).alias("currency"), F.coalesce(F.col("o.total").try_cast("double"), F.lit(0.0)).alias("total"), F.try_to_date(F.left(F.col("o.date_paid"), F.lit(10)), "yyyy-MM-dd").alias("date"),
        F.coalesce(F.nullif(F.trim(billing["company"]), F.lit("")), full).alias("customer"), F.coalesce(billing["vat_number"], billing["nif"]).alias("nif"), F.nullif(F.lower(F.trim(billing["email"])), F.lit("")).alias("email"), F.col("o.line_items").alias("items"),
    )


def new_orders(orders: DataFrame, documents: DataFrame) -> DataFrame:
    """Orders, one of each tenant and number (the largest order_id), that no issued document of
    documents (tenant_id, number) stands for yet."""
    latest = orders.groupBy("tenant_id", "number").agg(F.max("order_id").alias("order_id"))
    return orders.join(latest, ["tenant_id", "number", "order_id"]).dropDuplicates(["tenant_id", "number"]).join(documents.select("tenant_id", "number"), ["tenant_id", "number"], "left_anti")


def order_items(orders: DataFrame) -> DataFrame:
    """(order_id, line, description, quantity, price, total, code): the price is the subtotal (else
    the total) for each piece, of one piece at least; unreadable amounts are 0."""
    rows = orders.select("order_id", F.posexplode("items").alias("at", "i"))
    number = lambda c: F.coalesce(F.col(f"i.{c}").try_cast("double"), F.lit(0.0))
    price = F.coalesce(F.col("i.subtotal").try_cast("double"), number("total")) / F.greatest(F.coalesce("i.quantity", F.lit(1.0)), F.lit(1.0))
    return rows.select("order_id", (F.col("at") + 1).alias("line"), F.col("i.name").alias("description"), F.col("i.quantity").alias("quantity"), price.alias("price"), number("total").alias("total"), F.col("i.sku").alias("code"))


def with_customers(orders: DataFrame, parties: DataFrame) -> DataFrame:
    """orders with the party_id of an active party (id, tenant_id, nif, email, active) of the tenant:
    by tax number, else by e-mail; ties by the smallest id; null where there is none."""
    live = parties.where("active")
    by = lambda c, name: live.where(f"{c} IS NOT NULL AND {c} <> ''").groupBy("tenant_id", F.lower(c).alias(c)).agg(F.min("id").alias(name))
    rows = orders.join(by("nif", "__a"), ["tenant_id", "nif"], "left").join(by("email", "__b"), ["tenant_id", "email"], "left")
    return rows.withColumn("party_id", F.coalesce("__a", "__b")).drop("__a", "__b")
