"""URL filter by path-template trees, in DataFrame operations only.

Urls that a host rule fits are the labelled ones. Every host has a tree of path segments,
grown level by level: segments that look like numbers or hashes become wildcards by their
form, and under a node with many different segments of few pages each all of them become
one wildcard. Branches that stay apart but whose labels don't differ beyond chance from
those of their siblings together are merged. A template (host and merged path) is rejected
when the share of blocked urls among its labelled ones, smoothed towards the share in all
labelled urls, is high; a url without a rule gets its template's verdict.

Everything is counted on distinct (host, path shape) pairs, so a host with a third of all
pages is a few rows, and joined back once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contaflux.llm.common import Scratch

#: (verdict, host, path): the rule fits the host and its subdomains, and paths that begin so.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Levels that every tree has. Below them a node is grown as deep as its paths go while a verdict
#: can still change there, else the rest of its paths is one wildcard.
LEVELS = 4
#: A node's children become one wildcard from this many on, if they have fewer pages each on average.
MANY, PAGES_EACH = 16, 4.0
#: Weight of the prior, the least labelled urls of a rejected template, and its least purity.
PRIOR, LEAST_LABELS, PURITY = 4.0, 5, 0.8
#: Branches are merged when their share of blocked urls is within so many standard errors.
ERRORS = 2.0
#: Templates up to this number are broadcast (some hundred bytes each), else joined by a shuffle.
MOST_BROADCAST = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null or no ://: empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; null or no ://: empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (like net/; else null) and its verdict (else null)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The segments of a path, of which those that are numbers, dates, hashes or ids are wildcards by form."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    hashed = r"^(?:[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[A-Za-z0-9_-]{24,})$"

    def general(s: Column) -> Column:
        plain = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", "")
        return F.when(plain.rlike(r"^[0-9]+$"), F.lit("{n}")).when(plain.rlike(hashed) & plain.rlike("[0-9]"), F.lit("{h}")).when(plain.rlike(r"^[0-9]+[-_]|[-_][0-9]+$"), F.lit("{id}")).otherwise(s)

    return F.transform(parts, general)


def tree(shapes: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, shape, template) of rows (host, shape, pages, blocked, labelled), one for each
    distinct host and shape: the template is the path with wildcards, branches merged.

    Below LEVELS a node with too few labelled urls, none of them blocked or no unlabelled
    url ends in one wildcard: no template under it could be rejected and change a verdict.
    """
    rows = scratch.keep(shapes.withColumns({"template": F.lit(""), "open": F.lit(True)}))
    deepest = rows.agg(F.max(F.size("shape"))).first()[0] or 0
    for level in range(1, deepest + 1):
        if level > LEVELS and rows.where(F.col("open") & (F.size("shape") >= level)).isEmpty():
            break
        here = F.when(F.col("open") & (F.size("shape") >= level), F.get("shape", F.lit(level - 1)))
        rows = rows.withColumn("segment", here)
        branch = rows.groupBy("host", "template", "segment").agg(F.sum("pages").alias("pages"), F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
        node = branch.where("segment is not null").groupBy("host", "template")
        node = node.agg(F.count("*").alias("children"), F.sum("pages").alias("all"), F.sum("b").alias("nb"), F.sum("l").alias("nl"))
        every = branch.join(node, ["host", "template"], "left")
        wild = (F.col("children") >= MANY) & (F.col("all") < PAGES_EACH * F.col("children"))
        # A branch is like its siblings when its labels, smoothed, lie within chance of those of all the others.
        mean = (F.col("nb") - F.col("b") + 1) / (F.col("nl") - F.col("l") + 2)
        own = (F.col("b") + PRIOR * mean) / (F.col("l") + PRIOR)
        like = (F.col("l") >= LEAST_LABELS) & (F.col("nl") > F.col("l")) & (F.abs(own - mean) <= ERRORS * F.sqrt(mean * (1 - mean) / (F.col("l") + PRIOR)))
        grows = F.lit(level <= LEVELS) | ((F.col("nl") >= LEAST_LABELS) & (F.col("nb") > 0) & (F.col("all") > F.col("nl")))
        name = F.when(F.col("segment").isNull(), F.lit(None)).when(wild | ~grows, F.lit("{*}")).when(like & ~F.col("segment").startswith("{"), F.lit("{~}")).otherwise(F.col("segment"))
        named = every.select(F.col("host").alias("h"), F.col("template").alias("t"), F.col("segment").alias("s"), name.alias("name"), (F.col("segment").isNotNull() & grows).alias("grows"))
        same = (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & F.col("segment").eqNullSafe(F.col("s"))
        longer = F.concat("template", F.coalesce(F.concat(F.lit("/"), "name"), F.lit("")))
        rows = scratch.keep(rows.join(named, same).select("host", "shape", "pages", "blocked", "labelled", longer.alias("template"), F.col("grows").alias("open")))
    return rows.drop("open")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = tuple(RULES)) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every row of pages.

    The verdict is the longest fitting rule's, else block for a rejected template, else
    allow. A null url, or one without ://, has an empty host and path, which no rule fits.
    Repeated rows stay; an empty table gives no rows; other columns are left out.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, told = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), told.alias("told"), shape(F.col("path")).alias("shape"))
    shapes = rows.groupBy("host", "shape").agg(F.count("*").alias("pages"), F.count_if(F.col("told") == "block").alias("blocked"), F.count("told").alias("labelled"))
    grown = tree(shapes, Scratch(pages.sparkSession, "url-filter"))
    labels = grown.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    prior = (labels["b"] or 0) / labels["l"] if labels["l"] else 0.0
    counted = grown.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    purity = (F.col("b") + PRIOR * prior) / (F.col("l") + PRIOR)
    rejected = counted.select("host", "template", ((F.col("l") >= LEAST_LABELS) & (purity >= PURITY)).alias("rejected"))
    by_shape = grown.select("host", "shape", "template").join(rejected, ["host", "template"]).select("host", "shape", "template", "rejected")
    few = by_shape.count() <= MOST_BROADCAST
    out = rows.join(F.broadcast(by_shape) if few else by_shape, ["host", "shape"], "left")
    verdict = F.coalesce("told", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")
