"""Keyed digests (HMAC-SHA-256) as column expressions, checks of signatures, and routing by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contaflux.functions.fiscal import bound

BLOCK = 64  # bytes of a SHA-256 block
#: How a signature is written: hexadecimal, base64, or hexadecimal behind a prefix.
SCHEMES = ("sha256", "sha256-base64", "prefixed")
PREFIX = "sha256="



def _padded(key: Column, pad: int) -> Column:
    """The key, hashed if it is longer than a block, filled up with zeros, each byte xor pad. Only the
    key's own bytes are looked up, the rest of the block is the pad itself."""
    raw = key.cast("binary")
    short = F.when(F.octet_length(raw) > BLOCK, F.unhex(F.sha2(raw, 256))).otherwise(raw)
    table = F.array(*(F.lit(f"{i ^ pad:02X}") for i in range(256)))
    told = F.transform(F.split(F.decode(short, "ISO-8859-1"), ""), lambda c: F.get(table, F.ascii(c)))
    own = F.when(F.octet_length(short) > 0, F.array_join(told, "")).when(short.isNotNull(), "")
    return F.unhex(F.rpad(own, 2 * BLOCK, f"{pad:02X}"))


def hmac(key: Column | str, body: Column) -> Column:
    """HMAC-SHA-256 of a text or binary body under a key (a column or one secret), as hexadecimal.
    Null where either is null. Nothing leaves the JVM, and one secret's pads are folded once."""
    key = F.lit(key) if isinstance(key, str) else key
    return _digest(_padded(key, 0x36), _padded(key, 0x5C), body)


def _digest(inner: Column, outer: Column, body: Column) -> Column:
    """From the key's two padded forms."""
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))), 256)


def signed(key: Column | str, body: Column, scheme: str = "sha256") -> Column:
    """The signature of a body as the scheme writes it."""
    return _as_written(hmac(key, body), scheme)


def _as_written(digest: Column, scheme: str) -> Column:
    if scheme not in SCHEMES:
        raise ValueError(f"no such scheme: {scheme}")
    return {"sha256": digest, "sha256-base64": F.base64(F.unhex(digest)), "prefixed": F.concat(F.lit(PREFIX), digest)}[scheme]


def fault(key: Column | str, body: Column, signature: Column, scheme: str = "sha256") -> Column:
    """What is wrong with a signature: null if it is right, ``malformed`` if there is none (null or
    empty), else ``mismatch``, also without a key. Blanks around it and a missing prefix don't matter."""
    key = F.lit(key) if isinstance(key, str) else key
    want = hmac(key, F.coalesce(body.cast("binary"), F.lit(b"")))

    def told(sent: Column) -> Column:
        right = F.coalesce((F.octet_length(key.cast("binary")) > 0) & _agrees(sent, want, scheme), F.lit(False))
        return F.when(sent.isNull() | (sent == ""), "malformed").when(~right, "mismatch")

    return bound(signature, told)  # a signature may itself be costly and is looked at several times


def _agrees(signature: Column, digest: Column, scheme: str) -> Column:
    told = F.trim(signature)
    if scheme == "prefixed":
        told, scheme = F.when(F.startswith(told, F.lit(PREFIX)), F.substring(told, F.lit(len(PREFIX) + 1), F.length(told))).otherwise(told), "sha256"
    return told == _as_written(digest, scheme)


def routed(calls: DataFrame, tenants: DataFrame, scheme: str = "sha256", most: int = 200) -> DataFrame:
    """calls (provider, body, signature ...) with tenant_id: the first of the provider's tenants
    (tenant_id, provider, secret), by id, whose key made the signature; null if none did.

    Each call is held against its own provider's keys only. A provider's keys travel as one array,
    so calls aren't multiplied; of more than `most` keys a provider's tenants are dealt out in
    arrays of that size and the calls pass them one after another. Null secrets open nothing."""
    some = tenants.where(F.col("secret").isNotNull() & (F.col("secret") != "")).select("provider", "tenant_id", "secret").distinct()
    sizes = some.groupBy("provider").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    rounds = max(1, -(-sizes // most))
    out, found = calls, []
    for i in range(rounds):
        part = some if rounds == 1 else some.where(F.pmod(F.xxhash64("tenant_id"), F.lit(rounds)) == i)
        pads = F.struct("tenant_id", _padded(F.col("secret"), 0x36).alias("inner"), _padded(F.col("secret"), 0x5C).alias("outer"))
        keys = part.groupBy("provider").agg(F.sort_array(F.collect_list(pads)).alias(f"__k{i}"))
        out = out.join(keys, "provider", "left")
        body = F.coalesce(F.col("body").cast("binary"), F.lit(b""))
        right = F.filter(f"__k{i}", lambda k: F.coalesce(_agrees(F.col("signature"), _digest(k["inner"], k["outer"], body), scheme), F.lit(False)))
        out = out.withColumn(f"__t{i}", F.get(F.transform(right, lambda k: k["tenant_id"]), F.lit(0))).drop(f"__k{i}")
        found.append(F.col(f"__t{i}"))
    first = found[0] if len(found) == 1 else F.least(*found)
    return reduce(lambda df, i: df.drop(f"__t{i}"), range(rounds), out.withColumn("tenant_id", first))
