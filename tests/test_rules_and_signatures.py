"""Canonical JSON, keyed digests, conditions as JSON, and the embedding table function."""

from __future__ import annotations

import base64
import datetime
import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from contaflux.functions import canonical, embed, signatures
from contaflux.operators import conditions


def test_canonical_text():
    same = ['{"b":1,"a":{"d":[3,{"z":1.0,"y":null}],"c":"\\u00e9\\/"}}', ' { "a" : {"c":"é/", "d":[3.0,{"y":null,"z":1e0}]} , "b" : 10e-1 }']
    assert {canonical.canonical_text(s) for s in same} == {'{"a":{"c":"é/","d":[3,{"y":null,"z":1}]},"b":1}'}
    assert canonical.canonical_text('{"a":1,"a":2}') == '{"a":2}'
    assert canonical.canonical_text('{"\\ud83d\\ude00":1,"￿":2,"A":3}') == '{"A":3,"😀":1,"￿":2}'  # by UTF-16 units
    assert canonical.canonical_text('"\\u0001\\t\\u007f\\u2028\\ud800"') == '"\\u0001\\t\x7f \\ud800"'
    for bad in (None, "", "tru", "{", "NaN", "[1e999]", "[" * 100_000):
        assert canonical.canonical_text(bad) is None
    numbers = {"1e21": "1e+21", "123456789012345680000": "123456789012345680000", "1e-7": "1e-7", "0.000001": "0.000001", "1.50": "1.5", "-0.0": "0", "5e-324": "5e-324", "100": "100", "-12.5e2": "-1250", "0.1": "0.1", "123456789012345678901234567890": "1.2345678901234568e+29", "9007199254740993": "9007199254740992"}
    assert {k: canonical.canonical_text(k) for k in numbers} == numbers
    rng = random.Random(1)
    for _ in range(2000):
        x = rng.choice([rng.uniform(-1, 1), rng.gauss(0, 1)]) * 10.0 ** rng.randint(-30, 30)
        assert float(canonical.number(x)) == x


def test_equal_payloads_hash_alike(spark):
    rng = random.Random(2)

    def shuffled(v):
        if isinstance(v, dict):
            items = list(v.items())
            rng.shuffle(items)
            return {k: shuffled(x) for k, x in items}
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    value = {f"k{i}": {"n": i / 3, "list": [{"x": i, "y": "ç"}, None, True], "": {}} for i in range(5)}
    rows = [(json.dumps(shuffled(value), ensure_ascii=bool(i % 2), indent=i % 3 or None),) for i in range(8)] + [(None,), ("nope",)]
    got = [r[0] for r in spark.createDataFrame(rows, "j string").select(canonical.digest(F.col("j"))).collect()]
    assert len(set(got[:8])) == 1 and got[8:] == [None, None]


def test_published_vectors(spark):
    """RFC 4231, cases 1 to 4, 6 and 7."""
    cases = [(b"\x0b" * 20, b"Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"), (b"Jefe", b"what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
             (b"\xaa" * 20, b"\xdd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"), (bytes(range(1, 26)), b"\xcd" * 50, "82558a389a443c0ea4cc819899f2083a85f0faa3e578f8077a2e3ff46729665b"),
             (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
             (b"\xaa" * 131, b"This is a test using a larger than block-size key and a larger than block-size data. The key needs to be hashed before being used by the HMAC algorithm.", "9b09ffa71b942fcb27635fbcd5b0e944bfdc63644f0713938a7f51535c3a35e2")]
    df = spark.createDataFrame([(bytearray(k), bytearray(b)) for k, b, _ in cases], "k binary, b binary")
    assert [r[0] for r in df.select(signatures.hmac(F.col("k"), F.col("b"))).collect()] == [c[2] for c in cases]


def test_faults_and_schemes(spark):
    digest = hmac.new(b"sec\xc3\xa9", "corpo".encode(), hashlib.sha256).digest()
    rows = [(digest.hex(), base64.b64encode(digest).decode(), f" sha256={digest.hex()} "), ("", None, digest.hex()), (digest.hex()[:-1], "x", "sha256=")]
    df = spark.createDataFrame(rows, "a string, b string, c string").withColumn("body", F.lit("corpo"))
    got = df.select(*(signatures.fault("secé", F.col("body"), F.col(c), s) for c, s in zip("abc", signatures.SCHEMES, strict=True))).collect()
    assert [tuple(r) for r in got] == [(None, None, None), ("malformed", "malformed", None), ("mismatch", "mismatch", "mismatch")]
    assert df.select(signatures.fault("", F.col("body"), F.col("a"))).first()[0] == "mismatch"
    assert df.select(*(signatures.signed("secé", F.col("body"), s) for s in signatures.SCHEMES)).first()[:2] == (digest.hex(), base64.b64encode(digest).decode())
    with pytest.raises(ValueError, match="no such scheme"):
        signatures.signed("k", F.lit("b"), "md5")


@pytest.mark.parametrize("most", [200, 2])
def test_a_call_goes_to_the_tenant_whose_key_made_it(spark, most):
    tenants = spark.createDataFrame([(i, "p" if i % 2 else "q", f"key{i}") for i in range(9)] + [(20, "p", "key1"), (21, "p", None), (22, "r", "")], "tenant_id long, provider string, secret string")
    sign = lambda key: hmac.new(key.encode(), b"body", hashlib.sha256).hexdigest()
    calls = [(1, "p", sign("key1")), (2, "p", sign("key7")), (3, "q", sign("key7")), (4, "q", sign("key8")), (5, "x", sign("key1")), (6, "p", None), (7, "r", sign(""))]
    df = spark.createDataFrame(calls, "id long, provider string, signature string").withColumn("body", F.lit("body"))
    assert {r["id"]: r["tenant_id"] for r in signatures.routed(df, tenants, most=most).collect()} == {1: 1, 2: 7, 3: None, 4: 8, 5: None, 6: None, 7: None}


DOCS = "id long, type string, supplier string, nif string, email string, text string, total double, country string, day date"


@pytest.fixture(scope="module")
def docs(spark):
    day = datetime.date(2026, 3, 1)
    return spark.createDataFrame([(1, "RECIBO", "EDP Comercial", "500", "x@EDP.pt", "Conta da LUZ", 99.5, "PT", day), (2, "FATURA", "Acme", "501", "y@acme.com", "nada", 150.0, "ES", day), (3, None, None, None, None, None, None, None, None)], DOCS)


@pytest.mark.parametrize(
    ("condition", "ids"),
    [
        ({}, [1, 2, 3]), ({"type": "RECIBO"}, [1]), ({"supplier": "edp"}, [1]), ({"supplierNif": "501"}, [2]), ({"emailDomain": "edp.PT"}, [1]), ({"keywords": ["gás", "luz"]}, [1]),
        ({"total": {"ge": 99.5, "lt": 150}}, [1]), ({"total": 150}, [2]), ({"country": {"in": ["ES", "FR"]}}, [2]), ({"not": {"country": "PT"}}, [2, 3]), ({"type": {"exists": False}}, [3]),
        ({"any": [{"type": "RECIBO"}, {"all": [{"total": {"gt": 100}}, {"country": "ES"}]}]}, [1, 2]), ({"text": {"matches": r"L[A-Z]Z$"}}, [1]), ({"supplier": {"starts": "AC", "ends": "me"}}, [2]),
        ({"day": {"le": "2026-03-01"}}, [1, 2]), ({"type": {"ne": "RECIBO"}}, [2]), ({"type": "RECIBO", "total": {"gt": 100}}, []), ({"text": {"contains": "da l"}}, [1]),
    ],
)
def test_conditions_hold(docs, condition, ids):
    assert sorted(r["id"] for r in docs.where(conditions.compiled(condition, conditions.Fields(docs))).collect()) == ids


@pytest.mark.parametrize(
    ("condition", "path", "problem"),
    [
        ([], "$", "needs an object"), ({"nope": 1}, "$.nope", "no such field: nope"), ({"any": [{"type": "A"}, {"total": {"ge": "x"}}]}, "$.any[1].total.ge", "needs a number"), ({"all": []}, "$.all", "needs a list of conditions"),
        ({"type": {"like": "x"}}, "$.type.like", "no such operator: like"), ({"keywords": ["a", 1]}, "$.keywords[1]", "needs a text"), ({"text": {"matches": "("}}, "$.text.matches", "not a pattern"), ({"not": 3}, "$.not", "needs an object"),
        ({"total": {}}, "$.total", "needs an operator"), ({"type": None}, "$.type", "needs a text or a number"), ({"day": {"ge": "1.3.2026"}}, "$.day.ge", "needs a date"), ({"country": {"in": []}}, "$.country.in", "needs a list"), ({"type": {"exists": 1}}, "$.type.exists", "needs true or false"),
    ],
)
def test_what_is_wrong_is_said_by_its_path(docs, condition, path, problem):
    with pytest.raises(conditions.ConditionError) as error:
        conditions.compiled(condition, conditions.Fields(docs))
    assert error.value.path == path and error.value.problem.startswith(problem)


def test_rules_from_a_table(spark, docs):
    deep = "{" + '"not":{' * 40 + "}" * 41
    rules = spark.createDataFrame([(1, 5, True, None), (2, 10, True, '{"type":"RECIBO"}'), (3, 10, True, '{"supplier":"EDP"}'), (4, 99, False, "{}"), (5, 50, True, '{"total":{"ge":"x"}}'), (6, 50, True, "{"), (7, None, True, "{}"), (8, 60, True, deep)], "id int, priority int, active boolean, conditions string")
    out, problems = conditions.first_matching(docs, rules)
    assert {r["id"]: r["rule_id"] for r in out.collect()} == {1: 2, 2: 1, 3: 1}
    assert [(p[0], p[1][:20]) for p in sorted(problems)] == [(5, "$.total.ge"), (6, "$"), (8, ("$" + ".not" * 33)[:20])]
    out, problems = conditions.first_matching(docs, rules.limit(0))
    assert problems == [] and all(r["rule_id"] is None for r in out.collect())


def test_embed_in_sql(spark):
    embed.register(spark)
    text = " ".join(f"Pão{i}" for i in range(150))
    spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "a , b")], "id long, text string").createOrReplaceTempView("embed_texts")
    rows = spark.sql("SELECT t.id, e.chunk, e.content, e.vector FROM embed_texts t, LATERAL embed(t.text) e").collect()
    assert sorted((r["id"], r["chunk"], len(r["content"].split())) for r in rows) == [(1, 0, 80), (1, 1, 80), (1, 2, 22), (4, 0, 3)]
    for r in rows:
        assert list(r["vector"]) == embed.vector(r["content"]) and len(r["vector"]) == 256
        assert sum(x * x for x in r["vector"]) == pytest.approx(1 if r["id"] == 1 else 0)
    assert embed.tokens("Ção É x " + "y" * 25) == ["cao"]


def test_vectors_as_json(spark):
    df = spark.createDataFrame([("[1, 2.5]",), ("[]",), ("nope",), ("[1, null]",), (None,), ('["a"]',)], "v string")
    assert [r[0] for r in df.select(embed.of_json(F.col("v"))).collect()] == [[1.0, 2.5], None, None, None, None, None]


def test_a_costly_signature_is_worked_out_once(spark):
    df = spark.createDataFrame([("k", "b", "c", bytes(range(64)))], "k string, b string, c string, raw binary")
    sent = signatures.signed(F.col("k"), F.reverse("c"), "prefixed")
    plan = df.select(signatures.fault(F.col("k"), F.col("b"), sent, "prefixed").alias("f"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1 and plan.first()[0] == "mismatch"
    for raw in (bytes(range(64)), bytes(range(192, 256)), bytes(range(100)), b"\0", b"6\\"):
        got = spark.createDataFrame([(raw,)], "k binary").select(signatures.hmac(F.col("k"), F.lit("body"))).first()[0]
        assert got == hmac.new(raw, b"body", hashlib.sha256).hexdigest()
