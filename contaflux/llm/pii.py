"""Personal data: detected entities get keyed surrogates of the same type.

A surrogate keeps the entity's format (length, separators, letter case, digits where there
were digits), its script, its gender where the title or a known first name tells one, and
its validity (a card number's check digit, an address's octets). Every surrogate is a
keyed permutation of the entities of that format, so the same entity has the same
surrogate in every document (coreference), different entities have different ones, and a
task needs to know nothing of the others. Where a permuted value would not do (it equals
the original, is no valid value, or collides with a name of the known lists) it is permuted
again until it does, which keeps the permutation one to one.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
import sys
import unicodedata
import warnings
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contaflux.llm.common import give_back, pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The setting of the session that holds the secret key. Without it, and without a key passed,
#: this public one is used, which makes surrogates that anyone with the code can undo: a warning says so.
SETTING = "spark.contaflux.pii.key"
KEY = b"contaflux"
ROUNDS = 8

#: Known first names by gender, and titles that tell a gender.
FEMALE = "Alice Amelia Ana Anna Astrid Beatriz Camille Carla Carmen Charlotte Chloe Claire Clara Daniela Elena Elisabeth Emily Emma Eva Fatima Frieda Greta Hannah Helena Ingrid Irene Isabel Jane Julia Karin Laura Lea Lucia Luisa Margot Maria Marie Marta Mary Mia Monika Nadia Nina Olivia Paula Petra Rosa Sara Silvia Sofia Sophie Susan Teresa Ursula Valentina Victoria Zoe".split()
MALE = "Adam Albert Alejandro Alexander Andreas Antonio Bernard Bruno Carlos Charles Christian Daniel David Diego Dieter Eduardo Emil Enrique Felix Fernando Francisco Franz Frederic Georg Hans Heinrich Henri Hugo Jacques James Javier Jean John Jorge Jose Jürgen Karl Klaus Leon Louis Lucas Luis Marc Martin Michael Miguel Oliver Pablo Paul Pedro Peter Philippe Rafael Ricardo Robert Stefan Thomas Victor William".split()
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Dr": "", "Prof": ""}

#: Letters that replace one another: each text is one class of a script.
CLASSES = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûü", "çñßðþ",
    "αεηιουω", "βγδζθκλμνξπρσςτφχψ", "άέήίόύώ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщъьё",
    "אבגדהוזחטיכלמנסעפצקרשת", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
]
_CLASS = {c: (n, i) for n, text in enumerate(CLASSES) for i, c in enumerate(text)}
#: Blocks of letters without case, by their first and last code point.
BLOCKS = [(0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x0905, 0x0939)]


def classed(c: str, hexadecimal: bool = False) -> tuple[int, int, int] | None:
    """(class, place in it, size of it) of a lower-case character; None: it stays as it is."""
    if hexadecimal and "a" <= c <= "f":
        return -1, ord(c) - 97, 6
    if c in _CLASS:
        n, i = _CLASS[c]
        return n, i, len(CLASSES[n])
    for n, (low, high) in enumerate(BLOCKS):
        if low <= ord(c) <= high:
            return 1000 + n, ord(c) - low, high - low + 1
    return None


def member(n: int, i: int) -> str:
    return chr(97 + i) if n == -1 else CLASSES[n][i] if n < 1000 else chr(BLOCKS[n - 1000][0] + i)


class Surrogates:
    """Keyed surrogates; equal keys give equal surrogates in every task and run."""

    def __init__(self, key: bytes = KEY):
        self.key = key
        self.first = {"f": self.shifted(FEMALE, b"female"), "m": self.shifted(MALE, b"male")}
        self.known = {n.casefold() for n in FEMALE + MALE}
        self.of = lru_cache(200_000)(self._of)

    def prf(self, *parts: bytes) -> int:
        return int.from_bytes(hmac.new(self.key, b"\0".join(parts), hashlib.sha256).digest(), "big")

    def shifted(self, names: list[str], label: bytes) -> dict[str, str]:
        """Each known name to another one: the next in a keyed order, so none stays itself."""
        ring = sorted(names, key=lambda n: self.prf(b"name", label, n.encode()))
        return {a.casefold(): b for a, b in zip(ring, ring[1:] + ring[:1], strict=True)}

    def permuted(self, values: list[int], sizes: list[int], label: bytes) -> list[int]:
        """A keyed permutation of the tuples with these sizes: Feistel rounds on alternate halves."""
        values = list(values)
        n = len(values)
        halves = [range(0, (n + 1) // 2), range((n + 1) // 2, n)]
        shape = ",".join(map(str, sizes)).encode()
        for r in range(ROUNDS):
            turn, other = halves[r % 2], halves[1 - r % 2]
            noise = self.prf(label, shape, str(r).encode(), ",".join(str(values[i]) for i in other).encode())
            for i in turn:
                values[i] = (values[i] + noise) % sizes[i]
                noise = noise // sizes[i] if noise > 1 << 64 else self.prf(label, str((r, i, noise)).encode())
        return values

    def walked(self, values: list[int], sizes: list[int], label: bytes, good: Callable[[list[int]], bool]) -> list[int]:
        """The first of the repeated permutations that is good and differs: one to one on the good ones,
        unless only the value itself is left."""
        now = values
        while True:  # a permutation comes back to where it began, so this ends
            now = self.permuted(now, sizes, label)
            if now == values or good(now):
                return now

    def spelled(self, text: str, label: bytes, hexadecimal: bool = False, good: Callable[[str], bool] = lambda s: True) -> str:
        """text with each letter and digit replaced by one of its class, its case kept."""
        plain = unicodedata.normalize("NFC", text)
        lower = [c.lower() if len(c.lower()) == 1 else c for c in plain]
        found = [(i, classed(c, hexadecimal)) for i, c in enumerate(lower)]
        found = [(i, x) for i, x in found if x]
        if not found:
            return text

        def built(values: list[int]) -> str:
            out = list(lower)
            for (i, (n, _, _)), v in zip(found, values, strict=True):
                out[i] = member(n, v)
            return "".join(o.upper() if p != p.lower() and len(o.upper()) == 1 else o for o, p in zip(out, plain, strict=True))

        shape = "".join("?" if i in dict(found) else c for i, c in enumerate(lower)).encode()
        kinds = ",".join(str(x[0]) for _, x in found).encode()
        return built(self.walked([x[1] for _, x in found], [x[2] for _, x in found], label + shape + kinds, lambda v: good(built(v))))

    def digits(self, text: str, label: bytes, keep: int, good: Callable[[str], bool]) -> str:
        """text with its digits from the keep-th on permuted; separators stay. Equal digits in
        another format get equal digits."""
        own = [c for c in text if "0" <= c <= "9"]
        head, tail = "".join(own[:keep]), [int(c) for c in own[keep:]]
        new = head + "".join(map(str, self.walked(tail, [10] * len(tail), label + head.encode(), lambda v: good(head + "".join(map(str, v))))))
        digit = iter(new)
        return "".join(next(digit) if "0" <= c <= "9" else c for c in text)

    def card(self, text: str) -> str:
        """All digits but the last are permuted, the first stays (the issuer's kind), and the last
        is as far from a valid check digit as it was."""
        own = [int(c) for c in text if "0" <= c <= "9"]
        off = (own[-1] - check_digit(own[:-1])) % 10
        new = self.walked(own[1:-1], [10] * (len(own) - 2), b"card" + bytes([own[0]]), lambda v: True)
        new = [own[0], *new]
        new.append((check_digit(new) + off) % 10)
        digit = iter(map(str, new))
        return "".join(next(digit) if "0" <= c <= "9" else c for c in text)

    def address(self, text: str) -> str:
        """An IPv4 address of the same reach: private stays private, public stays public."""
        own = [int(x) for x in text.split(".")]
        private = ipaddress.ip_address(text_of(own)).is_private
        if own[0] == 10:
            return text_of([10, *self.walked(own[1:], [256] * 3, b"ip10", lambda v: True)])
        if own[:2] == [192, 168]:
            return text_of([192, 168, *self.walked(own[2:], [256] * 2, b"ip192", lambda v: True)])
        return text_of(self.walked(own, [256] * 4, b"ip", lambda v: v[0] != 10 and v[:2] != [192, 168] and ipaddress.ip_address(text_of(v)).is_private == private and 0 < v[0] < 224))

    def email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        *labels, top = domain.split(".")
        return self.spelled(local, b"local") + "@" + ".".join([*(self.spelled(x, b"domain") for x in labels), top])

    def iban(self, text: str) -> str:
        """The country stays, the account is permuted and the check digits are made anew."""
        plain = re.sub(r"\s", "", text).upper()
        body = self.spelled(plain[4:], b"iban" + plain[:2].encode())
        number = int("".join(str(int(c, 36)) for c in body + plain[:2] + "00"))
        sign = iter(plain[:2] + f"{98 - number % 97:02d}" + body)
        return "".join(c if c.isspace() else next(sign) for c in text)

    def name(self, text: str) -> str:
        """A title stays; first names are replaced by names of the same gender."""
        title, blank, rest = re.match(r"(\w+\.?)(\s+)(.*)", text, re.S).groups()
        told = TITLES.get(title.rstrip("."), "")
        out = []
        for k, word in enumerate(re.split(r"(\s+)", rest)):
            folded = word.casefold()
            gender = told if told and folded in self.first[told] else next((g for g in "fm" if folded in self.first[g]), "")
            if k == 0 and gender:
                new = self.first[gender][folded]
                out.append(new.upper() if word.isupper() else new)
            else:
                out.append(word if word.isspace() else self.spelled(word, b"name", good=lambda s: s.casefold() not in self.known))
        return title + blank + "".join(out)

    def _of(self, kind: str, text: str) -> str:
        if kind == "email":
            return self.email(text)
        if kind == "ip":
            return self.address(text)
        if kind == "card":
            return self.card(text)
        if kind == "iban":
            return self.iban(text)
        if kind == "name":
            return self.name(text)
        if kind == "secret":
            is_hex = bool(re.fullmatch(r"[0-9A-Fa-f]+", text))
            return self.spelled(text, b"hex" if is_hex else b"secret", is_hex)
        if kind == "ssn":
            return self.digits(text, b"ssn", 0, lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000")
        # A phone number keeps its country code; area and exchange don't begin with 0 or 1.
        plain = re.sub(r"\D", "", text)
        country = len(plain) - 10 if len(plain) > 10 else 0
        rest = len(plain) - country
        return self.digits(text, b"phone" + bytes([rest]), country, lambda s: rest < 7 or (s[-7] > "1" and (rest < 10 or s[-10] > "1")) or plain[-7] <= "1" or (rest >= 10 and plain[-10] <= "1"))


def text_of(octets: list[int]) -> str:
    return ".".join(map(str, octets))


def check_digit(digits: list[int]) -> int:
    """The last digit that makes a card number valid."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
    return -total % 10


_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
#: What is looked for, in this order: of overlapping finds the earlier kind wins. With each
#: pattern a test that is quick to fail where a text can hold none.
PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}\b"), lambda t: "@" in t),
    ("secret", re.compile(r"(?i)(?:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"'])([^\"'\s]{6,})(?=[\"'])"), lambda t: '"' in t or "'" in t),
    ("secret", re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})\b"), None),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), None),
    ("ip", re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"), None),
    ("card", re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])"), None),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), None),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\d-])|(?<![\w.])\+\d{9,14}(?!\d)|(?<![\d.-])\d{3}-\d{4}(?![\d-])"), None),
    ("name", re.compile(rf"\b(?:{_TITLE})\b\.?[ \t]+[^\W\d_a-z][^\W\d_]+(?:[ \t]+[^\W\d_a-z][^\W\d_]+){{0,2}}"), lambda t: any(x in t for x in TITLES)),
]
_DIGIT = re.compile(r"\d[\d .()-]{5}")


def found(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, apart and in order."""
    out: list[tuple[int, int, str]] = []
    number = bool(_DIGIT.search(text)) or bool(re.search(r"[0-9a-fA-F]{20}", text))
    for kind, pattern, possible in PATTERNS:
        if possible(text) if possible else number or (kind == "secret" and ("AKIA" in text or "gh" in text or "sk-" in text)) or kind == "iban" and bool(re.search(r"[A-Z]{2}\d\d", text)):
            new = []
            for m in pattern.finditer(text):
                a, b = m.span(1) if pattern.groups else m.span()
                at = bisect.bisect_left(out, (a,))  # finds lie apart, so only the neighbours can overlap
                if (at == len(out) or b <= out[at][0]) and (not at or out[at - 1][1] <= a):
                    new.append((a, b, kind))
            out = sorted(out + new) if new else out
    return out


def replaced(text: str | None, surrogates: Surrogates) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, entity, surrogate) of each find."""
    if not text:
        return text, []
    out, at, pairs = [], 0, []
    for a, b, kind in found(text):
        entity = text[a:b]
        new = surrogates.of(kind, entity)
        out += [text[at:a], new]
        pairs.append((kind, entity, new))
        at = b
    return ("".join([*out, text[at:]]), pairs) if pairs else (text, pairs)


def key_of(docs: DataFrame) -> bytes:
    """The session's key, else the public one with a warning."""
    named = docs.sparkSession.conf.get(SETTING, None)
    if not named:
        warnings.warn(f"{SETTING} is not set: surrogates are made with a public key", stacklevel=3)
    return named.encode() if named else KEY


def masked(docs: DataFrame, key: bytes | None = None, text: str = "text") -> DataFrame:
    """docs with surrogates in text and the number of finds in n_entities. key: the secret
    (default: the session's).

    Null and empty texts stay as they are (0 finds); repeated rows stay; a column
    n_entities of docs is replaced, all others are kept.
    """
    key = key_of(docs) if key is None else key
    rows = docs.drop("n_entities")
    schema = StructType(list(rows.schema.fields)).add("n_entities", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in pieces(batches, text):
            at = batch.schema.get_field_index(text)
            done = [replaced(t, surrogates) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(p) for _, p in done], pa.int64())], names=schema.names)
        give_back()

    return rows.mapInArrow(run, schema)


def entities(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """(kind, entity, surrogate, n) of all finds, entities folded to lower case."""
    key = key_of(docs) if key is None else key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in pieces(batches, "text"):
            rows = [p for t in batch.column(0).to_pylist() for p in replaced(t, surrogates)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["kind", "entity", "surrogate"])
        give_back()

    rows = docs.select("text").mapInArrow(run, "kind string, entity string, surrogate string")
    return rows.groupBy("kind", F.lower("entity").alias("entity"), F.lower("surrogate").alias("surrogate")).agg(F.count("*").alias("n"))


def collisions(of: DataFrame) -> DataFrame:
    """The collision check over entities(): surrogates that two entities share, and entities
    with two surrogates. Empty when distinctness and coreference hold."""
    shared = of.groupBy("kind", F.col("surrogate").alias("value")).agg(F.countDistinct("entity").alias("n")).where("n > 1")
    split = of.groupBy("kind", F.col("entity").alias("value")).agg(F.countDistinct("surrogate").alias("n")).where("n > 1")
    return shared.withColumn("fault", F.lit("two entities")).unionByName(split.withColumn("fault", F.lit("two surrogates")))
