"""Conditions that users write as JSON, compiled to a column; what is wrong is said by its path.

    {"type": "RECIBO", "supplier": "edp", "keywords": ["luz", "gás"]}
    {"any": [{"total": {"ge": 100}}, {"not": {"country": {"in": ["PT", "ES"]}}}]}

An object holds if all its members hold; ``all``, ``any`` and ``not`` nest. A plain value of a field must
be equal; an object of operators says more. The short names type, supplier, supplierNif,
emailDomain and keywords mean what they mean in folder rules. An empty object holds for all.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampType

#: Rules of one table; they are one expression, and more would be no rules of people.
MOST_RULES = 1000
DEPTH = 32


class ConditionError(ValueError):
    """A condition that can't be compiled; path says where (``$.any[1].total.ge``)."""

    def __init__(self, path: str, problem: str):
        super().__init__(f"{path}: {problem}")
        self.path, self.problem = path, problem


@dataclass
class Fields:
    """The columns that conditions may name, and the columns behind the short names."""

    documents: DataFrame
    names: dict[str, str] = field(default_factory=lambda: {"supplierNif": "nif", "emailDomain": "email", "keywords": "text"})

    def column(self, name: str, path: str) -> tuple[Column, object]:
        real = self.names.get(name, name)
        if real not in self.documents.columns:
            raise ConditionError(path, f"no such field: {name}")
        return F.col(f"`{real}`"), self.documents.schema[real].dataType


def _text(value: object, path: str) -> str:
    if not isinstance(value, str) or not value:
        raise ConditionError(path, "needs a text")
    return value


def _texts(value: object, path: str) -> list[str]:
    if not isinstance(value, list) or not value:
        raise ConditionError(path, "needs a list of texts")
    return [_text(v, f"{path}[{i}]") for i, v in enumerate(value)]


def _literal(value: object, kind: object, path: str) -> Column:
    """A JSON value that can be compared with a column of the type."""
    if isinstance(value, bool) or value is None or isinstance(value, (list, dict)):
        raise ConditionError(path, "needs a text or a number")
    if isinstance(kind, NumericType):
        if not isinstance(value, (int, float)):
            raise ConditionError(path, "needs a number")
        return F.lit(value)
    if isinstance(kind, (DateType, TimestampType)):
        if not isinstance(value, str) or not re.fullmatch(r"\d{4}-\d\d-\d\d", value):
            raise ConditionError(path, "needs a date (yyyy-mm-dd)")
        return F.try_to_date(F.lit(value), "yyyy-MM-dd")
    return F.lit(_text(value, path))


def _pattern(value: object, path: str) -> str:
    pattern = _text(value, path)
    try:
        re.compile(pattern)
    except re.error as error:
        raise ConditionError(path, f"not a pattern: {error}") from None
    return pattern


def _low(column: Column) -> Column:
    return F.lower(F.coalesce(column.cast("string"), F.lit("")))


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}
_SEARCH: dict[str, Callable[[Column, Column], Column]] = {"contains": F.contains, "starts": F.startswith, "ends": F.endswith}


def _operator(name: str, value: object, column: Column, kind: object, path: str) -> Column:
    if name in _COMPARE:
        return _COMPARE[name](column, _literal(value, kind, path))
    if name in _SEARCH:
        return _SEARCH[name](_low(column), F.lit(_text(value, path).lower()))
    if name == "matches":
        return F.coalesce(column.cast("string"), F.lit("")).rlike(_pattern(value, path))
    if name == "in":
        if not isinstance(value, list) or not value:
            raise ConditionError(path, "needs a list")
        return column.isin(*(_literal(v, kind, f"{path}[{i}]") for i, v in enumerate(value)))
    if name == "exists":
        if not isinstance(value, bool):
            raise ConditionError(path, "needs true or false")
        return column.isNotNull() if value else column.isNull()
    raise ConditionError(path, f"no such operator: {name}")


def _short(name: str, value: object, fields: Fields, path: str) -> Column | None:
    """The short names of folder rules with plain values; null for others."""
    if name not in ("supplier", "emailDomain", "keywords") or isinstance(value, dict):
        return None
    column, _ = fields.column(name, path)
    if name == "supplier":
        return F.contains(_low(column), F.lit(_text(value, path).lower()))
    if name == "emailDomain":
        return F.endswith(_low(column), F.lit("@" + _text(value, path).lower()))
    return reduce(lambda a, b: a | b, (F.contains(_low(column), F.lit(k.lower())) for k in _texts(value, path)))


def compiled(condition: object, fields: Fields, path: str = "$", depth: int = 0) -> Column:
    """The column of a parsed condition, true or false, never null."""
    if depth > DEPTH:
        raise ConditionError(path, f"nested deeper than {DEPTH}")
    if not isinstance(condition, dict):
        raise ConditionError(path, "needs an object")
    parts = []
    for name, value in condition.items():
        at = f"{path}.{name}"
        if name in ("all", "any"):
            if not isinstance(value, list) or not value:
                raise ConditionError(at, "needs a list of conditions")
            inner = [compiled(v, fields, f"{at}[{i}]", depth + 1) for i, v in enumerate(value)]
            parts.append(reduce((lambda a, b: a & b) if name == "all" else (lambda a, b: a | b), inner))
        elif name == "not":
            parts.append(~compiled(value, fields, at, depth + 1))
        elif (short := _short(name, value, fields, at)) is not None:
            parts.append(short)
        else:
            column, kind = fields.column(name, at)
            if isinstance(value, dict):
                if not value:
                    raise ConditionError(at, "needs an operator")
                parts += [_operator(k, v, column, kind, f"{at}.{k}") for k, v in value.items()]
            else:
                parts.append(column == _literal(value, kind, at))
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def parsed(text: str | None) -> object:
    try:
        return json.loads(text) if text is not None else {}
    except ValueError as error:
        raise ConditionError("$", f"not JSON: {error}") from None


def first_matching(documents: DataFrame, rules: DataFrame) -> tuple[DataFrame, list[tuple[object, str, str]]]:
    """(documents with rule_id, problems). rules: id, priority, active and conditions (JSON; null holds for
    all). rule_id is the active rule of the largest priority whose condition holds (ties: the
    smaller id), null without one. problems: (id, path, problem) of each rule that can't be
    compiled, which then matches nothing. Rules are what people write: more than MOST_RULES are
    a ValueError, and they become one expression, so documents aren't joined or moved."""
    some = rules.where("active").select("id", "priority", "conditions").limit(MOST_RULES + 1).collect()
    if len(some) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fields, found, problems = Fields(documents), [], []
    for rule in sorted(some, key=lambda r: (r["priority"] is None, -(r["priority"] or 0), r["id"])):
        try:
            found.append(F.when(compiled(parsed(rule["conditions"]), fields), F.lit(rule["id"])))
        except ConditionError as error:
            problems.append((rule["id"], error.path, error.problem))
    kind = rules.schema["id"].dataType if not isinstance(rules.schema["id"].dataType, StringType) else StringType()
    return documents.withColumn("rule_id", F.coalesce(*found, F.lit(None)).cast(kind)), problems
