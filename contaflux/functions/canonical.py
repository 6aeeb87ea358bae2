"""One text for equal JSON: keys in order at every level, numbers and escapes written one way."""

from __future__ import annotations

import json
import math
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LONE = re.compile("[\ud800-\udfff]")


def number(x: float) -> str:
    """A number as ECMAScript writes it: the shortest digits that give it back, without an
    exponent from 1e-7 up to below 1e21."""
    x = float(x)
    if x == 0:
        return "0"
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    digits, _, power = repr(abs(x)).partition("e")
    whole, _, part = digits.partition(".")
    figures = (whole + part).rstrip("0") if part else whole + part
    point = len(whole) + int(power or 0)
    lead = len(figures) - len(figures.lstrip("0"))
    figures, point = figures[lead:], point - lead
    figures = figures.rstrip("0")
    n = len(figures)
    if n <= point <= 21:
        out = figures + "0" * (point - n)
    elif 0 < point <= 21:
        out = f"{figures[:point]}.{figures[point:]}"
    elif -6 < point <= 0:
        out = f"0.{'0' * -point}{figures}"
    else:
        e = point - 1
        out = f"{figures[0]}{'.' + figures[1:] if n > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"
    return f"-{out}" if x < 0 else out


def string(s: str) -> str:
    """A string with the escapes that JSON needs and no others; halves of pairs stay escaped."""
    out = json.dumps(s, ensure_ascii=False)
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", out)


def written(value: object) -> str:
    """The canonical text of a parsed value. Keys are in the order of their UTF-16 code units."""
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, str):
        return string(value)
    if isinstance(value, (int, float)):
        return number(value)
    if isinstance(value, list):
        return f"[{','.join(map(written, value))}]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return f"{{{','.join(f'{string(k)}:{written(value[k])}' for k in keys)}}}"


def _refused(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def canonical_text(text: str | None) -> str | None:
    """Null for what isn't JSON, for numbers past the largest double, and for values nested too deep to walk."""
    if text is None:
        return None
    try:
        return written(json.loads(text, parse_constant=_refused, parse_int=float))
    except (ValueError, OverflowError, RecursionError):
        return None


def canonical(text: Column) -> Column:
    """A JSON column in canonical form, in Arrow batches: of a key that is there twice the last
    value counts, numbers are doubles. Null where it can't be read."""

    @F.pandas_udf("string")
    def rewritten(values: pd.Series) -> pd.Series:
        return values.map(canonical_text, na_action="ignore")

    return rewritten(text)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form: equal for equal values, however they were written."""
    return F.sha2(canonical(text), 256)
