"""A table function for SQL that cuts a text into windows of words and gives each a vector:

    SELECT d.doc_id, e.* FROM documents d, LATERAL embed(d.text) e

and vectors that come as JSON text."""

from __future__ import annotations

import hashlib
import math
import re
import sys
import unicodedata
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words of a window, words until the next one begins, components of a vector, and the letters
# that a token has.
WINDOW, STEP, DIMENSIONS, SHORTEST, LONGEST = 80, 64, 256, 2, 24
_MARKS = re.compile("[̀-ͯ]")


def tokens(text: str) -> list[str]:
    plain = _MARKS.sub("", unicodedata.normalize("NFD", text.lower()))
    return [t for t in re.split("[^a-z0-9]+", plain) if SHORTEST <= len(t) <= LONGEST]


def vector(text: str) -> list[float]:
    """How often tokens fall into each bucket (the second byte of their SHA-1), scaled to length 1; zeros
    without tokens."""
    counts = [0] * DIMENSIONS
    for token in tokens(text):
        counts[hashlib.sha1(token.encode(), usedforsecurity=False).digest()[1]] += 1
    length = math.sqrt(sum(c * c for c in counts)) or 1.0
    return [c / length for c in counts]


class Embed:
    def eval(self, text: str) -> Iterator[tuple[int, str, list[float]]]:
        words = (text or "").split()
        for number, start in enumerate(range(0, len(words), STEP)):
            content = " ".join(words[start : start + WINDOW])
            yield number, content, vector(content)


def register(spark: SparkSession, name: str = "embed") -> None:
    """Makes embed(text) a table function of the session: chunk (from 0), content and vector of each
    window of a text. A null or blank text has no rows."""
    spark.udtf.register(name, F.udtf(Embed, returnType="chunk int, content string, vector array<double>"))


def of_json(text: Column) -> Column:
    """A vector written as JSON (``[0.1, 2]``); null if it isn't a list of numbers or is empty."""
    read = F.from_json(text, "array<double>")
    return F.when((F.size(read) > 0) & ~F.exists(read, lambda x: x.isNull()), read)
