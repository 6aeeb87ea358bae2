"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A text is marked (a dummy blank before it, blanks become U+2581), every piece that starts at
a character is found by one walk of a double-array trie of the pieces' bytes, and the path
with the largest sum of scores wins, ties to the earlier start. A character that no piece
covers alone costs the least score less a penalty and is written as its bytes' pieces.
U+2581 itself is always written as bytes, so decoding gives back every text exactly.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from contaflux.llm.common import give_back, pieces as cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What an uncovered character costs below the least score.
PENALTY = 10.0
#: Encoded words that a task keeps for their next occurrence.
MOST_KEPT = 300_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(raw):
        tag, at = varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(raw, at)
        elif kind == 2:
            size, at = varint(raw, at)
            value, at = raw[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id, from a SentencePiece model file."""
    found = []
    with open(path, "rb") as file:
        raw = file.read()
    for number, message in fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for part, value in fields(message):
                if part == 1:
                    piece = value.decode()
                elif part == 2:
                    score = struct.unpack("<f", value)[0]
                elif part == 3:
                    kind = value
            found.append((piece, score, kind))
    return found


@dataclass
class DoubleArray:
    """A trie of byte strings: the child of node s by byte c is base[s] + c + 1, if its check is s."""

    base: list[int] = field(default_factory=list)
    check: list[int] = field(default_factory=list)
    value: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, keys: dict[bytes, int]) -> DoubleArray:
        out = cls([0], [-2], [-1])
        tree: dict = {}
        for key, value in keys.items():
            node = tree
            for byte in key:
                node = node.setdefault(byte, {})
            node[-1] = value
        todo, free = [(0, tree)], 1
        while todo:
            at, node = todo.pop()
            out.value[at] = node.get(-1, -1)
            children = sorted(b for b in node if b >= 0)
            if not children:
                continue
            base, tries = max(0, free - children[0] - 1), 0
            while True:
                most = base + children[-1] + 2
                if most > len(out.check):
                    more = most - len(out.check)
                    out.base += [0] * more
                    out.check += [-1] * more
                    out.value += [-1] * more
                if all(out.check[base + b + 1] == -1 for b in children):
                    break
                base, tries = base + 1, tries + 1
            if tries > 20:  # what lies before is nearly full: later searches begin here
                free = base + children[0] + 1
            out.base[at] = base
            for b in children:
                out.check[base + b + 1] = at
                todo.append((base + b + 1, node[b]))
            while free < len(out.check) and out.check[free] != -1:
                free += 1
        more = 258  # so that a child is looked up without a test of the length
        out.base += [0] * more
        out.check += [-1] * more
        out.value += [-1] * more
        return out


class Unigram:
    """Encoder and decoder of a list of (piece, score, kind)."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        usable = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED) and p}
        self.trie = DoubleArray.of(usable)
        self.scores = [score for _, score, _ in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        least = min((self.scores[i] for i in usable.values()), default=0.0)
        self.uncovered = least - PENALTY
        self.out = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNUSED) else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        several = "".join(p for p, _, kind in pieces if kind in (NORMAL, USER_DEFINED) and len(p) > 1)
        marked = any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind in (NORMAL, USER_DEFINED))
        # No piece runs over the start of a marked word, nor over a line feed: parts between them are encoded alone.
        self.parts = None if marked or "\n" in several else re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
        self.kept: dict[str, list[int]] = {}

    def best(self, raw: bytes) -> list[int]:
        """Ids of the best path over the bytes of a marked text."""
        base, check, value, scores, n = self.trie.base, self.trie.check, self.trie.value, self.scores, len(raw)
        none = float("-inf")
        best, back, piece = [none] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            lead = raw[i]
            end = i + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            so_far, node, j, alone = best[i], 0, i, False
            while j < n:
                child = base[node] + raw[j] + 1
                if check[child] != node:
                    break
                node = child
                j += 1
                found = value[node]
                if found >= 0:
                    if j == end:
                        alone = True
                    score = so_far + scores[found]
                    if score > best[j]:
                        best[j], back[j], piece[j] = score, i, found
            if not alone and so_far + self.uncovered > best[end]:
                best[end], back[end], piece[end] = so_far + self.uncovered, i, -1
            i = end
        ids: list[int] = []
        j = n
        while j > 0:
            i = back[j]
            if piece[j] >= 0:
                ids.append(piece[j])
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(raw[i:j])]
            else:
                ids.append(self.unknown)
            j = i
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty: none."""
        if not text:
            return []
        ids: list[int] = []
        for i, plain in enumerate(text.split(MARK)):
            if i:
                ids += [self.bytes[b] for b in MARK.encode()] if self.bytes else [self.unknown]
            marked = plain.replace(" ", MARK)
            if not i:
                marked = MARK + marked
            if self.parts is None:
                ids += self.best(marked.encode())
                continue
            for part in self.parts.findall(marked):
                have = self.kept.get(part)
                if have is None:
                    have = self.best(part.encode())
                    if len(self.kept) >= MOST_KEPT:
                        self.kept.clear()
                    if len(part) <= 64:
                        self.kept[part] = have
                ids += have
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: markers become blanks, runs of byte pieces characters, and the dummy blank goes."""
        text = b"".join([self.out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def tokenized(docs: DataFrame, path: str = PIECES, text: str = "text") -> DataFrame:
    """docs with ids (array of int; null and empty text: empty), n_pieces, and round_trip:
    whether decoding the ids gives the text back (null counts as empty).

    Columns of docs with one of these names are replaced; repeated rows stay.
    """
    rows = docs.drop("ids", "n_pieces", "round_trip")
    schema = StructType(list(rows.schema.fields)).add("ids", ArrayType(IntegerType())).add("n_pieces", "long").add("round_trip", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(path))  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram(shared.value)
        for batch in cut(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            ids = [model.encode(t) for t in texts]
            same = [model.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]
            more = [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)
            del texts, ids, same, more
        give_back()

    return rows.mapInArrow(run, schema)


def detokenized(rows: DataFrame, path: str = PIECES) -> DataFrame:
    """rows with a column text, decoded from ids (null: null)."""
    kept = rows.drop("text")
    schema = StructType(list(kept.schema.fields)).add("text", "string")
    shared = rows.sparkSession.sparkContext.broadcast(read_pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram(shared.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            texts = [None if x is None else model.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)
        give_back()

    return kept.mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str = PIECES) -> DataFrame:
    """doc_id, n_pieces, n_bytes (byte pieces among them), ids_md5 (of the ids as 32-bit
    little-endian numbers) and round_trip of every row; the digests are taken where the
    ids are made, so the ids aren't moved."""
    schema = "doc_id long, n_pieces long, n_bytes long, ids_md5 string, round_trip boolean"
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram(shared.value)
        fallback = frozenset(model.bytes.values())
        for batch in cut(batches, "text"):
            out = []
            for t in batch.column(1).to_pylist():
                ids = model.encode(t)
                digest = hashlib.md5(struct.pack(f"<{len(ids)}i", *ids), usedforsecurity=False).hexdigest()
                out.append((len(ids), sum(map(fallback.__contains__, ids)), digest, model.decode(ids) == (t or "")))
            columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_pieces", "n_bytes", "ids_md5", "round_trip"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
