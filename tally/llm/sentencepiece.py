"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

The pieces come from a ``.model`` file (its normalizer must be the identity;
its spaces become the marker U+2581, one marker is put before a non-empty
text).  A unigram file gives their log scores; a merge file gives ranks, the
negated orders of its merges, whose sums mean nothing.  These become log
probabilities by the Zipf-Mandelbrot law, p = 1 / (rank + ``SHIFT``) over the
sum of all (:func:`log_scores`): nothing is trained on any corpus.  Encoding takes, of all ways to cut the text into
pieces, one with the greatest sum of scores; a character no piece covers falls
back to its UTF-8 bytes at the lowest score minus ``UNKNOWN_PENALTY``.  At
equal sums the cut whose last piece starts first wins, as the forward pass
keeps the first best.  Decoding joins the pieces, turns byte pieces into
characters (invalid bytes into U+FFFD), markers into spaces, and drops the
one marker put in front; it gives back every text without a literal U+2581.

Where no piece of the file crosses a border, between letters or digits and
other characters or before a run of markers, every path is cut there, and the
Viterbi search runs per chunk between such borders with the same result; which
borders hold is read off the pieces (:func:`chunkers`).  The new chunks of a
batch are solved together, position by position, as numpy vectors.  Workers
remember chunks, up to ``CACHE_ENTRIES``.

Defined results: null and empty texts have no pieces and decode to the empty
text; rows repeat as they come; other columns of the input are kept by
:func:`with_pieces` and ignored by :func:`encode`.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.llm.shared import documents

MODEL = "piece_bpe_32k.model"
MARKER = chr(0x2581)
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 500_000
CACHED_BYTES = 64
BATCH_DOCS = 1024
SHIFT = 2.7  # of the Zipf-Mandelbrot law
_UNIGRAM = 1
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at:at + size]
            at += size


def load_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, log score, type) in id order."""
    with open(path, "rb") as f:
        model = f.read()
    pieces, kind = [], _UNIGRAM
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode("utf-8"), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0],
                           piece.get(3, _NORMAL)))
        elif number == 2:  # how the file was made; its third field is the model's kind
            kind = dict(_fields(value)).get(3, _UNIGRAM)
    return pieces if kind == _UNIGRAM else log_scores(pieces)


def log_scores(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Negated merge ranks as log probabilities: of the ordinary pieces
    together 1, falling with the rank."""
    scored = (_NORMAL, _USER, _UNUSED)
    weight = [1 / (max(0.0, -s) + SHIFT) if kind in scored else 0.0 for _, s, kind in pieces]
    total = math.fsum(weight)
    return [(p, math.log(w / total) if w else 0.0, kind) for (p, _, kind), w in zip(pieces, weight, strict=True)]


@dataclass
class DoubleArray:
    """Trie over UTF-8 bytes: the child of node n by byte b is base[n] + b + 1
    if check of that slot is n; value is the piece id, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def build(keys: Iterable[tuple[bytes, int]]) -> DoubleArray:
        tree: dict = {}
        for key, number in keys:
            node = tree
            for byte in key:
                node = node.setdefault(byte, {})
            node[-1] = number
        base, check, value = [0], [0], [-1]
        free, top, todo = 257, 257, [(0, tree)]
        while todo:
            slot, node = todo.pop()
            value[slot] = node.get(-1, -1)
            codes = sorted(b + 1 for b in node if b >= 0)
            if not codes:
                continue
            # slots up to 256 stay out of it: no code is larger, so every base is at least 0
            while free < len(check) and check[free] >= 0:  # the first slot still empty
                free += 1
            # few children fit into gaps; many go where nothing is yet, but for the last stretch
            at = free if len(codes) < 4 else max(free, top - 128)
            while True:
                if at + 257 > len(check):
                    grown = at + 4096 - len(check)
                    base.extend([0] * grown)
                    check.extend([-1] * grown)
                    value.extend([-1] * grown)
                if check[at] < 0 and all(check[at - codes[0] + c] < 0 for c in codes):
                    break
                at += 1
            base[slot] = at - codes[0]
            top = max(top, base[slot] + codes[-1])
            for code in codes:
                check[base[slot] + code] = slot
            todo.extend((base[slot] + b + 1, child) for b, child in node.items() if b >= 0)
        base.extend([0] * 512)
        check.extend([-1] * 512)
        value.extend([-1] * 512)
        return DoubleArray(*(np.array(a, dtype=np.int32) for a in (base, check, value)))


def chunkers(scored: list[tuple[str, int]]) -> Iterator[Callable[[str], list[str]]]:
    """Ways to cut a marked text, finest first; one is right if it leaves every piece whole."""
    odd = "".join(sorted({c for p, _ in scored for c in p if c.isalnum() and not (c.isalpha() or c.isdecimal())}))
    yield re.compile(f"{MARKER}*(?:[^\\W_{odd}]+|[\\W_{odd}](?<!{MARKER})(?:[\\W_{odd}](?<!{MARKER}))*)|{MARKER}+").findall
    yield re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+").findall
    yield lambda text: [text]


class Codec:
    """Encoder and decoder for one list of pieces."""

    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        self.pieces = pieces
        scored = [(p, i) for i, (p, _, kind) in enumerate(pieces) if kind in (_NORMAL, _USER, _UNUSED) and p]
        self.trie = DoubleArray.build((p.encode("utf-8"), i) for p, i in scored)
        self.scores = [s for _, s, _ in pieces]
        self._score_array = np.array(self.scores)
        self.unknown_score = min([pieces[i][1] for _, i in scored], default=0.0) - UNKNOWN_PENALTY
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == _UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.text_of = ["" if kind == _CONTROL else p for p, _, kind in pieces]
        self.chunks = next(f for f in chunkers(scored) if all(len(f(p)) == 1 for p, _ in scored))
        self.seen: dict[str, bytes] = {}
        self._lists: tuple | None = None

    def viterbi(self, text: str) -> list[int]:
        """Best piece ids of a marked text."""
        if self._lists is None:
            self._lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist()
        base, check, value = self._lists
        data, scores = text.encode("utf-8"), self.scores
        n = len(data)
        best, origin, piece = [-np.inf] * n + [-np.inf], [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            lead = data[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, covered, node, j = best[i], False, 0, i
            while j < n:
                child = base[node] + data[j] + 1
                if check[child] != node or child == 0:
                    break
                node = child
                j += 1
                if (number := value[node]) >= 0:
                    covered = covered or j == i + width
                    if (total := here + scores[number]) > best[j]:
                        best[j], origin[j], piece[j] = total, i, number
            if not covered and here + self.unknown_score > best[i + width]:
                best[i + width], origin[i + width], piece[i + width] = here + self.unknown_score, i, -1
            i += width
        return self._trace(data, origin, piece)

    def _trace(self, data: bytes, origin: list[int], piece: list[int]) -> list[int]:
        found: list[int] = []
        end = len(data)
        while end:
            start, number = origin[end], piece[end]
            if number >= 0:
                found.append(number)
            elif self.bytes:
                found.extend([self.bytes[b] for b in reversed(data[start:end])])
            else:
                found.append(self.unknown)
            end = start
        return found[::-1]

    def viterbi_all(self, chunks: list[bytes]) -> list[list[int]]:
        """:meth:`viterbi` of many chunks of one byte length at once."""
        trie, scores = self.trie, self._score_array
        n, width = len(chunks), len(chunks[0])
        data = np.frombuffer(b"".join(chunks), np.uint8).reshape(n, width)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        origin, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        for i in range(width):
            lead = data[:, i]
            rows = starts = np.flatnonzero((lead & 0xC0) != 0x80)  # a character begins here
            size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0).astype(np.int64)
            covered = np.zeros(n, bool)
            node = np.zeros(len(rows), np.int32)
            for j in range(i, width):
                child = trie.base[node] + data[rows, j] + 1
                kept = trie.check[child] == node
                rows, node = rows[kept], child[kept]
                if not len(rows):
                    break
                number = trie.value[node]
                hit = number >= 0
                at, number = rows[hit], number[hit]
                covered[at] |= size[at] == j + 1 - i
                total = best[at, i] + scores[number]
                better = total > best[at, j + 1]
                at, number = at[better], number[better]
                best[at, j + 1], origin[at, j + 1], piece[at, j + 1] = total[better], i, number
            bare = starts[~covered[starts]]
            total, end = best[bare, i] + self.unknown_score, i + size[bare]
            better = total > best[bare, end]
            bare, end = bare[better], end[better]
            best[bare, end], origin[bare, end], piece[bare, end] = total[better], i, -1
        return [self._trace(c, o, p) for c, o, p in zip(chunks, origin.tolist(), piece.tolist())]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Piece ids of each text."""
        cut = [self.chunks(MARKER + t.replace(" ", MARKER)) if t else [] for t in texts]
        if len(self.seen) >= CACHE_ENTRIES:
            self.seen.clear()
        new: dict[int, list[tuple[str, bytes]]] = {}
        for chunk in set().union(*cut):
            if chunk in self.seen:
                continue
            data = chunk.encode("utf-8")
            new.setdefault(len(data), []).append((chunk, data))
        long: dict[str, bytes] = {}
        for size, group in new.items():
            if size > CACHED_BYTES:
                long.update((c, np.array(self.viterbi(c), np.int32).tobytes()) for c, _ in group)
                continue
            for (chunk, _), ids in zip(group, self.viterbi_all([d for _, d in group])):
                self.seen[chunk] = np.array(ids, np.int32).tobytes()
        if long:
            get = lambda c: self.seen[c] if c in self.seen else long[c]
        else:
            get = self.seen.__getitem__
        return [np.frombuffer(b"".join(map(get, chunks)), np.int32) for chunks in cut]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        if self.byte_of and not self.byte_of.keys().isdisjoint(ids):
            parts: list[str] = []
            run = bytearray()
            for number in ids:
                if number in self.byte_of:
                    run.append(self.byte_of[number])
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run.clear()
                parts.append(self.text_of[number])
            parts.append(run.decode("utf-8", "replace"))
            text = "".join(parts)
        else:
            text = "".join(map(self.text_of.__getitem__, ids))
        return text[text.startswith(MARKER):].replace(MARKER, " ")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a model file, built once a process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(load_pieces(path))
    return _CODECS[path]


def with_pieces(docs: DataFrame, path: str, ids_col: str = "token_ids", decoded_col: str = "decoded_text",
                text_col: str = "text") -> DataFrame:
    """``docs`` with the piece ids of each text and what they decode to; columns
    of the input with these names are replaced."""
    docs = docs.drop(ids_col, decoded_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())),
                           T.StructField(decoded_col, T.StringType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_DOCS):  # bounds the ids held at once
                part = batch.slice(start, BATCH_DOCS)
                ids = c.encode_all(part.column(at).to_pylist())
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate([*ids, np.empty(0, np.int32)])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(ends, flat),
                     pa.array([c.decode(x) for x in ids], pa.string())],
                    names=[*part.schema.names, ids_col, decoded_col])

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, token_ids, decoded_text, text`` of every row."""
    return with_pieces(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode(documents(spark, sf_dir), public_tokenizers.path(MODEL))
    return out.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_pieces"), "token_ids",
        (F.col("decoded_text") == F.coalesce("text", F.lit(""))).alias("round_trip"))
