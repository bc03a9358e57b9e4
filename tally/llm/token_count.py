"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at the tokenizer's special strings (one token each, the
library's default) and into the byte-level pre-tokens.  A pre-token starts as
a linked list of bytes; a heap gives the adjacent pair of lowest merge rank
(leftmost at ties), which is merged until none is left.  Its count is its
bytes minus the merges; no identifier is ever emitted.  Each worker remembers
the counts of pre-tokens it has seen, up to ``CACHE_ENTRIES``, then forgets
all: memory stays bounded and the result does not depend on it.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated
rows are counted each; further columns of the input are ignored; very long
pre-tokens cost n log n.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.shared import documents

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
CACHE_ENTRIES = 400_000
CACHED_LENGTH = 64
#: Fixed value: the byte-level pre-token pattern of this kind of tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What the library takes for \s; without the separators \x1c-\x1f.
_SPACE = r"\p{White_Space}"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(path: str) -> tuple[dict[tuple[int, int], tuple[int, int]], list[str]]:
    """Merges as {(left, right): (rank, joined)} over symbol numbers (a byte is
    its own number), and the special strings, of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    number: dict[str, int] = byte_letters()
    merges: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        joined = number.setdefault(left + right, len(number))
        merges[number[left], number[right]] = rank, joined
    return merges, [t["content"] for t in spec.get("added_tokens", [])]


def count_merged(piece: bytes, merges: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Symbols left of one pre-token after all merges."""
    n = left = len(piece)
    if n < 2:
        return n
    symbol = list(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(merges[pair][0], i, pair) for i, pair in enumerate(zip(piece, piece[1:])) if pair in merges]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbol[i] != pair[0] or symbol[j] != pair[1]:
            continue  # one of the two has been merged since
        symbol[i], symbol[j] = merges[pair][1], -1
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if found := merges.get(new := (symbol[i], symbol[k])):
                heapq.heappush(heap, (found[0], i, new))
        if (h := before[i]) >= 0 and (found := merges.get(new := (symbol[h], symbol[i]))):
            heapq.heappush(heap, (found[0], h, new))
    return left


class _Counts(dict):
    """Pre-token -> count, filled on demand."""

    def __init__(self, merges) -> None:
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> int:
        count = count_merged(piece.encode("utf-8"), self.merges)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = count
        return count


def counter(path: str) -> Callable[[str | None], int]:
    """A function text -> number of tokens for the tokenizer file."""
    merges, specials = load_merges(path)
    pieces = regex.compile(PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"\s", _SPACE)).findall
    cut = regex.compile("|".join(map(regex.escape, specials))).split if specials else lambda t: [t]
    counts = _Counts(merges)

    def count(text: str | None) -> int:
        if not text:
            return 0
        parts = cut(text) if specials and any(s in text for s in specials) else (text,)
        return len(parts) - 1 + sum(sum(map(counts.__getitem__, pieces(p))) for p in parts)

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path)
        for texts in batches:
            yield texts.map(count)

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (
        narrow.withColumn("n_tokens", tokens("text"))
        .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens",
                (F.col("n_tokens") > limit).alias("over_limit")))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
