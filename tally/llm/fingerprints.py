"""Document fingerprints from prefix polynomial hashes.

For a text of code points c the arrays P[i] = sum of c[k] B**k for k < i,
modulo the prime 2**31 - 1 and for two bases, answer in constant time whether
two spans are equal ((P[j] - P[i]) B**-i), and a binary search over span
equality finds longest common extensions.  The fingerprint of a text is read
off the same arrays: the hash of the whole text with its length, and the
``SKETCH`` smallest distinct (mixed) hashes of all its spans of ``SPAN`` code
points.  Likeness of two fingerprints is the share of spans in common (Dice's
coefficient, its Jaccard part estimated from the smallest hashes of both): 1
for equal fingerprints, about a half for texts that share one half, near 0 for
unrelated texts.

``neighbours`` puts every document beside the next by ascending id.  The texts
are range-partitioned by id once and sorted within partitions, and each task
walks its rows in order; the last row of a partition meets the first of the
next through a small table of partition borders.  No task sees more than its
range; ids equal in a third of the rows are split further by the text's hash.

Defined results: null text is empty; an empty text has the fingerprint of no
span, likeness 1 to another empty text and 0 to any other; equal ids follow
one another in the order of a hash of the text, null ids come last; the only
document of a table is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tally.llm.shared import documents, stored

PRIME = np.uint64(2 ** 31 - 1)
BASES = (1_000_003, 998_244_353)
SPAN = 12
SKETCH = 48
_SHIFT = np.uint64(31)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**62."""
    x = (x & PRIME) + (x >> _SHIFT)
    x = (x & PRIME) + (x >> _SHIFT)
    return np.where(x >= PRIME, x - PRIME, x)


class _Powers:
    """Powers of a number modulo the prime, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.table = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = np.uint64(pow(self.base, len(self.table), int(PRIME)))
            self.table = np.concatenate([self.table, _mod(self.table * step)])
        return self.table[:n]


_UP = tuple(_Powers(b) for b in BASES)
_DOWN = tuple(_Powers(pow(b, -1, int(PRIME))) for b in BASES)


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.prefix = []
        for up in _UP:
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_mod(points * up.upto(self.n)), out=sums[1:])
            self.prefix.append(_mod(sums))

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """Hash of the code points from start to end."""
        return tuple((int(p[end]) - int(p[start])) * int(down.upto(start + 1)[start]) % int(PRIME)
                     for p, down in zip(self.prefix, _DOWN))

    def common_extension(self, other: PrefixHash, start: int = 0, other_start: int = 0) -> int:
        """Length of the longest span both texts have from the given places."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(start, start + middle) == other.span(other_start, other_start + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, width: int) -> np.ndarray:
        """Mixed 64-bit hashes of all spans of a width (of the whole text if shorter)."""
        width = min(width, self.n)
        if not width:
            return np.empty(0, np.uint64)
        count = self.n - width + 1
        high, low = (_mod(_mod(p[width:] + PRIME - p[:count]) * down.upto(count))
                     for p, down in zip(self.prefix, _DOWN))
        x = (high << np.uint64(32)) | low
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def fingerprint(self) -> Fingerprint:
        mixed = self.spans(SPAN)
        few = mixed
        if len(mixed) > 40 * SKETCH:  # the smallest hashes are among those under a bound
            few = mixed[mixed < np.uint64((1 << 64) // len(mixed) * 8 * SKETCH)]
        smallest = np.unique(few)[:SKETCH]
        if len(smallest) < SKETCH and len(few) < len(mixed):  # many repeats: look at all
            smallest = np.unique(mixed)[:SKETCH]
        a, b = self.span(0, self.n)
        return Fingerprint(f"{self.n:x}-{a:08x}{b:08x}", np.unique((smallest >> np.uint64(32)).astype(np.uint32)))


class Fingerprint:
    """``whole``: length and hash of the text; ``sketch``: sorted smallest span hashes."""

    def __init__(self, whole: str, sketch: np.ndarray) -> None:
        self.whole, self.sketch = whole, sketch

    def __str__(self) -> str:
        return f"{self.whole}-{base64.urlsafe_b64encode(self.sketch.astype('>u4').tobytes()).decode()}"

    @staticmethod
    def parse(text: str) -> Fingerprint:
        length, whole, sketch = text.split("-", 2)
        return Fingerprint(f"{length}-{whole}", np.frombuffer(
            base64.urlsafe_b64decode(sketch), ">u4").astype(np.uint32))

    def likeness(self, other: Fingerprint) -> float:
        if self.whole == other.whole:
            return 1.0
        union = np.union1d(self.sketch, other.sketch)
        if max(len(self.sketch), len(other.sketch)) >= SKETCH - 1:
            union = union[:SKETCH]
        if not len(union):
            return 0.0
        both = len(np.intersect1d(np.intersect1d(self.sketch, other.sketch, True), union, True)) / len(union)
        return 2 * both / (1 + both)


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by the first as many
    code points of the following document."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, common_edited long, common_next long")
_WALK = _RESULT + ", part int, edge int, text string"


def _compare(doc_id, text: str, own: PrefixHash, mark: Fingerprint, text_b: str, own_b: PrefixHash,
             mark_b: Fingerprint) -> tuple:
    changed = edited(text, text_b)
    own_e = PrefixHash(changed)
    mark_e = own_e.fingerprint()
    return (doc_id, own.n, hashlib.sha256(changed.encode("utf-8")).hexdigest(), str(mark), str(mark_e),
            mark.likeness(mark_e), mark.likeness(mark_b), own.common_extension(own_e),
            own.common_extension(own_b))


_NAMES = [f.split()[0] for f in _WALK.split(", ")]


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for name in {"doc_id", "n_chars", "common_edited", "common_next"} & set(names):
        out[name] = out[name].astype("Int64")
    return out


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compares each row with the one after it; the first row of the partition
    is also given out as edge 1, the last as edge 2, both with their texts."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            own = PrefixHash(text)
            now = doc_id, text, own, own.fingerprint()
            if held is None:
                rows.append((doc_id, *[None] * 8, part, 1, text))
            else:
                rows.append((*_compare(*held, *now[1:]), part, 0, None))
            held = now
        yield _frame(rows, _NAMES)
    if held is not None:
        yield _frame([(held[0], *[None] * 8, part, 2, held[1])], _NAMES)


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text, following in zip(batch["doc_id"], batch["text"], batch["following"]):
            own, own_b = PrefixHash(text), PrefixHash(following)
            rows.append(_compare(None if pd.isna(doc_id) else int(doc_id), text, own, own.fingerprint(),
                                 following, own_b, own_b.fingerprint()))
        yield _frame(rows, _NAMES[:9])


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness to each
    other and to the next document's; ``common_*`` are the longest common
    extensions from the start."""
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("last", F.col("doc_id").isNull()).withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("last", "doc_id", "tie").sortWithinPartitions("last", "doc_id", "tie"))
    walked = stored(ordered.select("doc_id", "text").mapInPandas(_walk, _WALK), "fingerprints")
    heads = walked.where("edge = 1").select("part", "text")
    parts = heads.select("part").withColumn("next_part", F.coalesce(
        F.lead("part").over(W.orderBy("part")),
        F.min("part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    ends = (
        walked.where("edge = 2").select("doc_id", "text", "part").join(parts, "part")
        .join(heads.select(F.col("part").alias("next_part"), F.col("text").alias("following")), "next_part")
        .select("doc_id", "text", "following").mapInPandas(_finish, _RESULT))
    return walked.where("edge = 0").select(*_NAMES[:9]).unionByName(ends)


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return neighbours(documents(spark, sf_dir))
