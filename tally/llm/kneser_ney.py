"""LM scoring: an interpolated modified Kneser-Ney bigram model.

Tokens are the words of the text with A-Z lower-cased, then one end; a start
stands before the first word as a context only.  The model is counted in
Spark in three shuffles: words (by 64-bit hash), bigrams (by hash of the
pair), and what the bigrams say of their words (by word range): how often and
in how many ways a word is followed, and after how many words it comes.  Each
reducer writes sorted arrays into a folder below ``spark.checkpoint.dir``:
word hashes with counts, whose places are the word numbers; bigram pairs with
counts, sorted within hash buckets; word statistics by number.  Workers
memory-map these files and look whole batches up by sorted search, so no
worker loads the model and the driver sees counts of counts alone.

p(w | v) = (max(c(vw) - D(c), 0) + gamma(v) p1(w)) / c(v), with D by c = 1, 2,
3 and more; p1 is the same over continuation counts, interpolated with one
part in V + 1, the last for unknown words.  After an unknown word p1 alone
holds.

Words are merged in as many ranges as there are buckets of pairs, so neither
step has a group that grows with the vocabulary or the corpus.

Scale: every task works in slices of ``SLICE_BYTES`` of text and sends sorted
blocks, already counted; buckets get ``BUCKET_TOKENS`` tokens on average and
take pairs by hash, so neither a word nor a pair is ever one task's load.  A
lost executor repeats its tasks, which write the same files under the same
names (written aside and moved, so a killed attempt leaves no half of one).  Word
numbers have 32 bits: over 2**32 - 2 distinct words raise.  Two words with one
64-bit hash would be counted as one.

Defined results: null and empty texts are one end token; a training set
without rows gives every token the base and model probability 1; repeated rows
count each; a null id is not held out; an empty table gives no rows.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.shared import documents, shared_dir, stored

HELD_OUT_OF, HELD_OUT = 10, 0
SLICE_BYTES = 8 << 20
BUCKET_TOKENS, LEAST_BUCKETS = 2_000_000, 32
LEAST_RANGE = 256
BASE_ADD = 0.1
END_HASH = np.int64(-0x61C8864680B583EB)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2 ** 64 - 1], np.uint64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


class Files:
    """Arrays in a shared folder, written whole and memory-mapped."""

    def __init__(self, root: str) -> None:
        self.root = root
        self._open: dict[str, np.ndarray] = {}

    def put(self, name: str, array: np.ndarray) -> None:
        system, path = fs.FileSystem.from_uri(f"{self.root}/{name}")
        system.create_dir(os.path.dirname(path), recursive=True)
        if isinstance(system, fs.LocalFileSystem):
            part = f"{path}.{uuid.uuid4().hex}"
            array.tofile(part)
            os.replace(part, path)  # a repeated task replaces the file by an equal one
        else:
            part = f"{path}.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(np.ascontiguousarray(array).data)
            if system.get_file_info(path).type != fs.FileType.NotFound:
                system.delete_file(path)  # an earlier attempt's, equal
            system.move(part, path)

    def get(self, name: str, dtype) -> np.ndarray:
        if name not in self._open:
            system, path = fs.FileSystem.from_uri(f"{self.root}/{name}")
            if not isinstance(system, fs.LocalFileSystem):  # a copy without a name, gone with the worker
                copy = tempfile.TemporaryFile()
                with system.open_input_stream(path) as source:
                    while chunk := source.read(1 << 22):
                        copy.write(chunk)
                copy.flush()
                size, path = copy.tell(), copy
            else:
                size = os.path.getsize(path)
            self._open[name] = np.memmap(path, dtype, "r") if size else np.empty(0, dtype)
        return self._open[name]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of lower-cased texts, and the words of each text."""
    data = b"\n".join([*texts, b"\0" * 8])
    raw = np.frombuffer(data, np.uint8)
    text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    end = int(text_ends[-1]) if len(texts) else 0
    word = ~_SPACE[raw[:end]]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    lanes = np.ndarray((max(0, len(raw) - 7),), "<u8", data, strides=(1,))
    hashes = (sizes.astype(np.uint64) + np.uint64(1)) * _M1
    todo, at = np.arange(len(starts)), 0
    while len(todo):
        lane = lanes[starts[todo] + at] & _LOW_BYTES[np.minimum(sizes[todo] - at, 8)]
        x = (hashes[todo] ^ lane) * _M2
        x = (x ^ (x >> np.uint64(29))) * _M3
        hashes[todo] = x ^ (x >> np.uint64(32))
        at += 8
        todo = todo[sizes[todo] > at]
        if at >= 1024 and len(todo):  # the rest of very long words at once
            for i in todo:
                a = int(starts[i])
                hashes[i] ^= np.uint64(xxhash.xxh64_intdigest(data[a + at:a + int(sizes[i])], 7))
            break
    in_text = np.diff(np.searchsorted(starts, np.concatenate([[0], text_ends])))
    return hashes.view(np.int64), in_text


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Rows with their lower-cased bytes, ``SLICE_BYTES`` at a time."""
    for batch in batches:
        start, texts, size = 0, [], 0
        for i, text in enumerate(batch["text"]):
            texts.append(text.encode("utf-8").lower() if text else b"")
            size += len(texts[-1])
            if size >= SLICE_BYTES or i == len(batch) - 1:
                yield batch.iloc[start:i + 1], texts
                start, texts, size = i + 1, [], 0


def _pair_bucket(pairs: np.ndarray, buckets: int) -> np.ndarray:
    x = (pairs ^ (pairs >> np.uint64(31))) * _M2
    return ((x ^ (x >> np.uint64(33))) * _M3 >> np.uint64(20)) % np.uint64(buckets)


def _runs(numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of each run of equal numbers."""
    starts = np.flatnonzero(np.diff(numbers, prepend=numbers[:1] + 1)) if len(numbers) else np.empty(0, np.int64)
    return zip(numbers[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(numbers)])


class Words:
    """The sorted word hashes: hash -> number, number -> count."""

    def __init__(self, files: Files, shards: list[tuple[int, int, int]]) -> None:
        self.files, self.shards = files, shards  # (part, first hash, rows) in order
        self.firsts = np.array([s[1] for s in shards], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum([s[2] for s in shards])]).astype(np.int64)
        self.size = int(self.offsets[-1])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of sorted distinct hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        bounds = np.append(np.searchsorted(hashes, self.firsts), len(hashes))
        for (part, _, rows), offset, a, b in zip(self.shards, self.offsets, bounds, bounds[1:]):
            if a < b:
                known = self.files.get(f"word-hash-{part}", np.int64)
                at = np.searchsorted(known, hashes[a:b])
                hit = known[np.minimum(at, rows - 1)] == hashes[a:b]
                number[a:b][hit] = at[hit] + offset
                count[a:b][hit] = self.files.get(f"word-count-{part}", np.int64)[at[hit]]
        return number, count


def _sequence(hashes: np.ndarray, in_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes (sorted, the end among them), the tokens of all texts as
    indices into them, the context of each token (-1: start), each text's end."""
    distinct, inverse = np.unique(np.append(hashes, END_HASH), return_inverse=True)
    ends = np.cumsum(in_text + 1) - 1
    tokens = np.full(len(hashes) + len(in_text), inverse[-1], np.int64)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = inverse[:-1]
    context = np.concatenate([[-1], tokens[:-1]])
    context[np.concatenate([[0], ends[:-1] + 1])[:len(ends)]] = -1
    return distinct, tokens, context[:len(tokens)], ends


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows, texts in _slices(batches):
        hashes, in_text = word_hashes(texts)
        distinct, counts = np.unique(hashes, return_counts=True)
        yield pd.DataFrame({"hash": np.append(distinct, END_HASH), "n": np.append(counts, len(in_text))})


def _write_words(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, files = TaskContext.get().partitionId(), Files(root)
        parts = [(b["hash"].to_numpy(), b["n"].to_numpy()) for b in batches if len(b)]
        if parts:
            hashes, counts = (np.concatenate(x) for x in zip(*parts))
            files.put(f"word-hash-{part}", hashes)
            files.put(f"word-count-{part}", counts)
            yield pd.DataFrame({"part": [part], "first": hashes[:1], "rows": [len(hashes)], "n": [counts.sum()]})

    return run


def _count_pairs(root: str, shards: list, buckets: int):
    """Sorted blocks of distinct pairs (context number << 32 | word number) with
    their counts, one a bucket and slice; the start has the number V."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(Files(root), shards)
        for _, texts in _slices(batches):
            distinct, tokens, context, _ = _sequence(*word_hashes(texts))
            number = words.find(distinct)[0].astype(np.uint64)
            before = np.where(context < 0, np.uint64(words.size), number[context])
            pairs, counts = np.unique((before << np.uint64(32)) | number[tokens], return_counts=True)
            bucket = _pair_bucket(pairs, buckets)
            order = np.argsort(bucket, kind="stable")
            pairs, counts = pairs[order], counts[order].astype("<u4")
            yield pd.DataFrame([(b, _packed(pairs[i:j]), _packed(counts[i:j])) for b, i, j in _runs(bucket[order])],
                               columns=["bucket", "pairs", "counts"])

    return run


def _packed(array: np.ndarray) -> bytes:
    """The array byte by byte, highest bytes together, so that sorted numbers compress."""
    return np.ascontiguousarray(array.view(np.uint8).reshape(len(array), -1).T).tobytes()


def _unpacked(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


_STATS = "bucket int, word_range long, followed binary, ways binary, after binary, n1 long, n2 long, n3 long, n4 long"


def _merge_pairs(root: str, span: int):
    """One bucket: writes its pairs and counts (empty files where it has none),
    gives out what they say of the words, by ranges of ``span`` word numbers."""
    columns = [f.split()[0] for f in _STATS.split(", ")]

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        pairs = np.concatenate([_unpacked(p, "<u8") for p in rows["pairs"]])
        counts = np.concatenate([_unpacked(c, "<u4") for c in rows["counts"]]).astype(np.int64)
        files = Files(root)
        if not len(pairs):
            files.put(f"pair-{key[0]}", pairs)
            files.put(f"pair-count-{key[0]}", counts)
            return pd.DataFrame([], columns=columns)
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        pairs, counts = pairs[first], np.add.reduceat(counts, first)
        files.put(f"pair-{key[0]}", pairs)
        files.put(f"pair-count-{key[0]}", counts)
        before, word = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
        starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        follow = np.stack([before[starts].astype(np.int64), np.add.reduceat(counts, starts),
                           *(np.add.reduceat((counts == c if c < 3 else counts >= c).astype(np.int64), starts)
                             for c in (1, 2, 3))])
        words, after = np.unique(word.astype(np.int64), return_counts=True)
        out = []
        ranges = np.union1d(follow[0] // span, words // span)
        f_at, w_at = (np.searchsorted(x, np.append(ranges, ranges[-1] + 1) * span) for x in (follow[0], words))
        for k, r in enumerate(ranges):
            f, w = follow[:, f_at[k]:f_at[k + 1]], slice(w_at[k], w_at[k + 1])
            out.append((key[0], r, _packed(f[0].astype("<u4")) + _packed(f[1].astype("<u8")),
                        b"".join(_packed(x.astype("<u4")) for x in f[2:]),
                        _packed(words[w].astype("<u4")) + _packed(after[w].astype("<u4")), 0, 0, 0, 0))
        out.append((key[0], -1, b"", b"", b"", *(int((counts == c).sum()) for c in (1, 2, 3, 4))))
        return pd.DataFrame(out, columns=columns)

    return run


def _merge_words(root: str, size: int, span: int):
    """One range of word numbers (the start's is the last): writes their
    statistics, gives out counts of continuation counts."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        low = int(key[0]) * span
        length = min(span, size + 1 - low)
        total, ways, after = np.zeros(length, np.int64), np.zeros((3, length), np.int64), np.zeros(length, np.int64)
        for followed, way, came in zip(rows["followed"], rows["ways"], rows["after"]):
            n = len(followed) // 12
            at = _unpacked(followed[:4 * n], "<u4").astype(np.int64) - low
            total[at] += _unpacked(followed[4 * n:], "<u8").astype(np.int64)
            for k in range(3):
                ways[k][at] += _unpacked(way[4 * n * k:4 * n * (k + 1)], "<u4")
            n = len(came) // 8
            after[_unpacked(came[:4 * n], "<u4").astype(np.int64) - low] += _unpacked(came[4 * n:], "<u4")
        files = Files(root)
        files.put(f"stats-{key[0]}", np.concatenate([total, *ways, after]))
        return pd.DataFrame([[int((after == c).sum()) for c in (1, 2, 3, 4)] + [
            int((after >= 3).sum()), int(after.sum())]], columns=["n1", "n2", "n3", "n4", "n3plus", "pairs"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float, float]:
    """Modified Kneser-Ney discounts by count (0, 1, 2, 3 and more); where a
    count of counts is 0, the next lower discount in reach of its count."""
    if not n1 or not n2:
        return 0.0, 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = min(max(2 - 3 * y * n3 / n2, 0.1), 1.9)
    d3 = min(max(3 - 4 * y * n4 / n3, 0.1), 2.9) if n3 else d2
    return 0.0, max(d1, 0.1), d2, d3


class Model:
    """What scoring needs beside the files."""

    def __init__(self, root: str, shards: list, buckets: int, span: int, tokens: int, high: tuple, low: tuple,
                 uniform: float, pairs: int) -> None:
        self.root, self.shards, self.buckets, self.span, self.tokens = root, shards, buckets, span, tokens
        self.high, self.low, self.uniform, self.pairs = high, low, uniform, pairs
        self.size = sum(s[2] for s in shards)

    def score_slice(self, words: Words, texts: list[bytes]) -> pd.DataFrame:
        distinct, tokens, context, ends = _sequence(*word_hashes(texts))
        starts = np.concatenate([[0], ends[:-1] + 1])[:len(ends)]
        number, count = words.find(distinct)
        base = np.log10((count + BASE_ADD) / (self.tokens + BASE_ADD * (self.size + 1))) if self.tokens else 0.0 * count
        logs = np.log10(self._probabilities(words, number, tokens, context)) if self.tokens else np.zeros(len(tokens))
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.empty(0)
        return pd.DataFrame({
            "n_tokens": (ends - starts + 1).astype(np.int64), "n_known": add((count[tokens] > 0).astype(np.int64)),
            "base_score": add(base[tokens]), "score": add(logs)})

    def _probabilities(self, words: Words, number: np.ndarray, tokens: np.ndarray, context: np.ndarray) -> np.ndarray:
        numbers = np.append(number, self.size)  # the last: the start, reached by context -1
        stats = np.zeros((5, len(numbers)), np.int64)
        known = np.flatnonzero(numbers >= 0)
        known = known[np.argsort(numbers[known], kind="stable")]
        ranges = numbers[known] // self.span
        for r in np.unique(ranges):
            some = known[ranges == r]
            stats[:, some] = words.files.get(f"stats-{r}", np.int64).reshape(5, -1)[:, numbers[some] - r * self.span]
        total, *ways, after = stats
        gamma = sum(d * w for d, w in zip(self.high[1:], ways))
        first = np.maximum(after - np.take(self.low, np.minimum(after, 3)), 0) / self.pairs + self.uniform
        pair_count = self._pair_counts(words, numbers[context], numbers[tokens])
        lower, all_ = first[tokens], total[context]
        seen = np.maximum(pair_count - np.take(self.high, np.minimum(pair_count, 3)), 0)
        return np.where(all_ > 0, (seen + gamma[context] * lower) / np.maximum(all_, 1), lower)

    def _pair_counts(self, words: Words, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(word), np.int64)
        both = np.flatnonzero((before >= 0) & (word >= 0))
        pairs = (before[both].astype(np.uint64) << np.uint64(32)) | word[both].astype(np.uint64)
        distinct, inverse = np.unique(pairs, return_inverse=True)
        bucket, counts = _pair_bucket(distinct, self.buckets), np.zeros(len(distinct), np.int64)
        order = np.argsort(bucket, kind="stable")
        for b, i, j in _runs(bucket[order]):
            known, mine = words.files.get(f"pair-{b}", np.uint64), order[i:j]
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, distinct[mine]), len(known) - 1)
            hit = known[at] == distinct[mine]
            counts[mine[hit]] = words.files.get(f"pair-count-{b}", np.int64)[at[hit]]
        out[both] = counts[inverse]
        return out


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts the model over every row of ``docs``."""
    spark = docs.sparkSession
    root = f"{shared_dir(spark)}/kneser-ney-{uuid.uuid4().hex}"
    texts = docs.select(F.col(text_col).alias("text"))
    counted = (texts.mapInPandas(_count_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
               .repartitionByRange("hash").sortWithinPartitions("hash"))
    written = counted.mapInPandas(_write_words(root), "part int, first long, rows long, n long").collect()
    written.sort(key=lambda r: r["first"])
    shards, tokens = [(r["part"], r["first"], r["rows"]) for r in written], sum(r["n"] for r in written)
    size = sum(s[2] for s in shards)
    if size > 2 ** 32 - 2:
        raise ValueError(f"{size} distinct words; word numbers have 32 bits")
    buckets = max(LEAST_BUCKETS, math.ceil(tokens / BUCKET_TOKENS))
    span = max(LEAST_RANGE, math.ceil((size + 1) / buckets))  # as many ranges of words as buckets of pairs
    none = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(b"").alias("pairs"),
                                       F.lit(b"").alias("counts"))  # so that every bucket gets its files
    said = stored(
        texts.mapInPandas(_count_pairs(root, shards, buckets), "bucket int, pairs binary, counts binary")
        .unionByName(none).groupBy("bucket").applyInPandas(_merge_pairs(root, span), _STATS), "kneser-ney-stats")
    high = said.where("word_range < 0").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n1", "n2", "n3", "n4")]).first()
    low = (said.where("word_range >= 0").groupBy("word_range")
           .applyInPandas(_merge_words(root, size, span), "n1 long, n2 long, n3 long, n4 long, n3plus long, pairs long")
           .agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n1", "n2", "n3", "n4", "n3plus", "pairs")]).first())
    d_low = discounts(*low[:4])
    left = d_low[1] * low[0] + d_low[2] * low[1] + d_low[3] * low[4]
    return Model(root, shards, buckets, span, tokens, discounts(*high), d_low,
                 left / max(low[5], 1) / (size + 1), max(low[5], 1))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(Files(model.root), model.shards)
        for rows, texts in _slices(batches):
            out = model.score_slice(words, texts)
            out.insert(0, "doc_id", rows["doc_id"].astype("Int64").to_numpy())
            out.insert(1, "held_out", rows["held_out"].to_numpy())
            out.insert(4, "train_tokens", model.tokens)
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       held_out(F.col(id_col)).alias("held_out")).mapInPandas(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
             "base_score double, score double")


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs.where(~held_out(F.col("doc_id")))))
