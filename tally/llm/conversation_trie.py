"""Operator 12: prefix trie of conversations, by adaptive radix trees.

Every distinct sequence of first turns is a node.  A turn is (role, text),
null as empty; its id is the first 16 bytes of a SHA-256, a fixed-width
big-endian number, so a conversation is a byte key and its prefixes of whole
turns are the nodes.

1. Turns are numbered within their conversation and rebuilt (:func:`rebuilt`)
   by windows on the table's own columns; texts stay in the task that read
   them, only ids and lengths move.
2. Each task reads its conversations in order and grows adaptive radix trees
   (:class:`Tree`: layouts of 4, 16, 48 and 256 children that grow, paths
   compressed) and emits a partial node for every turn-aligned byte depth.  A
   tree is emitted and begun anew at ``TURNS`` turns, and a conversation of
   more than ``SEGMENT`` turns goes on in a tree below its own prefix, so a
   task's memory doesn't grow with any group.
3. Partial nodes are merged by prefix digest: a first turn that a third of all
   conversations share is a row a task by then.
4. Subtree values need no walk by depth.  The smallest member of a node owns it; the
   nodes a conversation owns are the lower end of its path.  So with ``owned``
   the code points of a conversation's own nodes, ``total`` those of all its turns,
   and ``before`` those above a node::

       sum of n_convs * chars below v = sum over members (total - before)
       sum of chars below v = sum over members owned  - owned(v's owner) + total(v's owner) - before

   A second pass of the trees adds up ``owned`` and leaves over the members.

Results of odd input: rows with a null conv_id belong to no conversation; of
rows with the same turn the smaller role, then the smaller turn id comes first; a
conversation without turns is a member of the root; a table
without conversations has no nodes; other columns are not carried.  Equal
128-bit ids count as equal turns.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tally.llm.shared import cut, documents
from tally.operators.joins import lookup_join

WIDTH = 16
SEGMENT = 4096
TURNS = 100_000
IDS = 50_000  # conversation numbers in one chunk of an end list

# --------------------------------------------------------------------- tree


class Sorted:
    """Children of up to ``room`` bytes, in order (layouts 4 and 16)."""

    __slots__ = ("room", "keys", "nodes")

    def __init__(self, room: int = 4):
        self.room, self.keys, self.nodes = room, bytearray(), []

    def get(self, byte: int):
        k = bisect_left(self.keys, byte)
        return self.nodes[k] if k < len(self.keys) and self.keys[k] == byte else None

    def put(self, byte: int, node) -> Sorted | Indexed:
        """This layout, or the next larger one if it was full."""
        k = bisect_left(self.keys, byte)
        if k < len(self.keys) and self.keys[k] == byte:
            self.nodes[k] = node
            return self
        if len(self.keys) == self.room:
            return _moved(self, Sorted(16) if self.room == 4 else Indexed()).put(byte, node)
        self.keys.insert(k, byte)
        self.nodes.insert(k, node)
        return self

    def items(self):
        return zip(self.keys, self.nodes, strict=True)


class Indexed:
    """Up to 48 children, found through a table of 256 places."""

    __slots__ = ("place", "nodes")
    room = 48

    def __init__(self):
        self.place, self.nodes = bytearray(256), []

    def get(self, byte: int):
        return self.nodes[self.place[byte] - 1] if self.place[byte] else None

    def put(self, byte: int, node) -> Indexed | Direct:
        if self.place[byte]:
            self.nodes[self.place[byte] - 1] = node
            return self
        if len(self.nodes) == self.room:
            return _moved(self, Direct()).put(byte, node)
        self.nodes.append(node)
        self.place[byte] = len(self.nodes)
        return self

    def items(self):
        return ((b, self.nodes[p - 1]) for b, p in enumerate(self.place) if p)


class Direct:
    """A place for each of the 256 bytes."""

    __slots__ = ("nodes",)
    room = 256

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> Direct:
        self.nodes[byte] = node
        return self

    def items(self):
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


def _moved(small, large):
    for byte, node in small.items():
        large = large.put(byte, node)
    return large


class Node:
    """A compressed path, what stands below it, and the values that end there
    (``[members, smallest conv_id, *sums]``; after ``add_up`` those of the
    whole subtree) with the conversations whose last turn this is."""

    __slots__ = ("path", "below", "value", "ends")

    def __init__(self, path: bytes):
        self.path, self.below, self.value, self.ends = path, Sorted(), None, []


def merged(a: list | None, b: list | None) -> list | None:
    if a is None or b is None:
        return list(b) if a is None and b else a
    return [a[0] + b[0], min(a[1], b[1]), *(x + y for x, y in zip(a[2:], b[2:], strict=True))]


def _same(a: bytes, key: bytes, at: int) -> int:
    """How many bytes of ``a`` stand in ``key`` from ``at`` on."""
    if key.startswith(a, at):
        return len(a)
    lo, hi = 0, min(len(a), len(key) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if key.startswith(a[:mid], at) else (lo, mid - 1)
    return lo


class Tree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value: list, end: int | None) -> None:
        """Add ``value`` for ``key``; ``end`` is the conversation that ends there."""
        node, holder, byte, at = self.root, None, 0, 0
        while True:
            same = _same(node.path, key, at)
            if same < len(node.path):  # split the compressed path
                upper = Node(node.path[:same])
                upper.below = upper.below.put(node.path[same], node)
                node.path = node.path[same + 1:]
                holder.below = holder.below.put(byte, upper)  # the root's own path is empty
                node = upper
            at += same
            if at == len(key):
                break
            holder, byte = node, key[at]
            node = holder.below.get(byte)
            at += 1
            if node is None:
                node = Node(key[at:])
                holder.below = holder.below.put(byte, node)
                break
        node.value = merged(node.value, value)
        if end is not None:
            node.ends.append(end)

    def add_up(self) -> None:
        order = [self.root]
        for node in order:
            order += [n for _, n in node.below.items()]
        for node in reversed(order):
            for _, n in node.below.items():
                node.value = merged(node.value, n.value)


class Start:
    """Where a tree begins: the digest and code points of the turns above it."""

    __slots__ = ("sha", "depth", "before")

    def __init__(self, sha=None, depth: int = 0, before: int = 0):
        self.sha, self.depth, self.before = sha or hashlib.sha256(), depth, before

    def after(self, turn: bytes, chars: int) -> Start:
        sha = self.sha.copy()
        sha.update(turn)
        return Start(sha, self.depth + 1, self.before + chars)

    def digest(self) -> bytes:
        return self.sha.digest()[:WIDTH]


NODE, END = 0, 1


def tree_rows(tree: Tree, start: Start, chars: dict[bytes, int]) -> Iterator[tuple]:
    """(kind, node, parent, depth, chars, before, members, smallest, *sums) of
    every turn-aligned depth below ``start``, and of the root's own."""
    tree.add_up()
    stack = [(tree.root, b"", start)]
    if start.depth == 0 and tree.root.value:
        yield (NODE, start.digest(), None, 0, 0, 0, *tree.root.value)
    while stack:
        node, rest, above = stack.pop()
        rest += node.path
        while len(rest) >= WIDTH:
            turn, rest = rest[:WIDTH], rest[WIDTH:]
            here = above.after(turn, chars[turn])
            yield (NODE, here.digest(), above.digest(), here.depth, chars[turn], above.before, *node.value)
            above = here
        for conv in node.ends:
            yield (END, above.digest(), None, 0, 0, 0, 0, conv, *[0] * (len(node.value) - 2))
        stack += [(n, rest + bytes([b]), above) for b, n in node.below.items()]


def partial_nodes(sums: list[str], turns: int = TURNS, segment: int = SEGMENT) -> Callable:
    """For ``mapInArrow`` over rows (conv_id, id, chars, *sums) of whole
    conversations in the order of their turns, each after a row with a null id."""
    types = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * (5 + len(sums))]
    names = ["kind", "node", "parent", "depth", "chars", "before", "n_convs", "conv_id", *sums]

    def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in rows:
            held.append(row)
            if len(held) == 10_000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held = []
        if held:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    def grow(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trees: dict[bytes, tuple[Tree, Start]] = {}
        chars: dict[bytes, int] = {}
        held = 0
        conv, value, key, start, here = None, None, [], Start(), Start()

        def flush() -> Iterator[tuple]:
            nonlocal held
            for tree, begin in trees.values():
                yield from tree_rows(tree, begin, chars)
            trees.clear()
            chars.clear()
            held = 0

        def put(ends: bool) -> None:
            nonlocal held
            tree, _ = trees.setdefault(start.digest(), (Tree(), start))
            tree.insert(b"".join(t for t, _ in key), [1, conv, *value], conv if ends else None)
            chars.update(key)
            held += len(key) + 1

        for part in parts:
            columns = [part.column(c).to_pylist() for c in ("conv_id", "id", "chars", *sums)]
            for c, turn, n, *more in zip(*columns, strict=True):
                if turn is None:
                    if value is not None:
                        put(True)
                    conv, value, key, start, here = c, more, [], Start(), Start()
                    if held >= turns:
                        yield from flush()
                    continue
                if len(key) == segment:
                    put(False)
                    start, key = here, []
                    if held >= turns:
                        yield from flush()
                key.append((turn, n))
                here = here.after(turn, n)
        if value is not None:
            put(True)
        yield from flush()

    return lambda parts: batches(grow(parts))


def hash_ends(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined lists of (node, first, list), in order of both."""
    node, sha = None, None
    for part in parts:
        nodes, shas = [], []
        for n, text in zip(part.column("node").to_pylist(), part.column("list").to_pylist(), strict=True):
            if n == node:
                sha.update(b",")
            else:
                if sha:
                    nodes.append(node)
                    shas.append(sha.hexdigest())
                node, sha = n, hashlib.sha256()
            sha.update(text.encode())
        yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array(shas, pa.string())], ["node", "ends_sha256"])
    if sha:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], ["node", "ends_sha256"])


def join_ends(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, first conv_id, conv_ids joined) of rows in order of node and conv_id."""
    node, ids = None, []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.string()), strict=True)],
                               ["node", "first", "list"])

    for part in parts:
        out = []
        for n, c in zip(part.column("node").to_pylist(), part.column("conv_id").to_pylist(), strict=True):
            if ids and (n != node or len(ids) == IDS):
                out.append((node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = n
            ids.append(c)
        yield batch(out)
    if ids:
        yield batch([(node, ids[0], ",".join(map(str, ids)))])


# ----------------------------------------------------------------- operator


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``block, conv_id, pos, id, chars`` of every turn; a block is 100
    conversations and the unit that is shuffled."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    known = conversations.where(F.col("conv_id").isNotNull())
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = known.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.substring(F.unhex(F.sha2(named, 256)), 1, WIDTH).alias("id"), F.length(text).cast("long").alias("chars"))
    block = F.col("conv_id") - F.col("conv_id") % 100
    order = Window.partitionBy("block", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "id")
    return (turns.withColumn("block", block).repartition("block")
            .withColumn("pos", F.row_number().over(order)).select("block", "conv_id", "pos", "id", "chars"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Every conversation with its first h turns taken from the first of its
    block (``pos`` orders the turns); before them a row with a null id."""
    own = numbered_turns(conversations)
    h = F.crc32(F.col("conv_id").cast("string")) % 6
    convs = own.groupBy("block", "conv_id").agg(h.alias("h"))
    heads = own.where((F.col("conv_id") == F.col("block")) & (F.col("pos") <= 5)).select("block", "pos", "id", "chars")
    mark = convs.select("block", "conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("id"),
                        F.lit(0).cast("long").alias("chars"))
    given = convs.join(heads, "block").where(F.col("pos") <= F.col("h")).select(*own.columns)
    return mark.unionByName(given).unionByName(own.where(F.col("pos") > h))


def _nodes(turns: DataFrame, sums: list[str], size: dict) -> DataFrame:
    in_order = turns.repartition("block").sortWithinPartitions("block", "conv_id", "pos")
    schema = ("kind int, node binary, parent binary, depth long, chars long, before long, n_convs long, conv_id long"
              + "".join(f", {s} long" for s in sums))
    return cut(in_order.select("conv_id", "id", "chars", *sums).mapInArrow(partial_nodes(sums, **size), schema))


def _merged(parts: DataFrame, sums: list[str]) -> DataFrame:
    same = [F.first(c).alias(c) for c in ("parent", "depth", "chars", "before")]
    return parts.where(F.col("kind") == NODE).groupBy("node").agg(
        *same, F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.sum(s).alias(s) for s in sums])


def trie(conversations: DataFrame, **size: int) -> DataFrame:
    """One row per node: ``node, parent`` (digests), ``conv_id`` (smallest
    member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.  ``size``: turns, segment."""
    turns = rebuilt(conversations)
    totals = Window.partitionBy("block", "conv_id")
    turns = cut(turns.withColumn("total", F.sum("chars").over(totals)))
    parts = _nodes(turns, ["total"], size)
    nodes = cut(_merged(parts, ["total"]))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("_of")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, nodes["node"] == children["_of"], "left").drop("_of").fillna(0, ["n_children"])
    nodes = cut(nodes)
    owners = cut(nodes.groupBy(F.col("conv_id").alias("_conv")).agg(
        F.sum("chars").alias("owned"), F.count_if(F.col("n_children") == 0).alias("leaf")))
    owning = lookup_join(turns.drop("total"), owners, "conv_id", "_conv", "inner").drop("_conv")
    below = _merged(_nodes(owning, ["owned", "leaf"], size), ["owned", "leaf"]).select(
        F.col("node").alias("_node"), F.col("owned").alias("owned_below"), F.col("leaf").alias("n_leaves"))
    whole = turns.where("id is null").select(F.col("conv_id").alias("_whole"), F.col("total").alias("own_total"))
    owner = owners.join(whole, F.col("_conv") == F.col("_whole")).select("_conv", "owned", "own_total")
    above = nodes.select(F.col("node").alias("_up"), F.col("conv_id").alias("parent_conv_id"))
    ended = (parts.where(F.col("kind") == END).select("node", "conv_id").repartitionByRange("node", "conv_id")
             .sortWithinPartitions("node", "conv_id").mapInArrow(join_ends, "node binary, first long, list string"))
    ends = (ended.repartition("node").sortWithinPartitions("node", "first").select("node", "list")
            .mapInArrow(hash_ends, "node binary, ends_sha256 string").withColumnRenamed("node", "_end"))
    out = nodes.join(below, F.col("node") == F.col("_node")).join(ends, F.col("node") == F.col("_end"), "left")
    out = lookup_join(lookup_join(out, owner, "conv_id", "_conv", "inner"), above, "parent", "_up", "left")
    chars_below = F.col("owned_below") - F.col("owned") + F.col("own_total") - F.col("before")
    return out.select(
        F.lower(F.hex("node")).alias("node"), F.lower(F.hex("parent")).alias("parent"), "conv_id", "depth",
        "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("total") - F.col("n_convs") * F.col("before") - chars_below).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(documents(spark, sf_dir, "conversations")).drop("node", "parent")


#: DuckDB: nodes as lists of turns; CRC-32 by its bits.
ORACLE_SQL = """
WITH turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
         xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                                         lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
  FROM turns),
rebuilt AS (
  SELECT c.conv_id, pos, said FROM convs c JOIN turns t ON t.conv_id = c.base WHERE pos <= h
  UNION ALL SELECT conv_id, pos, said FROM convs JOIN turns USING (conv_id) WHERE pos > h),
whole AS (
  SELECT conv_id, coalesce(list(said ORDER BY pos) FILTER (said IS NOT NULL), []) AS path
  FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
steps AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM whole),
nodes AS (
  SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256
  FROM steps GROUP BY ALL),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
upward AS (SELECT node, depth, n_convs, n_children, unnest(range(0, depth + 1)) AS top FROM counted),
below AS (
  SELECT node[1:top] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
         sum(CASE WHEN depth > 0 THEN (n_convs - 1) * length(node[depth].text) ELSE 0 END) AS saved_tokens
  FROM upward GROUP BY ALL)
SELECT c.conv_id, c.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, c.n_convs, c.n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, c.ends_sha256,
FROM counted c JOIN below USING (node)
LEFT JOIN nodes up ON c.depth > 0 AND up.node = c.node[1:c.depth - 1]
"""
