"""Operator 13: repair of conversation structure by generalised LR parsing.

The roles of a conversation, by their first letters, have to form a sentence
of a grammar (:data:`ROLES`: an optional system turn, then user and assistant in
turn).  A generalised LR parser reads the rows in order; its table is made from
the productions (:class:`Table`).  Stacks share their lower parts (a
:class:`Stack` is interned by its state and what stands below), and for every row each
live stack is tried with keep, rerole, delete and, between rows, insert.  Equal stacks
merge by the minimum of (cost, audit), so a row leaves a handful of them and
the parse is linear in the rows.

* keep costs 0, rerole to user or assistant 2, delete 3, insert of an empty user or assistant turn 2;
* a blank row or a duplicate has to be deleted; a truncated row adds 1 unless deleted;
* the audit is the initials of the edits in order (K, R, D, I); of equally
  cheap repairs the one with the ASCII-least audit is taken.

At scale: duplicates are found by a window on (conversation, role, digest of
the text), so one conversation's rows spread over tasks there.  The parse streams
through the rows in order of conversation and turn; a task holds the live stacks, each with
a running SHA-256 of its repaired lines, and the audit's letters, never a conversation's
texts.  :func:`repaired_turns` gives the repaired rows by joins on
(conversation, row number).

Results of odd input: null roles and texts count as one space (a blank text);
null turns come first; rows of the same turn go by role, then text; a null conv_id is a
conversation like any other; a conversation whose rows are all deleted has the
audit of its deletions and the hash of the empty string; an empty table gives no rows;
other columns are not carried.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tally.llm.shared import documents

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = ("su", "ua", "au")
NAMES = {"u": "user", "a": "assistant"}  # roles that rerole and insert can give
ROLES = (("C", ""), ("C", "L"), ("C", "sL"), ("L", "P"), ("L", "LP"), ("P", "ua"))
END = "$"

# ------------------------------------------------------------------- parser


class Table:
    """SLR actions of a grammar given as (head, body) productions, one
    character a symbol; conflicting actions are all kept."""

    def __init__(self, productions=ROLES):
        self.rules = [("'", productions[0][0]), *productions]
        self.heads = {h for h, _ in self.rules}
        self.terminals = {s for _, body in self.rules for s in body} - self.heads
        follow = self._follow()
        states, self.goto, self.reduce = [self._closure({(0, 0)})], {}, {}
        for n, state in enumerate(states):
            for symbol in sorted({self.rules[r][1][d] for r, d in state if d < len(self.rules[r][1])}):
                after = self._closure({(r, d + 1) for r, d in state if self.rules[r][1][d:d + 1] == symbol})
                if after not in states:
                    states.append(after)
                self.goto[n, symbol] = states.index(after)
            for r, d in sorted(state):
                if d == len(self.rules[r][1]):
                    for symbol in follow[self.rules[r][0]]:
                        self.reduce.setdefault((n, symbol), []).append(r)

    def _closure(self, items: set) -> frozenset:
        while True:
            more = items | {(r, 0) for i, d in items for r, (h, _) in enumerate(self.rules) if self.rules[i][1][d:d + 1] == h}
            if more == items:
                return frozenset(items)
            items = more

    def _follow(self) -> dict[str, set[str]]:
        empty, first, follow = set(), {h: set() for h in self.heads}, {h: set() for h in self.heads}
        follow["'"].add(END)
        for _ in range(len(self.rules) * 3 + 3):  # more rounds than symbols: a fixed point
            for head, body in self.rules:
                if all(s in empty for s in body):
                    empty.add(head)
                for k, s in enumerate(body):
                    if all(x in empty for x in body[:k]):
                        first[head] |= first.get(s, {s})
                    if s in self.heads:
                        rest = body[k + 1:]
                        for j, x in enumerate(rest):
                            if all(y in empty for y in rest[:j]):
                                follow[s] |= first.get(x, {x})
                        if all(x in empty for x in rest):
                            follow[s] |= follow[head]
        return follow


class Stack:
    """A parse stack: its top state and the stack below.  Equal stacks are one object."""

    __slots__ = ("state", "below", "above", "after")

    def __init__(self, state: int, below: Stack | None = None):
        self.state, self.below, self.above, self.after = state, below, {}, {}

    def push(self, state: int) -> Stack:
        if state not in self.above:
            self.above[state] = Stack(state, self)
        return self.above[state]

    def shift(self, table: Table, symbol: str) -> list[Stack]:
        """The stacks after ``symbol`` and the reductions it calls for, without
        repeats; for the end mark those that accept."""
        if symbol not in self.after:
            seen, todo, out = {self}, [self], []
            while todo:
                top = todo.pop()
                if symbol == END and 0 in table.reduce.get((top.state, END), ()):
                    out.append(top)
                elif (top.state, symbol) in table.goto:
                    out.append(top.push(table.goto[top.state, symbol]))
                for rule in table.reduce.get((top.state, symbol), ()):
                    head, body = table.rules[rule]
                    base = top
                    for _ in body:
                        base = base.below
                    if rule and (base.state, head) in table.goto:
                        new = base.push(table.goto[base.state, head])
                        if new not in seen:
                            seen.add(new)
                            todo.append(new)
            self.after[symbol] = out
        return self.after[symbol]


class Parse:
    """The live stacks of one conversation: stack -> (cost, audit, hash so far,
    lines not yet in the hash)."""

    def __init__(self, table: Table, base: Stack):
        self.table, self.done, self.rows = table, "", 0
        self.live = self._closed({base: (0, "", None, ())})

    def _closed(self, live: dict) -> dict:
        """With every useful insert, and the hashes brought up to date."""
        todo = list(live)
        while todo:
            stack = todo.pop()
            cost, audit, sha, lines = live[stack]
            for symbol, name in NAMES.items():
                for after in stack.shift(self.table, symbol):
                    self._better(live, after, (cost + INSERT, audit + "I", sha, (*lines, name + ":")), todo)
        for stack, (cost, audit, sha, lines) in live.items():
            if lines:
                fresh = sha.copy() if sha else hashlib.sha256()
                fresh.update(("\n" if sha else "").encode() + "\n".join(lines).encode("utf-8", "surrogatepass"))
                live[stack] = (cost, audit, fresh, ())
        return live

    @staticmethod
    def _better(live: dict, stack: Stack, item: tuple, todo: list | None = None) -> None:
        if stack not in live or item[:2] < live[stack][:2]:
            live[stack] = item
            if todo is not None:
                todo.append(stack)

    def row(self, role: str, text: str, dead: bool, truncated: bool) -> None:
        after: dict = {}
        for stack, (cost, audit, sha, lines) in self.live.items():
            self._better(after, stack, (cost + DELETE, audit + "D", sha, lines))
            if dead:
                continue
            cost += TRUNCATED * truncated
            if role[:1] in self.table.terminals:
                for top in stack.shift(self.table, role[0]):
                    self._better(after, top, (cost + KEEP, audit + "K", sha, (*lines, f"{role}:{text}")))
            for symbol, name in NAMES.items():
                for top in stack.shift(self.table, symbol):
                    self._better(after, top, (cost + REROLE, audit + "R", sha, (*lines, f"{name}:{text}")))
        self.live = self._closed(after)
        self.rows += 1
        if self.rows % 256 == 0:  # letters that all stacks share are settled
            shared = os.path.commonprefix([x[1] for x in self.live.values()])
            self.done += shared
            self.live = {s: (c, a[len(shared):], h, x) for s, (c, a, h, x) in self.live.items()}

    def best(self) -> tuple[int, str, str]:
        """(cost, audit, hash of the repaired lines); every grammar here has a sentence."""
        cost, audit, sha, _ = min((x for s, x in self.live.items() if s.shift(self.table, END)), key=lambda x: x[:2])
        return cost, self.done + audit, (sha or hashlib.sha256()).hexdigest()


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def parse_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over (conv_id, turn, role, text, repeated) in order of
    conversation and row: one row of :data:`RESULT` a conversation."""
    table, base = Table(), Stack(0)
    none = object()
    conv, parse, counts, turns, last = none, None, {}, [], ""

    def result() -> tuple:
        cost, audit, sha = parse.best()
        gaps = min(turns[1] - turns[0] + 1 - turns[2], (1 << 63) - 1) if turns else 0
        return (conv, gaps, *(counts[c] for c in COUNTS[1:-1]), cost, audit, sha)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 9
        types = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                               ["conv_id", *COUNTS, "audit", "repaired_sha256"])

    for part in parts:
        out = []
        for c, turn, role, text, repeated in zip(*(part.column(k).to_pylist() for k in (
                "conv_id", "turn", "role", "text", "repeated")), strict=True):
            if c != conv or conv is none:
                if conv is not none:
                    out.append(result())
                conv, parse, counts, turns, last = c, Parse(table, base), dict.fromkeys(COUNTS, 0), [], None
            if turn is not None:
                if not turns:
                    turns = [turn, turn, 1]
                elif turn != turns[1]:
                    turns = [turns[0], turn, turns[2] + 1]
            if last is not None and last + role[:1] not in LEGAL:
                counts["illegal"] += 1
            last = role[:1]
            solid = text.rstrip(SPACE)
            fault = ("blank" if not solid else "duplicate" if repeated
                     else "truncated" if solid[-1] not in ENDS else None)
            if fault:
                counts[fault] += 1
            parse.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")
        yield batch(out)
    if conv is not none:
        yield batch([result()])


# ----------------------------------------------------------------- operator

def ordered_rows(turns: DataFrame) -> DataFrame:
    """``conv_id, row`` (from 1, in order of turn, role, text), ``turn, role,
    text, repeated`` (role and text stand in an earlier row)."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        role.alias("role"), text.alias("text"))
    same = Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "repeated")
    return (rows.withColumn("repeated", F.row_number().over(same) > 1)
            .withColumn("row", F.row_number().over(order)))


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text): the
    counts of faults, the cost and audit of the repair, and the SHA-256 of the
    repaired ``role:text`` lines."""
    rows = ordered_rows(turns).repartition("conv_id").sortWithinPartitions("conv_id", "row")
    return rows.select("conv_id", "turn", "role", "text", "repeated").mapInArrow(parse_rows, RESULT)


def repaired_turns(turns: DataFrame, repairs: DataFrame | None = None) -> DataFrame:
    """The repaired conversations themselves: ``conv_id, position`` (from 1),
    ``edit`` (K, R or I), ``role, text``."""
    repairs = repair(turns) if repairs is None else repairs
    edits = repairs.where("audit <> ''").select(
        F.col("conv_id").alias("_conv"), F.posexplode(F.split("audit", "(?<=.)(?=.)")).alias("_at", "edit"))
    upto = Window.partitionBy("_conv").orderBy("_at")
    edits = edits.select(
        "_conv", "edit", F.when(F.col("edit") != "I", F.count_if(F.col("edit") != "I").over(upto)).alias("_row"),
        F.count_if(F.col("edit") != "D").over(upto).alias("position")).where("edit <> 'D'")
    rows = ordered_rows(turns).select("conv_id", "row", "role", "text")
    placed = edits.join(rows, F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("_row") == F.col("row")), "left")
    opens = (F.max(F.when((F.col("position") == 1) & (F.col("edit") == "K") & F.col("role").startswith("s"), 1)
                   .otherwise(0)).over(Window.partitionBy("_conv")))
    given = F.when((F.col("position") - opens) % 2 == 1, NAMES["u"]).otherwise(NAMES["a"])
    return placed.select(
        F.col("_conv").alias("conv_id"), "position", "edit",
        F.when(F.col("edit") == "K", F.col("role")).otherwise(given).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's faults, by crc32 of ``conv_id:turn``: dropped, emptied,
    stripped of sentence ends, repeated, or said by the user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = (F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text_of("text"), "[.!?]", ""))
            .otherwise(text_of("text")))
    return conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(text_of("role")).alias("role"),
        text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = documents(spark, sf_dir, "conversations")
    found = repair(damage(conversations)).withColumnRenamed("conv_id", "_found")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _oracle_sql() -> str:
    """DuckDB: the cheapest repair by dynamic programming over the letters a
    sentence can stand at (e: nothing yet, s: system, u: user, a: a full pair).
    A value is the cost in eight digits and the audit, so the least text is
    the least (cost, audit)."""
    def plus(value: str, cost: str, edit: str) -> str:
        return f"lpad((left({value}, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({value}, 9) || '{edit}'"

    def step(edit: str, cost: str, e: str, s: str, u: str, a: str) -> str:
        sources = {"s": e, "u": u, "a": a}
        return ", ".join(f"least({', '.join(plus(x, cost, edit) for x in sources[k].split())}) AS {edit.lower()}_{k}"
                         for k in "sua" if sources[k])

    insert = lambda *of: ", ".join(plus(x, str(INSERT), "I") for x in of)
    kept = f"{KEEP} + {TRUNCATED} * truncated"
    rerole = f"{REROLE} + {TRUNCATED} * truncated"
    legal = ", ".join(f"'{x}'" for x in LEGAL)
    space = " || ".join(f"chr({ord(c)})" for c in SPACE)
    crc = """xor(4294967295, list_reduce(
        list_concat([4294967295::BIGINT], list_transform(string_split(named, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                                      lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""
    return f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS named FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END))
  FROM (SELECT *, {crc} % 20 AS kind FROM given) WHERE kind <> 0),
seen AS (
  SELECT *, rtrim(text, {space}) AS solid,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS repeated FROM damaged),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, repeated) AS place,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, repeated) AS before
  FROM seen),
judged AS (
  SELECT *, (solid = '')::INT AS blank, (solid <> '' AND repeated)::INT AS duplicate,
         (solid <> '' AND NOT repeated AND right(solid, 1) NOT IN ('.', '!', '?'))::INT AS truncated,
         (before IS NOT NULL AND before || left(role, 1) NOT IN ({legal}))::INT AS illegal FROM numbered),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank) AS blank,
         sum(duplicate) AS duplicate, sum(truncated) AS truncated, sum(illegal) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id),
parse AS (
  SELECT conv_id, 0 AS k, '00000000' AS e, NULL::VARCHAR AS s, '00000002I' AS u, '00000004II' AS a FROM counted
  UNION ALL
  SELECT conv_id, k, e, s, least(u, {insert('a')}) AS u, a FROM (
    SELECT conv_id, k, e, s, u, least(a, {insert('u')}) AS a FROM (
      SELECT conv_id, k, e, s, least(u, {insert('e', 's', 'a')}) AS u, a FROM (
        SELECT conv_id, k, d_e AS e, least(d_s, CASE WHEN alive AND left(role, 1) = 's' THEN k_s END) AS s,
               least(d_u, CASE WHEN alive AND left(role, 1) = 'u' THEN k_u END, CASE WHEN alive THEN r_u END) AS u,
               least(d_a, CASE WHEN alive AND left(role, 1) = 'a' THEN k_a END, CASE WHEN alive THEN r_a END) AS a
        FROM (SELECT p.conv_id, k + 1 AS k, role, blank + duplicate = 0 AS alive,
                     {', '.join(f"{plus(x, str(DELETE), 'D')} AS d_{x}" for x in 'esua')},
                     {step('K', kept, 'e', 's', 'e s a', 'u')}, {step('R', rerole, '', '', 'e s a', 'u')}
              FROM parse p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND place = k + 1))))),
best AS (
  SELECT c.*, left(least(e, a), 8)::INT AS cost, substr(least(e, a), 9) AS audit
  FROM counted c JOIN parse p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND k = n),
edits AS (
  SELECT conv_id, i, audit[i] AS edit,
         sum((audit[i] <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY i) AS place,
         sum((audit[i] <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY i) AS out_place
  FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS i FROM best)),
placed AS (
  SELECT e.*, CASE WHEN edit <> 'I' THEN role END AS role, CASE WHEN edit <> 'I' THEN text ELSE '' END AS text
  FROM edits e LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.place = e.place WHERE edit <> 'D'),
opened AS (
  SELECT *, max((out_place = 1 AND edit = 'K' AND left(role, 1) = 's')::INT) OVER (PARTITION BY conv_id) AS opens FROM placed),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (out_place - opens) % 2 = 1 THEN 'user' ELSE 'assistant' END
                             || ':' || text, chr(10) ORDER BY out_place) AS repaired FROM opened GROUP BY conv_id)
SELECT o.conv_id, {', '.join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in COUNTS)}, coalesce(audit, '') AS audit,
       sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLE_SQL = _oracle_sql()
