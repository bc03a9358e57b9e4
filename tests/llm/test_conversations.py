"""Operators 12 and 13 against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tally.llm import conversation_repair as repair
from tally.llm import conversation_trie as trie
from tally.llm.shared import documents

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


# --------------------------------------------------------------------- trie


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            named = f"{len((role or '').encode())}:{role or ''}{text or ''}"
            own[c].append((turn, role or "", hashlib.sha256(named.encode()).digest(), text or ""))
    own = {c: [(r, x) for _, r, _, x in by_turn(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(set), collections.defaultdict(set)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
        ends[seq].add(c)
    children = collections.Counter(s[:-1] for s in members if s)
    leaves, saved = collections.Counter(), collections.Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1]) if s else 0
    sha = lambda s: hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()
    return collections.Counter(
        (min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s], sha(s))
        for s, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(df, **size):
    return collections.Counter(map(tuple, trie.trie(df, **size).select(COLUMNS).collect()))


def conversations():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 30), *range(100, 140), *range(205, 260), -5, -100, 10**12 + 3]:
        for turn in range(rng.choice([0, 1, 2, 3, 7, 9])):
            rows.append((c, turn, "ua"[turn % 2], rng.choice(["hi", "so é", "中文 text", "", None])))
    rows += [(c, None, None, "first") for c in (1, 2, 107)] + [(7, 0, "u", "hi")] * 3 + [(None, 1, "u", "lost")]
    rows += [(301, t, "user", str(t)) for t in range(40)] + [(302, t, "user", str(t) if t < 39 else "x") for t in range(40)]
    rows += [(c, t, "user", str(t)) for c in range(400, 450) for t in range(9)]
    return rows


@pytest.mark.parametrize("size", [{}, {"turns": 30, "segment": 4}, {"segment": 1}])
def test_trie(spark, size):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "node": F.lit(1), "block": F.lit(2)})
    assert trie_of(df.repartition(3), **size) == plain_trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.trie(empty).count() == 0
    assert trie_of(spark.createDataFrame([(105, 0, "u", "a"), (106, 3, None, None)], SCHEMA)) == plain_trie(
        [(105, 0, "u", "a"), (106, 3, None, None)])


def test_layouts_grow_and_paths_split():
    rng = random.Random(1)
    for keys in ([bytes([b]) * 16 for b in range(256)], [rng.randbytes(16) for _ in range(300)],
                 [b"\0" * k + rng.randbytes(16 * 3 - k) for k in range(48)]):
        tree, chars = trie.Tree(), {}
        for n, key in enumerate(keys):
            tree.insert(key, [1, n, 10], n)
            chars |= {key[k:k + 16]: 1 for k in range(0, len(key), 16)}
            assert tree.root.below.room >= min(256, len(set(k[0] for k in keys[:n + 1])))
        rows = list(trie.tree_rows(tree, trie.Start(), chars))
        prefixes = collections.Counter(k[:d] for k in keys for d in range(0, len(k) + 1, 16))
        assert collections.Counter((r[3], r[6]) for r in rows if r[0] == trie.NODE) == collections.Counter(
            (len(p) // 16, n) for p, n in prefixes.items())
        assert sorted(r[7] for r in rows if r[0] == trie.END) == list(range(len(keys)))


def test_trie_query(spark):
    import __spark_entry__ as e
    rows = [tuple(r) for r in documents(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    out = e.queries()["op12_conversation_trie"](spark, SF)
    assert set(out.columns) == set(COLUMNS)
    want = plain_trie(rows)
    assert collections.Counter(map(tuple, out.select(COLUMNS).collect())) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    told = con.sql(e.oracle_sql()["op12_conversation_trie"])
    assert collections.Counter(told.select(*COLUMNS).fetchall()) == want


# ------------------------------------------------------------------- repair

SENTENCE = re.compile(r"(s?(ua)+)?")


def every_repair(rows, inserts=2):
    """All (cost, audit, lines) of rows (role, text, dead, truncated), by trying everything."""
    def extend(k, budget):
        if budget:
            for name in ("user", "assistant"):
                for cost, audit, lines in extend(k, budget - 1):
                    yield cost + 2, "I" + audit, (name + ":",) + lines
        if k == len(rows):
            yield 0, "", ()
            return
        role, text, dead, truncated = rows[k]
        for cost, audit, lines in extend(k + 1, budget):
            yield cost + 3, "D" + audit, lines
            if not dead:
                yield cost + truncated, "K" + audit, (f"{role}:{text}",) + lines
                for name in ("user", "assistant"):
                    yield cost + 2 + truncated, "R" + audit, (f"{name}:{text}",) + lines
    return min((x for x in extend(0, inserts) if SENTENCE.fullmatch("".join(line[:1] for line in x[2]))), key=lambda x: x[:2])


def plain_parse(rows):
    """The same by shortest paths over (row, letters of the sentence modulo their cycle)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "ua", ("ua", "u"): "u"}
    live = {"": (0, "", ())}

    def inserted(live):
        todo = list(live)
        while todo:
            state = todo.pop()
            cost, audit, lines = live[state]
            for name in ("user", "assistant"):
                to = step.get((state, name[0]))
                new = (cost + 2, audit + "I", lines + (name + ":",))
                if to and (to not in live or new[:2] < live[to][:2]):
                    live[to] = new
                    todo.append(to)
        return live

    live = inserted(live)
    for role, text, dead, truncated in rows:
        after = {}
        for state, (cost, audit, lines) in live.items():
            tries = [(state, (cost + 3, audit + "D", lines))]
            if not dead:
                tries.append((step.get((state, role[:1])), (cost + truncated, audit + "K", lines + (f"{role}:{text}",))))
                tries += [(step.get((state, n[0])), (cost + 2 + truncated, audit + "R", lines + (f"{n}:{text}",)))
                          for n in ("user", "assistant")]
            for to, new in tries:
                if to is not None and (to not in after or new[:2] < after[to][:2]):
                    after[to] = new
        live = inserted(after)
    cost, audit, lines = min((live[s] for s in ("", "ua") if s in live), key=lambda x: x[:2])
    return cost, audit, lines


def sha(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def parsed(rows):
    table = repair.Table()
    parse = repair.Parse(table, repair.Stack(0))
    for r in rows:
        parse.row(*r)
    return parse.best()


def test_parser_against_trying_everything():
    kinds = [("system", "s.", False, False), ("user", "u.", False, False), ("assistant", "a.", False, False),
             ("tool", "t.", False, False), ("", "e.", False, False), ("user", "", True, False),
             ("assistant", "cut", False, True), ("C", "head.", False, False), ("$", "end.", False, False)]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            cost, audit, lines = every_repair(rows)
            assert parsed(rows) == (cost, audit, sha(lines)), rows
            assert plain_parse(rows) == (cost, audit, lines)


def test_parser_on_long_conversations():
    rng = random.Random(2)
    for n in (40, 700):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), str(k), rng.random() < .1, rng.random() < .2)
                for k in range(n)]
        cost, audit, lines = plain_parse(rows)
        assert parsed(rows) == (cost, audit, sha(lines))
    assert parsed([("user", "a.", False, False), ("assistant", "b.", False, False)] * 2000)[:2] == (0, "K" * 4000)


def test_table_takes_other_grammars():
    table = repair.Table((("A", "uA"), ("A", "a"), ("A", "B"), ("B", "uB"), ("B", "s")))
    tops = [repair.Stack(0)]
    for symbol in "uuus":
        tops = [t for s in tops for t in s.shift(table, symbol)]
    assert tops and any(s.shift(table, repair.END) for s in tops)


def damaged(rows):
    out = collections.defaultdict(list)
    text_of = lambda x: " " if x is None else str(x)
    for c, turn, role, text in rows:
        kind = zlib.crc32(f"{text_of(c)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if kind == 0:
            out[c] += []
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[c] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: by_turn(v) for c, v in out.items()}


def plain_repair(rows):
    out = {}
    for c, turns in damaged(rows).items():
        known, count, marked = set(), collections.Counter(), []
        for _, role, text in turns:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not solid else "duplicate" if (role, text) in known
                     else "truncated" if solid[-1] not in ".!?" else "")
            known.add((role, text))
            count[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        at = [t for t, _, _ in turns if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, lines = plain_parse(marked)
        out[c] = (c, max(at) - min(at) + 1 - len(set(at)) if at else 0, count["blank"], count["duplicate"],
                  count["truncated"], illegal, cost, audit, sha(lines), lines)
    return out


def messy():
    rng = random.Random(7)
    rows = []
    for c in [*range(60), None, -3]:
        for k in range(rng.randrange(12)):
            rows.append((c, rng.choice([k, k, k + 3, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
                         rng.choice(["one.", "two!", "cut", " ", "", None, "é.\n", "three?\x0b", "中。", "\x1f", "four."])))
    return rows + [(999, t, "user" if t % 2 else "assistant", f"say {t}.") for t in range(600)]


def test_repair(spark):
    rows = messy()
    want = plain_repair(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit("x"), "edit": F.lit(1), "repeated": F.lit(2)})
    found = repair.repair(repair.damage(df.repartition(3)))
    got = {r.conv_id: tuple(r) for r in found.collect()}
    kept = {c for c, v in damaged(rows).items() if v}
    assert got == {c: want[c][:-1] for c in kept}
    lines = collections.defaultdict(list)
    for r in sorted(repair.repaired_turns(repair.damage(df)).collect(), key=lambda r: r.position):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
        assert len(lines[r.conv_id]) == r.position
    assert {c: tuple(v) for c, v in lines.items()} == {c: v[-1] for c, v in want.items() if v[-1]}


def test_sql_repairs_the_messy_rows():
    rows = [r for r in messy() if r[0] != 999]
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: r for r in con.sql(repair.ORACLE_SQL).fetchall()} == {c: v[:-1] for c, v in plain_repair(rows).items()}


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair(empty).count() == 0 and repair.repaired_turns(empty).count() == 0


def test_repair_query(spark, tmp_path):
    import __spark_entry__ as e
    rows = [tuple(r) for r in documents(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    out = e.queries()["op13_conversation_repair"](spark, SF)
    assert out.columns == ["conv_id", *repair.COUNTS, "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r) for r in out.collect()} == {c: v[:-1] for c, v in plain_repair(rows).items()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    told = con.sql(e.oracle_sql()["op13_conversation_repair"])
    assert told.columns == out.columns and {r[0]: r for r in told.fetchall()} == {r.conv_id: tuple(r) for r in out.collect()}
    lost = [(c, t, "user", "x.") for c in range(400) for t in range(1)]
    spark.createDataFrame(lost, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r) for r in repair.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {c: v[:-1] for c, v in plain_repair(lost).items()} and any(v[7] == "" for v in got.values())
