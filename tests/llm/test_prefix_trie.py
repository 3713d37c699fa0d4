import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from wardstat.llm import prefix_trie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Plain loops over (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            token = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, token, role, text))
    own = {c: [(r[3], r[4]) for r in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        head = c - int(np.fmod(c, 20))
        built[c] = tuple(own.get(head, [])[:h] + own[c][h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def words(p):
        text = p[-1][1] if p else ""
        for gap in "\t\n\x0b\x0c\r":
            text = text.replace(gap, " ")
        return len([w for w in text.split(" ") if w])

    def under(p):
        yield p
        for k in kids.get(p, []):
            yield from under(k)

    out = []
    for p, members in nodes.items():
        ends = sorted(c for c in members if len(built[c]) == len(p))
        below = list(under(p))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), sum(q not in kids for q in below),
            sum((len(nodes[q]) - 1) * words(q) for q in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def table(spark, rows):
    rows = [(*r, "x", 1) for r in rows]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, head int").repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def made(seed, n, turns=6, texts=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 400), n):
        for t in range(rng.randint(1, turns)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", " d  e\tf ", "g"][:texts])))
    rng.shuffle(rows)
    return rows


ODD = [
    (7, None, None, None), (7, 1, "user", ""), (7, 1, "", "user"), (7, 1, "user", ""), (None, 1, "user", "lost"), (40, 0, "user", "é 漢字 🙂"),
    (41, 0, "user", "only"), (42, 0, "u", "sera"), (42, 0, "us", "era"), (43, 2, "user", "x " * 5000), (43, None, "user", None), (60, 3, "a", "b"), (61, 1, "a", "c"), (-21, 0, "a", "b"),
]


@pytest.mark.parametrize("block,partitions", [(1 << 20, 1), (1 << 20, 4), (9, 3), (1, 2)])
def test_brute_force(spark, block, partitions):
    rows = made(1, 90) + [(c + 1000, t, r, x) for c, t, r, x in ODD if c is not None] + ODD
    assert got(prefix_trie.trie(table(spark, rows), block_turns=block, partitions=partitions)) == brute(rows)


def test_group_of_equal_conversations_over_many_blocks(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(160) for t in range(5)] + made(3, 20)
    assert got(prefix_trie.trie(table(spark, rows), block_turns=40, partitions=6)) == brute(rows)


def test_long_conversations(spark):
    same = [(20, t, "user", f"w {t % 7}") for t in range(700)]
    rows = same + [(39, t, "user", f"w {t % 7}") for t in range(690)] + [(59, t, "user", "z") for t in range(3)]
    assert got(prefix_trie.trie(table(spark, rows), block_turns=500, partitions=2)) == brute(rows)


def test_one_and_none(spark):
    assert got(prefix_trie.trie(table(spark, [(5, 0, "user", "hi there")]))) == brute([(5, 0, "user", "hi there")])
    assert prefix_trie.trie(table(spark, [(1, 1, "a", "b")]).where("false")).count() == 0
    assert prefix_trie.trie(table(spark, [(None, 1, "a", "b")])).count() == 0


def test_turnless_conversation_ends_at_the_root(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 2)
    rows = [(c, 0, "user", "gone")]
    assert got(prefix_trie.trie(table(spark, rows))) == brute(rows)
    assert brute(rows)[0][1] == 0


def test_extents_are_those_of_plain_loops():
    rng = np.random.default_rng(5)
    for _ in range(50):
        m = int(rng.integers(1, 40))
        values = rng.integers(0, 5, m)
        table, at, least = prefix_trie._Minima(values), rng.integers(0, m, 30), rng.integers(0, 6, 30)
        for i, least_i, left, right in zip(at, least, table.reach_left(at, least), table.reach_right(at, least)):
            r = left_want = i
            while r + 1 < m and values[r + 1] >= least_i:
                r += 1
            while left_want > 0 and values[left_want] >= least_i:
                left_want -= 1
            assert (left, right) == (left_want, r)


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    duckdb.execute(f"create or replace view conversations as select * from '{folder}/conversations.parquet'")
    want = duckdb.sql(f"select {', '.join(COLUMNS)} from ({queries.ORACLE['op13_conversation_trie']})").fetchall()
    assert got(queries.QUERIES["op13_conversation_trie"](spark, folder)) == sorted(want, key=str)
