"""The prefix trie against a brute-force trie, and its spilling queue."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from linewarden.llm import common, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node int"


def brute_force(rows):
    """Trie rows of plain (conv_id, turn, role, text) rows."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        lead = c - (c % 5 if c >= 0 else -(-c % 5))
        path = tuple(turns.get(lead, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    totals = {}
    for path in sorted(members, key=len, reverse=True):
        under = [totals[child] for child in children[path]]
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        totals[path] = (sum(t[0] for t in under) or 1, own + sum(t[1] for t in under))
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *totals[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    }


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = [tuple(r) for r in prefix_trie.prefix_trie(frame).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute_force(rows)


def some_rows():
    dice = random.Random(5)
    rows = [
        (c, t, dice.choice(["user", "system", None]), dice.choice(["a", "bé", "", None, "long " * 50]))
        for c in [*range(60), -7, -5, -3, 10**15 + 3] for t in range(dice.randint(0, 11))
    ]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 200) for t in range(12)]
    rows += [(7, None, "user", "first"), (7, 2, "user", "tie"), (7, 2, "user", "tie"), (None, 1, "u", "lost")]
    rows += [(3 * 10**4, 0, None, None), (2**63 - 1, 1, "a", "b"), (-2**63, 1, "a", "b")]
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit, factor", [(20_000, 1000), (30, 3)])
def test_trie_equals_brute_force(spark, monkeypatch, limit, factor):
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", limit)
    monkeypatch.setattr(prefix_trie, "LEVEL_FACTOR", factor)
    check(spark, some_rows())


def test_trie_of_small_tables(spark):
    check(spark, [])
    check(spark, [(5, 1, "user", "x")])
    check(spark, [(None, 1, "user", "x")])


def test_trie_of_the_table(spark, sf_dir):
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()
    check(spark, [tuple(r) for r in rows])


def test_shards_stay_below_their_limit(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", 30)
    monkeypatch.setattr(prefix_trie, "LEVEL_FACTOR", 3)
    frame = spark.createDataFrame([(*r, "x", 1) for r in some_rows()], SCHEMA)
    nodes, levels = prefix_trie.node_rows(prefix_trie.paths(prefix_trie.rebuilt(frame)))
    sizes = nodes.groupBy("level", "shard").count().where("level = 0").collect()
    assert levels > 2 and max(r["count"] for r in sizes) <= 30


def test_queue_spills_and_keeps_order():
    dice = random.Random(1)
    queue = prefix_trie.SpillingQueue(limit=10)
    sums = defaultdict(int)
    for _ in range(500):
        key = (dice.randint(0, 99), b"x")
        sums[key] += 1
        queue.push(key, (1, 2, 3))
    for key in sorted(sums):
        assert queue.pop(key) == (sums[key], 2 * sums[key], 3 * sums[key])
    assert not len(queue) and queue.pop((5, b"x")) == (0, 0, 0)
