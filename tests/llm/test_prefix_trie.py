import hashlib
import math
import random
import zlib

import helpers
import numpy as np
import pytest

from laurel.llm import prefix_trie as op

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            found.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [(x[3], x[4]) for x in sorted(t)] for c, t in found.items()}


def rebuilt(found):
    out = {}
    for c, own in found.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = found.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    return out


def plain(found):
    """Every node by plain recursion over its prefix."""
    nodes = {}
    for c in sorted(found):
        for d in range(len(found[c]) + 1):
            nodes.setdefault(tuple(found[c][:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        saved[k] = saved.get(k, 0) + own
        leaves[k] = leaves.get(k, 0) or 1
        if k:
            up = k[:-1]
            kids[up] = kids.get(up, 0) + 1
            saved[up] = saved.get(up, 0) + saved[k]
            leaves[up] = leaves.get(up, 0) + leaves[k]
    out = []
    for k, members in nodes.items():
        ended = ",".join(str(c) for c in members if len(found[c]) == len(k))
        parent = min(nodes[k[:-1]]) if k else None
        out.append((members[0], len(k), parent, len(members), kids.get(k, 0), leaves[k], saved[k], hashlib.sha256(ended.encode()).hexdigest()))
    return helpers.plain(out)


def conversations(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: op.F.lit("other") for c in ["depth", "p", "q", "name", "n", "owner", "bytes", "worth"]})


def got(df):
    return helpers.plain(df.drop("p", "q").collect())


def random_rows(draw, convs, turns):
    rows = []
    for _ in range(convs):
        c = draw.randint(-40, 60)
        rows += [(c, t, draw.choice(["user", "assistant"]), draw.choice(["a", "bé", "", None])) for t in range(draw.randint(0, turns))]
    return rows


@pytest.mark.parametrize("graft", [False, True])
def test_equals_plain_python(spark, graft):
    rows = random_rows(random.Random(3), 120, 9)
    want = sequences(rows)
    assert got(op.conversation_trie(conversations(spark, rows), graft)) == plain(rebuilt(want) if graft else want)


def test_forests_are_merged_across_slabs(spark):
    draw = random.Random(4)
    rows = [(c, t, "user", draw.choice("ab") if t > 3 else "same") for c in range(60) for t in range(draw.randint(2, 9))]
    turns = op.staged(op.ordered(conversations(spark, rows)), "turns")
    ids = turns.select("conv_id").distinct()
    # Arrow batches hold the rows of a partition; partitions are slabs of their own.
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = got(op.trie(turns, ids, slab_rows=3))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == plain(sequences(rows))


def test_long_conversations_go_over_bands(spark):
    base = [f"t{i}" for i in range(300)]
    texts = {1: base, 2: base, 3: base[:64], 4: base[:128] + ["x"], 5: base[:200] + ["y"] * 90, 6: base[:65], 7: ["z"] * 64, 8: ["z"] * 63}
    rows = [(c, i, "user", x) for c, t in texts.items() for i, x in enumerate(t)]
    assert got(op.conversation_trie(conversations(spark, rows))) == plain(sequences(rows))


def test_chains_are_those_of_the_union_of_neighbours():
    # Rows: ab, abc, abd, ac (lengths and common prefixes of neighbours).
    chains = op.merges(np.array([2, 3, 3, 2]), np.array([2, 2, 1]))
    assert sorted(chains) == [(0, 2, 1, 2), (0, 3, 0, 1), (1, 1, 2, 3), (2, 2, 2, 3), (3, 3, 1, 2)]


def test_awkward_rows(spark):
    rows = [
        (None, 1, "user", "lost"), (5, None, "user", "first"), (5, 1, None, "x"), (5, 1, "user", None), (5, 1, "user", None),
        (6, 0, "a", "b:c"), (7, 0, "ab", ":c"), (8, 3, "user", helpers.LONG), (9, 3, "user", helpers.LONG), (2**63 - 1, 0, "user", "max"), (-(2**63), 0, "user", "min"),
    ]
    docs = conversations(spark, rows)
    assert got(op.conversation_trie(docs)) == plain(sequences(rows))
    assert got(op.conversation_trie(docs, graft=True)) == plain(rebuilt(sequences(rows)))
    assert got(op.conversation_trie(docs.limit(0))) == got(op.conversation_trie(docs.where("conv_id IS NULL"))) == []


def test_ids_without_turns_are_members_of_the_root(spark):
    empty = spark.createDataFrame([], "conv_id long, depth long, name string, bytes long")
    ids = spark.createDataFrame([(4,), (12,), (-3,)], "conv_id long")
    digest = hashlib.sha256(b"-3,4,12").hexdigest()
    assert got(op.trie(empty, ids)) == [(-3, 0, None, 3, 0, 1, 0, digest)]
