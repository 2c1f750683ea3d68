"""Trie of conversations by their turns: which openings are shared, by how many, and what a cache of them saves.

Every prefix of a conversation has a name: two 64-bit sums of its turns' hashes, each made with its depth, so
that prefixes of any length are named by running sums over ranges (``order.running``). Paths are cut into
bands of ``BAND`` depths, and equal pieces are counted once. What a band's pieces share is found by sorting
them and by union-find over the edges between neighbours, their common prefixes (LCP), from the deepest
up: two components that meet at some depth make a node there, and the names between that depth and the
component's own one hang under it as a chain. A slab of a partition makes its own forest. Only components
at a slab's edges can go on in the next one: those are contracted to one row for each depth and merged by
name across the boundaries.

Values of subtrees are sums over members, so no path is followed. A node belongs to its smallest member,
and the nodes of one member are the lower part of its path. So the worth of a subtree is that of all members
of the node, without what the node's own member has above it: a second forest and a running sum.

A conversation is never one row, nor one task: ranges cut it, and a band has ``BAND`` turns at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm.order import running
from laurel.llm.sql_forms import crc32_sql
from laurel.llm.tables import prepare, read, staged

BAND = 64
SLAB_ROWS = 16_384
CHUNK_IDS = 8192
KEY = ["depth", "p", "q"]


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), name (of role and text) and bytes (of the text) of every turn.

    Turns go by ``turn``, nulls first; turns of one number go by a hash of role and text, and equal rows
    are turns each. Null role or text is empty. Rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", name.alias("name"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("depth")
    )
    return running(staged(rows, "turns"), "conv_id", ["turn", "name"], adds=["depth"], name="turns-placed").select("conv_id", "depth", "name", "bytes")


def _kept(conv_id: str):
    return F.crc32(F.col(conv_id).cast("string")) % 9


def grafted(turns: DataFrame) -> DataFrame:
    """Every conversation c begins with the first turns of conversation c - c % 5; its own go on after its first ones.

    The number of turns taken and left out is the CRC-32 of c modulo 9, or what there is.
    """
    lengths = staged(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "lengths")
    base = lengths.select("conv_id", _kept("conv_id").alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    of_base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    short = base.join(of_base, "base", "left").withColumn("less", F.col("h") - F.coalesce("there", F.lit(0))).where("less > 0").select("conv_id", "less")
    own = turns.where(F.col("depth") > _kept("conv_id")).join(short, "conv_id", "left")
    own = own.select("conv_id", (F.col("depth") - F.coalesce("less", F.lit(0))).alias("depth"), "name", "bytes")

    offsets = F.explode(F.array(*(F.lit(k).cast("long") for k in range(-4, 5)))).alias("_offset")
    given = turns.where("depth <= 8 AND conv_id % 5 = 0").select("*", offsets).withColumn("_to", F.try_add("conv_id", "_offset"))
    given = given.where((F.col("_to") - F.col("_to") % 5 == F.col("conv_id")) & (F.col("depth") <= _kept("_to")))
    given = given.select(F.col("_to").alias("conv_id"), "depth", "name", "bytes").join(lengths.select("conv_id"), "conv_id", "left_semi")
    return own.unionByName(given)


def common(band: np.ndarray, start: np.ndarray, names: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many names each row shares with the next one; rows of different starts share none."""
    if len(lengths) < 2:
        return np.zeros(0, np.int64)
    same = (names[1:] == names[:-1]).all(axis=2)
    same &= np.arange(names.shape[1]) < np.minimum(lengths[1:], lengths[:-1])[:, None]
    lcp = np.cumprod(same, axis=1).sum(axis=1)
    together = (band[1:] == band[:-1]) & (start[1:] == start[:-1]).all(axis=1)
    return np.where(together, lcp, 0)


def merges(lengths: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Chains of the forest: first row, last row, depth above and lowest depth.

    Edges are taken from the deepest up. Both sides of an edge end at its depth: what they have below it
    hangs there as chains, and from there on they are one component.
    """
    up = list(range(len(lengths)))
    low, high, deep = list(up), list(up), lengths.tolist()
    chains = []

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    at = lcp.tolist()
    for edge in np.argsort(-lcp, kind="stable").tolist():
        depth = at[edge]
        if depth == 0:
            break
        a, b = find(edge), find(edge + 1)
        for x in (a, b):
            if deep[x] > depth:
                chains.append((low[x], high[x], depth, deep[x]))
        up[b] = a
        high[a], deep[a] = high[b], depth
    chains += [(low[x], high[x], 0, deep[x]) for x in range(len(up)) if up[x] == x]
    return chains


def _forest(adds: Sequence[str], least: str | None, slab_rows: int):
    def table_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        rows = table.num_rows
        column = table.column("names").chunk(0)
        offsets = column.offsets.to_numpy().astype(np.int64)
        flat = column.values.to_numpy()[offsets[0] : offsets[-1]].reshape(-1, 3)
        lengths = np.diff(offsets) // 3
        row = np.repeat(np.arange(rows), lengths)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        names = np.zeros((rows, BAND, 3), np.int64)
        names[row, place] = flat
        band = table.column("band").to_numpy()
        start = np.stack([table.column("sp").to_numpy(), table.column("sq").to_numpy()], axis=1)
        chains = np.array(merges(lengths, common(band, start, names[:, :, :2], lengths)), np.int64).reshape(-1, 4)

        size = chains[:, 3] - chains[:, 2]
        own = np.repeat(np.arange(len(chains)), size)
        depth = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + chains[own, 2]  # place of the node in its band
        first, last = chains[own, 0], chains[own, 1]
        above = np.where((depth > 0)[:, None], names[first, np.maximum(depth - 1, 0), :2], start[first])
        out = {"depth": BAND * band[first] + depth + 1, "p": names[first, depth, 0], "q": names[first, depth, 1], "bytes": names[first, depth, 2], "above_p": above[:, 0], "above_q": above[:, 1]}
        for name in adds:
            total = np.concatenate([[0], np.cumsum(table.column(name).to_numpy())])
            out[name] = total[last + 1] - total[first]
        if least:
            values = table.column(least).to_numpy()
            # Of first row, end, first row, end, ...: every second value is the least of a chain.
            bounds = np.stack([chains[:, 0], chains[:, 1] + 1], axis=1).ravel()
            out[least] = np.minimum.reduceat(np.append(values, np.iinfo(np.int64).max), bounds)[::2][own]
        out["open"] = (first == 0) | (last == rows - 1)
        return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in out.items()})

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= slab_rows:
                yield table_of(held)
                held, count = [], 0
        if held:
            yield table_of(held)

    return forest


def nodes(pieces: DataFrame, adds: Sequence[str], least: str | None, name: str, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """All nodes of ``pieces`` (band, sp, sq, names and values): KEY, bytes, above_p, above_q, ``adds`` and ``least``."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["band", "sp", "sq", "names"]
    values = [*adds, *([least] if least else [])]
    rows = pieces.select(*order, *values).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = "depth long, p long, q long, bytes long, above_p long, above_q long, " + "".join(f"{v} long, " for v in values) + "open boolean"
    found = staged(rows.mapInArrow(_forest(adds, least, slab_rows), schema), name)
    same = [*KEY, "bytes", "above_p", "above_q"]
    whole = [F.sum(v).alias(v) for v in adds] + ([F.min(least).alias(least)] if least else [])
    return found.where("NOT open").drop("open").unionByName(found.where("open").groupBy(*same).agg(*whole))


def pieces(turns: DataFrame) -> DataFrame:
    """conv_id, band, the name before the band (sp, sq), the names in it, and its last one (KEY)."""
    lanes = {"p": F.xxhash64("name", "depth", F.lit(1)), "q": F.xxhash64("name", "depth", F.lit(2))}
    rows = turns.withColumns(lanes).withColumns({"own_p": F.col("p"), "own_q": F.col("q")}).drop("name")
    rows = running(rows, "conv_id", ["depth"], xors=["p", "q"], name="prefixes")
    item = F.struct("depth", "p", "q", "bytes", "own_p", "own_q")
    band = F.floor((F.col("depth") - 1) / BAND).alias("band")
    cut = rows.groupBy("conv_id", band).agg(F.sort_array(F.collect_list(item)).alias("_list"))
    first, last = F.col("_list")[0], F.element_at("_list", -1)
    return cut.select(
        "conv_id", "band", first["p"].bitwiseXOR(first["own_p"]).alias("sp"), first["q"].bitwiseXOR(first["own_q"]).alias("sq"),
        F.flatten(F.transform("_list", lambda x: F.array(x["p"], x["q"], x["bytes"]))).alias("names"), *(last[k].alias(k) for k in KEY),
    )


def _id_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted ids of one node as text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in KEY], axis=1)
        ids = batch.column("conv_id").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(ids)]])
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({k: pa.array(key[cuts[:-1], i]) for i, k in enumerate(KEY)} | {"first": pa.array(ids[cuts[:-1]]), "ids": pa.array(texts, pa.string())})


def _id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node from its sorted runs of ids, as a stream."""
    key, digest, done = None, None, []

    def out() -> pa.RecordBatch:
        columns = {k: pa.array([r[0][i] for r in done], pa.int64()) for i, k in enumerate(KEY)}
        return pa.RecordBatch.from_pydict(columns | {"ends_sha256": pa.array([r[1] for r in done], pa.string())})

    for batch in batches:
        for *now, ids in zip(*(batch.column(c).to_pylist() for c in [*KEY, "ids"]), strict=True):
            if now != key:
                if key:
                    done.append((key, digest.hexdigest()))
                key, digest = now, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if len(done) >= CHUNK_IDS:
            yield out()
            done = []
    if key:
        done.append((key, digest.hexdigest()))
    if done:
        yield out()


def ends(last: DataFrame) -> DataFrame:
    """KEY and the digest of the ids, in order, of the conversations (conv_id, KEY) that end there.

    Ids are sorted by ranges and joined to runs of text; a node's runs are then hashed one after the other.
    """
    parts = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = last.repartitionByRange(parts, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    runs = rows.select(*KEY, "conv_id").mapInArrow(_id_lists, "depth long, p long, q long, first long, ids string")
    runs = runs.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return runs.mapInArrow(_id_hashes, "depth long, p long, q long, ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """The trie of ``turns`` (conv_id, depth from 1 without gaps, name, bytes) of the conversations ``ids`` (conv_id, distinct).

    Returns, for each distinct prefix, KEY (its name; the root's is 0, 0, 0), conv_id (its smallest member),
    parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (of its subtree: bytes of
    last turns, times the members beyond the first) and ends_sha256 (ids of members that end here). Ids without
    turns are members of the root only. Without ids there are no nodes.
    """
    cut = staged(pieces(turns), "pieces")
    piece = [F.first(c).alias(c) for c in ("sp", "sq", "names")]
    once = cut.groupBy("band", *KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("owner"), *piece)
    found = staged(nodes(once, ["n_convs"], "owner", "forest", slab_rows), "nodes")
    children = found.groupBy((F.col("depth") - 1).alias("depth"), F.col("above_p").alias("p"), F.col("above_q").alias("q")).agg(F.count(F.lit(1)).alias("n_children"))
    children = staged(children, "children")
    worth = (F.col("n_convs") - 1) * F.col("bytes")
    full = found.join(children, KEY, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)).cast("long"), "worth": worth})
    full = full.withColumns({"above": F.col("worth"), "nth": F.lit(1).cast("long")})
    # Along the part of its path that a member owns: what it has saved so far, and which node is the first.
    full = staged(running(staged(full, "full"), "owner", ["depth"], adds=["above", "nth"], name="owned"), "above")
    weights = full.groupBy("owner").agg(F.sum("worth").alias("worth"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    weights = staged(weights, "weights")
    owned = cut.join(weights.withColumnRenamed("owner", "conv_id"), "conv_id").groupBy("band", *KEY).agg(F.sum("worth").alias("worth"), F.sum("leaves").alias("leaves"), *piece)
    below = nodes(owned, ["worth", "leaves"], None, "subtrees", slab_rows).select(*KEY, F.col("worth").alias("_worth"), F.col("leaves").alias("n_leaves"))

    top = ids.agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    of_root = weights.agg(F.coalesce(F.sum("worth"), F.lit(0)).alias("saved_tokens"), F.coalesce(F.sum("leaves"), F.lit(1)).alias("n_leaves"))
    at_root = children.where("depth = 0").agg(F.coalesce(F.sum("n_children"), F.lit(0)).alias("n_children"))
    zero = {k: F.lit(0).cast("long") for k in KEY}
    root = top.crossJoin(F.broadcast(of_root)).crossJoin(F.broadcast(at_root)).withColumns(zero | {"parent_conv_id": F.lit(None).cast("long")})

    inner = full.join(below, KEY).withColumn("saved_tokens", F.col("_worth") - (F.col("above") - F.col("worth")))
    # Only the first node of a member has another member's node above it.
    parents = full.where("n_children > 0").select(*KEY, "owner").unionByName(root.select(*KEY, "owner"))
    parents = parents.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("above_p"), F.col("q").alias("above_q"), F.col("owner").alias("parent_conv_id"))
    tops = inner.where("nth = 1").join(parents, ["depth", "above_p", "above_q"], "left")
    rest = inner.where("nth > 1").withColumn("parent_conv_id", F.col("owner"))
    columns = [*KEY, "owner", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    every = tops.select(*columns).unionByName(rest.select(*columns)).unionByName(root.select(*columns))

    last = cut.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("_last"))
    last = ids.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(F.col("_last")[k], F.lit(0)).alias(k) for k in KEY))
    ended = ends(last)
    out = every.join(ended, KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    whole = ["depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return out.select(F.col("owner").alias("conv_id"), *(F.col(c).cast("long").alias(c) for c in whole), "ends_sha256", "p", "q")


def conversation_trie(conversations: DataFrame, graft: bool = False) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text), as they are or ``grafted``; other columns are ignored."""
    prepare(conversations.sparkSession)
    turns = staged(ordered(conversations), "ordered")
    ids = staged(turns.select("conv_id").distinct(), "ids")
    return trie(staged(grafted(turns), "grafted") if graft else turns, ids)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read(spark, sf_dir, "conversations"), graft=True).drop("p", "q")


ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS w, any_value({crc32_sql("CAST(conv_id AS VARCHAR)")} % 9) AS h
  FROM t GROUP BY conv_id),
b AS (
  SELECT c.conv_id, list_concat(coalesce(base.w[1:c.h], []), c.w[c.h + 1:]) AS w
  FROM c LEFT JOIN c base ON base.conv_id = c.conv_id - c.conv_id % 5),
m AS (SELECT conv_id, len(w) AS len, unnest(range(0, len(w) + 1)) AS d, w FROM b),
n AS (
  SELECT d, w[1:d] AS k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN octet_length(encode(w[d].x)) ELSE 0 END) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = d), '')) AS ends_sha256
  FROM m GROUP BY d, w[1:d]),
p AS (SELECT n.*, up.conv_id AS parent_conv_id FROM n LEFT JOIN n up ON up.d = n.d - 1 AND up.k = n.k[1:n.d - 1]),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN kids ON kids.d = p.d AND kids.k = p.k),
s AS (
  SELECT top, list_slice(k, 1, top) AS k, sum((n_convs - 1) * bytes) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS top FROM f) GROUP BY top, list_slice(k, 1, top))
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM f JOIN s ON s.top = f.d AND s.k = f.k
"""
