"""Merkle manifest of a data set, with a proof for every row by pointer jumping.

Every row is a leaf, the leaves of a source form a tree of runs of ``FAN`` nodes, and the sources' tops form
one more tree. A node holds a segment: for every step towards an ancestor the digests left and right of the
path. At first a segment has one step, to the parent; each round joins the nodes to their ancestors' rows and
appends the ancestors' segments, so the distance doubles until all have reached the root. Leaves of one run
share everything above it, so the run's row jumps for them and their own step is added at the end.

Leaves are numbered inside their source by ranges (``order.running``), so a source with most of the rows is
spread over all tasks. Groups are runs of at most ``FAN`` nodes. Every level has a ``FAN``-th of the rows of
the level below.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm.order import running
from laurel.llm.sql_forms import crc32_sql
from laurel.llm.tables import prepare, read, staged

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def part(value: Column) -> Column:
    """One value of a leaf: ``-`` for null, else its UTF-8 bytes after their number and a colon."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return digest(*(part(c) for c in (doc_id, source, lang, n_chars, text)))


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row whose text is lower-cased, for a fifth of the rows; null for the others."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return F.when(hit, leaf(*(F.col(c) for c in FIELDS[:-1]), lower))


def _height(leaves: int) -> int:
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def _grouped(nodes: DataFrame, *more: Column) -> DataFrame:
    """Runs of nodes (tree, idx, digest): their row one level higher, with the nodes in order."""
    item = F.struct("idx", "digest", *more)
    return nodes.groupBy("tree", F.floor(F.col("idx") / FAN).alias("run")).agg(F.sort_array(F.collect_list(item)).alias("nodes"))


def _steps(runs: DataFrame, level: int) -> DataFrame:
    """The first step of every node of ``level``: what stands left and right of it, and its parent's digest."""
    at = F.posexplode("nodes").alias("_place", "_node")
    own = runs.select("tree", "run", "digest", "nodes", at)
    left = joined(F.transform(F.slice("nodes", F.lit(1), F.col("_place")), lambda x: x["digest"]))
    right = joined(F.transform(F.slice("nodes", F.col("_place") + 2, F.lit(FAN)), lambda x: x["digest"]))
    step = F.struct(left.alias("left"), right.alias("right"), F.col("digest").alias("up"), (F.col("tree") >= 0).alias("own"))
    return own.select(
        "tree", F.lit(level).alias("level"), F.col("_node.idx").alias("idx"),
        F.col("tree").alias("to_tree"), F.lit(level + 1).alias("to_level"), F.col("run").alias("to_idx"), F.array(step).alias("path"),
    )


def _tree(first: DataFrame, height: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Levels above ``first`` (tree, idx, n nodes of that level, digest, level 0 or 1 by the caller).

    Returns the trees' tops (tree, level, digest) and the first steps of all nodes below them.
    """
    nodes, tops, steps, level = first, [], [], 0
    for level in range(height + 1):
        tops.append(nodes.where("n = 1").select("tree", F.lit(level).alias("level"), "digest"))
        if level == height:
            break
        runs = _grouped(nodes.where("n > 1"), F.col("n").alias("n")).withColumn("digest", digest(joined(F.transform("nodes", lambda x: x["digest"]))))
        runs = staged(runs, f"{name}-{level}")
        steps.append(_steps(runs, level))
        n = F.ceil(F.col("nodes")[0]["n"] / FAN).alias("n")
        nodes = runs.select("tree", F.col("run").alias("idx"), n, "digest")
    every = tops[0]
    for t in tops[1:]:
        every = every.unionByName(t)
    all_steps = None
    for s in steps:
        all_steps = s if all_steps is None else all_steps.unionByName(s)
    return every, all_steps


def _jumped(steps: DataFrame, height: int) -> DataFrame:
    """The whole path to the root of every node, by doubling the distance."""
    at = staged(steps, "steps")
    reach = 1
    while reach < height:
        up = at.select(
            F.col("tree").alias("to_tree"), F.col("level").alias("to_level"), F.col("idx").alias("to_idx"),
            F.col("to_tree").alias("_tree"), F.col("to_level").alias("_level"), F.col("to_idx").alias("_idx"), F.col("path").alias("_path"),
        )
        more = at.join(up, ["to_tree", "to_level", "to_idx"], "left")
        hop = F.col("_path").isNotNull()
        at = staged(
            more.select(
                "tree", "level", "idx",
                *(F.when(hop, F.col(f"_{c}")).otherwise(F.col(f"to_{c}")).alias(f"to_{c}") for c in ("tree", "level", "idx")),
                F.when(hop, F.concat("path", "_path")).otherwise(F.col("path")).alias("path"),
            ),
            "jumped",
        )
        reach *= 2
    return at


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """Leaf, tops and proof of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    Returns doc_id, source, leaf, altered (a second leaf, the column ``altered`` of the row or null), path
    (an array of left, right, up, own: the digests beside the path, the parent's digest and whether the step
    is inside the source's tree), subroot and root. Rows of a source go by doc_id, nulls first, then by leaf;
    equal rows are leaves each. Null is a source of its own, before all others; null and empty text differ.
    Texts are read once and never shuffled, whatever their length. Other columns are ignored; an empty table
    gives an empty one.
    """
    prepare(docs.sparkSession)
    second = (altered if altered is not None else F.lit(None)).cast("string")
    rows = docs.select("doc_id", "source", leaf(*(F.col(c) for c in FIELDS)).alias("leaf"), second.alias("altered"), F.lit(1).cast("long").alias("idx"))
    rows = running(staged(rows, "leaves"), "source", ["doc_id", "leaf"], adds=["idx"], name="numbered")
    rows = rows.withColumn("idx", F.col("idx") - 1).withColumnRenamed("_number", "tree").withColumn("digest", F.col("leaf"))

    # Level 0 of all trees at once: the only pass over all rows.
    item = F.struct("idx", "digest", "doc_id", "source", "altered")
    bottom = rows.groupBy("tree", F.floor(F.col("idx") / FAN).alias("run")).agg(F.sort_array(F.collect_list(item)).alias("nodes"))
    bottom = staged(bottom, "bottom")
    sizes = bottom.groupBy("tree").agg(F.sum(F.size("nodes")).alias("leaves"), F.count(F.lit(1)).alias("n"))
    sizes = staged(sizes, "sizes")
    most = sizes.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("trees")).first()
    above, trees = _height(most["n"] or 0), most["trees"]

    digests = F.transform("nodes", lambda x: x["digest"])
    first = bottom.join(sizes, "tree").select(
        "tree", F.col("run").alias("idx"), "n", F.when(F.col("leaves") == 1, F.col("nodes")[0]["digest"]).otherwise(digest(joined(digests))).alias("digest")
    )
    first = staged(first, "first")
    tops, inside = _tree(first, above, "tree")
    tops = staged(tops, "tops")

    # The tree over the sources: its leaves are the tops, by the source's place.
    over = tops.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("n"), "digest")
    _, outside = _tree(over, _height(trees), "sources")
    steps = inside
    if outside is not None:
        # A source's top is a leaf of the other tree: its step starts at its own place.
        below = outside.where("level = 0").join(tops.select(F.col("tree").alias("idx"), F.col("tree").alias("_own"), F.col("level").alias("_top")), "idx")
        below = below.select(F.col("_own").alias("tree"), F.col("_top").alias("level"), F.lit(0).cast("long").alias("idx"), "to_tree", "to_level", "to_idx", "path")
        others = outside.where("level > 0").unionByName(below)
        steps = others if steps is None else steps.unionByName(others)
    height = above + _height(trees)
    runs = bottom.withColumnRenamed("run", "_run").join(first.select("tree", F.col("idx").alias("_run"), "digest"), ["tree", "_run"])
    if steps is not None:
        paths = _jumped(steps, height).where("level = 0 AND tree >= 0").select("tree", F.col("idx").alias("_run"), F.col("path").alias("_path"))
        runs = runs.join(paths, ["tree", "_run"], "left")
    else:
        runs = runs.withColumn("_path", F.lit(None).cast("array<struct<left:string,right:string,up:string,own:boolean>>"))

    # The leaves' own step; a lone leaf of a source is its top and has none.
    sole = (F.size("nodes") == 1) & (F.col("digest") == F.col("nodes")[0]["digest"])
    own = runs.select("tree", "digest", "nodes", sole.alias("_sole"), "_path", F.posexplode("nodes").alias("_place", "_leaf"))
    left = joined(F.transform(F.slice("nodes", F.lit(1), F.col("_place")), lambda x: x["digest"]))
    right = joined(F.transform(F.slice("nodes", F.col("_place") + 2, F.lit(FAN)), lambda x: x["digest"]))
    step = F.struct(left.alias("left"), right.alias("right"), F.col("digest").alias("up"), F.lit(True).alias("own"))
    shared = F.coalesce("_path", F.array().cast("array<struct<left:string,right:string,up:string,own:boolean>>"))
    path = F.when(F.col("_sole"), shared).otherwise(F.concat(F.array(step), shared))
    out = own.select("_leaf.doc_id", "_leaf.source", F.col("_leaf.digest").alias("leaf"), "_leaf.altered", path.alias("path"))
    inner = F.filter("path", lambda x: x["own"])
    return out.withColumns(
        {
            "subroot": F.when(F.size(inner) > 0, F.element_at(inner, -1)["up"]).otherwise(F.col("leaf")),
            "root": F.when(F.size("path") > 0, F.element_at("path", -1)["up"]).otherwise(F.col("leaf")),
        }
    )


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, start, lambda up, step: digest(step["left"], up, step["right"]))


def proof(path: Column) -> Column:
    """The digest of all siblings, from the leaf to the root."""
    return digest(joined(F.transform(path, lambda x: F.concat(x["left"], x["right"]))))


def verified(rows: DataFrame) -> DataFrame:
    """Rows of a manifest, checked against their root: the altered leaf, where there is one, and the original siblings."""
    start = F.coalesce("altered", "leaf")
    out = rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(start, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return verified(manifest(docs, tampered(docs)))


def _sql(levels: int = 5) -> str:
    """The manifest of up to ``FAN ** levels`` leaves a source, and as many sources, in SQL."""

    def value(column: str) -> str:
        text = f"CAST({column} AS VARCHAR)"
        return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"

    def one(text: str) -> str:
        return "sha256(" + " || ".join([*(value(c) for c in FIELDS[:-1]), value(text)]) + ")"

    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    parts = [
        f"""d AS (SELECT doc_id, source, {one("text")} AS leaf,
          CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {one(lower)} END AS altered FROM documents)""",
        "p AS (SELECT source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM d))",
        """l AS (SELECT d.*, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, altered) - 1 AS idx
          FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)""",
    ]

    def climb(name: str, start: str) -> str:
        parts.append(f"{name}0 AS ({start})")
        for k in range(levels):
            parts.append(
                f"""{name}{k + 1} AS (SELECT tree, idx // {FAN} AS idx, CASE WHEN any_value(n) = 1 THEN any_value(digest)
                  ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest, CAST(ceil(any_value(n) / {FAN}) AS BIGINT) AS n
                  FROM {name}{k} GROUP BY tree, idx // {FAN})"""
            )
            parts.append(
                f"""{name}s{k} AS (SELECT a.tree, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
                  coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r, any_value(a.n) > 1 AS real
                  FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.idx // {FAN} = b.idx // {FAN} GROUP BY a.tree, a.idx)"""
            )
        return f"{name}{levels}"

    top = climb("t", "SELECT tree, idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM l")
    root = climb("r", f"SELECT 0 AS tree, tree AS idx, digest, count(*) OVER () AS n FROM {top}")
    joins, proof_ = [], "''"
    for name, tree, place in (("t", "l.tree", "l.idx"), ("r", "0", "l.tree")):
        for k in range(levels):
            s = f"{name}s{k}"
            joins.append(f"JOIN {s} ON {s}.tree = {tree} AND {s}.idx = {place} // {FAN**k}")
            proof_ += f" || CASE WHEN {s}.real THEN {s}.l || {s}.r ELSE '' END"
    before = "f"
    parts.append(f"f AS (SELECT l.*, {proof_} AS proof, coalesce(altered, leaf) AS h FROM l {' '.join(joins)})")
    for name, tree, place in (("t", "f.tree", "f.idx"), ("r", "0", "f.tree")):
        for k in range(levels):
            s, now = f"{name}s{k}", f"{name}f{k}"
            parts.append(
                f"""{now} AS (SELECT f.* REPLACE (CASE WHEN {s}.real THEN sha256({s}.l || f.h || {s}.r) ELSE f.h END AS h)
                  FROM {before} f JOIN {s} ON {s}.tree = {tree} AND {s}.idx = {place} // {FAN**k})"""
            )
            before = now
    return f"""WITH {", ".join(f"{p.replace(' AS (', ' AS MATERIALIZED (', 1)}" for p in parts)}
SELECT doc_id, leaf, {top}.digest AS subroot, {root}.digest AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = {root}.digest AS verified
FROM {before} f JOIN {top} ON {top}.tree = f.tree CROSS JOIN {root}"""


ORACLE = _sql()
