"""Near-duplicate vectors: PCA-ordered tiled comparison.

Unit vectors are turned onto the principal axes of all vectors, so the leading dimensions hold most of
any product. What the other dimensions can add is at most the product of the two suffix norms; a pair is
dropped as soon as its product so far plus that bound is below the threshold. Pairs that stay to the
end are decided by the cosine in double precision of the vectors as given.

Equal vectors are one vector with a weight, so copies are never paired. Vectors are dealt to groups by a
tree over the leading dimensions (cut points from a bounded sample; a leaf that is too full is divided by
a hash), each group has a box, and only groups whose boxes are close enough meet. A group pair is one
unit of work of bounded size: tiles of both are multiplied, and what leaves the task is a count for each
vector and the edges of a spanning forest, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm.components import components, forest
from laurel.llm.tables import prepare, read, staged

THRESHOLD = 0.9
TILE = 1024
LEADING = (16, 32)  # dimensions after which pairs are dropped
BOX = 8  # leading dimensions of a group's box
GROUP_ROWS = (2048, 32_768)  # smallest and largest size of a group
MOST_GROUPS = 1 << 16  # beyond that groups grow
SAMPLE = 100_000  # vectors that the tree's cut points are taken from, at most (about)
SLACK = 1e-4  # single precision may be off by that in the leading dimensions


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of double precision; shorter vectors are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares must not overflow
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Axes (columns) of the second moments of all unit vectors; ``dims ** 2`` numbers reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            unit = _unit(_matrix(batch.column("vector"), dims))
            total += unit.T @ unit
        yield pa.RecordBatch.from_pydict({"place": np.arange(dims * dims), "value": total.ravel()})

    rows = vectors.select("vector").mapInArrow(moments, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(dims * dims)
    total[rows.column("place").to_numpy()] = rows.column("value").to_numpy()
    _, axes = np.linalg.eigh(total.reshape(dims, dims))
    return axes[:, ::-1]


def cut_points(sample: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each level the cut point of each node; level ``i`` cuts dimension ``i`` modulo the box."""
    node, cuts = np.zeros(len(sample), np.int64), []
    for level in range(depth):
        value = sample[:, level % sample.shape[1]]
        order = np.lexsort((value, node))
        edges = np.searchsorted(node[order], np.arange(2**level + 1))
        cut = np.zeros(2**level)
        some = edges[1:] > edges[:-1]
        cut[some] = value[order][(edges[:-1] + edges[1:])[some] // 2]
        cuts.append(cut)
        node = 2 * node + (value >= cut[node])
    return cuts


def leaf_of(box: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    node = np.zeros(len(box), np.int64)
    for level, cut in enumerate(cuts):
        node = 2 * node + (box[:, level % box.shape[1]] >= cut[node])
    return node


def _leaves(axes, cuts, dims: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = axes.value[:, :BOX]
        for batch in batches:
            box = _unit(_matrix(batch.column("vector"), dims)) @ lead
            columns = {n: batch.column(n) for n in batch.schema.names}
            more = {"leaf": leaf_of(box, cuts.value) if cuts else np.zeros(len(box), np.int64)}
            more["box"] = pa.FixedSizeListArray.from_arrays(pa.array(box.ravel()), box.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict(columns | more)

    return assign


def _partners(boxes, reach: float):
    """Which groups each group meets: those with at least its own number and a close box."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, low, high = boxes.value
        for batch in batches:
            for group in batch.column("group").to_pylist():
                own = int(np.searchsorted(names, group))
                gap = np.maximum(np.maximum(low[own:] - high[own], low[own] - high[own:]), 0)
                near = own + np.flatnonzero((gap * gap).sum(axis=1) <= reach)
                yield pa.RecordBatch.from_pydict({"group": np.full(len(near), group), "other": names[near]})

    return meet


def _joined(axes, dims: int, threshold: float):
    """Links between the vectors of two groups, or inside one."""

    def compare(table: pa.Table) -> pa.Table:
        x = _unit(_matrix(table.column("vector"), dims))
        side = table.column("side").to_numpy()
        weight = table.column("weight").to_numpy()
        turned = (x @ axes.value).astype(np.float32)
        lead = [min(k, dims) for k in LEADING if k < dims]
        rest = {k: np.sqrt((turned[:, k:] ** 2).sum(axis=1)) for k in lead}
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        within = not len(right)
        degree = np.zeros(len(x), np.int64)
        a_links, b_links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(left), TILE):
            i = left[at : at + TILE]
            for bt in range(at if within else 0, len(left if within else right), TILE):
                j = (left if within else right)[bt : bt + TILE]
                if lead:
                    k = lead[0]
                    bound = turned[i, :k] @ turned[j, :k].T
                    bound += np.outer(rest[k][i], rest[k][j])
                    a, b = np.nonzero(bound >= threshold - SLACK)
                    a, b = i[a], j[b]
                else:
                    a, b = np.repeat(i, len(j)), np.tile(j, len(i))
                if within and at == bt:
                    a, b = a[a < b], b[a < b]
                for k in lead[1:]:
                    so_far = np.einsum("ij,ij->i", turned[a, :k], turned[b, :k])
                    stay = so_far + rest[k][a] * rest[k][b] >= threshold - SLACK
                    a, b = a[stay], b[stay]
                linked = np.concatenate(
                    [np.einsum("ij,ij->i", x[a[p : p + 65536]], x[b[p : p + 65536]]) >= threshold for p in range(0, len(a), 65536)]
                    or [np.zeros(0, bool)]
                )
                a, b = a[linked], b[linked]
                np.add.at(degree, a, weight[b])
                np.add.at(degree, b, weight[a])
                near = np.unique(np.concatenate([a, b]))
                root = near[forest(np.searchsorted(near, a), np.searchsorted(near, b), len(near))] if len(near) else near
                a_links.append(near[near != root])
                b_links.append(root[near != root])
        ids = table.column("vec_id").to_numpy()
        a, b = np.concatenate(a_links), np.concatenate(b_links)
        own = np.flatnonzero(degree)
        return pa.table(
            {
                "a": np.concatenate([ids[own], ids[a]]),
                "b": np.concatenate([ids[own], ids[b]]),
                "n": np.concatenate([degree[own], np.zeros(len(a), np.int64)]),
            }
        )

    return compare


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links of ``vectors`` (vec_id long, embedding array) with a cosine of at least ``threshold`` (over 0).

    Returns a row for each row: vec_id, n_links (other rows linked directly), component_id (smallest
    vec_id that links reach) and kept. Vectors that are null, zero, empty or hold null or non-finite
    components link with nothing, and so do rows without an id (their component is null, they are not
    kept). Vectors of fewer dimensions are filled up with zeros. Equal vectors are linked; repeated rows
    are rows of their own. Other columns are ignored. An empty table gives none.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select("vec_id", F.col("embedding").alias("vector"))
    good = usable(F.col("vector")) & F.col("vec_id").isNotNull()
    keys = [F.when(good, F.xxhash64("vector")).alias("h1"), F.when(good, F.xxhash64(F.reverse("vector"), F.lit(7))).alias("h2")]
    rows = staged(rows.select("vec_id", "vector", *keys), "vectors")
    slim = rows.select("vec_id", "h1", "h2")
    first = slim.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    first = staged(first, "classes")
    of_rep = rows.withColumnRenamed("vec_id", "_id").join(first, ["h1", "h2"]).where("_id = rep").dropDuplicates(["h1", "h2"])
    different = staged(of_rep.select(F.col("rep").alias("vec_id"), "vector", "weight"), "different")
    size = different.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims")).first()
    count, dims = size.n, size.dims or 0
    if count:
        found = _links(spark, different, count, dims, threshold)
    else:
        found = spark.createDataFrame([], "a long, b long, n long")
    degree = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("_n"))
    reached = components(found.where("n = 0").select("a", "b")).select(F.col("id").alias("rep"), "component")
    # One vec_id may stand for different vectors; then its links are those of all of them.
    classes = first.join(degree, "rep", "left").join(reached, "rep", "left")
    classes = classes.select("h1", "h2", (F.coalesce("_n", F.lit(0)) + F.col("weight") - 1).alias("_links"), F.coalesce("component", "rep").alias("_component"))
    out = slim.join(classes, ["h1", "h2"], "left")
    component = F.coalesce("_component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _links(spark: SparkSession, different: DataFrame, count: int, dims: int, threshold: float) -> DataFrame:
    """a, b, n: with n a vector's (a) weighted links in one unit of work, without it an edge of a forest."""
    axes = principal_axes(different, dims)
    fewest, most = GROUP_ROWS
    goal = max(min(max(count // 12, fewest), most), count // MOST_GROUPS)
    depth = max(0, int(np.ceil(np.log2(max(1, count / goal)))))
    cuts = None
    if depth:
        share = min(1.0, SAMPLE / count)
        chosen = different.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        sample = chosen.select("vector").toArrow().column("vector")
        cuts = spark.sparkContext.broadcast(cut_points(_unit(_matrix(sample, dims)) @ axes[:, :BOX], depth))
    axes = spark.sparkContext.broadcast(axes)
    kind = different.schema["vector"].dataType.simpleString()
    fields = f"vec_id long, vector {kind}, weight long, leaf long, box array<double>"
    assigned = different.mapInArrow(_leaves(axes, cuts, dims), fields)
    assigned = staged(assigned, "leaves")
    parts = assigned.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * goal)).alias("parts"))
    grouped = assigned.join(parts, "leaf").withColumn("group", F.col("leaf") * (1 << 20) + F.pmod(F.xxhash64("vec_id", F.lit(3)), "parts"))
    grouped = staged(grouped.select("vec_id", "vector", "weight", "group", "box"), "groups")
    lead = min(BOX, dims)
    edges = grouped.groupBy("group").agg(
        *[f(F.col("box")[d]).alias(f"{n}{d}") for d in range(lead) for n, f in (("low", F.min), ("high", F.max))]
    )
    table = edges.orderBy("group").toArrow()  # a row for each group, of which there are at most about MOST_GROUPS
    low, high = (np.column_stack([table.column(f"{n}{d}").to_numpy() for d in range(lead)]) for n in ("low", "high"))
    boxes = spark.sparkContext.broadcast((table.column("group").to_numpy(), low, high))
    reach = 2 - 2 * threshold + SLACK
    met = edges.select("group").mapInArrow(_partners(boxes, reach), "group long, other long")
    met = staged(met.withColumn("pair", F.concat_ws("-", "group", "other")), "pairs")
    sides = met.select("pair", "group", F.lit(0).alias("side")).unionByName(
        met.where("group <> other").select("pair", F.col("other").alias("group"), F.lit(1).alias("side"))
    )
    work = grouped.join(sides, "group").select("pair", "side", "vec_id", "vector", "weight")
    return staged(work.groupBy("pair").applyInArrow(_joined(axes, dims, threshold), "a long, b long, n long"), "found")


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
