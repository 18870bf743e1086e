"""Problem 2: the k most similar vectors of every vector, by NN-descent on Spark joins.

Equal vectors are one node, so that a vector held by a third of all rows is still one node. A graph of
`width` neighbours a node starts from random groups and random-projection leaves: hyperplanes fitted on
a sample of SAMPLE vectors put every vector into one leaf per tree, and leaves over 2 LEAF rows are cut into
slabs along one more direction; in these the nearest are found by comparing all. Each round then
joins neighbours of neighbours: every node gathers the vectors of the nodes it points to and of those
that point to it, compares all of them that are not yet known to each other (one of the two is new),
and sends each the candidates that would enter its list. Rounds end when under `settled` of the list
places change. The gathering of a hub, which more than HUB nodes point to, is cut into chunks of which every
pair is a gathering, so that no row and no distance matrix grows with it. A round's graph is removed when the
next is written.

`search` answers queries that need not be in the graph: it walks greedily from nodes of the query's
leaves to the neighbours of the best nodes seen, all queries in step, one join a round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.session import Scratch

LEAF = 128
HUB = 256
SAMPLE = 100_000
PLACED = "id bigint, vec array<float>, cells array<bigint>, slant array<float>"
NODE = "id bigint, vec array<float>, ids array<bigint>, ds array<float>, new array<boolean>"


def usable_vectors(df: DataFrame, key: str, vec: str, dim: int | None, latest: str | None = None) -> DataFrame:
    """(id, v): the current vector of each key, without those of another length than dim (None: any), with a
    null, NaN or infinite value, or all zero. Null keys are left out."""
    value = F.max_by(vec, latest) if latest else F.min(vec)
    rows = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(value.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    size = F.size("v") == dim if dim else F.size("v") > 0
    return rows.where(F.col("v").isNotNull() & size).where(fine).withColumn("v", F.transform("v", lambda x: x.cast("double")))


def distinct_vectors(rows: DataFrame, copies: int) -> DataFrame:
    """(id, v, same): one row per distinct vector with its smallest key and its `copies` smallest keys."""
    first = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= copies)
    return few.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("same")).select("id", "v", "same")


def _forest(sample: np.ndarray, rows: int, trees: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per tree random directions and the sample's median per level and cell, level after level: (depth, dim) and (2^depth - 1)."""
    depth = int(np.clip(np.ceil(np.log2(max(2, rows / (LEAF * 0.7)))), 1, np.log2(max(4, len(sample) / 8))))
    rng, forest = np.random.default_rng(seed), []
    for _ in range(trees):
        planes = rng.normal(size=(depth + 1, sample.shape[1]))
        cuts, cell = np.zeros((1 << depth) - 1), np.zeros(len(sample), np.int64)
        for level in range(depth):
            at, base = sample @ planes[level], (1 << level) - 1
            order = np.argsort(cell, kind="stable")
            names, starts = np.unique(cell[order], return_index=True)
            for name, part in zip(names, np.split(at[order], starts[1:]), strict=True):
                cuts[base + name] = np.median(part)
            cell = cell * 2 + (at > cuts[base + cell])
        forest.append((planes, cuts))
    return forest


def _placing(forest: list[tuple[np.ndarray, np.ndarray]], total: int):
    """Per (id, v) its single-precision vector, its leaf in every tree and its place along the tree's last direction, the last
    tree being random groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"))
            cells = np.zeros((len(v), len(forest) + 1), np.int64)
            mixed = batch.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            slant = np.zeros(cells.shape, np.float32)
            cells[:, -1] = (mixed >> np.uint64(20)) % np.uint64(max(1, total // LEAF))
            for t, (planes, cuts) in enumerate(forest):
                at = v @ planes.T if len(v) else np.zeros((0, len(planes)))
                for level in range(len(planes) - 1):
                    cells[:, t] = cells[:, t] * 2 + (at[:, level] > cuts[(1 << level) - 1 + cells[:, t]])
                slant[:, t] = at[:, -1]
            offsets = pa.array(np.arange(len(v) + 1) * cells.shape[1], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (cells, slant)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v").cast(pa.list_(pa.float32())), *lists], names=["id", "vec", "cells", "slant"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _lists(rows: np.ndarray, n: int, *columns: np.ndarray) -> list[pa.Array]:
    """List arrays of n rows from columns sorted by row number."""
    offsets = pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]


def _nearest(owner: np.ndarray, other: np.ndarray, d: np.ndarray, k: int, new: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The k smallest distances per owner, each other once (known before it is new), by distance and id."""
    fresh = np.zeros(len(owner), bool) if new is None else new
    order = np.lexsort((fresh, other, owner))
    owner, other, d, fresh = owner[order], other[order], d[order], fresh[order]
    once = np.ones(len(owner), bool)
    once[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, d, fresh = owner[once], other[once], d[once], fresh[once]
    order = np.lexsort((other, d, owner))
    owner, other, d, fresh = owner[order], other[order], d[order], fresh[order]
    begin = np.searchsorted(owner, owner, side="left")
    kept = np.arange(len(owner)) - begin < k
    return owner[kept], other[kept], d[kept], fresh[kept]


def _local_join(k: int):
    """At each gathering (ids, vecs, far, new): candidates per member, nearer than the farthest it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("m")
            sizes = np.diff(members.offsets.to_numpy())
            flat = members.flatten()
            ids = flat.field("id").to_numpy(zero_copy_only=False)
            far = flat.field("far").to_numpy(zero_copy_only=False)
            new = flat.field("new").to_numpy(zero_copy_only=False)
            vecs = _matrix(flat.field("vec")).astype(np.float32)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            order = np.argsort(sizes, kind="stable")
            at = 0
            while at < len(order):
                wide = int(sizes[order[at]])
                end = at + 1
                while end < len(order) and sizes[order[end]] <= max(8, wide * 1.25) and (end - at) * sizes[order[end]] ** 2 < 2_000_000:
                    end += 1
                some = order[at:end]
                wide = int(sizes[some].max())
                at = end
                slot = np.arange(wide)
                there = slot[None, :] < sizes[some][:, None]
                index = np.where(there, starts[some][:, None] + slot[None, :], starts[some][:, None])
                x = vecs[index]
                x = x - x.mean(axis=1, keepdims=True)
                norm = (x * x).sum(axis=2)
                d = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
                np.maximum(d, 0, out=d)
                fresh = new[index]
                take = there[:, :, None] & there[:, None, :] & (fresh[:, :, None] | fresh[:, None, :])
                take &= d < far[index][:, :, None]
                take[:, slot, slot] = False
                g, i, j = np.nonzero(take)
                if not len(g):
                    continue
                owner, other = ids[index[g, i]], ids[index[g, j]]
                real = owner != other
                group = (g * wide + i)[real]
                row, o, dist, _ = _nearest(group, other[real], d[g, i, j][real], k)
                names, where = np.unique(row, return_index=True)
                cells = np.concatenate((where, [len(row)]))
                offsets = pa.array(cells, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[index[names // wide, names % wide]]), pa.ListArray.from_arrays(offsets, pa.array(o)), pa.ListArray.from_arrays(offsets, pa.array(dist.astype(np.float32)))],
                    names=["id", "ids", "ds"],
                )

    return run


def _merge(k: int):
    """Keeps of each node's old list and candidates the k nearest; entries the old list lacks are new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            offsets = batch.column("ids").offsets.to_numpy()
            owner = np.repeat(np.arange(n), np.diff(offsets))
            flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "ds", "new")]
            o, ids, ds, new = _nearest(owner, flat[0], flat[1], k, flat[2].astype(bool))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), *_lists(o, n, ids, ds.astype(np.float32), new)], names=["id", "vec", "ids", "ds", "new"])

    return run


def _lists_of(rows: DataFrame, k: int) -> DataFrame:
    flat = [F.flatten(F.collect_list(c)).alias(c) for c in ("ids", "ds", "new")]
    return rows.groupBy("id").agg(F.max("vec").alias("vec"), *flat).mapInArrow(_merge(k), NODE)


def _gatherings(graph: DataFrame) -> DataFrame:
    """(at, pair, id, new): the nodes that every node points to or is pointed to by, where one of them is new.

    Up to HUB of them are one gathering, with pair 0; more are dealt into chunks by hash, and every pair of chunks is one.
    """
    ways = graph.select("id", F.explode(F.arrays_zip("ids", "new")).alias("e")).select("id", F.col("e.ids").alias("to"), F.col("e.new").alias("new"))
    both = ways.select(F.col("id").alias("at"), F.col("to").alias("id"), "new").unionByName(ways.select(F.col("to").alias("at"), "id", "new"))
    here = Window.partitionBy("at")
    live = both.withColumn("live", F.max("new").over(here)).withColumn("c", F.ceil(F.count("*").over(here) / HUB)).where("live")
    own = F.pmod(F.xxhash64("id"), F.col("c"))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1), lambda o: F.least(o, F.col("own")) * F.col("c") + F.greatest(o, F.col("own")))
    return live.withColumn("own", own).select("at", F.explode(pairs).alias("pair"), "id", "new")


@dataclass(frozen=True)
class Index:
    """A neighbour graph (id, vec, ids, ds, new), the trees it started from and every vector's leaf in them."""

    graph: DataFrame
    forest: list[tuple[np.ndarray, np.ndarray]]
    placed: DataFrame | None
    total: int


def neighbour_graph(vectors: DataFrame, **how) -> DataFrame:
    """The graph of `build`."""
    return build(vectors, **how).graph


def build(vectors: DataFrame, *, width: int = 12, trees: int = 3, rounds: int = 60, settled: float = 0.002, seed: int = 7) -> Index:
    """The index of every (id, v) of distinct vectors: its graph has the `width` nearest found, with squared distances.

    An empty table gives no rows; a single vector has an empty list. A graph that has not settled after `rounds` raises.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    base = scratch.save(vectors.select("id", "v"), "vectors")
    total = base.count()
    if total == 0:
        lists = [F.expr(f"cast(array() as array<{t}>)").alias(c) for c, t in (("ids", "bigint"), ("ds", "float"), ("new", "boolean"))]
        return Index(base.select("id", F.expr("cast(null as array<float>)").alias("vec"), *lists), [], None, 0)
    drawn = base.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).select("v").toArrow()
    sample = _matrix(drawn.column(0))
    forest = _forest(sample, total, trees, seed)

    placed = scratch.save(base.mapInArrow(_placing(forest, total), PLACED), "placed")
    planted = placed.select("id", "vec", F.posexplode(F.arrays_zip("cells", "slant")).alias("tree", "c")).select("id", "vec", "tree", F.col("c.cells").alias("leaf"), F.col("c.slant").alias("slant"))
    size = F.count("*").over(Window.partitionBy("tree", "leaf"))
    rank = F.row_number().over(Window.partitionBy("tree", "leaf").orderBy("slant", "id"))
    slab = F.floor((rank - 1) / F.ceil(size / F.ceil(size / (2 * LEAF))))
    member = F.struct("id", "vec", F.lit(float("inf")).cast("float").alias("far"), F.lit(True).alias("new"))
    start = planted.withColumn("slab", slab).groupBy("tree", "leaf", "slab").agg(F.collect_list(member).alias("m"))
    found = start.select("m").mapInArrow(_local_join(width), "id bigint, ids array<bigint>, ds array<float>")
    none = F.expr("cast(null as array<float>)")
    first = found.withColumn("vec", none).withColumn("new", F.transform("ids", lambda _: F.lit(True)))
    empty = [F.expr(f"cast(array() as array<{t}>)").alias(c) for c, t in (("ids", "bigint"), ("ds", "float"), ("new", "boolean"))]
    graph = scratch.save(_lists_of(first.unionByName(placed.select("id", "vec", *empty)), width), "graph")
    for _ in range(rounds):
        asked = _gatherings(graph)
        far = F.when(F.size("ds") >= width, F.element_at("ds", -1)).otherwise(F.lit(float("inf")).cast("float"))
        sent = asked.join(graph.select("id", "vec", far.alias("far")), "id")
        gathered = sent.groupBy("at", "pair").agg(F.collect_list(F.struct("id", "vec", "far", "new")).alias("m"))
        found = gathered.select("m").mapInArrow(_local_join(width), "id bigint, ids array<bigint>, ds array<float>")
        fresh = found.withColumn("vec", none).withColumn("new", F.transform("ids", lambda _: F.lit(True)))
        known = graph.withColumn("new", F.transform("ids", lambda _: F.lit(False)))
        graph = scratch.renew(_lists_of(fresh.unionByName(known), width), "graph")
        changed = graph.select(F.sum(F.size(F.filter("new", lambda x: x)))).first()[0] or 0
        if changed <= settled * width * total:
            break
    else:
        raise RuntimeError(f"the neighbour graph has not settled after {rounds} rounds")
    scratch.drop(scratch.last["vectors"])
    return Index(graph, forest, placed, total)


def nearest(vectors: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """(id, near): for every distinct vector its k + 1 nearest keys, its own among them, as array<struct<d2, id>>.

    vectors: (id, v, same) of distinct_vectors. Distances are squared and in double; equal ones go to the smaller key.
    """
    links = graph.select("id", F.explode(F.slice("ids", 1, 2 * k)).alias("to"))
    there = vectors.select(F.col("id").alias("to"), F.col("v").alias("w"), F.col("same").alias("keys"))
    sent = links.join(there, "to").groupBy("id").agg(F.collect_list(F.struct("w", "keys")).alias("m"))
    gap = lambda m: F.aggregate(F.zip_with("v", m.w, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    others = F.flatten(F.transform(F.col("m"), lambda m: F.transform(m["keys"], lambda c: F.struct(gap(m).alias("d2"), c.alias("id")))))
    own = F.transform("same", lambda c: F.struct(F.lit(0.0).alias("d2"), c.alias("id")))
    every = F.concat(own, F.coalesce(others, F.expr("cast(array() as array<struct<d2: double, id: bigint>>)")))
    return vectors.join(sent, "id", "left").select("id", F.slice(F.sort_array(every), 1, k + 1).alias("near"))


def knn(rows: DataFrame, k: int, **how) -> DataFrame:
    """(id, place, other, d2): the k nearest found of every (id, v), by distance and id; fewer where there are fewer rows."""
    scratch = Scratch(rows.sparkSession, "knn")
    rows = scratch.save(rows.select("id", "v"), "rows")
    vectors = scratch.save(distinct_vectors(rows, k + 1), "distinct")
    near = nearest(vectors, neighbour_graph(vectors, **how), k)
    owners = vectors.select(F.col("id").alias("rep"), "v").join(rows.withColumnRenamed("id", "own"), "v").select("own", F.col("rep").alias("id"))
    mine = F.slice(F.filter("near", lambda x: x.id != F.col("own")), 1, k)
    out = owners.join(near, "id").select("own", F.posexplode(mine).alias("place", "x"))
    return out.select(F.col("own").alias("id"), (F.col("place") + 1).alias("place"), F.col("x.id").alias("other"), F.col("x.d2").alias("d2"))


def search(queries: DataFrame, index: Index, k: int, *, beam: int = 24, expand: int = 4, entries: int = 32, rounds: int = 400, seed: int = 11) -> DataFrame:
    """(id, place, other, d2): for every query (id, v) the k nearest nodes that a greedy walk over the graph finds.

    A walk starts from up to `entries` nodes of the query's leaf in every tree, keeps its `beam` best, and each round
    looks at the nodes that its `expand` best unopened ones list or are listed by, until none is left to open; walks that
    go on after `rounds` rounds raise. Distances are those of single-precision vectors. An empty index gives no rows.
    """
    spark = queries.sparkSession
    scratch = Scratch(spark, "search")
    if index.placed is None:
        return queries.select("id", F.lit(0).alias("place"), F.lit(0).cast("bigint").alias("other"), F.lit(0.0).alias("d2")).limit(0)
    ways = index.graph.select("id", F.explode("ids").alias("to"))
    sides = ways.unionByName(ways.select(F.col("to").alias("id"), F.col("id").alias("to")))
    nodes = scratch.save(index.graph.select(F.col("id").alias("node"), "vec").join(sides.groupBy(F.col("id").alias("node")).agg(F.collect_set("to").alias("ids")), "node", "left"), "nodes")
    some = Window.partitionBy("tree", "leaf").orderBy(F.xxhash64(F.lit(seed), "node"), "node")
    leaves = index.placed.select(F.col("id").alias("node"), "vec", F.posexplode("cells").alias("tree", "leaf"))
    doors = leaves.withColumn("n", F.row_number().over(some)).where(F.col("n") <= entries).drop("n")
    walk = scratch.save(queries.mapInArrow(_placing(index.forest, index.total), PLACED).withColumnRenamed("vec", "q"), "queries")
    gap = F.aggregate(F.zip_with("q", "vec", lambda a, b: ((a - b) * (a - b)).cast("double")), F.lit(0.0), lambda s, x: s + x)
    seen = F.collect_set(F.struct(gap.alias("d2"), F.col("node").alias("id"), F.lit(False).alias("open")))
    begun = walk.select("id", "q", F.posexplode("cells").alias("tree", "leaf")).join(doors, ["tree", "leaf"]).groupBy("id").agg(F.first("q").alias("q"), seen.alias("best"))
    state = scratch.save(begun.select("id", "q", F.slice(F.sort_array("best"), 1, beam).alias("best")), "state")
    none = F.expr("cast(array() as array<bigint>)")
    for _ in range(rounds):
        nexts = F.transform(F.slice(F.filter("best", lambda x: ~x.open), 1, expand), lambda x: x.id)
        going = state.withColumn("nexts", nexts).where(F.size("nexts") > 0)
        steps = going.select("id", F.explode("nexts").alias("node")).join(nodes.select("node", "ids"), "node").select("id", F.explode("ids").alias("node")).distinct()
        met = steps.join(going.select("id", "q"), "id").join(nodes.select("node", "vec"), "node").groupBy("id").agg(seen.alias("met"))
        known = F.transform("best", lambda x: x.id)
        opened = F.transform("best", lambda x: F.struct(x.d2.alias("d2"), x.id.alias("id"), (x.open | F.array_contains(F.coalesce("nexts", none), x.id)).alias("open")))
        fresh = F.filter(F.coalesce("met", F.expr("cast(array() as array<struct<d2: double, id: bigint, open: boolean>>)")), lambda x: ~F.array_contains(known, x.id))
        joined = state.join(going.select("id", "nexts"), "id", "left").join(met, "id", "left")
        state = scratch.renew(joined.select("id", "q", F.slice(F.sort_array(F.concat(opened, fresh)), 1, beam).alias("best")), "state")
        if state.where(F.exists("best", lambda x: ~x.open)).isEmpty():
            break
    else:
        raise RuntimeError(f"walks are still open after {rounds} rounds")
    out = state.select("id", F.posexplode(F.slice("best", 1, k)).alias("place", "x"))
    return out.select("id", (F.col("place") + 1).alias("place"), F.col("x.id").alias("other"), F.col("x.d2").alias("d2"))
