"""Problem 5: groups of mutually similar records, by reciprocal-nearest-neighbour average linkage.

Records with equal label lists are one node. Two nodes are alike if their labels agree in a share of the
runs in which both have one. The sparse graph is made in two steps, so that no block of nodes is compared in
full. `near_links`: nodes that agree on all but LEFT_OUT of the runs are alike whatever else they hold, so each
combination of so many runs is a key, and every node gets a link to the smallest with the same key; tasks do
this among their own rows first, so that a key a third of all nodes share gives one row a batch. Linkage over
these links gives the cores of the groups. `far_links`: candidates share a block key; if the runs are dealt into
so many blocks that the disagreements and gaps allowed cannot touch all of them, two alike nodes agree on a whole
block (nodes with more gaps than that allows meet over single labels). In a block only the nodes outside its
largest core are compared, with the nodes of other cores, in chunks; of two cores the best link is kept. No link
that joins two groups is lost.

The linkage runs in rounds over a sparse graph: every cluster knows its best partner by average similarity,
all mutual best pairs merge at once, and sums and counts of the links between merged clusters are added. It
stops when no average reaches the threshold. In problem 5 groups are formed by being alike, directly or by way of
others, so links below the threshold are left out there and averages over the links never fall below it: the
averages set the order of merges, not the groups. Given all links, or averaged over all pairs, they do stop merges.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.session import Scratch

CHUNK = 1024
GAPS = 2
LEFT_OUT = 2
NONE = -(2**31)


def blocks(runs: int, percent: int) -> int:
    """So many blocks that alike lists with up to GAPS gaps each agree on all runs of at least one."""
    both = max(1, runs - 2 * GAPS)
    return min(runs, runs - math.ceil(percent * both / 100) + 1)


def label_lists(rows: DataFrame, scope: str, record: str, run: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (scope, node, labels, n) and members (record, scope, node).

    rows: (scope, record, run, label); labels mean nothing across runs. A record with several labels in a run
    has the smallest; records without any label are left out. A node is named by its smallest record.
    """
    named = rows.where(F.col(label).isNotNull() & F.col(record).isNotNull())
    order = named.select(scope, run).distinct().withColumn("_at", F.row_number().over(Window.partitionBy(scope).orderBy(run)) - 1)
    width = order.groupBy(scope).agg(F.count("*").cast("int").alias("_runs"))
    single = named.groupBy(scope, record, run).agg(F.min(label).cast("int").alias("_l"))
    pairs = single.join(order, [scope, run]).groupBy(scope, record).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_l"))).alias("_m"))
    labels = F.transform(F.sequence(F.lit(0), F.col("_runs") - 1), lambda i: F.try_element_at("_m", i))
    lists = Scratch(rows.sparkSession, "labels").save(pairs.join(width, scope).select(F.col(scope).alias("scope"), F.col(record).alias("record"), labels.alias("labels")), "lists")
    nodes = lists.groupBy("scope", "labels").agg(F.min("record").alias("node"), F.count("*").alias("n"))
    return nodes.select("scope", "node", "labels", "n"), lists.join(nodes.drop("n"), ["scope", "labels"]).select("record", "scope", "node")


def _tables(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The batch's (scope, node, labels) rows by scope: its name, nodes and label matrix."""
    scopes = np.array([s if s is not None else "" for s in batch.column("scope").to_pylist()], object)
    nodes, lists = batch.column("node").to_numpy(zero_copy_only=False), batch.column("labels")
    ends = lists.offsets.to_numpy()
    values = lists.flatten().fill_null(NONE).to_numpy(zero_copy_only=False).astype(np.int64)
    base = ends[0]
    for scope in dict.fromkeys(scopes.tolist()):
        at = np.flatnonzero(scopes == scope)
        width = int(ends[at[0] + 1] - ends[at[0]])
        yield scope, nodes[at], values[(ends[at] - base)[:, None] + np.arange(width)]


def _keyed(percent: int):
    """Keys of all combinations of runs with their smallest node in the batch, and links of its other nodes to that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for scope, nodes, x in _tables(batch):
                order = np.argsort(nodes, kind="stable")
                nodes, x = nodes[order], x[order]
                width = x.shape[1]
                keep = max(math.ceil(percent * width / 100), width - LEFT_OUT, 1)
                with np.errstate(over="ignore"):
                    mixed = (x.view(np.uint64) + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
                keys, tops, links = [], [], []
                for number, chosen in enumerate(itertools.combinations(range(width), keep)):
                    whole = np.flatnonzero((x[:, chosen] != NONE).all(axis=1))
                    if not len(whole):
                        continue
                    with np.errstate(over="ignore"):
                        key = mixed[np.ix_(whole, chosen)].sum(axis=1, dtype=np.uint64) + np.uint64(number) * np.uint64(0x27D4EB2F165667C5)
                    found, first, inverse = np.unique(key, return_index=True, return_inverse=True)
                    top = whole[first]
                    keys.append(found.view(np.int64))
                    tops.append(nodes[top])
                    other = top[inverse.ravel()] != whole
                    links.append(top[inverse.ravel()][other] * len(nodes) + whole[other])
                if not keys:
                    continue
                pairs = np.unique(np.concatenate(links))
                key, top = np.concatenate(keys), np.concatenate(tops)
                columns = [pa.array([scope] * (len(key) + len(pairs)), pa.string()), pa.concat_arrays([pa.array(key), pa.nulls(len(pairs), pa.int64())])]
                columns += [pa.array(np.concatenate((top, nodes[pairs // len(nodes)]))), pa.array(np.concatenate((top, nodes[pairs % len(nodes)])))]
                yield pa.RecordBatch.from_arrays(columns, names=["scope", "key", "a", "b"])

    return run


def _alike(nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(scope, a, b, like) of the pairs (scope, a, b) that are alike."""
    side = lambda c, v: nodes.select("scope", F.col("node").alias(c), F.col("labels").alias(v))
    both = pairs.join(side("a", "x"), ["scope", "a"]).join(side("b", "y"), ["scope", "b"])
    flags = F.zip_with("x", "y", lambda x, y: F.when(x.isNotNull() & y.isNotNull(), (x == y).cast("int")))
    common = F.filter(flags, lambda f: f.isNotNull())
    counted = both.select("scope", "a", "b", F.size(common).alias("c"), F.aggregate(common, F.lit(0), lambda s, f: s + f).alias("m"))
    return counted.where((F.col("c") > 0) & (F.col("m") * 100 >= percent * F.col("c"))).select("scope", "a", "b", (F.col("m") / F.col("c")).alias("like"))


def near_links(nodes: DataFrame, percent: int) -> DataFrame:
    """(scope, a, b, like), a < b: of nodes that agree on all but LEFT_OUT runs a link to the smallest node each agrees with so."""
    found = Scratch(nodes.sparkSession, "near").save(nodes.select("scope", "node", "labels").mapInArrow(_keyed(percent), "scope string, key bigint, a bigint, b bigint"), "keys")
    across = found.where("key is not null").withColumn("top", F.min("a").over(Window.partitionBy("scope", "key"))).where("top < a")
    pairs = found.where("key is null").select("scope", "a", "b").unionByName(across.select("scope", F.col("top").alias("a"), F.col("a").alias("b"))).distinct()
    return _alike(nodes, pairs, percent)


def _compared(percent: int):
    """Per task the best link of every pair of cores between an asking node and a node of another core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scopes, members = batch.column("scope").to_pylist(), batch.column("m")
            sizes = np.diff(members.offsets.to_numpy())
            flat = members.flatten()
            cores = flat.field("core").to_numpy(zero_copy_only=False)
            asking = flat.field("ask").to_numpy(zero_copy_only=False).astype(bool)
            lists = flat.field("labels")
            widths = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().fill_null(NONE).to_numpy(zero_copy_only=False)
            best: dict[tuple, float] = {}
            at, cell = 0, 0
            for scope, size in zip(scopes, sizes, strict=True):
                width = int(widths[at]) if size else 0
                x = values[cell : cell + size * width].reshape(size, width)
                core, ask = cores[at : at + size], asking[at : at + size]
                at, cell = at + size, cell + size * width
                there, owner = x[~ask], core[~ask]
                has = there != NONE
                for i in np.flatnonzero(ask):
                    common = has[:, x[i] != NONE].sum(axis=1)
                    match = (has & (there == x[i])).sum(axis=1)
                    fine = np.flatnonzero((100 * match >= percent * common) & (common > 0) & (owner != core[i]))
                    for j in fine:
                        pair = (scope, *sorted((int(core[i]), int(owner[j]))))
                        best[pair] = max(best.get(pair, 0.0), match[j] / common[j])
            rows = [(*pair, float(like)) for pair, like in best.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["scope", "a", "b", "like"])

    return run


def far_links(nodes: DataFrame, percent: int) -> DataFrame:
    """(scope, a, b, like), a < b: the best link between every two cores that alike nodes of theirs join, blocks given.

    nodes: (scope, node, labels, core).
    """
    spark = nodes.sparkSession
    widths = [r[0] for r in nodes.select(F.size("labels")).distinct().collect()]
    deal = F.lit(1)
    for runs in widths:
        deal = F.when(F.size("labels") == runs, F.lit(blocks(runs, percent))).otherwise(deal)
    thin = F.size(F.filter("labels", lambda x: x.isNull())) > GAPS
    dealt = nodes.select("scope", "node", "labels", "core").withColumn("q", deal).withColumn("thin", thin)
    part = lambda b: F.filter("labels", lambda _, i: i % F.col("q") == b)
    keys = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda b: F.struct(b.alias("block"), part(b).alias("key")))
    whole = dealt.select("scope", "node", "labels", "core", F.explode(F.filter(keys, lambda k: F.forall(k.key, lambda x: x.isNotNull()))).alias("k"))
    whole = whole.select("scope", F.col("k.block").alias("block"), F.xxhash64("k.key").alias("key"), "node", "labels", "core", F.lit(False).alias("thin"))
    token = dealt.select("scope", F.posexplode("labels").alias("at", "label"), "node", "labels", "core", "thin").where("label is not null")
    token = token.select("scope", (-1 - F.col("at")).alias("block"), F.xxhash64("label").alias("key"), "node", "labels", "core", "thin")
    block = ["scope", "block", "key"]
    asked = token.where("thin").select(*block).distinct()
    every = whole.unionByName(token.join(asked, block, "left_semi"))
    counts = every.groupBy(*block, "core").agg(F.count("*").alias("n"), F.count_if("thin").alias("thin_n"))
    sizes = counts.groupBy(*block).agg(F.count("*").alias("cores"), F.sum("n").alias("m"), F.max("n").alias("top_n"), F.max_by("core", F.struct("n", "core")).alias("top"), F.sum("thin_n").alias("t")).where("cores > 1")
    asks = F.when(F.col("block") < 0, F.col("t")).otherwise(F.col("m") - F.col("top_n"))
    grid = sizes.select(*block, "top", F.ceil(F.col("m") / CHUNK).alias("c"), F.greatest(F.lit(1), F.ceil(asks / CHUNK)).alias("r"))
    met = every.join(grid, block)
    ask = F.when(F.col("block") < 0, F.col("thin")).otherwise(F.col("core") != F.col("top"))
    spread = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(parts))
    all_of = lambda parts: F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1)
    row = ["labels", "core"]
    there = met.select(*block, *row, F.lit(False).alias("ask"), F.explode(all_of("r")).alias("i"), spread(1, "c").alias("j"))
    here = met.where(ask).select(*block, *row, F.lit(True).alias("ask"), spread(2, "r").alias("i"), F.explode(all_of("c")).alias("j"))
    place = [*block, "i", "j"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    tasks = there.unionByName(here).repartition(parts, *place).groupBy(*place).agg(F.collect_list(F.struct(*row, "ask")).alias("m"))
    found = tasks.select("scope", "m").mapInArrow(_compared(percent), "scope string, a bigint, b bigint, like double")
    return found.groupBy("scope", "a", "b").agg(F.max("like").alias("like"))


def average_linkage(links: DataFrame, threshold: float, *, over: str = "links", step: float = 0.0, rounds: int = 500) -> DataFrame:
    """(scope, node, cluster) for every node with a link (scope, a, b, like) of at least the threshold.

    links: each pair once, a <> b; null and NaN likes are none. A cluster pair's average is that of the links
    between the two, those below the threshold among them, or with over="pairs" that of all their pairs of nodes, those
    without a link counting as 0. Of equal averages that of the smaller names goes first, so the result is that of merging
    the best pair at a time. With a `step` averages within it of each other count as equal and all merge in the same
    round, so that a hub does not take one partner a round; where averages can fall below the threshold this may merge
    more. Clusters are named by their smallest node. No links give no rows.
    """
    if over not in ("links", "pairs"):
        raise ValueError("over is links or pairs")
    scratch = Scratch(links.sparkSession, "linkage")
    edges = scratch.save(links.where(~F.isnan("like")).select("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("like").alias("s"), F.lit(1).cast("long").alias("w")), "edges")
    ends = lambda df: df.select("scope", F.explode(F.array("a", "b")).alias("node")).distinct()
    sizes = scratch.save(ends(edges).withColumn("n", F.lit(1).cast("long")), "sizes")
    start = scratch.save(ends(edges.where(F.col("s") >= threshold)), "start")
    steps: list[DataFrame] = []
    for _ in range(rounds):
        if over == "links":
            rated = edges.withColumn("avg", F.col("s") / F.col("w"))
        else:
            size = lambda c: sizes.select("scope", F.col("node").alias(c), F.col("n").alias(f"n_{c}"))  # noqa: E731, B023
            rated = edges.join(size("a"), ["scope", "a"]).join(size("b"), ["scope", "b"]).withColumn("avg", F.col("s") / (F.col("n_a") * F.col("n_b")))
        open_ = scratch.renew(rated.where(F.col("avg") >= threshold).select("scope", "a", "b", "avg"), "open")
        if open_.isEmpty():
            break
        moved = scratch.save(_steps(scratch, open_, step) if step else _mutual(open_), "moved")
        steps.append(moved)
        of = lambda side: moved.select("scope", F.col("x").alias(side), F.col("to").alias(f"{side}_to"))  # noqa: E731, B023
        joined = edges.join(of("a"), ["scope", "a"], "left").join(of("b"), ["scope", "b"], "left")
        both = joined.select("scope", F.coalesce("a_to", "a").alias("p"), F.coalesce("b_to", "b").alias("q"), "s", "w").where("p <> q")
        edges = scratch.renew(both.groupBy("scope", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum("s").alias("s"), F.sum("w").alias("w")), "edges")
        if over == "pairs":
            grown = sizes.join(of("node"), ["scope", "node"], "left").select("scope", F.coalesce("node_to", "node").alias("node"), "n")
            sizes = scratch.renew(grown.groupBy("scope", "node").agg(F.sum("n").alias("n")), "sizes")
    else:
        raise RuntimeError(f"linkage unfinished after {rounds} rounds")
    out = start.withColumn("cluster", F.col("node"))
    for moved in steps:
        out = out.join(moved.select("scope", F.col("x").alias("cluster"), "to"), ["scope", "cluster"], "left").select("scope", "node", F.coalesce("to", "cluster").alias("cluster"))
    done = scratch.save(out, "clusters")
    scratch.drop(*(path for path in scratch.made if path != scratch.last["clusters"]))
    return done


def _mutual(open_: DataFrame) -> DataFrame:
    """(scope, x, to): the pairs each of whose ends has the other as its best partner; the best pair of all is one of them."""
    rank = F.struct("avg", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
    both = open_.select("scope", F.explode(F.array("a", "b")).alias("x"), rank.alias("r"))
    best = both.groupBy("scope", "x").agg(F.max("r").alias("r"))
    chosen = best.groupBy("scope", "r").agg(F.count("*").alias("c")).where("c = 2")
    return chosen.select("scope", (-F.col("r.b")).alias("x"), (-F.col("r.a")).alias("to"))


def _steps(scratch: Scratch, open_: DataFrame, step: float) -> DataFrame:
    """(scope, x, to): clusters whose best averages, in steps, are mutual go to the smallest cluster one or two links away."""
    level = F.floor(F.col("avg") / step + 1e-9)
    sides = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    both = open_.select("scope", level.alias("level"), sides.alias("e")).select("scope", "e.x", "e.y", "level")
    top = both.groupBy("scope", "x").agg(F.max("level").alias("top"))
    best = both.join(top, ["scope", "x"]).where("level = top").select("scope", "x", "y")
    mutual = scratch.renew(best.join(best.select("scope", F.col("y").alias("x"), F.col("x").alias("y")), ["scope", "x", "y"]), "mutual")
    near = mutual.groupBy("scope", "x").agg(F.min("y").alias("m")).select("scope", "x", F.least("x", "m").alias("l"))
    far = mutual.join(near.select("scope", F.col("x").alias("y"), F.col("l").alias("m")), ["scope", "y"])
    two = far.groupBy("scope", "x").agg(F.min("m").alias("m")).join(near, ["scope", "x"]).select("scope", "x", F.least("l", "m").alias("to"))
    return two.where("x <> to")


STEP = 0.05


def groups(nodes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(scope, record, node, lead, size): every record with its group's smallest record and size."""
    scratch = Scratch(nodes.sparkSession, "groups")
    near = average_linkage(near_links(nodes, percent), percent / 100, step=STEP)
    cored = scratch.save(nodes.join(near, ["scope", "node"], "left").select("scope", "node", "labels", F.coalesce("cluster", "node").alias("core")), "cores")
    joined = average_linkage(far_links(cored, percent), percent / 100, step=STEP).select("scope", F.col("node").alias("core"), "cluster")
    clusters = cored.join(joined, ["scope", "core"], "left").select("scope", "node", F.coalesce("cluster", "core").alias("cluster"))
    placed = scratch.save(members.join(clusters, ["scope", "node"]), "placed")
    lead = placed.groupBy("scope", "cluster").agg(F.min("record").alias("lead"), F.count("*").alias("size"))
    return placed.join(lead, ["scope", "cluster"]).select("scope", "record", "node", "lead", "size")


def typical(placed: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """(scope, lead, size, place, record, likeness): each group's `count` most typical records.

    A record's likeness is the share of agreeing labels over all pairs with its group's records (itself among
    them) and runs in which both have a label, from the group's label counts alone; ties go to smaller records.
    """
    grouped = placed.join(nodes.select("scope", "node", "labels"), ["scope", "node"])
    labels = grouped.groupBy("scope", "lead", "node").agg(F.count("*").alias("n"), F.first("labels").alias("labels"))
    cells = labels.select("scope", "lead", "node", "n", F.posexplode("labels").alias("at", "label")).where("label is not null")
    counts = cells.groupBy("scope", "lead", "at", "label").agg(F.sum("n").alias("same"))
    totals = counts.groupBy("scope", "lead", "at").agg(F.sum("same").alias("every"))
    likeness = cells.join(counts, ["scope", "lead", "at", "label"]).join(totals, ["scope", "lead", "at"]).groupBy("scope", "lead", "node").agg((F.sum("same") / F.sum("every")).alias("likeness"))
    order = Window.partitionBy("scope", "lead").orderBy(F.desc("likeness"), "record")
    ranked = placed.join(likeness, ["scope", "lead", "node"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)
    return ranked.select("scope", "lead", "size", "place", "record", "likeness")
