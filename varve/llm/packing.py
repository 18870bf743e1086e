"""Problem 6: items of varying length into containers of fixed capacity, by swap-based local search.

Items over the capacity are cut into full pieces and a rest. A first packing is plain next fit in hash
order; the local search does the rest, in rounds: underfull containers
are dealt into neighbourhoods (by fill, so that the emptiest meet, then by hash, so that others do) and,
within one, documents are moved, exchanged one for one and two for one whenever that raises the sum of
squared fills, until containers empty. A neighbourhood has at most NEAR containers, whatever the table's
size. Within a neighbourhood and over the rounds the search goes on until it has settled.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.session import Scratch

ITEMS = 8_192
NEAR = 128
BINS = "bin string, fill bigint, items array<struct<doc_id: bigint, piece: int, size: bigint>>"


def token_counts(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size): tokens of the whole text under the tokenizer in the given file, which Spark hands to the tasks; null
    and empty texts have none."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import SparkFiles
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(SparkFiles.get(name))
        tokenizer.encode_special_tokens = True
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                sizes = [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "size"])

    return documents.select(key, text).mapInArrow(count, "doc_id bigint, size bigint")


def _row(items: list[tuple[int, int, int]]) -> dict:
    lead = min(items)
    return {"bin": f"{lead[0]}-{lead[1]}", "fill": sum(i[2] for i in items), "items": [{"doc_id": d, "piece": p, "size": s} for d, p, s in items]}


def _out(bins: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    item = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("size", pa.int64())])
    return pa.RecordBatch.from_pylist([_row(b) for b in bins if b], schema=pa.schema([("bin", pa.string()), ("fill", pa.int64()), ("items", pa.list_(item))]))


def _first(capacity: int):
    """Next fit in the order given: a container is closed when the next item does not fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[tuple[int, int, int]] = []
        used = 0
        for batch in batches:
            closed = []
            for item in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "piece", "size")), strict=True):
                if used + item[2] > capacity:
                    closed.append(now)
                    now, used = [], 0
                now.append(item)
                used += item[2]
            yield _out(closed)
        if now:
            yield _out([now])

    return run


def _sizes(items: list[tuple[int, int, int]]) -> tuple[np.ndarray, list[int]]:
    """The distinct sizes of a container and for each a position; of those that occur twice a second one, else -1.

    Distinct sizes add up to the capacity at most, so they are fewer than the root of twice the capacity, and so few that
    every pair of them can be tried, however many items there are.
    """
    first: dict[int, list[int]] = {}
    for i, item in enumerate(items):
        held = first.setdefault(item[2], [])
        if len(held) < 2:
            held.append(i)
    return np.array(list(first), np.int64), [held[0] for held in first.values()] + [held[1] if len(held) > 1 else -1 for held in first.values()]


def _exchange(giver: list[tuple[int, int, int]], taker: list[tuple[int, int, int]], room: int, need: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
    """The move, swap or two-for-one swap of giver's and taker's items that fills the taker's room best: at
    least `need`, at most `room`. Returns the gain and the positions given and taken back."""
    best: tuple[int, tuple[int, ...], tuple[int, ...]] | None = None
    (give, g), (take, t) = _sizes(giver), _sizes(taker)

    def pairs(sizes: np.ndarray, at: list[int]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        i, j = np.triu_indices(len(sizes))
        twice = np.array(at[len(sizes) :]) >= 0
        fine = (i != j) | twice[i]
        i, j = i[fine], j[fine]
        return sizes[i] + sizes[j], [(at[x], at[y] if x != y else at[len(sizes) + y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]

    def fill(sums: np.ndarray, backs: np.ndarray, name_out, name_back) -> None:
        """The largest sums[i] - backs[j] within the room."""
        nonlocal best
        if not len(sums) or not len(backs) or (best and best[0] == room):
            return
        order = np.argsort(sums, kind="stable")
        at = np.searchsorted(sums[order], backs + room, side="right") - 1
        gains = np.where(at >= 0, sums[order][np.maximum(at, 0)] - backs, -1)
        j = int(np.argmax(gains))
        if gains[j] >= need and (best is None or gains[j] > best[0]):
            best = (int(gains[j]), name_out(int(order[at[j]])), name_back(j))

    # equal fills are reached with large items where possible: what stays in the giver is then easy to place
    both, named = pairs(take, t)
    fill(give, both, lambda i: (g[i],), lambda j: named[j])
    fill(give, take, lambda i: (g[i],), lambda j: (t[j],))
    both, given = pairs(give, g)
    fill(both, take, lambda i: given[i], lambda j: (t[j],))
    fill(give, np.zeros(1, np.int64), lambda i: (g[i],), lambda j: ())
    return best


def _improve(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Moves and swaps that raise the sum of squared fills, until none does; givers are the emptiest containers, takers
    the fullest. The sum is a whole number with a bound, so there is an end."""
    fills = [sum(i[2] for i in b) for b in bins]
    changed = True
    while changed:
        changed = False
        for giver in sorted(range(len(bins)), key=lambda b: fills[b]):
            if not bins[giver]:
                continue
            for taker in sorted((b for b in range(len(bins)) if b != giver and bins[b] and fills[b] < capacity), key=lambda b: -fills[b]):
                if not bins[giver]:
                    break
                room = capacity - fills[taker]
                # d tokens moved raise the sum of squares if the taker then is fuller than the giver was
                need = max(1, fills[giver] - fills[taker] + 1)
                if need > room:
                    continue
                found = _exchange(bins[giver], bins[taker], room, need)
                if not found:
                    continue
                gain, out, back = found
                moved, returned = [bins[giver][i] for i in out], [bins[taker][j] for j in back]
                bins[giver] = [x for i, x in enumerate(bins[giver]) if i not in out] + returned
                bins[taker] = [x for j, x in enumerate(bins[taker]) if j not in back] + moved
                fills[giver] -= gain
                fills[taker] += gain
                changed = True
    return [b for b in bins if b]


def _search(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[int, int, int]]] = []
        for batch in batches:
            held += [[(i["doc_id"], i["piece"], i["size"]) for i in items] for items in batch.column("items").to_pylist()]
            while len(held) >= NEAR:
                yield _out(_improve(held[:NEAR], capacity))
                held = held[NEAR:]
        if held:
            yield _out(_improve(held, capacity))

    return run


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, n_tokens, container_id) for every (doc_id, size), doc_id being unique.

    piece counts the parts of an item over the capacity, from 0; all but its last fill a container each.
    A container is named by its smallest item. Items of size 0 or null size have piece 0, n_tokens 0 and no container.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "packing")
    sized = scratch.save(items.select("doc_id", F.coalesce("size", F.lit(0)).cast("bigint").alias("size")), "sizes")
    last = F.floor((F.col("size") - 1) / capacity).cast("int")
    cut = sized.where("size > 0").select("doc_id", F.explode(F.sequence(F.lit(0), last)).alias("piece"), "size")
    pieces = cut.select("doc_id", "piece", F.least(F.lit(capacity), F.col("size") - F.col("piece").cast("bigint") * capacity).alias("size"))
    small = pieces.where(F.col("size") < capacity)
    lot = F.xxhash64("doc_id", "piece")
    tasks = lambda n, each: max(1, -(-n // each))
    dealt = small.repartition(tasks(sized.count(), 2 * ITEMS), lot).sortWithinPartitions(lot, "doc_id", "piece")
    bins = scratch.save(dealt.mapInArrow(_first(capacity), BINS), "bins")
    under, done = bins.where(F.col("fill") < capacity), [bins.where(F.col("fill") >= capacity)]
    left, idle, turn = under.count(), 0, 0
    # by fill the emptiest meet, by hash others do; the search ends when neither kind of round empties a container
    while left > 1 and idle < 2:
        k = tasks(left, 4 * NEAR)
        near = under.repartitionByRange(k, "fill", "bin").sortWithinPartitions("fill", "bin") if turn % 2 == 0 else under.repartition(k, F.xxhash64(F.lit(turn), "bin")).sortWithinPartitions(F.xxhash64(F.lit(turn), "bin"), "bin")
        bins = scratch.save(near.mapInArrow(_search(capacity), BINS), "bins")
        under = bins.where(F.col("fill") < capacity)
        done.append(bins.where(F.col("fill") >= capacity))
        after = bins.count()
        idle, left, turn = 0 if after < left else idle + 1, under.count(), turn + 1
    packed = under
    for part in done:
        packed = packed.unionByName(part)
    rows = packed.select(F.col("bin").alias("container_id"), F.explode("items").alias("i")).select("i.doc_id", "i.piece", F.col("i.size").alias("n_tokens"), "container_id")
    full = pieces.where(F.col("size") == capacity).select("doc_id", "piece", F.col("size").alias("n_tokens"), F.concat_ws("-", "doc_id", "piece").alias("container_id"))
    none = sized.where("size <= 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(None).cast("string").alias("container_id"))
    return rows.unionByName(full).unionByName(none)
