"""Problem 7: evaluation texts in a corpus, by rare n-gram seeds and Smith-Waterman alignment.

Every run of PASSAGE words of an item holds PASSAGE - SEED + 1 n-grams of SEED words; the one that is in
the fewest documents is its seed. A document that holds the run holds the seed, so the join of seeds and
documents loses none, while phrases that many texts share are passed over for rarer ones. An edited copy may
have lost the rarest n-gram of every passage, so where such are sought every n-gram of an item is a seed. The
n-grams of the whole corpus are matched against those of the items; only matches are shuffled. Each pair that
shares a seed is then aligned word by word, over the whole document; documents of one item go through together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.words import words
from varve.session import Scratch

PASSAGE = 12
SEED = 6
MATCH, MISMATCH, GAP = 2, -1, -1
TOGETHER = 16384
PRIME = np.uint64(0x9E3779B97F4A7C15)


def _codes(tokens: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(t) for t in tokens), np.uint64, len(tokens))


def _grams(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SEED):
            out = out * PRIME + codes[i : i + n]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def grams(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, grams): hashes of the word n-grams of the whole text, in order; none if it has fewer words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [_grams(_codes(words(t))) for t in part.column(1).to_pylist()]
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in found]))), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), lists], names=[key, "grams"])

    return texts.select(key, text).mapInArrow(run, f"{key} bigint, grams array<bigint>")


def seeds(items: DataFrame, frequency: DataFrame) -> DataFrame:
    """(item_id, gram): of every passage of PASSAGE words that may be whole in a document the n-gram in the fewest documents.

    items: (item_id, at, gram); frequency: (gram, docs), n-grams in no document are missing. A passage with such an
    n-gram is whole in no document and gives no seed.
    """
    rare = F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "gram", "at")
    span = PASSAGE - SEED
    window = Window.partitionBy("item_id").orderBy("at").rowsBetween(0, span)
    known = items.join(frequency, "gram", "left").withColumn("r", F.min(rare).over(window)).withColumn("k", F.count("*").over(window))
    return known.where((F.col("k") == span + 1) & (F.col("r.docs") > 0)).select("item_id", F.col("r.gram").alias("gram")).distinct()


def align_all(documents: list[np.ndarray], item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every document the best local alignment's score and the longest run of equal consecutive words.

    The documents lie end to end, one free place before each; there scores and runs are none, and the slope rises by
    more than any score, so that no alignment goes from one into the next.
    """
    starts = np.concatenate(([0], np.cumsum([len(d) + 1 for d in documents]))).astype(np.int64)
    n, starts = int(starts[-1]), starts[:-1]
    words_, inside = np.zeros(n, np.uint64), np.ones(n, bool)
    inside[starts] = False
    words_[inside] = np.concatenate(documents)
    wall = MATCH * len(item) + 1
    slope = np.arange(n) * -GAP + np.cumsum(~inside) * wall
    score, run, best, longest = (np.zeros(n, np.int64) for _ in range(4))
    same, step, grown = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for word in item:
        np.equal(words_, word, out=same)
        same &= inside
        np.add(run[:-1], 1, out=grown[1:])
        grown *= same
        run, grown = grown, run
        np.multiply(same, MATCH - MISMATCH, out=step)
        step[1:] += score[:-1]
        step += MISMATCH
        score += GAP
        np.maximum(step, score, out=step)
        np.maximum(step, 0, out=step)
        step[starts] = 0
        step += slope
        np.maximum.accumulate(step, out=step)  # gaps along the document
        step -= slope
        score, step = step, score
        np.maximum(best, score, out=best)
        np.maximum(longest, run, out=longest)
    return np.maximum.reduceat(best, starts), np.maximum.reduceat(longest, starts)


def align(document: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score and the longest run of equal consecutive words."""
    best, longest = align_all([document], item)
    return int(best[0]), int(longest[0])


def leaks(documents: DataFrame, items: DataFrame, *, edited: bool = True) -> DataFrame:
    """(doc_id, item_id, score, run, share) for every document and item that share an n-gram of SEED words.

    Without `edited`, only documents that may hold a whole passage are sought, by the seeds.
    score: of the best local alignment of their words; run: their longest equal run of words; share: score over that
    of the whole item. documents: (doc_id, text), items: (item_id, text), ids being unique. Null and empty texts,
    and items with fewer than PASSAGE words, hold no passage.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "leaks")
    of_items = scratch.save(grams(items, "item_id").where(F.size("grams") > PASSAGE - SEED).select("item_id", F.posexplode("grams").alias("at", "gram")), "items")
    sought = of_items.select("gram").distinct()
    met = grams(documents, "doc_id").select("doc_id", F.explode(F.array_distinct("grams")).alias("gram"))
    hits = scratch.save(met.join(sought, "gram"), "hits")
    frequency = hits.groupBy("gram").agg(F.count("*").alias("docs"))
    chosen = of_items.select("item_id", "gram").distinct() if edited else seeds(of_items, frequency)
    pairs = hits.join(chosen, "gram").select("doc_id", "item_id").distinct()
    asked = scratch.save(pairs.groupBy("doc_id").agg(F.collect_list("item_id").alias("item_ids")), "pairs")
    texts = documents.select("doc_id", "text").join(asked, "doc_id")
    wanted = texts.select("doc_id", "text", F.explode("item_ids").alias("item_id")).join(items.select("item_id", F.col("text").alias("item")), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc_ids, item_ids, found = batch.column("doc_id").to_pylist(), batch.column("item_id").to_pylist(), {}
            texts_, whole, rows_of = {}, {}, {}
            for row, (doc_id, item_id) in enumerate(zip(doc_ids, item_ids, strict=True)):
                if doc_id not in texts_:
                    texts_[doc_id] = _codes(words(batch.column("text")[row].as_py()))
                if item_id not in whole:
                    whole[item_id] = _codes(words(batch.column("item")[row].as_py()))
                rows_of.setdefault(item_id, []).append(row)
            for item_id, asked_rows in rows_of.items():
                lengths = np.cumsum([len(texts_[doc_ids[row]]) + 1 for row in asked_rows])
                for part in np.split(np.array(asked_rows), np.flatnonzero(np.diff(lengths // TOGETHER)) + 1):
                    best, longest = align_all([texts_[doc_ids[row]] for row in part], whole[item_id])
                    found |= dict(zip(part.tolist(), zip(best.tolist(), longest.tolist(), strict=True), strict=True))
            rows = [(d, i, *found[row], found[row][0] / (MATCH * len(whole[i]))) for row, (d, i) in enumerate(zip(doc_ids, item_ids, strict=True))]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "score", "run", "share"])

    return wanted.select("doc_id", "text", "item_id", "item").mapInArrow(run, "doc_id bigint, item_id bigint, score bigint, run bigint, share double")
