"""Exact top-k inner-product search by refining global score histograms.

Queries go in blocks of bounded size that are sent to the tasks; every task scores a block against the candidates
that it reads. Rounds of histograms, added up over all tasks, narrow the interval that holds each query's kth
score, until it is one score wide or few candidates are left above its lower end. A last pass keeps the candidates
from there on. Of candidates with the very same score a task keeps those of the k smallest ids, so ties, however
many, never gather in one place.

Vectors are made integers, floor(scale * x) with x as double, so scores are exact. Cases: a null vector, or one
with null or non-finite components, takes no part, nor does a null id; vectors of another length than a query's
aren't its candidates; rows that repeat an id are candidates each on their own, except the query's own id; queries
that repeat an id with other vectors are one query, which has the k best of all their candidates' scores. Fewer than
k candidates: all. No rows: no rows. Other columns are ignored. A score beyond 62 bits raises OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.bits import by_batches
from glossmill.llm.workspace import Workspace

BINS = 1024
_CELLS = 1 << 20  # scores held at once


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.select(F.col(key).cast("long").alias("id"), x.cast("array<double>").alias("x")).where("id is not null and x is not null").where(finite)


def _matrices(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer vectors) for each length of vectors in a batch of (id, x)."""
    column = batch.column(1)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    ids, flat = batch.column(0).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(lengths) else lengths
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield ids[rows], np.floor(scale * flat[starts[rows][:, None] + np.arange(size)])


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where no sum can pass 2**53, else in Python integers."""
    if not vectors.size or np.abs(queries).max() * np.abs(vectors).max() * vectors.shape[1] < 2.0**53:
        return (queries @ vectors.T).astype(np.int64)
    exact = np.array([[int(v) for v in q] for q in queries], object) @ np.array([[int(v) for v in x] for x in vectors], object).T
    if max(map(abs, exact.flat)) >= 1 << 62:
        raise OverflowError("scores don't fit into 64 bits")
    return exact.astype(np.int64)


class _Block:
    """Queries of one length, their intervals and what is known of them; this is what is sent to tasks."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors

    def scored(self, batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(candidate ids, scores by query, which of them count)."""
        step = max(1, _CELLS // max(1, len(self.ids)))
        for batch in batches:
            for ids, vectors in _matrices(batch, scale):
                if vectors.shape[1] != self.vectors.shape[1]:
                    continue
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    yield part, _scores(self.vectors, vectors[at : at + step]), part[None, :] != self.ids[:, None]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", block_rows: int = 2048, few: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates with other ids, ties to smaller ids.

    block_rows queries are searched at a time; few * k candidates at most may be left above an interval's lower
    end when its refinement stops early.
    """
    spark = candidates.sparkSession
    work = Workspace(spark, "topk")
    found = _usable(candidates, key, vector)
    asked = work.cut(_usable(queries, key, vector).distinct().withColumn("size", F.size("x")), "queries")
    kept = work.path("kept")  # of all blocks, so the plan doesn't grow with their number
    some = False
    for size in [r["size"] for r in asked.select("size").distinct().orderBy("size").collect()]:
        rows: list = []
        for r in asked.where(F.col("size") == size).select("id", "x").orderBy("id").toLocalIterator(prefetchPartitions=True):
            rows.append(r)
            if len(rows) == block_rows:
                _search(found, rows, k, scale, few, kept)
                rows, some = [], True
        if rows:
            _search(found, rows, k, scale, few, kept)
            some = True
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = spark.read.schema("query_id long, vec_id long, score long").parquet(kept)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(found: DataFrame, rows: list, k: int, scale: int, few: int, kept: str) -> None:
    """Appends a block's candidates to the folder."""
    context = found.sparkSession.sparkContext
    block = _Block(np.array([r["id"] for r in rows], np.int64), np.floor(scale * np.array([r["x"] for r in rows], float).reshape(len(rows), -1)))
    sent = context.broadcast(block)
    n = len(rows)
    low, high, above = _extent(found, sent, scale, n)
    total = above.copy()  # candidates in [low, high]; what is above high has been counted already
    above = np.zeros(n, np.int64)
    while True:
        # Open: more candidates than are allowed lie from low on, and the interval can still be cut.
        open_ = (above + total > few * k) & (high > low)
        if not open_.any():
            break
        width = np.maximum(1, -(-(high - low + 1) // BINS))
        for r in _refined(found, sent, scale, k, (low, high, above, width, open_)):
            q = r["q"]
            low[q], high[q], above[q], total[q] = r["low"], r["high"], r["above"], r["inside"]
    edge = context.broadcast((low, high))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (low, high) = sent.value, edge.value
        ties: dict[int, np.ndarray] = {}
        for ids, scores, counted in block.scored(batches, scale):
            fits = counted & (scores >= low[:, None])
            tied = fits & (scores == low[:, None]) & (low == high)[:, None]
            q, c = np.nonzero(fits & ~tied)
            if len(q):
                yield _rows(block.ids[q], ids[c], scores[q, c])
            for q in np.flatnonzero(tied.any(axis=1)):
                ties[q] = np.sort(np.concatenate((ties.get(q, ids[:0]), ids[tied[q]])))[:k]
        for q, ids in ties.items():
            yield _rows(np.full(len(ids), block.ids[q]), ids, np.full(len(ids), low[q]))

    found.mapInArrow(keep, "query_id long, vec_id long, score long").write.mode("append").parquet(kept)


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def _extent(found: DataFrame, sent, scale: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's lowest and highest score and its number of candidates."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.iinfo(np.int64).max
        low, high, count = np.full(n, top), np.full(n, -top), np.zeros(n, np.int64)
        for _, scores, counted in sent.value.scored(batches, scale):
            low = np.minimum(low, np.where(counted, scores, top).min(axis=1))
            high = np.maximum(high, np.where(counted, scores, -top).max(axis=1))
            count += counted.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(low), pa.array(high), pa.array(count)], ["q", "low", "high", "n"])

    low, high, count = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
    for r in found.mapInArrow(read, "q long, low long, high long, n long").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("n > 0").collect():
        low[r["q"]], high[r["q"]], count[r["q"]] = r["low"], r["high"], r["n"]
    return low, high, count


def _refined(found: DataFrame, sent, scale: int, k: int, state: tuple) -> list:
    """One round: the bin of each open query that holds its kth score (q, low, high, above, inside). Histograms, one
    of BINS numbers for each query of the block and task, are added up by query; only the bins found come back."""
    shared = found.sparkSession.sparkContext.broadcast(state)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, _, width, open_ = shared.value
        counts = np.zeros(len(low) * BINS, np.int64)
        for _, scores, counted in sent.value.scored(batches, scale):
            q, c = np.nonzero(counted & open_[:, None] & (scores >= low[:, None]) & (scores <= high[:, None]))
            counts += np.bincount(q * BINS + (scores[q, c] - low[q]) // width[q], minlength=len(counts))
        counts = counts.reshape(-1, BINS)
        some = np.flatnonzero(counts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([counts[q].tobytes() for q in some], pa.binary())], ["q", "counts"])

    def locate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high, above, width, _ = shared.value
        q, counts = 0, np.zeros(BINS, np.int64)
        for pdf in parts:
            for q, raw in zip(pdf["q"], pdf["counts"], strict=True):
                counts = counts + np.frombuffer(raw, np.int64)
        down = above[q] + np.cumsum(counts[::-1])[::-1]  # candidates from each bin on
        at = int(np.flatnonzero(down >= min(k, down[0]))[-1])
        begin = low[q] + at * width[q]
        yield pd.DataFrame({"q": [q], "low": [begin], "high": [min(high[q], begin + width[q] - 1)], "above": [down[at] - counts[at]], "inside": [counts[at]]})

    return found.mapInArrow(read, "q long, counts binary").groupBy("q").applyInPandas(by_batches(locate), "q long, low long, high long, above long, inside long").collect()
