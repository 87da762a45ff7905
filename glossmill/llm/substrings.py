"""Substring deduplication against a log-structured index of window fingerprints.

A window is ``window`` consecutive words of one document. Its fingerprint is the least hash of the ``gram``-word
sequences in it, so equal windows have equal fingerprints and neighbouring windows mostly share one: an index of
fingerprints has about a quarter of the rows that one of windows had. The index is a folder of immutable runs, bucketed
and sorted by key, and a manifest that names those that count:

* fingerprint runs (fp, first, many): the smallest document with it, and whether several documents of it have it;
* window runs (whole, check, first): 96-bit hashes of windows whose fingerprint more than one document has.

A new batch writes its own fingerprint run, which is merge-joined with the older ones, bucket by bucket and without
a shuffle. Windows of shared fingerprints are then verified: those of the batch, those in the window runs, and those
of the one older document that a fingerprint had so far. When there are more than ``fanout`` runs, the smallest are
merged before the next batch is joined with them. An index can be opened again, by another session too, and go on.

Groupings are pre-aggregated in the tasks that read the texts. Windows that very many documents have are few, so they
are sent to these tasks and settled there; only the others are joined by key. Texts are shuffled only if they may lose
words. So no document set, however large, meets in one task.

Cases: null text has no words. Rows with a null doc_id stay as they are and count nowhere. Rows with the same
doc_id are one document for "smaller", and each keeps its own words. Documents shorter than a window keep all.
No rows: no rows. Other columns pass through under their own names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm import bits, wordhash
from glossmill.llm.session import frugal, plainly, with_fields
from glossmill.llm.workspace import Workspace
from glossmill.shared import delete, listed, put

#: A window that at least so many documents' windows equal is settled where texts are read; of these there are at most
#: MOST_HEAVY, for which the number is raised.
HEAVY, MOST_HEAVY = 10_000, 50_000
#: By kind of run: columns, those that it is bucketed by, and that by which a bucket is sorted.
_RUNS = {"fingerprints": ("fp long, first long, many boolean", ["fp"], "fp"), "windows": ("whole long, check int, first long", ["whole", "check"], "whole")}
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def _windows(batch: pa.RecordBatch, window: int, gram: int):
    """For groups of rows: place in the batch of each row, then per window its row, start, fingerprint, words."""
    raw, offsets = wordhash.utf8(batch.column(1))
    for a, b in wordhash.groups(offsets):
        hashes, bounds = wordhash.words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=False)
        if len(hashes) < window:
            continue
        grams = wordhash.ngrams(hashes, gram)
        n = len(hashes) - window + 1
        fp = grams[:n].copy()
        for j in range(1, window - gram + 1):
            np.minimum(fp, grams[j : j + n], out=fp)
        row = np.repeat(np.arange(b - a), np.diff(bounds))[:n]
        starts = np.arange(n)
        inside = starts + window <= bounds[row + 1]
        yield a, hashes, bounds, row[inside], starts[inside], fp[inside]


def _fingerprints(documents: DataFrame, window: int, gram: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, _, _, row, _, fp in _windows(batch, window, gram):
                new = np.ones(len(fp), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(fp[new].view(np.int64)), pa.array(ids[a + row[new]])], ["fp", "doc"])

    return documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(frugal(read), "fp long, doc long")


def _hashed(hashes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of the windows at the starts."""
    whole, check = wordhash.ngrams(hashes, window)[starts], wordhash.ngrams(hashes, window, salt=1)[starts]
    return whole, (check >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _shared_windows(documents: DataFrame, shared: DataFrame, known, window: int, gram: int, only=None) -> DataFrame:
    """(whole, check, doc) of the windows whose fingerprint is among the shared ones, of which ``known`` is the filter;
    too many for one are joined. Documents that the filter ``only`` doesn't hold are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if only is not None:
                batch = batch.take(pa.array(np.flatnonzero(bits.held(only, batch.column(0).to_numpy().view(np.uint64)))))
            ids = batch.column(0).to_numpy()
            for a, hashes, _, row, starts, fp in _windows(batch, window, gram):
                some = bits.held(known, fp)
                if some.any():
                    whole, check = _hashed(hashes, starts[some], window)
                    columns = [*((fp[some].view(np.int64),) if known is None else ()), whole.view(np.int64), check, ids[a + row[some]]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    schema = ("fp long, " if known is None else "") + "whole long, check int, doc long"
    names = [x.split()[0] for x in schema.split(", ")]
    found = documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(frugal(read), schema)
    return found.distinct().join(shared, "fp", "left_semi").drop("fp") if known is None else found


def _repeats(documents: DataFrame, repeated, heavy, window: int) -> DataFrame:
    """(whole, check, doc, key, at, settled) of the windows that ``repeated`` holds: the text's key and the window's
    start. Those of ``heavy`` (sorted whole, check, first) come out only if they are repeats, settled and under random
    keys; whether the others are is left to a join."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wholes, checks, firsts = heavy.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            raw, offsets = wordhash.utf8(batch.column(1))
            for a, b in wordhash.groups(offsets):
                hashes, bounds = wordhash.words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=False)
                if len(hashes) < window:
                    continue
                starts = np.arange(len(hashes) - window + 1)
                row = np.repeat(np.arange(b - a), np.diff(bounds))[: len(starts)]
                some = starts + window <= bounds[row + 1]
                some &= bits.held(repeated, wordhash.ngrams(hashes, window))
                if not some.any():
                    continue
                starts, row = starts[some], row[some]
                whole, check = _hashed(hashes, starts, window)
                whole, doc = whole.view(np.int64), ids[a + row]
                settled, keep = np.zeros(len(whole), bool), np.ones(len(whole), bool)
                if len(wholes):
                    at = np.minimum(np.searchsorted(wholes, whole), len(wholes) - 1)
                    settled = (wholes[at] == whole) & (checks[at] == check)
                    keep = ~settled | (doc > firsts[at])
                    whole = np.where(settled, wordhash.mix((doc * np.int64(2654435761) + starts).view(np.uint64)).view(np.int64), whole)
                columns = (whole, check, doc, _text_keys(hashes, bounds)[row], (starts - bounds[row]).astype(np.int32), settled)
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], ["whole", "check", "doc", "key", "at", "settled"])

    return documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(frugal(read), "whole long, check int, doc long, key long, at int, settled boolean")


def _text_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits of each row's words, which tell apart rows that share a doc_id."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(wordhash.mix(hashes + (np.arange(len(hashes), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64))), out=sums[1:])
    return wordhash.mix(sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)


# Runs are merged by join: Spark 4.1 groups a union of bucketed tables by their buckets without bringing these together.
def _merged_fingerprints(one: DataFrame, other: DataFrame) -> DataFrame:
    other = other.select("fp", F.col("first").alias("too"), F.col("many").alias("more"))
    many = F.coalesce("many", F.lit(False)) | F.coalesce("more", F.lit(False)) | F.col("first").isNotNull() & F.col("too").isNotNull()
    return one.join(other.hint("merge"), "fp", "full_outer").select("fp", F.least("first", "too").alias("first"), many.alias("many"))


def _merged_windows(one: DataFrame, other: DataFrame) -> DataFrame:
    other = other.select("whole", "check", F.col("first").alias("too"))
    return one.select("whole", "check", "first").join(other.hint("merge"), ["whole", "check"], "full_outer").select("whole", "check", F.least("first", "too").alias("first"))


class FingerprintIndex:
    """The index in a folder of a shared store: the one that is there, or else a new one."""

    def __init__(self, spark: SparkSession, path: str, window: int = 13, gram: int = 7, fanout: int = 4):
        self.spark, self.path, self.window, self.gram, self.fanout = spark, path, window, gram, fanout
        self.buckets, self.version = int(spark.conf.get("spark.sql.shuffle.partitions")), 0
        self.runs: dict[str, list[dict]] = {"fingerprints": [], "windows": []}
        self.work = Workspace(spark, "substrings")
        found = [x for x in listed(spark, path) if x.startswith("manifest-")]
        if found:
            self._open(max(found))

    def _open(self, manifest: str) -> None:
        saved = json.loads(self.spark.read.text(f"{self.path}/{manifest}", wholetext=True).first()["value"])
        if (saved["window"], saved["gram"]) != (self.window, self.gram):
            raise ValueError(f"the index at {self.path} is of {saved['window']} words by {saved['gram']}")
        self.buckets, self.version, self.runs = saved["buckets"], saved["version"], saved["runs"]
        for kind, runs in self.runs.items():
            schema, _, key = _RUNS[kind]
            for r in runs:  # runs of before buckets had names of their own are bucketed by what they are sorted by
                self.spark.sql(f"CREATE TABLE IF NOT EXISTS {r['name']} ({schema}) USING parquet CLUSTERED BY ({', '.join(r.get('by', [key]))}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{r['name']}'")

    def _save(self) -> None:
        """The manifest of the runs that count now; what only older ones name goes after it is written."""
        self.version += 1
        state = {"window": self.window, "gram": self.gram, "buckets": self.buckets, "version": self.version, "runs": self.runs}
        put(self.spark, f"{self.path}/manifest-{self.version:09d}", json.dumps(state).encode())
        kept = {f"manifest-{self.version:09d}", *(r["name"] for runs in self.runs.values() for r in runs)}
        for x in listed(self.spark, self.path):
            if x not in kept:
                self.spark.sql(f"DROP TABLE IF EXISTS {x}") if x.startswith("run_") else None
                delete(self.spark, f"{self.path}/{x}")

    def _write(self, kind: str, rows: DataFrame) -> dict:
        """Tasks have whole buckets, as the rows are dealt by what a run is bucketed by. So they sort by the key alone and
        keep a bucket's file open, where sortBy would sort by bucket and key, which takes several times as long."""
        name, (_, by, key) = f"run_{uuid.uuid4().hex}", _RUNS[kind]
        usual = self.spark.conf.get(_WRITERS)
        self.spark.conf.set(_WRITERS, str(self.buckets))
        try:
            with self.work.small_batches():
                rows.sortWithinPartitions(key).write.format("parquet").bucketBy(self.buckets, *by).option("path", f"{self.path}/{name}").saveAsTable(name)
        finally:
            self.spark.conf.set(_WRITERS, usual)
        self.work.release()
        return {"name": name, "rows": self.spark.table(name).count(), "by": by}

    def _tables(self, kind: str) -> list[DataFrame]:
        return [self.spark.table(r["name"]) for r in self.runs[kind]]

    def add(self, batch: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Adds the batch; history: the documents of earlier batches, of which only those are looked at that have a
        fingerprint for the second time now. Returns (doc, key, at): by document and text the starts of windows that a
        smaller document of the batch or of an earlier one has. Ids of a batch needn't be above earlier ones, but what
        earlier batches returned stays as it was."""
        self._compact()
        w, g = self.window, self.gram
        firsts = _fingerprints(batch, w, g).groupBy("fp").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        new = self._write("fingerprints", firsts.select("fp", "first", (F.col("first") != F.col("last")).alias("many")))
        run = self.spark.table(new["name"])
        shared, only = run.where("many").select("fp"), None
        if self.runs["fingerprints"]:
            hits = reduce(DataFrame.unionAll, [run.select("fp").join(old.hint("merge"), "fp") for old in self._tables("fingerprints")])
            hits = self.work.cut(hits.groupBy("fp").agg(F.min("first").alias("first"), (F.max("many") | (F.count("*") > 1)).alias("many")), "hits", release=True)
            shared = shared.unionAll(hits.select("fp"))
            lone = hits.where("not many").select("first")
            only = bits.within(lone, lone.count())
        known = bits.within(shared, shared.count())
        all_windows = _shared_windows(batch, shared, known, w, g)
        if self.runs["fingerprints"] and history is not None:
            if only is None:
                history = history.join(lone.withColumnRenamed("first", "doc_id").distinct(), "doc_id", "left_semi")
            all_windows = all_windows.unionAll(_shared_windows(history, shared, known, w, g, only))
        least = all_windows.groupBy("whole", "check").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
        seen = self._write("windows", least)
        self.runs["fingerprints"].append(new)
        best = self.spark.table(seen["name"])
        for old in self._tables("windows"):
            o = old.select("whole", "check", F.col("first").alias("older"))
            best = best.join(o.hint("merge"), ["whole", "check"], "left").select("whole", "check", F.least("first", "older").alias("first"), "last", "n")
        best = self.work.cut(best.where("first < last").select("whole", "check", "first", "n"), "best", release=True)
        self.runs["windows"].append(seen)
        self._save()
        out = self._settle(batch, best)
        self.work.drop(best)
        return out

    def _settle(self, batch: DataFrame, best: DataFrame) -> DataFrame:
        number, total = best.agg(F.count("*"), F.sum("n")).first()
        limit = max(HEAVY, (total or 0) // MOST_HEAVY)
        rows = best.where(F.col("n") >= limit).select("whole", "check", "first").orderBy("whole", "check").toArrow()  # at most total / limit
        context = self.spark.sparkContext
        heavy = context.broadcast([rows.column(c).to_numpy() for c in ("whole", "check", "first")])
        found = _repeats(batch, bits.within(best.select("whole"), number), heavy, self.window)
        light = best.where(F.col("n") < limit).select("whole", "check", "first")
        both = found.join(light, ["whole", "check"], "left").where("settled or doc > first")
        # As many starts as the text has words, at most. They are dealt first: a task of the join has few of a text each.
        starts = both.select("doc", "key", "at").repartition("doc", "key")
        return self.work.cut(starts.groupBy("doc", "key").agg(F.collect_set("at").alias("at")), "repeats", release=True)

    def _compact(self) -> None:
        """Merges the smallest runs of a kind that has more than ``fanout``."""
        for kind, runs in self.runs.items():
            if len(runs) <= self.fanout:
                continue
            runs.sort(key=lambda r: r["rows"])
            merged, kept = runs[: len(runs) - self.fanout + 1], runs[len(runs) - self.fanout + 1 :]
            both = reduce(_merged_fingerprints if kind == "fingerprints" else _merged_windows, [self.spark.table(r["name"]) for r in merged])
            self.runs[kind] = [*kept, self._write(kind, both)]
            self._save()

    def delete(self) -> None:
        for runs in self.runs.values():
            for r in runs:
                self.spark.sql(f"DROP TABLE IF EXISTS {r['name']}")
        delete(self.spark, self.path)


def dedup(documents: DataFrame, batches: int = 3, window: int = 13, gram: int = 7, fanout: int = 1, counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """Documents with every word removed that a window covers which a document of smaller doc_id has as well.

    ``batches`` ranges of doc_id go into an index one after another, which goes when the last is in. Text loses the
    removed words and the white space behind them and is otherwise unchanged; two counts are appended under the names
    ``counts`` (existing columns of these names are replaced).
    """
    spark = documents.sparkSession
    work = Workspace(spark, "substring-index")
    index = FingerprintIndex(spark, work.path("index"), window, gram, fanout)
    edges = documents.approxQuantile("doc_id", [n / batches for n in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({int(x) for x in edges})
    removed = []
    for n, (low, high) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
        part = documents
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        removed.append(index.add(part, documents.where(F.col("doc_id") <= low) if n else None))
    index.delete()
    return without(documents, reduce(DataFrame.unionAll, removed), window, counts)


def without(documents: DataFrame, repeats: DataFrame, window: int = 13, counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """Documents without the words of the windows at ``repeats`` (doc, key, at), as ``FingerprintIndex.add`` returns them."""
    others = [c for c in documents.columns if c.lower() not in counts]
    rows = plainly(documents, others)
    columns = rows.columns
    touched = bits.within(repeats.select("doc"), repeats.count())
    texts, ids = others.index("text"), others.index("doc_id")

    def may_lose(batch: pa.RecordBatch) -> np.ndarray:
        keys = batch.column(ids).cast(pa.int64())
        return bits.held(touched, keys.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) & ~np.asarray(keys.is_null())

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(~may_lose(batch))))
            n = wordhash.counted(*wordhash.utf8(batch.column(texts)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(np.zeros(len(n), np.int64))], [*columns, "words", "removed"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(may_lose(batch))))
            raw, offsets = wordhash.utf8(batch.column(texts))
            keys = np.zeros(batch.num_rows, np.int64)
            for a, b in wordhash.groups(offsets):
                keys[a:b] = _text_keys(*wordhash.words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], [*columns, "key"])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n_removed = [], []
            n_words = wordhash.counted(*wordhash.utf8(batch.column(texts)))
            for text, starts, n in zip(batch.column(texts), batch.column(len(others)), n_words.tolist(), strict=True):
                gone = np.zeros(n, bool)
                if starts.is_valid:
                    found = starts.values.to_numpy(zero_copy_only=False)
                    for j in range(window):
                        gone[found + j] = True
                n_removed.append(int(gone.sum()))
                out.append(_without(text.as_py(), gone) if gone.any() else text.as_py())
            held = batch.columns[: len(others)]
            held[texts] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*held, pa.array(n_words), pa.array(n_removed, pa.int64())], [*columns, "words", "removed"])

    schema = with_fields(rows, words="long", removed="long")
    places = repeats.select("doc", F.col("key").alias("of"), "at")
    met = rows.mapInArrow(frugal(keyed), with_fields(rows, key="long")).join(places, (F.col(columns[ids]) == F.col("doc")) & (F.col("key") == F.col("of")), "left")
    return rows.mapInArrow(frugal(clean), schema).unionAll(met.select(*columns, "at").mapInArrow(frugal(rewrite), schema)).toDF(*others, *counts)


def _without(text: str, gone: np.ndarray) -> str:
    raw = np.frombuffer(text.encode(), np.uint8)
    solid = ~wordhash.WHITE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    word = np.cumsum(begins) - 1  # white space goes with the word before it
    return raw[(word < 0) | ~gone[np.maximum(word, 0)]].tobytes().decode()
