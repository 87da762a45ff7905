"""Exact Jaccard join of documents on word n-grams, and the groups that its links make.

Documents with equal sets form a class, named by a 64-bit hash of the set; work goes on with classes. The order of
n-grams is rare first, by counts of hash buckets over all documents (ties by hash): any order that is the same
everywhere keeps the prefix filter exact, so buckets, whose number grows with the input up to a bound, may stand for
n-grams. Two sets that link share an n-gram of their prefixes. Candidates pass the length and the positional filter when they are joined, a filter of
both sides of the n-gram that they met on when the sets are at hand, and then one exact count per pair.

Buckets of few documents have all their pairs compared. Large ones need not: in each, a leader of each band of
lengths is paired with the others; bands are taken twice, shifted by half. The leader is the class whose n-grams
are the most frequent on average, that is, of a group of edited copies the text that they were made from. The links
so found join most classes. What is left are pairs of classes of one large bucket in different components: all of
these are then compared, by joining the classes outside each bucket's largest component with the whole bucket. Before that
join a class leaves a bucket if it can't link there: if behind the n-gram's place in its order it has fewer n-grams
than even the smallest class of the bucket that its length allows would need. What is left of a bucket is dealt over
several tasks. So no link is lost that could join two components, and a group of n near copies costs about n
comparisons, as do pages that share a template but not enough of it.

Cases: words are bytes other than 0x20 and 0x09-0x0D with A-Z lower-cased; null and wordless texts have an empty
set, link with nothing and are their own component; texts of fewer than n words have their whole sequence as one
n-gram. Rows of equal texts are in one component, also if they share a doc_id. A null doc_id takes no part in
links: its component_id is null. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm import bits, wordhash
from glossmill.llm.components import components
from glossmill.llm.session import frugal
from glossmill.llm.workspace import Workspace

SLICE = 1 << 13
#: Slices, entries and bytes of sets of a batch, which are 1 to 2 MB: larger buffers aren't pooled by the JVM, and much of
#: what is freed of them stays with the C library.
SENT_SLICES, SENT_ENTRIES, SENT_BYTES = 32, 1 << 16, 1 << 20
#: Buckets of more documents than this are large.
LARGE = 16
#: Classes of a bucket that one task compares with the bucket.
SHARE = 256
#: Counted buckets: 2**20 up to so many bytes of text, then in proportion, up to 2**24 (64 MB).
COUNTED_BYTES, MOST_LOG2_COUNTS = 1 << 32, 24


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row with words: its place in the batch and its distinct n-gram hashes, sorted."""
    raw, offsets = wordhash.utf8(batch.column(1))
    for a, b in wordhash.groups(offsets):
        hashes, bounds = wordhash.words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
        grams = wordhash.ngrams(hashes, n)
        for row in range(b - a):
            begin, end = bounds[row], bounds[row + 1]
            if end - begin >= n:
                yield a + row, np.unique(grams[begin : end - n + 1])
            elif end > begin:
                yield a + row, wordhash.ngrams(hashes[begin:end], int(end - begin), salt=int(end - begin))


def _class(grams: np.ndarray) -> np.ndarray:
    return wordhash.mix(np.array([wordhash.mix(grams + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)]) + np.uint64(len(grams))).view(np.int64)


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Counts as 16-bit ranks in the same order, which sort in linear time."""
    values, rank = np.unique(counts, return_inverse=True)
    return (rank * min(1.0, 65535 / len(values))).astype(np.uint16)


def _bound(x: np.ndarray, y: np.ndarray) -> int:
    """The most n-grams that two parts of sets can share, by the sizes of 16 partitions of each."""
    shift = np.uint64(60)
    return int(np.minimum(np.bincount((x >> shift).astype(np.int64), minlength=16), np.bincount((y >> shift).astype(np.int64), minlength=16)).sum())


class JaccardJoin:
    """n words make an n-gram; sets link when 100 * intersection >= percent * union."""

    def __init__(self, n: int = 5, percent: int = 80, log2_counts: int | None = None):
        self.n, self.percent, self.log2_counts = n, percent, log2_counts

    def _ordered(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Rare first; the sort is stable, and grams come sorted."""
        seen = counts[(grams >> np.uint64(64 - self.log2_counts)).astype(np.int64)]
        return grams[np.argsort(seen, kind="stable")]

    def _prefix(self, size: int) -> int:
        return size - -(-self.percent * size // 100) + 1

    def scan(self, documents: DataFrame, work: Workspace) -> DataFrame:
        """One row per document (doc_id, size, class), and rows (k, counts) of the tasks' bucket counts."""
        n, log2 = self.n, self.log2_counts
        names = ["doc_id", "size", "class", "k", "counts"]

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(1 << log2, np.uint32)
            for batch in batches:
                sizes, classes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                waiting, held = [], 0
                for row, grams in _sets(batch, n):
                    sizes[row], classes[row] = len(grams), _class(grams)[0]
                    waiting.append(grams)
                    held += len(grams)
                    if held > counts.size:
                        counts += np.bincount((np.concatenate(waiting) >> np.uint64(64 - log2)).astype(np.int64), minlength=counts.size).astype(np.uint32)
                        waiting, held = [], 0
                if waiting:
                    counts += np.bincount((np.concatenate(waiting) >> np.uint64(64 - log2)).astype(np.int64), minlength=counts.size).astype(np.uint32)
                size = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(classes, mask=sizes == 0), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names)
            parts = [(k, x.tobytes()) for k in range(0, counts.size // SLICE) if (x := counts[k * SLICE : (k + 1) * SLICE]).any()]
            for at in range(0, len(parts), SENT_SLICES):
                some = parts[at : at + SENT_SLICES]
                empty = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([empty, empty, empty, pa.array([k for k, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], names)

        return work.cut(documents.mapInArrow(frugal(read), "doc_id long, size long, class long, k int, counts binary"), "scan")

    def _counts(self, scanned: DataFrame):
        def total(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, k = None, 0
            for pdf in parts:
                for k, raw in zip(pdf["k"], pdf["counts"], strict=True):
                    x = np.frombuffer(raw, np.uint32)
                    sums = x.astype(np.uint64) if sums is None else sums + x
            if sums is not None:
                yield pd.DataFrame({"k": [k], "counts": [np.minimum(sums, 0xFFFFFFFF).astype(np.uint32).tobytes()]})

        counts = np.zeros(1 << self.log2_counts, np.uint32)
        for r in scanned.where("k is not null").select("k", "counts").groupBy("k").applyInPandas(bits.by_batches(total), "k int, counts binary").collect():
            counts[r["k"] * SLICE : (r["k"] + 1) * SLICE] = np.frombuffer(r["counts"], np.uint32)
        return scanned.sparkSession.sparkContext.broadcast(_ranks(counts))

    def _grams(self, documents: DataFrame, counts) -> DataFrame:
        """(gram, class) for every prefix n-gram."""
        return self._entries(documents, counts).select("gram", "class")

    def _entries(self, documents: DataFrame, counts, known=None, large=None, whole: bool = False) -> DataFrame:
        """(gram, class, size, pos, central, large) for every prefix n-gram, or for those that ``known`` holds: its
        place in the order, the average rank of the set's counts (with ``known`` or ``whole``), and whether ``large``
        holds it."""
        n, names = self.n, ["gram", "class", "size", "pos", "central", "large"]

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                waiting, held = [], 0
                for _, unordered in _sets(batch, n):
                    size = len(unordered)
                    prefix = self._ordered(unordered, counts.value)[: self._prefix(size)]
                    pos = np.arange(len(prefix), dtype=np.int32)
                    if known is not None:
                        some = bits.contains(known.value, prefix)
                        prefix, pos = prefix[some], pos[some]
                    if len(prefix):
                        central = counts.value[(unordered >> np.uint64(64 - self.log2_counts)).astype(np.int64)].mean() if known is not None or whole else 0
                        waiting.append((prefix.view(np.int64), np.full(len(prefix), _class(unordered)[0]), np.full(len(prefix), size, np.int32), pos, np.full(len(prefix), int(central), np.int32)))
                        held += len(prefix)
                    if held > SENT_ENTRIES:
                        yield flush(waiting)
                        waiting, held = [], 0
                if held:
                    yield flush(waiting)

        def flush(waiting: list[tuple]) -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            over = np.zeros(len(columns[0]), bool) if large is None else bits.contains(large.value, columns[0].view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, over)], names)

        return documents.mapInArrow(frugal(read), "gram long, class long, size int, pos int, central int, large boolean")

    def _arrays(self, documents: DataFrame, counts, reps: DataFrame, pairs: DataFrame, work: Workspace) -> DataFrame:
        """(class, grams): the ordered sets of the classes in pairs, each read from its representative (rep, class).
        A filter picks the texts, so a few more sets may come along; very many are joined."""
        n = self.n
        asked = work.cut(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(reps, "class").select("rep"), "asked", release=True)
        number = asked.count()
        wanted = bits.build(asked, number) if bits.fits(number) else None
        if wanted is None:
            documents = documents.join(asked.withColumnRenamed("rep", "doc_id").distinct(), "doc_id", "left_semi")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_numpy().view(np.uint64)
                some = np.arange(len(keys)) if wanted is None else np.flatnonzero(bits.contains(wanted.value, keys))
                if not len(some):
                    continue
                classes, arrays, held = [], [], 0
                for _, grams in _sets(batch.take(pa.array(some)), n):
                    classes.append(_class(grams)[0])
                    arrays.append(self._ordered(grams, counts.value).tobytes())
                    held += len(arrays[-1])
                    if held > SENT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(arrays, pa.binary())], ["class", "grams"])
                        classes, arrays, held = [], [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(arrays, pa.binary())], ["class", "grams"])

        return documents.mapInArrow(frugal(read), "class long, grams binary")

    def _candidates(self, met: DataFrame) -> DataFrame:
        """From entries joined on their n-gram, the second's columns ending in _y, under the length and positional
        filters: (a, b, i, j) once per pair, with the positions of the first n-gram that they were joined on."""
        p = self.percent
        need = F.ceil(F.lit(p) * (F.col("size") + F.col("size_y")) / F.lit(100 + p))
        most = F.least(F.col("size") - F.col("pos"), F.col("size_y") - F.col("pos_y"))
        met = met.where((F.col("class") != F.col("class_y")) & (F.least("size", "size_y") * 100 >= F.greatest("size", "size_y") * p) & (most >= need))
        up = F.col("class") < F.col("class_y")
        pairs = met.select(
            F.least("class", "class_y").alias("a"), F.greatest("class", "class_y").alias("b"),
            F.when(up, F.col("pos")).otherwise(F.col("pos_y")).alias("i"), F.when(up, F.col("pos_y")).otherwise(F.col("pos")).alias("j"),
        )
        return pairs.groupBy("a", "b").agg(F.min("i").alias("i"), F.min("j").alias("j"))  # both grow along the common order

    def _links(self, pairs: DataFrame, arrays: DataFrame) -> DataFrame:
        percent = self.percent

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep, common = [], []
                for k, (i, j, x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True)):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    need = -(-percent * (len(x) + len(y)) // (100 + percent))
                    # (i, j) need not be the first n-gram that they share: earlier ones may lie in large buckets.
                    if _bound(x[:i], y[:j]) + 1 + _bound(x[i + 1 :], y[j + 1 :]) < need:
                        continue
                    shared = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                    if shared >= need:
                        keep.append(k)
                        common.append(shared)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), pa.array(common, pa.int64())], ["a", "b", "common"])

        y = arrays.select(F.col("class").alias("b"), F.col("grams").alias("y"))
        x = arrays.select(F.col("class").alias("a"), F.col("grams").alias("x"))
        both = pairs.join(y, "b").join(x, "a").select("a", "b", "i", "j", "x", "y")
        return both.mapInArrow(frugal(verify), "a long, b long, common long")

    def groups(self, documents: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, component_id) for every row of (doc_id, text)."""
        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        named = docs.where("doc_id is not null")
        work = Workspace(documents.sparkSession, "jaccard")
        if self.log2_counts is None:
            size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
            self.log2_counts = min(MOST_LOG2_COUNTS, 20 + (-(-size // COUNTED_BYTES) - 1).bit_length() if size else 20)
        scanned = self.scan(docs, work)
        rows = scanned.where("k is null").select("doc_id", "size", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class"))
        labels = self._labels(named, scanned, work)
        placed = rows.join(labels.withColumnRenamed("node", "class"), "class", "left").select("doc_id", "size", F.coalesce("component", "class").alias("component"))
        least = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
        return placed.join(least, "component", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))

    def _able(self, mixed: DataFrame) -> DataFrame:
        """Without the entries that can be in no link of their bucket: a partner's size is at least that of the least
        class of the bucket in the same band of lengths or the one below, and at least what the lengths allow."""
        p = self.percent
        band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / p))).cast("int")
        mixed = mixed.withColumn("band", band)
        least = mixed.groupBy("gram", "band").agg(F.min("size").alias("least"))
        # Rounding may put a size at a band's edge into the next one, so the two below count.
        near = least.select("gram", F.explode(F.array(F.col("band"), F.col("band") + 1, F.col("band") + 2)).alias("band"), "least").groupBy("gram", "band").agg(F.min("least").alias("least"))
        partner = F.greatest(F.col("least"), F.ceil(F.lit(p) * F.col("size") / 100))
        need = F.ceil(F.lit(p) * (F.col("size") + partner) / F.lit(100 + p))
        return mixed.join(near, ["gram", "band"]).where(F.col("size") - F.col("pos") >= need).drop("band", "least")

    def _met(self, mixed: DataFrame) -> DataFrame:
        """Entries outside their bucket's largest component with all of the bucket, the second's columns ending in _y.
        A bucket's entries are dealt over as many tasks as it has shares of them, each of which gets the bucket."""
        minor = mixed.where("component <> top").drop("top")
        shares = minor.groupBy("gram").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
        minor = minor.join(shares, "gram").withColumn("share", F.pmod(F.xxhash64("class"), F.col("shares").cast("long")).cast("int")).drop("shares")
        whole = mixed.drop("top").withColumnsRenamed({c: f"{c}_y" for c in ("class", "size", "pos", "component")})
        whole = whole.join(shares, "gram").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        return minor.join(whole, ["gram", "share"])

    def _labels(self, docs: DataFrame, scanned: DataFrame, work: Workspace) -> DataFrame:
        counts = self._counts(scanned)
        ends = self._grams(docs, counts).groupBy("gram").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n"))
        shared = work.cut(ends.where("low <> high").select("gram", (F.col("n") > LARGE).alias("large")), "shared", release=True)
        number = shared.count()
        if bits.fits(number):
            # The second filter decides by n-gram alone which buckets count as large, so all tasks decide alike.
            known, over = bits.build(shared.select("gram"), number), bits.build(shared.where("large").select("gram"), shared.where("large").count())
            entries = self._entries(docs, counts, known, over)
        else:
            entries = self._entries(docs, counts, whole=True).drop("large").join(shared, "gram")
        entries = work.cut(entries.distinct(), "entries", release=True)
        work.drop(shared)
        reps = scanned.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep"))

        few = entries.where("not large").select("gram", "class", "size", "pos")
        pairs = self._candidates(few.join(few.toDF("gram", "class_y", "size_y", "pos_y"), "gram").where("class < class_y"))
        # Leaders of bands of lengths. All sizes of a band link by length; a band and the same shifted by half.
        many = entries.where("large").drop("large")
        step = F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / self.percent))
        banded = many.withColumn("band", F.explode(F.array((F.floor(step) * 2).cast("int"), (F.floor(step + 0.5) * 2 + 1).cast("int"))))
        leader = banded.groupBy("gram", "band").agg(F.max(F.struct("central", "class", "size", "pos")).alias("y"))
        leader = leader.select("gram", "band", F.col("y.class").alias("class_y"), F.col("y.size").alias("size_y"), F.col("y.pos").alias("pos_y"))
        led = self._candidates(banded.join(leader, ["gram", "band"]))
        pairs = pairs.unionAll(led).groupBy("a", "b").agg(F.min("i").alias("i"), F.min("j").alias("j"))
        pairs = work.cut(pairs, "pairs", release=True)
        links = work.cut(self._links(pairs, self._arrays(docs, counts, reps, pairs, work)), "links", release=True, batch_rows=256)
        labels = work.cut(components(links.select("a", "b"), work), "labels", release=True)

        # All pairs of one large bucket that are in different components still.
        e = many.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        e = work.cut(e, "placed", release=True)
        per = e.groupBy("gram", "component").agg(F.count("*").alias("n"))
        top = per.groupBy("gram").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("k")).where("k > 1").select("gram", F.col("top.component").alias("top"))
        mixed = work.cut(self._able(e.join(top, "gram")), "mixed", release=True)
        rest = self._candidates(self._met(mixed).where("component <> component_y"))
        rest = work.cut(rest.join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "rest", release=True)
        more = work.cut(self._links(rest, self._arrays(docs, counts, reps, rest, work)), "more", release=True, batch_rows=256)
        if more.isEmpty():
            return labels
        stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return work.cut(components(stars.unionAll(more.select("a", "b")), work), "labels", release=True)
