"""Quality and toxicity of documents by hierarchical empirical Bayes.

A logistic model of each label gives a document's evidence from its words and the shape of its text. Hosts and
paths within hosts are Beta-distributed around their parent: a host around the global mean, a path around its host,
each with a strength (a number of pseudo-documents) estimated from all groups by the method of moments. A sparse
site thus stays near its parent and a large one goes by its own documents. A document's posterior is its evidence
with its path's posterior mean, the document itself left out, as the prior in place of the global one.

The models are fitted on a bounded sample: about ``sample`` labelled documents, those of the smallest hashes. Sums
by host and path cover all documents and are pre-aggregated; they are joined back on the narrow scored table, those of
large sites, which are few, by broadcast, so no site's documents meet in one task.

Cases: null text has the mean as its evidence. A null host or path is a site of its own, "". Labels other than 0 and 1,
null ones, and ones without a document teach nothing; several labels of a document each count. Without labels of a
kind its probability is null, and null keeps the document. Repeated rows are scored each on their own. No rows: no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm import wordhash
from glossmill.llm.workspace import Workspace

LABELS = ("quality", "toxic")
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_OTHER = wordhash.MARKS & ~wordhash.WHITE
SHAPES = 6
#: Documents of a large site, and the most large sites (some MB), for which the number is raised.
LARGE, MOST_LARGE = 100_000, 10_000


def _shape(raw: np.ndarray, words: np.ndarray) -> list[float]:
    """Shares of capitals, digits, other marks and white space in bytes, of different words, and words by length."""
    n = max(1, len(raw))
    return [_UPPER[raw].sum() / n, _DIGIT[raw].sum() / n, _OTHER[raw].sum() / n, wordhash.WHITE[raw].sum() / n, len(np.unique(words)) / max(1, len(words)), 5 * len(words) / n]


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, bytes, and hashes of the lower-cased words without punctuation."""
    raw, offsets = wordhash.utf8(column)
    for a, b in wordhash.groups(offsets):
        hashes, bounds = wordhash.words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], True, wordhash.MARKS)
        for row in range(a, b):
            yield row, raw[offsets[row] : offsets[row + 1]], hashes[bounds[row - a] : bounds[row - a + 1]]


@dataclass(frozen=True)
class Logistic:
    """Words (sorted hashes) whose presence counts, their weights, and the scaled shape of the text."""

    words: np.ndarray
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    shape_weights: np.ndarray
    bias: float
    mean: float

    def evidence(self, words: np.ndarray, shape: list[float]) -> float:
        at = np.searchsorted(self.words, words)
        hit = np.unique(at[(at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == words)]) if len(self.words) else at[:0]
        return float(self.bias + self.weights[hit].sum() + ((np.array(shape) - self.centre) / self.scale) @ self.shape_weights)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Newton's method for ridge logistic regression; the last column of x is the constant and not penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(documents: DataFrame, labels: DataFrame, label: str, sample: int = 10_000, words: int = 200) -> Logistic | None:
    """From (doc_id, text) and (doc_id, label): the ``words`` words whose share of documents differs most between
    the labels by its standard error, and the shape of the text."""
    spark = documents.sparkSession
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    total = rated.count()
    if not total:
        return None
    share = min(1.0, sample / total)
    picked = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # About `sample` rows of two numbers, whatever the size of the labels.
    rows = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("text", "y")
    rows = Workspace(spark, "quality").cut(rows, label)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, held, marks = batch.column(1).to_pylist(), [], []
            for row, _, hashes in _texts(batch.column(0)):
                u = np.unique(hashes)
                held.append(u)
                marks.append(np.full(len(u), ys[row], np.int64))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), pa.array(np.concatenate(marks))], ["word", "y"])

    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return None
    n0, n1 = size[0], size[1]
    seen = rows.mapInArrow(present, "word long, y long").groupBy("word").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    p = (F.col("c0") + F.col("c1") + 1) / (n0 + n1 + 2)
    z = F.abs(F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    best = seen.where(z > 4).orderBy(F.desc(z), "word").limit(words).select("word").collect()
    chosen = np.sort(np.array([r["word"] for r in best], np.int64).view(np.uint64))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, raw, hashes in _texts(batch.column(0)):
                row = np.zeros(len(chosen) + SHAPES)
                if len(chosen):
                    at = np.minimum(np.searchsorted(chosen, hashes), len(chosen) - 1)
                    row[np.unique(at[chosen[at] == hashes])] = 1
                row[len(chosen) :] = _shape(raw, hashes)
                out.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.tobytes() for x in out], pa.binary())], ["y", "x"])

    table = rows.mapInArrow(features, "y int, x binary").toArrow()  # of about `sample` rows
    y = table.column("y").to_numpy().astype(float)
    x = np.array([np.frombuffer(v.as_buffer(), float) for v in table.column("x")]).reshape(len(y), -1)
    order = np.lexsort((*x.T[::-1], y))  # the fit doesn't depend on the order of tasks
    x, y = x[order], y[order]
    shape = x[:, len(chosen) :]
    centre, scale = shape.mean(axis=0), shape.std(axis=0) + 1e-9
    x[:, len(chosen) :] = (shape - centre) / scale
    w = _fit(np.hstack([x, np.ones((len(y), 1))]), y)
    return Logistic(chosen, w[: len(chosen)], centre, scale, w[len(chosen) : -1], float(w[-1]), float(y.mean()))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-documents of the Beta prior of groups (n, s) around their parents' mean, by the method of moments:
    the variance of group means beyond what their documents' own spread explains."""
    m = F.col("s") / F.col("n")
    within = mean * (1 - mean)
    r = groups.where("n > 1").agg(
        F.sum(F.col("n") * (m - mean) * (m - mean)).alias("between"), F.sum(within).alias("noise"), F.sum(F.col("n") * within).alias("spread"), F.sum("n").alias("n"), F.count("*").alias("g")
    ).first()
    if not r["n"] or not r["spread"]:
        return 100.0
    excess = max((r["between"] - r["noise"]) / r["n"], 0.0)
    return float(min(1e4, max(1.0, r["spread"] / r["n"] / excess - 1 if excess > 0 else 1e4)))


def _joined(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows with the sums of their sites. Sites of LARGE documents and more are at most as many as all documents by LARGE,
    or MOST_LARGE; rows that have met theirs go on under keys of their own, so they are spread evenly."""
    total = sites.agg(F.sum("n").alias("n")).first()["n"] or 0
    large = F.col("n") >= max(LARGE, total // MOST_LARGE)
    sums = ("n", "s", "host_n", "host_s")
    few = F.broadcast(sites.where(large).select("host", "path", *(F.col(c).alias(f"__{c}") for c in sums)))
    met = rows.join(few, ["host", "path"], "left")
    known = F.col("__n").isNotNull()
    met = met.withColumn("__host", F.when(known, F.concat(F.lit("\n"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col("host")))
    rest = sites.where(~large).select(F.col("host").alias("__host"), F.col("path").alias("__path"), *sums)
    both = met.join(rest, (met["__host"] == rest["__host"]) & (met["path"] == rest["__path"]), "left")
    return both.select(*(both[c] for c in rows.columns if c not in ("host", "path")), met["host"], met["path"], *(F.coalesce(f"__{c}", c).alias(c) for c in sums))


def score(documents: DataFrame, labels: DataFrame, host: str = "host", path: str = "path", sample: int = 10_000) -> DataFrame:
    """(doc_id, host, path, p_quality, p_toxic, keep) for every row of (doc_id, text, host, path)."""
    spark = documents.sparkSession
    work = Workspace(spark, "quality")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))
    models = {x: train(docs, labels, x, sample) for x in LABELS}
    sent = spark.sparkContext.broadcast(models)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3)
            out = {x: np.full(batch.num_rows, np.nan) for x in LABELS}
            null = np.asarray(texts.is_null())
            for row, raw, words in _texts(texts):
                shape = _shape(raw, words)
                for x, m in sent.value.items():
                    if m is not None:
                        out[x][row] = np.log(m.mean / (1 - m.mean)) if null[row] else m.evidence(words, shape)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(out[x], mask=np.isnan(out[x])) for x in LABELS)], ["doc_id", "host", "path", *LABELS])

    scored = work.cut(docs.select("doc_id", "host", "path", "text").mapInArrow(read, "doc_id long, host string, path string, quality double, toxic double"), "scored")
    out = scored
    for x in LABELS:
        if models[x] is None:
            out = out.withColumn(f"p_{x}", F.lit(None).cast("double"))
            continue
        p = 1 / (1 + F.exp(-F.col(x)))
        mean = scored.agg(F.avg(p).alias("m")).first()["m"] or models[x].mean
        paths = work.cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")), f"{x}-paths")
        hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        k_host = _strength(hosts, F.lit(float(mean)))
        hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"))
        sites = paths.join(hosts, "host")
        k_path = _strength(sites.withColumn("mean", (F.col("host_s") + k_host * mean) / (F.col("host_n") + k_host)), F.col("mean"))
        # The document itself is left out of its host's and its path's sums.
        j = _joined(out, sites)
        above = (F.col("host_s") - p + k_host * mean) / (F.col("host_n") - 1 + k_host)
        site = (F.col("s") - p + k_path * above) / (F.col("n") - 1 + k_path)
        posterior = F.col(x) - _logit(F.lit(float(mean))) + _logit(site)
        out = j.withColumn(f"p_{x}", F.round(1 / (1 + F.exp(-posterior)), 6)).drop("n", "s", "host_n", "host_s")
    keep = F.coalesce(F.col("p_quality") >= 0.5, F.lit(True)) & F.coalesce(F.col("p_toxic") < 0.5, F.lit(True))
    return out.select("doc_id", "host", "path", "p_quality", "p_toxic", keep.alias("keep"))
