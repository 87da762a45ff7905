"""Benchmark decontamination by spaced-seed hashing, in column expressions only.

Texts become tokens: runs of letters and digits, lower-cased. A mask keeps some positions of a short stretch and
ignores the others, so a seed (the hash of the kept tokens) survives substitutions at the ignored ones. Seeds of
documents and benchmark items are joined; each hit is an alignment of the two, which is then verified token by
token, on the hashed tokens of documents that have a hit: somewhere in it ``window`` tokens in a row (or the whole item, if it is shorter) must agree but for
``substitutions`` of them (in proportion for a shorter item, rounded down).

The two masks are lossless for 2 substitutions in 13 tokens and for 1 in 8 to 12: whichever tokens are replaced,
one of the masks fits between them (a test goes through all cases). The benchmark's seeds are broadcast when they
are at most BROADCAST_SEEDS, else shuffled.

Cases: null text or a null key takes no part. Items of fewer than ``shortest`` tokens are never found. Rows that
repeat a doc_id are one document, hit if any of them is. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.workspace import Workspace

#: Positions that a mask keeps; the others of its span are ignored.
MASKS = ((0, 1, 2, 4, 5), (0, 2, 3, 4, 5))
#: Of 8 bytes and a key each: some 30 MB.
BROADCAST_SEEDS = 500_000


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _seeds(hashes: Column) -> Column:
    """For each mask in turn an array of (seed, at): every stretch's seed and the token that it starts at."""

    def of(n: int, mask: tuple[int, ...]) -> Column:
        starts = F.slice(hashes, F.lit(1), F.greatest(F.lit(0), F.size(hashes) - mask[-1]))
        return F.transform(starts, lambda h, i: F.struct(F.xxhash64(F.lit(n), h, *[F.get(hashes, i + p) for p in mask[1:]]).alias("seed"), i.alias("at")))

    return F.concat(*[of(n, mask) for n, mask in enumerate(MASKS)])


def _placed(df: DataFrame, key: str) -> DataFrame:
    """(key, seed, at) for all texts."""
    some = df.where(F.col(key).isNotNull() & F.col("text").isNotNull())
    return some.select(key, F.inline(let(token_hashes(F.col("text")), _seeds)))


def find(documents: DataFrame, benchmark: DataFrame, window: int = 13, substitutions: int = 2, shortest: int = 8) -> DataFrame:
    """(doc_id, item_id, first_token, n_aligned, n_matched): for each alignment that holds a passage of an item the
    document's token that meets the item's first (negative: before the document), the item's tokens within the
    document, and how many of them agree."""
    work = Workspace(documents.sparkSession, "decontaminate")
    items = benchmark.where("item_id is not null and text is not null").select("item_id", token_hashes(F.col("text")).alias("y"))
    items = work.cut(items.where(F.size("y") >= shortest).distinct(), "items")
    seeds = _placed(benchmark.select("item_id", "text"), "item_id").withColumnRenamed("at", "item_at").distinct()
    seeds = work.cut(seeds.join(items.select("item_id").distinct(), "item_id", "left_semi"), "seeds")
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    hits = _placed(documents.select("doc_id", "text"), "doc_id").join(seeds, "seed")
    hits = work.cut(hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).cast("long").alias("first_token")).distinct(), "hits", release=True)

    # Hits come from a table of known size, so Spark broadcasts them if they are small enough. Documents are hashed once,
    # and meet their alignments in the last join, behind which nothing is shuffled.
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    hashed = work.cut(docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", token_hashes(F.col("text")).alias("x")), "hashed", release=True)
    met = hashed.join(hits.join(items, "item_id"), "doc_id")

    def verified(x: Column) -> Column:
        y, first = F.col("y"), F.col("first_token").cast("int")
        same = F.transform(y, lambda t, i: F.when((i + first >= 0) & (F.get(x, F.greatest(i + first, F.lit(0))) == t), 1).otherwise(0))
        inside = F.least(F.size(x), first + F.size(y)) - F.greatest(F.lit(0), first)
        return let(same, lambda s: F.when(holds(s), F.struct(inside.cast("long").alias("n_aligned"), F.aggregate(s, F.lit(0), lambda a, v: a + v).cast("long").alias("n_matched"))))

    def holds(same: Column) -> Column:
        span = F.least(F.lit(window), F.size(same))
        need = span - F.floor(span * substitutions / window)
        return F.exists(F.sequence(F.lit(1), F.size(same) - span + 1), lambda s: F.aggregate(F.slice(same, s, span), F.lit(0), lambda a, v: a + v) >= need)

    met = met.select("doc_id", "item_id", "first_token", F.explode(F.array(verified(F.col("x")))).alias("v"))
    return met.where("v is not null").select("doc_id", "item_id", "first_token", "v.n_aligned", "v.n_matched").distinct()


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The ids of documents that hold a passage of the benchmark, once each."""
    return find(documents, benchmark).select("doc_id").distinct()
