"""Ranked phrase search per dictionary: tokens, postings of the query's tokens, BM25, top rows, snippets.

A query is one phrase. It reads the postings of its own tokens from a stored inverted index, or makes them where
documents aren't indexed. A place of token i of the phrase implies a start, and a start that all tokens imply is a match.
So nothing is joined with itself, and what is shuffled is a row for each token and document, not for each place.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.shared import delete

LIMIT = 50
LIMIT_EACH = 20
#: BM25's constants and the least weight of a phrase.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
OPEN, CLOSE, MORE, SNIPPET = ">>>", "<<<", "...", 30
_TOKEN = r"[\p{L}\p{N}\p{Co}]+"


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str]:
    """Letters with exactly one diacritic, and the letters without: by rule, from the Unicode decompositions."""
    pairs = []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.category(chr(int(parts[1], 16))) == "Mn":
            base = chr(int(parts[0], 16))
            if not unicodedata.decomposition(base) and base.isalpha() and ord(base) < 0x250:
                pairs.append((chr(code), base.lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case without single diacritics; marks on their own are dropped."""
    source, target = _folds()
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Mn}+", "")
    return F.translate(F.replace(F.lower(F.translate(plain, source, target)), F.lit("ς"), F.lit("σ")), source, target)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(_TOKEN), F.lit(0))


def phrase(query: str) -> list[str]:
    """The query's tokens; whatever else it holds only separates them."""
    return _python_tokens(query)


def _python_tokens(text: str) -> list[str]:
    return [t for t, _, _ in _spans(text)]


def _fold(text: str) -> str:
    source, target = _folds()
    table = dict(zip(map(ord, source), target, strict=True))
    return text.translate(table).lower().replace("ς", "σ").translate(table)


def _token_character(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN" or unicodedata.category(c) in ("Co", "Mn")


@lru_cache(maxsize=1)
def _runs() -> re.Pattern:
    """A regular expression for runs of token characters, by code point ranges."""
    ranges, start = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and _token_character(chr(code))
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return re.compile(f"[{''.join(ranges)}]+")


def _spans(text: str) -> list[tuple[str, int, int]]:
    """Tokens with their places in the text."""
    out = []
    for m in _runs().finditer(text):
        token = "".join(c for c in _fold(m[0]) if unicodedata.category(c) != "Mn")
        if token:
            out.append((token, m.start(), m.end()))
    return out


class Postings(NamedTuple):
    """What a search reads, stored or not. entries: (token, dict_id, entry_seq, at) with the token's places in both
    columns as one sequence, in which a gap keeps phrases from spanning both; documents: (dict_id, entry_seq, headword,
    length in tokens); totals: (dict_id, n, average length)."""

    entries: DataFrame
    documents: DataFrame
    totals: DataFrame


def _sequence() -> Column:
    return F.concat(tokens(F.col("headword")), F.array(F.lit("")), tokens(F.col("definition")))


def _measured(documents: DataFrame) -> DataFrame:
    return documents.select("dict_id", "entry_seq", "headword", (F.size(_sequence()) - 1).alias("length"))


def _totals(measured: DataFrame) -> DataFrame:
    return measured.groupBy("dict_id").agg(F.count("*").alias("n"), F.avg("length").alias("average"))


def _as_postings(documents: DataFrame, words: list[str]) -> Postings:
    """Of documents that aren't indexed, the postings of a query's own words."""
    placed = documents.select("dict_id", "entry_seq", F.posexplode(_sequence()).alias("at", "token")).where(F.col("token").isin(words))
    measured = _measured(documents)
    return Postings(placed.groupBy("token", "dict_id", "entry_seq").agg(F.collect_list("at").alias("at")), measured, _totals(measured))


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows with their words, the different words of each and the places that each has."""
    for batch in batches:
        words = batch.column("words")
        lengths = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        table, codes, ends = coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.cumsum(lengths)
        row, at = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
        order = np.argsort(row * (len(table) + 1) + codes, kind="stable")
        order = order[~np.asarray(table.to_numpy(zero_copy_only=False) == "")[codes[order]]]
        row, codes, at = row[order], codes[order], at[order]
        first = np.flatnonzero(np.diff(row, prepend=-1).astype(bool) | np.diff(codes, prepend=-1).astype(bool))
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(at, pa.int32()))
        found = pa.StructArray.from_arrays([table.take(pa.array(codes[first])), places], ["token", "at"])
        inverted = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(len(lengths) + 1)), pa.int32()), found)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in range(3)), pa.array(lengths - 1, pa.int32()), inverted], ["dict_id", "entry_seq", "headword", "length", "postings"])


def store_postings(documents: DataFrame, path: str, partitions: int | None = None) -> None:
    """The inverted index of documents (dict_id, entry_seq, headword, definition), sorted by token, so a search reads the
    row groups of its words. Frequent tokens are spread over partitions by document.

    Texts are read once: each document's own postings are stored aside, in a row, and lengths and the sorted index are
    made of these rows."""
    spark, setting = documents.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    words = documents.select("dict_id", "entry_seq", "headword", _sequence().alias("words"))
    kinds = [*words.schema.fields[:3], T.StructField("length", T.IntegerType()), T.StructField("postings", T.ArrayType(T.StructType().add("token", "string").add("at", T.ArrayType(T.IntegerType()))))]
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(512, int(before)) if int(before) > 0 else 512)
    try:
        words.mapInArrow(_invert, T.StructType(kinds)).write.parquet(f"{path}/inverted")
    finally:
        spark.conf.set(setting, before)
    inverted = spark.read.schema(T.StructType(kinds)).parquet(f"{path}/inverted")
    entries = inverted.select("dict_id", "entry_seq", F.explode("postings").alias("p")).select("p.token", "dict_id", "entry_seq", "p.at")
    if inverted.groupBy("dict_id", "entry_seq").count().where("count > 1").limit(1).count():
        entries = entries.groupBy("token", "dict_id", "entry_seq").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("at"))
    key = ["token", "dict_id", "entry_seq"]
    spread = entries.repartitionByRange(partitions, *key) if partitions else entries.repartitionByRange(*key)
    spread.sortWithinPartitions(*key).write.parquet(f"{path}/entries")
    inverted.select("dict_id", "entry_seq", "headword", "length").write.parquet(f"{path}/documents")
    _totals(spark.read.parquet(f"{path}/documents")).write.parquet(f"{path}/totals")
    delete(spark, f"{path}/inverted")


def postings(spark: SparkSession, path: str) -> Postings:
    return Postings(
        spark.read.schema("token string, dict_id string, entry_seq long, at array<int>").parquet(f"{path}/entries"),
        spark.read.schema("dict_id string, entry_seq long, headword string, length int").parquet(f"{path}/documents"),
        spark.read.schema("dict_id string, n long, average double").parquet(f"{path}/totals"),
    )


def _hits(entries: DataFrame, words: list[str]) -> DataFrame:
    """(dict_id, entry_seq, hits): starts of the phrase. The places of each word imply starts, and a start that all words
    imply is a match, so no posting is joined with another, and a document's places stay in its row."""
    different = list(dict.fromkeys(words))
    entries = entries.where(F.col("token").isin(different))
    if len(words) == 1:
        return entries.select("dict_id", "entry_seq", F.size("at").cast("long").alias("hits"))
    places = [F.first(F.when(F.col("token") == w, F.col("at")), ignorenulls=True).alias(f"at{k}") for k, w in enumerate(different)]
    both = entries.groupBy("dict_id", "entry_seq").agg(*places)
    before = lambda n: lambda at: at - F.lit(n)
    starts = [F.transform(f"at{different.index(w)}", before(n)) for n, w in enumerate(words)]
    return both.select("dict_id", "entry_seq", F.size(reduce(F.array_intersect, starts)).cast("long").alias("hits")).where("hits > 0")


def search(source: DataFrame | Postings, query: str, limit: int = LIMIT_EACH) -> DataFrame:
    """(dict_id, entry_seq, headword, rank_score, place): each dictionary's best matches of a phrase in (headword,
    definition), best first; lower scores are better, ties go to the earlier entry. source: the stored index, or
    documents (dict_id, entry_seq, headword, definition)."""
    words = phrase(query)
    if not words:
        empty = source.documents if isinstance(source, Postings) else source
        return empty.limit(0).select("dict_id", "entry_seq", "headword", F.lit(0.0).alias("rank_score"), F.lit(0).alias("place"))
    index = source if isinstance(source, Postings) else _as_postings(source, words)
    found = _hits(index.entries, words).join(index.documents, ["dict_id", "entry_seq"])
    counted = found.groupBy("dict_id").agg(F.count("*").alias("df"))
    weights = index.totals.join(counted, "dict_id").select("dict_id", "average", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    idf = F.when(F.col("idf") <= 0, F.lit(LEAST_IDF)).otherwise(F.col("idf"))
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.col("average"))
    score = -idf * F.col("hits") * (K1 + 1) / (F.col("hits") + norm)
    scored = found.join(weights, "dict_id").withColumn("rank_score", score)
    place = F.row_number().over(Window.partitionBy("dict_id").orderBy("rank_score", "entry_seq"))
    return scored.withColumn("place", place).where(F.col("place") <= limit).select("dict_id", "entry_seq", "headword", "rank_score", "place")


def merged(found: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """Matches of all dictionaries in order of discovery, each dictionary's by rank."""
    return found.join(dictionaries.select("dict_id", "dict_seq", "name"), "dict_id").orderBy("dict_seq", "place")


def frequencies(index: Postings) -> DataFrame:
    """(token, documents, occurrences) over both columns."""
    return index.entries.groupBy("token").agg(F.count("*").alias("documents"), F.sum(F.size("at")).cast("long").alias("occurrences"))


def snippet(text: str | None, words: list[str], size: int = SNIPPET) -> str:
    """The window of ``size`` tokens with the most of the phrase, its hits marked.

    Windows centre on hits, or begin at the start of the sentence that a hit is in, which is preferred; the text
    before a window that isn't at the beginning, and behind one that isn't at the end, is an ellipsis.
    """
    text = text or ""
    spans = _spans(text)
    names, n, k = [t for t, _, _ in spans], len(spans), len(words)
    hits = [i for i in range(n - k + 1) if k and names[i : i + k] == words]
    sentences = [i for i, (_, a, _) in enumerate(spans) if i == 0 or text[:a].rstrip(" \t\n\r")[-1:] in (".", ":")]

    def worth(start: int) -> tuple[int, int]:
        inside = [h for h in hits if start <= h < start + size]
        if not inside:
            return 0, 0
        centred = inside[0] - int((size - (inside[-1] + k - inside[0])) / 2)
        return 1000 + len(inside) - 1, max(0, min(centred, n - size))

    best, begin = 0, 0
    for h in hits:
        value, centred = worth(h)
        if value > best:
            best, begin = value, centred
        if n > size:
            sentence = max(s for s in sentences if s <= h)
            if sentence < h:
                value = worth(sentence)[0] + (120 if sentence == 0 else 100)
                if value > best:
                    best, begin = value, sentence
    if not n:
        return text
    end = min(begin + size, n)
    out, at = [MORE] if begin else [], spans[begin][1] if begin else 0
    marked = begin
    for h in hits:
        first, last = max(h, marked), min(h + k, end)
        if h < begin or first >= last:
            continue
        out += [text[at : spans[first][1]], OPEN, text[spans[first][1] : spans[last - 1][2]], CLOSE]
        at, marked = spans[last - 1][2], last
    out += [text[at:]] if end >= n else [text[at : spans[end - 1][2]], MORE]
    return "".join(out)


def snippets(found: DataFrame, documents: DataFrame, query: str) -> DataFrame:
    """Adds the snippet of the definition. Found rows, at most the limit of each dictionary, go to the documents, so
    texts aren't shuffled."""
    words = phrase(query)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t, words))

    bodies = documents.select("dict_id", "entry_seq", "definition")
    return bodies.join(F.broadcast(found), ["dict_id", "entry_seq"]).select(*found.columns, "definition").withColumn("snippet", cut("definition")).drop("definition")


def highlights(text: Column) -> Column:
    """The marked parts of a snippet."""
    return F.regexp_extract_all(text, F.lit(f"{OPEN}([^<]*){CLOSE}"), F.lit(1))
