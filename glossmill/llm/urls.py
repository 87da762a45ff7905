"""URL filter rules fetched by their rarest literal token; only fetched rules run their regular expressions.

A rule names a host and the beginning of a path, or patterns of either. Its literal tokens are its host labels, its
whole path segments and, for patterns, words that every match has. Of each rule the token that the fewest URLs have
(ties: the least) is its index key, by which tokens of a URL fetch it; a rule without a token is fetched for every
URL. A small index is an expression, so URLs aren't shuffled; a larger one is joined. Everything is built-in column
expressions.

Cases: a null url, or one without "://", has an empty host and path and gets the default verdict unless a rule
without tokens fits. Repeated rows are judged one by one. No rows: no rows. Columns named host, path, rule or
verdict are replaced; all others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules the index is broadcast (some 20 MB at most); more are joined by a shuffle.
BROADCAST_RULES = 100_000
#: Up to so many rules the index is part of the expression itself.
INLINE_RULES = 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """host: this host and its subdomains, or else host_pattern, a regular expression searched in the host, with the
    words (between dots and hyphens) that every match has. path: the beginning of the path, and path_pattern, a regular
    expression searched in it, with the words (of letters and digits) that every match has. Higher priority wins, then
    the longer of host + path, then the name."""

    name: str | None
    verdict: str
    host: str = ""
    path: str = ""
    host_pattern: str = ""
    words: tuple[str, ...] = ()
    priority: int = 1
    path_pattern: str = ""
    path_words: tuple[str, ...] = ()

    def host_regex(self) -> str:
        return self.host_pattern or (rf"(?s)\A(?:.*\.)?{_quoted(self.host)}\z" if self.host else "")

    def path_regex(self) -> str:
        begins = rf"\A{_quoted(self.path)}"
        return rf"\A(?=(?s:.*?)(?:{self.path_pattern})){_quoted(self.path)}" if self.path_pattern else begins

    def tokens(self) -> list[str]:
        labels = [f"h:{x}" for x in self.host.split(".") if x]
        return labels + [f"p:{x}" for x in self.path.split("/")[1:-1] if x] + [f"w:{x}" for x in self.words] + [f"q:{x}" for x in self.path_words]

    def rank(self) -> tuple:
        return self.priority, len(self.host) + len(self.path), self.name or ""


def _quoted(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z\x80-\U0010ffff])", r"\\\1", text)


#: The method's own judgement of hosts that no other rule names: words that unwanted sites carry.
OWN_RULES = tuple(Rule(None, "block", host_pattern=rf"(?:\A|[.-]){w}(?:[.-]|\z)", words=(w,), priority=0) for w in ("ads", "bets", "casino", "pills", "spam", "track"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens, and the empty one by which rules without tokens are fetched."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    words = F.transform(F.split(host, "[.-]"), lambda x: F.concat(F.lit("w:"), x))
    parts = F.transform(F.split(path, r"[^\p{L}\p{N}]+"), lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.concat(F.array(F.lit("")), labels, segments, words, parts))


def rules_of(table: DataFrame) -> list[Rule]:
    """Rules from a table with the fields of Rule as columns (those that it hasn't have their defaults); rules are lists
    that people keep, and more than some 100,000 should be split by priority and judged one list after another."""
    names = [c for c in table.columns if c in Rule.__dataclass_fields__]
    return [Rule(**{n: tuple(v) if isinstance(v, list) else v for n, v in zip(names, r, strict=True) if v is not None or n == "name"}) for r in table.select(*names).toLocalIterator()]


def judge(urls: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """Appends host, path, rule and verdict. With more than INLINE_RULES rules, rows are shuffled with their columns, so
    select what is needed."""
    spark = urls.sparkSession
    urls = urls.drop("host", "path", "rule", "verdict")
    ranked = sorted({*rules, *OWN_RULES}, key=Rule.rank)
    parts = urls.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    held = {t for r in ranked for t in r.tokens()}
    asked = spark.createDataFrame([(t,) for t in sorted(held)], "token string")
    # Counted over all URLs, but only for the tokens that rules have.
    seen = parts.select(F.explode(tokens_of(F.col("host"), F.col("path"))).alias("token"))
    counted = {r["token"]: r["n"] for r in seen.join(_small(asked, len(held)), "token").groupBy("token").agg(F.count("*").alias("n")).collect()}
    index = []
    for n, r in enumerate(ranked):
        key = min(((counted.get(t, 0), t) for t in r.tokens()), default=(0, ""))[1]
        index.append((key, n, r.name, r.verdict, r.host_regex(), r.path_regex()))
    if len(ranked) <= INLINE_RULES:
        return _inline(parts, index, default)
    index = spark.createDataFrame(index, "key string, rank int, rule string, verdict string, host_regex string, path_regex string")
    index = _small(index, len(ranked))
    fetched = parts.withColumn("__row", F.monotonically_increasing_id()).withColumn("__token", F.explode(tokens_of(F.col("host"), F.col("path"))))
    fetched = fetched.join(index.select("key", "rank", "host_regex", "path_regex"), F.col("__token") == F.col("key"), "left")
    fits = F.expr("rank is not null and regexp(path, path_regex) and regexp(host, host_regex)")
    best = fetched.groupBy("__row", *[F.col(f"`{c}`") for c in parts.columns]).agg(F.max(F.when(fits, F.col("rank"))).alias("__rank"))
    verdicts = index.select(F.col("rank").alias("__rank"), "rule", "verdict")
    return best.join(verdicts, "__rank", "left").select(*[F.col(f"`{c}`") for c in parts.columns], "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _inline(parts: DataFrame, index: list[tuple], default: str) -> DataFrame:
    """The rules of each of a URL's tokens from a literal map, tried from left to right; the highest rank that fits stays."""
    by_key: dict[str, list[tuple]] = {}
    for key, rank, _, _, host, path in index:
        by_key.setdefault(key, []).append((rank, host, path))
    of = lambda rank, host, path: F.struct(F.lit(rank).alias("rank"), F.lit(host).alias("host"), F.lit(path).alias("path"))
    fetch = F.create_map(*[x for key, rules in by_key.items() for x in (F.lit(key), F.array(*[of(*r) for r in rules]))])
    known = F.array_intersect(tokens_of(F.col("host"), F.col("path")), F.array(*[F.lit(k) for k in by_key]))

    def tried(best: Column, rule: Column) -> Column:
        return F.when((rule["rank"] > best) & F.regexp(F.col("path"), rule["path"]) & F.regexp(F.col("host"), rule["host"]), rule["rank"]).otherwise(best)

    best = F.aggregate(known, F.lit(-1), lambda best, token: F.aggregate(F.element_at(fetch, token), best, tried))
    names = F.create_map(*[x for _, rank, name, _, _, _ in index for x in (F.lit(rank), F.lit(name).cast("string"))])
    verdicts = F.create_map(*[x for _, rank, _, verdict, _, _ in index for x in (F.lit(rank), F.lit(verdict))])
    found = parts.withColumn("__rank", best)
    columns = [F.col(f"`{c}`") for c in parts.columns]
    return found.select(*columns, F.when(F.col("__rank") >= 0, names[F.col("__rank")]).alias("rule"), F.when(F.col("__rank") >= 0, verdicts[F.col("__rank")]).otherwise(default).alias("verdict"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_RULES else df
