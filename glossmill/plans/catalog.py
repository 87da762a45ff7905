"""Registered queries of the dictionary engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.functions import headwords, text
from glossmill.operators import fulltext, history, index, lookup, scope, spans
from glossmill.plans import corpus
from glossmill.plans.registered import ORACLES, QUERIES, query  # noqa: F401  the registry is read here too

# Common parts of the SQL. strip_accents(lower()) equals the normalised form on these tables.
_DICTS = """dicts AS (SELECT DISTINCT source || '/' || lang AS dict_id, lang AS source_lang, 'en' AS target_lang, regexp_extract(source, '[0-9]+', 0)::INTEGER AS priority, source FROM documents),
  dictionaries AS (SELECT *, dict_id AS name, (row_number() OVER (ORDER BY dict_id))::INTEGER AS dict_seq FROM dicts)"""
_TOKENS = r"""docs AS (SELECT source || '/' || lang AS dict_id, doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM documents),
  raw AS (SELECT dict_id, doc_id, unnest(w) AS headword, unnest(range(len(w))) AS i FROM docs),
  entries AS (SELECT dict_id, doc_id * 1000000 + i AS entry_seq, headword, strip_accents(lower(headword)) AS n, doc_id AS byte_offset, length(headword)::BIGINT AS byte_length FROM raw)"""
_PARTS = "parts AS (SELECT p_brand AS dict_id, p_partkey AS entry_seq, p_name AS headword, lower(p_name) AS n FROM part)"


@query(f"WITH {_TOKENS} SELECT dict_id, entry_seq, headword, byte_offset, byte_length FROM entries WHERE n = 'etre'")
def lookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, E1."""
    return lookup.exact(corpus.stored_entries(spark, sf_dir), "Être").select("dict_id", "entry_seq", "headword", "byte_offset", "byte_length")


WORDS = ("the", "Éelle", "und", "que", "nothing-such")


@query(f"""WITH {_TOKENS}, {_DICTS}, q(word, qn) AS (VALUES ('the', 'the'), ('Éelle', 'eelle'), ('und', 'und'), ('que', 'que'), ('nothing-such', 'nothing-such'))
  SELECT word, dict_id, name, priority, (dense_rank() OVER (PARTITION BY word ORDER BY priority, dict_seq))::INTEGER AS rank, entry_seq, headword
  FROM q JOIN entries ON qn = n JOIN dictionaries USING (dict_id)""")  # fmt: skip
def lookup_all_dicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of words over all dictionaries, by priority and discovery."""
    found = lookup.exact_batch(corpus.stored_entries(spark, sf_dir), WORDS)
    return lookup.ranked(found, corpus.document_dictionaries(spark, sf_dir)).select("word", "dict_id", "name", "priority", "rank", "entry_seq", "headword")


@query(f"""WITH {_TOKENS}, {_DICTS}, m AS (SELECT dict_id FROM dictionaries WHERE name = 'src1/fr' QUALIFY row_number() OVER (ORDER BY dict_seq) = 1)
  SELECT dict_id, entry_seq, headword FROM entries WHERE n = 'que' AND dict_id IN (FROM m)""")
def lookup_one_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3."""
    return lookup.exact_in(corpus.stored_entries(spark, sf_dir), corpus.document_dictionaries(spark, sf_dir), "src1/fr", "que").select("dict_id", "entry_seq", "headword")


@query(f"WITH {_TOKENS}, d AS (SELECT DISTINCT headword, n FROM entries WHERE starts_with(n, 'ele') ORDER BY n, headword LIMIT 100) SELECT headword FROM d")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4, E2, O4."""
    return lookup.prefix(corpus.stored_entries(spark, sf_dir), "Elé")


@query(f"WITH {_TOKENS}, d AS (SELECT headword, min(entry_seq) AS f FROM entries WHERE n LIKE 'en_re%' GROUP BY headword ORDER BY f, headword LIMIT 200) SELECT headword FROM d")
def wildcard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5, Q7."""
    return lookup.wildcard(corpus.stored_entries(spark, sf_dir), "en?re*")


@query(f"""WITH {_PARTS}, f AS (SELECT dict_id, headword, min(entry_seq) AS first FROM parts WHERE n LIKE '%b_l%' GROUP BY ALL),
  r AS (SELECT headword, row_number() OVER (PARTITION BY dict_id ORDER BY first, headword) AS p FROM f) SELECT DISTINCT headword FROM r WHERE p <= 200""")
def wildcard_all_dicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6."""
    return lookup.wildcard_everywhere(corpus.part_entries(spark, sf_dir), "*b?l*")


@query(f"""WITH {_TOKENS}, c AS (SELECT n, count(DISTINCT dict_id) AS dict_count FROM entries GROUP BY n)
  SELECT DISTINCT headword, n AS headword_normalized, dict_count FROM entries JOIN c USING (n)""")
def completion_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    return lookup.completion_index(corpus.stored_entries(spark, sf_dir))


@query(f"""WITH {_TOKENS}, c AS (SELECT n, count(DISTINCT dict_id) AS dict_count FROM entries GROUP BY n), d AS (SELECT DISTINCT headword, n, dict_count FROM entries JOIN c USING (n)
  WHERE starts_with(n, 'the') ORDER BY n, headword LIMIT 200) SELECT headword, dict_count, CASE WHEN dict_count > 1 THEN ' (' || dict_count || ' dicts)' ELSE '' END AS note FROM d""")
def completion_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8, Q9."""
    return lookup.complete(corpus.stored_completions(spark, sf_dir), "The")


@query(f"""WITH {_PARTS}, d AS (SELECT DISTINCT dict_id, headword, n FROM parts WHERE starts_with(n, 'blu')),
  r AS (SELECT dict_id, headword, row_number() OVER (PARTITION BY dict_id ORDER BY n, headword) AS p FROM d) SELECT headword, count(DISTINCT dict_id) AS dict_count FROM r WHERE p <= 200 GROUP BY headword""")
def completion_without_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9's way without the unified index."""
    return lookup.complete_without_index(corpus.part_entries(spark, sf_dir), "blu")


@query(f"WITH {_TOKENS}, {_DICTS} SELECT dict_id, entry_seq, headword FROM entries WHERE n = 'de' AND dict_id IN (SELECT dict_id FROM dictionaries WHERE source_lang = 'es' AND target_lang = 'en')")
def scope_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10 by languages."""
    inside = scope.in_scope(corpus.document_dictionaries(spark, sf_dir), source="es", target="en")
    return lookup.exact(corpus.stored_entries(spark, sf_dir), "de").join(inside, "dict_id", "left_semi").select("dict_id", "entry_seq", "headword")


GROUPS = {"romance": ("src0/fr", "src1/es", "src2/fr", "missing")}


@query(f"WITH {_TOKENS} SELECT dict_id, entry_seq, headword FROM entries WHERE n = 'la' AND dict_id IN ('src0/fr', 'src1/es', 'src2/fr', 'missing')")
def scope_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10 by a group, J5."""
    inside = scope.in_scope(corpus.document_dictionaries(spark, sf_dir), GROUPS, group="romance")
    return lookup.exact(corpus.stored_entries(spark, sf_dir), "la").join(inside, "dict_id", "left_semi").select("dict_id", "entry_seq", "headword")


@query("SELECT DISTINCT lang AS source_lang FROM documents WHERE lang <> '' ORDER BY 1")
def source_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    return scope.languages(corpus.document_dictionaries(spark, sf_dir))


@query("SELECT DISTINCT 'en' AS target_lang FROM documents WHERE lang = 'fr'")
def target_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 for one source."""
    return scope.languages(corpus.document_dictionaries(spark, sf_dir), "target", "fr")


@query(f"WITH {_TOKENS} SELECT dict_id, count(*) AS entries FROM entries GROUP BY dict_id")
def entry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return index.entry_counts(corpus.stored_entries(spark, sf_dir))


@query(f"WITH {_TOKENS}, q(word, qn) AS (VALUES ('the', 'the'), ('que', 'que'), ('und', 'und')) SELECT word, count(DISTINCT dict_id) AS dict_count FROM q JOIN entries ON qn = n GROUP BY word")
def lookup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return history.logged(lookup.exact_batch(corpus.stored_entries(spark, sf_dir), ("the", "que", "und")))


@query("SELECT user_id::VARCHAR AS dict_id, event_type AS key, max_by(event_id, event_id)::VARCHAR AS value FROM events GROUP BY ALL")
def metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, Q15: the last write of a key stays."""
    log = corpus.log(spark, sf_dir)
    return index.latest(log.select(F.col("user_id").cast("string").alias("dict_id"), F.col("word").alias("key"), F.col("seq").cast("string").alias("value"), "seq"))


@query("""WITH f AS (SELECT p_partkey::VARCHAR AS dict_id, CASE WHEN p_partkey % 11 <> 0 THEN p_size END AS mtime, CASE WHEN p_partkey % 7 <> 0 THEN p_size - (p_partkey % 5 = 0)::INTEGER END AS stored,
  CASE WHEN p_partkey % 3 <> 0 THEN p_size % 4 END AS entries FROM part),
  w AS (SELECT dict_id, CASE WHEN stored IS NULL THEN 'not indexed' WHEN mtime IS NULL THEN 'file missing' WHEN stored <> mtime THEN 'changed' WHEN coalesce(entries, 0) = 0 THEN 'no entries' END AS why FROM f)
  SELECT dict_id, why IS NOT NULL AS stale, why FROM w""")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11."""
    key, size = F.col("p_partkey"), F.col("p_size")
    p = corpus.table(spark, sf_dir, "part")
    ids = key.cast("string").alias("dict_id")
    files = p.select(ids, F.when(key % 11 != 0, size.cast("long")).alias("mtime"))
    stored = p.where(key % 7 != 0).select(ids, F.lit("mtime").alias("key"), (size - (key % 5 == 0).cast("int")).cast("string").alias("value"), F.lit(1).alias("seq"))
    counts = p.where(key % 3 != 0).select(ids, (size % 4).cast("long").alias("entries"))
    return index.staleness(files, stored, counts)


@query("SELECT p_partkey::VARCHAR AS dict_id, (p_partkey % 4 = 0 OR p_size < p_partkey % 50) AS stale FROM part")
def staleness_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12."""
    p = corpus.table(spark, sf_dir, "part").withColumn("dict_id", F.col("p_partkey").cast("string"))
    indexes = p.where(F.col("p_partkey") % 4 != 0).select("dict_id", F.col("p_size").alias("mtime"))
    return index.stale_quickly(p.select("dict_id", (F.col("p_partkey") % 50).alias("mtime")), indexes)


@query(f"""WITH {_TOKENS}, {_DICTS}, c AS (SELECT dict_id, count(*) AS e FROM entries GROUP BY dict_id)
  SELECT name, 'DSL' AS format, source_lang || ' → ' || target_lang AS languages, format('{{:,}}', coalesce(e, 0)) AS entries,
         CASE WHEN coalesce(e, 0) = 0 THEN 'Not indexed' WHEN priority % 3 = 0 THEN 'Needs reindex' ELSE 'Indexed' END AS status, '/dict/' || dict_id || '.dsl' AS path FROM dictionaries LEFT JOIN c USING (dict_id)""")
def dict_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q14, E25."""
    d = corpus.document_dictionaries(spark, sf_dir)
    stale = d.select("dict_id", (F.col("priority") % 3 == 0).alias("stale"))
    return index.listing(d, index.entry_counts(corpus.stored_entries(spark, sf_dir)), stale)


_FTS = r"""d AS (SELECT source AS dict_id, doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS t FROM documents),
  p AS (SELECT dict_id, doc_id, unnest(t) AS w, unnest(range(len(t))) AS at FROM d),
  l AS (SELECT dict_id, doc_id, len(t) + 2 AS size FROM d), n AS (SELECT dict_id, count(*) AS n, avg(size) AS a FROM l GROUP BY dict_id)"""
_RANK = """, c AS (SELECT dict_id, count(*) AS df FROM h GROUP BY dict_id),
  s AS (SELECT dict_id, doc_id, -(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / a)) AS score
        FROM h JOIN l USING (dict_id, doc_id) JOIN n USING (dict_id) JOIN c USING (dict_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY dict_id ORDER BY score, doc_id) AS place FROM s)"""
_RANKED = " SELECT dict_id, doc_id AS entry_seq, 'doc ' || doc_id AS headword, round(score, 9) AS rank_score FROM r WHERE place <= 20"


@query(f"WITH {_FTS}, h AS (SELECT dict_id, doc_id, count(*) AS f FROM p WHERE w = 'tion' GROUP BY ALL){_RANK}{_RANKED}")
def fts_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One word."""
    return fulltext.search(corpus.stored_fulltext(spark, sf_dir), "Tion").select("dict_id", "entry_seq", "headword", F.round("rank_score", 9).alias("rank_score"))


@query(f"WITH {_FTS}, h AS (SELECT x.dict_id, x.doc_id, count(*) AS f FROM p x JOIN p y ON x.doc_id = y.doc_id AND y.at = x.at + 1 WHERE x.w = 'of' AND y.w = 'the' GROUP BY ALL){_RANK}{_RANKED}")
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, F3 with a phrase; punctuation and case of the query don't count."""
    return fulltext.search(corpus.stored_fulltext(spark, sf_dir), "of-THE").select("dict_id", "entry_seq", "headword", F.round("rank_score", 9).alias("rank_score"))


_SNIPPET = r"""WITH {fts}, h AS (SELECT x.dict_id, x.doc_id, count(*) AS f FROM p x JOIN p y ON x.doc_id = y.doc_id AND y.at = x.at + 1 WHERE x.w = 'with' AND y.w = 'the' GROUP BY ALL){rank},
  g AS (SELECT dict_id, doc_id, place, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS raw, string_split_regex(text, '[\p{{L}}\p{{N}}]+') AS gap, t FROM r JOIN documents USING (doc_id) JOIN d USING (dict_id, doc_id) WHERE place <= 20),
  k AS (SELECT *, len(t) AS size, list_filter(range(0, len(t) - 1), lambda i: t[i + 1] = 'with' AND t[i + 2] = 'the') AS hits,
               list_filter(range(0, len(t)), lambda i: i = 0 OR regexp_matches(gap[i + 1], '[.:][ \t\n\r]*$')) AS starts FROM g),
  each_hit AS (SELECT *, unnest(hits) AS hit, unnest(range(len(hits))) AS nth FROM k),
  e AS (SELECT *, len(list_filter(hits, lambda x: x >= hit AND x < hit + 30)) AS many, list_max(list_filter(hits, lambda x: x < hit + 30)) AS last, list_max(list_filter(starts, lambda x: x <= hit)) AS start FROM each_hit),
  v AS (SELECT dict_id, doc_id, 2 * nth AS turn, 999 + many AS worth, greatest(0, least(hit - trunc((30 - (last + 2 - hit)) / 2.0)::BIGINT, size - 30)) AS begin FROM e
        UNION ALL SELECT dict_id, doc_id, 2 * nth + 1, CASE WHEN len(list_filter(hits, lambda x: x >= start AND x < start + 30)) > 0 THEN 999 + len(list_filter(hits, lambda x: x >= start AND x < start + 30)) ELSE 0 END + CASE WHEN start = 0 THEN 120 ELSE 100 END, start
        FROM e WHERE size > 30 AND start < hit),
  b AS (SELECT dict_id, doc_id, begin FROM v QUALIFY row_number() OVER (PARTITION BY dict_id, doc_id ORDER BY worth DESC, turn) = 1),
  z AS (SELECT *, least(begin + 30, size) AS stop FROM k JOIN b USING (dict_id, doc_id)),
  o AS (SELECT dict_id, doc_id, place, CASE WHEN begin > 0 THEN '...' ELSE '' END || array_to_string(list_transform(range(begin, stop), lambda i: CASE WHEN i > begin OR begin = 0 THEN gap[i + 1] ELSE '' END
          || CASE WHEN list_contains(hits, i) THEN '>>>' ELSE '' END || raw[i + 1] || CASE WHEN i > begin AND list_contains(hits, i - 1) OR i = stop - 1 AND list_contains(hits, i) THEN '<<<' ELSE '' END), '')
          || CASE WHEN stop >= size THEN gap[size + 1] ELSE '...' END AS snippet FROM z),
  q AS (SELECT source AS dict_id, (row_number() OVER (ORDER BY source))::INTEGER AS dict_seq FROM (SELECT DISTINCT source FROM documents))
  SELECT dict_seq, place::INTEGER AS place, dict_id, doc_id AS entry_seq, 'doc ' || doc_id AS headword, snippet, array_to_string(regexp_extract_all(snippet, '>>>([^<]*)<<<', 1), '|') AS marked FROM o JOIN q USING (dict_id)"""


@query(_SNIPPET.format(fts=_FTS, rank=_RANK))
def fts_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of all dictionaries in order of discovery, with snippets."""
    docs, stored = corpus.fulltext(spark, sf_dir), corpus.stored_fulltext(spark, sf_dir)
    dictionaries = scope.discovered(stored.totals.select("dict_id").withColumn("name", F.col("dict_id")))
    found = fulltext.snippets(fulltext.search(stored, "with the"), docs, "with the")
    return fulltext.merged(found, dictionaries).select("dict_seq", "place", "dict_id", "entry_seq", "headword", "snippet", F.array_join(fulltext.highlights(F.col("snippet")), "|").alias("marked"))


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower('doc ' || doc_id || ' ' || text)), '[\p{L}\p{N}]+') AS t FROM documents), e AS (SELECT doc_id, unnest(t) AS token FROM d)
  SELECT token, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM e GROUP BY token""")
def fts_docfreq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    return fulltext.frequencies(corpus.stored_fulltext(spark, sf_dir))


@query(r"""WITH r AS (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages),
  e AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&quot;', '"') AS t FROM r)
  SELECT page_id, trim(regexp_replace(t, '[ \t\n\r]+', ' ', 'g')) AS plain FROM e""")
def plain_text_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7."""
    return corpus.table(spark, sf_dir, "pages").select("page_id", text.plain_text(F.col("html"), "mdict").alias("plain"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10's link targets."""
    return corpus.table(spark, sf_dir, "pages").select("page_id", F.explode(text.links(F.col("html"))).alias("target"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(
  replace(replace(replace(replace(replace(html, '&amp;', '&'), '&apos;', ''''), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#[0-9]+;', '', 'g')), '\[[-a-z]+\]', '', 'g'), '[^\p{L}\p{N} ]', '', 'g'), '[ \t]+', ' ', 'g')) AS name FROM pages""")
def goldendict_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E28."""
    return corpus.table(spark, sf_dir, "pages").select("page_id", text.goldendict_normalize(F.col("html")).alias("name"))


HEADWORDS = ("colour{/}color", "go(es)", "favo{u/}rite", "real{ize/ise}", "{the }sample", r"\{curly\}", r"\(round\)", "a(b)(c)")


@query(r"""SELECT * FROM (VALUES ('colour{/}color', 1, 'colour'), ('colour{/}color', 2, 'color'), ('go(es)', 1, 'go'), ('go(es)', 2, 'goes'), ('favo{u/}rite', 1, 'favourite'), ('favo{u/}rite', 2, 'favorite'),
  ('real{ize/ise}', 1, 'realize'), ('real{ize/ise}', 2, 'realise'), ('{the }sample', 1, 'the sample'), ('\{curly\}', 1, '{curly}'), ('\(round\)', 1, '(round)'),
  ('a(b)(c)', 1, 'a'), ('a(b)(c)', 2, 'ac'), ('a(b)(c)', 3, 'ab'), ('a(b)(c)', 4, 'abc')) t(headword, place, variant)""")
def headword_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4, E5, O7."""
    rows = spark.createDataFrame([(h,) for h in HEADWORDS], "headword string")
    return rows.select("headword", F.posexplode(headwords.variants("headword")).alias("p", "variant")).select("headword", (F.col("p") + 1).alias("place"), "variant")


@query("""WITH i AS (SELECT p_brand AS dict_id, p_partkey AS byte_offset, p_size::BIGINT AS byte_length, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INTEGER AS ordinal FROM part),
  s AS (SELECT 'Brand#' || (l_suppkey % 25 + 1) AS dict_id, l_orderkey || '-' || l_linenumber AS headword, l_partkey::INTEGER AS ordinal FROM lineitem)
  SELECT dict_id, headword, ordinal, byte_offset, byte_length FROM s JOIN i USING (dict_id, ordinal)""")
def synonym_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals out of range are dropped."""
    place = (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("ordinal")
    main = corpus.table(spark, sf_dir, "part").select(F.col("p_brand").alias("dict_id"), F.col("p_partkey").alias("byte_offset"), F.col("p_size").cast("long").alias("byte_length"), place)
    line = corpus.table(spark, sf_dir, "lineitem")
    name = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    other = line.select(F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string")).alias("dict_id"), name.alias("headword"), F.col("l_partkey").cast("int").alias("ordinal"))
    return spans.synonyms(other, main).select("dict_id", "headword", "ordinal", "byte_offset", "byte_length")


_OFFSETS = "r AS (SELECT source AS dict_id, doc_id, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars) // 3 AS byte_offset FROM documents), t AS (SELECT source AS dict_id, sum(n_chars)::BIGINT AS total FROM documents GROUP BY source)"


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = corpus.table(spark, sf_dir, "documents")
    before = F.sum("n_chars").over(Window.partitionBy("source").orderBy("doc_id"))
    records = docs.select(F.col("source").alias("dict_id"), "doc_id", F.floor((before - F.col("n_chars")) / 3).alias("byte_offset"))
    return records, docs.groupBy(F.col("source").alias("dict_id")).agg(F.sum("n_chars").alias("total"))


@query(f"""WITH {_OFFSETS}, o AS (SELECT DISTINCT dict_id, byte_offset FROM r), e AS (SELECT *, lead(byte_offset) OVER (PARTITION BY dict_id ORDER BY byte_offset) AS next FROM o)
  SELECT dict_id, doc_id, byte_offset::BIGINT AS byte_offset, coalesce(next, total)::BIGINT AS end_offset FROM r JOIN e USING (dict_id, byte_offset) JOIN t USING (dict_id)""")
def record_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2."""
    return spans.record_spans(*_records(spark, sf_dir)).select("dict_id", "doc_id", "byte_offset", "end_offset")


@query(f"""WITH {_OFFSETS}, b AS (SELECT 'src' || (p_partkey % 20) AS dict_id, p_partkey AS block, p_size::BIGINT * 40 AS size FROM part),
  s AS (SELECT *, sum(size) OVER (PARTITION BY dict_id ORDER BY block) - size AS begin FROM b)
  SELECT dict_id, doc_id, r.byte_offset::BIGINT AS byte_offset, block, (byte_offset - begin)::BIGINT AS within FROM r JOIN s USING (dict_id) WHERE byte_offset >= begin AND byte_offset < begin + size""")
def record_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3."""
    blocks = corpus.table(spark, sf_dir, "part").select(F.concat(F.lit("src"), (F.col("p_partkey") % 20).cast("string")).alias("dict_id"), F.col("p_partkey").alias("block"), F.col("p_size").alias("packed"), (F.col("p_size").cast("long") * 40).alias("size"))
    found = spans.blocks_of(_records(spark, sf_dir)[0], spans.block_starts(blocks))
    return found.select("dict_id", "doc_id", "byte_offset", "block", (F.col("byte_offset") - F.col("begin")).alias("within"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey * 7 + 3) % 2003 END AS link, p_name AS body FROM part),
  w AS (SELECT k AS start, k AS target, 0 AS hops, false AS ended, NULL::VARCHAR AS body, NULL::VARCHAR AS error FROM e
        UNION ALL
        SELECT w.start, coalesce(e.link, w.target), w.hops + 1, e.link IS NULL, CASE WHEN e.link IS NULL THEN e.body END,
               CASE WHEN e.k IS NULL THEN 'Link target "' || w.target || '" not found' END FROM w LEFT JOIN e ON e.k = w.target WHERE NOT w.ended AND w.hops < 5)
  SELECT start::VARCHAR AS start, body, error, hops FROM w WHERE ended
  UNION ALL SELECT start::VARCHAR, NULL, 'redirect loop for ' || target, hops FROM w WHERE NOT ended AND hops = 5""")
def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part leads to another one but for each fourth; some chains are too long, some end nowhere."""
    p = corpus.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    link = F.when(key % 4 != 0, ((key * 7 + 3) % 2003).cast("string"))
    entries = p.select(F.lit("d").alias("dict_id"), key.cast("string").alias("headword_normalized"), key.alias("entry_seq"), F.col("p_name").alias("body"), link.alias("link"))
    starts = entries.select("dict_id", F.col("headword_normalized").alias("start"), F.col("headword_normalized").alias("target"))
    return spans.resolve_links(entries, starts).select("start", "body", "error", "hops")


@query("SELECT event_id AS seq, ts, event_type AS word FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def history_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O5, O6."""
    return history.recent(corpus.log(spark, sf_dir).select("seq", "ts", "word"))


@query("SELECT event_id AS seq, user_id, event_type AS word FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type")
def history_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word that follows itself is left out."""
    return history.without_repeats(corpus.log(spark, sf_dir)).select("seq", "user_id", "word")


@query("SELECT event_type AS headword, user_id::VARCHAR AS dictionary, min(ts) AS ts FROM events GROUP BY ALL")
def bookmark_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pair the first bookmark stays; half are there already."""
    marks = corpus.log(spark, sf_dir).select(F.col("word").alias("headword"), F.col("user_id").cast("string").alias("dictionary"), "ts")
    held = history.bookmarks_added(marks.limit(0), marks.where("cast(dictionary as int) % 2 = 0"))
    return history.bookmarks_added(held, marks)


@query("""WITH p AS (SELECT p_brand AS name, min_by(p_size, p_partkey) AS priority FROM part WHERE p_partkey % 40 = 1 GROUP BY p_brand), d AS (SELECT DISTINCT p_brand AS name FROM part),
  o AS (SELECT name, coalesce(priority, 0)::INTEGER AS priority, row_number() OVER (ORDER BY name) AS s FROM d LEFT JOIN p USING (name))
  SELECT name, priority, (row_number() OVER (ORDER BY priority, s))::INTEGER AS place FROM o""")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some brands have several priorities, of which the first counts, some none."""
    given = corpus.table(spark, sf_dir, "part").where("p_partkey % 40 = 1").select(F.col("p_brand").alias("name"), F.col("p_size").alias("priority"), F.col("p_partkey").alias("seq"))
    d = scope.with_priorities(corpus.part_dictionaries(spark, sf_dir), given)
    return d.select("name", "priority", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("priority", "dict_seq")).alias("place"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS shown FROM documents")
def eldoc_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutting is the feature."""
    return corpus.table(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text")).alias("shown"))


@query("""WITH a AS (SELECT p_name AS tag, min_by(p_type, p_partkey) AS expansion FROM part GROUP BY p_name) SELECT l_orderkey AS k, l_linenumber AS n, tag, expansion
  FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN p_name ELSE l_returnflag END AS tag FROM lineitem JOIN part ON l_partkey = p_partkey) LEFT JOIN a USING (tag)""")
def abbreviation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7."""
    p = corpus.table(spark, sf_dir, "part")
    line = corpus.table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    tags = line.select(F.lit("d").alias("dict_id"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.when(F.col("l_linenumber") % 2 == 0, F.col("p_name")).otherwise(F.col("l_returnflag")).alias("tag"))
    side = p.select(F.lit("d").alias("dict_id"), F.col("p_name").alias("key"), F.col("p_partkey").alias("seq"), F.col("p_type").alias("expansion"))
    return spans.with_abbreviations(tags, side).select("k", "n", "tag", "expansion")


@query("""WITH e AS (SELECT p_brand AS dict_id, p_partkey, p_name FROM part), r AS (SELECT DISTINCT p_brand AS from_dict, p_type || p_brand AS ref_id, p_name AS target FROM part WHERE p_size < 3),
  m AS (SELECT ref_id, from_dict, dict_id, p_partkey, p_name, max((dict_id = from_dict)::INTEGER) OVER (PARTITION BY ref_id, target) AS own FROM r JOIN e ON lower(p_name) = lower(target))
  SELECT DISTINCT ref_id, dict_id, p_partkey AS entry_seq, p_name AS headword FROM m WHERE own = 0 OR dict_id = from_dict""")
def follow_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q16 with the same dictionary first."""
    e = corpus.part_entries(spark, sf_dir)
    p = corpus.table(spark, sf_dir, "part").where("p_size < 3")
    refs = p.select(F.concat("p_type", "p_brand").alias("id"), F.col("p_brand").alias("dict_id"), F.lower("p_name").alias("target_normalized")).distinct()
    refs = refs.withColumn("ref_id", F.concat_ws("|", "id", "target_normalized"))
    found = lookup.follow(e, corpus.part_dictionaries(spark, sf_dir), refs, "same")
    return found.select(F.split_part("ref_id", F.lit("|"), F.lit(1)).alias("ref_id"), "dict_id", "entry_seq", "headword").distinct()


@query("SELECT count(*) FILTER (p_partkey % 9 <> 0) AS processed, count(*) FILTER (p_partkey % 9 = 0) AS errors, coalesce(sum(p_size) FILTER (p_partkey % 9 <> 0), 0)::BIGINT AS entries FROM part")
def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    p = corpus.table(spark, sf_dir, "part")
    return index.totals(p.select(F.col("p_partkey").alias("dict_id"), F.when(F.col("p_partkey") % 9 == 0, "failed").alias("error"), F.col("p_size").cast("long").alias("entries")))


@query("SELECT p_partkey, md5('/dict/' || p_name) AS dict_id, '━━ ' || p_name || ' ' || repeat('━', greatest(0, 66 - length(p_name))) AS header, regexp_replace(p_name || '.dsl.dz', '[.]dz$', '') || '.files.zip' AS resources FROM part")
def dictionary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3, E31, E33."""
    name = F.col("p_name")
    return corpus.table(spark, sf_dir, "part").select("p_partkey", text.dict_id(F.concat(F.lit("/dict/"), name)).alias("dict_id"), text.section_header(name).alias("header"), text.resource_zip(F.concat(name, F.lit(".dsl.dz"))).alias("resources"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events")
def time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E30."""
    return corpus.table(spark, sf_dir, "events").select("event_id", text.minute(F.col("ts")).alias("shown"))


@query("SELECT DISTINCT source || '/' || lang AS dict_id, lang || ' → en' AS label FROM documents")
def group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E27."""
    return corpus.document_dictionaries(spark, sf_dir).select("dict_id", F.col("group").alias("label"))


@query(f"WITH {_TOKENS} SELECT dict_id, entry_seq, n AS headword_normalized FROM entries")
def normalized_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised headword of every entry."""
    return index.indexed(corpus.tokens(spark, sf_dir)).select("dict_id", "entry_seq", "headword_normalized")
