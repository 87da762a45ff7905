"""The queries that apply the operators of this subpackage to their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.decontaminate import find
from glossmill.llm.html_text import extract
from glossmill.llm import licenses
from glossmill.llm.jaccard import JaccardJoin
from glossmill.llm import langid
from glossmill.llm.packing import pack
from glossmill.llm import quality
from glossmill.llm.session import read
from glossmill.llm.substrings import dedup
from glossmill.llm.topk import top_k
from glossmill.llm.urls import Rule, judge


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(n=5, percent=80).groups(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    models = langid.train(documents.where(~held))
    return langid.identify(documents.select("doc_id", "text"), models).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: their source and language are the directories, since the table has no paths."""
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    found = licenses.scan(read(spark, sf_dir, "documents").select(path.alias("path"), "text"))
    return found.select(F.regexp_extract("path", "([^/]*)[.]txt$", 1).cast("long").alias("doc_id"), "path", "license", "how", "score")


def op6_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "), F.lit(" "))
    return dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


#: The rules that the query judges by.
URL_RULES = (
    Rule("org/", "allow", "org", "/"),
    Rule("example.org/es/", "block", "example.org", "/es/"),
    Rule("example.org/en/1", "block", "example.org", "/en/1"),
    Rule("com/fr/", "allow", "com", "/fr/"),
    Rule("com/de/", "block", "com", "/de/"),
)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its host and its language the path below it, since the table has no urls."""
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), host="source", path="lang")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_license_scan": op5_license_scan,
    "op6_exact_topk_search": op6_exact_topk_search,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_html_extraction": op10_html_extraction,
}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_TOKENS = r"regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')"

ORACLES: dict[str, str] = {
    "op4_benchmark_decontamination": """
        WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS x FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS y FROM benchmark),
        p AS (SELECT doc_id, i, x[i:i + 3] AS g FROM (SELECT doc_id, x, unnest(range(1, len(x) - 2)) AS i FROM t)),
        q AS (SELECT item_id, j, y[j:j + 3] AS g FROM (SELECT item_id, y, unnest(range(1, len(y) - 2)) AS j FROM b WHERE len(y) >= 8)),
        h AS (SELECT DISTINCT doc_id, item_id, i - j AS s FROM p JOIN q USING (g)),
        m AS (SELECT h.doc_id, h.item_id, h.s, len(t.x) AS n, len(b.y) AS size, least(13, len(b.y)) AS span,
                     list_transform(range(1, len(b.y) + 1), lambda k: CASE WHEN k + h.s >= 1 AND t.x[k + h.s] = b.y[k] THEN 1 ELSE 0 END) AS same
              FROM h JOIN t USING (doc_id) JOIN b USING (item_id))
        SELECT doc_id, item_id, s::BIGINT AS first_token, (least(n, s + size) - greatest(0, s))::BIGINT AS n_aligned, list_sum(same)::BIGINT AS n_matched
        FROM m WHERE len(list_filter(range(1, size - span + 2), lambda k: list_sum(same[k:k + span - 1]) >= span - span * 2 // 13)) > 0""",
    "op5_license_scan": rf"""
        WITH f AS (SELECT doc_id, '/' || coalesce(source, '') || '/' || coalesce(lang, '') AS directory, text FROM documents WHERE doc_id IS NOT NULL),
        t(template, name, text) AS (VALUES {", ".join(f"({n}, '{name}', '{text}')" for n, (name, text) in enumerate(licenses.TEMPLATES))}),
        tt AS (SELECT template, token, count(*) AS tf FROM (SELECT template, unnest({_TOKENS}) AS token FROM t) WHERE token <> '' GROUP BY ALL),
        n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
        df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({_TOKENS})) AS token FROM documents) WHERE token IN (SELECT token FROM tt) GROUP BY token),
        idf AS (SELECT DISTINCT token, ln((1.0 + n.n) / (1.0 + coalesce(df.df, 0))) + 1 AS idf FROM tt LEFT JOIN df USING (token), n),
        u AS (SELECT template, token, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS u FROM (SELECT template, token, tf * idf AS w FROM tt JOIN idf USING (token))),
        l AS (SELECT doc_id, directory, text, unnest(string_split(text, chr(10))) AS passage FROM f),
        h AS (SELECT doc_id, directory, text, passage FROM l WHERE {" OR ".join(f"contains(lower(passage), '{w}')" for w in licenses.WORDS)}),
        c AS (SELECT passage, token, count(*) AS tf FROM (SELECT passage, unnest({_TOKENS.replace("text", "passage")}) AS token FROM (SELECT DISTINCT passage FROM h)) WHERE token <> '' GROUP BY ALL),
        w AS (SELECT passage, token, tf * coalesce(idf, ln(1.0 + n.n) + 1) AS w FROM c LEFT JOIN idf USING (token), n),
        s AS (SELECT passage, template, round(dot / norm, 6) AS score FROM (SELECT passage, template, sum(w * u) AS dot FROM w JOIN u USING (token) GROUP BY ALL)
              JOIN (SELECT passage, sqrt(sum(w * w)) AS norm FROM w GROUP BY passage) USING (passage)),
        i AS (SELECT passage, regexp_replace(regexp_extract(passage, '{licenses.IDENTIFIER}', 1), '{licenses.SUFFIX}', '') AS name FROM (SELECT DISTINCT passage FROM h)),
        b AS (SELECT passage, name, 1.0::DOUBLE AS score FROM i WHERE name <> '' UNION ALL
              SELECT passage, name, score FROM (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY score DESC, template) AS r FROM s WHERE score >= 0.6) JOIN t USING (template)
              WHERE r = 1 AND passage IN (SELECT passage FROM i WHERE name = '')),
        o AS (SELECT doc_id, directory, max(score) AS score, max_by(name, {{'s': score, 'n': name}}) AS license,
                     2 * sum(len(list_filter({_TOKENS.replace("text", "passage")}, lambda x: x <> ''))) >= max(len(list_filter({_TOKENS}, lambda x: x <> ''))) AS declares
              FROM h JOIN b USING (passage) GROUP BY doc_id, directory),
        d AS (SELECT directory AS at, max_by(license, {{'s': score, 'n': license}}) AS declared FROM o WHERE declares GROUP BY directory)
        SELECT f.doc_id, f.directory || '/' || f.doc_id || '.txt' AS path, coalesce(o.license, d.declared) AS license,
               CASE WHEN o.license IS NOT NULL THEN 'own' WHEN d.declared IS NOT NULL THEN 'inherited' END AS how, o.score
        FROM f LEFT JOIN o USING (doc_id) LEFT JOIN d ON d.at = f.directory""",
    "op6_exact_topk_search": f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings WHERE {_FINITE}),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
        r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10""",
    "op8_url_filters": """
        WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r(rule, verdict, h, p) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
             ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/'))
        SELECT page_id, host, path, m.rule, coalesce(m.verdict, CASE WHEN regexp_matches(host, '(^|[.-])(ads|bets|casino|pills|spam|track)([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
        FROM u LEFT JOIN LATERAL (SELECT rule, verdict FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
                                  ORDER BY length(h) + length(p) DESC, rule DESC LIMIT 1) m ON true""",
    "op2_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("text", _LOWER)} AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) END AS g FROM d),
        p AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
        l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id <> y.doc_id
              GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
        r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, m.c AS component_id FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = s.doc_id""",
    "op7_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        p AS (SELECT doc_id, len(w) AS n, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        g AS (SELECT doc_id, i, w[i:i + 12] AS s FROM p WHERE i + 12 <= n),
        f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
        c AS (SELECT DISTINCT g.doc_id, g.i + o.j AS i FROM g JOIN f USING (s), (SELECT unnest(range(0, 13)) AS j) o WHERE f.first < g.doc_id),
        k AS (SELECT p.doc_id, count(c.i) AS n_removed, coalesce(string_agg(CASE WHEN c.i IS NULL THEN p.w[p.i] END, ' ' ORDER BY p.i), '') AS kept
              FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
}
