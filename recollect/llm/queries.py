"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import (
    byte_bpe, collocations, embedding_dedup, embedding_whitening, jaccard_join, kdtree_shards, language_id, license_scan,
    line_dedup, page_text, source_mix, topk_search, url_filter,
)
from recollect.llm.common import read_table

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
# Fixed values of the contract.
URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op1_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; eight shards of near-equal bytes."""
    return kdtree_shards.shard_documents(read_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and of decoded bytes, per document."""
    docs = read_table(spark, sf_dir, "documents")
    return byte_bpe.encode_digests(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or that of its directory."""
    return license_scan.document_licences(read_table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.95."""
    found = embedding_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors for every vector whose id is divisible by 50."""
    return topk_search.top_k(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "id % 50 = 0")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of linked documents, three words and 90 %."""
    return jaccard_join.near_copies(read_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return page_text.extract(read_table(spark, sf_dir, "pages"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of every document."""
    return source_mix.mixture(read_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of every vector."""
    return embedding_whitening.whitened_vectors(read_table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and dropped lines of every document, and a digest of what stays."""
    return line_dedup.line_digests(read_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of every language."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: query for name, query in list(globals().items()) if name.startswith("op") and name[2].isdigit()
}

# Components of the pairs in ``links`` (a, b), by the ids in ``nodes``.
_REACHED = """
        pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reached AS (
            SELECT id AS start, id AS met FROM nodes
            UNION SELECT r.start, b.b FROM reached r JOIN pairs b ON b.a = r.met)"""

LLM_ORACLE: dict[str, str] = {
    "op5_embedding_dedup": f"""
        WITH RECURSIVE points AS (
            SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT p.id AS a, q.id AS b FROM points p JOIN points q ON p.id < q.id AND len(p.v) = len(q.v)
            WHERE list_cosine_similarity(p.v, q.v) >= 0.95),
        nodes AS (SELECT vec_id AS id FROM embeddings), {_REACHED},
        counts AS (SELECT a AS id, count(*) AS n FROM pairs GROUP BY a)
        SELECT start AS vec_id, coalesce(any_value(n), 0) AS n_links, min(met) AS component_id, start = min(met) AS kept
        FROM reached LEFT JOIN counts ON counts.id = start GROUP BY start""",
    "op6_topk_search": """
        WITH points AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
                   CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
            FROM points q JOIN points d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        WHERE rank <= 5""",
    "op12_line_dedup": """
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        placed AS (
            SELECT doc_id, text, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM texts),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM placed),
        repeated AS (
            SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        judged AS (
            SELECT k.*, r.key IS NOT NULL AND k.doc_id < r.last AS dropped FROM keyed k LEFT JOIN repeated r ON r.key = k.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id, text""",
    "op13_collocations": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents),
        words AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda w: w <> '') AS w FROM pieces),
        totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
        grams AS (
            SELECT lang, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
            FROM words, (VALUES (1), (2), (3), (4)) AS sizes(m) WHERE len(w) >= m),
        counts AS (SELECT lang, phrase, count(*) AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= 30),
        candidates AS (
            SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE contains(phrase, ' ')),
        cuts AS (SELECT *, unnest(range(1, len(w))) AS k FROM candidates),
        scored AS (
            SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (2000000 * c.a::HUGEINT) // (l.f + r.f) AS score
            FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
            JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
        lowest AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored)
            WHERE place = 1),
        lengths AS (SELECT *, unnest(range(2, len(w))) AS m FROM candidates),
        inner_phrases AS (
            SELECT lang, a, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
            FROM lengths),
        longer AS (SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY lang, phrase),
        kept AS (
            SELECT s.* FROM lowest s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase
            WHERE o.most IS NULL OR 100 * o.most < 80 * s.a),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op7_jaccard_join": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        sets AS (
            SELECT id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
            FROM words),
        grams AS (SELECT id, len(s) AS n, unnest(s) AS g FROM sets),
        links AS (
            SELECT p.id AS a, q.id AS b FROM grams p JOIN grams q ON p.g = q.g AND p.id < q.id
                AND 10 * p.n >= 9 * q.n AND 10 * q.n >= 9 * p.n
            GROUP BY p.id, q.id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
        nodes AS (SELECT DISTINCT id FROM sets), {_REACHED}
        SELECT start AS doc_id, any_value(len(s)) AS n_shingles, min(met) AS component_id
        FROM reached JOIN sets ON sets.id = start GROUP BY start""",
}
