"""Queries of the text operators over the whole of their tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import ball_kmeans, bpe, filter_audit, fingerprints, packing, pii, secrets, toxicity, url_filter
from wayfold.llm.common import count_kind, spans_text, table
from wayfold.llm.exact_dedup import exact_groups
from wayfold.llm.near_dedup import near_groups
from wayfold.llm.suffix_dedup import repeat_digests
from wayfold.llm.vector_dedup import vector_links

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

# The rules that the url contract names.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The block list that decides where no rule fits.
BLOCKED = (("ads.example.net", "/"), ("tracker.example.net", "/"), ("malware.test", "/"), ("phishing.invalid", "/"), ("example.net", "/redirect"))


def with_digests(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind> of the base spans, their digest, and all spans as text."""
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *(count_kind(spans, k).alias(f"n_{k}") for k in kinds),
        F.sha2(spans_text(spans, base_only=True), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(secrets.find_secrets(table(spark, sf_dir, "documents")), ("assign", "access", "hex"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(pii.find_pii(table(spark, sf_dir, "documents")), pii.BASE)


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES, BLOCKED).drop("listed")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster_digests(table(spark, sf_dir, "embeddings"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_pii_scan": op8_pii_scan,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_filter_audit": op11_filter_audit,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_fingerprints": op13_fingerprints,
}

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


def _fits(alias: str) -> str:
    return f"(p.host = {alias}.host OR ends_with(p.host, '.' || {alias}.host)) AND starts_with(p.path, {alias}.path)"



def _rounds(n: int) -> str:
    """Rounds of nearest centroids and exact rounded-down means, each a table of its own."""
    parts = []
    for k in range(n + 1):
        parts.append(f"""d{k} AS (SELECT v.vec_id, c.c, sum((v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))::BIGINT AS d
            FROM v, c{k} c, range(1, 65) t(i) GROUP BY v.vec_id, c.c),
        a{k} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{k} GROUP BY vec_id)""")
        if k < n:
            parts.append(f"""m{k} AS (SELECT a.c, i, sum(v.x[i])::BIGINT AS s, count(*) AS n FROM a{k} a JOIN v USING (vec_id), range(1, 65) t(i) GROUP BY a.c, i),
        c{k + 1} AS MATERIALIZED (SELECT c.c, coalesce((SELECT list((s - ((s % n) + n) % n) // n ORDER BY i) FROM m{k} m WHERE m.c = c.c), c.x) AS x FROM c{k} c)""")
    return ",\n        ".join(parts)


SQL: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), {LETTERS}) AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body)""",
    "op9_vector_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id
                 AND list_cosine_similarity(a.e, b.e) >= 0.9),
        reach AS (SELECT vec_id AS id, vec_id AS to_id FROM v
                  UNION SELECT reach.id, near.b FROM reach JOIN near ON reach.to_id = near.a)
        SELECT id AS vec_id, (SELECT count(*) FROM near WHERE near.a = reach.id) AS n_links,
               min(to_id) AS component_id, id = min(to_id) AS kept
        FROM reach GROUP BY id""",
    "op10_url_filter": f"""
        WITH rules(verdict, host, path) AS (VALUES {_values(RULES)}),
        listed(host, path) AS (VALUES {_values(BLOCKED)}),
        p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), {LETTERS}) AS host,
                     regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        best AS (SELECT p.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
                        arg_max(r.verdict, length(r.host || r.path)) AS verdict
                 FROM p JOIN rules r ON {_fits('r')} GROUP BY p.page_id)
        SELECT p.page_id, p.host, p.path, best.rule,
               coalesce(best.verdict, CASE WHEN EXISTS (SELECT 1 FROM listed l WHERE {_fits('l')}) THEN 'block' ELSE 'allow' END) AS verdict
        FROM p LEFT JOIN best USING (page_id)""",
    "op11_filter_audit": f"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
                          regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        f AS (SELECT doc_id, part,
                     [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
                      100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body),
                      regexp_matches(body, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false)] AS fails FROM t),
        marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        counted AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
                    FROM f LEFT JOIN marks USING (doc_id) GROUP BY part, fails),
        orders(filter_order) AS (VALUES {_values((''.join(p),) for p in permutations(filter_audit.FILTERS))}),
        steps AS (SELECT filter_order, step::INT AS step, ascii(filter_order[step]) - 64 AS own,
                         list_transform(range(1, step), lambda k: ascii(filter_order[k]) - 64) AS before FROM orders, range(1, 6) r(step)),
        met AS (SELECT part, filter_order, step, n, good, toxic, fails[own] AS fail,
                       len(list_filter(before, lambda k: fails[k])) > 0 AS earlier,
                       len(list_filter(fails, lambda x: x)) AS k FROM counted, steps)
        SELECT part, filter_order, step,
               coalesce(sum(n) FILTER (NOT fail AND NOT earlier), 0)::BIGINT AS kept,
               coalesce(sum(n) FILTER (fail AND NOT earlier), 0)::BIGINT AS removed,
               coalesce(sum(n) FILTER (fail AND earlier), 0)::BIGINT AS redundant,
               coalesce(sum(n) FILTER (fail AND k = 1), 0)::BIGINT AS unique_fails,
               coalesce(sum(good) FILTER (fail AND NOT earlier), 0)::BIGINT AS good_lost,
               coalesce(sum(toxic) FILTER (fail AND NOT earlier), 0)::BIGINT AS toxic_lost,
               (sum(coalesce(sum(n) FILTER (fail AND NOT earlier), 0)) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley
        FROM met GROUP BY part, filter_order, step""",
    "op12_ball_kmeans": f"""
        WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, x FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8),
        {_rounds(10)}
        SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c10.x, ',')) AS centroid_sha256
        FROM a10 a JOIN c10 ON a.c = c10.c""",
}
