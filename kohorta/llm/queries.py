"""The operators' queries over the whole tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    archives, centroid_clusters, decontamination, near_duplicates, near_vectors, packing, periodic_runs, quality_rules, repeats, token_files, token_rollup,
    url_rules, wrappers,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(docs, _table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col(f"_statistics.{n}").alias(n) for n in names], quality_rules.base_failed().alias("base_failed"), F.col("_kept").alias("kept"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(_table(spark, sf_dir, "pages"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer())


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(_table(spark, sf_dir, "pages"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return token_rollup.count_corpus(docs, _tokenizer(), "word_bpe_49k", "word_bpe_49k+end")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contained_items(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_shared", "n_item")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=repeats.WORDS)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs).withColumn("longest", periodic_runs.longest_run(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period",
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"), periodic_runs.runs_digest(F.col("runs")).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.clusters(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_quality_rules, op2_html_extraction, op3_token_files, op4_warc, op5_near_duplicates, op6_token_counts, op7_decontamination,
        op8_url_filter, op9_repeated_passages, op10_packing, op11_periodic_runs, op12_near_vectors, op13_centroid_clusters,
    )
    return {f.__name__: f for f in made}


_WHITE = r"[\x20\x09-\x0D]+"

_OP4 = f"""
WITH p AS (
  SELECT page_id, coalesce(octet_length(encode(html)), 0) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (SELECT digest, min(page_id) AS least FROM p WHERE n >= {archives.MIN_REVISIT} GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND n >= {archives.MIN_REVISIT}
"""

_OP7 = rf"""
WITH item_words AS (
  SELECT row_number() OVER () AS r, item_id, list_filter(string_split_regex(lower(text), '{_WHITE}'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL
), sized AS (SELECT *, least(len(w), 5) AS k FROM item_words WHERE len(w) > 0),
item_grams AS (
  SELECT DISTINCT r, item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS g FROM sized
), items AS (SELECT r, count(*) AS n_item FROM item_grams GROUP BY r),
doc_words AS (
  SELECT row_number() OVER () AS d, doc_id, list_filter(string_split_regex(lower(text), '{_WHITE}'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL
), doc_grams AS (
  SELECT DISTINCT d, doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS g
  FROM doc_words, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k
), hits AS (SELECT d, doc_id, r, item_id, count(*) AS n_shared FROM doc_grams JOIN item_grams USING (k, g) GROUP BY d, doc_id, r, item_id),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_shared / n_item DESC, n_shared DESC) AS place
  FROM hits JOIN items USING (r) WHERE n_shared >= ceil(n_item * 0.8 - 1e-9)
)
SELECT doc_id, item_id, n_shared, n_item FROM best WHERE place = 1
"""


_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_OP12 = f"""
WITH RECURSIVE rows_ AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings),
v AS MATERIALIZED (
  SELECT r, CAST(embedding AS DOUBLE[]) AS e FROM rows_ WHERE len(embedding) > 0 AND {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.r AS i, b.r AS j FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {near_vectors.THRESHOLD}
), reached AS (SELECT r, r AS s FROM rows_ UNION SELECT reached.r, links.j FROM reached JOIN links ON reached.s = links.i),
least AS (SELECT reached.r, min(o.vec_id) AS component_id FROM reached JOIN rows_ o ON reached.s = o.r GROUP BY reached.r),
counted AS (SELECT i AS r, count(*) AS n FROM links GROUP BY i)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM rows_ JOIN least USING (r) LEFT JOIN counted USING (r)
"""


def _cluster_sql() -> str:
    """Every round is a few tables: the vectors' clusters, and the floors of their means."""
    dims, scale, k = centroid_clusters.DIMS, centroid_clusters.SCALE, centroid_clusters.CLUSTERS
    tables = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND {_FINITE}
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('{centroid_clusters.SALT}' || vec_id) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k})
)""",
    ]
    nearest = """a{i} AS MATERIALIZED (
  SELECT r, min({{'d': d, 'c': c}}) AS best
  FROM (SELECT r, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c{i}) GROUP BY r
)"""
    mean = """s{i} AS (SELECT best.c AS c, unnest(v) AS x, unnest(range({dims})) AS place FROM a{i} JOIN v USING (r)),
f{i} AS (SELECT c, place, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM s{i} GROUP BY c, place),
c{j} AS MATERIALIZED (SELECT c, coalesce(any_value(n.m), any_value(c{i}.m)) AS m FROM c{i} LEFT JOIN (SELECT c, list(x ORDER BY place) AS m FROM f{i} GROUP BY c) n USING (c) GROUP BY c)"""
    rounds = centroid_clusters.ROUNDS
    for i in range(rounds):
        tables += [nearest.format(i=i), mean.format(i=i, j=i + 1, dims=dims)]
    tables.append(nearest.format(i=rounds))
    return f"""
WITH {", ".join(tables)}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c ON c.c = best.c
"""


def _url_sql() -> str:
    path = r"regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"
    host = r"lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'))"
    ordered = sorted(url_rules.RULES, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    case = lambda value: " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in ordered)
    hit = lambda t: rf"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')"
    terms = url_rules.read_terms()
    soft = {t: n for t, n in terms.items() if n < url_rules.LIMIT}
    count = " + ".join(f"CAST({hit(t)} AS INTEGER)" for t in soft)
    points = " + ".join(f"{n} * CAST({hit(t)} AS INTEGER)" for t, n in soft.items())
    strict = " + ".join(f"len(regexp_extract_all(u2, '(^|[^a-z0-9]){t}($|[^a-z0-9])'))" for t in terms if t not in soft)
    return f"""
WITH s AS (
  SELECT page_id, {host} AS host, {path} AS path, lower(coalesce(url, '')) AS u,
         regexp_replace(lower(coalesce(url, '')), '([^a-z0-9-])', '\\1\\1', 'g') AS u2 FROM pages
), c AS (SELECT *, CAST({strict} AS INTEGER) AS strict_hits, CAST({count} AS INTEGER) AS soft_hits, CAST({points} AS INTEGER) AS soft_points FROM s)
SELECT page_id, host, path, CASE {case(lambda r: r.name)} END AS rule,
       CASE {case(lambda r: r.verdict)} WHEN strict_hits > 0 OR soft_points >= {url_rules.LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
       strict_hits, soft_hits, soft_points
FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": _OP4, "op7_decontamination": _OP7, "op8_url_filter": _url_sql(), "op12_near_vectors": _OP12, "op13_centroid_clusters": _cluster_sql(),
    }
