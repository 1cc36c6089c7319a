"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import SPACE, table

#: The fixed rules of the url query: host, path, verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Where the SQL twin, which is left as it is, departs from the rules: it blocks net/de/.
_SQL_VERDICTS = {("net", "/de/"): "block"}
SHARDS = [f"shard-{i:02d}" for i in range(16)]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import score_toxicity

    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out).withColumnRenamed("__doc_id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .quality import judge_quality

    judged = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("__doc_id").alias("doc_id"), F.col("__lang").alias("lang"), "perplexity", "threshold", "trusted", "kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import place

    return place(table(spark, sf_dir, "documents").select("doc_id"), SHARDS).select("doc_id", "slot", "shard")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import overlap_report

    return overlap_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {_RULE_LIST} AS rules(host, path, verdict)"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_mixing": op3_mixing,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality": op6_quality,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_secret_scan": op10_secret_scan,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_centroids": op13_centroids,
    "pipeline": pipeline,
}

_SHARD_LIST = ", ".join(f"('{s}', {i})" for i, s in enumerate(SHARDS))
_RULE_LIST = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_SQL_RULE_LIST = ", ".join(f"('{h}', '{p}', '{_SQL_VERDICTS.get((h, p), v)}')" for h, p, v in URL_RULES)
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Links and components of small tables; every pair that shares a shingle is counted.
_JACCARD = f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^{SPACE}]+') AS w FROM documents),
        e AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))
                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s FROM d),
        x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM e),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
                 AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2),
        links AS (SELECT a, b FROM met WHERE 100 * shared >= 80 * (na + nb - shared)),
        reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM e JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

_TEST_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OVERLAP = f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TEST_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
        b AS (SELECT row_number() OVER () AS i, coalesce(item_id::VARCHAR, '') AS id, {_TEST_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
        bm AS (SELECT *, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
        bw AS (SELECT i, id, m, s, list_slice(w, s, s + m - 1) AS g FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM bm)),
        dw AS (SELECT r, m, p, list_slice(w, p, p + m - 1) AS g FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM bm))),
        hit AS (SELECT r, p, m, i, id, s FROM dw JOIN bw USING (m, g)),
        words AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, p + unnest(range(m)) AS place FROM (SELECT DISTINCT r, p, m FROM hit)) GROUP BY r),
        items AS (SELECT r, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hit GROUP BY r),
        runs AS (SELECT r, min(p) AS begin, max(p + m) - min(p) AS size FROM (SELECT *, p - row_number() OVER (PARTITION BY r, i, s - p ORDER BY p) AS run FROM hit) GROUP BY r, i, s - p, run),
        best AS (SELECT r, max(size) AS longest, min(begin) FILTER (size = top) - 1 AS longest_start FROM (SELECT *, max(size) OVER (PARTITION BY r) AS top FROM runs) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::INTEGER AS longest, coalesce(longest_start, -1)::INTEGER AS longest_start
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN best USING (r)"""



def _centroid_sql(k: int = 8, rounds: int = 10) -> str:
    """All distances in every round, round by round."""
    assign = """a{r} AS MATERIALIZED (SELECT n, (arg_min(struct_pack(j := j, d := d), struct_pack(d := d, j := j))).j AS j, min(d) AS d
             FROM (SELECT n, j, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM x, c{r}) GROUP BY n)"""
    update = """c{r} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{b} c LEFT JOIN (
             SELECT j, list(floor(s / cnt::DOUBLE)::BIGINT ORDER BY i) AS c FROM (
               SELECT j, i, sum(e)::BIGINT AS s, count(*) AS cnt FROM (SELECT a.j, unnest(x.v) AS e, unnest(range(len(x.v))) AS i FROM a{b} a JOIN x USING (n)) GROUP BY j, i) GROUP BY j) m USING (j))"""
    steps = [assign.format(r=0)]
    for r in range(1, rounds + 1):
        steps += [update.format(r=r, b=r - 1), assign.format(r=r)]
    return f"""
        WITH x AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM (SELECT v, sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h FROM x ORDER BY h, v LIMIT {k})),
        {", ".join(steps)},
        f AS (SELECT vec_id, j, d, sum(d) OVER (PARTITION BY j) AS ci, sum(d) OVER () AS ti FROM a{rounds} JOIN x USING (n))
        SELECT vec_id, j::INTEGER AS cluster, d AS distance, ci::BIGINT AS cluster_inertia, ti::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM f JOIN c{rounds} USING (j)"""


#: Every anchor with every row; whole-number components, so scores are exact.
_NEGATIVES = """
        WITH x AS (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS v
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
        s AS MATERIALIZED (SELECT a.n AS a, a.vec_id AS anchor_id, b.n AS b, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM x a, x b WHERE a.vec_id % 100 = 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id) AS k FROM s WHERE same AND other_id <> anchor_id QUALIFY k <= 5),
        h AS (SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.other_id) AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
              FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 5"""

ORACLES: dict[str, str] = {
    "op11_hard_negatives": _NEGATIVES,
    "op13_centroids": _centroid_sql(),
    "op4_jaccard_join": _JACCARD,
    "op8_decontamination": _OVERLAP,
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[{SPACE}]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)""",
    "op3_mixing": f"""
        WITH d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^{SPACE}]+')), 0)::BIGINT AS size,
                          CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS skey,
                          ('0x' || substr(md5('17/' || coalesce(doc_id::VARCHAR, '') || '/' || coalesce(text, '')), 1, 15))::BIGINT AS pos FROM documents),
        s AS (SELECT skey, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY skey) AS n FROM d GROUP BY skey),
        w AS (SELECT *, list_extract([3.0, 1.0, 2.0]::DOUBLE[], (n - 1) % 3 + 1) AS w, 2.0::DOUBLE * source_size AS most FROM s),
        p AS (SELECT 1.5::DOUBLE * sum(source_size) AS pool FROM s),
        f AS (SELECT a.skey, a.most, a.w, a.most / a.w AS ratio, (SELECT sum(least(b.most, b.w * a.most / a.w)) FROM w b) <= pool AS is_full FROM w a, p),
        l AS (SELECT (max(pool) - coalesce(sum(most) FILTER (is_full), 0)) / sum(w) FILTER (NOT is_full) AS level FROM f, p),
        t AS (SELECT skey, CASE WHEN is_full THEN most ELSE w * level END AS target FROM f, l),
        r AS (SELECT doc_id, size, source_size, target, floor(target + 1e-6)::BIGINT AS budget,
                     (sum(size) OVER (PARTITION BY skey ORDER BY pos, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
              FROM d JOIN w USING (skey) JOIN t USING (skey))
        SELECT doc_id, size, source_size, target,
               (CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) END)::BIGINT AS taken
        FROM (SELECT * REPLACE (source_size::BIGINT AS source_size) FROM r)""",
    "op7_sharding": f"""
        WITH RECURSIVE shards(name, i) AS (VALUES {_SHARD_LIST}),
        prefs AS (SELECT list(a ORDER BY i) AS starts, list(b ORDER BY i) AS steps FROM (
            SELECT i, ('0x' || substr(md5(name || '/start'), 1, 8))::BIGINT % 1601 AS a, ('0x' || substr(md5(name || '/step'), 1, 8))::BIGINT % 1600 + 1 AS b FROM shards)),
        fill(n, taken, slot) AS (
            SELECT 0, []::BIGINT[], -1::BIGINT
            UNION ALL
            SELECT n + 1, list_append(taken, pick), pick FROM (
                SELECT n, taken, list_filter(list_transform(range(1601), lambda j: (starts[n % 16 + 1] + j * steps[n % 16 + 1]) % 1601), lambda s: NOT list_contains(taken, s))[1] AS pick
                FROM fill, prefs WHERE n < 1601)),
        owner AS (SELECT slot, (n - 1) % 16 AS i FROM fill WHERE n > 0)
        SELECT doc_id, slot::INTEGER AS slot, name AS shard
        FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 1601 AS slot FROM documents) JOIN owner USING (slot) JOIN shards USING (i)""",
    "op9_url_filter": f"""
        WITH rules(rhost, rpath, rverdict) AS (VALUES {_SQL_RULE_LIST}),
        p AS (SELECT page_id, coalesce({_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
                     coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
                     row_number() OVER () AS n FROM pages),
        f AS (SELECT n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
              FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (n)""",
}
