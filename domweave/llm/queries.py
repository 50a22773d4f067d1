"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from domweave.llm import (
    ann, decontaminate, jaccard_join, license_scan, lm_score, near_vectors, packing, token_counts, toxicity, url_filter, vector_codes, warc, whitening,
)
from domweave.llm.registry import query, table
from domweave.session import work_dir

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op2_url_filter")
def op2(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES)


@query("op3_decontamination")
def op3(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_license_scan")
def op4(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("notices")


@query("op7_ngram_jaccard_join")
def op7(spark, sf_dir):
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"), length=4, percent=85)


@query("op8_best_fit_packing")
def op8(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_vocabulary()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence_id"), "offset")


@query("op6_toxicity")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int"))


@query("op5_lm_scoring")
def op5(spark, sf_dir):
    return lm_score.score_texts(table(spark, sf_dir, "documents"))


@query("op1_token_counts")
def op1(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), piece_vocabulary())


@query("op9_warc", sql="""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest,
                 max(page_id) OVER (PARTITION BY html) AS last FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
    FROM d
""")
def op9(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"), work_dir(spark, "archives")).drop("problem")


@query("op10_nearest_neighbours")
def op10(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Operator 11 with every round as a query of its own."""
    steps = [f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS DOUBLE)) AS x FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        part AS (
            SELECT vec_id, label, p, list_slice(x, len(x) * p // {parts} + 1, len(x) * (p + 1) // {parts}) AS x
            FROM kept, range({parts}) AS t(p)),
        first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}),
        book0 AS (SELECT p, entry, x AS e FROM part JOIN first USING (vec_id))"""]
    for k in range(rounds + 1):
        steps.append(f"""
        near{k} AS MATERIALIZED (
            SELECT vec_id, label, p, x, entry,
                   list_inner_product(x, x) - 2 * list_inner_product(x, e) + list_inner_product(e, e) AS d
            FROM part JOIN book{k} USING (p)
            QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, entry) = 1)""")
        if k < rounds:
            steps.append(f"""
        mean{k} AS (
            SELECT p, entry, list(m ORDER BY i) AS m
            FROM (SELECT p, entry, i, floor(sum(c) / count(*)) AS m
                  FROM (SELECT p, entry, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM near{k}) GROUP BY p, entry, i)
            GROUP BY p, entry),
        book{k + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(m, e) AS e FROM book{k} AS b LEFT JOIN mean{k} USING (p, entry))""")
    return ",".join(steps) + f""",
        book AS (
            SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, entry, i)) AS codebooks_sha256
            FROM (SELECT p, entry, unnest(e) AS c, generate_subscripts(e, 1) AS i FROM book{rounds})),
        coded AS (
            SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
            FROM near{rounds} GROUP BY vec_id, label)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, book"""


@query("op11_vector_codes", sql=_codes_sql())
def op11(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


@query("op12_whitening")
def op12(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_near_vectors")
def op13(spark, sf_dir):
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
