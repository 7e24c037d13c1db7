"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, licenses, lm, minhash, packing, quality, rules, sharding, wavelet
from . import pipeline as stages
from .common import bounded, held_out, read
from .pipeline import language_model, quality_model
from .tokens import vocabulary


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(read(spark, sf_dir, "documents"), quality_model(spark, sf_dir), "doc_id")
    return out.select("doc_id", held_out(5).alias("held_out"), "score", "predicted")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    ratio = rules.fit(rules.trusted(docs, read(spark, sf_dir, "labels")))
    return rules.apply(docs, ratio, "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"), held_out(10), vocabulary("byte_bpe_50k.tiktoken"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=2)


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read(wavelet.manifest(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.predict(read(spark, sf_dir, "documents"), language_model(spark, sf_dir), "doc_id")
    return out.select("doc_id", held_out(5).alias("held_out"), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id")
    # ranges are disjoint pairs: ends less begins
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES = {f.__name__: bounded(f) for f in (op1_kd_sharding, op2_best_fit_packing, op3_quality_classifier, op4_quality_rules, op5_lm_scoring, op6_minhash_dedup, op7_wavelet_tokens, op8_language_id, op9_license_scan, op10_decontamination, pipeline)}

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op6_minhash_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOW}, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
              ELSE list_distinct(list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
        p AS (SELECT a.doc_id AS i, b.doc_id AS j, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
              FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT i, j FROM p WHERE 100 * c >= 80 * (n + m - c)),
        u AS (SELECT i, j FROM l UNION SELECT j, i FROM l),
        r AS (SELECT doc_id AS i, doc_id AS k FROM documents UNION SELECT u.i, r.k FROM r JOIN u ON u.j = r.i),
        c AS (SELECT i, min(k) AS k FROM r GROUP BY i)
        SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.k AS component_id, c.k = s.doc_id AS kept FROM s JOIN c ON c.i = s.doc_id""",
    "op10_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOW}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(coalesce({_LOW}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
        g AS (SELECT item_id, least(len(ws), 10) AS n, unnest(list_transform(generate_series(1, greatest(len(ws) - 9, 1)), lambda i: array_to_string(ws[i:i + 9], ' '))) AS x FROM b WHERE len(ws) > 0),
        z AS (SELECT DISTINCT n FROM g),
        t AS (SELECT doc_id, z.n, unnest(generate_series(1, len(ws) - z.n + 1)) AS i, ws FROM d, z WHERE len(ws) >= z.n),
        h AS (SELECT t.doc_id, t.i, t.n, g.item_id FROM t JOIN g ON g.n = t.n AND g.x = array_to_string(ws[i:i + t.n - 1], ' ')),
        k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM h) GROUP BY 1),
        q AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id""",
}
