"""The queries of this package and what SQL says of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact, jaccard, langid, lm, packing, secrets, sharding, toxicity
from .bpe import digests
from .common import remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(documents(spark, sf_dir).select("doc_id", "text"), shards=16)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        "grown_shard",
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), with_ids=False)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decide(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    repo = F.concat_ws("/", "source", "lang")
    rows = secrets.scan(docs.select("doc_id", "text", "source", "lang"), F.col("source"), repo)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "live")
    return rows.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(documents(spark, sf_dir), width=4, percent=85)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held_out = remainder("doc_id", 10) == 0
    return lm.score(documents(spark, sf_dir), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, held_out)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_sharding, op2_packing, op3_langid, op4_exact_dedup, op5_bpe, op6_ann, op7_secrets, op8_ngram_jaccard, op9_lm_scoring, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
        "op8_ngram_jaccard": r"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
            s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [array_to_string(l, ' ')]
                ELSE list_transform(range(1, len(l) - 2), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] || ' ' || l[i + 3]) END) AS g FROM w),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
            e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
            r AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
            reach AS (SELECT x, y FROM r UNION SELECT reach.x, r.y FROM reach JOIN r ON reach.y = r.x),
            g AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
            SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(g.component_id, d.doc_id), d.doc_id) AS component_id
            FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)""",
    }
