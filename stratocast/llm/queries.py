"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratocast.llm import crf, html, mixing, ngram, packing, rans, rules, simhash, topk, toxicity

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every vector whose id is divisible by 20."""
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64.0)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), most=3)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the verdict of the quality rules for every document."""
    docs = _table(spark, sf_dir, "documents")
    return rules.apply_rules(docs, rules.fit_rules(docs, _table(spark, sf_dir, "labels")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids packed into sequences of at most 2048."""
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer(BYTE_BPE), window=2048, end_id=1)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(_table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return crf.score_quality(docs, crf.fit_quality(docs, _table(spark, sf_dir, "labels")), threshold=0.3)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest, read back from the token files written for all of them."""
    path, _ = rans.write_tokens(_table(spark, sf_dir, "documents"), _tokenizer(WORD_BPE), end_id=1)
    return rans.read_tokens(spark, path)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels")), threshold=0.5)


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probabilities of every document."""
    docs = _table(spark, sf_dir, "documents")
    return ngram.score(docs, ngram.train(docs))


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_simhash": op2_simhash,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_html_text": op5_html_text,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_mixing": op7_mixing,
    "op8_token_files": op8_token_files,
    "op9_toxicity": op9_toxicity,
    "op10_kneser_ney": op10_kneser_ney,
}

ORACLES = {
    "op1_exact_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.own, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.own <> b.own
            WHERE a.vec_id % 20 = 0
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS r, vec_id, score
            FROM scored
        )
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
    """,
}
