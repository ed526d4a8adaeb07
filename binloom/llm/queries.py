"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binloom.llm.alignment import alignment_counts
from binloom.llm.common import documents
from binloom.llm.decontaminate import contaminated
from binloom.llm.encoders import tokenizer_path
from binloom.llm.exact_dedup import exact_duplicates
from binloom.llm.fill_middle import fill_in_middle_digests
from binloom.llm.hash_tree import sharded, tree
from binloom.llm.line_dedup import line_deduplicated
from binloom.llm.lsh_forest import near_duplicates
from binloom.llm.packing import pack
from binloom.llm.secret_spans import secret_spans
from binloom.llm.secret_spans import train as train_field
from binloom.llm.site_quality import site_quality
from binloom.llm.site_quality import train as train_quality
from binloom.llm.token_frames import read_token_files, write_token_files
from binloom.llm.toxicity import score, train
from binloom.llm.transducer import token_counts


def op1_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op2_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(*write_token_files(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secret_spans(docs, train_field(docs))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return site_quality(docs, train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_deduplicated(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_dropped")


def op11_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir), tree(8), tree(9))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_counts(
        documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digests(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lsh_forest,
        op2_token_frames,
        op3_decontamination,
        op4_best_fit_packing,
        op5_exact_dedup,
        op6_token_counts,
        op7_secret_spans,
        op8_toxicity,
        op9_site_quality,
        op10_line_dedup,
        op11_weighted_hash_tree,
        op12_cross_tokenizer_alignment,
        op13_fill_in_middle,
    )
}

SQL = {
    "op5_exact_dedup": """
        WITH hashed AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, text_sha256
        FROM hashed WINDOW same AS (PARTITION BY text_sha256)
    """,
    "op11_weighted_hash_tree": """
        WITH RECURSIVE steps(byte, k, v) AS (
            SELECT b, 0, b FROM range(256) t(b)
            UNION ALL SELECT byte, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END
            FROM steps WHERE k < 8
        ),
        lookup AS (SELECT list(v ORDER BY byte) AS t FROM steps WHERE k = 8),
        leaves AS (
            SELECT k AS shard, 'r' || (k // 4) AS region, 'r' || (k // 4) || '.k' || (k // 2 % 2) AS rack
            FROM range(8) t(k) UNION ALL SELECT 8, 'r2', 'r2.k0'
        ),
        trees AS (SELECT n, leaves.* FROM leaves JOIN (VALUES (8), (9)) v(n) ON shard < n),
        nodes AS (
            SELECT n, 0 AS level, '' AS parent, region AS node, count(*) AS weight FROM trees GROUP BY ALL
            UNION ALL SELECT n, 1, region, rack, count(*) FROM trees GROUP BY ALL
            UNION ALL SELECT n, 2, rack, shard::VARCHAR, count(*) FROM trees GROUP BY ALL
        ),
        docs AS (
            SELECT row_number() OVER () AS row, doc_id, strlen(coalesce(text, '')) + 1 AS size,
                   coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') AS key
            FROM documents
        ),
        draws AS (
            SELECT row, n, level, parent, node,
                   -ln((('0x' || substr(md5('tree:' || level || ':' || node || ':' || key), 1, 13))::BIGINT + 0.5)
                       / 4503599627370496.0) / weight AS draw
            FROM docs, nodes
        ),
        won AS (
            SELECT row, n, level, parent, arg_min(node, draw) AS node FROM draws GROUP BY row, n, level, parent
        ),
        placed AS (
            SELECT a.row, a.n, c.node::INTEGER AS shard
            FROM won a JOIN won b ON b.row = a.row AND b.n = a.n AND b.level = 1 AND b.parent = a.node
            JOIN won c ON c.row = a.row AND c.n = a.n AND c.level = 2 AND c.parent = b.node
            WHERE a.level = 0
        )
        SELECT doc_id, size::BIGINT AS size,
               xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(text), '..'),
                                                                       lambda x: ('0x' || x)::BIGINT)),
                               lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1])), 4294967295) AS text_crc32,
               'key' AS law, p.shard,
               row_number() OVER (PARTITION BY p.shard ORDER BY doc_id) - 1 AS slot, g.shard AS grown_shard
        FROM docs JOIN placed p ON p.row = docs.row AND p.n = 8 JOIN placed g ON g.row = docs.row AND g.n = 9, lookup
    """,
}
