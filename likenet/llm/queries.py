"""The registered queries of this subpackage, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents
from .exact_dedup import exact_dedup
from .merge_replay import encode
from .near_dedup import near_groups
from .packing import pack
from .perspectives import rotate
from .quality_cnn import quality
from .quality_rules import quality_rules
from .substring_dedup import substring_dedup
from .toxic_spans import toxicity
from .word_pieces import token_counts

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_documents(spark, sf_dir), width=2)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).withColumn("n_spans", F.size("spans")).drop("spans")


def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_documents(spark, sf_dir)).drop("host")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_near_dedup": op2_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_perspectives": op7_perspectives,
    "op8_quality_rules": op8_quality_rules,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality_cnn": op10_quality_cnn,
}

ORACLE_SQL = {
    "op2_near_dedup": rf"""
        WITH RECURSIVE split AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
            SELECT k, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w] ELSE [w[j : j + 1] for j in range(1, len(w))] END) AS s
            FROM split
        ),
        items AS (SELECT k, unnest(s) AS x FROM sets),
        common AS (SELECT a.k AS i, b.k AS j, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.k < b.k GROUP BY ALL),
        links AS (
            SELECT i, j FROM common JOIN sets a ON a.k = i JOIN sets b ON b.k = j WHERE 100 * n >= 80 * (len(a.s) + len(b.s) - n)
        ),
        edges AS (SELECT i, j FROM links UNION ALL SELECT j, i FROM links),
        reach AS (SELECT k AS i, k AS j FROM sets UNION SELECT r.i, e.j FROM reach r JOIN edges e ON r.j = e.i),
        least AS (SELECT r.i AS k, min(o.doc_id) AS component_id FROM reach r JOIN sets o ON o.k = r.j GROUP BY r.i)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (k)
    """,
    "op3_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {LOWER} AS t FROM documents)
    """,
    "op7_perspectives": r"""
        WITH base AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations),
        who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM base WHERE speaker <> 'system'),
        seen AS (
            SELECT b.*, perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
            FROM base b JOIN who w ON b.conv_id IS NOT DISTINCT FROM w.conv_id
        ),
        named AS (SELECT *, translate(replace(speaker, '<|im_', '<\|im_'), chr(10) || chr(13), '  ') AS name FROM seen),
        headed AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || name ELSE '' END || chr(10) AS head FROM named),
        said AS (SELECT *, head || replace(body, '<|im_', '<\|im_') || '<|im_end|>' || chr(10) AS segment FROM headed),
        placed AS (
            SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, md5(body)
                ROWS UNBOUNDED PRECEDING) - length(segment) AS BIGINT) AS start FROM said
        )
        SELECT conv_id, perspective, turn, speaker, role, segment, start,
               CASE WHEN role = 'assistant' THEN start + length(head) ELSE start END AS loss_start,
               CASE WHEN role = 'assistant' THEN start + length(segment) - 1 ELSE start END AS loss_end,
               role = 'assistant' AS in_loss
        FROM placed
    """,
    "op8_quality_rules": r"""
        WITH base AS (SELECT row_number() OVER () AS k, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
        split AS (
            SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
                   [l for l in string_split(t, chr(10)) if regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines
            FROM base
        ),
        windows AS (
            SELECT k, unnest(range(1, len(words) - 1)) AS i, unnest([words[j : j + 2] for j in range(1, len(words) - 1)]) AS w FROM split
        ),
        twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, w) AS n FROM windows) WHERE n > 1),
        covered AS (SELECT k, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY k),
        measured AS (
            SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                   CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
            FROM split LEFT JOIN covered USING (k)
        ),
        hosts AS (
            SELECT host, count(*) AS n, avg((n_words < 50)::INT) AS r1, avg((100 * n_repeat_words > 50 * n_words)::INT) AS r2,
                   avg((10 * n_symbols > word_chars)::INT) AS r3, avg((10 * n_dup_lines > n_words)::INT) AS r4
            FROM measured WHERE host IS NOT NULL GROUP BY host
        ),
        long AS (SELECT host, n, unnest([1, 2, 3, 4]) AS rule, unnest([r1, r2, r3, r4]) AS r FROM hosts),
        prior AS (SELECT rule, avg(r) AS m, var_pop(r) AS v FROM long GROUP BY rule),
        shrunk AS (
            SELECT host, CASE WHEN v <= 1e-12 THEN m WHEN m * (1 - m) / v - 1 <= 0 THEN r
                ELSE (r * n + m * (m * (1 - m) / v - 1)) / (n + m * (1 - m) / v - 1) END AS rate
            FROM long JOIN prior USING (rule)
        ),
        verdicts AS (SELECT host, max(rate) > 0.5 AS rejected FROM shrunk GROUP BY host),
        judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT coalesce(rejected, false) AS kept
        FROM judged LEFT JOIN verdicts USING (host)
    """,
}
