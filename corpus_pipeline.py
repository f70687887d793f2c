"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of
documents, and further ones that the table has, whatever they are called. Rows that share an identifier share its fate: they stay if any of them
does. Texts of any length count whole, and an empty table gives an empty result in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likenet.llm.common import materialize
from likenet.llm.exact_dedup import exact_dedup
from likenet.llm.near_dedup import near_groups
from likenet.llm.packing import pack
from likenet.llm.quality_rules import quality_rules
from likenet.llm.substring_dedup import substring_dedup


#: So many dropped identifiers (8 bytes each) are broadcast, so that texts stay where they are; for more, rows meet them by identifier.
BROADCAST_DROPPED = 2_000_000


def _private(name: str, taken: list[str]) -> str:
    """A column name that isn't taken."""
    while name.lower() in (c.lower() for c in taken):
        name += "_"
    return name


def _without_dropped(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` with an identifier that has a kept row in ``verdicts`` (doc_id, kept)."""
    mine = _private("dropped_id", docs.columns)
    dropped = verdicts.groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept")).select(F.col("doc_id").alias(mine))
    dropped = materialize(dropped, "dropped")
    if dropped.count() <= BROADCAST_DROPPED:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, docs["doc_id"].eqNullSafe(F.col(mine)), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or whose host is rejected, go.

    Null and empty texts have no words and go. Rows without host are judged by themselves. Rows are judged one by one, repeated ones too.
    """
    whole = docs.select(F.struct("*").alias("row"), "text", "source")
    return quality_rules(whole, keep=("row",)).where("kept").select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z and a-z, the one with the largest identifier stays.

    Null counts as empty, and empty texts equal each other. Rows that repeat that identifier stay with it. Rows without identifier go if another row has
    their text, and share one fate: they stay if any has a text of its own.
    """
    return _without_dropped(docs, exact_dedup(docs).select("doc_id", "kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the one with the least identifier stays.

    A null or empty text is like no other and stays. Rows that repeat that identifier stay with it; rows without identifier share one fate, as above.
    """
    return _without_dropped(docs, near_groups(docs).select("doc_id", "kept"))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of strings of 200 bytes are cut out of the texts; the first copy stays, and so do all rows.

    First is what has the least identifier, then the least place; no identifier comes before any. Null texts become empty. Rows that repeat an identifier
    and text are one document and stay alike.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    whole = docs.select("doc_id", "text", F.struct(*others).alias("row"))
    cut = substring_dedup(whole, keep="first", carry=("row",), with_text=True)
    return cut.select(*(_cut_column(c) for c in docs.columns))


def _cut_column(name: str):
    """A column of documents from a row (row, kept_text)."""
    if name == "text":
        return F.col("kept_text").alias(name)
    if name == "n_chars":
        return F.char_length("kept_text").cast("long").alias(name)
    return F.col("row")[name].alias(name)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens.

    A null or empty text is the end token alone. Rows are packed as they come, repeated ones and those without identifier too.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("suffix dedup", suffix_stage),
    ("packing", packing_stage),
]

#: SQL can't express the tokens that are packed; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again by the next."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = materialize(stage(spark, out, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, out, sf_dir)
