"""A corpus pipeline of five stages, each of which keeps or changes documents for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringelake.llm import mixing, packing, pii, quality, simhash
from fringelake.llm.common import fresh, numbered, quoted, scratch
from fringelake.scratch import discard_since, made


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rules keep, each by its own verdict, whatever its doc_id. Null and empty texts are rejected; repeated
    rows stay or go alike; an empty table gives an empty one; all columns stay."""
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id (null last). Rows are told apart by themselves, so
    different texts with one doc_id or none all stay; of null and empty texts one row stays; an empty table gives an empty
    one; all columns stay."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with pseudonyms in the text; n_chars follows the text. Null text stays null, with n_chars null. Row by row, so
    repeated rows and ids change alike; an empty table gives an empty one; all columns stay."""
    found = fresh(docs, "found")[0]
    return pii.pseudonymise(docs, pii.session_key(spark), found).drop(found).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice. A null source is one; rows without words are not
    taken; rows of one doc_id, or none, have copies each; an empty table gives an empty one; all columns stay."""
    row, of, copies, copy = fresh(docs, "row", "of", "copies", "copy")
    rows = numbered(docs, row)
    taken = mixing.mix(rows, row=row).where("copies > 0").select(F.col("row").alias(of), F.col("copies").alias(copies))
    both = rows.join(taken.hint("shuffle_hash"), F.col(row) == F.col(of))
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*[quoted(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences. Null text is a document of one id; repeated rows are packed each on their own; an
    empty table gives no rows; other columns are ignored."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("PII", personal_data), ("mixing sources", mixture), ("packing", pack)]

#: SQL has no tokenizer and no keyed permutation within a text's matches; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again."""
    docs, began = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch(docs, f"stage{i}")
            discard_since(began, docs)
    return docs
