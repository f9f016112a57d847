"""A training-data pipeline: quality rules, n-gram Jaccard join, secret scans, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one as Parquet in the shared folder
and reads it back for the next. A stage works on all rows that its predecessor kept:

- quality: rows that the base rule or the learned rules reject go;
- near_duplicates: of each component of the Jaccard join the row with the smallest doc_id stays (of rows with the same
  doc_id and set one; rows without shingles or without a doc_id all stay);
- secrets: found spans in the text become [SECRET], and n_chars follows;
- mixing: a row for each pass of its source that it takes part in, in the order of the mixed sequence: files by ranges of
  its blocks, rows within a file by block and order (the columns are those of documents);
- packing: batches within each of these files, so that training goes through the mix in its order: doc_id, length,
  bucket, padded_length, block (the file, by name), batch, place, text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import mixing, ngram_join, packing, quality, secrets
from veilspark.llm.shared import drop_staged, staged, staged_tables


#: Words of a block of the mixed sequence.
MIX_BLOCK_TOKENS = 1 << 16


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs, quality.fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_near_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(docs, mixing.mixing_plan(docs, max_repeats=2.0), block_tokens=MIX_BLOCK_TOKENS)
    return rows.repartitionByRange("mix_block", "mix_order").sortWithinPartitions("mix_block", "mix_order").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs: read from files, whose names' numbers are their places in the mix (a table without files is one block)."""
    number = F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1)
    return packing.packed(docs, block=F.coalesce(F.try_to_number(number, F.lit("99999999")), F.lit(0)), keep=("text",))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("secrets", secret_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The stages learn rules and use hashes that DuckDB doesn't have; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        first = staged_tables(spark)
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_staged(spark, max(0, first - 1) if name != STAGES[0][0] else first, -1)  # what only this stage has read
    return STAGES[-1][1](spark, docs, sf_dir)
