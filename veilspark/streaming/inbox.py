"""An inbox as a stream: new text rows or files are detected and masked as they come, row by row and without state; a
batch's growing mapping is merged by foreachBatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import masks
from veilspark.operators.detect import detect


def text_stream(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """path, text of files that appear under path."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def masked_stream(docs: DataFrame, everything: str | None = None, mapping: bool = False, **how) -> DataFrame:
    """path and masked_text, without originals; legal in append mode. Names are numbered within a document. mapping: adds
    the mapping, for a sink of its own (see split_sink())."""
    style = how.pop("style", "english_bracket")
    out = masks.masked(detect(docs, **how), style=style, everything=everything, abbreviations="abbreviations")
    return out.select("path", "masked_text", *(["mapping"] if mapping else []))


def split_sink(texts: str, mappings: str | None = None):
    """A foreachBatch function: masked texts go to a folder, the mapping (if a folder is given) to another one; a folder for
    each batch, so that a batch that is run again replaces itself."""
    if mappings is not None and (mappings.rstrip("/") + "/").startswith(texts.rstrip("/") + "/"):
        raise ValueError("the mapping must not be in the folder of the masked texts")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.select("path", "masked_text").write.mode("overwrite").parquet(f"{texts}/batch={number}")
        if mappings is not None:
            rows = batch.select("path", F.explode("mapping").alias("placeholder", "v")).select("path", "placeholder", "v.type", "v.original")
            rows.write.mode("overwrite").parquet(f"{mappings}/batch={number}")
        batch.unpersist()

    return write
