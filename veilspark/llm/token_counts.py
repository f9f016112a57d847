"""Token counts of sections by offsets.

A whole text is encoded once; sections are ranges of it that follow each other (here lines with their line feed, or
any cut places in code points). Each token covers a range of bytes, from that a range of code points; ranges of tokens
are joined with those of sections by position. A token that covers parts of several sections goes where the rule says:
"first" (the section of its first byte), "last", or "most" (most of its bytes; of equals the first). Every token
counts in exactly one section, so that a text's counts add up to its number of tokens. Bytes of a character that
several tokens share belong to the section of that character.

Cases: a null or empty text has no sections and no tokens; a text that ends with a line feed has no empty last
section; sections without tokens of their own count 0; repeated rows and null ids are rows like others; an empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.pieces import encoder
from veilspark.llm.shared import ship

RULES = ("first", "last", "most")


def attribute(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token range [start, end) among sections that begin at cuts (ascending), and which tokens
    cross a cut."""
    first = np.searchsorted(cuts, starts, "right") - 1
    last = np.searchsorted(cuts, ends - 1, "right") - 1
    crossing = first != last
    if rule == "first" or not crossing.any():
        return first, crossing
    if rule == "last":
        return last, crossing
    out = first.copy()
    for k in np.flatnonzero(crossing):  # few
        s = np.arange(first[k], last[k] + 1)
        lo = np.maximum(cuts[s], starts[k])
        hi = np.minimum(np.append(cuts, ends[k])[s + 1], ends[k])
        out[k] = s[np.argmax(hi - lo)]
    return out, crossing


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "most", tokenizer: str | None = None) -> DataFrame:
    """A row for each row of docs: id_col, n_tokens, n_sections, n_crossing, section_tokens (array<long>, one count for
    each line), section_starts (array<long>, code points)."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    ship(docs.sparkSession)
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            n_tokens, n_sections, n_crossing, counts, points, sizes = [], [], [], [], [], []
            enc = encoder(tokenizer)
            for _, ids, per, buf, offs in enc.encode(batch.column(1)):
                ends = np.cumsum(enc.token_bytes[ids], dtype=np.int64)
                starts = ends - enc.token_bytes[ids]
                line = np.zeros(len(buf), bool)
                line[1:] = buf[:-1] == 0x0A
                line[offs[:-1][offs[1:] > offs[:-1]]] = True
                cuts = np.flatnonzero(line)
                section, crossing = attribute(starts, ends, cuts, rule) if len(ids) else (starts, np.zeros(0, bool))
                count = np.bincount(section, minlength=len(cuts)).astype(np.int64)
                lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                of = np.searchsorted(cuts, offs)
                size = np.diff(of)
                crossed = np.concatenate(([0], np.cumsum(crossing)))
                n_tokens.append(np.diff(per))
                n_sections.append(size)
                n_crossing.append(crossed[per[1:]] - crossed[per[:-1]])
                counts.append(count)
                points.append(lead[cuts] - np.repeat(lead[offs[:-1]], size))
                sizes.append(size)
            if n_tokens:
                bounds = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x).astype(np.int64))) for x in (counts, points)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (n_tokens, n_sections, n_crossing)), *lists], ["id", "n_tokens", "n_sections", "n_crossing", "section_tokens", "section_starts"])

    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = text.mapInArrow(counted, f"id {kind}, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>, section_starts array<long>")
    return out.withColumnRenamed("id", id_col)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
