"""Results as files: masked documents, and the mapping in a place of its own.

A file's name is its path below the folder that was read (base), so that files of one name in two folders stay apart. It
is written under a name of the task's attempt and then moved, so that a lost task leaves no half file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.shipping import ship


def relative_name(path: Column, base: str | None = None) -> Column:
    """A path without scheme and base, each part safe as a name."""
    bare = F.regexp_replace(F.coalesce(path.cast("string"), F.lit("")), "^[a-z0-9]+:/*", "/")
    if base:
        start = "/" + base.split(":", 1)[-1].strip("/") + "/"
        bare = F.when(F.startswith(bare, F.lit(start)), F.substring(bare, len(start), 1 << 30)).otherwise(bare)
    parts = F.filter(F.split(bare, "/"), lambda x: x != "")
    clean = F.transform(parts, lambda x: F.coalesce(F.nullif(F.trim(F.regexp_replace(x, r"[\\\x00-\x1f\x7f]+", "_"), F.lit(" .")), F.lit("")), F.lit("_")))
    return F.when(F.size(clean) == 0, F.lit("file")).otherwise(F.array_join(clean, "/"))


def write_documents(df: DataFrame, folder: str, name_col: str = "path", text_col: str = "masked_text", suffix: str | None = None, base: str | None = None, in_place=None) -> DataFrame:
    """Writes each row as a file of its own and returns name, written, kind. suffix: that of the outputs, without it each
    file's own. A content column (binary) and a mapping column, where there are some, let DOCX sources keep their layout.
    The list of files is written beside them, once."""
    ship(df.sparkSession)
    lit = lambda kind: F.lit(None).cast(kind)
    pairs = F.transform(F.map_entries("mapping"), lambda e: F.struct(e["value"]["original"].alias("o"), e["key"].alias("m"))) if "mapping" in df.columns else lit("array<struct<o:string,m:string>>")
    content = F.col("content") if "content" in df.columns else lit("binary")
    named = df.select(relative_name(F.col(name_col), base).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), content.alias("content"), pairs.alias("pairs"))

    def written(batches):
        import posixpath

        import pyarrow as pa
        from pyarrow import fs

        from veilspark.sources.writers import rendered

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            done = []
            for n, t, c, ps in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                stem, own = posixpath.splitext(n)
                data, kind = rendered(suffix or own or ".txt", t, c, [(p["o"], p["m"]) for p in ps or () if p["o"]], in_place)
                name = n if kind == own else stem + kind
                target = f"{root}/{name}"
                store.create_dir(posixpath.dirname(target), recursive=True)
                temp = f"{posixpath.dirname(target)}/.{uuid.uuid4().hex}"
                with store.open_output_stream(temp) as out:
                    out.write(data)
                store.move(temp, target)
                done.append((n, f"{folder}/{name}", kind))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in range(3)], ["name", "written", "kind"])

    named.mapInArrow(written, "name string, written string, kind string").write.mode("overwrite").parquet(f"{folder}/_list")
    return df.sparkSession.read.parquet(f"{folder}/_list")


def write_texts(df: DataFrame, folder: str, name_col: str = "path", text_col: str = "masked_text", base: str | None = None) -> DataFrame:
    """write_documents() as plain text."""
    return write_documents(df.select(name_col, text_col), folder, name_col, text_col, ".txt", base)


def write_zip(rows: DataFrame, path: str, name_col: str = "path", text_col: str = "masked_text", base: str | None = None) -> str:
    """One archive of the rows whose status is done (all rows without such a column), names and masked texts alone: the
    mapping is never in it. One task writes it, a batch of rows in memory at a time."""
    ship(rows.sparkSession)
    done = rows.filter("status = 'done'") if "status" in rows.columns else rows
    named = done.select(relative_name(F.col(name_col), base).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def written(batches):
        import zipfile

        import pyarrow as pa
        from pyarrow import fs

        store, target = fs.FileSystem.from_uri(path)
        temp, n = f"{target}.{uuid.uuid4().hex}", 0
        with store.open_output_stream(temp) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for b in batches:
                for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    z.writestr(name, t)
                    n += 1
        store.move(temp, target)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    named.repartition(1).mapInArrow(written, "n long").collect()
    return path


def write_mapping(df: DataFrame, folder: str, id_col: str = "doc_id") -> None:
    """Writes mappings as JSON lines; never in the folder of the masked texts."""
    df.select(id_col, F.to_json("mapping").alias("mapping")).write.mode("overwrite").json(folder)


def masked_name(name, mapping):
    """A file name with originals of two characters or more replaced by placeholders, longer ones first."""
    order = F.array_sort(F.transform(F.filter(F.map_entries(mapping), lambda e: F.length(e["value"]["original"]) >= 2), lambda e: F.struct((-F.length(e["value"]["original"])).alias("n"), e["value"]["original"].alias("o"), e["key"].alias("k"))))
    return F.aggregate(order, name, lambda t, e: F.replace(t, e["o"], e["k"]))
