"""Token-ID output: independent zstandard frames with a trailing seek table.

File: frames, index, seek table. A frame is one zstandard frame with its own content checksum, of one document's ids as
little-endian unsigned 32-bit integers (with frame_ids above 1: of whole documents until so many ids are in it). The
index is one more zstandard frame: for each document in order its id, whether the id is null, and its number of ids.
The seek table is a skippable frame: for each frame (the index last) its compressed and uncompressed size and the low
half of the XXH64 of its content, then the number of frames, a descriptor byte and the magic number. A reader takes the
end of the file, then only the frames that it needs.

Files hold ascending ranges of document ids, in the order of their names. Each is written under a name of its own
attempt and then moved in place, so that a repeated or lost task leaves one whole file.

Rows are dealt to files by ranges of (id, hash of the text, place in the input), so that neither rows of one id nor
null ids meet in one task; the list of files has the first and last id of each, and a search for documents opens only
the files whose range has an id, then only the index and the frames of the documents.

Cases: null and empty texts have just the end id; a null doc_id sorts first; rows with the same doc_id follow each
other in the order of their text's hash, then text; an empty table gives no files and no rows. Extra columns are not
read. A damaged frame raises ValueError.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.pieces import encoder
from veilspark.llm.shared import partitions, shared_dir, ship

FRAME_IDS = 1
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_ENTRY, _FOOT = struct.Struct("<III"), struct.Struct("<IBI")


class TokenFileWriter:
    """Writes documents' ids to a binary stream."""

    def __init__(self, out, level: int = 3, frame_ids: int = FRAME_IDS):
        import zstandard

        self.out, self.entries, self.index, self.frame_ids = out, [], [], frame_ids
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.held: list[bytes] = []
        self.ids = 0

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self.packer.compress(data)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.out.write(packed)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id or 0, doc_id is None, len(ids)))
        self.held.append(ids.astype("<u4").tobytes())
        self.ids += len(ids)
        if self.ids >= self.frame_ids:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
            self.held, self.ids = [], 0

    def close(self) -> None:
        self.flush()
        table = np.array(self.index, dtype=[("id", "<i8"), ("null", "u1"), ("n", "<i8")])
        self._frame(table.tobytes())
        body = b"".join(_ENTRY.pack(*e) for e in self.entries) + _FOOT.pack(len(self.entries), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class TokenFileReader:
    """Reads a seekable binary stream: all documents in order, or some by their id or place. read counts the frames."""

    def __init__(self, src):
        self.src, self.read = src, 0
        src.seek(0, io.SEEK_END)
        end = src.tell()
        src.seek(end - _FOOT.size)
        n, _, magic = _FOOT.unpack(src.read(_FOOT.size))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end")
        src.seek(end - _FOOT.size - n * _ENTRY.size)
        raw = src.read(n * _ENTRY.size)
        self.entries = [_ENTRY.unpack_from(raw, k * _ENTRY.size) for k in range(n)]
        self.starts = np.concatenate(([0], np.cumsum([e[0] for e in self.entries]))).tolist()
        self.index = np.frombuffer(self.frame(n - 1), dtype=[("id", "<i8"), ("null", "u1"), ("n", "<i8")])
        self.first = np.concatenate(([0], np.cumsum(self.index["n"])))
        self.frame_first = np.concatenate(([0], np.cumsum([e[1] // 4 for e in self.entries[:-1]])))

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        self.read += 1
        self.src.seek(self.starts[k])
        try:
            data = zstandard.ZstdDecompressor().decompress(self.src.read(self.entries[k][0]))
        except zstandard.ZstdError as e:
            raise ValueError(f"frame {k} is damaged") from e
        if len(data) != self.entries[k][1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.entries[k][2]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def places(self, doc_id: int | None) -> range:
        """The places of the documents with an id: nulls are first, then ids ascend."""
        nulls = int(self.index["null"].sum())
        if doc_id is None:
            return range(nulls)
        ids = self.index["id"][nulls:]
        return range(nulls + int(np.searchsorted(ids, doc_id)), nulls + int(np.searchsorted(ids, doc_id, "right")))

    def document(self, place: int) -> np.ndarray:
        """The ids of the document at a place in the file, from its frame alone."""
        k = int(np.searchsorted(self.frame_first, self.first[place], "right")) - 1
        a = int(self.first[place] - self.frame_first[k])
        return np.frombuffer(self.frame(k), "<u4")[a : a + int(self.index["n"][place])]

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """(document id, its ids' bytes) in order, a frame in memory at a time."""
        place = 0
        for k in range(len(self.entries) - 1):
            data, at = self.frame(k), 0
            while at < len(data):
                row = self.index[place]
                size = 4 * int(row["n"])
                yield (None if row["null"] else int(row["id"])), data[at : at + size]
                at, place = at + size, place + 1


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Writes files under folder (a URI that all executors reach) and returns their list, a row for each file: part,
    path, n_docs, n_ids, first_id, last_id (null where the file begins or ends with null ids). The list is evaluated once,
    by writing it beside the files."""
    spark = docs.sparkSession
    ship(spark)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("r"))
    ranged = text.repartitionByRange(partitions(spark), "id", "h", "r").sortWithinPartitions("id", "h", "text").select("id", "text")

    def written(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        writer, docs_n, ids_n, out, store, first = None, 0, 0, None, None, None
        name = f"part-{part:06d}.tokens"
        temp = f".{name}-{uuid.uuid4().hex}"
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, ids, per, _, offs in encoder(tokenizer).encode(batch.column(1)):
                if writer is None:
                    store, root = _store(folder)
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{temp}")
                    writer, first = TokenFileWriter(out, frame_ids=frame_ids), keys[0]
                for d in range(len(offs) - 1):
                    one = np.append(ids[per[d] : per[d + 1]], ids.dtype.type(end_id))
                    writer.add(keys[i + d], one)
                    docs_n, ids_n = docs_n + 1, ids_n + len(one)
        if writer is not None:
            writer.close()
            out.close()
            store.move(f"{root}/{temp}", f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{name}"], "n_docs": pa.array([docs_n]), "n_ids": pa.array([ids_n]), "first_id": pa.array([first], pa.int64()), "last_id": pa.array([keys[-1]], pa.int64())})

    ranged.mapInArrow(written, "part long, path string, n_docs long, n_ids long, first_id long, last_id long").write.parquet(f"{folder}/list")
    return spark.read.parquet(f"{folder}/list")


def read_token_files(files: DataFrame) -> DataFrame:
    """From the files of a list: a row for each document: doc_id, start, n_tokens, ids_crc32."""
    from pyspark.sql import Window

    spark = files.sparkSession
    ship(spark)
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.select("path", before.alias("before")).repartition(partitions(spark), "path")

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = _store(path)
                with store.open_input_file(place) as src:
                    got = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                    for doc, data in TokenFileReader(src).documents():
                        for k, v in zip(got, (doc, start, len(data) // 4, zlib.crc32(data)), strict=True):
                            got[k].append(v)
                        start += len(data) // 4
                        if len(got["doc_id"]) == 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in got.values()], list(got))
                            got = {k: [] for k in got}
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in got.values()], list(got))

    return placed.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(files: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids (array<int>), frames (read for it) of the documents whose id is in wanted (null ids ask for nothing),
    without reading others. The list of files, as many as shuffle partitions, is on the driver."""
    spark = files.sparkSession
    ship(spark)
    rows = files.orderBy("part").select("path", "first_id", "last_id").collect()
    bounds = lambda k: F.array(*(F.lit(r[k] if r[k] is not None else -(1 << 63)).cast("long") for r in rows))
    paths = F.array(*(F.lit(r["path"]) for r in rows))
    ids = wanted.select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct()
    low, high = F.size(F.filter(bounds("last_id"), lambda x: x < F.col("id"))), F.size(F.filter(bounds("first_id"), lambda x: x <= F.col("id")))
    asked = ids.withColumns({"low": low, "high": high}).filter("low < high").select("id", F.explode(F.sequence("low", F.col("high") - 1)).alias("k"))
    asked = asked.select(F.get(paths, F.col("k")).alias("path"), "id") if rows else ids.limit(0).select(F.lit("").alias("path"), "id")
    asked = asked.repartition(partitions(spark), "path").sortWithinPartitions("path", "id")

    def found(batches):
        import pyarrow as pa

        path, src, reader = None, None, None
        for batch in batches:
            out = {"doc_id": [], "ids": [], "frames": []}
            for p, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != path:
                    if src is not None:
                        src.close()
                    store, place = _store(p)
                    path, src = p, store.open_input_file(place)
                    reader = TokenFileReader(src)
                for place in reader.places(i):
                    before = reader.read
                    out["ids"].append(reader.document(place).astype(np.int32))
                    out["doc_id"].append(i)
                    out["frames"].append(reader.read - before)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["frames"], pa.int32())], list(out))
        if src is not None:
            src.close()

    return asked.mapInArrow(found, "doc_id long, ids array<int>, frames int")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    """The contract's rows, from files written in the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"))
