"""Media columns: payloads as 8-bit grey PNG files in binary columns, read back, with a low-frequency hash.

Writing: the payload (a text's UTF-8 bytes, zeros appended up to a positive multiple of WIDTH) becomes rows of WIDTH
samples; each row has the best filter type of none, sub and up, all rows are one zlib stream in IDAT chunks of at most IDAT_BYTES. Reading tests
the signature, every chunk's CRC-32, the order of chunks, the zlib stream's own checksum and its length, and undoes the
five filter types with numpy. The hash averages the samples to 32 x 32, takes the 8 x 8 lowest terms of a cosine
transform in whole numbers (so that it's the same on any machine) and sets a bit for each term above their median.

Cases: a null or empty text is WIDTH zero bytes; repeated rows give equal values; null ids are kept; a file that is
damaged in any place raises ValueError; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import ship

WIDTH = 64
IDAT_BYTES = 1 << 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed by the format.
FILTERS = {"none": 0, "sub": 1, "up": 2, "average": 3, "paeth": 4}

_COSINES = np.rint(4096 * np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(32)[None, :] + 1) / 64)).astype(np.int64)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _paeth(a, b, c):
    p = a + b - c
    pa, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def padded(data: bytes, width: int = WIDTH) -> bytes:
    return data + bytes(-len(data) % width if data else width)


def _best_rows(img: np.ndarray) -> np.ndarray:
    """Rows with their filter type before them: none, sub or up, whichever has the least sum of absolute differences (of
    equals the first). These three are undone by numpy without a loop over samples."""
    tries = np.stack([img] * 3)
    tries[1, :, 1:] -= img[:, :-1]
    tries[2, 1:] -= img[:-1]
    pick = np.abs(tries.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    return np.column_stack([pick.astype(np.uint8), tries[pick, np.arange(len(img))]])


def write_png(payload: bytes, width: int = WIDTH, kind: str = "best", level: int = 4) -> bytes:
    """A PNG file of a payload whose length is a positive multiple of width; kind is one of FILTERS for all rows, or best
    (of none, sub and up for each row)."""
    img = np.frombuffer(payload, np.uint8).reshape(-1, width)
    filtered = np.empty((len(img), width + 1), np.uint8)
    if kind == "best":
        filtered = _best_rows(img)
    elif kind == "none":
        filtered[:, 0], filtered[:, 1:] = FILTERS[kind], img
    else:
        wide = img.astype(np.int16)
        a, b = np.zeros_like(wide), np.zeros_like(wide)
        a[:, 1:], b[1:] = wide[:, :-1], wide[:-1]
        c = np.zeros_like(wide)
        c[1:, 1:] = wide[:-1, :-1]
        guess = {"sub": lambda: a, "up": lambda: b, "average": lambda: (a + b) // 2, "paeth": lambda: _paeth(a, b, c)}[kind]()
        filtered[:, 0], filtered[:, 1:] = FILTERS[kind], (wide - guess).astype(np.uint8)
    packed = zlib.compress(filtered.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(img), 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *(_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)), _chunk(b"IEND", b"")])


def unfiltered(rows: np.ndarray) -> np.ndarray:
    """Samples of filtered rows (the first byte of each is its filter type), for one byte a sample."""
    types, data = rows[:, 0], rows[:, 1:]
    if (types > 4).any():
        raise ValueError("unknown filter type")
    if not types.any():
        return data
    out = np.empty_like(data)
    above = np.zeros(data.shape[1], np.uint8)
    cuts = np.flatnonzero(np.diff(types.astype(np.int16), prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        kind = types[a]
        if kind == 0:
            out[a:b] = data[a:b]
        elif kind == 1:
            out[a:b] = np.cumsum(data[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(np.vstack([above[None], data[a:b]]), axis=0, dtype=np.uint8)[1:]
        else:
            for r in range(a, b):
                left = corner = 0
                for x, (value, up) in enumerate(zip(data[r].tolist(), above.tolist(), strict=True)):
                    if kind == 3:
                        guess = (left + up) // 2
                    else:
                        by_left, by_up, by_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                        guess = left if by_left <= by_up and by_left <= by_corner else up if by_up <= by_corner else corner
                    out[r, x] = left = (value + guess) & 255
                    corner = up
                above = out[r]
        above = out[b - 1]
    return out


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG file, after all its checks."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, packed, head, ended = 8, [], None, False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut off within a chunk")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(body) != n or crc != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"chunk {kind!r} is damaged")
        if (head is None) != (kind == b"IHDR"):
            raise ValueError("chunks in a wrong order")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
            if head[2:] != (8, 0, 0, 0, 0):
                raise ValueError("not 8-bit grey without interlacing")
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if not ended or at != len(data):
        raise ValueError("no IEND chunk at the end")
    width, height = head[0], head[1]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError("the zlib stream is damaged") from e
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of samples")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def cosine_hash(img: np.ndarray) -> bytes:
    """64 bits of the lowest cosine terms of an image of any height and a width of 32 or more (or a divisor of 32)."""

    def pooled(x: np.ndarray) -> np.ndarray:  # 32 averages along the first axis
        n = len(x)
        lo = np.arange(32) * n // 32
        hi = np.maximum(lo + 1, (np.arange(32) + 1) * n // 32)
        sums = np.zeros((n + 1, *x.shape[1:]), np.int64)
        np.cumsum(x, axis=0, out=sums[1:])
        return (sums[hi] - sums[lo]) * 64 // (hi - lo).reshape(-1, *[1] * (x.ndim - 1))

    small = pooled(pooled(img.astype(np.int64)).T).T
    terms = (_COSINES @ small @ _COSINES.T).ravel()
    bits = terms > np.sort(terms[1:])[31]
    bits[0] = False
    return np.packbits(bits).tobytes()


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, media (binary): each text's payload as a PNG file."""
    ship(docs.sparkSession)
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def written(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            sizes, files = [], []
            for k in range(len(texts)):
                data = texts[k].as_py() or b""
                sizes.append(len(data))
                files.append(write_png(padded(data)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["id", "n_bytes", "media"])

    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return text.mapInArrow(written, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the media column back: id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, cosine_hash (binary)."""
    ship(media.sparkSession)
    kind = dict(media.select(F.col(id_col).alias("id")).dtypes)["id"]

    def read(batches):
        import pyarrow as pa

        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "cosine_hash"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            rows = []
            for cell in batch.column(2):
                data = cell.as_py()
                img = read_png(data)
                payload = img.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(img)))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["id", "n_bytes", *names])

    rows = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    out = rows.mapInArrow(read, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, cosine_hash binary")
    return out.withColumnRenamed("id", id_col)


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    """The contract's rows: every document through a PNG column and back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return media_features(with_media(docs)).withColumn("feature", F.lower(F.hex("cosine_hash"))).drop("cosine_hash")
