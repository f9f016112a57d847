"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def ship(spark: SparkSession) -> None:
    """Sends the package to every Python worker of a session, once, wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_veilspark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="veilspark-"), "veilspark_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    sc._veilspark_shipped = True


#: Rows, and bytes with their texts, that a task works on at once: what is made of them is in memory as Python objects.
ROWS, BYTES = 1024, 1 << 20


def slices(batch):
    """A record batch in parts of at most ROWS rows and about BYTES bytes; a row alone may have more."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    weight = np.full(batch.num_rows, batch.nbytes // batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            weight += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, start = np.cumsum(weight), 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(total, (total[start - 1] if start else 0) + BYTES, "right"))
        stop = min(max(stop, start + 1), start + ROWS)
        yield batch.slice(start, stop - start)
        start = stop


class Made:
    """A column of Python values on its way to the next step of a pass; an Arrow array once it leaves."""

    def __init__(self, values, kind):
        self.values, self.kind = values, kind

    def to_pylist(self):
        return self.values

    def arrow(self):
        import pyarrow as pa

        return struct_maps(self.values, self.kind) if pa.types.is_map(self.kind) and pa.types.is_struct(self.kind.item_type) else pa.array(self.values, self.kind)


class Tuples:
    """Lists of tuples of fields, as Made."""

    def __init__(self, rows, fields: tuple[str, ...], arrow: Callable):
        self.rows, self.fields, self.arrow = rows, fields, lambda: arrow(rows)


def with_columns_from(df: DataFrame, inputs: list[str], ddl: str, fn: Callable[..., list], keep: list[str] | None = None) -> DataFrame:
    """df, or its columns keep, with the columns of ddl, which fn makes from the input columns, a part of an Arrow batch at
    a time: a list of values, or an Arrow array, for each. Other columns pass through as they are.

    Steps that follow each other are one pass: a step on what another one has given runs in the same worker, on its
    values as they are, and columns that nobody keeps are never written."""
    ship(df.sparkSession)
    made, names = T.StructType.fromDDL(ddl), df.columns
    source, steps, refs = (None if df.is_cached else df.__dict__.get("_pass")) or (df, (), tuple(range(len(names))))
    places = range(len(names)) if keep is None else [names.index(c) for c in keep]
    steps = (*steps, (tuple(refs[names.index(c)] for c in inputs), fn, made))
    out = (*(refs[k] for k in places), *((len(steps) - 1, k) for k in range(len(made.fields))))
    schema = T.StructType([*(df.schema.fields[k] for k in places), *made.fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [[to_arrow_type(f.dataType) for f in m.fields] for *_, m in steps]
        for b in batches:
            for part in slices(b):
                have = dict(enumerate(part.columns))
                for j, (ins, make, _) in enumerate(steps):
                    for k, (v, kind) in enumerate(zip(make(*(have[r] for r in ins)), kinds[j], strict=True)):
                        have[j, k] = v if isinstance(v, pa.Array | Tuples) else Made(v, kind)
                yield pa.RecordBatch.from_arrays([c if isinstance(c := have[r], pa.Array) else c.arrow() for r in out], schema.names)

    result = source.mapInArrow(run, schema)
    result._pass = (source, steps, out)
    return result


def tuples(column, *fields: str) -> list[list[tuple]]:
    """Rows of a column of lists of structs, as lists of tuples of the fields; null counts as empty."""
    import pyarrow.compute as pc

    if isinstance(column, Tuples):
        places = [column.fields.index(f) for f in fields]
        return [[tuple([x[k] for k in places]) for x in r] for r in column.rows]
    flat = column.flatten()
    rows = list(zip(*(flat.field(f).to_pylist() for f in fields), strict=True))
    out, at = [], 0
    for size in pc.fill_null(pc.list_value_length(column), 0).to_pylist():
        out.append(rows[at : at + size])
        at += size
    return out


def struct_lists(rows: list[list[tuple]], kind):
    """An Arrow array of the type kind (a list of structs) from lists of tuples in the order of its fields."""
    import pyarrow as pa

    bounds = [0]
    for r in rows:
        bounds.append(bounds[-1] + len(r))
    flat = [x for r in rows for x in r]
    fields = [kind.value_type.field(k) for k in range(kind.value_type.num_fields)]
    columns = [pa.array([x[k] for x in flat], f.type) for k, f in enumerate(fields)]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, fields=fields))


def struct_maps(rows: list[list[tuple[str, dict]]], kind):
    """An Arrow array of the type kind (a map from strings to structs) from lists of (key, dict)."""
    import pyarrow as pa

    bounds, flat = [0], []
    for r in rows:
        flat += r
        bounds.append(len(flat))
    fields = [kind.item_type.field(k) for k in range(kind.item_type.num_fields)]
    columns = [pa.array([v[f.name] for _, v in flat], f.type) for f in fields]
    return pa.MapArray.from_arrays(pa.array(bounds, pa.int32()), pa.array([k for k, _ in flat], kind.key_type), pa.StructArray.from_arrays(columns, fields=fields), type=kind)


def span_lists(rows: list[list[tuple]]) -> Tuples:
    """Spans (pos, txt, etype, layer, prio, seq) of each row as a column."""

    def arrow(rows):
        import pyarrow as pa

        text, whole = pa.string(), pa.int32()
        return struct_lists(rows, pa.list_(pa.struct([("pos", whole), ("txt", text), ("etype", text), ("layer", text), ("prio", whole), ("seq", whole)])))

    return Tuples(rows, ("pos", "txt", "etype", "layer", "prio", "seq"), arrow)
