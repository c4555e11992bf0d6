"""Helpers shared by the text operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molscreen.operators.running import running_sum

#: A word: a run of anything but the six ASCII blanks (``bytes.split()`` cuts at the same six).
WORD = r"[^\x20\x09-\x0D]+"
#: Texts of about this many bytes are handled together inside a task.
SLICE_BYTES = 2 << 20
#: Rows that one window partition may hold when a hot group is ranked.
CELL_ROWS = 20_000

ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
    "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
    "array<binary>": pa.list_(pa.binary()),
}


def quoted(name: str) -> Column:
    """Column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, rows) cuts of a batch so that each holds about ``most`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i - start
            start, held = i, 0
        held += n + 1
    if start < len(sizes):
        yield start, len(sizes) - start


def map_texts(
    df: DataFrame, fn: Callable[[list[str | None]], dict], fields: dict[str, str], text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """(row, *fields): ``fn`` over lists of whole texts; ``row`` is a struct of the ``keep`` columns.

    The struct lets any column names pass next to the new ones.  ``fn`` sees about 2 MB of
    text at a time (one text at least), so a task's memory does not follow its partition.
    """
    keep = df.columns if keep is None else keep
    inside = text in keep
    packed = df.select(F.struct(*[quoted(c) for c in keep]).alias("row"), *([] if inside else [quoted(text).alias("text")]))
    kinds = [ARROW[k] for k in fields.values()]
    names = list(fields)

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            texts = row.field(text) if inside else batch.column("text")
            for start, n in slices(texts):
                got = fn(texts.slice(start, n).to_pylist())
                columns = [pa.array(got[name], kind) for name, kind in zip(names, kinds)]
                yield pa.RecordBatch.from_arrays([row.slice(start, n), *columns], ["row", *names])

    schema = T.StructType([packed.schema["row"], *T._parse_datatype_string(", ".join(f"{n} {k}" for n, k in fields.items())).fields])
    return packed.mapInArrow(run, schema)


def bits_for(rows: int, cell: int = CELL_ROWS) -> int:
    """Hash bits that cut ``rows`` rows into ranges of about ``cell`` rows; grows with the rows."""
    return max(4, math.ceil(math.log2(max(1, rows) / cell)) if rows > cell else 4)


def ranked(df: DataFrame, rows: int, by: list[str], order: str, ties: list[str], name: str) -> DataFrame:
    """Add ``name``: 0-based position within ``by``, along a uniform non-negative 63-bit hash ``order``.

    ``df`` is read twice, so pass a stored table; ``rows`` is its row count.  A hot group is
    cut by hash range, so no window partition grows with it.
    """
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    cell = F.shiftright(F.col(order), 63 - bits_for(rows)).cast("int")
    done = running_sum(one, order, {"_one": "_pos"}, by=by, ties=ties, bucket=cell)
    return done.withColumn(name, F.col("_pos") - 1).drop("_one", "_pos", "_pos_total")


def hash63(*cols: Column | str) -> Column:
    """Non-negative 63-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)
