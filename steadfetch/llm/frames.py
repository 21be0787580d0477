"""Carries a table's own columns through an operator, whatever they are called."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "row"


def position(df: DataFrame, name: str) -> int:
    """Where column `name` is: an exact match first, else the first that differs in case only."""
    if name in df.columns:
        return df.columns.index(name)
    lower = [c.lower() for c in df.columns]
    if name.lower() not in lower:
        raise ValueError(f"no column {name} among {df.columns}")
    return lower.index(name.lower())


def pack(df: DataFrame, **needed: str) -> DataFrame:
    """One column per `needed` name (name in the operator = name in `df`) and `row` with all of `df`.

    Inside `row` columns are named by place, so repeated names and names that an operator
    uses itself cannot clash. Columns that nobody reads later are pruned from the scan.
    """
    places = [f"c{i}" for i in range(len(df.columns))]
    flat = df.toDF(*places)
    values = {
        p: F.col(p).cast("string") if f.dataType.typeName() == "void" else F.col(p)
        for p, f in zip(places, df.schema.fields)
    }
    keys = [values[places[position(df, name)]].alias(key) for key, name in needed.items()]
    return flat.select(*keys, F.struct(*[v.alias(p) for p, v in values.items()]).alias(ROW))


def unpack(df: DataFrame, names: list[str], replaced: dict[str, Column] | None = None, **added: Column) -> DataFrame:
    """The packed columns under their `names`, with some replaced in place, and new ones at the end.

    A packed column with the name of an added one gives way to it.
    """
    taken = {name.lower() for name in added}
    replaced = replaced or {}
    own = [
        replaced.get(name, F.col(f"{ROW}.c{i}")).alias(name)
        for i, name in enumerate(names) if name.lower() not in taken
    ]
    return df.select(*own, *[value.alias(name) for name, value in added.items()])


def hashable(df: DataFrame, column: str = ROW) -> Column:
    """A 64-bit hash of the packed row; maps and the like are left out of it."""
    fields = df.schema[column].dataType.fields
    usable = [f"{column}.{f.name}" for f in fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*[F.col(c) for c in usable])


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; free memory goes back to the system after each, as workers live on after a stage."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if trim is not None:
            trim(0)
