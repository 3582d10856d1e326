"""What the operators share: words, narrow inputs and Arrow mappings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, which may hold dots or back quotes."""
    return df["`" + name.replace("`", "``") + "`"]


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """The whole row as one struct `row`, beside working columns: no name can clash."""
    return df.select(F.struct(*[column(df, c) for c in df.columns]).alias("row"), *[c.alias(n) for n, c in extra.items()])


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    """Back from `packed`: the columns of `like` in their order."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in like.columns])


def map_batches(df: DataFrame, schema: T.StructType | str, make: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """Apply a function from columns (name to list) to columns, batch by batch.

    `make` runs once per task and returns that function, so state such as a cache lives as long as
    the task. Nothing crosses partitions, and a lost task is simply run again.
    """
    out = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, fn = to_arrow_schema(out), make()
        for batch in batches:
            for part in _light(batch):
                cols = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def _light(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that one part holds about `most` bytes (a single row may hold more)."""
    n = batch.num_rows
    parts = max(1, min(n, -(-batch.nbytes // most)))
    step = -(-n // parts) if n else 1
    for i in range(0, n, step):
        yield batch.slice(i, step)
