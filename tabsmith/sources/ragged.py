"""Ragged text files read in parallel by ranges of bytes, with line breaks inside quotes.

A job counts the quotes of every range; their running sum tells whether a range begins inside quotes. With that
plan each task finds the first record that starts in its range and reads its last record to the end, whatever
range that lies in. Filters on the named columns are evaluated in the tasks before rows reach the JVM, and
filters on the file or the place drop whole ranges.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.window import Window

from tabsmith.session import scratch_path

RANGE_BYTES = 64 << 20
CHUNK = 4 << 20
BATCH_ROWS = 10_000
PLAN = "path string, start long, end long, inside boolean"
TESTS = {
    EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt,
    LessThanOrEqual: operator.le, In: lambda x, values: x in values,
}


def open_at(path: str, start: int):
    """A file of any file system that Arrow reads, at a byte."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    f = store.open_input_file(name)
    f.seek(start)
    return f


def plan_ranges(spark: SparkSession, path: str, quoted: bool = False, width: int = RANGE_BYTES) -> str:
    """Write the plan of a scan, one row a range of bytes, and return its folder."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(width).cast("long")))
    ranges = files.select("path", "length", starts.alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + width, F.col("length")).alias("end"))
    if quoted:
        counted = ranges.repartition("path", "start").mapInArrow(_count_quotes, "path string, start long, end long, quotes long")
        before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum("quotes").over(before) % 2 == 1, F.lit(False))
        ranges = counted.select("path", "start", "end", inside.alias("inside"))
    else:
        ranges = ranges.withColumn("inside", F.lit(False))
    out = scratch_path(spark, "ranges")
    ranges.write.parquet(out)
    return out


def _count_quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for row in batch.to_pylist():
            left, n = row["end"] - row["start"], 0
            with open_at(row["path"], row["start"]) as f:
                while left and (part := f.read(min(CHUNK, left))):
                    n, left = n + part.count(b'"'), left - len(part)
            counts.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=["path", "start", "end", "quotes"])


def records(path: str, start: int, end: int, inside: bool, quoted: bool) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of every record that starts in a range; a last one without a line break counts."""
    from_ = max(start - 1, 0)
    with open_at(path, from_) as f:
        held, at, begun = [], from_, start == 0
        if begun:
            parity = 0
        else:
            first = f.read(1)
            at, parity = start, int(inside)
            begun = first == b"\n" and not inside
        place = start
        while part := f.read(CHUNK):
            raw = np.frombuffer(part, np.uint8)
            breaks = raw == 10
            if quoted:
                parities = (np.cumsum(raw == 34) + parity) & 1
                breaks &= parities == 0
                parity = int(parities[-1])
            cut = 0
            for b in np.flatnonzero(breaks).tolist():
                if begun:
                    yield place, b"".join([*held, part[cut:b]])
                held, cut, begun, place = [], b + 1, True, at + b + 1
                if place >= end:
                    return
            if begun:
                held.append(part[cut:])
            at += len(part)
        if begun and any(held):
            yield place, b"".join(held)


def cells_of(record: str, quoted: bool = False) -> list[str]:
    """Cells of a record: runs of tabs are one delimiter, commas another; trailing blanks go.

    With `quoted`, delimiters inside quotes are text, and doubled quotes stand for one.
    """
    record = record.rstrip()
    if not quoted or '"' not in record:
        return re.sub("\t+", ",", record).split(",")
    cells = [""]
    for i, text in enumerate(record.split('"')):
        cells[-1] += '"' if i else ""
        parts = [text] if i % 2 else re.sub("\t+", ",", text).split(",")
        cells[-1] += parts[0]
        cells += parts[1:]
    bare = [c[1:-1] if len(c) > 1 and c[0] == c[-1] == '"' else c for c in cells]
    return [c.replace('""', '"') for c in bare]


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, inside: bool):
        super().__init__((path, start))
        self.path, self.start, self.end, self.inside = path, start, end, inside


class RaggedText(DataSource):
    """`ragged`: records of text files by a plan of ranges.

    Options: plan (the folder of `plan_ranges`), quoted, encoding, and columns (JSON list of names) for a column
    a cell, padded with "", the first record of every file left out if `header` is true; without it, `cells` holds them all.
    """

    @classmethod
    def name(cls) -> str:
        return "ragged"

    def schema(self) -> str:
        named = json.loads(self.options.get("columns", "null"))
        cells = ["cells array<string>"] if named is None else ["`" + n.replace("`", "``") + "` string" for n in named]
        return ", ".join(["_path string", "_at long", *cells])

    def reader(self, schema) -> DataSourceReader:
        return RaggedReader(self.options, schema.names)


class RaggedReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.plan = options["plan"]
        self.quoted = options.get("quoted", "false") == "true"
        self.encoding = options.get("encoding", "UTF-8")
        self.names = names
        self.named = "columns" in options
        self.header = options.get("header", "true") == "true"
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        """Comparisons of whole columns with values; the others stay with Spark."""
        for f in filters:
            kept = type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in self.names and f.attribute[0] != "cells"
            if kept:
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        from pyarrow import fs, parquet

        uri = self.plan if re.match(r"^\w+:", self.plan) else f"file://{self.plan}"
        store, folder = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
        found = [Range(r["path"], r["start"], r["end"], r["inside"]) for r in parquet.read_table(folder, filesystem=store).to_pylist()]
        return [r for r in found if self._may_hold(r)] or [Range("", 0, 0, False)]

    def _may_hold(self, r: Range) -> bool:
        """Whether records of a range can pass the filters on file and place."""
        for name, kind, value in self.tests:
            if name == "_path" and not TESTS[kind](r.path, value):
                return False
            if name == "_at":
                best = r.end - 1 if kind in (GreaterThan, GreaterThanOrEqual) else r.start
                if kind is EqualTo and not r.start <= value < r.end:
                    return False
                if kind not in (EqualTo, In) and not TESTS[kind](best, value):
                    return False
        return True

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        kinds = [pa.string(), pa.int64()] + [pa.string() if self.named else pa.list_(pa.string())] * (len(self.names) - 2)
        schema = pa.schema(list(zip(self.names, kinds)))
        tests = [(self.names.index(n), TESTS[k], v) for n, k, v in self.tests]
        width, rows = len(self.names) - 2, []
        for at, raw in records(partition.path, partition.start, partition.end, partition.inside, self.quoted):
            text = raw.decode(self.encoding, "replace")
            if not text.strip() or (self.named and self.header and at == 0):
                continue
            cells = cells_of(text, self.quoted)
            row = [partition.path, at, *((cells + [""] * (width - len(cells)))[:width] if self.named else [cells])]
            if all(test(row[i], value) for i, test, value in tests):
                rows.append(row)
            if len(rows) == BATCH_ROWS:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def header_names(header: list[str], width: int) -> list[str]:
    """Names of the columns: the header's, `col_i` where it is short, and a number behind a name that came before."""
    names: list[str] = []
    for i in range(max(width, len(header))):
        base = name = header[i] if i < len(header) else f"col_{i + 1}"
        n = 1
        while name.lower() in {x.lower() for x in [*names, "_path", "_at"]}:
            n += 1
            name = f"{base}_{n}"
        names.append(name)
    return names


def scan_ragged_files(
    spark: SparkSession, path: str, quoted: bool = False, encoding: str = "UTF-8", width: int = RANGE_BYTES,
    names: list[str] | None = None, header: bool = True,
) -> DataFrame:
    """Table of ragged text files: `_path`, `_at` (byte of the record) and a text column for each cell.

    The first record of the first file (by name) is the header; each file's first record is left out, a blank one
    too. With `header=False` and `names` files hold rows only. Short rows are padded with "". Without `names` one more pass finds the widest row; with them, wider rows are cut to them.
    An unpaired quote under `quoted` makes text of what follows. Files without a record give a ValueError.
    Push-down needs `spark.sql.python.filterPushdown.enabled`, which this sets for the session.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RaggedText)
    read = spark.read.format("ragged").option("plan", plan_ranges(spark, path, quoted, width))
    read = read.option("quoted", str(quoted).lower()).option("header", str(header).lower()).option("encoding", encoding)
    if names is None:
        found = read.load().agg(F.max(F.size("cells")).alias("width"), F.min_by("cells", F.struct("_path", "_at")).alias("header")).first()
        if found["header"] is None:
            raise ValueError(f"no record in {path}")
        names = header_names(found["header"], found["width"])
    return read.option("columns", json.dumps(names)).load()
