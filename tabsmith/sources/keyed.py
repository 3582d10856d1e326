"""Datasets by key whose upserts rewrite only the files that hold a changed key.

A version is a list of immutable Parquet files. Every write makes one generation of files, sorted by key, so
that the key ranges of a generation do not overlap, and for each file an index: rows, least and greatest key,
and a Bloom filter in blocks of 256 bits, stored as rows (file, block, four words). An upsert finds by ranges
the one file of each generation that may hold a changed key, joins those pairs with the filters' blocks, reads
the key column of the files left, and rewrites those that really hold a changed key. All others stay as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabsmith.session import materialize

ROWS_PER_FILE = 1_000_000
#: Keys of a block of a filter: one in a hundred absent keys passes.
KEYS_PER_BLOCK = 25
#: Files of a version; their names and ranges are held by the driver and sent to tasks.
MOST_FILES = 1_000_000
WORDS = range(4)


class KeyedStore:
    """One dataset below `root`, with one row a key; NULL is a key like any other.

    Of rows that share a key within one write the greatest, by its columns in order, is taken. A change has the
    columns of the dataset. Of two writers on the same version the second gets a RuntimeError.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, rows_per_file: int = ROWS_PER_FILE):
        self.spark = spark
        self.root = root.rstrip("/")
        self.key = key
        self.rows_per_file = rows_per_file

    def create(self, rows: DataFrame) -> int:
        """Write the first version."""
        return self._commit(1, rows.schema, None, lambda: (self._one_a_key(rows), None))

    def upsert(self, changes: DataFrame) -> int:
        """Write the next version: rows of `changes` replace those of equal key and join the others."""
        version = self.version()
        schema = self.schema(version)
        if sorted(changes.columns) != sorted(schema.names):
            raise ValueError(f"changes need the columns {schema.names}")
        typed = changes.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])

        def work():
            new = self._one_a_key(typed)
            touched = self.files_with(new, version)
            old = self._open(touched, schema).alias("old")
            kept = old.join(new.select(F.col(f"`{self.key}`").alias("_changed")), self._at("old").eqNullSafe(F.col("_changed")), "left_anti")
            return kept.unionByName(new), touched

        return self._commit(version + 1, schema, version, work)

    def version(self) -> int:
        """The newest version that is whole."""
        path = self._path("versions")
        found = path.getFileSystem(self._conf()).globStatus(self._path("versions/*/_SUCCESS"))
        numbers = [int(x.getPath().getParent().getName()) for x in found]
        if not numbers:
            raise KeyError(self.root)
        return max(numbers)

    def schema(self, version: int) -> StructType:
        text = self.spark.read.text(f"{self.root}/schemas/{version}").first()[0]
        return StructType.fromJson(json.loads(text))

    def files(self, version: int | None = None) -> DataFrame:
        """The files of a version: gen, file, n_rows, n_null, low, high, blocks."""
        return self.spark.read.parquet(f"{self.root}/versions/{version or self.version()}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        version = version or self.version()
        names = [(r["gen"], r["file"]) for r in self.files(version).select("gen", "file").collect()]
        return self._open(names, self.schema(version))

    def files_with(self, changes: DataFrame, version: int) -> list[tuple[int, str]]:
        """(gen, file) of the version's files that hold a key of `changes`."""
        index = self.files(version).orderBy("gen", "low").collect()
        if len(index) > MOST_FILES:
            raise ValueError(f"{len(index)} files; create the dataset anew with more rows a file")
        keys = changes.select(F.col(f"`{self.key}`").alias("key"), F.xxhash64(f"`{self.key}`").alias("hash"))
        pairs = keys.where("key IS NOT NULL").mapInPandas(_by_range(index), "gen int, file string, blocks long, hash long")
        null = keys.where("key IS NULL").first()
        if null is not None:
            pairs = pairs.unionByName(self.files(version).where("n_null > 0").select("gen", "file", "blocks", F.lit(null["hash"]).alias("hash")))
        pairs = pairs.withColumn("block", F.pmod("hash", "blocks"))
        if not index:
            return []
        gens = sorted({r["gen"] for r in index})
        bloom = self.spark.read.schema(_bloom_schema()).parquet(*[f"{self.root}/bloom/{g}" for g in gens])
        all_set = [F.col(f"w{i}").bitwiseAND(_bit(i)) != 0 for i in WORDS]
        maybe = pairs.join(bloom, ["file", "block"]).where(all_set[0] & all_set[1] & all_set[2] & all_set[3])
        names = [(r["gen"], r["file"]) for r in maybe.select("gen", "file").distinct().collect()]
        if not names:
            return []
        held = self.spark.read.parquet(*[self._data(*x) for x in names]).select(
            F.col(f"`{self.key}`").alias("own"), F.col("_metadata.file_name").alias("file")
        )
        hit = held.join(keys.select("key"), held["own"].eqNullSafe(F.col("key")), "left_semi")
        hit = {r["file"] for r in hit.select("file").distinct().collect()}
        return [x for x in names if x[1] in hit]

    def _commit(self, version: int, schema: StructType, base: int | None, work) -> int:
        """Claim the version, write its generation of files with their index, then the list of its files."""
        claim = self._path(f"claims/{version}")
        fs = claim.getFileSystem(self._conf())
        if fs.exists(claim) or not fs.createNewFile(claim):
            raise RuntimeError(f"version {version} of {self.root} is being written or was written")
        try:
            rows, replaced = work()
            made = self._write(rows, version, schema)
            if base is not None:
                gone = self.spark.createDataFrame(replaced, "gen int, file string") if replaced else None
                old = self.files(base)
                made = (old.join(gone, ["gen", "file"], "left_anti") if gone is not None else old).unionByName(made)
            text = self.spark.createDataFrame([(schema.json(),)], "value string")
            text.coalesce(1).write.mode("overwrite").text(f"{self.root}/schemas/{version}")
            made.write.mode("overwrite").parquet(f"{self.root}/versions/{version}")
        except BaseException:
            fs.delete(claim, False)
            raise
        return version

    def _write(self, rows: DataFrame, gen: int, schema: StructType) -> DataFrame:
        """Write rows as one generation with its filters; the index of its files."""
        rows = materialize(rows, "keyed")
        parts = max(1, -(-rows.count() // self.rows_per_file))
        key = F.col(f"`{self.key}`")
        (
            rows.repartitionByRange(parts, key).sortWithinPartitions(key)
            .write.mode("overwrite").option("maxRecordsPerFile", self.rows_per_file).parquet(f"{self.root}/data/{gen}")
        )
        here = self.spark.read.schema(schema).parquet(f"{self.root}/data/{gen}")
        held = here.select(F.col("_metadata.file_name").alias("file"), key.alias("key"))
        index = held.groupBy("file").agg(
            F.lit(gen).alias("gen"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("key").isNull()).alias("n_null"),
            F.min("key").alias("low"), F.max("key").alias("high"),
        )
        index = materialize(index.withColumn("blocks", F.ceil(F.col("n_rows") / KEYS_PER_BLOCK)), "index")
        hashed = held.select("file", F.xxhash64("key").alias("hash")).join(index.select("file", "blocks"), "file")
        blocks = hashed.groupBy("file", F.pmod("hash", "blocks").alias("block")).agg(*[F.bit_or(_bit(i)).alias(f"w{i}") for i in WORDS])
        blocks.sortWithinPartitions("file", "block").write.mode("overwrite").parquet(f"{self.root}/bloom/{gen}")
        return index

    def _one_a_key(self, rows: DataFrame) -> DataFrame:
        whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        return materialize(rows.groupBy(F.col(f"`{self.key}`").alias("_key")).agg(F.max(whole).alias("_row")).select("_row.*"), "changes")

    def _open(self, names: list[tuple[int, str]], schema: StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._data(*x) for x in names])

    def _at(self, side: str):
        return F.col(f"{side}.`{self.key}`")

    def _data(self, gen: int, file: str) -> str:
        return f"{self.root}/data/{gen}/{file}"

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _conf(self):
        return self.spark._jsc.hadoopConfiguration()


def _bit(word: int):
    """The bit a key sets in one of its block's words."""
    return F.expr(f"shiftleft(1L, cast(shiftright(xxhash64(hash), {6 * word}) & 63L as int))")


def _bloom_schema() -> str:
    return "file string, block long, " + ", ".join(f"w{i} long" for i in WORDS)


def _by_range(index: list):
    """For each key, none of them NULL, the one file a generation whose range holds it."""
    gens: dict[int, list] = {}
    for r in index:
        if r["low"] is not None:
            gens.setdefault(r["gen"], []).append(tuple(r[c] for c in ("file", "blocks", "low", "high")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, hashes = frame["key"].to_numpy(), frame["hash"].to_numpy()
            for gen, files in gens.items():
                lows, highs = (pd.Series([x[i] for x in files]).to_numpy() for i in (2, 3))
                at = np.searchsorted(lows, keys, side="right") - 1
                inside = (at >= 0) & (keys <= highs[np.maximum(at, 0)])
                at = at[inside].tolist()
                if at:
                    cells = {"gen": gen, "file": [files[i][0] for i in at], "blocks": [files[i][1] for i in at]}
                    yield pd.DataFrame({**cells, "hash": hashes[inside]})

    return run
