"""Versioned datasets: immutable Parquet folders `name/version=N` and a catalog of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = "name string, version int, path string, row_count long, columns string"


class VersionStore:
    """Writes each result as the next version of its dataset."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    @property
    def _catalog_path(self) -> str:
        return f"{self.root}/_catalog"

    def catalog(self) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self._catalog_path)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return self.spark.createDataFrame([], CATALOG_SCHEMA)
        return self.spark.read.schema(CATALOG_SCHEMA).parquet(self._catalog_path)

    def save(self, df: DataFrame, name: str) -> int:
        """Write the next version (1 for a new name) and record it. Of two writers each gets a number of its own."""
        known = self.catalog().where(F.col("name") == name).agg(F.max("version")).first()[0]
        version = self._claim(name, (known or 0) + 1)
        path = f"{self.root}/{name}/version={version}"
        df.write.parquet(path)
        rows = self.spark.read.parquet(path).count()
        entry = self.spark.createDataFrame(
            [(name, version, path, rows, ",".join(df.columns))], CATALOG_SCHEMA
        )
        entry.write.mode("append").parquet(self._catalog_path)
        return version

    def _claim(self, name: str, version: int) -> int:
        """The first free version from here on; the claim file is created by one writer only."""
        jvm = self.spark._jvm
        while True:
            claim = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_claims/{name}-{version}")
            fs = claim.getFileSystem(self.spark._jsc.hadoopConfiguration())
            try:
                if fs.createNewFile(claim):
                    return version
            except Exception:  # some stores raise where others say false
                if not fs.exists(claim):
                    raise
            version += 1

    def latest(self, name: str) -> DataFrame:
        row = latest_version(self.catalog().where(F.col("name") == name), "name", "version", "path").first()
        if row is None:
            raise KeyError(name)
        return self.spark.read.parquet(row["path"])


def latest_version(catalog: DataFrame, name: str, version: str, path: str) -> DataFrame:
    """Newest version per dataset."""
    return catalog.groupBy(name).agg(
        F.max(version).alias(version), F.max_by(path, version).alias(path)
    )


def upsert_by_id(remote: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Union by id; the local row wins. One partial aggregate per key."""
    both = remote.withColumn("_side", F.lit(0)).unionByName(local.withColumn("_side", F.lit(1)))
    row = F.max_by(F.struct(*[F.col(f"`{c}`") for c in remote.columns]), "_side")
    return both.groupBy(key).agg(row.alias("_row")).select("_row.*")
