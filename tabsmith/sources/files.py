"""Delimited files and Parquet."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("UTF-8", "GBK")
STANDARD_CHARSETS = ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32")


def invalid_utf8_files(spark: SparkSession, path: str) -> list[str]:
    """Files with a line that is not UTF-8; names only reach the driver."""
    bad = spark.read.text(path).where(~F.is_valid_utf8("value")).select("_metadata.file_path").distinct()
    return [r[0] for r in bad.collect()]


def scan_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    encoding: str | None = None,
    quoted_newlines: bool = False,
) -> DataFrame:
    """Header CSV with every cell as text; blank lines are skipped.

    Without an explicit encoding, each file that is not valid UTF-8 is read as GBK, the others as UTF-8.
    `quoted_newlines` reads line breaks inside quotes; a file is then read by one task.
    """
    if encoding is None:
        bad = invalid_utf8_files(spark, path)
        plain = {_slashes(f) for f in bad}
        good = [f for f in spark.read.text(path).inputFiles() if _slashes(f) not in plain] if bad else [path]
        parts = [_read_csv(spark, p, delimiter, e, quoted_newlines) for p, e in ((good, ENCODINGS[0]), (bad, ENCODINGS[1])) if p]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return _read_csv(spark, path, delimiter, encoding, quoted_newlines)


def _slashes(uri: str) -> str:
    """A file name for comparison: file:/x and file:///x are the same."""
    return re.sub(r"^(\w+):/+", r"\1:/", uri)


def _read_csv(spark: SparkSession, path: str | list[str], delimiter: str, encoding: str, quoted_newlines: bool) -> DataFrame:
    if encoding.upper() not in STANDARD_CHARSETS:
        # Spark limits CSV charsets to a short list unless the session allows all of Java's.
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return (
        spark.read.option("header", True)
        .option("sep", delimiter)
        .option("encoding", encoding)
        .option("escape", '"')
        .option("inferSchema", False)
        .option("multiLine", quoted_newlines)
        .csv(path)
    )


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def sink_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Quoted CSV with a header; quotes are doubled."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .csv(path)
    )


def preview(df: DataFrame, rows: int = 100) -> DataFrame:
    """The first rows of a frame, without a full scan."""
    return df.limit(rows)


def shape(df: DataFrame) -> DataFrame:
    """Row and column count; Parquet answers the count from its footers."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns))
    )


def sort_page(
    df: DataFrame, by: str, tie: list[str], page: int, size: int, ascending: bool = True
) -> DataFrame:
    """One page of the frame in the order of a column; `tie` makes the order total."""
    key = F.col(f"`{by}`").asc() if ascending else F.col(f"`{by}`").desc()
    return df.orderBy(key, *tie).offset((page - 1) * size).limit(size)


def split_ragged(lines: DataFrame, line_id: str, text: str) -> DataFrame:
    """(line id, cells): runs of tabs are one delimiter, otherwise commas; blank lines go."""
    t = F.rtrim(F.regexp_replace(F.col(text), "\r$", ""))
    t = F.regexp_replace(t, r"\s+$", "")
    cells = F.when(t.contains("\t"), F.split(F.regexp_replace(t, "\t+", ","), ",")).otherwise(
        F.split(t, ",")
    )
    return lines.where(F.trim(F.col(text)) != "").select(line_id, cells.alias("cells"))


def scan_ragged_text(lines: DataFrame, line_id: str, text: str) -> DataFrame:
    """Table from pasted text: short headers get col_i names, short rows are padded with "".

    Only the header line and the widest row's size reach the driver.
    """
    rows = split_ragged(lines, line_id, text)
    head = rows.agg(
        F.max(F.size("cells")).alias("width"),
        F.min_by("cells", line_id).alias("header"),
        F.min(line_id).alias("first"),
    ).first()
    names = list(head["header"]) + [
        f"col_{i + 1}" for i in range(len(head["header"]), head["width"])
    ]
    body = rows.where(F.col(line_id) != F.lit(head["first"]))
    return body.select(
        line_id,
        *[
            F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n)
            for i, n in enumerate(names)
        ],
    )
