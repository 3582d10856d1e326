"""Moments of all pairs of many columns in one scan.

Few columns go through one aggregate expression a pair. Beyond MANY columns the expressions would
outgrow generated code, so each task sums Gram matrices in numpy, with mask matrices for cells that
are missing; a second pass sums the matrices' rows, one row of the matrix at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANY = 10


def pair_moments(wide: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r, n, cov for each pair of double columns, over the rows complete in the pair.

    r is NULL without variance, cov below two rows.
    """
    if len(columns) <= MANY:
        return _by_expressions(wide, columns)
    return _by_matrices(wide, columns)


def _by_expressions(wide: DataFrame, columns: list[str]) -> DataFrame:
    aggs, rows = [], []
    for i, (a, b) in enumerate(combinations(columns, 2)):
        x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
        aggs += [F.corr(x, y).alias(f"_{i}_r"), F.regr_count(y, x).alias(f"_{i}_n"), F.covar_samp(x, y).alias(f"_{i}_cov")]
        cells = [F.col(f"_{i}_{f}").alias(f) for f in ("r", "n", "cov")]
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *cells))
    return wide.agg(*aggs).select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def _by_matrices(wide: DataFrame, columns: list[str]) -> DataFrame:
    k, fields = len(columns), ("n", "sx", "sy", "qx", "qy", "c")
    plain = wide.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    # any shift will do; one near the values keeps the sums well conditioned
    first = plain.limit(100).agg(*[F.avg(c).alias(c) for c in plain.columns]).first()
    shift = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in first])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, c = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            x = np.stack([col.to_numpy(zero_copy_only=False) for col in batch.columns], axis=1).astype(float) - shift
            there = np.isfinite(x)
            x = np.where(there, x, 0.0)
            m = there.astype(float)
            n += m.T @ m
            s += x.T @ m
            q += (x * x).T @ m
            c += x.T @ x
        rows = zip(n, s, s.T, q, q.T, c)
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), *[pa.array(list(v)) for v in cols]], names=["i", *fields])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            parts = [batch.column(1 + f).flatten().to_numpy().reshape(-1, k) for f in range(len(fields))]
            for at, i in enumerate(batch.column(0).to_pylist()):
                row = np.stack([p[at] for p in parts])
                held[i] = held[i] + row if i in held else row
        out: list[tuple] = []
        for i, (n, sx, sy, qx, qy, c) in held.items():
            with np.errstate(all="ignore"):
                co, vx, vy = c - sx * sy / n, qx - sx * sx / n, qy - sy * sy / n
                r, cov = co / np.sqrt(vx * vy), co / (n - 1)
                flat = (vx <= 1e-13 * qx) | (vy <= 1e-13 * qy)
            for j in range(i + 1, k):
                ok = n[j] > 1 and not flat[j]
                out.append((columns[i], columns[j], float(r[j]) if ok else None, int(n[j]), float(cov[j]) if n[j] > 1 else None))
        cols = list(zip(*out)) or [()] * 5
        types = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types)], names=["a", "b", "r", "n", "cov"])

    schema = "i int, " + ", ".join(f"{f} array<double>" for f in fields)
    return plain.mapInArrow(sums, schema).repartition("i").mapInArrow(total, "a string, b string, r double, n long, cov double")
