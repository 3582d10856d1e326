"""Feature preparation, splits and scaling on MLlib pipelines."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    Imputer, MinMaxScaler, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.scalars import is_numeric, number, present
from tabsmith.operators.cleaning import numeric_columns

FEATURES = "features"
SPLIT_PARTS = 10_000


def prepare(df: DataFrame, numeric: list[str], categorical: list[str], target: str | None = None):
    """Typed copy of the model columns: doubles, and text with blanks as "missing"."""
    cols = {c: number(df, c) for c in numeric}
    cols |= {c: F.coalesce(present(df, c).cast("string"), F.lit("missing")) for c in categorical}
    if target is not None and is_numeric(df, target):
        cols[target] = number(df, target)
    return df.withColumns(cols)


def split_roles(df: DataFrame, features: list[str], threshold: float = 0.7) -> tuple[list, list]:
    numeric = numeric_columns(df, features, threshold)
    return numeric, [c for c in features if c not in numeric]


def feature_stages(
    numeric: list[str], categorical: list[str], impute: str = "mean", one_hot: bool = True,
    scale: str = "none",
) -> list:
    """Impute, index or one-hot, assemble and scale; labels unseen in training get their own code."""
    stages, inputs = [], []
    if numeric and impute != "zero":
        outs = [f"_i_{c}" for c in numeric]
        stages.append(Imputer(strategy=impute, inputCols=numeric, outputCols=outs))
        inputs += outs
    else:
        inputs += numeric
    if categorical:
        codes = [f"_c_{c}" for c in categorical]
        stages.append(StringIndexer(inputCols=categorical, outputCols=codes, handleInvalid="keep"))
        if one_hot:
            hot = [f"_h_{c}" for c in categorical]
            stages.append(
                OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=True, handleInvalid="keep")
            )
            inputs += hot
        else:
            inputs += codes
    raw = FEATURES if scale == "none" else "_raw"
    stages.append(VectorAssembler(inputCols=inputs, outputCol=raw, handleInvalid="keep"))
    if scale == "standard":
        stages.append(StandardScaler(inputCol=raw, outputCol=FEATURES, withMean=True, withStd=True))
    elif scale == "minmax":
        stages.append(MinMaxScaler(inputCol=raw, outputCol=FEATURES))
    return stages


def fit_features(df: DataFrame, numeric: list[str], categorical: list[str], **options) -> PipelineModel:
    src = prepare(df, numeric, categorical)
    if options.get("impute") == "zero":
        src = src.na.fill(0.0, numeric)
    return Pipeline(stages=feature_stages(numeric, categorical, **options)).fit(src)


def apply_features(model: PipelineModel, df: DataFrame, numeric: list[str], categorical: list[str], impute: str = "mean"):
    src = prepare(df, numeric, categorical)
    if impute == "zero":
        src = src.na.fill(0.0, numeric)
    out = model.transform(src)
    return out.drop(*[c for c in out.columns if c.startswith(("_i_", "_c_", "_h_", "_raw"))])


def feature_names(model: PipelineModel, df: DataFrame, numeric: list[str], categorical: list[str]):
    """Names of the vector's slots, read from the assembler's metadata before any scaling."""
    out = model.transform(prepare(df, numeric, categorical))
    meta = out.schema["_raw" if "_raw" in out.columns else FEATURES].metadata.get("ml_attr", {})
    found = {a["idx"]: a["name"] for g in meta.get("attrs", {}).values() for a in g}
    names = [found.get(i, f"f{i}") for i in range(meta.get("num_attrs", len(found)))]
    return [n.removeprefix("_i_").removeprefix("_h_").removeprefix("_c_") for n in names]


def bucket(key: list[str], parts: int, seed: int) -> Column:
    """Stable pseudo-random bucket of a row from its key; the same for any layout, and in any engine with MD5."""
    text = F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % parts


def split_holdout(df: DataFrame, key: list[str], test_size: float = 0.2, seed: int = 42):
    b = bucket(key, SPLIT_PARTS, seed)
    cut = int(round(test_size * SPLIT_PARTS))
    return df.where(b >= cut), df.where(b < cut)


def split_kfold(df: DataFrame, key: list[str], k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    return df.withColumn(name, bucket(key, k, seed).cast("int"))


def scale_fit(df: DataFrame, train: Column, columns: list[str], mode: str = "standard") -> DataFrame:
    """Scale with statistics of the training rows only; constant columns become 0."""
    if mode == "none":
        return df
    aggs = []
    for i, c in enumerate(columns):
        x = F.when(train, number(df, c))
        if mode == "standard":
            aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
        else:
            aggs += [F.min(x).alias(f"a{i}"), (F.max(x) - F.min(x)).alias(f"b{i}")]
    fit = df.agg(*aggs).select(F.struct("*")).scalar()
    placed = df.withColumn("_fit", fit)
    new = {
        c: F.when(
            number(df, c).isNotNull(),
            F.when(F.col(f"_fit.b{i}") > 0, (number(df, c) - F.col(f"_fit.a{i}")) / F.col(f"_fit.b{i}")).otherwise(0.0),
        )
        for i, c in enumerate(columns)
    }
    return placed.withColumns(new).drop("_fit")


def dedupe_before_fit(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).dropDuplicates()
