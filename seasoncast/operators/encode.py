"""Ordinal codes and one-hot vectors of categorical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasoncast.operators.ranking import with_row_index


def feature_levels(df: DataFrame, feature: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Distinct levels of one feature with codes from 0, sorted within each panel."""
    levels = df.select(*group_cols, feature).filter(F.col(feature).isNotNull()).distinct()
    coded = with_row_index(levels, [*group_cols, feature], name="code")
    if not group_cols:
        return coded
    first = coded.groupBy(*group_cols).agg(F.min("code").alias("_first"))
    return (
        coded.join(first, list(group_cols))
        .withColumn("code", F.col("code") - F.col("_first"))
        .drop("_first")
    )


def ordinal_codes(
    df: DataFrame, features: Sequence[str], group_cols: Sequence[str] = ()
) -> DataFrame:
    """Add ``<feature>_code`` for every feature, each counting from 0."""
    for feature in features:
        levels = feature_levels(df, feature, group_cols).withColumnRenamed(
            "code", f"{feature}_code"
        )
        df = df.join(levels, [*group_cols, feature], "left")
    return df


def level_counts(
    df: DataFrame, features: Sequence[str], group_cols: Sequence[str] = ()
) -> DataFrame:
    """Number of levels per feature."""
    counts = [F.count_distinct(F.col(f)).alias(f"n_{f}") for f in features]
    return df.groupBy(*group_cols).agg(*counts) if group_cols else df.agg(*counts)


def fit_one_hot(
    df: DataFrame, categorical: Sequence[str], passthrough: Sequence[str]
) -> PipelineModel:
    """One-hot encoder over all levels of ``df``, followed by the passed-through columns."""
    codes = [f"{c}_index" for c in categorical]
    hot = [f"{c}_hot" for c in categorical]
    stages = [
        StringIndexer(
            inputCols=list(categorical), outputCols=codes, stringOrderType="alphabetAsc"
        ),
        OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=False),
        VectorAssembler(inputCols=[*hot, *passthrough], outputCol="assembled"),
    ]
    return Pipeline(stages=stages).fit(df)


def encode_one_hot(encoder: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``features``, sparse where that is shorter, so a row does not grow with the levels.

    The categorical metadata is dropped so that trees split on numbers.
    """
    out = encoder.transform(df)
    made = [c for c in out.columns if c not in df.columns]
    plain = F.col("assembled").alias("features", metadata={})
    return out.select(*[c for c in out.columns if c not in {*made, "features"}], plain)
