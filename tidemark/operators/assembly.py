"""Feature assembly: groups of columns, each scaled and weighted, as a fitted pipeline that is saved, loaded and applied to later rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALERS = ("standard", "minmax", "robust")


def elements(name: str, size: int) -> list[str]:
    """Expressions of the first ``size`` elements of an array column."""
    return [f"get(`{name}`, {i})" for i in range(size)]


def one_hot(rows: DataFrame, name: str, most: int) -> list[str]:
    """Expressions of 1 or 0 for the ``most`` most frequent values of an integer column (null as 0), ties to the smaller; zeros where there are fewer."""
    top = rows.groupBy(F.coalesce(F.col(name), F.lit(0)).alias("v")).count().orderBy(F.desc("count"), "v").limit(most).collect()
    return [f"CASE WHEN coalesce(`{name}`, 0) = {r['v']} THEN 1.0D ELSE 0.0D END" for r in top] + ["0.0D"] * (most - len(top))


@dataclass
class Assembly:
    """A fitted pipeline and the columns it was fitted on."""

    pipeline: PipelineModel
    schema: T.StructType

    def apply(self, rows: DataFrame) -> DataFrame:
        """The rows with a vector for each group, named by it, and ``features``, all of them in order; columns that the rows don't have count as missing."""
        lost = [f for f in self.schema if f.name not in rows.columns]
        out = self.pipeline.transform(rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in lost}) if lost else rows)
        return out.drop(*(c for c in out.columns if c.startswith("_part_")), *(f.name for f in lost))

    def save(self, folder: str) -> None:
        self.pipeline.write().save(f"{folder}/pipeline")
        SparkSession.active().createDataFrame([(self.schema.json(),)], "schema string").coalesce(1).write.parquet(f"{folder}/columns")

    @staticmethod
    def load(folder: str) -> Assembly:
        import json

        kept = SparkSession.active().read.parquet(f"{folder}/columns").first()["schema"]
        return Assembly(PipelineModel.load(f"{folder}/pipeline"), T.StructType.fromJson(json.loads(kept)))


def _centre_and_width(scaler: str, value) -> tuple:
    if scaler == "standard":
        return F.avg(value), F.stddev_pop(value)
    if scaler == "minmax":
        return F.min(value), F.max(value) - F.min(value)
    low, middle, high = (F.percentile(value, p) for p in (0.25, 0.5, 0.75))
    return middle, high - low


def fit(rows: DataFrame, groups: dict[str, list[str]], scaler: str = "standard", weights: dict[str, float] | None = None) -> Assembly:
    """Fits groups (name to SQL expressions over the columns) in one pass over the rows.

    A missing value (null) is 0 before scaling; NaN and infinities are left out of the fit and 0
    after it, as is a column without width (population deviation, range or quartile range); an
    empty table fits zeros.  Each group is scaled by itself and multiplied by its weight (1)."""
    if scaler not in SCALERS:
        raise ValueError(f"scaler must be one of {SCALERS}")
    named = [(g, i, e) for g, parts in groups.items() for i, e in enumerate(parts)]
    raw = rows.select(*(F.expr(f"coalesce(CAST({e} AS DOUBLE), 0.0D)").alias(f"x{n}") for n, (_, _, e) in enumerate(named)))
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))  # noqa: E731  NaN is larger than infinity
    both = [_centre_and_width(scaler, finite(f"x{n}")) for n in range(len(named))]
    at = raw.agg(*(c.cast("double").alias(f"{p}{n}") for n, pair in enumerate(both) for p, c in zip("cw", pair, strict=True))).first()
    stages, done = [], []
    for g, parts in groups.items():
        scaled = []
        for i, e in enumerate(parts):
            n = named.index((g, i, e))
            centre, width, weight = at[f"c{n}"], at[f"w{n}"], (weights or {}).get(g, 1.0)
            x = f"coalesce(CAST({e} AS DOUBLE), 0.0D)"
            value = f"CASE WHEN abs({x}) < double('Infinity') THEN ({x} - double('{centre!r}')) / double('{width!r}') * double('{weight!r}') ELSE 0.0D END" if width else "0.0D"
            scaled.append(f"{value} AS `_part_{g}_{i}`")
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__"))
        stages.append(VectorAssembler(inputCols=[f"_part_{g}_{i}" for i in range(len(parts))], outputCol=g))
        done.append(g)
    stages.append(VectorAssembler(inputCols=done, outputCol="features"))
    return Assembly(PipelineModel(stages), rows.schema)
