"""Saved models with everything needed to score and to check them again."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.calibration import apply_knots

KIND = "scored-model"
PREFIX = "churn_artifact_seed"
_META = (
    "name string, kind string, threshold double, has_calibrator boolean, features array<string>, "
    "metadata string, metrics map<string,double>, comparison string"
)


@dataclass
class Bundle:
    """Fitted pipeline, operating threshold, the calibrator's blocks and provenance."""

    model: PipelineModel
    threshold: float
    calibrator: DataFrame | None
    features: list[str]
    metadata: dict = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=dict)
    comparison: list[dict] = field(default_factory=list)

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Raw probability; feature columns the table lacks are imputed."""
        missing = [c for c in self.features if c not in df.columns]
        numeric = set(self.metadata.get("numeric", ()))
        padded = df.withColumns(
            {c: F.lit(None).cast("double" if c in numeric else "string") for c in missing}
        )
        scored = self.model.transform(padded)
        return scored.withColumn(name, vector_to_array("probability")[1]).drop(
            "rawPrediction", "probability", "prediction", *missing
        )

    def score_calibrated(self, df: DataFrame, name: str = "calibrated") -> DataFrame:
        """Raw and calibrated probability; both are equal without a calibrator."""
        scored = self.score(df)
        if self.calibrator is None:
            return scored.withColumn(name, F.col("score"))
        return apply_knots(scored, self.calibrator, "score", name)


def save_bundle(spark: SparkSession, bundle: Bundle, registry: str, seed: int) -> str:
    """Save under the registry folder; the metadata row is written last."""
    name = f"{PREFIX}{seed}"
    path = f"{registry.rstrip('/')}/{name}"
    bundle.model.write().overwrite().save(f"{path}/model")
    if bundle.calibrator is not None:
        bundle.calibrator.write.mode("overwrite").parquet(f"{path}/calibrator")
    row = (
        name,
        KIND,
        float(bundle.threshold),
        bundle.calibrator is not None,
        bundle.features,
        json.dumps(bundle.metadata, sort_keys=True),
        {k: float(v) for k, v in bundle.metrics.items()},
        json.dumps(bundle.comparison, sort_keys=True),
    )
    spark.createDataFrame([row], _META).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return path


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """Load a saved bundle; anything else in its place is refused."""
    meta = spark.read.schema(_META).json(f"{path}/meta").first()
    if meta is None or meta["kind"] != KIND:
        raise TypeError(f"{path} holds no {KIND}")
    return Bundle(
        model=PipelineModel.load(f"{path}/model"),
        threshold=meta["threshold"],
        calibrator=spark.read.parquet(f"{path}/calibrator")
        if meta["has_calibrator"]
        else None,
        features=list(meta["features"]),
        metadata=json.loads(meta["metadata"]),
        metrics=dict(meta["metrics"]),
        comparison=json.loads(meta["comparison"]),
    )


def registry_table(spark: SparkSession, registry: str) -> DataFrame:
    """One row per saved bundle."""
    return spark.read.schema(_META).json(f"{registry.rstrip('/')}/{PREFIX}*/meta")


def load_default_bundle(spark: SparkSession, registry: str) -> Bundle:
    """The bundle whose name comes first; an empty registry is an error."""
    try:
        name = registry_table(spark, registry).agg(F.min("name")).first()[0]
    except AnalysisException:
        name = None
    if name is None:
        raise FileNotFoundError(f"no saved model under {registry}; train one first")
    return load_bundle(spark, f"{registry.rstrip('/')}/{name}")
