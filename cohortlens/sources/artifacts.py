"""Model artefacts by version: the fitted pipeline and its one-row description."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from py4j.protocol import Py4JJavaError


def save_model(model: PipelineModel, meta: DataFrame, folder: str, version: str) -> None:
    model.write().overwrite().save(f"{folder}/{version}/model")
    meta.coalesce(1).write.mode("overwrite").json(f"{folder}/{version}/meta")


def load_model(folder: str, version: str) -> PipelineModel:
    """The stored pipeline; ``FileNotFoundError`` when that version was never saved."""
    try:
        return PipelineModel.load(f"{folder}/{version}/model")
    except (PySparkException, Py4JJavaError) as error:
        raise FileNotFoundError(f"no model {version!r} in {folder}") from error


def load_meta(spark: SparkSession, folder: str, version: str) -> DataFrame:
    try:
        return spark.read.json(f"{folder}/{version}/meta")
    except PySparkException as error:
        raise FileNotFoundError(f"no description of model {version!r} in {folder}") from error
