"""Saving and loading of what a matchday prediction needs: both models, blend configuration and calibrator."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession

from touchline import settings
from touchline.operators.boosting import Ensemble
from touchline.operators.models import BinaryTrees, LogitModel, Preparation, TreesModel, VectorScaling
from touchline.schemas import MODEL_COLUMNS
from touchline.sources import writers

FORMAT = 1
_PREPARATION = "model string, at int, name string, median double, mean double, deviation double"
_MANIFEST = ("format int, signs array<string>, logit_columns array<string>, tree_columns array<string>, tree_parts int, "
             "calibrator_rows long, config string")


@dataclass(frozen=True)
class PredictionModels:
    """The trained parts of a matchday prediction. ``calibrator`` may be missing, as after a training with too few rows."""

    logit: LogitModel
    trees: TreesModel
    config: Mapping
    calibrator: VectorScaling | None = None

    def columns(self) -> set[str]:
        """Feature columns that scoring reads."""
        parts = [self.logit.preparation, *[p.preparation for p in self.trees.parts]]
        return {c for p in parts for c in p.columns} | {"division"}

    def require_columns(self, df: DataFrame) -> None:
        if missing := sorted(self.columns() - set(df.columns)):
            raise ValueError(f"columns the models were trained on are missing: {', '.join(missing)}")


def save(spark: SparkSession, models: PredictionModels, folder: str) -> str:
    """Write all parts beside their names, then rename them together, the manifest last. Nothing is overwritten."""
    logit, trees, scaling = models.logit, models.trees, models.calibrator
    rows = [("logit", i, c, *_figures(logit.preparation, c)) for i, c in enumerate(logit.preparation.columns)]
    for k, part in enumerate(trees.parts):
        rows += [(f"trees-{k}", i, c, *_figures(part.preparation, c)) for i, c in enumerate(part.preparation.columns)]
    manifest = (
        FORMAT, list(settings.SIGNS), list(logit.columns), list(trees.parts[0].columns), len(trees.parts),
        scaling.rows if scaling else None, json.dumps(dict(models.config), sort_keys=True),
    )
    estimators: dict[str, MLWritable] = {
        "logit-division": logit.indexer, "logit-encoder": logit.encoder, "logit": logit.model,
        **({"calibrator": scaling.model} if scaling else {}),
    }
    parts: dict[str, Callable[[str], None]] = {
        f"{folder}/{name}": lambda path, model=model: model.write().save(path) for name, model in estimators.items()
    }
    for k, part in enumerate(trees.parts):
        parts[f"{folder}/trees-{k}"] = lambda path, model=part.model: model.save(spark, path)
    parts[f"{folder}/preparation"] = lambda path: spark.createDataFrame(rows, _PREPARATION).coalesce(1).write.parquet(path)
    parts[f"{folder}/manifest"] = lambda path: spark.createDataFrame([manifest], _MANIFEST).coalesce(1).write.json(path)
    writers.publish(spark, parts)
    return folder


def _figures(p: Preparation, column: str) -> tuple[float, float, float]:
    return p.medians[column], p.means[column], p.deviations[column]


def load(spark: SparkSession, folder: str, known: Sequence[str] = MODEL_COLUMNS) -> PredictionModels:
    """What ``save`` wrote, fit for scoring.

    A folder without a manifest, another format or class order, or a feature outside ``known`` fails here, not in a score.
    """
    try:
        manifest = spark.read.schema(_MANIFEST).json(f"{folder}/manifest").first()
    except AnalysisException:
        manifest = None
    if manifest is None:
        raise FileNotFoundError(f"no whole set of models in {folder}")
    if manifest["format"] != FORMAT or tuple(manifest["signs"]) != tuple(settings.SIGNS):
        raise ValueError(f"format {manifest['format']} with classes {manifest['signs']} is not read here")
    strange = sorted({*manifest["logit_columns"], *manifest["tree_columns"]} - set(known))
    if strange:
        raise ValueError(f"trained on features that are not known here: {', '.join(strange)}")

    figures: dict[str, list] = {}
    for r in spark.read.schema(_PREPARATION).parquet(f"{folder}/preparation").orderBy("model", "at").collect():
        figures.setdefault(r["model"], []).append(r)  # a row per feature and model

    def preparation(model: str) -> Preparation:
        rows = figures.get(model, [])
        return Preparation(tuple(r["name"] for r in rows), *[{r["name"]: r[f] for r in rows} for f in ("median", "mean", "deviation")])

    logit = LogitModel(manifest["logit_columns"])
    logit.preparation = preparation("logit")
    logit.indexer = StringIndexerModel.load(f"{folder}/logit-division")
    logit.encoder = OneHotEncoderModel.load(f"{folder}/logit-encoder")
    logit.model = LogisticRegressionModel.load(f"{folder}/logit")
    trees = TreesModel(manifest["tree_columns"])
    trees.parts = [BinaryTrees(manifest["tree_columns"]) for _ in range(manifest["tree_parts"])]
    for k, part in enumerate(trees.parts):
        part.preparation, part.model = preparation(f"trees-{k}"), Ensemble.load(spark, f"{folder}/trees-{k}")
    scaling = None
    if manifest["calibrator_rows"] is not None:
        scaling = VectorScaling()
        scaling.rows, scaling.model = manifest["calibrator_rows"], LogisticRegressionModel.load(f"{folder}/calibrator")
    return PredictionModels(logit, trees, json.loads(manifest["config"]), scaling)


def load_or_train(spark: SparkSession, folder: str, train: Callable[[], PredictionModels], known: Sequence[str] = MODEL_COLUMNS) -> PredictionModels:
    """The saved models, or those that ``train`` fits, saved for the next call."""
    try:
        return load(spark, folder, known)
    except FileNotFoundError:
        save(spark, trained := train(), folder)
        return trained
