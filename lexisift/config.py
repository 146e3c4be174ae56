"""Settings: defaults of the service, the training pipeline and the ensemble, overlaid by a JSON file."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

# The defaults.
SERVICE: dict[str, Any] = {
    "neural_weight": 0.4,
    "statistical_weight": 0.4,
    "rule_weight": 0.2,
    "consensus_threshold": 0.6,
    "error_confidence_threshold": 0.5,
    "max_text_length": 10000,
    "batch_size": 32,
}
ENSEMBLE: dict[str, Any] = {
    "neural_weight": 0.35,
    "statistical_weight": 0.45,
    "rule_weight": 0.20,
    "consensus_threshold": 0.65,
    "error_confidence_threshold": 0.50,
    "character_ngrams": [3, 4, 5],
    "syllable_ngrams": [2, 3, 4],
    "smoothing_method": "good_turing",
    "min_khmer_ratio": 0.6,
    "min_text_length": 50,
}


def overlaid(defaults: dict[str, Any], text: str | None) -> dict[str, Any]:
    """The defaults with the top-level keys of a JSON object in their place; no text or no JSON object leaves them."""
    try:
        own = json.loads(text) if text else {}
    except json.JSONDecodeError:
        own = {}
    return defaults | (own if isinstance(own, dict) else {})


def load(spark: SparkSession, path: str, defaults: dict[str, Any] = SERVICE) -> dict[str, Any]:
    """Settings of a JSON file on any file system that Spark reads; a missing file leaves the defaults."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path, wholetext=True).limit(1).collect()
    except AnalysisException:
        rows = []
    return overlaid(defaults, rows[0]["value"] if rows else None)


def save(spark: SparkSession, settings: dict[str, Any], path: str) -> None:
    """Settings or results as one JSON text file."""
    spark.createDataFrame([(json.dumps(settings, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def integrator(settings: dict[str, Any]):
    """The integrator's settings of a configuration; keys it has no place for are left out."""
    from lexisift.operators.integrator import Settings

    return Settings(**{k: v for k, v in settings.items() if k in Settings.__dataclass_fields__})
