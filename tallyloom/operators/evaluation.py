"""Scoring of extraction, classification and transcription models against ground truth.

Predictions: ``model``, ``file``, ``status``, ``seconds``, ``payload``. A model that has no row for a
ground-truth file counts that file as not found.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions import replies

PREDICTION_SCHEMA = "model string, file string, status string, seconds double, payload string, error string"


def run_model(files: DataFrame, model: str, predict: Callable[[str], object]) -> DataFrame:
    """Calls ``predict(path)`` for every file inside Spark tasks, timed and isolated per file.

    ``files``: file, path. The function returns a JSON text, a dict or None; an exception becomes a
    row with status ``error``. It is the caller's model, so this is the one place that runs Python.
    """
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        for batch in batches:
            out = []
            for name, path in zip(batch["file"], batch["path"]):
                begin = time.perf_counter()
                status, payload, error = "success", None, None
                try:
                    answer = predict(path)
                    if answer is None:
                        status = "extraction_returned_none"
                    else:
                        payload = answer if isinstance(answer, str) else json.dumps(answer, ensure_ascii=False, default=str)
                except Exception as exc:  # noqa: BLE001 - any failure of the caller's model is a result row
                    status, error = "error", str(exc)
                out.append((model, name, status, time.perf_counter() - begin, payload, error))
            yield pd.DataFrame(out, columns=["model", "file", "status", "seconds", "payload", "error"])
    return files.select("file", "path").mapInPandas(call, PREDICTION_SCHEMA)


def four_places(value: Column) -> Column:
    return F.floor(value * 10000 + 0.5) / 10000


def outcome(truth: DataFrame, predictions: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """One row per model and ground-truth file, absent predictions as ``file_not_found``.

    ``models``: (model); defaults to the models with predictions. The list is small and known, so it
    is attached to the files as an array rather than joined.
    """
    models = predictions.select("model").distinct() if models is None else models
    listed = models.agg(F.array_sort(F.collect_set("model")).alias("m")).scalar()
    return truth.withColumn("model", F.explode(listed)).join(predictions, ["model", "file"], "left").withColumn(
        "status", F.coalesce("status", F.lit("file_not_found")))


def field_scores(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """(model, file, field, expected, extracted, score) for the successful predictions.

    ``truth``: file, expected map<string,string>; ``payload`` of a prediction is a JSON object. Each prediction meets its file
    once; its payload is parsed, and the expected fields are written out, behind the join, so that only texts are moved and sorted.
    """
    done = predictions.where(F.col("status") == "success").select("model", "file", "payload")
    entries = F.transform(F.map_entries(F.from_json("payload", "map<string,string>")), lambda e: F.struct(
        replies.ground_truth_key(e["key"]).alias("field"), e["value"].alias("value")))
    wanted = (
        done.join(truth.select("file", F.col("expected").alias("all")), "file")
        .select("model", "file", entries.alias("entries"), F.map_filter("all", lambda _, v: v.isNotNull()).alias("all"))
        .select("model", "file", "entries", F.explode("all").alias("field", "expected"))
    )
    # A later key of the reply replaces an earlier one that maps to the same field.
    last = F.try_element_at(F.filter("entries", lambda e: e["field"] == F.col("field")), F.lit(-1))["value"]
    found = wanted.select("model", "file", "field", "expected", last.alias("value"))
    as_list = F.from_json("value", "array<string>")
    extracted = F.when(F.col("value").startswith("["), F.coalesce(F.array_join(as_list, "; "), "value")).otherwise(F.col("value"))
    return found.select("model", "file", "field", "expected", extracted.alias("extracted")).withColumn(
        "score", replies.field_score(F.col("field"), F.col("expected"), F.col("extracted")))


def _mean(column: str) -> Column:
    """Mean of scores of at most 1; summed as decimals so that the result does not depend on the order of rows.

    The sum has 18 digits, which Spark adds as whole numbers; it holds 10^12 rows.
    """
    return F.sum(F.col(column).cast("decimal(8,6)")).cast("double") / F.count(column)


def field_accuracy(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model", "field").agg(four_places(_mean("score")).alias("accuracy"), F.count("*").alias("files"))


def file_accuracy(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model", "file").agg(four_places(_mean("score")).alias("accuracy"))


def model_summary(truth: DataFrame, predictions: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Accuracy over all scored fields, failure rate, times and counts per model.

    Failed files count in the failure rate and not in the accuracy; times leave out files not found.
    A model without any ground-truth file gets accuracy 0 and failure rate 1.
    """
    accuracy = field_scores(truth, predictions).groupBy("model").agg(_mean("score").alias("mean"))
    rows = outcome(truth.select("file"), predictions, models)
    counts = rows.groupBy("model").agg(
        F.count("*").alias("total_files"), F.count_if(F.col("status") == "success").alias("successes"),
        F.sum(F.col("seconds").cast("decimal(20,6)")).cast("double").alias("total_time"), F.count("seconds").alias("timed"))
    everyone = predictions.select("model").distinct() if models is None else models
    return everyone.join(counts, "model", "left").join(accuracy, "model", "left").select(
        "model",
        F.coalesce(four_places(F.col("mean")), F.lit(0.0)).alias("accuracy"),
        F.coalesce(four_places((F.col("total_files") - F.col("successes")) / F.col("total_files")), F.lit(1.0)).alias("failure_rate"),
        F.coalesce(four_places(F.try_divide("total_time", "timed")), F.lit(0.0)).alias("avg_time"),
        F.coalesce(four_places(F.col("total_time")), F.lit(0.0)).alias("total_time"),
        F.coalesce("total_files", F.lit(0)).alias("total_files"), F.coalesce("successes", F.lit(0)).alias("successes"),
        (F.coalesce("total_files", F.lit(0)) - F.coalesce("successes", F.lit(0))).alias("failures"))


def status_counts(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    return outcome(truth.select("file"), predictions).groupBy("model", "status").agg(F.count("*").alias("files"))


def rank_models(summary: DataFrame) -> DataFrame:
    """Ranks by accuracy, speed (only models that took time) and reliability. One row per model, so one task."""
    def place(*order: Column) -> Column:
        return F.rank().over(Window.orderBy(*order))
    timed = F.when(F.col("avg_time") > 0, F.col("avg_time"))
    return summary.select(
        "model", "accuracy", "avg_time", "failure_rate",
        place(F.col("accuracy").desc()).alias("accuracy_rank"),
        place(timed.asc_nulls_last()).alias("speed_rank"),
        place(F.col("failure_rate").asc_nulls_last()).alias("reliability_rank"))


def best_models(summary: DataFrame) -> DataFrame:
    """Best accuracy, fastest and most reliable model; ties go to the model that ran first (``run_no``).

    Models that were not evaluated have a null failure rate and are never the most reliable.
    """
    timed = F.when(F.col("avg_time") > 0, F.struct("avg_time", "run_no"))
    failing = F.when(F.col("failure_rate").isNotNull(), F.struct("failure_rate", "run_no"))
    return summary.agg(
        F.max_by("model", F.struct("accuracy", -F.col("run_no"))).alias("best_accuracy"),
        F.min_by("model", timed).alias("fastest"), F.min_by("model", failing).alias("most_reliable"))


def classification_results(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """(model, file, expected_type, predicted_type, correct); a file without a prediction is not correct."""
    rows = outcome(truth, predictions)
    predicted = F.when(F.col("status") == "success", F.coalesce(F.get_json_object("payload", "$.document_type"), F.lit("other")))
    return rows.select("model", "file", "expected_type", predicted.alias("predicted_type"), "status", "seconds",
                       F.coalesce(predicted == F.col("expected_type"), F.lit(False)).alias("correct"))


def classification_accuracy(results: DataFrame) -> DataFrame:
    """Correct answers over all files, files not found included."""
    return results.groupBy("model").agg(
        F.count_if("correct").alias("correct"), F.count("*").alias("total"),
        four_places(F.count_if("correct") / F.count("*")).alias("accuracy"))


def top_labels(scores: DataFrame, n: int = 5) -> DataFrame:
    """Best ``n`` labels per document with their document type. ``scores``: doc_id, label, score."""
    order = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "label")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select(
        "doc_id", "place", "label", replies.document_type(F.col("label")).alias("app_type"), F.round("score", 4).alias("score"))


def classify(scores: DataFrame) -> DataFrame:
    """Top label, type and the array of the best five labels per document."""
    best = top_labels(scores).groupBy("doc_id").agg(F.array_sort(F.collect_list(
        F.struct("place", "label", "app_type", "score"))).alias("all_scores"))
    top = F.col("all_scores")[0]
    return best.select("doc_id", top["app_type"].alias("document_type"), top["score"].alias("confidence"),
                       top["label"].alias("raw_label"), "all_scores")


def word_errors(pairs: DataFrame) -> DataFrame:
    """Adds ``wer`` to rows with ``reference`` and ``hypothesis``."""
    return pairs.withColumn("wer", replies.word_error_rate(F.col("reference"), F.col("hypothesis")))


def transcription_summary(errors: DataFrame) -> DataFrame:
    """Mean error over the scored rows, 1 when there are none, and accuracy as its complement."""
    mean = F.coalesce(_mean("wer"), F.lit(1.0))
    return errors.groupBy("model").agg(
        four_places(mean).alias("avg_wer"), four_places(1 - mean).alias("accuracy"), F.count("*").alias("total"))
