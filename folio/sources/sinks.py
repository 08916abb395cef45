"""Sinks: tables partitioned by their natural key, JSON and text forms. Spark's commit protocol is the atomic rename."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import chapter_label, escape_json


def write_chapters(chapters: DataFrame, path: str) -> None:
    """SNK-1: chapters with their file label."""
    chapters.withColumn("label", chapter_label("chapter_id", "title")).write.mode("overwrite").parquet(path)


def write_outputs(outputs: DataFrame, path: str) -> None:
    """SNK-2: outputs in folders by model."""
    outputs.write.mode("overwrite").partitionBy("model_name").parquet(path)


def write_runs(prompts: DataFrame, outputs: DataFrame, logs: DataFrame, path: str) -> None:
    """SNK-2: prompts, outputs and logs of runs, each in folders by model."""
    for name, rows in (("prompts", prompts), ("outputs", outputs), ("logs", logs)):
        write_outputs(rows, f"{path}/{name}")


def write_manifests(manifests: DataFrame, path: str) -> None:
    """SNK-3: manifests as JSON lines."""
    manifests.write.mode("overwrite").json(path)


def embedded(manifest: Column) -> Column:
    """SNK-5: a manifest as the base64 of its JSON."""
    return F.regexp_replace(F.base64(F.encode(F.to_json(manifest), "utf-8")), r"[\r\n]", "")


def progress_line(stage: Column, message: Column, percent: Column) -> Column:
    """SNK-7: a progress event as a JSON line, the fraction with four decimals."""
    p = F.format_string("%.4f", percent)
    return F.concat(F.lit('{"event":"orchestrator_progress","stage":"'), escape_json(stage), F.lit('","message":"'), escape_json(message), F.lit('","percent":'), p, F.lit("}"))


def event_line(event: str, fields: dict[str, Column]) -> Column:
    """SNK-8: an event as a JSON line; null fields are left out."""
    return F.to_json(F.struct(F.lit(event).alias("event"), *[c.alias(k) for k, c in fields.items()]))


def download_percent(written: Column, total: Column) -> Column:
    """SNK-9: per cent of a download with one decimal; 0 of nothing."""
    return F.floor(F.coalesce(F.try_divide(written, total), F.lit(0.0)) * 1000 + 0.5) / 10


def attach(rows: DataFrame, more: DataFrame) -> DataFrame:
    """SNK-6: attachments with more of them, whose ord goes on behind that of their document; an earlier one of a name is
    kept and comes first."""
    last = rows.groupBy("doc").agg(F.max("ord").alias("__last"))
    moved = more.join(last, "doc", "left").withColumn("ord", F.col("ord") + 1 + F.coalesce("__last", F.lit(-1)))
    return rows.select("doc", "ord", "name", "content").unionByName(moved.select("doc", "ord", "name", "content"))


def attachments(rows: DataFrame, name: str) -> DataFrame:
    """SNK-6, SRC-9: the first attachment of a name per document (doc, ord, name, content)."""
    return rows.where(F.col("name") == name).groupBy("doc").agg(F.min_by("content", "ord").alias("content"))
