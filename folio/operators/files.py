"""Listings of files: shards, verification, downloads, libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD = r"\.gguf\.(\d+)$"


def shard_index(name: Column) -> Column:
    """FLT-10: the index in name.gguf.N; null for any other name."""
    return F.when(name.rlike(SHARD), F.regexp_extract(name, SHARD, 1).cast("long"))


def shards(listing: DataFrame) -> DataFrame:
    """AGG-7, SET-6: per repo its shards, bytes and whether they are continuous: largest - least index + 1 = their number.

    listing: repo, filename, size. Files that are no weight files take no part; a base file has no index."""
    rows = listing.where(F.lower("filename").rlike(r"\.gguf(\.\d+)?$")).withColumn("i", shard_index(F.col("filename")))
    n = F.count("i")
    return rows.groupBy("repo").agg(
        F.count(F.lit(1)).alias("shards"), F.sum("size").alias("bytes"), ((n == 0) | (F.max("i") - F.min("i") + 1 == n)).alias("continuous")
    )


def state(files: DataFrame) -> DataFrame:
    """AGG-8: per repo bytes, bytes there, the share of them (0 of nothing) and whether all are there."""
    done = F.sum(F.when(F.col("downloaded"), F.col("size")).otherwise(0))
    total = F.sum("size")
    return files.groupBy("repo").agg(
        total.alias("total"), done.alias("done"), F.round(F.coalesce(F.try_divide(done, total), F.lit(0.0)), 6).alias("progress"), F.bool_and("downloaded").alias("complete")
    )


def verify(expected: DataFrame, found: DataFrame) -> DataFrame:
    """JON-6: repo, filename and the first fault of each expected file: missing, size, checksum; null without one."""
    f = found.select("repo", "filename", F.col("size").alias("f_size"), F.col("sha256").alias("f_sha"), F.lit(True).alias("there"))
    fault = (
        F.when(F.col("there").isNull(), "missing")
        .when((F.col("size") > 0) & (F.col("size") != F.col("f_size")), "size")
        .when(F.col("sha256").isNotNull() & (F.col("sha256") != F.coalesce("f_sha", F.lit(""))), "checksum")
    )
    return expected.join(f, ["repo", "filename"], "left").select("repo", "filename", fault.alias("fault"))


def first_faults(expected: DataFrame, found: DataFrame) -> DataFrame:
    """JON-6: per repo the first file, in the order ord of expected, that has a fault, and the fault; a sound repo has no row."""
    faults = verify(expected, found).where("fault is not null").join(expected.select("repo", "filename", "ord"), ["repo", "filename"])
    return faults.groupBy("repo").agg(F.min(F.struct("ord", "filename", "fault")).alias("f")).select("repo", "f.filename", "f.fault")


def partial_downloads(listing: DataFrame) -> DataFrame:
    """SRC-10: weight files that are still being written, by name: filename without .part and size in MB (of the largest of a
    name). Sorted (SRT-1)."""
    rows = listing.where(F.lower("filename").endswith(".gguf.part")).select(F.regexp_replace("filename", r"(\.part)+$", "").alias("filename"), "size")
    return rows.groupBy("filename").agg((F.max("size") / 1048576).alias("size_mb")).orderBy("filename")


def ordered_shards(listing: DataFrame) -> DataFrame:
    """SET-6: repo, filenames of its weight files by index (the file without one first), then by name."""
    rows = listing.where(F.lower("filename").rlike(r"\.gguf(\.\d+)?$")).withColumn("i", F.coalesce(shard_index(F.col("filename")), F.lit(-1)))
    ordered = F.array_sort(F.collect_list(F.struct("i", "filename")))  # the files of one model
    return rows.groupBy("repo").agg(F.transform(ordered, lambda x: x["filename"]).alias("filenames"))


def whole(listing: DataFrame) -> DataFrame:
    """SRC-13, JON-7: files without a sibling that is still being written (name.part)."""
    part = listing.where(F.col("filename").endswith(".part")).select("repo", F.expr("substring(filename, 1, length(filename) - 5)").alias("filename"))
    return listing.where(~F.col("filename").endswith(".part")).join(part, ["repo", "filename"], "left_anti")


def cached(listing: DataFrame) -> DataFrame:
    """SRC-13: repo, shards and bytes of the sets of weight files that are there whole: a set in which one file is still
    being written (name.part), or that has no weight file, isn't there."""
    rows = listing.where(F.col("filename").rlike(r"(\.gguf|\.gguf\.\d+)$")).select("repo", "filename", "size")
    part = listing.where(F.col("filename").endswith(".part")).select("repo", F.expr("substring(filename, 1, length(filename) - 5)").alias("filename"))
    broken = rows.join(part, ["repo", "filename"], "left_semi").select("repo").distinct()
    return rows.join(broken, "repo", "left_anti").groupBy("repo").agg(F.count(F.lit(1)).alias("shards"), F.sum("size").alias("bytes"))


def first_weight_file(listing: DataFrame) -> DataFrame:
    """LIM-1: the first weight file of each folder, by name."""
    return listing.where(F.lower("filename").endswith(".gguf")).groupBy("repo").agg(F.min("filename").alias("filename"))


def choose_asset(assets: DataFrame, wanted: str, fallback: str, prefix: str, suffix: str = ".zip") -> DataFrame:
    """PER-7: per release its first asset, by place, whose name has the prefix, the suffix and the wanted word; else with the
    fallback word; a release without either has no row. assets: release, ord, name."""
    fits = assets.where(F.col("name").startswith(prefix) & F.col("name").endswith(suffix))
    rank = F.when(F.col("name").contains(wanted), 0).when(F.col("name").contains(fallback), 1)
    return fits.withColumn("rank", rank).where("rank is not null").groupBy("release").agg(F.min(F.struct("rank", "ord", "name"))["name"].alias("name"))


def upsert(state: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """PER-12: state after changes in order: the last one of a key decides; op is put (its row replaces the key's or is
    added), reset (the key's row stays with done 0 and complete false; nothing without one) or remove.

    state: key, done, complete; changes: key, order, op, done, complete. A reset behind a put or remove acts on it, so only
    the last put or remove of a key and the resets behind it matter."""
    solid = F.when(F.col("op") != "reset", F.col(order))
    last = changes.groupBy(key).agg(
        F.max(solid).alias("at"), F.max_by("op", solid).alias("op"), F.max_by("done", solid).alias("new_done"), F.max_by("complete", solid).alias("new_complete"),
        F.max(F.when(F.col("op") == "reset", F.col(order))).alias("reset"),
    )
    both = state.join(last, key, "full_outer")
    was_reset = F.coalesce(F.col("reset") > F.coalesce("at", F.lit(-1)), F.lit(False))
    put = F.col("op") == "put"
    there = F.when(F.col("op").isNotNull(), put).otherwise(F.col("complete").isNotNull())
    done, complete = F.when(put, F.col("new_done")).otherwise(F.col("done")), F.when(put, F.col("new_complete")).otherwise(F.col("complete"))
    return both.where(there).select(key, F.when(was_reset, 0).otherwise(done).cast("long").alias("done"), (complete & ~was_reset).alias("complete"))


def library(listing: DataFrame) -> DataFrame:
    """SRC-10, SET-7, SRT-1: distinct weight files with their size in MB, sorted by name."""
    mb = F.floor(F.max("size") / 1048576)
    return listing.where(F.lower("filename").endswith(".gguf")).groupBy("filename").agg(mb.alias("size_mb")).orderBy("filename")
