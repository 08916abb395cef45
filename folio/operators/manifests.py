"""Run manifests as rows: validation, merging, slots, conflicts, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = ("model1", "model2", "model3", "fusion")
#: Slots of a mode, before fusion (fixed values).
MODE_SLOTS = {"single": SLOTS[:1], "dual": SLOTS[:2], "full": SLOTS[:3], "optimized": SLOTS[:3]}


def violation() -> Column:
    """FLT-2: the first rule of validity that a manifest row breaks; null if it is valid. Nulls count as empty."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    none = F.lit(True)
    for s in SLOTS:
        none = none & (text(s) == "")
    return (
        F.when(text("run_id") == "", "run_id is empty")
        .when(~text("run_id").startswith("Run_"), F.concat(F.lit("run_id format invalid: "), text("run_id")))
        .when(text("started_at") == "", "timestamp is empty")
        .when(text("manifest_version") == "", "manifest_version is empty")
        .when(none, "no active models defined")
        .when(text("filename") == "", "source filename is empty")
    )


def mode() -> Column:
    """UDF-5: a mode's spelling made even: 1 is single, 2 is dual; full if null or unknown."""
    m = F.lower(F.trim("mode"))
    return F.when(m == "1", "single").when(m == "2", "dual").when(m.isin(*MODE_SLOTS), m).otherwise("full")


def slots(manifests: DataFrame) -> DataFrame:
    """JON-5: run_id, slot, model of every filled slot."""
    stacked = F.expr(f"stack({len(SLOTS)}, {', '.join(f'{s!r}, {s}' for s in SLOTS)}) as (slot, model)")
    return manifests.select("run_id", stacked).where("model is not null and model <> ''").distinct()


def sequence() -> Column:
    """UDF-4: the models that run, in order: the filled slots of the mode, fusion last."""
    m = mode()

    def slot(s: str) -> Column:
        on = (F.coalesce(F.col(s), F.lit("")) != "") & (F.lit(True) if s == "fusion" else m.isin(*[k for k, v in MODE_SLOTS.items() if s in v]))
        return F.when(on, F.lit(s))

    return F.array_compact(F.array(*[slot(s) for s in SLOTS]))


def merge(base: DataFrame, incoming: DataFrame, key: str = "book_id") -> DataFrame:
    """SET-1, SET-2, SET-3, SET-4: the incoming manifest with the base's categories first, each once, the base's packets
    (rag_packets_used, a map of lists) and failures (partial_run) merged with its own, and the base's notes if it has none.
    All else is the incoming one's. The last two columns are merged where both tables have them."""
    merged = [c for c in ("rag_packets_used", "partial_run") if c in base.columns and c in incoming.columns]
    b = base.select(F.col(key), F.col("categories_active").alias("b_cat"), F.col("notes").alias("b_notes"), *[F.col(c).alias(f"b_{c}") for c in merged])
    empty = F.array().cast("array<string>")
    out = incoming.join(b, key).withColumns({"categories_active": F.array_union(F.coalesce("b_cat", empty), F.coalesce("categories_active", empty)), "notes": F.coalesce("notes", "b_notes")})
    how = {"rag_packets_used": merge_lists, "partial_run": merge_partial}
    for c in merged:
        both = how[c](F.col(f"b_{c}"), F.col(c))
        out = out.withColumn(c, F.coalesce(both, F.col(c), F.col(f"b_{c}")))
    return out.select(*incoming.columns)


def merge_all(manifests: DataFrame, key: str, order: str) -> DataFrame:
    """SET-3 over all runs of a key in order: key, order (of the last run), notes (the last there are), categories (each
    once, as they first occur). Only distinct categories are gathered, never the runs of a key."""
    last = manifests.groupBy(key).agg(F.max(order).alias(order), F.max_by("notes", F.when(F.col("notes").isNotNull(), F.col(order))).alias("notes"))
    each = manifests.select(key, order, F.posexplode("categories_active").alias("pos", "category"))
    first = each.groupBy(key, "category").agg(F.min(F.struct(order, "pos")).alias("at"))
    cats = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "category"))), lambda x: x["category"]).alias("categories_active"))
    return last.join(cats, key, "left").withColumn("categories_active", F.coalesce("categories_active", F.array().cast("array<string>")))


def merge_all_lists(rows: DataFrame, key: str, order: str, name: str, items: str) -> DataFrame:
    """SET-2 over all rows of a key in order: key and a map name -> its items, each once, as they first occur."""
    names = rows.groupBy(key, name).agg(F.lit(1).alias("one")).drop("one")
    each = rows.select(key, order, name, F.posexplode(items).alias("pos", "item"))
    first = each.groupBy(key, name, "item").agg(F.min(F.struct(order, "pos")).alias("at"))
    lists = first.groupBy(key, name).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("items"))
    both = names.join(lists, [key, name], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return both.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "items")))).alias("merged"))


def merge_lists(a: Column, b: Column) -> Column:
    """SET-2: two maps of lists, key by key, each item once."""
    empty = F.array().cast("array<string>")
    return F.map_zip_with(a, b, lambda _, x, y: F.array_union(F.coalesce(x, empty), F.coalesce(y, empty)))


def merge_partial(a: Column, b: Column) -> Column:
    """SET-4: two records of failures (models, chunks, partial), either of which may be null."""
    both = F.struct(
        F.array_union(a["models"], b["models"]).alias("models"), F.array_union(a["chunks"], b["chunks"]).alias("chunks"), (a["partial"] | b["partial"]).alias("partial")
    )
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def categories(default: list[str]) -> Column:
    """FLT-4: the active categories of a manifest, the default if it has none."""
    return F.when(F.size(F.coalesce("categories_active", F.array().cast("array<string>"))) > 0, F.col("categories_active")).otherwise(F.array(*map(F.lit, default)))


def missing_models(manifests: DataFrame, known: DataFrame) -> DataFrame:
    """Slots that name a model without outputs."""
    return slots(manifests).join(known.select(F.col("model_name").alias("model")).where("model is not null").distinct(), "model", "left_anti")


def empty_paths(slots: DataFrame) -> DataFrame:
    """SET-9: run_id, slot of each slot that is set but has an empty path; a null path is no slot."""
    return slots.where(F.col("path").isNotNull() & (F.trim("path") == "")).select("run_id", "slot").distinct()


def unresolved(conflicts: DataFrame, resolved: DataFrame) -> DataFrame:
    """SET-8: conflicts of kinds that weren't resolved, whatever their payload."""
    return conflicts.join(resolved.select("kind").distinct(), "kind", "left_anti")
