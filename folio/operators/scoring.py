"""Scores of models by category: counting, penalties, averages, wins, consensus.

All groups are aggregated with partial sums; no window runs over a whole history, and the newest books come from a
distinct list of book numbers. Ties go to the smaller model name. Null scores take no part; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.numeric import penalised
from folio.functions.text import bound, mentions_in

#: Books of the window, books it needs, least margin, tie margin, least share of wins (fixed values).
WINDOW, MARGIN, TIE, WIN_SHARE = 10, 0.05, 0.01, 0.7
#: Categories whose keywords are counted in one expression, or one block.
CATEGORIES = 1000


def scores(outputs: DataFrame, categories: DataFrame, text: str = "text", distinct: list[str] | None = None) -> DataFrame:
    """JON-1, AGG-1, AGG-2: hits of every category's keyword in the outputs of every (book_id, model_name), and ln(1 + hits).

    categories: category, keyword. Up to CATEGORIES rows are collected into one expression, so each text is read once;
    more are put into blocks of so many, and each text meets each block once, by block number. A null text has no hits;
    every pair keeps its row. distinct: columns of which repeated rows count once; they are told after counting, so texts
    are never moved."""
    rows = [(r["category"], r["keyword"]) for r in categories.limit(CATEGORIES + 1).collect()]
    low = F.lower(F.coalesce(text, F.lit("")))
    head = list(dict.fromkeys(["book_id", "model_name", *(distinct or [])]))
    if len(rows) <= CATEGORIES:
        counts = bound(low, lambda t: F.array(*[F.struct(F.lit(c).alias("category"), mentions_in(t, k).alias("hits")) for c, k in rows]))
        each = outputs.select(*head, counts.alias("c"))
    else:
        numbered = categories.select("category", "keyword", F.pmod(F.xxhash64("category", "keyword"), F.lit(-(-categories.count() // CATEGORIES))).cast("int").alias("__block"))
        blocks = numbered.groupBy("__block").agg(F.collect_list(F.struct("category", "keyword")).alias("__words"))
        n = blocks.agg(F.max("__block")).first()[0]
        met = outputs.select(*head, low.alias("__low"), F.explode(F.sequence(F.lit(0), F.lit(n))).alias("__block")).join(blocks, "__block")
        counts = F.transform("__words", lambda w: F.struct(w["category"].alias("category"), mentions_in(F.col("__low"), w["keyword"]).alias("hits")))
        each = met.select(*head, counts.alias("c"))
    if distinct:
        block = F.transform("c", lambda x: x["category"])  # rows of one text differ by their block only
        each = each.withColumn("__c", F.xxhash64(block)).dropDuplicates([*distinct, "__c"]).drop("__c")
    each = each.select("book_id", "model_name", F.explode("c").alias("c")).select("book_id", "model_name", "c.category", "c.hits")
    total = each.groupBy("book_id", "model_name", "category").agg(F.sum("hits").alias("hits"))
    return total.withColumn("score", F.round(F.log1p("hits"), 6)).withColumn("false_positives", F.lit(0).cast("long"))


def history(raw: DataFrame) -> DataFrame:
    """Distinct rows with a score, penalised."""
    rows = raw.select("book_seq", "model_name", "category", "score", "false_positives", "hits").where("score is not null").distinct()
    return rows.withColumn("score", penalised("score", "false_positives"))


def newest(rows: DataFrame, n: int = WINDOW) -> DataFrame:
    """WIN-2: the rows of the n newest books."""
    last = rows.select("book_seq").distinct().orderBy(F.desc("book_seq")).limit(n)
    return rows.join(F.broadcast(last), "book_seq", "left_semi")  # n rows


def average(rows: DataFrame) -> DataFrame:
    """AGG-3: mean score, integer means of false positives and hits."""
    n = F.count(F.lit(1))
    return rows.groupBy("model_name", "category").agg(
        F.avg("score").alias("score"),
        F.floor(F.sum(F.coalesce("false_positives", F.lit(0))) / n).alias("false_positives"),
        F.floor(F.sum(F.coalesce("hits", F.lit(0))) / n).alias("hits"),
    )


def book_winners(rows: DataFrame) -> DataFrame:
    """WIN-3: the model of the highest score of each category in each book."""
    return rows.groupBy("book_seq", "category").agg(F.min(F.struct((-F.col("score")).alias("s"), "model_name"))["model_name"].alias("model_name"))


def wins(rows: DataFrame) -> DataFrame:
    """AGG-4: in how many books a model has the highest score of a category."""
    return book_winners(rows).groupBy("model_name", "category").agg(F.count(F.lit(1)).alias("wins"))


def consensus(rows: DataFrame) -> DataFrame:
    """WIN-1, JON-3: the winner of each category that leads by the margin, and whether it is stable."""
    top2 = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "model_name"))), 1, 2)
    # of a category, one row per model
    ranked = average(rows).groupBy("category").agg(top2.alias("t"))
    best, second = -F.col("t")[0]["s"], -F.get("t", F.lit(1))["s"]
    led = ranked.select("category", F.col("t")[0]["model_name"].alias("model_name"), best.alias("best"), F.coalesce((best - second) / best, F.lit(1.0)).alias("margin"))
    books = rows.agg(F.least(F.countDistinct("book_seq"), F.lit(WINDOW)).alias("books"))  # one row
    out = led.where((F.col("best") > 0) & (F.col("margin") > TIE) & (F.col("margin") >= MARGIN)).join(wins(rows), ["model_name", "category"], "left")
    out = out.withColumn("wins", F.coalesce("wins", F.lit(0))).join(F.broadcast(books))
    stable = (F.col("books") >= WINDOW) & (F.col("wins") >= F.lit(int(WIN_SHARE * WINDOW + 0.5)))
    return out.select("category", "model_name", F.round("margin", 6).alias("margin"), F.col("wins").cast("long").alias("wins"), stable.alias("stable"))


def best_models(rows: DataFrame) -> DataFrame:
    """AGG-12, AGG-13: the map category -> model of the stable winners (null if none), and whether all categories are stable."""
    winners = consensus(rows).where("stable")
    entries = winners.agg(F.array_sort(F.collect_list(F.struct("category", "model_name"))).alias("e"), F.count(F.lit(1)).alias("n_stable"))
    all_ = rows.agg(F.countDistinct("category").alias("n_categories"))
    mapped = F.when(F.size("e") > 0, F.map_from_entries("e"))
    return entries.join(F.broadcast(all_)).select(mapped.alias("best_model"), "n_stable", "n_categories", ((F.col("n_stable") == F.col("n_categories")) & (F.col("n_categories") > 0)).alias("all_stable"))
