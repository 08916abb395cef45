"""The run as a whole: pages to chapters to prompts to analyses to cleaned outputs to a folded review, a report and scores.

Every step runs over all runs at once. A chapter is analysed once for each model and budget, whatever the number of runs
that need it, and handed to the runs by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import numeric as N
from folio.functions.text import bound, strip_noise, trim_all
from folio.operators import chapters as C
from folio.operators import manifests as M
from folio.operators import packets as K
from folio.operators import packing as P
from folio.operators import reports as R
from folio.operators import scoring as S
from folio.operators.analysis import Analyzer, analyze, prompt
from folio.session import cut

OVERLAP = 200
#: What is said of a run without any output (fixed value).
ALL_FAILED = "All models failed — no inference output produced."


@dataclass
class Run:
    chapters: DataFrame  # max_tokens, book_id, chapter_id, title, start_page, end_page, text, approx_tokens
    outputs: DataFrame  # run_id, book_id, model_name, chunk_idx, output_id, title, text
    failed: DataFrame  # run_id, message
    reviews: DataFrame  # run_id, passes, text
    reports: DataFrame  # run_id, text
    history: DataFrame  # book_seq, model_name, category, score, false_positives, hits


def run(pages: DataFrame, manifests: DataFrame, packets: DataFrame, categories: DataFrame, history: DataFrame, analyzer: Analyzer, fold_bytes: int = 24_372) -> Run:
    """packets: valid ones (packets.usable); categories: category, keyword; history: as score_history.

    A run of a book without pages has no outputs and fails (FLT-8). A fusion slot folds the outputs (PCK-5); a report is
    the review, else the outputs by model and chapter (AGG-9), else NOTHING (FLT-7). Scores of a run enter the history
    under its start time in microseconds, so newer runs are newer books; repeated manifest rows count once."""
    rows = manifests.dropDuplicates(["run_id"])
    budget = N.chapter_budget(F.coalesce("context_length", F.lit(N.DEFAULT_CONTEXT)))
    plan = cut(rows.select("run_id", "book_id", F.unix_micros(F.col("started_at").cast("timestamp")).alias("book_seq"), budget.alias("max_tokens"), M.sequence().alias("slots"), *M.SLOTS))
    model = F.coalesce(*[F.when(F.col("slot") == s, F.col(s)) for s in M.SLOTS])
    lanes = plan.select("*", F.posexplode("slots").alias("lane", "slot")).where("slot <> 'fusion'").select("run_id", "book_id", "book_seq", "max_tokens", "lane", model.alias("model_name"))

    whole = C.assemble(pages)
    chapters = cut(C.pieces(whole.join(plan.select("book_id", "max_tokens").distinct(), "book_id"), N.CHAPTER_FLOOR, OVERLAP))
    system = K.prompt(K.merge(packets))  # one row
    work = lanes.select("book_id", "max_tokens", "model_name").distinct().join(chapters, ["book_id", "max_tokens"])
    asked = work.join(F.broadcast(system)).select("book_id", "max_tokens", "model_name", "chapter_id", prompt(F.col("prompt"), F.col("text")).alias("asked"))
    raw = analyze(asked, ["book_id", "max_tokens", "model_name", "chapter_id"], analyzer, "asked", "model_name")
    said = bound(trim_all(strip_noise(F.coalesce("output", F.lit("")))), lambda x: x)
    answers = cut(raw.select("book_id", "max_tokens", "model_name", "chapter_id", said.alias("text")).where("text <> ''"))
    titles = chapters.select("book_id", "max_tokens", "chapter_id", "title")
    outputs = lanes.join(answers, ["book_id", "max_tokens", "model_name"]).join(titles, ["book_id", "max_tokens", "chapter_id"])
    # lanes and chapters of a run are few, so their order fits in one number
    outputs = cut(outputs.select("run_id", "book_id", "book_seq", "model_name", F.col("chapter_id").alias("chunk_idx"), (F.col("lane") * 1_000_000_000 + F.col("chapter_id")).cast("long").alias("output_id"), "title", "text"))

    failed = plan.select("run_id").join(outputs.select("run_id").distinct(), "run_id", "left_anti").withColumn("message", F.lit(ALL_FAILED))
    leaves = outputs.join(plan.where(F.array_contains("slots", "fusion")).select("run_id"), "run_id", "left_semi").select("run_id", "output_id", R.leaf(F.col("model_name"), F.col("chunk_idx"), F.col("text")).alias("text"))
    reviews = cut(P.fold_texts(leaves, "run_id", "output_id", "text", fold_bytes, analyzer))
    plain = R.report_of(outputs.withColumnRenamed("text", "clean"))
    reports = plan.select("run_id").join(reviews.select("run_id", F.col("text").alias("review")), "run_id", "left").join(plain, "run_id", "left")
    reports = reports.select("run_id", F.coalesce("review", "report", F.lit(R.NOTHING)).alias("text"))
    scored = S.scores(outputs.select(F.col("book_seq").alias("book_id"), "model_name", "text"), categories)
    fresh = scored.select(F.col("book_id").alias("book_seq"), "model_name", "category", "score", "false_positives", "hits")
    columns = fresh.columns
    return Run(chapters, outputs.drop("book_seq"), failed, reviews, reports, history.select(*columns).unionByName(fresh))
