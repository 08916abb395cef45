"""Ordered text aggregation: leaves, fold prompts, reports, log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import strip_noise, trim_all
from folio.session import first_rows, spread

#: What a report says if there was no output (fixed value).
NOTHING = "Run complete. No inference output was produced."


def cleaned(outputs: DataFrame) -> DataFrame:
    """FLT-6: distinct outputs with their text without tool noise, where anything is left."""
    rows = spread(first_rows(outputs, ["output_id"]), outputs)
    # exploding the text where there is any filters without working it out twice
    clean = F.explode(F.filter(F.array(trim_all(strip_noise("text"))), lambda x: x != "")).alias("clean")
    return rows.select("output_id", "run_id", "book_id", "model_name", "chunk_idx", clean)


def leaf(model: Column, chunk: Column, text: Column) -> Column:
    """AGG-10: an output as a labelled block."""
    return F.concat(F.lit("=== "), model, F.lit(" · chapter "), (chunk + 1).cast("string"), F.lit(" ===\n"), text)


def leaves(outputs: DataFrame) -> DataFrame:
    return cleaned(outputs).select("run_id", "model_name", "chunk_idx", "output_id", leaf(F.col("model_name"), F.col("chunk_idx"), F.col("clean")).alias("leaf"))


#: What a model is asked to make of several analyses: the last time, and before (fixed values).
FINAL_INSTRUCTION = (
    "You are writing the final consolidated review of an entire book. Below are analyses of its individual sections, each produced by examining that section for manipulation tactics, "
    "logical fallacies, and rhetorical framing. Write one coherent review of the whole book: a short summary of its central argument, every distinct manipulation tactic or fallacy found "
    "(with where it occurs and its severity), and an overall assessment. Do not omit any section's findings.\n\n--- SECTION ANALYSES ---\n"
)
INTERMEDIATE_INSTRUCTION = (
    "You are consolidating analyses of several sections of a book into a single intermediate summary. Merge the analyses below, preserving every distinct finding, flagged manipulation "
    "tactic or fallacy, and its severity. Keep the section/chapter labels so later synthesis can still tell them apart. Be concise but drop nothing.\n\n--- SECTION ANALYSES ---\n"
)


def fold_prompt(blocks: Column, final: Column) -> Column:
    """AGG-15: the instruction of a fold, and the blocks behind it."""
    return F.concat(F.when(final, FINAL_INSTRUCTION).otherwise(INTERMEDIATE_INSTRUCTION), F.array_join(blocks, "\n\n"))


def report(outputs: DataFrame, titles: DataFrame) -> DataFrame:
    """AGG-9, JON-8: run_id and its report: models in order, under each the outputs in order under their chapters' titles.

    titles: book_id, chunk_idx, title; a chapter without a title is named by its number. A report is one value, as long
    as its run's texts."""
    return report_of(cleaned(outputs).join(titles, ["book_id", "chunk_idx"], "left"))


def report_of(rows: DataFrame) -> DataFrame:
    """The same of rows already cleaned, with their titles: run_id, model_name, chunk_idx, output_id, clean, title."""
    name = F.coalesce(F.when(F.coalesce("title", F.lit("")) != "", F.col("title")), F.concat(F.lit("Chapter "), (F.col("chunk_idx") + 1).cast("string")))
    part = rows.select("run_id", "model_name", "chunk_idx", "output_id", F.concat(F.lit("── "), name, F.lit(" ──\n"), F.col("clean"), F.lit("\n\n")).alias("part"))
    per_model = part.groupBy("run_id", "model_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "output_id", "part"))), lambda x: x["part"]), "").alias("body"))
    block = per_model.select("run_id", "model_name", F.concat(F.lit("═══ "), F.col("model_name"), F.lit(" ═══\n\n"), F.col("body")).alias("block"))
    return block.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("model_name", "block"))), lambda x: x["block"]), "").alias("report"))


#: Title of a report's pages (a parameter), and what it has behind it from the second page on (fixed value).
TITLE, CONTINUED, LINES_PER_PAGE = "Analysis Results", " (continued)", 55


def report_pages(reports: DataFrame, keys: list[str], text: str = "text", title: str = TITLE, lines: int = LINES_PER_PAGE) -> DataFrame:
    """SNK-4: keys, page_no, title, page of each report: so many lines to a page, the title on the first and the title with
    "(continued)" on the others. A report without lines, or null, is one page without text."""
    # what stands behind the last line feed is a line only if it holds anything
    body = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), "\n$", "")
    rows = reports.select(*keys, F.split(body, "\n").alias("l"))
    paged = rows.select(*keys, "l", F.explode(F.sequence(F.lit(0), F.ceil(F.size("l") / lines).cast("int") - 1)).alias("page_no"))
    page = F.array_join(F.slice("l", F.col("page_no") * lines + 1, lines), "\n")
    return paged.select(*keys, "page_no", F.when(F.col("page_no") == 0, title).otherwise(title + CONTINUED).alias("title"), page.alias("page"))


def log_line(ts: Column, subsystem: Column, level: Column, message: Column, metadata: Column) -> Column:
    """SNK-10: a log entry; metadata (a map, may be null) by sorted keys."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": "'), e["value"], F.lit('"'))), ", ")
    head = F.concat(F.lit("["), ts, F.lit("] ["), F.lower(subsystem), F.lit("] ["), level, F.lit(']\nmessage: "'), message, F.lit('"\n'))
    return F.when(F.coalesce(F.size(metadata), F.lit(0)) > 0, F.concat(head, F.lit("metadata: { "), pairs, F.lit(" }\n"))).otherwise(head)


def metric_line(ts: Column, name: Column, value: Column) -> Column:
    """SNK-10: a metric without metadata."""
    return F.concat(F.lit("["), ts, F.lit(']\nmetric: "'), name, F.lit('"\nvalue: '), value.cast("string"), F.lit("\n"))
