"""Headings, chapters and their pieces from pages.

A page belongs to the chapter whose ordinal is the number of headings up to it. That running count is taken in blocks
of pages, so a book with a third of all pages is no single window. Null page texts count as empty; repeated rows count
once; a book with fewer than two headings is one chapter without a title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import col, token_estimate, trim_all, truncate_bytes
from folio.operators.arrow import map_rows
from folio.operators.ordered import running_count
from folio.operators.packing import split_paragraphs
from folio.session import cut

#: Patterns of headings in the order they are tried (fixed values), and how much of a page they are sought in.
HEADINGS = (
    r"(?i)^chapter\s+(\d+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)",
    r"(?i)^part\s+(\d+|i{1,3}|iv|v|vi{0,3}|ix|x|one|two|three|four|five)",
    r"(?i)^section\s+\d+",
    r"(?m)^\d{1,3}\.\s+[A-Z]",
)
HEAD_CHARS = 500
BLOCK = 4096
FRONT = "Front Matter"
CONTEXT_OPEN, CONTEXT_CLOSE = "[CONTEXT FROM PREVIOUS SECTION]\n", "\n[END CONTEXT]\n\n"


def heading(text: Column | str, patterns: tuple[str, ...] = HEADINGS) -> Column:
    """CHP-1: the title from the first pattern that matches, to the end of its line; null without a heading."""
    head = F.substring(F.coalesce(col(text), F.lit("")), 1, HEAD_CHARS)
    found = F.coalesce(*[F.when(head.rlike(p), F.regexp_extract(head, rf"(?:{p})[^\n]*", 0)) for p in patterns])
    return truncate_bytes(trim_all(found))


def distinct_pages(pages: DataFrame) -> DataFrame:
    return pages.where("book_id is not null and page_idx is not null").groupBy("book_id", "page_idx").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))


def boundaries(pages: DataFrame, patterns: tuple[str, ...] = HEADINGS) -> DataFrame:
    """CHP-1: book_id, page_idx, title of each page with a heading."""
    return distinct_pages(pages).select("book_id", "page_idx", heading("text", patterns).alias("title")).where("title is not null")


def assemble(pages: DataFrame, patterns: tuple[str, ...] = HEADINGS) -> DataFrame:
    """CHP-2, CHP-3, WIN-5: book_id, chapter_id, title, start_page, end_page, text, approx_tokens."""
    rows = distinct_pages(pages).withColumn("title", heading("text", patterns))
    marked = running_count(rows.withColumn("__f", F.col("title").isNotNull()), "book_id", "page_idx", "__f", "ordinal", BLOCK).drop("__f")
    several = rows.groupBy("book_id").agg((F.count("title") > 1).alias("several"))
    ordinal = F.when(F.col("several"), F.col("ordinal")).otherwise(0)
    placed = marked.join(several, "book_id").withColumn("ordinal", ordinal)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "text"))), lambda x: x["text"])
    grouped = placed.groupBy("book_id", "ordinal", "several").agg(
        F.min("page_idx").alias("start_page"), F.max("page_idx").alias("end_page"), F.min_by("title", "page_idx").alias("first_title"), F.array_join(texts, "\n\n").alias("text")
    )
    title = F.when(~F.col("several"), "").when(F.col("ordinal") == 0, FRONT).otherwise(F.col("first_title"))
    return grouped.select("book_id", F.col("ordinal").cast("int").alias("ordinal"), title.alias("title"), "start_page", "end_page", "text", token_estimate("text").alias("approx_tokens"))


def pieces(chapters: DataFrame, max_tokens: int, overlap_tokens: int) -> DataFrame:
    """CHP-4, CHP-5, WIN-4: chapters cut to two bytes a token; each piece of a book after the first opens with the tail
    of the piece before, as context. With a column max_tokens each book is cut to each of its budgets there."""
    if "max_tokens" not in chapters.columns:
        return pieces(chapters.withColumn("max_tokens", F.lit(max_tokens).cast("long")), max_tokens, overlap_tokens).drop("max_tokens")
    tail = 2 * overlap_tokens

    def run(batches):
        """Each piece with the end of the one before it in its chapter, how many there are, and the end of the last one."""
        for c in batches:
            out = []
            for x, b, o, title, s, e, t in zip(c["max_tokens"], c["book_id"], c["ordinal"], c["title"], c["start_page"], c["end_page"], c["text"]):
                most = max(2 * x, 100)
                parts = [t] if len(t.encode()) <= most else split_paragraphs(t, most)
                ends = [p[-tail:] if tail else "" for p in parts]
                out.extend((x, b, o, title, s, e, k, p, ends[k - 1] if k else None, len(parts), ends[-1]) for k, p in enumerate(parts))
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in chapters.schema}
    ddl = ", ".join(f"{n} {kinds[n]}" for n in ("max_tokens", "book_id", "ordinal", "title", "start_page", "end_page")) + ", part_no int, piece string, tail string, n int, last string"
    # the pieces are read twice, and cut once
    cut_ = cut(map_rows(chapters.where("text is not null and max_tokens is not null").select("max_tokens", "book_id", "ordinal", "title", "start_page", "end_page", "text"), run, ddl))
    # the piece before the first of a chapter is the last of the chapter before; chapters are far fewer than pages
    order = W.partitionBy("book_id", "max_tokens").orderBy("ordinal")
    first = cut_.where("part_no = 0").select("max_tokens", "book_id", "ordinal", "n", "last")
    chain = first.select("max_tokens", "book_id", "ordinal", F.lag("last").over(order).alias("carry"), F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("ids"))
    joined = cut_.join(chain, ["max_tokens", "book_id", "ordinal"])
    context = F.when(F.col("part_no") > 0, F.col("tail")).otherwise(F.col("carry"))
    text = F.when(context.isNull() | F.lit(overlap_tokens == 0), F.col("piece")).otherwise(F.concat(F.lit(CONTEXT_OPEN), context, F.lit(CONTEXT_CLOSE), F.col("piece")))
    title = F.when(F.col("n") > 1, F.concat("title", F.lit(" (part "), (F.col("part_no") + 1).cast("string"), F.lit(")"))).otherwise(F.col("title"))
    return joined.select(
        "max_tokens", "book_id", (F.coalesce("ids", F.lit(0)) + F.col("part_no")).cast("int").alias("chapter_id"), title.alias("title"), "start_page", "end_page", text.alias("text"), token_estimate(text).alias("approx_tokens")
    )


def totals(chapters: DataFrame) -> DataFrame:
    """CHP-6, AGG-6: pages, chapters, tokens and the largest chapter of each book."""
    return chapters.groupBy("book_id").agg(
        F.sum(F.col("end_page") - F.col("start_page") + 1).alias("pages"), F.count(F.lit(1)).alias("chapters"), F.sum("approx_tokens").alias("tokens"), F.max("approx_tokens").alias("largest")
    )
