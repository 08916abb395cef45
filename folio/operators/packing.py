"""Sequential packing: greedy groups, budgeted paragraphs, word windows, line pages, the fold over passes.

The greedy grouping is a recurrence over a whole key. It runs distributed and exactly: rows are range-partitioned in
order; each partition tells, for every fill it could be handed (few matter: a new group can start only within one
budget's length), the fill it would hand on; these small tables are composed in order; then each partition numbers its
groups knowing what it is handed. No key is gathered, however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import bound, strip_noise, trim_all
from folio.operators.analysis import Analyzer
from folio.operators.arrow import map_rows, per_row
from folio.operators.reports import fold_prompt
from folio.session import cut

#: Bytes that a separator adds to a leaf; passes of a fold (fixed values).
SEPARATOR, PASSES = 2, 16
LINES_PER_PAGE = 55


def _exits(costs: list[int], budget: int) -> list[tuple[int, int]]:
    """For a group that opens at each item: (groups opened behind it, fill at the end)."""
    n, stop, fill = len(costs), 0, 0
    jumps = [0] * n
    sums = [0] * n
    for i in range(n):
        if stop < i + 1:
            stop, fill = i + 1, costs[i]
        while stop < n and fill + costs[stop] <= budget:
            fill += costs[stop]
            stop += 1
        jumps[i], sums[i] = stop, fill
        fill -= costs[i]
    out: list[tuple[int, int]] = [(0, 0)] * n
    for i in range(n - 1, -1, -1):
        j = jumps[i]
        out[i] = (0, sums[i]) if j == n else (out[j][0] + 1, out[j][1])
    return out


def _handover(costs: list[int], budget: int) -> tuple[list[int], list[int], list[int]]:
    """Where a partition may open its first group: it opens at entry i if the fill handed in is above bound[i] and not
    above the bounds before; then so many groups are opened and such a fill is handed on."""
    exits, bounds, opened, onward, total = _exits(costs, budget), [], [], [], 0
    for c, (groups, fill) in zip(costs, exits):
        total += c
        bounds.append(budget - total)
        opened.append(groups + 1)
        onward.append(fill)
        if budget - total < 0:
            break
    return bounds, opened, onward


def _hand(row, fill: int, group: int) -> tuple[int, int]:
    """What a partition that is all one key makes of a fill and a group."""
    for i, bound in enumerate(row["bounds"]):
        if fill > bound:
            # the first item of a key opens group 0 without closing one
            return row["onward"][i], group + row["opened"][i] - (fill == 0 and i == 0)
    return fill + row["total"], group


HANDOVER = "pid int, first {k}, last {k}, whole boolean, tail_fill long, tail_group long, total long, bounds array<long>, opened array<long>, onward array<long>"


def greedy_groups(leaves: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """PCK-1: key, order, cost and grp (from 0 in each key): a leaf joins the group while the budget holds, and a group
    holds one leaf at least. Costs below 1 and nulls count 1. Equal orders of a key are taken by cost; null keys are a key."""
    rows = leaves.select(F.col(key).alias("k"), F.col(order).alias("o"), F.greatest(F.coalesce(F.col(cost), F.lit(1)), F.lit(1)).cast("long").alias("c"))
    kind_k, kind_o = rows.schema["k"].dataType.simpleString(), rows.schema["o"].dataType.simpleString()
    sliced = cut(rows.repartitionByRange("k", "o", "c").sortWithinPartitions("k", "o", "c").withColumn("p", F.spark_partition_id()))

    def tables(batches):
        head: list[int] = []
        first = last = pid = None
        fill = group = 0
        whole = True
        for b in batches:
            for p, k, c in zip(b["p"], b["k"], b["c"]):
                if pid is None:
                    pid, first, last = p, k, k
                if k != last:
                    whole, last, fill, group = False, k, 0, 0
                if whole:
                    head.append(c)
                if fill and fill + c > budget:
                    fill, group = 0, group + 1
                fill += c
        if pid is not None:
            yield [(pid, first, last, whole, fill, group, sum(head), *_handover(head, budget))]

    # one row per partition; an entry of a table is a leaf within one budget's length
    handed: dict[int, tuple[int, int]] = {}
    last, fill, group = None, 0, 0
    for row in map_rows(sliced, tables, HANDOVER.format(k=kind_k)).orderBy("pid").collect():
        if row["first"] != last:
            fill, group = 0, 0
        handed[row["pid"]] = (fill, group)
        fill, group = _hand(row, fill, group) if row["whole"] else (row["tail_fill"], row["tail_group"])
        last = row["last"]
    given = leaves.sparkSession.sparkContext.broadcast(handed)  # one entry per partition

    def number(batches):
        k_now, f, g, seen = None, 0, 0, False
        for b in batches:
            out = []
            for p, k, o, c in zip(b["p"], b["k"], b["o"], b["c"]):
                if not seen:
                    (f, g), k_now, seen = given.value.get(p, (0, 0)), k, True
                elif k != k_now:
                    k_now, f, g = k, 0, 0
                if f and f + c > budget:
                    g, f = g + 1, 0
                f += c
                out.append((k, o, c, g))
            yield out

    return map_rows(sliced, number, f"`{key}` {kind_k}, `{order}` {kind_o}, `{cost}` long, grp long")


class _Part:
    """A piece in the making: strings and their bytes."""

    def __init__(self) -> None:
        self.strings: list[str] = []
        self.size = 0

    def add(self, s: str, size: int, between: str) -> None:
        if self.size:
            self.strings.append(between)
            self.size += len(between)
        self.strings.append(s)
        self.size += size

    def take(self) -> list[str]:
        out = ["".join(self.strings)] if self.size else []
        self.strings, self.size = [], 0
        return out


def split_paragraphs(text: str, most: int) -> list[str]:
    """PCK-2: paragraphs packed up to so many bytes; a longer one is packed by words, its rest is open to the next."""
    out: list[str] = []
    part = _Part()
    for paragraph in text.split("\n\n"):
        size = len(paragraph.encode())
        if size > most or part.size + size + SEPARATOR > most:
            out += part.take()
        if size <= most:
            part.add(paragraph, size, "\n\n")
            continue
        for w in paragraph.split():
            n = len(w.encode())
            if part.size + n + 1 > most:
                out += part.take()
            part.add(w, n, " ")
    return out + part.take() or [text]


def paragraph_pieces(texts: DataFrame, keys: list[str], most: int, text: str = "text") -> DataFrame:
    """keys, part_no, piece of every text (a text within the limit is one piece)."""

    def cut_one(t: str) -> list[tuple]:
        parts = [t] if len(t.encode()) <= most else split_paragraphs(t, most)
        return list(enumerate(parts))

    return per_row(texts, keys, text, cut_one, "part_no int, piece string")


def word_windows(words: list[tuple[str, int]], most: int, overlap: int) -> list[tuple[int, int]]:
    """PCK-3: [start, end) of windows of words up to so many bytes (a byte of space each), one word at least; the next
    window starts the overlap's words earlier, but never where the last one did."""
    out, start, n = [], 0, len(words)
    share = max(4 * overlap // 5, 1)
    while start < n:
        end, size = start, 0
        while end < n and (end == start or size + len(words[end][0].encode()) + 1 <= most):
            size += len(words[end][0].encode()) + 1
            end += 1
        out.append((start, end))
        if end >= n:
            break
        start = max(end - min(share, end - start), start + 1)
    return out


def word_chunks(texts: DataFrame, keys: list[str], max_tokens: int, overlap_tokens: int, text: str = "text") -> DataFrame:
    """keys, chunk_no, n_words, chunk of every text, by word windows of four bytes a token."""
    most = max(4 * max_tokens, 1)

    def cut_one(t: str) -> list[tuple]:
        words = [(w, 0) for w in t.split()]
        return [(i, e - s, " ".join(w for w, _ in words[s:e])) for i, (s, e) in enumerate(word_windows(words, most, overlap_tokens))]

    return per_row(texts, keys, text, cut_one, "chunk_no int, n_words int, chunk string")


def page_windows(pages: DataFrame, max_tokens: int, overlap_tokens: int) -> DataFrame:
    """PCK-3 over books: book_id, chunk_no, start_page, end_page, n_words, text of the word windows of each book, which run
    over page ends.

    A book's windows follow from each other, so a book is one run of the loop; it holds words and pages of one window's
    length only, as pages come in order, and books are spread by id."""
    most, share = max(4 * max_tokens, 1), max(4 * overlap_tokens // 5, 1)
    rows = pages.where("text is not null").groupBy("book_id", "page_idx").agg(F.max("text").alias("text"))

    def run(batches):
        now, held, no, first = None, [], 0, True

        def windows(whole: bool):
            """Windows that can't change any more: all at the end of a book, else those that a word follows."""
            nonlocal held, no
            out = []
            while held:
                end, size = 0, 0
                while end < len(held) and (end == 0 or size + len(held[end][0].encode()) + 1 <= most):
                    size += len(held[end][0].encode()) + 1
                    end += 1
                if end >= len(held) and not whole:
                    break
                out.append((now, no, held[0][1], held[end - 1][1], end, " ".join(w for w, _ in held[:end])))
                no += 1
                if end >= len(held):
                    held = []
                    break
                held = held[max(end - min(share, end), 1) :]
            return out

        for c in batches:
            out = []
            for b, p, t in zip(c["book_id"], c["page_idx"], c["text"]):
                if not first and b != now:
                    out += windows(True)
                    held, no = [], 0
                now, first = b, False
                held += [(w, p) for w in t.split()]
                out += windows(False)
            yield out
        if not first:
            yield windows(True)

    ordered = rows.repartition("book_id").sortWithinPartitions("book_id", "page_idx")
    return map_rows(ordered, run, "book_id long, chunk_no int, start_page int, end_page int, n_words int, text string")


def line_pages(texts: DataFrame, keys: list[str], text: str = "text", lines: int = LINES_PER_PAGE) -> DataFrame:
    """PCK-4, SNK-4: keys, page_no, page: so many lines to a page."""
    rows = texts.where(F.col(text).isNotNull()).select(*keys, F.split(text, "\n").alias("l"))
    n = F.ceil(F.size("l") / lines).cast("int")
    paged = rows.select(*keys, "l", F.explode(F.sequence(F.lit(0), n - 1)).alias("page_no"))
    return paged.select(*keys, "page_no", F.array_join(F.slice("l", F.col("page_no") * lines + 1, lines), "\n").alias("page"))


def fold_texts(leaves: DataFrame, key: str, order: str, text: str, budget: int, analyzer: Analyzer, passes: int = PASSES) -> DataFrame:
    """PCK-5: key, passes, text: the leaves of each key folded into one text.

    A pass groups the texts in order within the budget (PCK-1), asks the analyzer for one text of each group (AGG-15; the
    last time with the final instruction), cleans it, and takes the group's own texts where nothing is left. A key whose
    pass was one group is done; after so many passes what is left is joined. All keys run through a pass at once, each
    pass is written down before the next, and a group holds no more than a budget or one leaf. Orders are unique in a
    key; null texts take no part."""
    state = leaves.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), F.col(text).alias("t"))
    kind, done, number = state.schema["k"].dataType.simpleString(), None, 0
    while True:
        number += 1
        placed = greedy_groups(state.select("k", "o", (F.octet_length("t") + SEPARATOR).alias("c")), "k", "o", "c", budget)
        blocks = F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"])
        groups = state.join(placed.select(F.col("k").alias("pk"), F.col("o").alias("po"), "grp"), F.col("k").eqNullSafe(F.col("pk")) & (F.col("o") == F.col("po"))).groupBy("k", "grp").agg(blocks.alias("blocks"))
        number_of = placed.groupBy(F.col("k").alias("pk")).agg((F.max("grp") + 1).alias("n"))
        asked = groups.join(number_of, F.col("k").eqNullSafe(F.col("pk"))).drop("pk")
        asked = asked.select("k", "grp", "n", fold_prompt(F.col("blocks"), F.col("n") == 1).alias("prompt"), F.array_join("blocks", "\n\n").alias("joined"))

        def run(batches):
            for c in batches:
                yield list(zip(c["k"], c["grp"], c["n"], c["joined"], analyzer(c["prompt"])))

        answered = map_rows(asked, run, f"k {kind}, grp long, n long, joined string, raw string")
        clean = bound(trim_all(strip_noise(F.coalesce("raw", F.lit("")))), lambda x: F.when(x == "", F.col("joined")).otherwise(x))
        folded = cut(answered.select("k", F.col("grp").alias("o"), "n", clean.alias("t")))
        row = folded.where("n = 1").select("k", F.lit(number).cast("long").alias("passes"), "t")
        done = row if done is None else done.unionByName(row)
        state = folded.where("n > 1").select("k", "o", "t")
        if number == passes or state.isEmpty():
            break
    rest = state.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "\n\n").alias("t"))
    return done.unionByName(rest.select("k", F.lit(number).cast("long").alias("passes"), "t")).toDF(key, "passes", text)


def fold_passes(leaves: DataFrame, key: str, order: str, cost: str, budget: int, combined: int, passes: int = PASSES) -> DataFrame:
    """PCK-5: passes, groups of the first pass and final groups of each key, if a fold of a group costs combined bytes.

    A pass groups what the last one folded, until one group was processed, at most so many times; the passes run over
    all keys at once, each written down before the next."""
    state = leaves.select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), F.col(cost).cast("long").alias("c"))
    done, number = None, 0
    while number < passes:
        number += 1
        grouped = cut(greedy_groups(state, "k", "o", "c", budget).groupBy("k", "grp").agg(F.count(F.lit(1)).alias("n")))
        per = grouped.groupBy("k").agg(F.count(F.lit(1)).alias("groups"))
        row = per.select("k", F.lit(number).alias("pass"), "groups")
        done = row if done is None else done.unionByName(row)
        more = per.where("groups > 1").select("k")
        state = grouped.join(more, "k", "left_semi").select("k", F.col("grp").alias("o"), F.lit(combined).cast("long").alias("c"))
        if state.isEmpty():
            break
    return done.groupBy(F.col("k").alias(key)).agg(
        F.max("pass").cast("long").alias("passes"), F.max(F.when(F.col("pass") == 1, F.col("groups"))).alias("first_groups"), F.max_by("groups", "pass").alias("last_groups")
    )

