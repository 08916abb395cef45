"""Problem 3: cutting oversized texts into pieces under a byte limit at natural boundaries, with an overlap.

Agglomerative merging: a text starts as atomic segments (the largest stretches between boundaries that fit, down to words
and, in a word that is too long, characters). Adjacent segments lie in a heap under the strength of the boundary between them: inside a word,
between words, sentences, lines, paragraphs. The weakest boundary is merged first, and of equally weak ones the one whose
merged segment is smallest, as long as the segment plus the overlap before it keeps within the limit. What stays apart
is cut, so cuts fall on the strongest boundaries the limit allows.

The overlap of a piece is the last characters of the piece before, which are the characters before its own start; they
count towards the limit. Results: a text within the limit, an empty text included, is one piece without overlap; a null
text gives no piece. The limit must leave room for the overlap and one character (a ValueError says so). Repeated rows
are cut once per distinct key and text.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import map_rows
from folio.session import table

#: origin: (table, id column, byte limit, overlap in characters)
LIMITS = {"chapters": ("chapters", "chapter_id", 8192, 200), "chunks": ("chunks", "chunk_id", 2048, 64)}
NEW_LINE = r"(?:\r\n|\n|\r)"
INSIDE, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
#: White space up to the end of which a boundary of a strength lies, strongest first.
BOUNDARIES = (
    (PARAGRAPH, re.compile(rf"[^\S\r\n]*{NEW_LINE}[^\S\r\n]*{NEW_LINE}\s*")),
    (LINE, re.compile(rf"[^\S\r\n]*{NEW_LINE}\s*")),
    (SENTENCE, re.compile(r"[.!?…。！？][\"'”’»)\]]*\s+")),
    (WORD, re.compile(r"\s+")),
)


def _bytes_before(text: str):
    """Bytes before each character and at the end."""
    if text.isascii():
        return range(len(text) + 1)
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    return [0, *np.cumsum(size).tolist()]


def atoms(text: str, limit: int, overlap: int, at) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary behind) of the segments that merging starts from.

    A segment between two boundaries that fits the limit is an atom: all boundaries inside it are weaker and all merges
    inside it fit, so they would be made before any merge over its ends, and nothing is lost by starting with their result."""
    out: list[tuple[int, int, int]] = []
    room = limit - 4 * overlap  # what fits whatever the characters before it are

    def cut(a: int, b: int, strength: int, level: int) -> None:
        if at[b] - at[max(0, a - overlap)] <= limit:
            out.append((a, b, strength))
            return
        if level == len(BOUNDARIES):
            while at[b] - at[a] > room:
                c = bisect_right(at, at[a] + room, a + 1, b + 1) - 1
                c = max(c, a + 1)
                out.append((a, c, INSIDE))
                a = c
            out.append((a, b, strength))
            return
        mark, pattern = BOUNDARIES[level]
        start = a
        for m in pattern.finditer(text, a, b):
            if m.end() < b:
                cut(start, m.end(), mark, level + 1)
                start = m.end()
        cut(start, b, strength, level + 1)

    cut(0, len(text), PARAGRAPH, 0)
    return out


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start of overlap, start, end) of each piece, in characters."""
    if len(text.encode()) <= limit:
        return [(0, 0, len(text))]
    if limit < 4 * overlap + 4:
        raise ValueError("the limit leaves no room for the overlap")
    at = _bytes_before(text)
    return merge(atoms(text, limit, overlap, at), limit, overlap, at)


def merge(segments: list[tuple[int, int, int]], limit: int, overlap: int, at) -> list[tuple[int, int, int]]:
    """Adjacent segments merged over the weakest boundary first while the result fits."""
    start, end, strong = map(list, zip(*segments))
    n = len(start)
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n

    def joined(i: int) -> int:
        """Bytes of segment i with the next one and with the overlap before it."""
        return at[end[after[i]]] - at[max(0, start[i] - overlap)]

    heap = [(strong[i], joined(i), i, after[i], end[after[i]]) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        s, size, i, j, stop = heapq.heappop(heap)
        if not alive[i] or after[i] != j or j >= n or end[j] != stop or joined(i) != size or size > limit:
            continue
        alive[j] = False
        end[i], strong[i], after[i] = end[j], strong[j], after[j]
        if after[j] < n:
            before[after[j]] = i
            heapq.heappush(heap, (strong[i], joined(i), i, after[i], end[after[i]]))
        if before[i] >= 0:
            p = before[i]
            heapq.heappush(heap, (strong[p], joined(p), p, i, end[i]))
    return [(max(0, start[i] - overlap), start[i], end[i]) for i in range(n) if alive[i]]


def split(items: DataFrame, keys: list[str], limit: int, overlap: int, text: str = "text") -> DataFrame:
    """keys, piece_no, n_pieces, start_char, end_char, n_bytes, text of each piece; start_char is where the new text begins."""
    kinds = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for c in batches:
            out = []
            for i, t in enumerate(c[text]):
                if t is None:
                    continue
                cut = pieces(t, limit, overlap)
                head = tuple(c[k][i] for k in keys)
                out.extend((*head, no, len(cut), s, e, len(t[o:e].encode()), t[o:e]) for no, (o, s, e) in enumerate(cut))
            yield out

    rows = items.select(*keys, text).groupBy(*keys, F.xxhash64(text).alias("__h")).agg(F.first(text).alias(text)).drop("__h")
    return map_rows(rows, run, f"{kinds}, piece_no int, n_pieces int, start_char int, end_char int, n_bytes int, text string")


def _oversized(spark, sf_dir: str, origin: str) -> DataFrame:
    name, key, limit, _ = LIMITS[origin]
    return table(spark, sf_dir, name).where(F.octet_length("text") > limit).select("book_id", F.col(key).alias("item_id"), "text")


def p3_pieces(spark, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chapter and chunk."""
    parts = [
        split(_oversized(spark, sf_dir, o), ["book_id", "item_id"], limit, overlap).select(F.lit(o).alias("origin"), "*")
        for o, (_, _, limit, overlap) in LIMITS.items()
    ]
    return parts[0].unionByName(parts[1])


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Each chapter and chunk that is over its limit, as the operator's pieces have it."""
    return p3_pieces(spark, sf_dir).select("origin", "book_id", F.col("item_id").cast("int").alias("item_id")).distinct()


P3_FOUND_SQL = """
SELECT DISTINCT 'chapters' AS origin, book_id, chapter_id AS item_id FROM chapters WHERE octet_length(encode(text)) > 8192
UNION ALL
SELECT DISTINCT 'chunks' AS origin, book_id, chunk_id AS item_id FROM chunks WHERE octet_length(encode(text)) > 2048
"""
