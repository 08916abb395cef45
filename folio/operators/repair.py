"""TXT-4: texts whose printable characters were all moved by a constant."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import GRAPHIC, READABLE_SHARE, SINGLE_SHARE, STOP_KINDS, STOP_PATTERNS, UNREADABLE, looks_sane, shifted_alphabet, windows
from folio.operators.arrow import map_rows

#: White space as `functions.text.SPACE` has it, and what isn't readable.
_SPACE = re.compile("[ \t\n\x0b\f\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_UNREADABLE = re.compile(UNREADABLE)


def _sane(w: str) -> bool:
    """The check of a window (TXT-3), the cheapest test first."""
    low = w.lower()
    if sum(p in low for p in STOP_PATTERNS) < STOP_KINDS:
        return False
    if len(_UNREADABLE.sub("", w)) <= READABLE_SHARE * len(w.encode()):
        return False
    tokens = [x for x in _SPACE.split(w) if x]
    return sum(len(x.encode()) == 1 for x in tokens) <= SINGLE_SHARE * len(tokens)


def byte_shift(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and the least shift (1..255) that makes a garbled text readable; readable texts, and those no shift mends, give
    no row, nor do null texts.

    Only the three windows of the check leave the JVM, never whole texts; the shifts are tried in order, up to the first
    that fits, and a shift is dropped at the first window and test that fails."""
    a, b, d = windows(text)
    bad = texts.where(F.col(text).isNotNull()).where(~looks_sane(text)).select(key, a.alias("a"), b.alias("b"), d.alias("d"))
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        tables = [str.maketrans(GRAPHIC, shifted_alphabet(k)) for k in range(1, 256)]
        for c in batches:
            out = []
            for k, *parts in zip(c[key], c["a"], c["b"], c["d"]):
                shift = next((i for i, t in enumerate(tables, 1) if all(_sane(w.translate(t)) for w in parts)), None)
                if shift is not None:
                    out.append((k, shift))
            yield out

    return map_rows(bad, run, f"`{key}` {kind}, shift long").groupBy(key).agg(F.min("shift").alias("shift"))
