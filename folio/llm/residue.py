"""Problem 5: template residue and error-page text in place of content.

Labelled exemplars of error messages, script notices, filler and placeholders lie in an inverted index: word -> the
exemplars that hold it. Every text is cut into passage windows (sentences and lines; marked spans for placeholders).
A window retrieves exemplars through the postings of its words; its containment is the TF-IDF weight of those of its
words that the best exemplar, with the best next one of the same label, holds, against the weight of all its words. A
text is residue if windows of high containment cover most of it, or if a placeholder stands in it outside quotation
marks. The two marks of a placeholder are one word of the index, so "{{name}}" retrieves the exemplar "{{…}}" whatever
stands between, and "[Insert title here]" is measured against the exemplars in square brackets.

Frequency changes nothing: words are weighed by the texts that aren't themselves made of exemplar words, so a notice that
is a third of all texts weighs as one that occurs once, and all exemplars stay in the index. A word in fewer than one of
RARE texts weighs like one in none; the table of weights is therefore bounded by RARE, however large the corpus is.

Two additions to the method: made-up Latin is learned as one more exemplar, of the words that the texts which keep saying
its classic first words have among themselves; and a window that says a word or two over and over is filler.

Results: null and blank texts are no residue and stay in the rest of the table; repeated rows count once among the
found and stay as they are in the rest. A window without any word outside the exemplars is whole residue.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import Found, map_rows, with_lookup
from folio.llm.residue_exemplars import NOTICES, PLACEHOLDERS
from folio.session import cut, spread, table

WORDS = re.compile(r"[^\W\d_]+").findall
PASSAGE = re.compile(r"(?<=[.!?…;:])\s+|\n+|</?\w+[^<>]*>")
TAGS = re.compile(r"</?[a-zA-Z][^<>\n]*>")
#: Words of made-up Latin that everyone knows, and how often a text says them that is such filler itself.
SEEDS, SEED_USES = ("lorem", "ipsum"), 3
COUNT = "\x1fN"
OPENING, CLOSING = "\"'“„‘‚«‹`", "\"'”“’‘»›`"
#: Spans that may be placeholders: marks of template languages and forms, and brackets (fixed patterns).
MARKED = re.compile(
    r"\{\{(?:[^{}\n]|\{[^{}\n]*\})+\}\}|\{%.+?%\}|<%.+?%>|[$#]\{[^{}\n]+\}|%\(\w+\)[sdrf]|%[A-Z][A-Z0-9_]{2,}%|@@\w+@@|(?<!\w)__[A-Za-z](?:\w*[A-Za-z0-9])?__(?!\w)"
    r"|<<[\w .-]+>>|\[\[[\w .-]+\]\]|(?<![\w{$#])\{[A-Za-z_]\w*(?:[:!][^{}\s]*)?\}(?!\})|(?<!\w)_{4,}(?!\w)|(?<!\w)[Xx]{4,40}(?!\w)|(?<!\w)(?:TODO|FIXME|TBD)(?!\w)"
)
#: (a longer run of x is a drawn rule and no value to fill in)
BRACKET = re.compile(r"\[[^\[\]\n]+\]|<[^<>\n/=]{2,}>|\([^()\n]+\)")
HINTS = ("{", "%", "<", "__", "@@", "[[", "XXX", "xxx", "TODO", "FIXME", "TBD")
ANY = "…"
#: Containment from which a passage is residue, share of a text from which it is, containment from which brackets ask.
CONTAINED, COVERED, ASKED = 0.65, 0.5, 0.3
#: A word is filler if it is in so many seed texts, and such a share of its texts are seed texts.
SEED_TEXTS, SEED_SHARE = 2, 0.5
#: A passage of so many words of which so few are different repeats itself.
REPEATED_WORDS, REPEATED_SHARE = 10, 0.15
#: A text of whose words such a share are words of exemplars doesn't count in the weights.
SUSPECT = 0.7
RARE = 100_000
LEARNED = "learned"


def exemplars(lines: str = NOTICES) -> list[tuple[str, frozenset[str]]]:
    """(label, words) of each exemplar."""
    out = []
    for line in lines.strip().splitlines():
        label, _, text = line.partition(" | ")
        out.append((label, frozenset(WORDS(text.lower()))))
    return out


def marks(span: str) -> str:
    """The marks at both ends of a span as one word of the index: the shape of a span without its words."""
    if span[0] in "_Xx" and not span.strip("_Xx"):
        return span[0].upper() * 4
    if span.isalpha():
        return span
    start = re.match(r"[^\w\s…]+|__", span)
    end = re.search(r"(?:[^\w\s…]+|__)$", span)
    opened, closed = start.group() if start else "", end.group() if end else ""
    for o, c in (("{{", "}}"), ("{%", "%}"), ("<%", "%>"), ("<<", ">>"), ("[[", "]]"), ("%(", ""), ("${", "}"), ("#{", "}"), ("{", "}")):
        if opened.startswith(o) and (closed.endswith(c) or not c):
            return o + ANY + (c or ")")
    if opened in ("%", "@@", "__") and closed == opened:
        return opened + ANY + closed
    return span[0] + span[-1]


def placeholders(lines: str = PLACEHOLDERS) -> list[tuple[str, frozenset[str], bool]]:
    """(marks, words, whether any words may stand in it) of each exemplar of a placeholder."""
    return [(marks(x), frozenset(WORDS(x.lower())) if x[0] in "[<" and ANY not in x else frozenset(), ANY in x or x[0] not in "[<") for x in lines.strip().splitlines()]


def _counter(every: frozenset[str]):
    def counts(batches):
        n: Counter[str] = Counter()
        seeds: Counter[str] = Counter()
        for c in batches:
            for t in c["text"]:
                if t is None or not t.strip():
                    continue
                low = t.lower()
                words = set(WORDS(low))
                if sum(map(low.count, SEEDS)) >= SEED_USES:
                    seeds.update(words)
                elif len(words & every) < SUSPECT * len(words):
                    n.update(words)
                    n[COUNT] += 1
            if len(n) + len(seeds) > 300_000:
                yield [(w, n[w], seeds[w]) for w in n.keys() | seeds.keys()]
                n, seeds = Counter(), Counter()
        yield [(w, n[w], seeds[w]) for w in n.keys() | seeds.keys()]

    return counts


def document_counts(texts: DataFrame, every: frozenset[str]) -> DataFrame:
    """key, value: number of content texts of each word and of all (COUNT); below 0 if the word is learned filler."""
    rows = cut(map_rows(texts.select("text"), _counter(every), "key string, n long, s long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    filler = (F.col("s") >= SEED_TEXTS) & (F.col("s") >= SEED_SHARE * (F.col("n") + F.col("s")))
    # the scalar of one row: below a share of all texts no word needs an entry
    least = rows.where(F.col("key") == COUNT).agg((F.coalesce(F.max("n"), F.lit(0)) / RARE).alias("least"))
    return rows.join(F.broadcast(least)).where(filler | (F.col("n") > F.col("least"))).select("key", F.when(filler, -1 - F.col("n")).otherwise(F.col("n")).alias("value"))


class Judge:
    """The inverted index and the weights."""

    def __init__(self, found: Found, notices: list[tuple[str, frozenset[str]]], forms: list[tuple[str, frozenset[str], bool]] | None = None):
        self.found = found
        self.n = max(1, found.get(COUNT) or 1)
        self.rare = math.log((self.n + 1) / 0.5) if self.n > 1 else 1.0
        self.labels = [label for label, _ in notices]
        #: postings: word -> exemplars
        self.index: dict[str, tuple[int, ...]] = {}
        for k, (_, words) in enumerate(notices):
            for w in words:
                self.index[w] = (*self.index.get(w, ()), k)
        self.learned = len(self.labels)
        self.labels.append("filler")
        self.filler_words = frozenset().union(*(v for label, v in notices if label == "filler"))
        #: marks -> exemplars of placeholders with them
        self.forms: dict[str, list[frozenset[str] | None]] = {}
        for mark, words, any_ in forms if forms is not None else placeholders():
            self.forms.setdefault(mark, []).append(None if any_ else words)
        self.forms.setdefault("()", self.forms.get("[]", []))
        self.memo: dict[str, tuple[float, tuple[int, ...]]] = {}

    def entry(self, w: str) -> tuple[float, tuple[int, ...]]:
        """Weight and postings of a word."""
        x = self.memo.get(w)
        if x is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            count = self.found.get(w, 0)
            posts = self.index.get(w, ())
            if count < 0:  # learned filler
                count, posts = -1 - count, (*posts, self.learned)
            elif w in self.filler_words and w in SEEDS:
                posts = (*posts, self.learned)
            x = self.memo[w] = (max(0.05, self.rare if count <= self.n / RARE else math.log((self.n + 1) / (count + 0.5)) if self.n > 1 else 1.0), posts)
        return x

    def asks(self, span: str, mark: str) -> bool:
        """Whether a span with such marks is an unfilled placeholder: contained in an exemplar with them."""
        candidates = self.forms.get(mark)
        if not candidates:
            return False
        if None in candidates:
            return True
        words = WORDS(span.lower())
        if not words:
            return False
        weights = [self.entry(w)[0] for w in words]
        return max(sum(x for w, x in zip(words, weights) if w in e) for e in candidates) >= ASKED * sum(weights)

    def placeholder(self, text: str) -> bool:
        if any(h in text for h in HINTS) and any(not _quoted(text, *m.span()) and self.asks(m.group(), marks(m.group())) for m in MARKED.finditer(text)):
            return True
        return ("[" in text or "<" in text or "(" in text) and any(not _quoted(text, *m.span()) and self.asks(x := m.group(), x[0] + x[-1]) for m in BRACKET.finditer(text))

    def contained(self, entries: list[tuple[float, tuple[int, ...]]], total: float) -> bool:
        """Whether the best exemplar of a window, with the best next one of its label, contains it."""
        # all exemplars together hold no less than two of them
        if sum([x for x, posts in entries if posts]) < CONTAINED * total:
            return False
        by: dict[int, float] = {}
        for x, posts in entries:
            for k in posts:
                by[k] = by.get(k, 0.0) + x
        first = max(by, key=by.__getitem__)
        if by[first] >= CONTAINED * total:
            return True
        label = self.labels[first]
        more: dict[int, float] = {}
        for x, posts in entries:
            if first not in posts:
                for k in posts:
                    if self.labels[k] == label:
                        more[k] = more.get(k, 0.0) + x
        return by[first] + max(more.values(), default=0.0) >= CONTAINED * total

    def covered(self, text: str) -> float:
        """Share of the text in windows that exemplars contain: of its weight or of its words, whichever is less."""
        if "<" in text:  # markup around a message is part of it
            text = TAGS.sub("\n", text)
        windows = [words for passage in PASSAGE.split(text) if (words := WORDS(passage.lower()))]
        n, n_inside, left = sum(map(len, windows)), 0, (1 - COVERED) * sum(map(len, windows))
        whole = inside = 0.0
        known, entry = self.memo.get, self.entry
        for words in windows:
            entries = [known(w) or entry(w) for w in words]
            total = sum([x for x, _ in entries])
            whole += total
            if self.contained(entries, total) or (len(words) >= REPEATED_WORDS and len(set(words)) <= REPEATED_SHARE * len(words)):
                inside += total
                n_inside += len(words)
            else:
                left -= len(words)
                if left < 0:  # the rest can't cover the text any more
                    return 0.0
        return min(inside / whole, n_inside / n) if n else 0.0

    def residue(self, text: str) -> bool:
        return self.placeholder(text) or self.covered(text) >= COVERED


def _quoted(text: str, start: int, end: int) -> bool:
    return 0 < start and end < len(text) and text[start - 1] in OPENING and text[end] in CLOSING


def find_residue(outputs: DataFrame, key: str = "output_id", notices: list[tuple[str, frozenset[str]]] | None = None, limit: int | None = None) -> DataFrame:
    """The keys of the texts that are residue, each once."""
    kind = outputs.schema[key].dataType.simpleString()
    labelled = notices or exemplars()
    every = frozenset().union(*(v for _, v in labelled))

    def wanted(c, i):
        t = c["text"][i]
        return set(WORDS(t.lower())) if t is not None else ()

    def decide(c, i, judge):
        t = c["text"][i]
        return [(c[key][i],)] if t is not None and t.strip() and judge.residue(t) else []

    always = {COUNT, *every, *(w for _, words, _ in placeholders() for w in words)}
    rows = spread(outputs.select(key, "text"))
    return with_lookup(rows, document_counts(rows, every), wanted, decide, f"`{key}` {kind}", limit, lambda found: Judge(found, labelled), always).distinct()


def without_residue(outputs: DataFrame, key: str = "output_id") -> DataFrame:
    """The rest of the table, with all its columns and rows."""
    return outputs.join(find_residue(outputs, key), key, "left_anti")


def p5_found(spark, sf_dir: str) -> DataFrame:
    """The outputs that hold placeholders, filler, error messages or script notices."""
    return find_residue(table(spark, sf_dir, "model_outputs"))


def p5_clean(spark, sf_dir: str) -> DataFrame:
    """model_outputs without residue."""
    return without_residue(table(spark, sf_dir, "model_outputs"))
