"""Problem 2: texts that were cut by a length limit or a broken transfer.

Over all texts, the corpus vocabulary is counted and laid out as a trie: each prefix of a word is a node that holds how
often words go on from it, and each word how often it closes a sentence. A text is looked at where it stops. One that
stops with the end of a sentence, a closed bracket or a whole line of a closing list is complete. Of any other the final
token is looked up, and the evidence is combined:

* trie: the token is an unknown proper prefix of known words, so the text stops inside a word;
* length: unfinished texts pile up at its length in characters or bytes;
* going on: the log ratio of how often the token closes sentences to how often any token does. A cut falls anywhere, an
  end falls on words that end sentences. A text that has neither of the first two is cut if this makes it more probable
  than not, against the share of complete texts among such endings, which is fitted to all of them (two-part mixture by
  expectation maximisation over a histogram). So complete texts without a full stop are told from cut ones by their last
  words and by how common either is, and no mark at the end decides by itself. A structure left open (a bracket, bold
  type, a table row) counts as a ratio of OPEN;
* list: the shape of a line of a closing list isn't one its label has in the corpus, or its value is an unknown proper
  prefix of values of the same label. Numbers, which are prefixes of numbers, need length evidence;
* mark: an ellipsis is set by a cut unless it ends a notice: a clause of words of the labelled exemplars alone, or one
  that ends a good share of all texts, without a pile at its length.

All counts cover all texts, those of lengths and of clauses with an ellipsis distinct texts; the trie is distributed, and
broadcast only if its size allows. Results: null and blank texts are never cut; repeated rows count once; rates are over
distinct outputs with text, a null source is a source.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import map_rows, with_lookup
from folio.llm.residue import WORDS, exemplars
from folio.session import cut, spread, table

LAST_WORD = re.compile(r"\w+(?:['’\-]\w+)*$")
CLOSERS = "\"'”’»)]*"
EDGES = "\"'“”„‘’«»()[]{}<>*_|.,;:!?…—–-"
TERMINAL = ".!?。！？…\"”»>}"
LABEL = re.compile(r"^([^\w\n]{0,4}[^\W\d_](?:[^\W\d_]| ){0,30}:)\s*(.*)$")
SHAPE_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|['’\-])*")
DIGITS = re.compile(r"\d+")
#: Marks that a cut text may end with (fixed forms): an ellipsis, a bracketed ellipsis or note, a broken character.
MARK = re.compile(r"(?:…|\.\.\.|\[(?:…|\.\.\.|cut|truncated|snip)\]|\(…\)|\n\s*[\[(<][^\])>\n]*|\n\s*[\[(<]?(?:connection|stream|transfer|output)\b[^\n]{0,40}|�)$", re.I)
#: Abbreviations that end in a full stop inside a sentence (fixed list).
ABBREVIATIONS = frozenset("mr mrs ms dr prof st vol no nr fig cf p pp ch ed eds e.g i.e bzw vgl z d p.ej".split())
SEP = "\x1f"
WORDS_OF_ALL, ENDS_OF_ALL = f"W{SEP}", f"E{SEP}"
#: What a structure left open makes of the odds that a text is complete; uses that the mean counts as in a word's share of
#: closed sentences.
OPEN, SMOOTH = 0.02, 5.0
#: A word is an unknown prefix if words that go on from it are so many times as frequent.
RARER = 20
#: Share of a label's lines that a finished shape has at least.
SHAPE_SHARE = 0.05
#: Words of a notice that may end in an ellipsis.
NOTICE_WORDS = 4
#: A clause is a notice if such a share of all texts ends with it.
NOTICE_SHARE = 0.05
EXEMPLARS = tuple(v for _, v in exemplars())
#: A length is evidence if so many unfinished texts have it, and so many times as many as have the lengths around it.
PILE, PILE_RATIO, AROUND = 4, 4, 5


def shape(line: str) -> str:
    return SHAPE_WORD.sub("w", DIGITS.sub("9", line))


def closing_lines(text: str) -> list[str]:
    """The lines of the last paragraph."""
    last = text[text.rfind("\n\n") + 2 :] if "\n\n" in text else text[text.rfind("\n") + 1 :]
    return last.split("\n")


def ending(text: str) -> tuple | None:
    """None if the text stops with a finished sentence or a closed line; else (kind, label, line)."""
    t = text.rstrip()
    if t[-1] in ".!?" and t[-3:] != "...":
        w = t.rsplit(None, 1)[-1].lower().strip(EDGES)
        return ("stop", "", w) if t[-1] == "." and w in ABBREVIATIONS else None
    line = t[t.rfind("\n") + 1 :]
    if MARK.search("\n" + line if len(line) < len(t) else line):
        return ("mark", "", re.split(r"[.!?] ", line)[-1])
    if line.startswith("|"):
        above = t[: len(t) - len(line)].rstrip("\n")
        wanted = above[above.rfind("\n") + 1 :].count("|")
        if line.count("|") == wanted or (wanted == 0 and line.endswith("|")):
            return None
        return ("open", "", line)
    if line.startswith("**") and line.count("**") % 2 or line.rfind("(") > line.rfind(")"):
        return ("open", "", line)
    if line.endswith(("**", ")", "]")) or line.rstrip(CLOSERS)[-1:] in TERMINAL or line[-1] in TERMINAL:
        return None
    m = LABEL.match(line)
    if m:
        return ("label", m.group(1), line)
    return ("line", "", line) if line.startswith("#") else ("body", "", line)


def _merged(raw: Counter, count: Counter) -> None:
    """Raw tokens, with the marks around them, to words."""
    for token, n in raw.items():
        w = token.lower().strip(EDGES)
        if w:
            count[w] += n
            count[WORDS_OF_ALL] += n
            if token.rstrip(CLOSERS)[-1:] in (".", "!", "?"):
                count[f"E{SEP}{w}"] += n
                count[ENDS_OF_ALL] += n


def _statistics(batches):
    """Counts of a partition's texts: key, n, and the hash of the text where distinct texts count."""
    count: Counter[str] = Counter()
    raw: Counter[str] = Counter()
    once: set[tuple[str, int]] = set()
    for c in batches:
        for t, h in zip(c["text"], c["h"]):
            if t is None or not (words := t.split()):
                continue
            end = ending(t)
            once.add((f"N{SEP}", h))
            if end and end[0] != "stop":
                words.pop()  # the last word of an unfinished text teaches nothing
                if end[0] != "label":
                    once.update(((f"C{SEP}{len(t)}", h), (f"B{SEP}{len(t.encode())}", h)))
                if end[0] == "mark":
                    once.add((f"T{SEP}{end[2]}", h))
            raw.update(words)
            if "\n" in t:
                for line in closing_lines(t):
                    m = LABEL.match(line)
                    if m:
                        label = m.group(1)
                        count[f"M{SEP}{label}"] += 1
                        count[f"S{SEP}{shape(line)}"] += 1
                        for w in m.group(2).lower().split():
                            count[f"L{SEP}{label}{SEP}{w.strip(EDGES)}"] += 1
        if len(raw) + len(count) + len(once) > 300_000:
            _merged(raw, count)
            yield [*((k, n, None) for k, n in count.items()), *((k, 1, h) for k, h in once)]
            raw, count, once = Counter(), Counter(), set()
    _merged(raw, count)
    yield [*((k, n, None) for k, n in count.items()), *((k, 1, h) for k, h in once)]


def corpus_counts(texts: DataFrame) -> DataFrame:
    """key, value: every count and every node of the trie ("P" and a prefix: uses of the longer words below it)."""
    rows = map_rows(texts.select("text", F.xxhash64("text").alias("h")), _statistics, "key string, n long, h long")
    each = rows.groupBy("key", "h").agg(F.sum("n").alias("n"))
    # read twice below, so written down: the texts are read once
    counts = cut(each.groupBy("key").agg(F.sum(F.when(F.col("h").isNull(), F.col("n")).otherwise(1)).alias("n")))
    word = F.when(F.col("key").startswith(f"L{SEP}"), F.substring_index("key", SEP, -1)).otherwise(F.col("key"))
    words = counts.where(F.col("key").startswith(f"L{SEP}") | ~F.col("key").contains(SEP)).withColumn("w", word)
    head = F.expr("substring(key, 1, length(key) - length(w))")
    nodes = (
        words.where("length(w) > 1")
        .select(head.alias("head"), "w", "n", F.explode(F.expr("sequence(1, length(w) - 1)")).alias("k"))
        .groupBy(F.concat(F.lit(f"P{SEP}"), "head", F.expr("substring(w, 1, k)")).alias("key"))
        .agg(F.sum("n").alias("n"))
    )
    return counts.unionByName(nodes).select("key", F.col("n").alias("value"))


def last_word(line: str) -> str:
    line = line.lower()
    while line and not (line[-1].isalnum() or line[-1] == "_"):
        line = line[:-1]
    m = LAST_WORD.search(line.rsplit(None, 1)[-1]) if line else None
    return m.group() if m else ""


def last_value(line: str) -> str:
    return line.split()[-1].lower().strip(EDGES)


def _keys(kind: str, label: str, line: str, chars: int, size: int) -> list[str]:
    if kind == "stop":
        return []
    lengths = [f"{k}{SEP}{n + d}" for k, n in (("C", chars), ("B", size)) for d in range(-AROUND, AROUND + 1)]
    if kind == "mark":
        return [*lengths, f"T{SEP}{line}", f"N{SEP}"]
    w = last_value(line)
    if kind == "label":
        return [*lengths, f"M{SEP}{label}", f"S{SEP}{shape(line)}", f"L{SEP}{label}{SEP}{w}", f"P{SEP}L{SEP}{label}{SEP}{w}"]
    w = last_word(line)
    return [*lengths, w, f"P{SEP}{w}", f"E{SEP}{w}"]


def pile(found: dict, chars: int, size: int) -> int:
    """Length evidence: how many unfinished texts have just this length, if far more than have the lengths around it."""
    most = 0
    for k, n in (("C", chars), ("B", size)):
        here = found.get(f"{k}{SEP}{n}", 0)
        near = sum(found.get(f"{k}{SEP}{n + d}", 0) for d in range(-AROUND, AROUND + 1) if d) / (2 * AROUND)
        if here >= PILE and here >= PILE_RATIO * near:
            most = max(most, here)
    return most


def notice(line: str) -> bool:
    """Whether a clause has several words, all of them words of one label's exemplars."""
    words = WORDS(line.lower())
    return len(words) >= NOTICE_WORDS and any(v.issuperset(words) for v in EXEMPLARS)


def evidence(kind: str, label: str, line: str, chars: int, size: int, found) -> tuple[str, float | None] | None:
    """What says that a text is cut, and None; or "going on" and the log ratio that its end is one of a complete text; None
    if nothing does."""
    get = found.get
    if kind == "stop":
        return "going on", None  # an abbreviation goes on in its sentence
    if kind == "mark":
        # a notice of several words that always ends so is no cut, unless texts with other endings pile up at its length
        if len(line.split()) >= NOTICE_WORDS:
            same = get(f"T{SEP}{line}", 0)
            often = same >= 2 and same >= NOTICE_SHARE * get(f"N{SEP}", 0)
            if (often or notice(line)) and pile(found, chars, size) <= 3 * same:
                return None
        return "mark", None
    if kind == "label":
        w = last_value(line)
        if not w or get(f"S{SEP}{shape(line)}", 0) < max(2, SHAPE_SHARE * get(f"M{SEP}{label}", 0)):
            return "list", None
        known, longer = get(f"L{SEP}{label}{SEP}{w}", 0), get(f"P{SEP}L{SEP}{label}{SEP}{w}", 0)
        # numbers go on in numbers, so only their length tells
        if w.isdigit():
            return ("length", None) if longer > 0 and pile(found, chars, size) > 0 else None
        return ("trie", None) if longer > RARER * known else None
    w = last_word(line)
    known, longer = get(w, 0), get(f"P{SEP}{w}", 0)
    if w and longer > RARER * known:
        return "trie", None
    if pile(found, chars, size) > 0:
        return "length", None
    if kind == "line":  # a heading ends in any word
        return None if w else ("list", None)
    mean = (get(ENDS_OF_ALL, 0) + 1) / (get(WORDS_OF_ALL, 0) + 2)
    share = (get(f"E{SEP}{w}", 0) + SMOOTH * mean) / (known + SMOOTH) if w else 0.5 * mean
    return "going on", math.log(share / mean) + (math.log(OPEN) if kind == "open" else 0.0)


def complete_share(ratios: list[tuple[float, int]], rounds: int = 200) -> float:
    """The share of complete texts among endings of these (log ratio, number), by expectation maximisation; one of each
    kind is added."""
    share, n = 0.5, sum(k for _, k in ratios)
    for _ in range(rounds):
        share = (1 + sum(k / (1 + (1 - share) / share * math.exp(-r)) for r, k in ratios)) / (n + 2)
    return share


def cut_evidence(outputs: DataFrame, key: str = "output_id", limit: int | None = None) -> DataFrame:
    """key, why of each cut text."""
    kind_of_key = outputs.schema[key].dataType.simpleString()
    outputs = spread(outputs.select(key, "text"))

    def tails(batches):
        for c in batches:
            out = []
            for k, t in zip(c[key], c["text"]):
                if t is None or not t.strip():
                    continue
                e = ending(t)
                if e:
                    out.append((k, *e, len(t), len(t.encode())))
            yield out

    ends = map_rows(outputs.select(key, "text"), tails, f"`{key}` {kind_of_key}, kind string, label string, line string, chars int, size int")
    ends = ends.dropDuplicates([key])

    def feature(c, i):
        return c["kind"][i], c["label"][i], c["line"][i], c["chars"][i], c["size"][i]

    def decide(c, i, found):
        e = evidence(*feature(c, i), found)
        return [(c[key][i], *e)] if e else []

    always = (WORDS_OF_ALL, ENDS_OF_ALL, f"N{SEP}")
    seen = cut(with_lookup(ends, corpus_counts(outputs), lambda c, i: _keys(*feature(c, i)), decide, f"`{key}` {kind_of_key}, why string, ratio double", limit, always=always))
    # one row per tenth of a log ratio, and these are bounded by the logarithm of the counts
    tenths = seen.where("ratio is not null").groupBy(F.round("ratio", 1).alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()
    share = complete_share([(r["r"], r["n"]) for r in tenths])
    return seen.where(F.col("ratio").isNull() | (F.col("ratio") + math.log(share / (1 - share)) < 0)).select(key, "why")


def find_cut(outputs: DataFrame, key: str = "output_id", limit: int | None = None) -> DataFrame:
    """The keys of the cut texts, each once."""
    return cut_evidence(outputs, key, limit).select(key)


def cut_rates(outputs: DataFrame, key: str = "output_id", source: str = "model_name") -> DataFrame:
    """Per source: its distinct outputs with text, those that are cut, and their share."""
    rows = outputs.where(F.col("text").isNotNull() & F.col("text").rlike(r"\S")).select(key, source).dropDuplicates([key])
    found = find_cut(outputs, key).withColumn("__cut", F.lit(1))
    per = rows.join(found, key, "left").groupBy(source).agg(F.count(F.lit(1)).alias("n_outputs"), F.count("__cut").alias("n_cut"))
    return per.withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_outputs"), 6))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """The cut outputs."""
    return find_cut(table(spark, sf_dir, "model_outputs"))


def p2_rates(spark, sf_dir: str) -> DataFrame:
    """How often each model's outputs are cut."""
    return cut_rates(table(spark, sf_dir, "model_outputs"))
