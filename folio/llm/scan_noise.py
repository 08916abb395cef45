"""Problem 1: text from scanned pages, repaired into continuous paragraphs.

The de-lined character stream (lines joined, words over line ends and page edges joined, running lines left out) is decoded
by joint word segmentation: a lattice over the characters has an arc for each stretch that is a word of the corpus, or
that a confusion of characters makes one, whether a space is printed inside it (split), missing at its ends (merge) or a
hyphen and a line end lie in it. A path is worth as much as its rarest word occurs, divided by a ratio for every edit on
it; the path of most worth is taken by dynamic programming, if it is worth more than the stream as it is printed. Worth
is a ratio of frequencies throughout, so decoding is the same at every size of the corpus.

The lattice is cut where no other path can win: between two words that are frequent in the corpus as they are printed no
arc across is worth more than both. What lies between such cuts is a window: a single form, the two parts of a word at a
line end, or a run of rare tokens with its neighbours. Each distinct window is decoded once, and its reading is applied
wherever it occurs. Running headers, footers and page numbers are lines at the edge of a page that come again on other
pages of the book (page numbers: that keep their distance to the page index), or that stand in the middle of a sentence.
Paragraph boundaries are chosen by dynamic programming over the lines.

No page or book is gathered: forms and edge lines are aggregated with partial counts, readings and the vocabulary are
broadcast only if their size allows, else their head is and the rest is joined.

Results: null and blank texts have no noise and no paragraphs; repeated rows count once; a chapter without an end page
reaches to the end of its book. A running line has no other kind. No word is longer than LONGEST
characters; a longer string is several words or left as it is.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import map_rows, with_lookup
from folio.session import cut, spread, table

#: Characters (as misread, as printed) that recognition confuses: fixed list.
CONFUSED = (
    ("c", "e"), ("|", "i"), ("!", "i"), ("|", "l"), ("!", "l"), ("æ", "a"), ("æ", "e"), ("®", "r"), ("ri", "n"), ("f", "t"), ("0", "o"), ("5", "s"), ("$", "s"), ("£", "l"),
    ("1", "l"), ("1", "i"), ("l", "i"), ("i", "l"), ("ii", "u"), ("cl", "d"), ("d", "cl"), ("(", "c"), ("rn", "m"), ("m", "rn"), ("9", "g"), ("b", "h"), ("h", "b"), ("6", "b"), ("8", "b"),
    ("m", "in"), ("y", "v"), ("v", "y"), ("ü", "ti"), ("ſ", "f"), ("ſ", "s"), ("vv", "w"), ("h", "li"), ("tl", "d"), ("o", "c"), ("c", "o"), ("u", "n"), ("n", "u"), ("@", "a"),
    ("ш", "щ"), ("щ", "ш"), ("и", "н"), ("н", "и"), ("п", "н"), ("с", "е"), ("е", "с"), ("о", "а"), ("3", "з"), ("0", "о"), ("6", "б"), ("ж", "мн"), ("ii", "й"), ("(", "с"),
)
#: Marks that aren't part of a word at its edges, and those among them that may be misread characters.
EDGES = "\"'“”„‘’«»()[]{}<>*_|.,;:!?…—–-"
DOUBTFUL = "(!|"
#: Characters that don't stand between letters in print.
ODD = re.compile(r"(?<=[^\W\d_])[!|®£(@$\d](?=[^\W\d_])|[®£ſ](?=[^\W\d_])|(?<=[^\W\d_])[®£ſ]")
HYPHENS = "-‐¬\xad="
HYPHEN_SET = frozenset(HYPHENS)
LINE_HYPHEN = re.compile(r"[-‐¬\xad=][^\S\n]*(?:\n|$)")
BROKEN = re.compile(r"([^\W\d_][^\s]*?)[-‐¬\xad=]\s*$")
FIRST_WORD = re.compile(r"\s*([^\s]+)")
#: Words behind which a hyphen may stay open, as in "pre- and post-" (fixed list).
OPEN_HYPHEN = frozenset("and or und oder et ou y o i oraz lub e ou и или".split())
ROMAN = re.compile(r"^[ivxlc]+$")
NUMBER = re.compile(r"^\W*(?:page|p\.|seite|s\.|pág\.|str\.|стр\.)?\s*([\dlIoOSB|!]{1,4}|[ivxlcIVXLC]{1,7})(?:\s*(?:/|of|von|de|sur|z|из)\s*\d{1,4})?\W*$", re.I)
#: A page number before or behind a running title.
BESIDE = re.compile(r"^[\[(]?(\d{1,4})[\])]?(?:\s*[|·•—–-]\s*|\s+)(?=[^\W\d_])|(?:\s*[|·•—–-]\s*|\s{2,}|\s)[\[(]?(\d{1,4}|[ivxlc]{1,6})[\])]?$")
#: How headings begin (fixed list): these run only where the whole line comes again.
HEADING = re.compile(r"^\s*(?:(?:chapter|part|section|book|appendix|kapitel|teil|abschnitt|chapitre|partie|section|capítulo|parte|sección|seção|rozdział|część|глава|часть|раздел)\b|\d{1,3}[.)]\s)", re.I)
SENTENCE_BREAK = re.compile(r"[^\W\d_]{3,}[.!?] ")
LETTERS = re.compile(r"[^\W\d_]+")
#: A reading is believed if it is so many times as frequent as the form: for a form with an odd character, of four
#: letters and more, and of fewer.
ODD_RATIO, RATIO, SHORT_RATIO = 1.0, 25.0, 150.0
KNOWN = 3
#: No word of print is longer: the reach of an arc of the lattice.
LONGEST = 48
#: The same for merged words, for a part of them of fewer than four letters or with a misread one (such parts fit in many
#: places), and for words with a space inside.
MERGED_RATIO, MORE_RATIO, SPLIT_RATIO = 50.0, 2.0, 50.0
#: Tokens of at most such a share of all (or of KNOWN uses) may be parts of words, and how many in a row are looked at.
FRAGMENT, RUN_LENGTH = 2e-5, 6
ALL = "\x1fN"
EDGE_LINES = 3
SEP = "\x1f"


def core(token: str) -> str:
    return token.strip(EDGES).lower()


def title_like(line: str) -> bool:
    """Whether a line could be a running header: short, without the end of a sentence, mostly capitalised."""
    s = line.strip()
    if len(s) < 2 or s[0].islower() or s[-1] in ".,;:!?-‐¬\xad=":
        return False
    words = [w for x in s.split() if (w := x.strip(EDGES)) and LETTERS.search(w)]
    if not words or SENTENCE_BREAK.search(s):
        return False
    if len(words) >= 6 and all(len(w) == 1 for w in words):
        return True  # spaced out
    long_ = [w for w in words if len(w) > 3] or words
    return s.lstrip(EDGES + " 0123456789")[:1].isupper() and sum(w[0].isupper() or w[0].isdigit() for w in long_) >= 0.9 * len(long_)


def number_like(line: str) -> bool:
    m = NUMBER.match(line.strip())
    return bool(m) and (any(c.isdigit() for c in m.group(1)) or bool(ROMAN.match(m.group(1).lower())))


# ---- forms -------------------------------------------------------------------------------------------------------------


def _break(lines: list[str], k: int) -> tuple[str, list[str], bool] | None:
    """If line k ends in a hyphen: the broken part, the words it may go on with, whether it may go on behind the text."""
    if not lines[k].rstrip()[-1:] or lines[k].rstrip()[-1] not in HYPHENS:
        return None
    m = BROKEN.search(lines[k])
    if not m:
        return None
    nexts, end = [], True
    for j in range(k + 1, len(lines)):
        line = lines[j]
        if not line.strip():
            continue
        w = FIRST_WORD.match(line).group(1)
        nexts.append(w)
        if not (title_like(line) or number_like(line)):
            end = False
            break
    return m.group(1).split()[-1].lstrip(EDGES), nexts, end


def _form_counts(batches):
    count: Counter[str] = Counter()
    joins: set[str] = set()
    for c in batches:
        for t in c["text"]:
            if not t or not t.strip():
                continue
            count.update(t.split())
            if not LINE_HYPHEN.search(t):
                continue
            lines = t.split("\n")
            for k, line in enumerate(lines):
                if line.rstrip()[-1:] in HYPHEN_SET and (b := _break(lines, k)):
                    count[line.split()[-1]] -= 1  # a part of a word is no form
                    for w in b[1]:
                        joins.add(b[0] + SEP + w.rstrip(EDGES))
        if len(count) + len(joins) > 300_000:
            yield [*((w, n) for w, n in count.items() if n), *((j, 0) for j in joins)]
            count, joins = Counter(), set()
    yield [*((w, n) for w, n in count.items() if n), *((j, 0) for j in joins)]


def variants(w: str) -> list[tuple[str, int]]:
    """Words that w may be a misreading of, with the number of confusions: one or two."""
    if len(w) > LONGEST:
        return []
    out: dict[str, int] = {}
    todo = [w]
    for depth in (1, 2):
        new = []
        for x in todo:
            for wrong, right in CONFUSED:
                at = x.find(wrong)
                while at >= 0:
                    y = x[:at] + right + x[at + len(wrong) :]
                    if y != w and y not in out:
                        out[y] = depth
                        new.append(y)
                    at = x.find(wrong, at + 1)
        if depth == 1:
            if len(w) < 5:
                break
            odd = len(ODD.findall(w))
            todo = [x for x in new if not odd or len(ODD.findall(x)) < odd]
    return list(out.items())


def _bases(token: str) -> list[str]:
    """The word of a token, and the same with doubtful marks at its edges kept."""
    w = core(token)
    kept = token.lower().strip("".join(c for c in EDGES if c not in DOUBTFUL))
    return [w] if kept == w or len(kept) < 3 else [w, kept]


def _wanted_of(form: str) -> set[str]:
    if SEP in form:
        a, b = form.split(SEP)
        a, b = a.lower(), b.lower().strip(EDGES)
        w = a + b
        return {w, f"{a}-{b}", a, b, *(v for v, _ in variants(w))}
    out: set[str] = set()
    bases = _bases(form)
    if len(bases) > 1:
        out.add(SEP + bases[0])
    for w in bases:
        out.add(w)
        out.update(v for v, _ in variants(w))
        if len(w) >= 6 and w.isalpha():
            out |= _wanted_of_window(w)
    return out


def misread(w: str, n: int, found: dict) -> str | None:
    """The word that w is a misreading of."""
    odd = bool(ODD.search(w)) or any(c in w for c in "(|")
    ratio = ODD_RATIO if odd else RATIO if len(w) >= 4 else SHORT_RATIO
    if not 2 <= len(w) <= LONGEST or (len(w) == 2 and not odd and n * 1000 < 1):
        return None
    best, most = None, 0.0
    for v, k in variants(w):
        m = found.get(v, 0)
        if m >= KNOWN - odd and m >= ratio * n * (1 if odd else k * k) and m / (8**k) > most and not ODD.search(v):
            best, most = v, m / (8**k)
    return best


def reading(form: str, found: dict) -> str | None:
    """What a form is read as: "m" misread, "j" one word, "h" a compound, "n" no word goes on, "s" two merged words."""
    get = found.get
    if SEP in form:
        a, b = form.split(SEP)
        b = b.strip(EDGES)
        la, lb = a.lower(), b.lower()
        whole, compound = get(la + lb, 0), get(f"{la}-{lb}", 0)
        if lb in OPEN_HYPHEN and whole < KNOWN:
            return "n"
        if compound > whole and compound >= KNOWN:
            return "h"
        if whole >= KNOWN:
            right = misread(la + lb, whole, found)
            return f"m{right}" if right else "j"
        right = misread(la + lb, max(1, whole), found)
        if right:
            return f"m{right}"
        if get(la, 0) >= 20 and get(lb, 0) >= 20:
            return "h"
        return "j" if b[:1].islower() else "n"
    bases = _bases(form)
    n = get(bases[0], 0)
    if len(bases) > 1:
        w, bare = bases[1], n - get(SEP + bases[0], 0)
        right = misread(w, max(1, bare), found)
        # the marks are marks if the word is frequent without them, or the reading is rarer than the word
        if right and get(right, 0) >= max(ODD_RATIO * n, (RATIO if len(w) >= 4 else SHORT_RATIO) * bare):
            return f"m{right}"
    right = misread(bases[0], n, found)
    if right:
        return f"m{right}"
    w = bases[0]
    if w.isalpha():
        if len(w) >= 6 and (path := segment(w, (), found, MERGED_RATIO * max(1, n))) and len(path[0]) > 1:
            return f"s{' '.join(path[0])}"
        if n <= max(KNOWN, FRAGMENT * get(ALL, 0)):
            return "f"
    return f"o{w}" if ODD.search(w) and ")" not in form else None


def segment(chars: str, spaces: tuple[int, ...], found, least: float) -> tuple[list[str], set[int]] | None:
    """The words, and the places of their ends, of the path through the lattice of a window that is worth most, if that is worth least: spaces are the
    places of printed spaces. An arc is a word of the corpus or, where words reach both its ends, the reading of a misread
    one."""
    n, get = len(chars), found.get
    counts: dict[tuple[int, int], float] = {}

    def arc(i: int, j: int) -> bool:
        if (i, j) in counts:
            return True
        if j - i < 2 or (i == 0 and j == n and not spaces):  # a letter; the window as it is printed
            return False
        m = get(chars[i:j], 0)
        if m >= least and spaces:
            m /= SPLIT_RATIO ** max(0, sum(i < x < j for x in spaces) - 1)
        if not spaces and j - i < 4:
            m /= MORE_RATIO
        if m >= least:
            counts[i, j] = m
            return True
        return False

    heads = {0}
    for i in range(n - 1):  # only arcs that words reach from the start
        if i in heads:
            heads.update(j for j in range(i + 2, min(n, i + LONGEST) + 1) if arc(i, j))
    path = _path(n, counts) if n in heads else None
    if path is not None:
        return [chars[i:j] for i, j in path], {j for _, j in path}
    if not spaces and least > MERGED_RATIO * max(KNOWN, FRAGMENT * get(ALL, 0)):
        return None  # a merged word with a misread character in it is rare
    tails = {n}
    for j in range(n, 1, -1):
        if j in tails:
            tails.update(i for i in range(max(0, j - LONGEST), j - 1) if arc(i, j))
    confused = {}
    for i in heads:
        for j in tails:
            if 4 <= j - i <= LONGEST and (i, j) not in counts and (j - i < n or spaces):
                right = misread(chars[i:j], max(1, get(chars[i:j], 0)), found)
                if right and get(right, 0) / MORE_RATIO >= least:
                    confused[i, j] = right
                    counts[i, j] = get(right, 0) / MORE_RATIO
    path = _path(n, counts) if confused else None
    return ([confused.get((i, j), chars[i:j]) for i, j in path], {j for _, j in path}) if path else None


def _path(n: int, arcs: dict[tuple[int, int], float]) -> list[tuple[int, int]] | None:
    """The path whose rarest word is most frequent; of several the one of fewest words."""
    into: dict[int, list[tuple[int, float]]] = {}
    for (i, j), m in arcs.items():
        into.setdefault(j, []).append((i, m))
    best: list[tuple[float, int, int]] = [(float("inf"), 0, -1)] + [(0.0, 0, -1)] * n  # worth, less words, start
    for j in range(1, n + 1):
        best[j] = max(((min(best[i][0], m), best[i][1] - 1, i) for i, m in into.get(j, ()) if best[i][0] > 0), default=best[j])
    if best[n][0] <= 0:
        return None
    out, j = [], n
    while j:
        out.append((best[j][2], j))
        j = best[j][2]
    return out[::-1]


def window_reading(window: str, found) -> str | None:
    """What a run of tokens with printed spaces between them reads as: "w" and the words, "x" if a character is misread."""
    tokens = window.split(" ")
    chars, spaces, at = "".join(tokens), [], 0
    for t in tokens[:-1]:
        at += len(t)
        spaces.append(at)
    printed = min(found.get(t, 0) for t in tokens)
    got = segment(chars, tuple(spaces), found, SPLIT_RATIO * max(1, printed))
    if not got:
        return None
    path, ends = got
    removed, missing = len(set(spaces) - ends), len(ends - set(spaces) - {len(chars)})
    if not removed or missing > removed:
        return None  # nothing was joined: such forms are read by themselves
    return ("w" if "".join(path) == chars else "x") + " ".join(path)


def windows_of(lines: list[str], tokens: set[str]) -> list[tuple[int, int, int, str]]:
    """(line, place of the first word, words on that line, window) of the runs of these (rare) tokens, with the word before and the
    one behind, that no mark divides; a run may go on in the next line."""
    out = []
    stream: list[tuple[int, int, str]] = []
    broken = False
    split = [line.split() for line in lines]
    has = [not tokens.isdisjoint(words) for words in split]
    for k, words in enumerate(split):
        if not (has[k] or has[max(0, k - 1)] or has[min(k + 1, len(has) - 1)]) and words:
            if stream and stream[-1][2]:
                stream.append((k, 0, ""))  # too far from any rare token
            broken = words[-1][-1] in HYPHEN_SET
            continue
        if not words:
            stream.append((k, 0, ""))
            continue
        if has[k]:
            # what goes on from a broken line is no word by itself
            stream.extend((k, i, "" if broken and i == 0 else w) for i, w in enumerate(words))
        else:  # a line without a rare token has at most a neighbour of one at its ends
            stream += [(k, 0, "" if broken else words[0]), (k, 1, ""), (k, len(words) - 1, words[-1])] if len(words) > 1 else [(k, 0, "" if broken else words[0])]
        broken = words[-1][-1] in HYPHEN_SET
    n, i = len(stream), 0
    joins = [stream[i][2][-1:].isalpha() and stream[i + 1][2][:1].isalpha() for i in range(n - 1)] + [False]
    rare = [w in tokens for _, _, w in stream]
    while i < n:
        if not rare[i]:
            i += 1
            continue
        j = i
        while j + 1 < n and rare[j + 1] and joins[j] and j + 1 - i < RUN_LENGTH:
            j += 1
        first, last = i - (i > 0 and joins[i - 1] and not rare[i - 1]), j + joins[j]
        for a, b in {(first, last), (i, last), (first, j), (i, j)}:
            if b > a:
                k, at, _ = stream[a]
                out.append((k, at, sum(x == k for x, _, _ in stream[a : b + 1]), " ".join(core(w) for _, _, w in stream[a : b + 1])))
        i = j + 1
    return out


def _wanted_of_window(window: str) -> set[str]:
    chars = window.replace(" ", "")
    out = set(window.split(" "))
    for i in range(len(chars) - 1):
        for j in range(i + 2, min(len(chars), i + LONGEST) + 1):
            out.add(chars[i:j])
            if j - i >= 4:
                out.update(v for v, _ in variants(chars[i:j]))
    return out


def readings(texts: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """key (form), value (reading) of every form that isn't simply kept, or that is so rare that it may be a part of a word
    ("f"); and the lexicon: key (word), value (uses)."""
    raw = cut(map_rows(texts.select("text"), _form_counts, "form string, n long").groupBy("form").agg(F.sum("n").alias("n")))

    def words(batches):
        for c in batches:
            counted = [(_bases(f), n) for f, n in zip(c["form"], c["n"])]
            # every use of a word, and again those with doubtful marks at its edges
            yield [(k, n) for b, n in counted if b[0] for k in (b[0], *([SEP + b[0]] if len(b) > 1 else []))] + [(ALL, sum(c["n"]))]

    cores = map_rows(raw.where(f"n > 0 and length(form) <= {LONGEST}"), words, "key string, n long")
    lexicon = cut(cores.groupBy("key").agg(F.sum("n").alias("value")))
    forms = raw.where(F.col("form").rlike(r"\p{L}"))

    def decide(c, i, found):
        r = reading(c["form"][i], found)
        return [(c["form"][i], r)] if r else []

    found = with_lookup(forms.select("form"), lexicon, lambda c, i: _wanted_of(c["form"][i]), decide, "key string, value string", limit, always=[ALL])
    return cut(found), lexicon


def window_readings(windows: DataFrame, lexicon: DataFrame, limit: int | None = None) -> DataFrame:
    """key (window), value (reading) of every window that isn't read as it is printed."""

    def decide(c, i, found):
        r = window_reading(c["key"][i], found)
        return [(c["key"][i], r)] if r else []

    return with_lookup(windows.select("key").distinct(), lexicon, lambda c, i: _wanted_of_window(c["key"][i]), decide, "key string, value string", limit, always=[ALL])


# ---- running lines -----------------------------------------------------------------------------------------------------


def roman_value(s: str) -> int:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    total = 0
    for a, b in zip(s, s[1:] + " "):
        total += -values[a] if values.get(b, 0) > values[a] else values[a]
    return total


DIGIT_LOOKS = str.maketrans("lIoO|!SB", "11001158")


def edge_keys(line: str, page: int) -> list[str]:
    """Keys under which the running line of another page meets this one."""
    s = line.strip()
    m = NUMBER.match(s)
    if m and any(c.isdigit() for c in m.group(1)):
        return [f"N{int(m.group(1).translate(DIGIT_LOOKS)) - page}"]
    if m and ROMAN.match(m.group(1).lower()):
        return [f"R{roman_value(m.group(1).lower()) - page}"]
    if not title_like(s):
        return []
    if HEADING.match(s):
        return [f"H{' '.join(s.lower().split())}"]
    beside = BESIDE.search(s)
    number = beside and (beside.group(1) or beside.group(2))
    letters = "".join(LETTERS.findall(s)).lower()
    n = len(letters)
    if n < 3:
        return []
    out = [f"T{letters}"]
    if number:
        out.append(f"N{int(number) - page}" if number.isdigit() else f"R{roman_value(number) - page}")
    if n >= 9:  # with a misread character in one third
        k = n // 3
        a, b, c = letters[:k], letters[k : n - k], letters[n - k :]
        out += [f"1{a}{SEP}{c}", f"2{n}{SEP}{a}{b}", f"3{n}{SEP}{b}{c}"]
    return out


def _edges(batches):
    for c in batches:
        out = []
        for book, page, t in zip(c["book_id"], c["page_idx"], c["text"]):
            if not t or page is None:
                continue
            lines = [(k, x) for k, x in enumerate(t.split("\n")) if x.strip()]
            top, bottom = lines[:EDGE_LINES], lines[max(EDGE_LINES, len(lines) - EDGE_LINES) :]
            for side, edge in (("t", top), ("b", bottom[::-1])):
                for at, (k, x) in enumerate(edge):
                    keys = edge_keys(x, page)
                    if not keys:
                        break
                    how = ""
                    if keys[0][0] == "T" and page > 0 and len(lines) > at + 1:
                        how = "maybe"
                        near = (lines[at + 1] if side == "t" else lines[-at - 2])[1].strip()
                        full = max(len(y.strip()) for _, y in lines) > 100 or len(x.strip()) > 0.85 * max(len(y.strip()) for _, y in lines)
                        if not full and (near[:1].islower() if side == "t" else near[-1:] not in ".!?:;\"”»)" and not title_like(near) and not number_like(near)):
                            how = "inside"
                    out.append((book, page, k, x, keys, how))
        yield out


def running_lines(pages: DataFrame, scanned: DataFrame) -> DataFrame:
    """book_id, page_idx, line_no, line of each running line. scanned: book_id, page_idx of pages with other noise, on
    which a title at the edge of the page that doesn't open a part of the book runs even if it doesn't come again."""
    edges = map_rows(pages.select("book_id", "page_idx", "text"), _edges, "book_id long, page_idx int, line_no int, line string, keys array<string>, how string")
    edges = cut(edges.distinct())  # read twice below
    keyed = edges.select("book_id", "page_idx", "line_no", "line", "how", F.explode("keys").alias("key"))
    # distinct pages of a key, counted in two steps with partial sums
    often = keyed.select("book_id", "key", "page_idx").distinct().groupBy("book_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("book_id", "key", F.lit(True).alias("again"))
    lines = keyed.join(often, ["book_id", "key"], "left").groupBy("book_id", "page_idx", "line_no", "line", "how").agg(F.coalesce(F.max("again"), F.lit(False)).alias("again"))
    surely = lines.where("again or how = 'inside'").select("book_id", "page_idx", "line_no", "line")
    noisy = scanned.unionByName(surely.select("book_id", "page_idx")).distinct()
    maybe = lines.where("not again and how = 'maybe'").join(noisy, ["book_id", "page_idx"], "left_semi").select("book_id", "page_idx", "line_no", "line")
    return surely.unionByName(maybe)


# ---- lines -------------------------------------------------------------------------------------------------------------


def noisy_lines(text: str, found: dict) -> list[tuple[int, str]]:
    """(line, kind): misread, split; weak kinds that need other noise beside them: compound, odd; line: might be running."""
    lines = text.split("\n")
    out: list[tuple[int, str]] = []
    suspects = {w for w in set(text.split()) if found.get(w, "f") != "f"}
    if not suspects and len(lines) < 2:
        return out
    hyphens = bool(LINE_HYPHEN.search(text))
    for k, line in enumerate(lines):
        if number_like(line) or title_like(line):
            out.append((k, "line"))
    carried: dict[int, str] = {}  # lines whose first word belongs to the line before
    for k, line in enumerate(lines if suspects or hyphens else ()):
        words = line.split()
        if not words:
            continue
        kinds = set()
        last = len(words)
        if hyphens and words[-1][-1] in HYPHEN_SET and (b := _break(lines, k)):
            last -= 1
            head, nexts, end = b
            for at, w in enumerate(nexts):
                r = found.get(head + SEP + w.rstrip(EDGES), "")
                if r[:1] in ("j", "m") or r == "h":
                    if r != "h" or at == len(nexts) - 1:
                        kinds.add("compound" if r == "h" else "split")
                        j = k + 1
                        seen = -1
                        while j < len(lines):
                            if lines[j].strip():
                                seen += 1
                                if seen == at:
                                    break
                            j += 1
                        carried[j] = w
                        if r[:1] == "m":
                            # the part that differs from the right word holds the wrong character
                            right = r[1:]
                            low = head.lower()
                            if not right.startswith(low):
                                kinds.add("misread")
                            if not right.endswith(w.strip(EDGES).lower()):
                                out.append((j, "misread"))
                        break
            else:
                if end and head[-1:].isalpha():
                    kinds.add("split" if len(head) > 1 else "compound")
        for w in words[1 if k in carried else 0 : last] if suspects else ():
            if w in suspects:
                kind = found[w][0]
                if kind == "m":
                    kinds.add("misread")
                elif kind == "o":
                    kinds.add("odd")
        out.extend((k, x) for x in kinds)
    return out


#: line: the text of a line that may run, or a window; at, here: its first word, and how many of its words are on the line.
RAW = "origin string, book_id long, unit_id int, line_no int, kind string, line string, at int, here int"


def raw_noise(units: DataFrame, table_of_readings: DataFrame, limit: int | None = None) -> DataFrame:
    """units: origin, book_id, unit_id, text."""

    def wanted(c, i):
        t = c["text"][i] or ""
        lines = t.split("\n")
        out = set(t.split())
        for k in range(len(lines)):
            if (b := _break(lines, k)) is not None:
                out.update(b[0] + SEP + w.rstrip(EDGES) for w in b[1])
        return out

    def decide(c, i, found):
        t = c["text"][i]
        if not t:
            return []
        head = (c["origin"][i], c["book_id"][i], c["unit_id"][i])
        lines = t.split("\n")
        out = [(*head, k, kind, lines[k] if kind == "line" else None, None, None) for k, kind in noisy_lines(t, found)]
        rare = {w for w in set(t.split()) if found.get(w, "") == "f"}
        if rare:
            out.extend((*head, k, "window", window, at, n) for k, at, n, window in windows_of(lines, rare))
        return out

    return with_lookup(units, table_of_readings, wanted, decide, RAW, limit)


def read_windows(raw: DataFrame, lexicon: DataFrame, limit: int | None = None) -> DataFrame:
    """origin, book_id, unit_id, line_no, at, here, key, value of every window that isn't read as it is printed. Windows
    hold a rare token, so none of them is a hot key."""
    windows = raw.where("kind = 'window'").select("origin", "book_id", "unit_id", "line_no", "at", "here", F.col("line").alias("key"))
    return windows.join(window_readings(windows, lexicon, limit), "key")


def units_of(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    pages, chapters = spread(pages), spread(chapters)
    return pages.select(F.lit("pages").alias("origin"), "book_id", F.col("page_idx").cast("int").alias("unit_id"), "text").unionByName(
        chapters.select(F.lit("chapters").alias("origin"), "book_id", F.col("chapter_id").cast("int").alias("unit_id"), "text")
    )


def find_noise(pages: DataFrame, chapters: DataFrame, limit: int | None = None) -> DataFrame:
    """origin, book_id, unit_id, line_no, kind of each noisy line."""
    units = units_of(pages, chapters)
    read, lexicon = readings(units.select("text"), limit)
    raw = cut(raw_noise(units, read, limit))
    return noise_of(pages, chapters, raw, cut(read_windows(raw, lexicon, limit)))


def noise_of(pages: DataFrame, chapters: DataFrame, raw: DataFrame, windows: DataFrame) -> DataFrame:
    """The same of raw noise and windows already read."""
    over = F.col("here") < F.size(F.split("key", " "))  # goes on in the next line
    joined = F.size(F.split("value", " ")) < F.size(F.split("key", " "))
    more = windows.select("origin", "book_id", "unit_id", "line_no", F.when(F.substring("value", 1, 1) == "x", "misread").when(over & joined, "split").alias("kind"))
    raw = raw.where("kind <> 'window'").drop("at", "here").unionByName(more.where("kind is not null").withColumn("line", F.lit(None).cast("string")))
    scanned_pages = raw.where("origin = 'pages' and kind in ('split', 'misread')").select("book_id", F.col("unit_id").alias("page_idx")).distinct()
    running = cut(running_lines(pages, scanned_pages))
    on_pages = running.select(F.lit("pages").alias("origin"), "book_id", F.col("page_idx").alias("unit_id"), "line_no")
    spans = chapters.select("book_id", F.col("chapter_id").cast("int").alias("unit_id"), "start_page", "end_page").distinct()
    # a running line of a page is one in the chapters that hold the page
    maybe = raw.where("kind = 'line' and origin = 'chapters'").select("book_id", "unit_id", "line_no", "line").distinct()
    in_chapters = (
        maybe.join(spans, ["book_id", "unit_id"])
        .join(running.select("book_id", "line", "page_idx").distinct(), ["book_id", "line"])
        .where("page_idx >= coalesce(start_page, 0) and page_idx <= coalesce(end_page, 2147483647)")
        .select(F.lit("chapters").alias("origin"), "book_id", "unit_id", "line_no")
    )
    run = on_pages.unionByName(in_chapters).distinct()
    key = ["origin", "book_id", "unit_id", "line_no"]
    other = raw.where("kind <> 'line'").select(*key, "kind").distinct().join(run, key, "left_anti")
    scanned = other.where("kind in ('split', 'misread')").select(*key[:3]).unionByName(run.select(*key[:3])).distinct()
    sure = other.where("kind in ('split', 'misread')")
    weak = other.where("kind in ('compound', 'odd')").join(scanned, key[:3], "left_semi").withColumn("kind", F.when(F.col("kind") == "compound", "split").otherwise("misread"))
    return run.withColumn("kind", F.lit("running")).unionByName(sure.unionByName(weak).distinct())


# ---- repaired text -----------------------------------------------------------------------------------------------------

#: Costs of joining over, and of breaking at, the border of two lines; a paragraph's own cost.
JOIN_BLANK, JOIN_INDENT, JOIN_SHORT, BREAK_WORD, BREAK_SENTENCE, BREAK_SMALL, PARAGRAPH = 4.0, 3.0, 1.5, 8.0, 3.0, 4.0, 1.0


def with_windows(lines: list[str], windows: list[tuple[int, int, str, str]]) -> list[str]:
    """Lines with their windows, (line, place of the first word, window, reading), replaced."""
    changed: dict[int, list[str]] = {}
    for k, at, window, read in sorted(windows, key=lambda w: (w[0], w[1], -len(w[2])), reverse=True):
        n = len(window.split(" "))
        while n and k < len(lines):  # from the line it begins on to the next
            words = changed.setdefault(k, lines[k].split())
            old = words[at : at + n]
            if [core(w) for w in old] != window.split(" ")[: len(old)]:
                break  # a longer window has been read there
            if len(old) == n or read:
                new = read.split(" ") if read else []
                if new and old:
                    first, last = old[0], old[-1]
                    lead, tail = first[: len(first) - len(first.lstrip(EDGES))], last[len(last.rstrip(EDGES)) :]
                    if first.lstrip(EDGES)[:1].isupper():
                        new[0] = new[0].upper() if first.isupper() and len(first) > 1 else new[0][:1].upper() + new[0][1:]
                    new[0] = lead + new[0]
                    if len(old) == n:
                        new[-1] += tail
                words[at : at + n] = new
            window, read, n, at, k = " ".join(window.split(" ")[len(old) :]), "", n - len(old), 0, k + 1
    return [" ".join(changed[k]) if k in changed else x for k, x in enumerate(lines)]


def repaired(text: str, running: set[int], found, windows: list[tuple[int, int, str, str]] = ()) -> list[str]:
    """The paragraphs of a text without running lines, with broken words joined and misread ones read."""
    lines = text.split("\n")
    if windows:
        lines = with_windows(lines, windows)
    kept: list[tuple[str, bool, bool]] = []  # line, blank line before it, page edge before it
    blank = edge = False
    for k, line in enumerate(lines):
        if k in running:
            edge = True
        elif not line.strip():
            blank = True
        else:
            kept.append((line, blank and not edge, edge))
            blank = edge = False
    if not kept:
        return []
    # words over line ends: (line, joined word or None)
    texts, broken = [], [False] * len(kept)
    carry = ""
    full = max(len(x.rstrip()) for x, _, _ in kept)
    for i, (line, _, _) in enumerate(kept):
        words = [w if carry and at == 0 else _read(w, found) for at, w in enumerate(line.split())]
        if carry and words:
            words[0] = carry + words[0]
            carry = ""
        if i + 1 < len(kept) and words and words[-1][-1] in HYPHENS and (m := BROKEN.search(line)):
            head = m.group(1).split()[-1]
            nxt = FIRST_WORD.match(kept[i + 1][0]).group(1)
            r = found.get(head.lstrip(EDGES) + SEP + nxt.rstrip(EDGES), "")
            if r:
                words.pop()
                broken[i] = r != "n"
                if r == "n":
                    words.append(head + "-")
                elif r[0] == "m":
                    right = r[1:]
                    carry = (right[:1].upper() if head[:1].isupper() else right[:1]) + right[1:]
                    kept[i + 1] = (re.sub(r"^\s*[^\s]*[^\s\W]", "", kept[i + 1][0]) or " ", *kept[i + 1][1:])
                    lead = head[: len(head) - len(head.lstrip(EDGES))]
                    carry = lead + carry
                    if not kept[i + 1][0].strip():
                        words.append(carry)
                        carry = ""
                else:
                    carry = head + ("-" if r == "h" else "")
        texts.append(" ".join(words))

    def border(i: int) -> tuple[float, float]:
        """(cost of joining, cost of breaking) between lines i - 1 and i."""
        above, (line, gap, page) = kept[i - 1][0].rstrip(), kept[i]
        ends = above[-1:] in ".!?:\"”»)"
        small = line.lstrip()[:1].islower()
        join = (JOIN_BLANK if gap else 0) + (JOIN_INDENT if line[:2].isspace() and not kept[i - 1][0][:2].isspace() else 0)
        join += JOIN_SHORT if ends and len(above) < 0.75 * full else 0
        join += JOIN_BLANK if HEADING.match(line) or HEADING.match(above) and title_like(above) else 0
        cut = (BREAK_WORD if broken[i - 1] else 0) + (0 if ends else BREAK_SENTENCE) + (BREAK_SMALL if small else 0)
        if title_like(above) and HEADING.match(above):
            cut = 0.0
        return join, cut

    n = len(kept)
    costs = [(0.0, 0.0), *(border(i) for i in range(1, n))]
    # joining costs add up, so the best start of a paragraph that ends at j is a running minimum: linear, without a bound
    best, back, joined = [0.0] * (n + 1), [0] * (n + 1), 0.0
    least, start = float("inf"), 0
    for j in range(1, n + 1):
        joined += costs[j - 1][0]
        here = best[j - 1] + costs[j - 1][1] - joined
        if here <= least:
            least, start = here, j - 1
        best[j], back[j] = least + joined + PARAGRAPH, start
    cuts, j = [], n
    while j:
        cuts.append((back[j], j))
        j = back[j]
    return [" ".join(x for x in texts[i:j] if x) for i, j in reversed(cuts)]


def _read(token: str, found: dict) -> str:
    r = found.get(token)
    if not r or r[0] not in "ms":
        return token
    kept = token.lower().strip("".join(c for c in EDGES if c not in DOUBTFUL))
    for w in (kept, core(token)):
        at = token.lower().find(w)
        if at >= 0 and len(token.lower()) == len(token):
            right = r[1:]
            if token[at : at + 1].isupper():
                right = right.upper() if len(w) > 1 and w.upper() == token[at : at + len(w)] else right[:1].upper() + right[1:]
            if w == kept or any(v == r[1:] for v, _ in variants(w)) or r[0] == "s":
                return token[:at] + right + token[at + len(w) :]
    return token


def paragraphs(pages: DataFrame, chapters: DataFrame, limit: int | None = None) -> DataFrame:
    """origin, book_id, unit_id, par_no, text of every page and chapter that has text."""
    units = units_of(pages, chapters)
    read, lexicon = readings(units.select("text"), limit)
    raw = cut(raw_noise(units, read, limit))
    windows = cut(read_windows(raw, lexicon, limit))
    key = ["origin", "book_id", "unit_id"]
    running = noise_of(pages, chapters, raw, windows).where("kind = 'running'").groupBy(*key).agg(F.collect_list("line_no").alias("running"))
    replaced = windows.groupBy(*key).agg(F.collect_set(F.struct("line_no", "at", F.col("key").alias("window"), F.expr("substring(value, 2)").alias("read"))).alias("windows"))
    whole = units.where("text is not null").dropDuplicates(key).join(running, key, "left").join(replaced, key, "left")

    def wanted(c, i):
        lines = c["text"][i].split("\n")
        gone = set(c["running"][i] or ())
        kept = [x for k, x in enumerate(lines) if x.strip() and k not in gone]
        out = set(c["text"][i].split())
        for a, b in zip(kept, kept[1:]):
            if (m := BROKEN.search(a)) is not None:
                out.add(m.group(1).split()[-1].lstrip(EDGES) + SEP + FIRST_WORD.match(b).group(1).rstrip(EDGES))
        return out

    def decide(c, i, found):
        windows = [(w["line_no"], w["at"], w["window"], w["read"]) for w in c["windows"][i] or ()]
        parts = repaired(c["text"][i], set(c["running"][i] or ()), found, windows)
        return [(c["origin"][i], c["book_id"][i], c["unit_id"][i], k, p) for k, p in enumerate(parts)]

    return with_lookup(whole, read, wanted, decide, "origin string, book_id long, unit_id int, par_no int, text string", limit)


def p1_found(spark, sf_dir: str) -> DataFrame:
    """The noisy lines of pages and chapters."""
    return find_noise(table(spark, sf_dir, "pages"), table(spark, sf_dir, "chapters"))


def p1_paragraphs(spark, sf_dir: str) -> DataFrame:
    """The repaired paragraphs of pages and chapters."""
    return paragraphs(table(spark, sf_dir, "pages"), table(spark, sf_dir, "chapters"))
