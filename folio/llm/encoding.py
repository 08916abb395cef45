"""Problem 8: text that was decoded with the wrong character encoding.

Adjacent characters of which at least one isn't ASCII are scored by their mutual information in the corpus, shrunk
towards 0 where it rests on few texts. A pair of low information is improbable; so is a mark of replacement in a word. The
maximal segments of improbable pairs are isolated, and the inverse mappings are tested inside them: the bytes that a
wrong encoding would have made these characters of, read as UTF-8 (again, while that works, as text can be garbled
twice), or read as another one-byte encoding if this makes nearly all improbable pairs probable. What no mapping brings
back, because characters were replaced, is told by the replacement marks in a segment.

Garbled text may be so frequent that its pairs look normal. Therefore a second score is taken beside the information: the
log ratio of how often the pair occurs that a one-byte mapping makes of this one, to how often this one does. Where a
mapping makes the pairs of lines far more frequent, these are segments too (of the positive ratios of that mapping). A
segment is taken with whole words, and extended over what follows while the mapping explains it too; the rest of the line
stays. The statistics are over distinct texts and leave out runs that read whole as UTF-8 under a wrong encoding, and
lines whose words have forms that no script has until a one-byte mapping gives them regular ones. (The second score and
this trimming are our additions to the method.) A short garbled run alone in quotation marks is quoted, not garbled.

Results: null and empty texts are never affected; a document is found once; text that isn't affected comes back as it is.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import Found, map_rows, with_lookup
from folio.session import spread, table

#: Encodings that UTF-8 is taken for, and pairs (taken for, really) of one-byte encodings: fixed lists of codec names.
WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "cp850", "cp437", "mac_roman", "cp852", "cp866", "koi8_r", "iso8859_2", "iso8859_15", "cp1254", "mac_cyrillic", "iso8859_5")
ONE_BYTE = tuple(
    (w, r)
    for w, rs in {
        "cp1252": ("cp850", "cp852", "cp437", "mac_roman", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866"),
        "latin-1": ("cp850", "cp852", "cp437", "mac_roman", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866"),
        "cp1251": ("koi8_r", "cp866", "mac_cyrillic", "iso8859_5", "cp1252", "cp1250"),
        "cp1250": ("cp852", "cp1252", "cp1251", "iso8859_2"),
        "koi8_r": ("cp1251", "cp866", "mac_cyrillic"),
        "cp866": ("cp1251", "koi8_r"),
        "cp850": ("cp1252",),
        "cp437": ("cp1252",),
        "cp852": ("cp1250",),
        "mac_roman": ("cp1252",),
        "iso8859_2": ("cp1252", "cp1250"),
    }.items()
    for r in rs
)
RUN = re.compile(r"[^\x00-\x7f]+")
REPLACED = "�"
#: Marks in place of characters that were lost, and all runs whose pairs are scored.
LOST = re.compile(rf"{REPLACED}+|(?<=[^\W\d_])\?(?=[^\W\d_A-Z])")
MARKS = re.compile(r"[^\x00-\x7f]+|(?<=[^\W\d_])\?(?=[^\W\d_A-Z])")
#: Share of texts at which a pair's information counts half; information below which a pair is improbable.
HALF, IMPROBABLE = 0.004, 0.25
#: What an ASCII pair takes from a segment.
GAP = 0.02
#: One-byte mappings: least improbable share before, most of it that may be left, least pairs.
GAIN, LEFT_OVER, PAIRS = 0.15, 0.3, 3
#: Log ratios of frequencies: what is added to each count, the most a pair tells, the least sum and the least mean over the
#: changed pairs from which a mapping explains lines, and the fall at which a segment isn't extended further.
SMOOTH, MOST, LEAST_GAIN, MEAN_GAIN, DROP = 0.5, 6.0, 6.0, 0.5, 4.0
#: A line whose mappings can't reach such a sum is left aside.
LEAST_LINE = 4.0
#: Share of what segments touch that must read as UTF-8 before other mappings are left aside.
EXPLAINED = 0.34
QUOTED = 8
OPENING, CLOSING = "\"'“„‘‚«‹`(", "\"'”“’‘»›`)"
NEVER = "\x00"


@lru_cache(maxsize=64)
def _bytes_of(codec: str) -> dict[int, int]:
    """Character -> byte for the upper half; bytes the codec doesn't know pass as control characters."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            out[b] = b
    if codec in ("cp1252", "cp1250", "cp1251"):
        for b in range(0x80, 0xA0):
            out.setdefault(b, b)
    return out


def _raw(text: str, codec: str) -> bytes | None:
    known, out = _bytes_of(codec), bytearray()
    for ch in text:
        o = ord(ch)
        if o < 0x80:
            out.append(o)
        elif (b := known.get(o)) is not None:
            out.append(b)
        else:
            return None
    return bytes(out)


#: Ranges of characters that text is made of (fixed values): Latin, combining marks, Greek, Cyrillic, Hebrew, Arabic, Indic
#: and Thai, joiners and punctuation, currency, letter-like signs, arrows, CJK, Hangul, emoji. Phonetic letters, which
#: capitals with a quotation mark behind them would read as, are left out.
TEXT_RANGES = (
    (0xA0, 0x17F), (0x218, 0x21B), (0x300, 0x36F), (0x384, 0x3CE), (0x401, 0x45F), (0x490, 0x491), (0x5D0, 0x5EA), (0x600, 0x6FF), (0x900, 0xE7F),
    (0x200B, 0x2044), (0x20A0, 0x20BF), (0x2116, 0x2122), (0x2150, 0x2200), (0x2600, 0x27BF), (0x3000, 0x9FFF), (0xAC00, 0xD7A3), (0xFB00, 0xFB06), (0xFE0F, 0xFE0F), (0x1F000, 0x1FAFF),
)


def _plausible(ch: str) -> bool:
    """Whether a character is one of text."""
    o = ord(ch)
    return any(a <= o <= b for a, b in TEXT_RANGES)


@lru_cache(maxsize=200_000)
def utf8_behind(run: str) -> str | None:
    """What a run of characters that aren't ASCII reads as, if its bytes under a wrong encoding are whole UTF-8."""
    if len(run) < 2:
        return None
    for codec in WRONG:
        raw = _raw(run, codec)
        if raw is None:
            continue
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        again = utf8_behind(text)
        if again is not None:
            return again
        if all(map(_plausible, text)):
            return text
        # garbled more than once: some of the runs inside may still be whole
        inner = RUN.sub(lambda m: utf8_behind(m.group()) or m.group(), text)
        if all(_plausible(c) for c in inner):
            return inner
    return None


def _quoted(text: str, start: int, end: int) -> bool:
    return end - start <= QUOTED and 0 < start and end < len(text) and text[start - 1] in OPENING and text[end] in CLOSING


#: Forms that words of no script have: a sign between letters, signs in a row, a capital behind a small letter, three letters of Latin
#: beyond ASCII and more in a row, Cyrillic beside Latin, control characters.
_LETTER, _SMALL, _GREAT = r"[^\W\d_]", "[a-zß-öø-ÿа-яё-џ]", "[À-ÖØ-ÞА-ЯЀ-Џ]"
IRREGULAR = re.compile(
    rf"(?<={_LETTER})[¡-©«-´¶-¹»-¿×÷‚„†‡‰‹›€™\u2200-\u22ff\u2320-\u25ff]+(?={_LETTER})|[¡-ª¬-¹¼-¿]{{2,}}|(?<={_SMALL}){_GREAT}+|(?:[À-ÖØ-öø-ƒªºµ]){{3,}}|(?<=[а-яёА-ЯЁ])[À-ÖØ-öø-ƒ]+|(?<=[a-zA-ZÀ-ÖØ-öø-ƒ])[а-яёА-ЯЁ]+|[\x80-\x84\x86-\x9f\u2500-\u259f]+"
)
#: A word with small and great letters exchanged, and what this makes great.
INVERTED, GREAT = re.compile(r"(?<![^\W\d_])[а-яё] ?[А-ЯЀ-Џ]{2,}(?![^\W\d_])"), re.compile("[А-ЯЀ-Џ]")


def _irregular(line: str) -> int:
    """Characters of a line in forms that words don't have."""
    n = sum(m.end() - m.start() for m in IRREGULAR.finditer(line))
    return max(n, len(GREAT.findall(line))) if INVERTED.search(line) else n


@lru_cache(maxsize=20_000)
def garbled_form(line: str) -> bool:
    """Whether the words of a line are irregular, and a one-byte mapping makes nearly all of them regular."""
    n = sum(map(len, RUN.findall(line)))
    if n < PAIRS:
        return False
    bad = _irregular(line)
    if bad < GAIN * n:
        return False
    for wrong, right in ONE_BYTE:
        raw = _raw(line, wrong)
        if raw is None:
            continue
        try:
            other = raw.decode(right)
        except UnicodeDecodeError:
            continue
        if _irregular(other) <= LEFT_OVER * bad and all(c < "\x80" or _plausible(c) for c in other):
            return True
    return False


def _counts(batches):
    count: Counter[str] = Counter()
    for c in batches:
        for t in c["text"]:
            if not t:
                continue
            count[NEVER] += 1
            if t.isascii():
                count.update(set(t))
                continue
            seen: set[str] = {"\n"} if "\n" in t else set()
            for line in t.split("\n"):
                if line.isascii():
                    seen.update(line)
                    continue
                runs = RUN.findall(line)
                whole = any(len(r) > 1 and utf8_behind(r) is not None for r in runs)
                if not whole:
                    if not garbled_form(line):
                        seen.update(line)
                        seen.update(_pairs(line))
                    continue
                kept = RUN.sub(lambda m: m.group() if utf8_behind(m.group()) is None else NEVER, line)
                if kept.isascii() or not garbled_form(kept.replace(NEVER, "")):
                    seen.update(line)
                    for m in RUN.finditer(line):
                        if utf8_behind(m.group()) is None:
                            seen.update(_pairs(line[max(0, m.start() - 1) : m.end() + 1]))
            count.update(seen)
        if len(count) > 300_000:
            yield list(count.items())
            count = Counter()
    yield list(count.items())


def pair_counts(texts: DataFrame) -> DataFrame:
    """key, value: number of distinct texts with each character and each adjacent pair that isn't ASCII."""
    return map_rows(texts.select("text").distinct(), _counts, "key string, n long").groupBy("key").agg(F.sum("n").alias("value"))


class PairScores:
    def __init__(self, found: Found | dict):
        self.found, self.n = found, max(1, found.get(NEVER, 1))
        self.memo: dict[str, float] = {}
        self.deltas: dict[str, np.ndarray] = {}
        self.peaks: dict[str, float] = {}
        self.good: set[str] = set()

    def information(self, pair: str) -> float:
        """Mutual information of a pair, shrunk by the texts it rests on. No print holds a mark of replacement in a word."""
        known = self.memo.get(pair)
        if known is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            both = self.found.get(pair, 0)
            if both and REPLACED not in pair:
                each = max(1, self.found.get(pair[0], 1)) * max(1, self.found.get(pair[1], 1))
                known = math.log(both * self.n / each) * both / (both + HALF * self.n)
                if pair[0] < "\x80" or pair[1] < "\x80":
                    # a character that is in all texts tells nothing of its neighbours, but its frequency does
                    known = max(known, math.log(1 + both / (HALF * self.n)) / 2)
            else:
                known = -1.0
            self.memo[pair] = known
        return known

    def improbable(self, pair: str) -> bool:
        return self.information(pair) < IMPROBABLE

    def delta(self, pair: str) -> np.ndarray:
        """Per one-byte mapping how much more frequent (log ratio) the pair is that it makes of this one."""
        known = self.deltas.get(pair)
        if known is None:
            if len(self.deltas) > 100_000:
                self.deltas.clear()
            here = self.found.get(pair, 0) + SMOOTH
            out = []
            for known_map in _maps():
                other = pair.translate(known_map)
                gain = 0.0 if other == pair else -MOST if NEVER in other else math.log((self.found.get(other, 0) + SMOOTH) / here)
                out.append(max(-MOST, min(MOST, gain)))
            known = self.deltas[pair] = np.array(out)
        return known

    def gains(self, line: str) -> tuple[np.ndarray, np.ndarray]:
        """Per one-byte mapping the sum of a line's deltas, and how many of its pairs it changes."""
        every = np.array([self.delta(p) for p in _pairs(line)])
        return (every.sum(0), np.count_nonzero(every, 0)) if len(every) else (_NONE, _NONE)

    def normal(self, line: str) -> tuple[bool, bool]:
        """Whether no pair of a line is improbable, and whether no mapping could make its pairs more frequent: a bound on its
        sum of deltas. Pairs known to be both are left out first."""
        pairs = _pairs(line)
        other = set(pairs) - self.good
        if not other:
            return True, True
        probable, total = True, 0.0
        for pair in other:
            peak = self.peaks.get(pair)
            if peak is None:
                if len(self.peaks) > 500_000:
                    self.peaks.clear()
                    self.good.clear()
                peak = self.peaks[pair] = max(0.0, float(self.delta(pair).max()))
            improbable = self.information(pair) < IMPROBABLE
            if not improbable and peak == 0:
                self.good.add(pair)
            probable = probable and not improbable
            if peak:
                total += peak * pairs.count(pair)
        return probable, total < LEAST_LINE

    def segments(self, line: str, mapping: int | None = None) -> list[tuple[int, int]]:
        """Maximal segments, as character ranges of a line: of improbable pairs, or of pairs that a mapping makes more
        frequent."""
        out: list[tuple[int, int]] = []
        total = best = 0.0
        start = stop = last = -1
        for m in MARKS.finditer(line):
            s, e = m.span()
            lost = m.group() == "?"
            if total > 0:
                total -= GAP * max(0, s - 1 - last)
                if total <= 0:
                    out.append((start, stop))
                    total = best = 0.0
            for i in range(max(0, s - 1), min(e, len(line) - 1)):
                pair = line[i : i + 2]
                score = IMPROBABLE + 1 if lost and mapping is None else IMPROBABLE - self.information(pair) if mapping is None else self.delta(pair)[mapping]
                if total <= 0:
                    if score <= 0:
                        continue
                    start, total, best = i, 0.0, 0.0
                total += score
                if total >= best:
                    best, stop = total, i + 2
                elif total <= 0:
                    out.append((start, stop))
                    best = 0.0
            last = e
        if total > 0:
            out.append((start, stop))
        return out

    def shares(self, text: str) -> tuple[int, int]:
        """(improbable, all) pairs of a text that aren't ASCII."""
        bad = n = 0
        for pair in _pairs(text):
            n += 1
            bad += self.improbable(pair)
        return bad, n


#: The adjacent pairs of a line of which at least one isn't ASCII.
_pairs = re.compile(r"(?=([^\x00-\x7f][\s\S]|[\x00-\x7f][^\x00-\x7f]))").findall


@lru_cache(maxsize=1)
def _maps() -> tuple[dict[int, str], ...]:
    """Per one-byte mapping what it makes of each character that isn't ASCII; NEVER if nothing."""
    out = []
    for wrong, right in ONE_BYTE:
        known = defaultdict(lambda: NEVER, {o: chr(o) for o in range(0x80)})
        for o, b in _bytes_of(wrong).items():
            try:
                known[o] = bytes([b]).decode(right)
            except UnicodeDecodeError:
                pass
        out.append(known)
    return tuple(out)


_NONE = np.zeros(len(ONE_BYTE))


def _utf8(line: str, parts: list[tuple[int, int]]) -> tuple[str, bool]:
    """A line with the runs that its segments touch, and from there on the runs next to them, read as UTF-8 where a wrong
    decoding of whole UTF-8 explains them; and whether it explains a good part of what the segments touch, as single runs
    of one-byte garbage can read as UTF-8 by chance."""
    runs = list(RUN.finditer(line))
    reads = [None if _quoted(line, *m.span()) else utf8_behind(m.group()) for m in runs]
    hit = [r is not None and any(a < m.end() and m.start() < b for a, b in parts) for m, r in zip(runs, reads)]
    if not any(hit):
        return line, False
    touched = sum(len(m.group()) for m in runs if any(a < m.end() and m.start() < b for a, b in parts))
    good = sum(len(m.group()) for m, h in zip(runs, hit) if h) >= EXPLAINED * touched
    for order in (range(1, len(runs)), range(len(runs) - 2, -1, -1)):
        step = 1 if order.step > 0 else -1
        for i in order:
            hit[i] = hit[i] or (hit[i - step] and reads[i] is not None)
    out, at = [], 0
    for m, r, h in zip(runs, reads, hit):
        if h:
            out += [line[at : m.start()], r]
            at = m.end()
    return "".join(out) + line[at:], good


def _mapping(lines: list[str], scores: PairScores) -> int | None:
    """The one-byte mapping that explains the improbable or replaceable pairs of these lines."""
    totals = [scores.gains(x) for x in lines]
    gain, changed = sum(t for t, _ in totals), sum(n for _, n in totals)
    best = int(gain.argmax())
    if changed[best] >= PAIRS and gain[best] >= LEAST_GAIN and gain[best] >= MEAN_GAIN * changed[best]:
        return best
    bad, n = map(sum, zip(*map(scores.shares, lines)))
    if n < PAIRS or bad < GAIN * n:
        return None
    found, least = None, LEFT_OVER * bad / n
    for k, known in enumerate(_maps()):
        left = m = 0
        for x in lines:
            other = x.translate(known)
            if NEVER in other:
                break
            b, c = scores.shares(other)
            left, m = left + b, m + c
        else:
            if m and left / m <= least:
                found, least = k, left / m - 1e-9
    return found


def _mapped(line: str, mapping: int, parts: list[tuple[int, int]], scores: PairScores) -> str:
    """A line with its segments mapped: those of improbable pairs and those the mapping makes more frequent, with whole
    words, and on from there while what follows is explained as well (up to the best point before it is markedly not)."""
    known = _maps()[mapping]
    words = [m.span() for m in re.finditer(r"[^ \t]+", line)]
    gain = [sum(float(scores.delta(p)[mapping]) for p in _pairs(line[max(0, a - 1) : b + 1])) for a, b in words]
    parts = [*parts, *scores.segments(line, mapping)]
    inside = [any(a < e and s < b for s, e in parts) for a, b in words]
    grown = list(inside)
    for order in (range(len(words)), range(len(words) - 1, -1, -1)):
        step, total, best, pending = 1 if order.step > 0 else -1, 0.0, 0.0, []
        live = False
        for i in order:
            if inside[i]:
                live, total, best, pending = True, 0.0, 0.0, []
                continue
            if not live:
                continue
            total += gain[i]
            pending.append(i)
            if total >= best:
                best = total
                for j in pending:
                    grown[j] = True
                pending = []
            elif total < best - DROP:
                live = False
    out, at = [], 0
    for (a, b), g in zip(words, grown):
        if g:
            other = line[a:b].translate(known)
            if NEVER not in other:
                out += [line[at:a], other]
                at = b
    return "".join(out) + line[at:]


def restore(text: str, scores: PairScores) -> tuple[bool, str, bool]:
    """(affected, restored text, whether nothing is left that couldn't be restored)."""
    found, lines, suspects = False, text.split("\n"), []
    lost = False
    for k, line in enumerate(lines):
        if line.isascii() and "?" not in line:
            continue
        probable, kept = scores.normal(line)
        if probable and kept and "?" not in line:
            continue
        parts = scores.segments(line)
        better, good = _utf8(line, parts) if parts else (line, False)
        if good:
            found, lines[k] = True, better
            parts = scores.segments(better)
        elif not line.isascii() and (parts or not kept):
            suspects.append((k, parts, better))
        lost = lost or _lost(lines[k], parts)
    if suspects:
        every = _mapping([lines[k] for k, _, _ in suspects], scores)
        for k, parts, better in suspects:
            m = every if every is not None else _mapping([lines[k]], scores) if len(suspects) > 1 else None
            if m is not None and (mapped := _mapped(lines[k], m, parts, scores)) != lines[k]:
                better = mapped
            if better != lines[k]:
                found, lines[k] = True, better
    return found or lost, "\n".join(lines), not lost


def _lost(line: str, parts: list[tuple[int, int]]) -> bool:
    """Whether a segment holds a mark that replaced characters of a word."""
    for m in LOST.finditer(line):
        if not any(a < m.end() and m.start() < b for a, b in parts):
            continue
        if m.group()[0] == REPLACED:
            if not _quoted(line, *m.span()):
                return True
            continue
        a, b = line.rfind(" ", 0, m.start()) + 1, line.find(" ", m.end())
        if not any(x in line[a : b if b >= 0 else len(line)] for x in ("/", "=", "&", "@")):
            return True
    return False


def restore_all(documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int | None = None) -> DataFrame:
    """key, affected, restored, whole of every document that is affected."""
    kind = documents.schema[key].dataType.simpleString()

    def pairs(t):
        out = {NEVER, *t}
        for pair in set(_pairs(t)):
            out.add(pair)
            for known in _maps():
                other = pair.translate(known)
                if NEVER not in other:
                    out.update((other, *other))
        for m in RUN.finditer(t):
            if (better := utf8_behind(m.group())) is not None:  # and their pairs with what stands beside them
                part = t[max(0, m.start() - 1) : m.start()] + better + t[m.end() : m.end() + 1]
                out.update((*part, *map("".join, zip(part, part[1:]))))
        return out

    def wanted(c, i):
        t = c["text"][i]
        return pairs(t) if t and not t.isascii() else ()

    def decide(c, i, scores):
        t = c["text"][i]
        if not t or (t.isascii() and "?" not in t):
            return []
        affected, restored, whole = restore(t, scores)
        return [(c[key][i], restored, whole)] if affected else []

    more = {} if limit is None else {"limit": limit}
    rows = spread(documents.select(key, F.col(text).alias("text")))
    return with_lookup(rows, pair_counts(rows), wanted, decide, f"`{key}` {kind}, restored string, whole boolean", state=PairScores, always=[NEVER], **more)


def p8_found(spark, sf_dir: str) -> DataFrame:
    """The documents of which any part was decoded wrongly."""
    return restore_all(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p8_restored(spark, sf_dir: str) -> DataFrame:
    """These documents with their text as far as it can be restored, and whether all of it could be."""
    return restore_all(table(spark, sf_dir, "documents"))
