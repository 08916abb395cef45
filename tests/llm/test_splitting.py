"""Pieces keep within the limit, overlap as asked, lose nothing and are cut at the strongest boundaries."""

import random
import re

import pytest

from folio.llm import splitting as S


def check(text, limit, overlap):
    got = S.pieces(text, limit, overlap)
    assert got[0][:2] == (0, 0) and got[-1][2] == len(text)
    for (_, _, e), (o, s, _) in zip(got, got[1:]):
        assert s == e and o == max(0, s - overlap)
    for k, (o, s, e) in enumerate(got):
        assert len(text[o:e].encode()) <= limit and e > s
        if k:
            before = text[got[k - 1][0] : got[k - 1][2]]
            assert text[o:e].startswith(before[-overlap:] if overlap else "")
    assert "".join(text[s:e] for _, s, e in got) == text
    return got


def test_random():
    rnd = random.Random(1)
    for _ in range(150):
        text = "".join(rnd.choice(["word ", "longerword ", "é", "漢字", ". ", "\n", "\n\n", "x" * 70, "🙂"]) for _ in range(rnd.randint(1, 300)))
        if len(text.encode()) > 200:
            check(text, 200, 16)


def words(text, limit, overlap, at):
    """Segments of single words, from which merging reaches the same pieces by many more steps."""
    out, a = [], 0
    room = limit - 4 * overlap
    for m in re.finditer(r"\s+|(?<=\S)$", text):
        b = m.end()
        if b <= a:
            continue
        lines = len(re.findall(S.NEW_LINE, m.group()))
        strength = S.PARAGRAPH if lines > 1 else S.LINE if lines else S.SENTENCE if re.search(r"[.!?…。！？][\"'”’»)\]]*$", text[: m.start()]) else S.WORD
        while at[b] - at[a] > room:
            c = a + 1
            while at[c + 1] - at[a] <= room:
                c += 1
            out.append((a, c, S.INSIDE))
            a = c
        out.append((a, b, strength))
        a = b
    return out


def test_same_as_from_words():
    rnd = random.Random(4)
    for _ in range(200):
        text = "".join(rnd.choice(["word ", "two words. ", "é ", "漢字 ", "End!\n", "line\n", "para\n\n", "a " * 9]) for _ in range(rnd.randint(20, 250)))
        if len(text.encode()) > 150:
            at = S._bytes_before(text)
            mine, plain = S.pieces(text, 150, 6), S.merge(words(text, 150, 6, at), 150, 6, at)
            strength = lambda got: [(text[:s][-1:], text[:s][-2:].count("\n")) for _, s, _ in got[1:]]
            assert len(mine) == len(plain) and strength(mine) == strength(plain)


def test_boundaries_in_order():
    paragraph = "One sentence here. " * 5
    text = "\n\n".join([paragraph] * 20)
    got = check(text, 2 * len(paragraph) + 40, 10)
    assert all(text[:s].endswith("\n\n") for _, s, _ in got[1:])
    line = "\n".join(["some words in a line"] * 60)
    assert all(line[s - 1] == "\n" for _, s, _ in check(line, 200, 8)[1:])
    words = "word " * 400
    assert all(words[s - 1] == " " for _, s, _ in check(words, 200, 8)[1:])
    check("x" * 5000, 200, 8)
    check("漢" * 5000, 200, 8)


def test_ties_and_limits():
    assert S.pieces("", 100, 5) == [(0, 0, 0)] and S.pieces("short", 100, 5) == [(0, 0, 5)]
    assert S.pieces("x" * 100, 100, 5) == [(0, 0, 100)]
    with pytest.raises(ValueError):
        S.pieces("x" * 500, 20, 200)


def test_rows(spark):
    long = "Many words. " * 100
    df = spark.createDataFrame([(1, 1, long, "a"), (1, 1, long, "a"), (2, 1, None, "b"), (3, 1, "", "c"), (4, None, long, None)], "book_id long, item_id int, text string, piece_no string")
    got = S.split(df, ["book_id", "item_id"], 300, 10).collect()
    one = [r for r in got if r["book_id"] == 1]
    assert [r["piece_no"] for r in sorted(one, key=lambda r: r["piece_no"])] == list(range(one[0]["n_pieces"]))
    assert {r["book_id"] for r in got} == {1, 3, 4} and all(r["n_bytes"] <= 300 for r in got)
    assert S.split(df.limit(0), ["book_id", "item_id"], 300, 10).count() == 0
