"""Cut, residual, garbled and noisy texts: planted cases, near misses, edge rows, and the joined route beside the broadcast."""

import os

import pyarrow.parquet as pq
import pytest

from folio.llm import encoding, residue, scan_noise, truncation

SENTENCES = [
    "The candid argument of the reader supports the narrow claim of the village.",
    "In the opening pages, the quiet promise hides the obscure example of the author.",
    "Who gains when the plausible appeal of the merchant echoes the stern warning?",
    "The medium severity of the comparison discredits the familiar metaphor!",
]


def body(k, n=6):
    return " ".join(SENTENCES[(k + i * (k % 3 + 1)) % 4] for i in range(n))


# ---- cut texts ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def outputs(spark):
    rows = [(i, f"m{i % 2}", body(i) + ("\n\n- Severity: medium\n- Location: page 12" if i % 5 == 0 else "\n\nScore: 4/5" if i % 5 == 1 else "")) for i in range(120)]
    rows += [(200 + i, "m0", (body(i, 12) + " The comparison of the reader supports the familiar metaphor")[:400]) for i in range(8)]
    rows += [
        (300, "m1", body(1) + " The narrow comp"),
        (301, "m1", body(2) + "\n\n- Severity: medi"),
        (302, "m1", body(2) + "\n\n- Severity: medium\n- Locat"),
        (303, "m1", body(2) + "\n\nScore: 4/"),
        (304, "m1", body(2) + " The argument of the reader is […]"),
        (305, "m1", body(2) + " The argument of the rea�"),
        (306, "m1", body(2) + " See vol."),
        (307, "m1", body(2) + "\n\n| tactic | severity |\n|---|---|\n| claim | me"),
        (400, "m1", body(2) + "\n\n| tactic | severity |\n|---|---|\n| claim | medium |"),
        (401, "m1", body(2) + "\n\n(end of section)"),
        (402, "m1", body(2) + "\n\n**Overall: low**"),
        (403, "m1", None),
        (404, "m1", ""),
        (405, None, "  \n "),
        (406, None, body(3)),
        (407, "m1", "Checking that you are not a robot…"),
        (408, "m1", "Wait. Checking that you are not a robot…"),
        (300, "m1", body(1) + " The narrow comp"),
    ]
    return spark.createDataFrame(rows, "output_id long, model_name string, text string")


CUT = {*range(200, 208), 300, 301, 302, 303, 304, 305, 306, 307}


@pytest.mark.parametrize("limit", [None, 0])
def test_cut(outputs, limit):
    got = [r["output_id"] for r in truncation.find_cut(outputs, limit=limit).collect()]
    assert set(got) == CUT and len(got) == len(set(got))


def test_rates(outputs):
    got = {r["model_name"]: (r["n_outputs"], r["n_cut"]) for r in truncation.cut_rates(outputs).collect()}
    assert got[None] == (1, 0) and sum(n for _, n in got.values()) == len(CUT)
    assert truncation.find_cut(outputs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [None, 0])
def test_frequent_cut(spark, limit):
    """Copies of one cut output, a third of all rows, beside other texts cut in the same clause."""
    tail = " The argument of the reader is […]"
    rows = [(i, f"{body(i)} Remark {i}.\n\n- Severity: medium") for i in range(80)] + [(100 + i, body(1) + tail) for i in range(40)] + [(200 + i, f"Remark {i}. {body(2 + i)}{tail}") for i in range(2)]
    rows += [(300, "Checking that you are not a robot…"), (301, "A clause of the reader. Checking that you are not a robot…")]
    got = {r["output_id"] for r in truncation.find_cut(spark.createDataFrame(rows, "output_id long, text string"), limit=limit).collect()}
    assert got == {*range(100, 140), 200, 201}


@pytest.mark.parametrize("limit", [None, 0])
def test_no_full_stop(spark, limit):
    """Complete texts without a closing mark are told from cut ones by where sentences end in the corpus, however many there are."""
    ends = ("A fine chapter of the village", "It supports the narrow claim of the author", "The chapter hides the familiar metaphor")
    rows = [(i, f"{body(i)} Remark {i} of the village.") for i in range(100)]
    rows += [(200 + i, f"{'Indeed. ' * i}{body(i)} {ends[i % 3]}") for i in range(30)]  # complete
    rows += [(300 + i, f"{'Well then. ' * i}{body(i)} The candid argument of {'the reader supports the'.rsplit(' ', i % 3)[0]}") for i in range(12)]  # cut between words
    rows += [(400, body(1) + " The narrow comp"), (401, body(2) + " A stern warn")]
    got = {r["output_id"] for r in truncation.find_cut(spark.createDataFrame(rows, "output_id long, text string"), limit=limit).collect()}
    assert got == {*range(300, 312), 400, 401}


def test_complete_share():
    assert truncation.complete_share([]) == 0.5
    assert truncation.complete_share([(-6.0, 900), (4.5, 100)]) == pytest.approx(0.1, abs=0.02)
    assert truncation.complete_share([(-6.0, 10_000), (0.0, 40)]) < 0.01


# ---- residue -----------------------------------------------------------------------------------------------------------

RESIDUE = {
    1: "Error 404: the page you asked for could not be found. Please try again later.",
    2: "<html><head><title>502 Bad Gateway</title></head><body><h1>Bad Gateway</h1></body></html>",
    3: "Bitte aktivieren Sie JavaScript, um diesen Inhalt zu sehen.",
    4: "The main tactic is {{author_name}}. " + SENTENCES[0],
    5: SENTENCES[1] + " Section: [Insert title here]. " + SENTENCES[2],
    6: "Lorem ipsum veka tora. Lorem ipsum veka nalu. Ipsum lorem tora veka nalu tora.",
    7: "Lorem ipsum nalu veka tora nalu. Ipsum veka tora lorem nalu ipsum.",
    8: "Blah blah " * 30,
    9: SENTENCES[0] + " Verdict: _____. " + SENTENCES[1],
    10: "Reviewed for (à compléter). " + SENTENCES[0],
}
CONTENT = {
    50: SENTENCES[0] + ' A printed form still shows the label "{{CATEGORY}}" as an example. ' + SENTENCES[1],
    51: SENTENCES[0] + " An error 404 on the poster stands for the lost generation. " + SENTENCES[1] + SENTENCES[2],
    52: SENTENCES[0] + " The set {fear, hope} is closed [sic] and 40 % follow [emphasis added]. " + SENTENCES[3],
    53: "x" * 50_000,
    54: None,
    55: " ",
    56: "",
}


@pytest.mark.parametrize("limit", [None, 0])
def test_residue(spark, limit):
    rows = [*RESIDUE.items(), *CONTENT.items(), *((100 + i, body(i)) for i in range(60)), (1, RESIDUE[1])]
    df = spark.createDataFrame(rows, "output_id long, text string")
    got = [r["output_id"] for r in residue.find_residue(df, limit=limit).collect()]
    assert set(got) ^ set(RESIDUE) == set() and len(got) == len(set(got))
    if limit is None:
        assert residue.without_residue(df).count() == len(rows) - len(RESIDUE) - 1
        assert residue.find_residue(df.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 8])
@pytest.mark.parametrize("others, times", [(5, 1), (60, 30)])
def test_frequent_residue(spark, k, others, times):
    """In a table of a few rows, and as a third of all rows."""
    rows = [(i, RESIDUE[k]) for i in range(times)] + [(1000 + i, body(i)) for i in range(others)]
    got = {r["output_id"] for r in residue.find_residue(spark.createDataFrame(rows, "output_id long, text string")).collect()}
    assert got == set(range(times))


WORDINGS = (
    "Sorry, the page you asked for could not be shown (404). Go back or try again in a few minutes.", "Your session has ended. Sign in again to go on reading.", "Bitte aktivieren Sie JavaScript, um diesen Inhalt zu sehen. Code 7.",
    "Ошибка 503. Страница временно недоступна, попробуйте позже.", '{"error": {"code": 502, "message": "bad gateway", "trace": "9a"}}', "Sample analysis goes here. Replace this paragraph with the final wording. (3)",
    "The tactic of <your chapter here> is plain.", "The tactic of {{" + "a" * 61 + "}} is plain.", "The tactic of " + "_" * 90 + " is plain.", "<noscript>Active JavaScript para continuar.</noscript>",
)


@pytest.mark.parametrize("share", [0.01, 0.06, 0.2, 0.4, 0.8])
@pytest.mark.parametrize("limit", [None, 0])
def test_one_wording_however_frequent(spark, share, limit):
    """Each wording alone beside clean texts, at every share of all texts."""
    clean = [(1000 + i, f"{body(i)} Remark {i} of the {'village town river mill'.split()[i % 4]}.") for i in range(120)]
    for k, wording in enumerate(WORDINGS[:: 1 if limit is None and share == 0.4 else 4]):
        times = max(1, round(120 * share / (1 - share)))
        rows = clean + [(i, wording) for i in range(times)]
        got = {r["output_id"] for r in residue.find_residue(spark.createDataFrame(rows, "output_id long, text string"), limit=limit).collect()}
        assert got == set(range(times)), (k, wording)


# ---- encodings ---------------------------------------------------------------------------------------------------------

CLEAN = {
    "fr": "La thèse répète la première idée du chapitre, où le lecteur hésite déjà à l'été.",
    "de": "Die Überschrift erklärt das größere Bild für die Zuhörer über mehrere Absätze.",
    "ru": "Вывод рассказчика заменяет главное возражение с первых страниц книги.",
    "pl": "Krótko mówiąc, przykład książki łagodzi głos świadków już na początku.",
    "en": "The chapter’s “façade” — a naïve cliché — costs £9 a seat.",
}


def garble(text, wrong, right="utf-8"):
    return "".join(chr(b) if not (c := bytes([b]).decode(wrong, "ignore")) else c for b in text.encode(right))


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, list(CLEAN.values())[i % 5] + " " + list(CLEAN.values())[(i + i // 5) % 5]) for i in range(400)]
    rows += [
        (1000, garble(CLEAN["fr"], "cp1252")),
        (1001, "Title\n" + garble(CLEAN["en"], "latin-1") + "\n" + CLEAN["de"]),
        (1002, garble(garble(CLEAN["de"], "cp1252"), "cp1252")),
        (1003, garble(CLEAN["ru"], "cp1251")),
        (1004, CLEAN["ru"].encode("koi8_r").decode("cp1251")),
        (1005, CLEAN["pl"].encode("cp852").decode("cp1252")),
        (1006, garble(CLEAN["pl"], "cp850")),
        (1007, "Das Beispiel schw�cht das Glied."),
        (2000, "A reader sees “Ã©” where “é” was meant. " + CLEAN["en"]),
        (2001, 'It prints "Ã©" by mistake.'),
        (2002, "MARIA CONCEIÇÃO E JOÃO SÃO Ångström 漢字 مرحبا ±½"),
        (2003, None),
        (2004, ""),
        (2005, "Why? Because."),
        (1000, garble(CLEAN["fr"], "cp1252")),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("limit", [None, 0])
def test_encoding(documents, limit):
    got = {r["doc_id"]: r for r in encoding.restore_all(documents, limit=limit).collect()}
    assert set(got) == set(range(1000, 1008))
    assert got[1000]["restored"] == CLEAN["fr"] and got[1002]["restored"] == CLEAN["de"] and got[1003]["restored"] == CLEAN["ru"]
    assert got[1001]["restored"] == f"Title\n{CLEAN['en']}\n{CLEAN['de']}" and got[1004]["restored"] == CLEAN["ru"]
    assert got[1005]["restored"] == CLEAN["pl"] and got[1006]["restored"] == CLEAN["pl"] and not got[1007]["whole"]
    assert encoding.restore_all(documents.limit(0)).count() == 0


ONE_BYTE = {"latin-1": ("ru", "cp1251"), "cp1251": ("ru", "koi8_r"), "cp1252": ("pl", "cp852")}


@pytest.mark.parametrize("wrong", sorted(ONE_BYTE))
@pytest.mark.parametrize("copies", [True, False])
def test_frequent_one_byte_garbling(spark, wrong, copies):
    """A third of all rows is garbled the same way: copies of one text, or different texts."""
    language, right = ONE_BYTE[wrong]
    clean = list(CLEAN.values())
    rows = [(i, f"{clean[i % 5]} {clean[(i + i // 5) % 5]} {i}") for i in range(200)]
    texts = {1000 + i: CLEAN[language] + ("" if copies else f" {i}") for i in range(100)}
    rows += [(k, t.encode(right).decode(wrong)) for k, t in texts.items()]
    got = {r["doc_id"]: r["restored"] for r in encoding.restore_all(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == texts


DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"
#: language, wrong, right
GARBLINGS = (("ru", "cp1251", "koi8_r"), ("ru", "latin-1", "cp1251"), ("ru", "koi8_r", "cp1251"), ("ru", "cp1250", "cp1251"), ("ru", "cp1252", "cp866"), ("pl", "cp1252", "cp852"), ("pl", "cp1252", "cp1250"), ("fr", "cp1252", "mac_roman"))


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="no test data")
@pytest.mark.parametrize("language, wrong, right", GARBLINGS)
def test_every_one_byte_mapping(language, wrong, right):
    """Documents of one language, wrongly decoded in one way, as 0.1, 1 and 5 % of all: nine tenths are found, and no clean one."""
    texts = pq.read_table(DOCUMENTS, columns=["text", "lang"]).to_pylist()
    clean = list(dict.fromkeys(r["text"] for r in texts if r["text"] and r["text"].strip()))
    spoken = [r["text"] for r in texts if r["lang"] == language and len(r["text"] or "") > 80]
    garbled = {}
    for t in spoken:
        raw = t.encode(right, "ignore")
        if raw.decode(right) == t and sum(map(len, encoding.RUN.findall(t))) >= 6:
            garbled["".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in raw)] = t

    def count(texts, found):
        for rows in encoding._counts([{"text": texts}]):
            for k, n in rows:
                found[k] = found.get(k, 0) + n
        return found

    before = count(clean, {})
    for share in (0.001, 0.01, 0.05):
        some = dict(list(garbled.items())[: max(1, round(share * len(clean)))])
        scores = encoding.PairScores(count(list(some), dict(before)))
        got = [encoding.restore(g, scores) for g in some]
        assert sum(f for f, _, _ in got) >= 0.9 * len(some), share
        assert sum(r == t for (_, r, _), t in zip(got, some.values())) >= 0.75 * len(some), share
    old = encoding.PairScores(before)
    assert [t for t in clean if encoding.restore(t, scores)[0] and not encoding.restore(t, old)[0]] == []


# ---- scanned pages -----------------------------------------------------------------------------------------------------


def pages_of(book, scanned):
    lines = []
    for k in range(6):
        top = ["THE WINTER LANTERN"] if scanned else []
        text = ["The candid argument of the reader supports", "the narrow claim of the village and the", "well-worn example of the author answers the", "quiet promise of the merchant.", ""]
        text += ["In the opening pages the familiar metaphor", "hides the stern warning of the village", "and the obscure example of the reader."]
        if scanned:
            text[1] = f"the narrow {'clairn' if k == 1 else 'claim'} of the village and the famil-"
            text[2] = "iar example of the author answers the well-"
            text[3] = "worn promise of the merchant."
        lines.append((book, k, "\n".join([*top, *text, *([f"- {k + 11} -"] if scanned else [])])))
    return lines


@pytest.fixture(scope="module")
def book(spark):
    pages = [p for b in range(1, 60) for p in pages_of(b, False)] + pages_of(99, True) + [(99, 6, None), (99, 7, ""), (99, 8, " "), pages_of(99, True)[0], (3, 50, "x" * 20_000)]
    scanned = [t for b, _, t in pages_of(99, True)]
    chapters = [(99, 1, 0, None, "\n\n".join(scanned)), (99, 2, 6, 8, None), (1, 1, 0, 2, "\n\n".join(t for _, _, t in pages_of(1, False)[:3]))]
    return (
        spark.createDataFrame(pages, "book_id long, page_idx int, text string"),
        spark.createDataFrame(chapters, "book_id long, chapter_id int, start_page int, end_page int, text string"),
    )


@pytest.mark.parametrize("limit", [None, 0])
def test_noise(book, limit):
    got = {tuple(r) for r in scan_noise.find_noise(*book, limit=limit).collect()}
    want = set()
    for k in range(6):
        kinds = [(0, "running"), (9, "running"), (2, "split"), (3, "split"), *[(2, "misread")] * (k == 1)]
        want |= {("pages", 99, k, n, kind) for n, kind in kinds}
        want |= {("chapters", 99, 1, 11 * k + n, kind) for n, kind in kinds}
    assert got == want


def test_paragraphs(book):
    got = [r["text"] for r in sorted(scan_noise.paragraphs(*book).where("origin = 'pages' and book_id = 99 and unit_id = 1").collect(), key=lambda r: r["par_no"])]
    assert got == [
        "The candid argument of the reader supports the narrow claim of the village and the familiar example of the author answers the well-worn promise of the merchant.",
        "In the opening pages the familiar metaphor hides the stern warning of the village and the obscure example of the reader.",
    ]


def test_no_pages(book):
    pages, chapters = book
    assert scan_noise.find_noise(pages.limit(0), chapters.limit(0)).count() == 0


def test_readings():
    found = {"times": 500, "cadence": 90, "well-worn": 60, "reader": 900, "the": 5000, "of": 5000}
    assert scan_noise.reading("timcs.", found) == "mtimes" and scan_noise.reading("caden(e", found) == "mcadence"
    assert scan_noise.reading("well\x1fworn", found) == "h" and scan_noise.reading("rea\x1fder", found) == "j"
    assert scan_noise.reading("times", found) is None and scan_noise.reading("x" * 500, found) == "f"
    assert scan_noise.roman_value("xiv") == 14


@pytest.mark.parametrize("times", [1, 10, 1000])
def test_marks_at_any_scale(times):
    found = {k: n * times for k, n in {"nvitation": 3, "\x1fnvitation": 3, "invitation": 90, "lose": 40, "\x1flose": 2, "close": 90, "timcs": 1, "fimcs": 2, "times": 900}.items()}
    assert scan_noise.reading("!nvitation", found) == "minvitation" and scan_noise.reading("|nvitation,", found) == "minvitation"
    assert scan_noise.reading("(lose", found) is None
    assert scan_noise.reading("fimcs", found) == "mtimes"  # two confusions


@pytest.mark.parametrize("limit", [None, 0])
def test_marks_in_repeated_pages(spark, limit):
    once = ["An !nvitation to the (hapter.", "(The invitation stands!) " + "The invitation of the chapter stands. " * 30]
    for times in (1, 20):
        got = dict(map(tuple, scan_noise.readings(spark.createDataFrame([(t,) for t in once * times], "text string"), limit)[0].where("value <> 'f'").collect()))
        assert got == {"!nvitation": "minvitation", "(hapter.": "mchapter"}


PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def lexicon(spark):
    read, words = scan_noise.readings(spark.read.parquet(PAGES).select("text"))
    return dict(map(tuple, words.collect()))


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test data")
def test_splits_and_merges(lexicon):
    """Frequent words with a space put in, runs of merged words, and both with a misread character."""
    words = sorted((w for w in lexicon if w.isalpha() and w.isascii() and len(w) >= 5), key=lambda w: (-lexicon[w], w))[:200]
    parts = [(w, w[: 2 + i % (len(w) - 3)], w[2 + i % (len(w) - 3) :]) for i, w in enumerate(words)]
    broken = [(w, f"{a} {b}") for w, a, b in parts if not (lexicon.get(a, 0) > 3 and lexicon.get(b, 0) > 3)]
    assert sum(scan_noise.window_reading(x, lexicon) == f"w{w}" for w, x in broken) >= 0.95 * len(broken) and len(broken) > 150
    three = [words[i : i + 3] for i in range(len(words) - 3)]
    assert sum(scan_noise.reading("".join(x), lexicon) == f"s{' '.join(x)}" for x in three) >= 0.9 * len(three)
    wrong = [(x, "".join([x[0], x[1].replace("e", "c", 1), x[2]])) for x in three if "e" in x[1] and len(x[1]) > 5 and lexicon[x[1]] > 5 * scan_noise.MERGED_RATIO]
    assert sum(scan_noise.reading(t, lexicon) == f"s{' '.join(x)}" for x, t in wrong) >= 0.8 * len(wrong) and len(wrong) > 20
    long_ = words[:40]
    assert scan_noise.reading("".join(long_), lexicon) == f"s{' '.join(long_)}"
    assert all(scan_noise.reading(w, lexicon) is None for w in words)


@pytest.mark.parametrize("limit", [None, 0])
def test_split_repair(spark, limit):
    """A word broken by spaces, on one line and over two, beside words that stand as they are printed."""
    plain = "The candid argument of the reader supports the narrow claim of the village. " * 40
    pages = [(1, k, plain) for k in range(4)] + [(2, 0, "The candid argu ment of the re ader supp\norts the narrow claim, of the vil lage."), (2, 1, "No th ing here.")]
    got = [r["text"] for r in scan_noise.paragraphs(spark.createDataFrame(pages, "book_id long, page_idx int, text string"), spark.createDataFrame([], "book_id long, chapter_id int, start_page int, end_page int, text string"), limit).where("book_id = 2").orderBy("unit_id").collect()]
    assert got == ["The candid argument of the reader supports the narrow claim, of the village.", "No th ing here."]


def test_long_paragraph():
    """A paragraph of any number of lines is one."""
    lines = ["The candid argument of the reader supports the"] * 1000 + ["claim.", "", "Another paragraph of the village."]
    assert [len(x.split()) for x in scan_noise.repaired("\n".join(lines), set(), {})] == [8001, 5]
