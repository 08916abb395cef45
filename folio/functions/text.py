"""String operators as Column -> Column functions: all JVM-side, whole-stage codegen, no Python per row.

Every function gives null for a null text unless it says otherwise; an empty text is an ordinary text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters but the line feed, and Unicode white space, as classes that Java and RE2 read alike.
CONTROL = r"[\x00-\x09\x0B-\x1F\x7F-\x{9F}]"
SPACE = r"[\s\p{Z}]+"
#: Characters that count as readable, the words that natural text holds, the windows of the check (fixed values).
UNREADABLE = "[^A-Za-z0-9 .,;:!?'\\-\"()\n]"
STOP_PATTERNS = ("the ", " and ", " of ", " to ", " is ", " in ", " a ")
WINDOW_CHARS, SHORT_CHARS, READABLE_SHARE, SINGLE_SHARE, STOP_KINDS = 800, 20, 0.60, 0.50, 2
#: What tool output starts with, what it holds in its banner and what it prints anywhere (fixed values).
BANNER_STARTS = (
    "Loading model", "llama_", "common_", "build", "model", "modalities", "available commands:", "/exit", "/regen", "/clear", "/read", "/glob",
)
BANNER_GLYPHS = "▄█▀"
NOISE_STARTS = ("[ Prompt:", "llama_perf_", "Error:")
NOISE_LINES = ("Exiting...", ">", "")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col(c), rf"^{SPACE}|{SPACE}$", "")


def normalize(c: Column | str) -> Column:
    """TXT-1: control characters dropped (tabs too), white space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), CONTROL, ""), SPACE, " "))


def sanitize(c: Column | str) -> Column:
    """TXT-6: without control characters but line feeds."""
    return F.regexp_replace(col(c), CONTROL, "")


def decode_pdf_string(b: Column | str) -> Column:
    """TXT-2: UTF-16BE behind its byte-order mark, else Latin-1."""
    b = col(b)
    return F.when(F.hex(F.substring(b, 1, 2)) == "FEFF", F.decode(F.substring(b, 3, 2**31 - 1), "UTF-16BE")).otherwise(F.decode(b, "ISO-8859-1"))


def _window_sane(w: Column) -> Column:
    def sane(x: Column) -> Column:
        low = F.lower(x)
        kinds = sum((F.when(F.contains(low, F.lit(p)), 1).otherwise(0) for p in STOP_PATTERNS), F.lit(0))
        readable = F.length(F.regexp_replace(x, UNREADABLE, ""))
        tokens = F.filter(F.split(x, SPACE), lambda y: y != "")
        single = F.size(F.filter(tokens, lambda y: F.octet_length(y) == 1))
        # the cheapest test first: what fails it is looked at no further
        return (kinds >= STOP_KINDS) & (readable > READABLE_SHARE * F.octet_length(x)) & (single <= SINGLE_SHARE * F.size(tokens))

    # bound to a variable, so the window is worked out once
    return F.exists(F.array(w), sane)


def windows(c: Column | str) -> list[Column]:
    """The three windows of the sanity check: start, middle, end."""
    t = col(c)
    n = F.length(t)
    s = F.least(n, F.lit(WINDOW_CHARS))
    return [F.substring(t, F.lit(1), s), F.substring(t, (F.floor((n - s) / 2) + 1).cast("int"), s), F.substring(t, (n - s + 1).cast("int"), s)]


def looks_sane(c: Column | str) -> Column:
    """TXT-3: short texts are sane; else each window is readable, holds two stop words and few one-byte tokens."""
    a, b, d = windows(c)
    return (F.length(col(c)) < SHORT_CHARS) | (_window_sane(a) & _window_sane(b) & _window_sane(d))


GRAPHIC = "".join(map(chr, range(0x21, 0x7F)))


def shifted_alphabet(k: int) -> str:
    """Where a shift of k takes the graphic characters; what leaves the printable range stays."""
    return "".join(chr(x) if 0x20 <= (x := (ord(c) + k) & 0xFF) <= 0x7E else c for c in GRAPHIC)


def shift_bytes(c: Column | str, k: int) -> Column:
    """The graphic ASCII characters moved by k places."""
    return F.translate(col(c), GRAPHIC, shifted_alphabet(k))


def spacing_density(c: Column | str) -> Column:
    """TXT-5: share of one-character tokens among half the characters, from which spaced-out text is told (0.40)."""
    t = col(c)
    single = F.size(F.filter(F.split(t, " "), lambda x: F.length(x) == 1))
    return single / F.greatest(F.floor(F.length(t) / 2), F.lit(1))


def collapse_spacing(c: Column | str) -> Column:
    """TXT-5, as intended: 'X Y Z' to 'XYZ'."""
    return F.regexp_replace(col(c), r"(?<!\S)(\S) (?=\S(?!\S))", "$1")


def spaced_text(ops: Column) -> Column:
    """TXT-9: the text of a page from its operators in order, an array of struct(op, a, b, text).

    Td, TD move by (a, b): a move up or down by more than half a point, or right by more than a quarter of the font's
    size, is a space; T*, Tm, cm and BT are one. Tf sets the font's size (b). TJ shows pieces: one with a text shows it
    as it stands, one without kerns by a, and a kerning below -15 times the size, and below -120, is a space. Tj shows a
    text without the white space at its ends, and ' and \" do the same behind a space. No text opens with a space."""
    start = F.struct(F.lit("").alias("t"), F.lit(12.0).alias("font"), F.lit(False).alias("gap"))

    def step(s: Column, x: Column) -> Column:
        op, font = x["op"], s["font"]
        moved = op.isin("Td", "TD") & ((F.abs(x["b"]) > 0.5) | (x["a"] > 0.25 * font))
        kerned = (op == "TJ") & x["text"].isNull() & (x["a"] < F.least(-15.0 * font, F.lit(-120.0)))
        gap = s["gap"] | moved | kerned | op.isin("T*", "Tm", "cm", "BT", "'", '"')
        shown = F.when(op == "TJ", x["text"]).when(op.isin("Tj", "'", '"'), F.trim(x["text"]))
        shows = F.coalesce(shown != "", F.lit(False))
        space = F.when(gap & (s["t"] != "") & ~s["t"].endswith(" "), " ").otherwise("")
        return F.struct(
            F.when(shows, F.concat(s["t"], space, shown)).otherwise(s["t"]).alias("t"), F.when((op == "Tf") & x["b"].isNotNull(), F.abs(x["b"])).otherwise(font).alias("font"), (gap & ~shows).alias("gap")
        )

    return F.aggregate(ops, start, step, lambda s: s["t"])


def pretty_json(row: Column) -> Column:
    """TXT-21: a struct of plain values as JSON on several lines, two spaces deep."""
    return F.regexp_replace(F.to_json(row, {"pretty": "true"}), r'(?m)^(\s*"(?:[^"\\]|\\.)*") : ', "$1: ")


def count_mentions(c: Column | str, keyword: Column | str) -> Column:
    """TXT-7: literal, case-insensitive, non-overlapping; an empty keyword counts 0, a null text 0."""
    return mentions_in(F.lower(F.coalesce(col(c), F.lit(""))), keyword)


def mentions_in(t: Column, keyword: Column | str) -> Column:
    """The same of a text already in lower case."""
    k = F.lower(keyword if isinstance(keyword, Column) else F.lit(keyword))
    hits = F.floor((F.length(t) - F.length(F.replace(t, k, F.lit("")))) / F.greatest(F.length(k), F.lit(1)))
    return F.when(F.length(k) == 0, 0).otherwise(hits).cast("long")


def bound(c: Column, f) -> Column:
    """f of c, with c worked out once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip_noise(c: Column | str) -> Column:
    """TXT-8: output of a command-line model without its banner, echoes and statistics."""
    lines = F.split(F.regexp_replace(F.regexp_replace(col(c), "\r\n", "\n"), "\n$", ""), "\n")
    # a line that neither begins nor ends with white space is its own trimmed form
    ragged = rf"^{SPACE}|{SPACE}$"
    pairs = F.transform(lines, lambda x: F.struct(x.alias("line"), F.when(x.rlike(ragged), trim_all(x)).otherwise(x).alias("t")))

    def banner(x: Column) -> Column:
        t = x["t"]
        out = (t == "") | t.rlike(f"[{BANNER_GLYPHS}]")
        for p in BANNER_STARTS:
            out = out | t.startswith(p)
        return out

    def noise(x: Column) -> Column:
        out = x["t"].isin(*NOISE_LINES)
        for p in NOISE_STARTS:
            out = out | x["t"].startswith(p)
        return out

    def body(rows: Column) -> Column:
        first = F.array_position(F.transform(rows, banner), F.lit(False)).cast("int")
        kept = bound(first, lambda k: F.when(k > 0, F.slice(rows, F.greatest(k, F.lit(1)), F.size(rows))))
        return F.array_join(F.transform(F.filter(kept, lambda x: ~noise(x)), lambda x: x["line"]), "\n")

    return F.when(col(c).isNotNull(), F.coalesce(bound(pairs, body), F.lit("")))


def truncate_bytes(c: Column | str, most: int = 120) -> Column:
    """TXT-10: whole up to so many bytes, else one character less than that and an ellipsis."""
    t = col(c)
    return F.when(F.octet_length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 1), F.lit("…")))


def chapter_label(index: Column | str, title: Column | str) -> Column:
    """TXT-11: the file label of a chapter; without a title its number."""
    safe = F.trim(F.regexp_replace(col(title), r"[^\p{L}\p{N} -]", "_"))
    empty = F.coalesce(col(title), F.lit("")) == ""
    return F.when(empty, F.format_string("chapter_%03d", col(index) + 1)).otherwise(F.format_string("%03d_%s", col(index) + 1, safe))


def report_name(c: Column | str, suffix: str = "_Report.pdf") -> Column:
    """TXT-12: a file name without .pdf or .PDF, made safe, with a suffix."""
    stem = F.regexp_replace(col(c), r"(\.pdf|\.PDF)$", "")
    return F.concat(F.regexp_replace(stem, r"[^\p{L}\p{N} \-_.]", "_"), F.lit(suffix))


def tail_chars(c: Column | str, n: int) -> Column:
    """TXT-13: the last n characters."""
    return F.lit("") if n == 0 else F.right(col(c), F.lit(n))


def escape_pdf(c: Column | str) -> Column:
    """TXT-14: backslash before backslash and parentheses."""
    return F.regexp_replace(col(c), r"([\\()])", r"\\$1")


def escape_json(c: Column | str) -> Column:
    """TXT-15: a JSON string body; control characters without a short form as \\u00xx."""
    t = col(c)
    for raw, short in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = F.replace(t, F.lit(raw), F.lit(short))
    for o in [*range(0x20), *range(0x7F, 0xA0)]:
        if chr(o) not in "\n\r\t":
            t = F.replace(t, F.lit(chr(o)), F.lit(f"\\u{o:04x}"))
    return t


def encode_path(c: Column | str) -> Column:
    """TXT-16: percent-encoded but for unreserved characters and '/'."""
    t = F.url_encode(col(c))
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def download_url(base: str, repo: Column | str, revision: Column | str, name: Column | str) -> Column:
    """TXT-17: where a file of a repository lies; the revision is main if null."""
    return F.concat(F.lit(base + "/"), col(repo), F.lit("/resolve/"), F.coalesce(col(revision), F.lit("main")), F.lit("/"), encode_path(name))


def url_file(c: Column | str) -> Column:
    """TXT-18: the weight file a direct link names; null for any other link."""
    u = col(c)
    name = F.substring_index(F.element_at(F.split(u, "/"), -1), "?", 1)
    ok = u.startswith("https://") & ~F.contains(u, F.lit("/tree/")) & ~F.contains(u, F.lit("/blob/")) & F.lower(name).endswith(".gguf")
    return F.when(ok, name)


def sha256(c: Column | str) -> Column:
    """TXT-19."""
    return F.sha2(col(c), 256)


def token_estimate(c: Column | str) -> Column:
    """TXT-20: a token for two bytes."""
    return F.floor(F.octet_length(col(c)) / 2).cast("long")


def iso8601(ts: Column | str) -> Column:
    """TXT-22."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def run_id(ts: Column | str) -> Column:
    """TXT-22."""
    return F.date_format(col(ts), "'Run_'yyyy-MM-dd_HH-mm-ss")
