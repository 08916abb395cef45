"""Queries of the string operators, of chapters and of packing, with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import chapters as C
from folio.operators import packing as P
from folio.operators.analysis import LexicalAnalyzer, analyze
from folio.operators import packets as K
from folio.operators.repair import byte_shift
from folio.plans import pipeline
from folio.plans.catalog import query
from folio.session import first_rows, shared_dir, spread, table
from folio.sources import readers

CTRL = r"[\x00-\x09\x0B-\x1F\x7F-\x{9F}]"
SP = r"[\s\p{Z}]+"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}|{SP}$', '', 'g')"


def sql_sane(t: str) -> str:
    """The sanity check of a text in SQL."""

    def window(w: str) -> str:
        kinds = " + ".join(f"(contains(lower({w}), '{p}'))::INT" for p in T.STOP_PATTERNS)
        tokens = f"list_filter(regexp_split_to_array({w}, '{SP}'), lambda x: x <> '')"
        readable = "[^A-Za-z0-9 .,;:!?''\\-\"()\n]"
        return (
            f"(length(regexp_replace({w}, '{readable}', '', 'g')) > 0.60 * strlen({w}) AND ({kinds}) >= 2 "
            f"AND len(list_filter({tokens}, lambda x: strlen(x) = 1)) <= 0.50 * len({tokens}))"
        )

    s = f"least(length({t}), 800)"
    ws = [f"substring({t}, 1, {s})", f"substring({t}, (length({t}) - {s}) // 2 + 1, {s})", f"substring({t}, length({t}) - {s} + 1, {s})"]
    return f"(length({t}) < 20 OR ({' AND '.join(map(window, ws))}))"


def sql_strip(t: str) -> str:
    """Tool output without noise in SQL."""
    starts = " OR ".join(f"starts_with({{x}}, '{p}')" for p in T.BANNER_STARTS)
    banner = f"({{x}} = '' OR regexp_matches({{x}}, '[{T.BANNER_GLYPHS}]') OR {starts})"
    noise = f"({{x}} IN ('Exiting...', '>', '') OR {' OR '.join(f'''starts_with({{x}}, '{p}')''' for p in T.NOISE_STARTS)})"
    lines = f"string_split(regexp_replace(replace({t}, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10))"
    x = sql_trim("x")
    first = f"list_position(list_transform({lines}, lambda x: {banner.format(x=x)}), false)"
    body = f"CASE WHEN {first} IS NULL OR {first} = 0 THEN [] ELSE list_slice({lines}, {first}, len({lines})) END"
    return f"array_to_string(list_filter({body}, lambda x: NOT {noise.format(x=x)}), chr(10))"


OUTPUTS = "(SELECT DISTINCT ON (output_id) * FROM model_outputs)"
NOISY = "'Loading model' || chr(10) || chr(10) || 'build: 4' || chr(10) || text || chr(10) || '> ' || chr(10) || '[ Prompt: 1 ]' || chr(10) || 'Exiting...'"


def outputs(spark, d):
    rows = table(spark, d, "model_outputs")
    return spread(first_rows(rows, ["output_id"]), rows)


def docs(spark, d):
    return spread(table(spark, d, "documents"))


@query("txt1_normalize", f"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '{CTRL}', '', 'g'), '{SP}', ' ', 'g')) AS clean FROM documents")
def txt1(spark, d):
    return docs(spark, d).select("doc_id", T.normalize("text").alias("clean"))


@query("txt2_decode", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def txt2(spark, d):
    marked = F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))
    return docs(spark, d).where("text is not null").select("doc_id", T.decode_pdf_string(marked).alias("text"))


@query("txt3_sane", f"SELECT doc_id, {sql_sane('text')} AS sane FROM documents WHERE text IS NOT NULL")
def txt3(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", T.looks_sane("text").alias("sane"))


SHIFT = 7


@query(
    "txt4_byte_shift_repair",
    "WITH s AS (SELECT doc_id, translate(text, '{g}', '{planted}') AS t FROM documents WHERE text IS NOT NULL), bad AS (SELECT * FROM s WHERE NOT {sane_t}), "
    "k AS (SELECT i AS k, list_extract([{tables}], i::INT) AS dst FROM range(1, 256) r(i)), c AS (SELECT doc_id, k, translate(t, '{g}', dst) AS u FROM bad, k) "
    "SELECT doc_id, min(k)::BIGINT AS shift FROM c WHERE {sane_u} GROUP BY doc_id".format(
        g=T.GRAPHIC.replace("'", "''"), planted=T.shifted_alphabet(SHIFT).replace("'", "''"), sane_t=sql_sane("t"), sane_u=sql_sane("u"), tables=", ".join("'" + T.shifted_alphabet(k).replace("'", "''") + "'" for k in range(1, 256))
    ),
)
def txt4(spark, d):
    """Texts shifted by a constant, and the first shift that makes each readable."""
    return byte_shift(docs(spark, d).select("doc_id", T.shift_bytes("text", SHIFT).alias("text")), "doc_id")


@query("txt5_spacing", "SELECT doc_id, round(len(list_filter(string_split(text, ' '), lambda x: length(x) = 1)) / greatest(length(text) // 2, 1), 6) AS density FROM documents WHERE text IS NOT NULL")
def txt5(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", F.round(T.spacing_density("text"), 6).alias("density"))


@query("txt5_collapse")
def txt5b(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", T.collapse_spacing(F.array_join(F.split("text", ""), " ")).alias("collapsed"))


@query("txt6_sanitize", f"SELECT doc_id, regexp_replace(text, '{CTRL}', '', 'g') AS clean FROM documents")
def txt6(spark, d):
    return docs(spark, d).select("doc_id", T.sanitize("text").alias("clean"))


@query("txt8_strip_noise", f"SELECT output_id, {sql_strip('t')} AS clean FROM (SELECT output_id, {NOISY} AS t FROM {OUTPUTS} WHERE text IS NOT NULL)")
def txt8(spark, d):
    noisy = F.concat(F.lit("Loading model\n\nbuild: 4\n"), F.col("text"), F.lit("\n> \n[ Prompt: 1 ]\nExiting..."))
    return outputs(spark, d).where("text is not null").select("output_id", T.strip_noise(noisy).alias("clean"))


@query("txt9_spacing_rules")
def txt9(spark, d):
    """Operators of a page to its text: moves, kernings, new lines and shown pieces, made of the words of a chunk."""
    chunks = table(spark, d, "chunks").where("text is not null").select("book_id", "chunk_id", "text").distinct()
    kinds = F.array(*[F.lit(x) for x in ("Td", "TJ", "Tj", "T*", "TJ", "'", "Tf")])

    def op(w, i):
        kind = F.get(kinds, (i % 7).cast("int"))
        return F.struct(kind.alias("op"), ((i % 3) * 4.0 - F.when(kind == "TJ", (i % 2) * 400.0).otherwise(0.0)).alias("a"), (F.when(kind == "Tf", 8.0 + i % 5).otherwise((i % 2) * 1.0)).alias("b"), F.when((kind != "TJ") | (i % 2 == 0), w).alias("text"))

    ops = F.transform(F.split("text", " "), op)
    return chunks.select("book_id", "chunk_id", T.spaced_text(ops).alias("text"))


@query(
    "txt10_to_14",
    "SELECT doc_id, CASE WHEN strlen(text) <= 120 THEN text ELSE substring(text, 1, 119) || '…' END AS short, right(text, 400) AS tail, "
    r"regexp_replace(text, '([\\()])', '\\\1', 'g') AS pdf FROM documents",
)
def txt10(spark, d):
    return docs(spark, d).select("doc_id", T.truncate_bytes("text").alias("short"), T.tail_chars("text", 400).alias("tail"), T.escape_pdf("text").alias("pdf"))


@query(
    "txt11_labels",
    r"SELECT DISTINCT book_id, chapter_id, CASE WHEN coalesce(title, '') = '' THEN 'chapter_' || printf('%03d', chapter_id + 1) ELSE printf('%03d', chapter_id + 1) || '_' || trim(regexp_replace(title, '[^\p{L}\p{N} -]', '_', 'g')) END AS label FROM chapters",
)
def txt11(spark, d):
    return table(spark, d, "chapters").select("book_id", "chapter_id", T.chapter_label("chapter_id", "title").alias("label")).distinct()


@query("txt12_report_names", r"SELECT DISTINCT run_id, regexp_replace(regexp_replace(filename, '(\.pdf|\.PDF)$', ''), '[^\p{L}\p{N} \-_.]', '_', 'g') || '_Report.pdf' AS report FROM manifests")
def txt12(spark, d):
    return table(spark, d, "manifests").select("run_id", T.report_name("filename").alias("report")).distinct()


def _sql_json(t: str) -> str:
    for raw, short in (("\\", "\\\\"), ('"', '\\"')):
        t = f"replace({t}, '{raw}', '{short}')"
    for o, short in ((10, "\\n"), (13, "\\r"), (9, "\\t")):
        t = f"replace({t}, chr({o}), '{short}')"
    for o in [*range(1, 0x20), *range(0x7F, 0xA0)]:
        if o not in (9, 10, 13):
            t = f"replace({t}, chr({o}), '\\u{o:04x}')"
    return t


@query("txt15_escape_json", f"SELECT doc_id, {_sql_json('text')} AS body FROM documents")
def txt15(spark, d):
    return docs(spark, d).select("doc_id", T.escape_json("text").alias("body"))


@query(
    "txt16_18_urls",
    "WITH u AS (SELECT doc_id, 'https://host.example/' || coalesce(source, 'x') || CASE WHEN doc_id % 5 = 0 THEN '/tree/' ELSE '/resolve/' END || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.GGUF?x=1' ELSE '.bin' END AS url, source FROM documents) "
    "SELECT doc_id, CASE WHEN starts_with(url, 'https://') AND NOT contains(url, '/tree/') AND NOT contains(url, '/blob/') AND lower(string_split(list_extract(string_split(url, '/'), -1), '?')[1]) LIKE '%.gguf' "
    "THEN string_split(list_extract(string_split(url, '/'), -1), '?')[1] END AS file, 'https://host.example/' || source || '/resolve/main/' || replace(replace(url_encode(source || ' ü/~*' || doc_id), '%2F', '/'), '%7E', '~') AS download FROM u",
)
def txt16(spark, d):
    src = F.coalesce("source", F.lit("x"))
    url = F.concat(F.lit("https://host.example/"), src, F.when(F.col("doc_id") % 5 == 0, "/tree/").otherwise("/resolve/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".GGUF?x=1").otherwise(".bin"))
    name = F.concat(F.col("source"), F.lit(" ü/~*"), F.col("doc_id").cast("string"))
    return docs(spark, d).select("doc_id", T.url_file(url).alias("file"), T.download_url("https://host.example", "source", F.lit(None).cast("string"), name).alias("download"))


@query("txt19_20_hash_tokens", "SELECT doc_id, sha256(text) AS sha, (strlen(text) // 2)::BIGINT AS tokens FROM documents")
def txt19(spark, d):
    return docs(spark, d).select("doc_id", T.sha256("text").alias("sha"), T.token_estimate("text").alias("tokens"))


@query("txt21_json", "SELECT doc_id, n_chars, text FROM documents WHERE text IS NOT NULL")
def txt21(spark, d):
    """Rows to JSON and back."""
    rows = docs(spark, d).where("text is not null").select("doc_id", F.to_json(F.struct("n_chars", "text")).alias("j"))
    back = rows.select("doc_id", F.from_json("j", "n_chars bigint, text string").alias("v"))
    return back.select("doc_id", "v.n_chars", "v.text")


@query("txt21_pretty_json", """SELECT event_id, '{' || chr(10) || '  "event_id": ' || event_id || ',' || chr(10) || '  "event_type": "' || event_type || '"' || chr(10) || '}' AS j FROM events""")
def txt21_pretty(spark, d):
    return table(spark, d, "events").select("event_id", T.pretty_json(F.struct("event_id", "event_type")).alias("j"))


@query("txt22_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, 'Run_%Y-%m-%d_%H-%M-%S') AS run FROM events")
def txt22(spark, d):
    return table(spark, d, "events").select("event_id", T.iso8601("ts").alias("iso"), T.run_id("ts").alias("run"))


# ---- chapters ----------------------------------------------------------------------------------------------------------

PAGES = "(SELECT book_id, page_idx, max(coalesce(text, '')) AS text FROM pages WHERE book_id IS NOT NULL AND page_idx IS NOT NULL GROUP BY ALL)"


def _sql_heading() -> str:
    head = "substring(text, 1, 500)"
    cases = ", ".join(f"CASE WHEN regexp_matches({head}, '{p}') THEN regexp_extract({head}, '(?:{p})[^\n]*', 0) END" for p in C.HEADINGS)
    t = sql_trim(f"coalesce({cases})")
    return f"CASE WHEN strlen({t}) <= 120 THEN {t} ELSE substring({t}, 1, 119) || '…' END"


MARKED = f"SELECT book_id, page_idx, text, {_sql_heading()} AS title FROM {PAGES}"
ASSEMBLED = (
    f"WITH m AS ({MARKED}), o AS (SELECT *, count(title) OVER (PARTITION BY book_id) > 1 AS several, count(title) OVER (PARTITION BY book_id ORDER BY page_idx) AS ord FROM m), "
    "p AS (SELECT *, CASE WHEN several THEN ord ELSE 0 END AS ordinal FROM o) "
    "SELECT book_id, ordinal::INT AS ordinal, CASE WHEN NOT several THEN '' WHEN ordinal = 0 THEN 'Front Matter' ELSE arg_min(title, page_idx) END AS title, min(page_idx) AS start_page, max(page_idx) AS end_page, "
    "string_agg(text, chr(10) || chr(10) ORDER BY page_idx) AS text FROM p GROUP BY book_id, ordinal, several"
)


@query("chp1_boundaries", f"SELECT book_id, page_idx, title FROM ({MARKED}) WHERE title IS NOT NULL")
def chp1(spark, d):
    return C.boundaries(table(spark, d, "pages"))


@query("chp2_chapters", f"SELECT *, (strlen(text) // 2)::BIGINT AS approx_tokens FROM ({ASSEMBLED})")
def chp2(spark, d):
    return C.assemble(table(spark, d, "pages"))


@query("chp5_pieces")
def chp5(spark, d):
    return C.pieces(C.assemble(table(spark, d, "pages")), 2949, 200)


@query(
    "chp6_totals",
    f"SELECT book_id, sum(end_page - start_page + 1)::BIGINT AS pages, count(*) AS chapters, sum(strlen(text) // 2)::BIGINT AS tokens, max(strlen(text) // 2)::BIGINT AS largest FROM ({ASSEMBLED}) GROUP BY book_id",
)
def chp6(spark, d):
    return C.totals(C.assemble(table(spark, d, "pages")))


@query(
    "jon9_pages_of_chapters",
    "SELECT c.book_id, c.chapter_id, count(*) AS n_pages, sum(strlen(p.text))::BIGINT AS n_bytes FROM (SELECT DISTINCT book_id, chapter_id, start_page, end_page FROM chapters) c "
    f"JOIN {PAGES} p ON p.book_id = c.book_id AND p.page_idx >= coalesce(c.start_page, 0) AND (c.end_page IS NULL OR p.page_idx <= c.end_page) GROUP BY 1, 2",
)
def jon9(spark, d):
    """A range join made an equi-join: the pages of a chapter are listed. Without an end it reaches to the end of its book."""
    ends = table(spark, d, "pages").groupBy("book_id").agg(F.max("page_idx").alias("last_page"))
    spans = table(spark, d, "chapters").select("book_id", "chapter_id", "start_page", "end_page").distinct().join(ends, "book_id")
    spans = spans.select("book_id", "chapter_id", F.coalesce("start_page", F.lit(0)).alias("start_page"), F.coalesce("end_page", "last_page").alias("end_page"))
    listed = spans.where("end_page >= start_page").select("book_id", "chapter_id", F.explode(F.sequence("start_page", "end_page")).alias("page_idx"))
    size = C.distinct_pages(table(spark, d, "pages")).select("book_id", "page_idx", F.octet_length("text").alias("n"))
    return listed.join(size, ["book_id", "page_idx"]).groupBy("book_id", "chapter_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n").alias("n_bytes"))


# ---- packing -----------------------------------------------------------------------------------------------------------

BUDGET = 3000


def leaves_of(spark, d):
    return outputs(spark, d).where("text is not null").select("book_id", "output_id", (F.octet_length("text") + P.SEPARATOR).alias("cost"))


@query(
    "pck1_groups",
    f"WITH RECURSIVE l AS (SELECT book_id, output_id, (strlen(text) + 2)::BIGINT AS cost, row_number() OVER (PARTITION BY book_id ORDER BY output_id) AS rn FROM {OUTPUTS} WHERE text IS NOT NULL), "
    "g AS (SELECT book_id, output_id, cost, rn, cost AS fill, 0::BIGINT AS grp FROM l WHERE rn = 1 UNION ALL "
    f"SELECT l.book_id, l.output_id, l.cost, l.rn, CASE WHEN g.fill + l.cost > {BUDGET} THEN l.cost ELSE g.fill + l.cost END, CASE WHEN g.fill + l.cost > {BUDGET} THEN g.grp + 1 ELSE g.grp END "
    "FROM g JOIN l ON l.book_id = g.book_id AND l.rn = g.rn + 1) SELECT book_id, output_id, cost, grp FROM g",
)
def pck1(spark, d):
    return P.greedy_groups(leaves_of(spark, d), "book_id", "output_id", "cost", BUDGET)


@query("pck2_paragraphs")
def pck2(spark, d):
    rows = table(spark, d, "chapters").select("book_id", "chapter_id", "text").distinct()
    return P.paragraph_pieces(rows, ["book_id", "chapter_id"], 4000)


@query("pck3_word_chunks")
def pck3(spark, d):
    return P.word_chunks(docs(spark, d), ["doc_id"], 500, 50)


@query(
    "pck4_line_pages",
    "SELECT doc_id, i::INT AS page_no, array_to_string(list_slice(l, i * 55 + 1, i * 55 + 55), chr(10)) AS page FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), "
    "LATERAL (SELECT unnest(range(0, ceil(len(l) / 55)::INT)) AS i)",
)
def pck4(spark, d):
    return P.line_pages(docs(spark, d), ["doc_id"])


@query("pck3_page_windows")
def pck3_pages(spark, d):
    """Word windows of whole books, with the pages they begin and end on."""
    return P.page_windows(table(spark, d, "pages"), 500, 50)


@query("pck5_fold_passes")
def pck5_passes(spark, d):
    return P.fold_passes(leaves_of(spark, d), "book_id", "output_id", "cost", 24372, 4098)


@query("pck5_fold")
def pck5(spark, d):
    """The outputs of each run folded into one text by the lexical analyzer."""
    return P.fold_texts(outputs(spark, d), "run_id", "output_id", "text", 4000, LexicalAnalyzer(FOLD_WORDS))


@query("pck5_fold_fallback", f"SELECT run_id, string_agg(text, chr(10) || chr(10) ORDER BY output_id) AS text FROM {OUTPUTS} WHERE text IS NOT NULL GROUP BY 1")
def pck5_fallback(spark, d):
    """A fold whose analyzer says nothing keeps all texts in order, whatever the number of passes."""
    return P.fold_texts(outputs(spark, d), "run_id", "output_id", "text", 4000, Silent(), passes=3).select("run_id", "text")


class Silent:
    def __call__(self, prompts):
        return [""] * len(prompts)


FOLD_WORDS = ("appeal", "threat", "slogan", "promise")


@query("udf1_analyze")
def udf1(spark, d):
    return analyze(table(spark, d, "chapters").select("book_id", "chapter_id", "text").distinct(), ["book_id", "chapter_id"], LexicalAnalyzer(("appeal", "threat", "slogan", "promise")))


@query("src6_extract", "SELECT doc_id, length(text)::INT AS n_chars, false AS failed FROM (SELECT doc_id, max(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1) WHERE " + sql_sane("text") + " UNION ALL SELECT doc_id, NULL, true FROM documents GROUP BY doc_id HAVING max(text) IS NULL")
def src6(spark, d):
    """Texts whose first extraction is missing, spoilt by a shift of all characters, or sound; rows that read like text."""
    rows = docs(spark, d).groupBy("doc_id").agg(F.max("text").alias("text"))
    shifted, k = T.shift_bytes("text", SHIFT), F.col("doc_id") % 3
    whole = rows.where(F.col("text").isNull() | T.looks_sane("text")).select("doc_id", F.when(k != 0, F.when(k == 1, shifted).otherwise(F.col("text"))).alias("primary"), F.when(k != 1, F.when(k == 0, F.col("text"))).alias("fallback"))
    # a shift is told by the text it gives, so a longer shift that reads as well may come first: the length is compared
    return readers.extract(whole, "doc_id").select("doc_id", F.length("text").alias("n_chars"), "failed")


@query("run_pipeline")
def run_pipeline(spark, d):
    """Whole runs: pages to reports, with a lexical analyzer; one row a run."""
    valid, _ = K.usable(readers.bundled_packets(spark))
    r = pipeline.run(table(spark, d, "pages"), table(spark, d, "manifests"), valid, spark.createDataFrame([(w, w) for w in FOLD_WORDS], "category string, keyword string"), table(spark, d, "score_history"), LexicalAnalyzer(FOLD_WORDS))
    n = r.outputs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_outputs"))
    return r.reports.join(n, "run_id", "left").select("run_id", F.coalesce("n_outputs", F.lit(0)).cast("long").alias("n_outputs"), "text")


PACKET_ROWS = "(VALUES (0, 10, 'framing', 2), (1, 20, 'authority', 2), (2, 30, 'urgency', 2), (3, 900, 'fusion', 2))"


@query("src3_bundled_packets", f"SELECT ord::INT AS ord, packet_id, category, n_rules FROM {PACKET_ROWS} v(ord, packet_id, category, n_rules)")
def src3(spark, d):
    valid, _ = K.usable(readers.bundled_packets(spark))
    return valid.select("ord", "packet_id", "category", F.size("rules").alias("n_rules"))


@query("src1_2_layered_packets", f"SELECT ord::INT AS ord, packet_id, category, n_rules FROM {PACKET_ROWS} v(ord, packet_id, category, n_rules) UNION ALL SELECT 4, 10, 'framing', 2 UNION ALL SELECT 5, 20, 'authority', 2 UNION ALL SELECT 6, 30, 'urgency', 2 UNION ALL SELECT 7, 900, 'fusion', 2")
def src1(spark, d):
    """The bundled packets written out as two layers, scanned with a third one that is missing."""
    folder = f"{shared_dir(spark)}/packets-{uuid.uuid4().hex}"
    for layer in ("defaults", "model"):
        readers.seed_packets(spark, f"{folder}/{layer}")
    valid, _ = K.usable(readers.packets(spark, f"{folder}/defaults", f"{folder}/none", f"{folder}/model"))
    return valid.select("ord", "packet_id", "category", F.size("rules").alias("n_rules"))
