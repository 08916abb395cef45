"""Every registered core query against its SQL on the small tables, and on tables without rows."""

import json
import os
import re
import time
from importlib import resources

import duckdb
import pandas as pd
import pytest

from folio.operators import reports
from folio.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def norm(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return None
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    v = v.item() if hasattr(v, "item") else v
    return round(v, 5) if isinstance(v, float) else v


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(norm, r)) for r in df[columns].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert rows(registry.queries()[name](spark, DATA).toPandas()) == rows(con.sql(registry.oracle_sql()[name]).df())


# ---- by brute force ----------------------------------------------------------------------------------------------------


def fetch(con, sql):
    cur = con.execute(sql)
    return [dict(zip([c[0] for c in cur.description], r)) for r in cur.fetchall()]


def split(text, most):
    """Paragraphs up to so many bytes; a longer one by words."""
    if len(text.encode()) <= most:
        return [text]
    out, now = [], ""
    for par in text.split("\n\n"):
        n = len(par.encode())
        if n > most or (len(now.encode()) + n + 2 > most):
            out, now = [*out, now] if now else out, ""
        if n <= most:
            now = f"{now}\n\n{par}" if now else par
            continue
        for w in par.split():
            if len(now.encode()) + len(w.encode()) + 1 > most:
                out, now = [*out, now] if now else out, ""
            now = f"{now} {w}" if now else w
    return [*out, now] if now else out or [text]


def chp5(con):
    rows = sorted(fetch(con, registry.oracle_sql()["chp2_chapters"]), key=lambda r: (r["book_id"], r["ordinal"]))
    out, book, before, no = [], None, None, 0
    for r in rows:
        if r["book_id"] != book:
            book, before, no = r["book_id"], None, 0
        parts = split(r["text"], 2 * 2949)
        for k, p in enumerate(parts):
            text = p if before is None else f"[CONTEXT FROM PREVIOUS SECTION]\n{before}\n[END CONTEXT]\n\n{p}"
            title = f"{r['title']} (part {k + 1})" if len(parts) > 1 else r["title"]
            out.append({"book_id": book, "chapter_id": no, "title": title, "start_page": r["start_page"], "end_page": r["end_page"], "text": text, "approx_tokens": len(text.encode()) // 2})
            before, no = p[-400:], no + 1
    return out


def pck2(con):
    rows = fetch(con, "SELECT DISTINCT book_id, chapter_id, text FROM chapters WHERE text IS NOT NULL")
    return [{"book_id": r["book_id"], "chapter_id": r["chapter_id"], "part_no": k, "piece": p} for r in rows for k, p in enumerate(split(r["text"], 4000))]


def windows(words, most, overlap):
    start, share = 0, max(4 * overlap // 5, 1)
    while start < len(words):
        end = start + 1
        while end < len(words) and sum(len(w.encode()) + 1 for w in words[start : end + 1]) <= most:
            end += 1
        yield start, end
        if end == len(words):
            return
        start = max(end - min(share, end - start), start + 1)


def pck3(con):
    rows = [(r["doc_id"], r["text"].split()) for r in fetch(con, "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")]
    return [{"doc_id": d, "chunk_no": k, "n_words": e - s, "chunk": " ".join(w[s:e])} for d, w in rows for k, (s, e) in enumerate(windows(w, 2000, 50))]


def pck3_pages(con):
    out = []
    for r in fetch(con, "SELECT book_id, list((page_idx, text) ORDER BY page_idx) AS l FROM (SELECT book_id, page_idx, max(text) AS text FROM pages WHERE text IS NOT NULL GROUP BY 1, 2) GROUP BY 1"):
        words = [(w, p) for p, t in r["l"] for w in t.split()]
        for k, (s, e) in enumerate(windows([w for w, _ in words], 2000, 50)):
            out.append({"book_id": r["book_id"], "chunk_no": k, "start_page": words[s][1], "end_page": words[e - 1][1], "n_words": e - s, "text": " ".join(w for w, _ in words[s:e])})
    return out


WORDS = ("appeal", "threat", "slogan", "promise")
FINAL, BETWEEN = reports.FINAL_INSTRUCTION, reports.INTERMEDIATE_INSTRUCTION


def said(prompt):
    return "\n".join(f"- {w}: {prompt.lower().count(w)}" for w in sorted(WORDS) if w in prompt.lower()) or "No findings."


def groups(texts, budget):
    out = []
    for t in texts:
        if out and sum(len(x.encode()) + 2 for x in [*out[-1], t]) <= budget:
            out[-1].append(t)
        else:
            out.append([t])
    return out


def folded(texts, budget):
    for n in range(1, 17):
        g = groups(texts, budget)
        texts = [said((FINAL if len(g) == 1 else BETWEEN) + "\n\n".join(x)) for x in g]
        if len(g) == 1:
            return n, texts[0]
    return 16, "\n\n".join(texts)


def pck5(con):
    rows = fetch(con, "SELECT run_id, list(text ORDER BY output_id) AS l FROM (SELECT DISTINCT ON (output_id) * FROM model_outputs) WHERE text IS NOT NULL GROUP BY 1")
    out = [(r["run_id"], *folded(r["l"], 4000)) for r in rows]
    return [{"run_id": r, "passes": n, "text": t} for r, n, t in out]


def passes(con):
    out = []
    for r in fetch(con, "SELECT book_id, list(strlen(text) + 2 ORDER BY output_id) AS l FROM (SELECT DISTINCT ON (output_id) * FROM model_outputs) WHERE text IS NOT NULL GROUP BY 1"):
        costs, seen = r["l"], []
        while True:
            n, fill = 0, None
            for c in costs:
                if fill is None or fill + c > 24372:
                    n, fill = n + 1, 0
                fill += c
            seen.append(n)
            costs = [4098] * n
            if n == 1 or len(seen) == 16:
                break
        out.append({"book_id": r["book_id"], "passes": len(seen), "first_groups": seen[0], "last_groups": seen[-1]})
    return out


def collapse(con):
    rows = fetch(con, "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
    return [{"doc_id": r["doc_id"], "collapsed": re.sub(r"(?<!\S)(\S) (?=\S(?!\S))", r"\1", " ".join(r["text"]), flags=re.A)} for r in rows]


def spaced(con):
    out = []
    for r in fetch(con, "SELECT DISTINCT book_id, chunk_id, text FROM chunks WHERE text IS NOT NULL"):
        text, font, gap = "", 12.0, False
        for i, w in enumerate(r["text"].split(" ")):
            op = ("Td", "TJ", "Tj", "T*", "TJ", "'", "Tf")[i % 7]
            a = (i % 3) * 4.0 - (400.0 * (i % 2) if op == "TJ" else 0.0)
            shown = None
            if op == "Tf":
                font = 8.0 + i % 5
            elif op == "Td":
                gap = gap or i % 2 > 0 or a > 0.25 * font
            elif op == "TJ" and i % 2:
                gap = gap or a < min(-15 * font, -120)
            elif op == "TJ":
                shown = w
            else:
                gap = gap or op in ("T*", "'")
                shown = w.strip(" ") if op != "T*" else None
            if shown:
                text += (" " if gap and text and not text.endswith(" ") else "") + shown
                gap = False
        out.append({"book_id": r["book_id"], "chunk_id": r["chunk_id"], "text": text})
    return out


def udf1(con):
    rows = fetch(con, "SELECT DISTINCT book_id, chapter_id, text FROM chapters WHERE text IS NOT NULL")
    return [{"book_id": r["book_id"], "chapter_id": r["chapter_id"], "output": said(r["text"])} for r in rows]


def whole_runs(con):
    """The run as a loop over runs, models and chapters."""
    system = []
    for f in sorted((resources.files("folio.resources") / "packets").iterdir(), key=lambda f: f.name):
        if f.name.endswith(".json"):
            system.append(json.loads(f.read_text("utf-8")))
    keeper = {}
    for p in system:
        for r in p["rules"]:
            keeper.setdefault(r["rule_id"], []).append(p["packet_id"])
    keeper = {k: max([i for i in v if i < 900] or v) for k, v in keeper.items()}
    blocks = []
    for p in sorted(system, key=lambda p: p["packet_id"]):
        rules = [f"  [{r['rule_id']}] {r['name']} ({r['severity'].title()})\n  Patterns: {', '.join(r['patterns'])}\n  Explanation: {r['explanation']}" for r in p["rules"] if keeper[r["rule_id"]] == p["packet_id"]]
        blocks.append(f"[RAG-PACKET {p['packet_id']:03d}]\nCategory: {p['category']}\n" + "\n\n".join(rules) + "\n[/RAG-PACKET]")
    head = "\n\n".join(blocks)
    chapters = sorted(fetch(con, registry.oracle_sql()["chp2_chapters"]), key=lambda r: (r["book_id"], r["ordinal"]))
    out = []
    for m in fetch(con, "SELECT DISTINCT ON (run_id) * FROM manifests"):
        mode = {"1": "single", "2": "dual"}.get((m["mode"] or "").strip().lower(), (m["mode"] or "").strip().lower())
        n = {"single": 1, "dual": 2}.get(mode, 3)
        models = [m[f"model{i + 1}"] for i in range(n) if m[f"model{i + 1}"]]
        c = 16384 if m["context_length"] is None else m["context_length"]
        budget = max(max(max(max(c - 6800, 0) - 2048, 0) - c * 10 // 100, 0), 1024)
        pieces, before = [], None
        for r in (r for r in chapters if r["book_id"] == m["book_id"]):
            parts = split(r["text"], max(2 * budget, 100))
            for k, p in enumerate(parts):
                pieces.append((f"{r['title']} (part {k + 1})" if len(parts) > 1 else r["title"], p if before is None else f"[CONTEXT FROM PREVIOUS SECTION]\n{before}\n[END CONTEXT]\n\n{p}"))
                before = p[-400:]
        answers = [(name, k, title, said(f"{head}\n\n{text}")) for name in models for k, (title, text) in enumerate(pieces)]
        if m["fusion"] and answers:
            text = folded([f"=== {name} · chapter {k + 1} ===\n{a}" for name, k, _, a in answers], 24372)[1]
        elif answers:
            text = ""
            for name in sorted(set(models)):
                text += f"═══ {name} ═══\n\n" + "".join(f"── {t or f'Chapter {k + 1}'} ──\n{a}\n\n" for nm, k, t, a in answers if nm == name)
        else:
            text = "Run complete. No inference output was produced."
        out.append({"run_id": m["run_id"], "n_outputs": len(answers), "text": text})
    return out


BRUTE = {
    "chp5_pieces": chp5, "pck2_paragraphs": pck2, "pck3_word_chunks": pck3, "pck3_page_windows": pck3_pages, "pck5_fold": pck5, "pck5_fold_passes": passes,
    "txt5_collapse": collapse, "txt9_spacing_rules": spaced, "udf1_analyze": udf1, "run_pipeline": whole_runs,
}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_matches_brute_force(spark, con, name):
    want = pd.DataFrame(BRUTE[name](con))
    assert len(want) and rows(registry.queries()[name](spark, DATA).toPandas()) == rows(want)


def test_entry(spark):
    assert registry.entry(spark, DATA).columns == ["category", "model_name", "margin", "wins", "stable"]


def test_missing_packets_of_many_rules(spark, tmp_path):
    """Packets of 15,000 rules, valid but for the last one: a repeated id (40), no patterns (80), an empty id (100); 60 weighs
    nothing. Comparing each rule with all before it takes minutes."""
    n = 15_000
    keys = [k for k in range(1, 200_000) if k % 97 and k % 89]
    part = [(k, f"B{k}", 1 + i // n) for i, k in enumerate(keys[: 5 * n])]
    part += [(next(k for k in keys if k > 100_000 and k % 50 == keys[n] % 50), f"B{keys[n]}", 2), (89 * 2000, "last", 4), (97 * 2000, "last", 5)]
    pd.DataFrame([(k, "name", b, "type", s) for k, b, s in part], columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size"]).to_parquet(tmp_path / "part.parquet")
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet'")
    began = time.time()
    found = rows(registry.queries()["jon4_missing_packets"](spark, str(tmp_path)).toPandas())
    assert time.time() - began < 30
    assert found == rows(con.sql(registry.oracle_sql()["jon4_missing_packets"]).df()) == (["packet_id"], [(100,), (40,), (60,), (80,)])


def test_missing_packets_are_not_gathered(spark, tmp_path):
    """No packet is held as a row with all its rules, and a packet without an id is like any other: valid here, and invalid
    with one more rule without patterns."""
    query, sql = registry.queries()["jon4_missing_packets"], registry.oracle_sql()["jon4_missing_packets"]
    assert "collect_list" not in query(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    part = [(1, "n", "B1", "t", None), (2, "n", "B2", "t", None), (3, "n", "B3", "t", 1), (194, "n", "B4", "t", 2)]
    for k, more in enumerate([[], [(89, "n", "B5", "t", None)]]):
        table = pd.DataFrame(part + more, columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size"]).astype({"p_size": "Int32"})
        (tmp_path / str(k)).mkdir()
        table.to_parquet(tmp_path / str(k) / "part.parquet")
        own = duckdb.connect()
        own.sql(f"create view part as select * from '{tmp_path}/{k}/part.parquet'")
        assert rows(query(spark, str(tmp_path / str(k))).toPandas()) == rows(own.sql(sql).df()) == (["packet_id"], [(40,)] + [(None,)] * k)
