"""Operators against plain reference computations and on edge cases: nulls, empty and long texts, ties, no rows."""

import random
import re
import struct
import time

import pytest
from pyspark.sql import functions as F

from folio.functions import numeric as N
from folio.functions import text as T
from folio.operators import chapters as C
from folio.operators import events as E
from folio.operators import manifests as M
from folio.operators import packets as K
from folio.operators import packing as P
from folio.operators import scoring as S
from folio.operators.analysis import LexicalAnalyzer, analyze
from folio.operators.ordered import running_count
from folio.operators.repair import byte_shift
from folio.sources import readers, sinks


def one(spark, column, /, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    assert df.columns == names
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "keyword, text, n", [("fallacy", "Fallacy fallacy FALLACY", 3), ("aa", "aaaaa", 2), ("", "abc", 0), ("x", None, 0), ("é", "É é", 2)]
)
def test_mentions(spark, keyword, text, n):
    assert one(spark, T.count_mentions("t", keyword), t=text) == n


@pytest.mark.parametrize("text, want", [("a\tb", "ab"), (" a \n b ", "a b"), ("a\x85b c", "ab c"), ("", ""), (None, None)])
def test_normalize(spark, text, want):
    assert one(spark, T.normalize("t"), t=text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Loading model x\n\nbuild 1\nmodel y\nReal line\n> \nExiting...\n[ Prompt: 3 ]\n\nEnd", "Real line\nEnd"),
        ("build\n\n", ""),
        ("> kept\nError: no", "> kept"),
        ("", ""),
    ],
)
def test_strip_noise(spark, text, want):
    assert one(spark, T.strip_noise("t"), t=text) == want


def test_sane_and_shift(spark):
    text = "It is the way of the world, and the end of it is in the hand of a man. " * 30
    assert one(spark, T.looks_sane("t"), t=text)
    assert one(spark, T.looks_sane("t"), t="zzzz qqqq xxxx " * 20) is False
    assert one(spark, T.looks_sane("t"), t="")
    shifted = text.translate(str.maketrans(T.GRAPHIC, T.shifted_alphabet(1)))
    got = byte_shift(spark.createDataFrame([(1, shifted), (2, text), (3, None)], "id long, text string"), "id").collect()
    assert [r["id"] for r in got] == [1]
    back = shifted.translate(str.maketrans(T.GRAPHIC, T.shifted_alphabet(got[0]["shift"])))
    assert back.lower().count("the ") > 20  # the first shift that reads, if in capitals


@pytest.mark.parametrize("s, fp, want", [(1.0, 0, 1.0), (1.0, 2, 0.8), (1.0, 10, 0.7), (0.05, 10, 0.035), (-9.0, 0, -9.0), (-9.0, 1, 0.0)])
def test_penalties(spark, s, fp, want):
    assert one(spark, N.penalised("s", "f"), s=s, f=fp) == pytest.approx(want)


@pytest.mark.parametrize("ctx, chapter, fold", [(16384, 5898, 12186), (2048, 1024, 512), (0, 1024, 512), (131072, 109117, 115405)])
def test_budgets(spark, ctx, chapter, fold):
    assert (one(spark, N.chapter_budget("c"), c=ctx), one(spark, N.fold_budget("c"), c=ctx)) == (chapter, fold)


def greedy(costs, budget):
    out, group, fill = [], 0, 0
    for c in costs:
        if fill and fill + c > budget:
            group, fill = group + 1, 0
        fill += c
        out.append(group)
    return out


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_greedy_groups(spark, partitions):
    """The distributed recurrence is the sequential one, also where one key fills many partitions."""
    rnd = random.Random(partitions)
    rows = [(k, i, rnd.choice([1, 5, 40, 90, 150, 400])) for k, n in (("a", 1), ("hot", 900), ("z", 37)) for i in range(n)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = P.greedy_groups(spark.createDataFrame(rnd.sample(rows, len(rows)), "k string, o int, c int"), "k", "o", "c", 300).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for key in ("a", "hot", "z"):
        mine = [r["grp"] for r in sorted((r for r in got if r["k"] == key), key=lambda r: r["o"])]
        assert mine == greedy([c for k, _, c in rows if k == key], 300)


def test_greedy_groups_edges(spark):
    df = spark.createDataFrame([(None, 1, None), (None, 2, 5), ("x", 1, 5000)], "k string, o int, c int")
    assert {(r["k"], r["o"], r["grp"]) for r in P.greedy_groups(df, "k", "o", "c", 3).collect()} == {(None, 1, 0), (None, 2, 1), ("x", 1, 0)}
    assert P.greedy_groups(df.limit(0), "k", "o", "c", 3).count() == 0


def paragraphs(text, most):
    """By the letter of the definition."""
    parts, cur = [], ""
    size = lambda s: len(s.encode())
    for p in text.split("\n\n"):
        if cur and size(cur) + size(p) + 2 > most:
            parts, cur = [*parts, cur], ""
        if size(p) > most:
            if cur:
                parts, cur = [*parts, cur], ""
            buf = ""
            for w in p.split():
                if buf and size(buf) + size(w) + 1 > most:
                    parts, buf = [*parts, buf], ""
                buf = f"{buf} {w}" if buf else w
            cur = buf or cur
        else:
            cur = f"{cur}\n\n{p}" if cur else p
    return parts + [cur] * bool(cur) or [text]


def test_split_paragraphs():
    rnd = random.Random(3)
    for _ in range(400):
        text = "".join(rnd.choice(["ab ", "é", "word ", "\n\n", "\n\n\n\n", "x" * 30, " "]) for _ in range(rnd.randint(0, 40)))
        assert P.split_paragraphs(text, 40) == paragraphs(text, 40), text


def test_word_windows():
    words = [(w, 0) for w in ("word " * 2000).split()]
    spans = P.word_windows(words, 2048, 32)
    assert spans[0][0] == 0 and spans[-1][1] == 2000 and all(a < c <= b < d for (a, b), (c, d) in zip(spans, spans[1:]))
    assert P.word_windows([], 10, 2) == [] and P.word_windows([("x" * 99, 0)], 1, 0) == [(0, 1)]


def test_chapters(spark):
    texts = ["Title Page", "Chapter 1 Introduction\nx", "text", "Chapter 2 Methods", None, "Chapter 3 Results"]
    pages = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(1, 2, "text")] + [(2, 0, "Chapter 1 Alone")], "book_id long, page_idx int, text string")
    got = {(r["book_id"], r["ordinal"]): r for r in C.assemble(pages).collect()}
    assert [got[1, k]["title"] for k in range(4)] == ["Front Matter", "Chapter 1 Introduction", "Chapter 2 Methods", "Chapter 3 Results"]
    assert (got[1, 1]["start_page"], got[1, 1]["end_page"], got[1, 1]["text"]) == (1, 2, "Chapter 1 Introduction\nx\n\ntext")
    assert got[2, 0]["title"] == "" and got[1, 2]["text"] == "Chapter 2 Methods\n\n"
    cut = sorted(C.pieces(C.assemble(pages), 500_000, 3).where("book_id = 1").collect(), key=lambda r: r["chapter_id"])
    assert [r["chapter_id"] for r in cut] == [0, 1, 2, 3] and "e Page" in cut[1]["text"] and cut[1]["text"].startswith(C.CONTEXT_OPEN)
    assert C.assemble(pages.limit(0)).count() == 0


def test_oversized_chapter(spark):
    pages = spark.createDataFrame([(1, 0, "Chapter 1 Big\n\n" + "word " * 5000)], "book_id long, page_idx int, text string")
    got = C.pieces(C.assemble(pages), 1000, 50).collect()
    assert len(got) > 1 and {r["chapter_id"] for r in got} == set(range(len(got)))
    assert all(r["title"].endswith(f" (part {r['chapter_id'] + 1})") for r in got)


def test_running_count_blocks(spark):
    df = spark.createDataFrame([("a", i, i % 3 == 0) for i in range(50)], "k string, o int, f boolean")
    got = sorted((r["o"], r["n"]) for r in running_count(df, "k", "o", "f", "n", block=7).collect())
    assert got == [(i, i // 3 + 1) for i in range(50)]


SCHEMA = "book_seq long, model_name string, category string, score double, false_positives long, hits long"


def test_consensus(spark):
    ten = [(b, m, "c", s, 0, 1) for b in range(10) for m, s in (("a", 10.0), ("b", 2.0))]
    assert [tuple(r) for r in S.consensus(S.newest(S.history(spark.createDataFrame(ten + ten, SCHEMA)))).collect()] == [("c", "a", 0.8, 10, True)]
    nine = spark.createDataFrame(ten[:18], SCHEMA)
    assert S.consensus(nine).first()["stable"] is False
    close = spark.createDataFrame([(1, "a", "c", 2.0, 0, 1), (1, "b", "c", 1.97, 0, 1)], SCHEMA)
    assert S.consensus(close).count() == 0
    single = spark.createDataFrame([(1, "a", "c", 2.0, None, None)], SCHEMA)
    assert S.consensus(single).first()["margin"] == 1.0
    empty = spark.createDataFrame([], SCHEMA)
    assert S.consensus(empty).count() == 0 and S.best_models(empty).first()["best_model"] is None


def test_packets(spark, tmp_path):
    rule = lambda i, ps=("p",): {"rule_id": i, "name": "n", "pattern_type": "literal", "patterns": list(ps), "severity": "low", "explanation": "e"}
    import json

    for n, (pid, rules) in enumerate([(3, [rule("A")]), (1, [rule("SAME")]), (2, [rule("SAME")]), (950, [rule("SAME"), rule("F")]), (960, [rule("F")])]):
        body = {"packet_id": pid, "category": "c", "description": "", "version": "1", "rules": rules, "hit_conditions": {"min_pattern_matches": 1, "confidence_weight": 1.0}, "model_behavior": {"inject_as": "s", "priority": 1}}
        (tmp_path / f"{n}.json").write_text(json.dumps(body))
    (tmp_path / "bad.json").write_text("{")
    df = readers.packets(spark, str(tmp_path))
    assert df.where("skipped is not null").count() == 1
    good = df.where("skipped is null")
    kept = {r["packet_id"]: [x["rule_id"] for x in r["rules"]] for r in K.merge(good).collect()}
    assert kept == {1: [], 2: ["SAME"], 3: ["A"], 950: [], 960: ["F"]}
    text = K.prompt(good.where("packet_id = 1")).first()["prompt"]
    assert text.startswith("[RAG-PACKET 001]\nCategory: c\n  [SAME] n (Low)\n  Patterns: p") and text.endswith("[/RAG-PACKET]")
    assert K.prompt(good.limit(0)).first()["prompt"] == ""


RULES = "packet_id int, rules array<struct<rule_id: string, patterns: array<string>>>, confidence_weight double"


def test_violations(spark):
    """The first fault of a packet is the one that a loop over its rules finds, with nulls, empty arrays and repeated ids."""

    def fault(pid, rules, weight):
        seen = set()
        for rule in rules or []:
            i, patterns = rule or (None, None)
            if not i:
                return f"packet {pid} has a rule with empty rule_id"
            if i in seen:
                return f"packet {pid} has duplicate rule_id: {i}"
            if not patterns:
                return f"packet {pid} rule {i} has no patterns"
            seen.add(i)
        return f"packet {pid} has no rules" if not rules else None if (weight or 0) > 0 else f"packet {pid} has non-positive confidence_weight"

    draw = random.Random(4)
    rule = lambda: None if draw.random() < 0.03 else (draw.choice(["A", "B", "C", "D", "E", "a", "A "] * 2 + ["", None]), draw.choice([["p"]] * 8 + [["p", "q"], [], None]))
    rows = [(n, None if draw.random() < 0.03 else [rule() for _ in range(draw.randrange(7))], draw.choice([1.0, 1.0, 0.5, 0.0, -1.0, None])) for n in range(2000)]
    found = {r["packet_id"]: r["violation"] for r in K.violation(spark.createDataFrame(rows, RULES)).collect()}
    assert found == {r[0]: fault(*r) for r in rows}
    assert len({re.sub("[0-9]+", "", str(v)) for v in found.values()}) > 10


def test_valid_packets_as_rows(spark):
    """Packets as rows of rules: the valid ones are those without a violation; a null is a packet's id too."""
    draw = random.Random(5)
    rule = lambda: None if draw.random() < 0.02 else (draw.choice(["A", "B", "C", "D", "E", "a", "A "] * 4 + ["", None]), draw.choice([["p"]] * 16 + [["p", "q"], [], None]))
    rows = [(n, None if draw.random() < 0.03 else [rule() for _ in range(draw.randrange(7))], draw.choice([1.0, 1.0, 0.5, 0.0, -1.0, None])) for n in range(2000)]
    packets = spark.createDataFrame(rows, RULES)
    want = sorted(r["packet_id"] for r in K.violation(packets).where("violation is null").collect())
    flat = packets.select("packet_id", "confidence_weight", F.explode_outer("rules").alias("r")).select("packet_id", "confidence_weight", "r.rule_id", "r.patterns")
    assert sorted(r["packet_id"] for r in K.valid(flat).collect()) == want and 200 < len(want) < 1800
    two = [(None, "A", 1.0), (None, "B", 1.0), (1, "A", 0.0)]
    mixed = spark.createDataFrame(two, "packet_id int, rule_id string, confidence_weight double").withColumn("patterns", F.array(F.lit("p")))
    assert [r["packet_id"] for r in K.missing_packets(mixed, K.valid(mixed)).collect()] == [1]
    assert K.valid(mixed.limit(0)).count() == 0


def test_violations_of_many_rules(spark):
    """Packets of 20,000 rules: one that is valid, one whose last rule repeats the first. Comparing each rule with all before
    it takes minutes, looking it up once takes a second."""
    ids = F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.struct(F.when((F.col("id") == 2) & (i == 20_000), 1).otherwise(i).cast("string").alias("rule_id"), F.array(F.lit("p")).alias("patterns")))
    packets = spark.range(1, 3).select(F.col("id").cast("int").alias("packet_id"), ids.alias("rules"), F.lit(1.0).alias("confidence_weight"))
    began = time.time()
    assert sorted(map(tuple, K.violation(packets).collect())) == [(1, None), (2, "packet 2 has duplicate rule_id: 1")]
    assert time.time() - began < 30


def test_manifest_round_trip(spark):
    row = spark.range(1).select(F.struct(F.lit("Run_1").alias("run_id"), F.lit("1.0").alias("manifest_version")).alias("m"))
    info = row.select(sinks.embedded(F.col("m")).alias("i"))
    got = info.select(readers.embedded_manifest(F.col("i"), F.lit(None).cast("string")).alias("e")).first()["e"]
    assert got["manifest"]["run_id"] == "Run_1" and not got["failed"]
    for bad in ("garbage!", "", "x" * 1000):
        assert info.select(readers.embedded_manifest(F.lit(bad), F.lit('{"run_id":"a","manifest_version":"1"}')).alias("e")).first()["e"]["failed"]


def test_merge_records(spark):
    kind = "struct<models: array<string>, chunks: array<string>, partial: boolean>"
    df = spark.createDataFrame([((["a"], ["1"], False), (["a", "b"], [], True)), (None, (["x"], [], False)), (None, None)], f"a {kind}, b {kind}")
    got = [r["m"] for r in df.select(M.merge_partial(F.col("a"), F.col("b")).alias("m")).collect()]
    assert (got[0]["models"], got[0]["chunks"], got[0]["partial"]) == (["a", "b"], ["1"], True) and got[1]["models"] == ["x"] and got[2] is None


def test_weight_headers():
    def s(x):
        return struct.pack("<Q", len(x)) + x

    body = struct.pack("<4sIQQ", b"GGUF", 3, 0, 3) + s(b"general.name") + struct.pack("<I", 8) + s(b"x")
    body += s(b"a.list") + struct.pack("<IIQ", 9, 4, 2) + struct.pack("<II", 1, 2) + s(b"llama.context_length") + struct.pack("<II", 4, 4096)
    assert readers.header_value(body, "context_length") == 4096
    assert readers.header_value(body, "block_count") is None and readers.header_value(b"", "x") is None and readers.header_value(body[:40], "context_length") is None


def test_recovery(spark):
    classes = ["Retryable"] * 4 + ["GpuFallback", "Retryable", "Recoverable", "Recoverable", "Fatal"]
    df = spark.createDataFrame([("r", i, c) for i, c in enumerate(classes)], "run string, seq int, cls string")
    got = [r["action"] for r in E.recovery_actions(df, "run", "seq", "cls").orderBy("seq").collect()]
    assert got == ["Retry", "Retry", "Retry", "SkipModel", "DowngradeGpu", "Retry", "Retry", "MarkPartialRun", "AbortRun"]


def test_replay(spark):
    df = spark.createDataFrame([("a", 1, "load"), ("a", 2, "infer"), ("b", 1, "infer"), ("b", 2, "error")], "k string, s int, r string")
    got = {(r["k"], r["s"]): (r["allowed"], r["state"]) for r in E.replay(df, "k", "s", "r", {("new", "load"), ("load", "infer")}, "new", "error").collect()}
    assert got == {("a", 1): (True, "load"), ("a", 2): (True, "infer"), ("b", 1): (False, "new"), ("b", 2): (True, "error")}


def test_analyzer(spark):
    df = spark.createDataFrame([(1, "Grammar grammar"), (2, None), (3, "")], "id long, text string")
    got = {r["id"]: r["output"] for r in analyze(df, ["id"], LexicalAnalyzer(["grammar"])).collect()}
    assert got == {1: "- grammar: 2", 3: "No findings."}


def test_scores_of_many_categories(spark, monkeypatch):
    """More categories than one expression holds are counted in blocks, with the same result."""
    outputs = spark.createDataFrame([(1, "m", 1, "a bb a"), (1, "m", 1, "a bb a"), (1, "n", 2, None), (2, "m", 3, "")], "book_id long, model_name string, output_id long, text string")
    words = spark.createDataFrame([(f"c{i}", w) for i, w in enumerate(["a", "bb", "", "b", "zz"])], "category string, keyword string")
    few = sorted(map(tuple, S.scores(outputs, words, distinct=["output_id"]).collect()))
    monkeypatch.setattr(S, "CATEGORIES", 2)
    assert sorted(map(tuple, S.scores(outputs, words, distinct=["output_id"]).collect())) == few
    assert len(few) == 15 and (1, "m", "c0", 2, 1.098612, 0) in few


def test_many_patterns(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "One two"), (2, None), (3, "three")], "id long, text string")
    patterns = spark.createDataFrame([(i, w) for i, w in enumerate(["one", "TWO", "", "hre", None, "none"])], "pattern_id int, pattern string")
    few = sorted(map(tuple, K.pattern_hits(texts, patterns, ["id"]).collect()))
    monkeypatch.setattr(K, "PATTERNS", 2)
    assert sorted(map(tuple, K.pattern_hits(texts, patterns, ["id"]).collect())) == few == [(1, 0), (1, 1), (3, 3)]


@pytest.mark.parametrize("block", [3, 1000])
def test_ordered(spark, block):
    """What rows hand on, over blocks, beside a loop; null keys are a key."""
    from folio.operators import ordered

    seq = [("a" if i % 3 else None, i, i % 7 if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(seq, "k string, o long, v int")
    up, before, count = {}, {}, {}
    last, n = {}, {}
    for k, o, v in seq:
        before[o] = last.get(k)
        last[k] = last.get(k) if v is None else v
        n[k] = n.get(k, 0) + (v is None)
        up[o], count[o] = last[k], n[k]
    assert {r["o"]: r["x"] for r in ordered.carried(df, "k", "o", F.col("v"), "x", block).collect()} == up
    assert {r["o"]: r["x"] for r in ordered.carried(df, "k", "o", F.col("v"), "x", block, before=True).collect()} == before
    assert {r["o"]: r["x"] for r in ordered.running_count(df.withColumn("f", F.col("v").isNull()), "k", "o", "f", "x", block).collect()} == count
    steps = spark.createDataFrame([(k, o, "abc"[o % 3] if o % 5 else None) for k, o, _ in seq], "k string, o long, r string")
    step = lambda s, r: (r, s) if r and (s, r) != ("a", "b") else (s, "no")
    state, want = {}, {}
    for k, o, _ in seq:
        state[k], want[o] = step(state.get(k, "a"), "abc"[o % 3] if o % 5 else None)
    assert {r["o"]: r["m"] for r in ordered.automaton(steps, "k", "o", "r", ["a", "b", "c"], step, "a", "m string", block).collect()} == want
    assert ordered.automaton(steps.limit(0), "k", "o", "r", ["a", "b", "c"], step, "a", "m string", block).count() == 0


def test_packet_layers(spark, tmp_path):
    """Folders in order, one of them missing; a malformed, an invalid and a too large packet are skipped with their reason."""
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    readers.seed_packets(spark, str(a))
    (b / "1.json").write_text("{")
    (b / "2.json").write_text('{"packet_id": 7, "category": "c", "rules": [], "hit_conditions": {"confidence_weight": 1.0}}')
    (b / "notes.txt").write_text("{}")
    valid, skipped = K.usable(readers.packets(spark, str(a), str(tmp_path / "none"), str(b)))
    assert [r["packet_id"] for r in valid.orderBy("ord").collect()] == [10, 20, 30, 900]
    assert {(r["path"].split("/")[-1], r["reason"]) for r in skipped.collect()} == {("1.json", "malformed"), ("2.json", "packet 7 has no rules")}
    assert readers.packets(spark, str(tmp_path / "none")).count() == 0 and readers.packets(spark).count() == 0
    prompt = K.prompt(K.merge(valid)).first()["prompt"]
    assert prompt.startswith("[RAG-PACKET 010]") and "Everyone agrees, at once" in prompt and "Unnamed experts again" not in prompt


def test_headers_read_the_head(spark, tmp_path, monkeypatch):
    """A weight file is read as far as its header goes, in growing steps."""
    import struct

    text = lambda s: struct.pack("<Q", len(s)) + s
    pairs = text(b"a.tokens") + struct.pack("<IIQ", 9, 8, 200) + text(b"token") * 200 + text(b"x.context_length") + struct.pack("<II", 4, 4096)
    (tmp_path / "m.gguf").write_bytes(b"GGUF" + struct.pack("<IQQ", 3, 0, 2) + pairs + b"0" * 100_000)
    (tmp_path / "n.gguf").write_bytes(b"none")
    monkeypatch.setattr(readers, "HEAD_BYTES", 64)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    got = {r["path"].split("/")[-1]: (r["context_length"], r["block_count"]) for r in readers.headers(files).collect()}
    assert got == {"m.gguf": (4096, None), "n.gguf": (None, None)}


def test_failed_runs(spark):
    """A run of a book without pages fails; one whose analyzer says nothing has no output either."""
    from folio.plans import pipeline

    pages = spark.createDataFrame([(1, 0, "Chapter 1 One\nThe appeal of the reader.")], "book_id long, page_idx int, text string")
    manifests = spark.createDataFrame(
        [("Run_a", 1, "1", "m", None, None, None, None), ("Run_b", 2, "full", "m", None, None, "f", 4096)], "run_id string, book_id long, mode string, model1 string, model2 string, model3 string, fusion string, context_length long"
    ).withColumn("started_at", F.lit("2024-01-01").cast("timestamp"))
    history = spark.createDataFrame([], "book_seq long, model_name string, category string, score double, false_positives long, hits long")
    packets, _ = K.usable(readers.bundled_packets(spark))
    words = spark.createDataFrame([("appeal", "appeal")], "category string, keyword string")
    r = pipeline.run(pages, manifests, packets, words, history, LexicalAnalyzer(["appeal"]))
    assert [x["run_id"] for x in r.failed.collect()] == ["Run_b"]
    texts = {x["run_id"]: x["text"] for x in r.reports.collect()}
    assert texts["Run_b"].startswith("Run complete.") and "- appeal: 1" in texts["Run_a"]
    assert [(x["category"], x["hits"]) for x in r.history.collect()] == [("appeal", 1)]
    silent = pipeline.run(pages, manifests, packets, words, history, lambda prompts: [""] * len(prompts))
    assert silent.outputs.count() == 0 and silent.failed.count() == 2


def test_extraction(spark):
    text = "The candid argument of the reader supports the narrow claim of the village and is in a book to read."
    shift = lambda t, k: "".join(chr(x) if 0x20 <= (x := (ord(c) - k) & 0xFF) <= 0x7E and c != " " else c for c in t)
    rows = [(1, text, None), (2, shift(text, 3), text), (3, None, shift(text, 3)), (4, None, None), (5, "x" * 100, "y" * 100)]
    got = {r["id"]: (r["text"], r["failed"]) for r in readers.extract(spark.createDataFrame(rows, "id long, primary string, fallback string"), "id").collect()}
    assert got[1] == got[2] == (text, False) and got[4] == got[5] == (None, True)
    assert got[3][1] is False and len(got[3][0]) == len(text)


def test_score_stream_in_batches(spark, tmp_path):
    """A stream of several batches keeps the newest books alone, and gives what one batch of all rows gives."""
    from folio.streaming import streams

    rows = [(b, m, c, float(b % 5 + (m == "a") + (c == "x")), b % 2, 3) for b in range(30) for m in "ab" for c in "xy"]
    whole = spark.createDataFrame(rows, SCHEMA)
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.keep_scores(stream, str(tmp_path / "kept"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    want = S.consensus(S.newest(S.history(whole)))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(str(tmp_path / "kept" / "batch=2")).select("book_seq").distinct().count() == 10
