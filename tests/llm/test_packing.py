"""Best fit by definition, whole items, budgets kept, and a hot run split."""

import random
from collections import defaultdict

import pytest

from folio.llm import packing as P


def brute(costs, capacity):
    room, out = [], [0] * len(costs)
    for i in sorted(range(len(costs)), key=lambda i: (-costs[i], i)):
        fits = [b for b, r in enumerate(room) if r >= costs[i]]
        if fits:
            b = min(fits, key=lambda b: room[b])
        else:
            room.append(capacity)
            b = len(room) - 1
        room[b] -= costs[i]
        out[i] = b
    return out, room


def test_best_fit():
    rnd = random.Random(2)
    for _ in range(200):
        capacity = rnd.choice([7, 50, 1000])
        costs = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 60))]
        mine, (want, room) = P.best_fit_decreasing(costs, capacity), brute(costs, capacity)
        used, wanted = defaultdict(int), defaultdict(int)
        for c, a, b in zip(costs, mine, want):
            used[a] += c
            wanted[b] += c
        assert all(v <= capacity for v in used.values()) and sorted(used.values()) == sorted(wanted.values())


def test_divide():
    for text in ("x" * 1000, "漢" * 333, "a漢" * 200):
        parts = P.divide(text, 100)
        assert b"".join(text.encode()[a:b] for a, b in parts).decode() == text
        for a, b in parts:
            text.encode()[a:b].decode()
            assert b - a + P.EXTRA <= 100


SCHEMA = "output_id long, run_id string, book_id long, text string, budget string"


@pytest.mark.parametrize("group", [20_000, 7])
def test_rows(spark, monkeypatch, group):
    monkeypatch.setattr(P, "GROUP", group)
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"r{i % 5}", 1, "w" * rnd.randint(1, 150), "x") for i in range(90)]
    rows += [rows[0], (900, "hot", 1, None, None), (901, "hot", 1, " \n ", None), (902, "none", 1, "text", None), (903, None, 1, "text", None), (904, "hot", 1, "é" * 200, None)]
    manifests = spark.createDataFrame([("hot", 200), ("hot", 200), *((f"r{k}", 160) for k in range(5)), ("none", None)], "run_id string, fold_budget_bytes long")
    got = P.pack(spark.createDataFrame(rows, SCHEMA), manifests).collect()
    used = defaultdict(int)
    for r in got:
        if r["container"] is None:
            assert r["output_id"] in (902, 903)
        else:
            used[r["run_id"], r["container"]] += r["cost"]
    assert {r["output_id"] for r in got} == {*range(90), 902, 903, 904}
    assert all(v <= (200 if k[0] == "hot" else 160) for k, v in used.items())
    parts = sorted((r["part_no"], r["byte_start"], r["byte_end"]) for r in got if r["output_id"] == 904)
    assert len(parts) > 1 and parts[0][1] == 0 and parts[-1][2] == 400
    whole = [r for r in got if r["output_id"] not in (904,)]
    assert len({r["output_id"] for r in whole}) == len(whole)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert P.pack(none, spark.createDataFrame([], "run_id string, fold_budget_bytes long")).count() == 0
