"""Versioned rule packets: validation, union with conflict resolution, prompt text, matching of patterns.

packets: packet_id INT, category STRING, rules ARRAY<STRUCT<rule_id, name, severity, patterns ARRAY<STRING>, explanation>>,
confidence_weight DOUBLE. Null arrays count as empty.
"""

from __future__ import annotations

from functools import reduce

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import sanitize
from folio.operators.arrow import map_rows

#: Patterns of one automaton.
PATTERNS = 1_000_000
#: Packets from this id on fill in, they never override (fixed value).
FUSION_ID = 900


def violation(packets: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """FLT-1: packet_id and the first rule of validity that a packet breaks; null if it is valid. The wordings are fixed
    values."""
    rules = F.coalesce("rules", F.array().cast(packets.schema["rules"].dataType))
    # the distinct ids in order of their first rules agree with the ids up to the first repeated one, and differ there; what
    # follows it doesn't count. So each id is looked up once, instead of a comparison with all earlier ones
    distinct = F.array_distinct(F.transform(rules, lambda r: r["rule_id"]))
    head = F.concat(F.lit("packet "), F.col("packet_id").cast("string"))

    def of_rule(r: Column, new: Column) -> Column:
        return (
            F.when(F.coalesce(r["rule_id"], F.lit("")) == "", F.concat(head, F.lit(" has a rule with empty rule_id")))
            .when(~r["rule_id"].eqNullSafe(new), F.concat(head, F.lit(" has duplicate rule_id: "), r["rule_id"]))
            .when(F.coalesce(F.size(r["patterns"]), F.lit(0)) <= 0, F.concat(head, F.lit(" rule "), r["rule_id"], F.lit(" has no patterns")))
        )

    first = F.get(F.filter(F.zip_with(rules, distinct, of_rule), lambda x: x.isNotNull()), F.lit(0))
    reason = F.when(F.size(rules) == 0, F.concat(head, F.lit(" has no rules"))).otherwise(
        F.coalesce(first, F.when(F.coalesce(F.col("confidence_weight"), F.lit(0.0)) <= 0, F.concat(head, F.lit(" has non-positive confidence_weight"))))
    )
    return packets.select(*(keep or []), "packet_id", reason.alias("violation"))


def valid(rules: DataFrame) -> DataFrame:
    """FLT-1 without its wordings, over packets that are rows of rules: packet_id of the valid ones.

    rules: packet_id, confidence_weight (of the packet), rule_id, patterns; a packet without rules is one row of nulls. No
    packet is gathered into a row: the rules of an id are counted, so a packet can be of any size."""
    per_id = rules.groupBy("packet_id", F.coalesce("rule_id", F.lit("")).alias("rule_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.coalesce(F.size("patterns"), F.lit(0))).alias("patterns"), F.min(F.coalesce("confidence_weight", F.lit(0.0))).alias("weight")
    )
    sound = (F.col("rule_id") != "") & (F.col("n") == 1) & (F.col("patterns") > 0) & (F.col("weight") > 0)
    return per_id.groupBy("packet_id").agg(F.bool_and(sound).alias("sound")).where("sound").select("packet_id")


def missing_packets(expected: DataFrame, loaded: DataFrame) -> DataFrame:
    """JON-4: packet_id of the packets that are expected but weren't loaded (null is an id). If nothing could be loaded, all
    of them."""
    there = loaded.select(F.col("packet_id").alias("__there"))
    return expected.select("packet_id").distinct().join(there, F.col("packet_id").eqNullSafe(F.col("__there")), "left_anti")


def usable(loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT-1 at load: the valid packets of a scan in its order, and the path and reason of each skipped one."""
    at = "ord" if "ord" in loaded.columns else "packet_id"
    reasons = violation(loaded.where("skipped is null").select(F.col(at).alias("__at"), "packet_id", "rules", "confidence_weight"), keep=["__at"]).select("__at", "violation")
    checked = loaded.join(reasons, loaded[at] == reasons["__at"], "left").drop("__at").withColumn("skipped", F.coalesce("skipped", "violation")).drop("violation")
    return checked.where("skipped is null").drop("skipped"), checked.where("skipped is not null").select("path", F.col("skipped").alias("reason"))


def rule_winners(rules: DataFrame) -> DataFrame:
    """JON-2: rule_id and the packet that keeps it: the highest below FUSION_ID, else the highest."""
    low = F.max(F.when(F.col("packet_id") < FUSION_ID, F.col("packet_id")))
    return rules.groupBy("rule_id").agg(F.coalesce(low, F.max("packet_id")).alias("winner"))


def merge(packets: DataFrame) -> DataFrame:
    """SET-5: packets in order of their ids without the rules that another packet keeps; a packet may end up empty."""
    rules = packets.select("packet_id", F.posexplode_outer("rules").alias("pos", "rule"))
    kept = rules.where("rule is not null").withColumn("rule_id", F.col("rule.rule_id"))
    winner = rule_winners(kept)
    left = kept.join(winner, "rule_id").where("packet_id = winner").groupBy("packet_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "rule"))), lambda x: x["rule"]).alias("kept"))
    empty = F.array().cast(packets.schema["rules"].dataType)
    return packets.join(left, "packet_id", "left").withColumn("rules", F.coalesce("kept", empty)).drop("kept")


def prompt_block(packets: DataFrame) -> DataFrame:
    """AGG-11: packet_id and the block of a packet in the prompt."""

    def of_rule(r: Column) -> Column:
        return F.concat(
            F.lit("  ["), sanitize(r["rule_id"]), F.lit("] "), sanitize(r["name"]), F.lit(" ("), F.initcap(r["severity"]), F.lit(")\n  Patterns: "),
            sanitize(F.array_join(r["patterns"], ", ")), F.lit("\n  Explanation: "), sanitize(r["explanation"]),
        )

    block = F.concat(
        F.format_string("[RAG-PACKET %03d]\nCategory: ", F.col("packet_id")), sanitize("category"), F.lit("\n"), F.array_join(F.transform("rules", of_rule), "\n\n"), F.lit("\n[/RAG-PACKET]")
    )
    return packets.select("packet_id", block.alias("block"))


def prompt(packets: DataFrame) -> DataFrame:
    """AGG-11: the system prompt, one row; empty without packets. Packets are a dimension of at most 500 files."""
    blocks = F.array_sort(F.collect_list(F.struct("packet_id", "block")))
    return prompt_block(packets).agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n").alias("prompt"))


def pattern_hits(texts: DataFrame, patterns: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """JON-11: keys, pattern_id of each pattern that a text holds, literal and case-insensitive.

    patterns: pattern_id, pattern. One automaton finds all of them in one run over a text, instead of a comparison of each
    text with each pattern. More patterns than one automaton holds are cut into blocks of so many by their hash, and the
    texts are run through block by block."""
    usable = patterns.where("pattern is not null and pattern <> ''").select("pattern_id", F.lower("pattern").alias("pattern"))
    blocks = -(-usable.count() // PATTERNS) or 1
    if blocks > 1:
        usable = usable.withColumn("__b", F.pmod(F.xxhash64("pattern"), F.lit(blocks)))
        parts = [_hits(texts, usable.where(F.col("__b") == b), keys, text) for b in range(blocks)]
        return reduce(DataFrame.unionByName, parts)
    return _hits(texts, usable, keys, text)


def _hits(texts: DataFrame, patterns: DataFrame, keys: list[str], text: str) -> DataFrame:
    rows = [(r["pattern_id"], r["pattern"]) for r in patterns.collect()]  # at most about PATTERNS
    given = texts.sparkSession.sparkContext.broadcast(rows)
    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        by: dict[str, list] = {}
        for i, p in given.value:
            by.setdefault(p, []).append(i)
        automaton = ahocorasick.Automaton()
        for p, ids in by.items():
            automaton.add_word(p, ids)
        automaton.make_automaton()
        for c in batches:
            out = []
            for i, t in enumerate(c[text]):
                if t and by:
                    head = tuple(c[k][i] for k in keys)
                    out.extend((*head, p) for p in sorted({x for _, ids in automaton.iter(t.lower()) for x in ids}))
            yield out

    return map_rows(texts.select(*keys, text), run, f"{kinds}, pattern_id {patterns.schema['pattern_id'].dataType.simpleString()}")
