"""Problem 7: one mix of several sources at target shares of the tokens, by pivotal dependent rounding.

The size of the mix is the largest at which every source can give its share without passing its cap: the least of
max_repeats * tokens / share over the sources that have tokens. Each document of a source then has the same expected
number of copies; the whole part is taken outright and the fraction is rounded at random, but dependently: two
documents of fractions p and q and sizes a and b pass mass to each other (a * p + b * q stays) until one of them is 0
or 1, and the other goes on, from large documents to small ones. So the tokens of a source miss its share by less than
one document, mostly a small one.

A source is rounded in buckets of a bounded number of documents, and what each bucket leaves over (at most one
document) is rounded in the same way up a reduction tree, so a source with a third of all rows is no single task.

Results: documents of sources without a target, with a null source, or without tokens take no part (a document of no
tokens has no size to mix). A target without documents keeps its row in p7_shares, with 0 tokens. Repeated target rows
count once; targets with a null or non-positive share or a cap below 1 count as absent.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.bpe import TOKENIZERS, count_tokens
from folio.session import cut, table

#: Documents of a bucket, and leftovers of a node of the tree: bounds of one task's group.
BUCKET = 20_000
FAN_IN = 2_000
SEED = 7
EPS = 1e-9
ROUNDED = "doc_id long, source string, n_tokens long, whole long, extra double, bucket long"


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """p with all but at most one entry moved to 0 or 1, each keeping its expectation, sum(p * size) kept exactly."""
    p = p.copy()
    draws = rng.random(len(p))
    hold = -1
    for j in range(len(p)):
        if not EPS < p[j] < 1 - EPS:
            p[j] = round(p[j])
            continue
        if hold < 0:
            hold = j
            continue
        i, a, b = hold, size[hold], size[j]
        up = min((1 - p[i]) * a, p[j] * b)  # mass that i can take from j
        down = min(p[i] * a, (1 - p[j]) * b)  # mass that j can take from i
        moved = up if draws[j] * (up + down) < down else -down
        p[i] += moved / a
        p[j] -= moved / b
        for k in (i, j):
            if p[k] < EPS or p[k] > 1 - EPS:
                p[k] = round(p[k])
        open_ = [k for k in (i, j) if 0 < p[k] < 1]
        hold = open_[0] if open_ else -1
    return p


def _round_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
    seed = zlib.crc32(f"{pdf.source.iloc[0]}|{pdf.bucket.iloc[0]}|{len(pdf)}|{SEED}".encode())
    pdf["extra"] = pivot(pdf.extra.to_numpy(float), pdf.n_tokens.to_numpy(float), np.random.default_rng(seed))
    return pdf


def targets_of(targets: DataFrame) -> DataFrame:
    """One valid row per source."""
    return (
        targets.where("source is not null and target_share > 0 and max_repeats >= 1 and not isnan(target_share)")
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.max("max_repeats").cast("long").alias("max_repeats"))
    )


def mix(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, source, n_tokens, copies of every document that takes part in the mix."""
    wanted = targets_of(targets)
    small = F.broadcast if _small(wanted) else lambda x: x  # measured once
    sized = count_tokens(documents.join(small(wanted), "source", "left_semi").where("text is not null"), ["doc_id", "source"], folder=folder)
    sized = cut(sized.where("n_tokens > 0"))
    sources = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).join(wanted, "source")
    total = sources.select((F.col("max_repeats") * F.col("tokens") / F.col("target_share")).alias("t"), "target_share").agg(F.min("t"), F.sum("target_share")).first()
    per_source = sources.select(
        "source",
        "max_repeats",
        F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET)).alias("buckets"),
        F.least(F.col("max_repeats"), F.lit(total[0] or 0.0) * F.col("target_share") / F.col("tokens")).alias("expected"),
    )
    # sources number at most the rows of the targets, whose size was checked
    items = sized.join(small(per_source), "source").select(
        "doc_id",
        "source",
        "n_tokens",
        F.floor(F.col("expected") + EPS).alias("whole"),
        F.greatest(F.lit(0.0), F.col("expected") - F.floor(F.col("expected") + EPS)).alias("extra"),
        F.pmod(F.xxhash64("doc_id"), "buckets").alias("bucket"),
    )
    fixed, rest, buckets = None, items, int(per_source.agg(F.max("buckets")).first()[0] or 1)
    while True:
        rounded = cut(rest.groupBy("source", "bucket").applyInPandas(_round_group, ROUNDED))
        if buckets == 1:
            # what is left of a source at the root is one document: the nearer whole number keeps within its size
            fixed = rounded if fixed is None else fixed.unionByName(rounded)
            break
        done = rounded.where("extra = 0 or extra = 1")
        fixed = done if fixed is None else fixed.unionByName(done)
        rest = rounded.where("extra > 0 and extra < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        buckets = -(-buckets // FAN_IN)
    copies = (F.col("whole") + F.round("extra")).cast("long")
    return fixed.select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def _small(wanted: DataFrame, rows: int = 100_000) -> bool:
    """Whether the targets are few enough to broadcast."""
    return wanted.limit(rows + 1).count() <= rows


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: documents, copies and tokens in the mix, and the share reached."""
    wanted = targets_of(targets)
    got = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens")
    )
    total = got.agg(F.sum("tokens").alias("all_tokens"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("documents", "copies", "most_copies", "tokens")}
    # one row, by construction
    return wanted.join(got, "source", "left").withColumns(zero).join(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", *zero, F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share")
    )


def p7_mix(spark, sf_dir: str) -> DataFrame:
    """The mix: each document in it with the number of its copies."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark, sf_dir: str) -> DataFrame:
    """The shares the mix reaches."""
    targets = table(spark, sf_dir, "mix_targets")
    return shares(mix(table(spark, sf_dir, "documents"), targets), targets)
