"""Numeric operators on columns: penalties and the integer budgets, all saturating at zero. Null in, null out, unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import col

#: Fixed values of the budgets: tokens of a prompt's fixed part, of a generation, of a fold's fixed part; floors; defaults.
PROMPT, GENERATION, FOLD_PROMPT = 6800, 2048, 512
CHAPTER_FLOOR, FOLD_FLOOR, CONTEXT_FLOOR, CONTEXT_STEP = 1024, 512, 2048, 2048
DEFAULT_CONTEXT, RESERVE_MB, TOKENS_PER_MB = 16384, 300, 16
PENALTY, PENALTY_SHARE = 0.1, 0.30
TIMEOUT_S, STARTUP_S, STARTUP_GB_S = 600, 120, 15


def div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("long")


def less(a: Column, b: Column | int) -> Column:
    """a - b, not below 0."""
    return F.greatest(a - b, F.lit(0).cast("long"))


def penalised(score: Column | str, false_positives: Column | str) -> Column:
    """NUM-1: a tenth off for each false positive, at most 30 %; without any the score stays, even if negative."""
    s, n = col(score), F.coalesce(col(false_positives), F.lit(0))
    return F.when(n == 0, s).otherwise(F.greatest(s - F.least(PENALTY * n, PENALTY_SHARE * s), F.lit(0.0)))


def chapter_budget(context: Column | str) -> Column:
    """NUM-2: tokens a chapter may have."""
    c = col(context).cast("long")
    return F.greatest(less(less(less(c, PROMPT), GENERATION), div(c * 10, 100)), F.lit(CHAPTER_FLOOR).cast("long"))


def right_sized_context(largest: Column | str, system: Column | str, configured: Column | str) -> Column:
    """NUM-3: the context the largest chapter needs with a tenth to spare, in whole steps, within what is configured."""
    x = col(largest) + col(system) + GENERATION
    need = x + div(x * 10, 100)
    steps = div(need + CONTEXT_STEP - 1, CONTEXT_STEP) * CONTEXT_STEP
    return F.greatest(F.least(steps, col(configured)), F.lit(CONTEXT_FLOOR).cast("long"))


def fold_budget(context: Column | str) -> Column:
    """NUM-4: tokens a fold may hold; twice as many bytes."""
    c = col(context).cast("long")
    return F.greatest(less(less(less(c, FOLD_PROMPT), GENERATION), div(c * 10, 100)), F.lit(FOLD_FLOOR).cast("long"))


def throttle(pct: Column | str) -> Column:
    """A throttle percentage within 25..100; 75 if null."""
    return F.least(F.greatest(F.coalesce(col(pct), F.lit(75)), F.lit(25)), F.lit(100)).cast("long")


def throttled(amount: Column | str, pct: Column | str, least: int = 0) -> Column:
    """NUM-10: the share of an amount a throttle leaves."""
    return F.greatest(div(col(amount) * throttle(pct), 100), F.lit(least).cast("long"))


def effective_context(user: Column | str, native: Column | str, hardware: Column | str) -> Column:
    """NUM-5, AGG-5, NUM-12: the least of the limits that are known, the default for the user's, never below the floor."""
    user = F.coalesce(col(user), F.lit(DEFAULT_CONTEXT)).cast("long")
    return F.greatest(F.least(user, col(native), col(hardware)), F.lit(CONTEXT_FLOOR).cast("long"))


def layers(blocks: Column | str, size_mb: Column | str) -> Column:
    return F.coalesce(col(blocks), F.greatest(div(col(size_mb), 512), F.lit(16).cast("long")))


def vram_context(vram_mb: Column | str, size_mb: Column | str, blocks: Column | str) -> Column:
    """NUM-6: the context that fits beside a quarter of the layers; null if a size is unknown."""
    n, size, vram = layers(blocks, size_mb), col(size_mb), col(vram_mb)
    per_layer = div(size, n + 2)
    reserve = F.least(F.greatest(div(n, 4), F.lit(8).cast("long")), n) * per_layer
    kv = less(less(vram, reserve), RESERVE_MB)
    fits = F.greatest(div(kv * TOKENS_PER_MB, CONTEXT_STEP) * CONTEXT_STEP, F.lit(CONTEXT_FLOOR).cast("long"))
    return F.when((size > 0) & (vram > 0), fits)


def gpu_layers(vram_mb: Column | str, size_mb: Column | str, blocks: Column | str, context: Column | str) -> Column:
    """NUM-7: how many layers fit with the context's share kept free; 0 if a size is unknown."""
    n, size, vram = layers(blocks, size_mb), col(size_mb), col(vram_mb)
    usable = less(vram, F.greatest(div(col(context), TOKENS_PER_MB), F.lit(500).cast("long")) + RESERVE_MB)
    per_layer = div(size, n + 2)
    fit = F.when(per_layer > 0, F.least(div(usable, F.greatest(per_layer, F.lit(1).cast("long"))), n)).otherwise(n)
    return F.coalesce(F.when((size > 0) & (vram > 0), fit), F.lit(0).cast("long"))


def inference_timeout(cpu_share: Column | str, context: Column | str) -> Column:
    """NUM-8: seconds an inference may take."""
    return F.floor(TIMEOUT_S * (1 + 4 * col(cpu_share)) * F.greatest(col(context) / 8192, F.lit(1.0))).cast("long")


def startup_timeout(size_bytes: Column | str) -> Column:
    """NUM-9: seconds a start may take."""
    return (STARTUP_S + STARTUP_GB_S * div(col(size_bytes), 1 << 30)).cast("long")


def backoff_ms(attempt: Column | str, rate_limited: Column | None = None) -> Column:
    """STR-9: the pause before an attempt; 15 s more after a rate limit."""
    a = col(attempt)
    wait = F.when(a >= 1, F.lit(500) * F.pow(F.lit(2), F.least(a, F.lit(6))).cast("long")).otherwise(F.lit(0)).cast("long")
    return wait if rate_limited is None else wait + F.when(rate_limited, 15000).otherwise(0)
