"""State that ordered events build up, without a state store where a window form is exact.

Order is by a unique integer sequence column. No task holds a whole key: what rows hand on goes through blocks (`ordered`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.ordered import automaton, carried, carried_all, running_counts

#: Kinds of errors and their classes, in the order of the kinds (fixed values); a kind is family, or family and member.
ERROR_CLASSES = {
    "ModelError.GpuError": "GpuFallback",
    "ModelError.Timeout": "Retryable",
    "ModelError.LoadFailure": "Recoverable",
    "ModelError.InferenceFailure": "PartialRun",
    "ModelError.IoError": "Recoverable",
    "ModelError.InvalidState": "Fatal",
    "RagError": "RagSkip",
    "PdfError": "Fatal",
    "ManifestError": "Fatal",
    "TimeoutError": "Retryable",
    "IoError": "Recoverable",
    "OptimizationError": "Recoverable",
    "UiError": "Recoverable",
    "UnknownError": "Fatal",
}
#: Members of the families that have any (fixed values).
ERROR_MEMBERS = {
    "ModelError": ("LoadFailure", "InferenceFailure", "Timeout", "GpuError", "IoError", "InvalidState"),
    "RagError": ("MalformedPacket", "MissingPacket", "ValidationFailure"),
    "PdfError": ("ParseFailure", "ExtractionFailure", "WriteFailure"),
    "ManifestError": ("Corruption", "ValidationFailure", "VersionMismatch", "IoError"),
    "OptimizationError": ("ScoringFailure", "ConsensusFailure"),
}
#: States of a model and the transitions it may make; any state may fail, and a failed one is unloaded (fixed values).
STATES = ("Unloaded", "Loading", "Loaded", "Inferencing", "Unloading", "Error")
TRANSITIONS = {
    ("Unloaded", "Loading"),
    ("Loading", "Loaded"),
    ("Loaded", "Inferencing"),
    ("Inferencing", "Loaded"),
    ("Loaded", "Unloading"),
    ("Inferencing", "Unloading"),
    ("Unloading", "Unloaded"),
    ("Error", "Unloaded"),
}
#: Stages of a run and how far it is at each (fixed values); models and chapters lie between the third and the fourth.
STAGES = {"IDLE": 0.0, "LOADING_PDF": 0.05, "CHUNKING": 0.10, "RUNNING_FUSION": 0.88, "OPTIMIZING": 0.94, "UPDATING_MANIFEST": 0.95, "WRITING_FINAL_PDF": 0.96, "COMPLETED": 1.0}
MODELS_FROM, MODELS_SHARE, LOADING, CHAPTERS_FROM, CHAPTERS_SHARE = 0.15, 0.70, 0.02, 0.05, 0.60
#: Seconds without growth after which output counts as whole (fixed value).
STALL_S = 15.0

#: Attempts of a class before the other action, and then again (fixed periods).
PERIODS = {"Recoverable": (2, "Retry", "MarkPartialRun"), "Retryable": (4, "Retry", "SkipModel")}
SINGLE = {"GpuFallback": "DowngradeGpu", "RagSkip": "SkipRagPacket", "PartialRun": "SkipChunk", "Fatal": "AbortRun"}


def classified(kind: Column, table: dict[str, str], other: str = "Fatal") -> Column:
    """STR-2: the class of a kind by a fixed table; other if it isn't in the table."""
    pairs = F.create_map(*[F.lit(x) for p in table.items() for x in p])
    return F.coalesce(F.element_at(pairs, kind), F.lit(other))


def error_kinds(spark) -> DataFrame:
    """PER-5: family, member, class of every kind of error; a family without members, or whose members share a class, has
    one class. A member that isn't in the table of classes has its family's."""
    rows = []
    families = list(dict.fromkeys(k.split(".")[0] for k in ERROR_CLASSES))
    for f in families:
        for m in ERROR_MEMBERS.get(f, (None,)):
            rows.append((f, m, ERROR_CLASSES.get(f"{f}.{m}", ERROR_CLASSES.get(f, "Fatal"))))
    return spark.createDataFrame(rows, "family string, member string, class string")


def error_class(kind: Column) -> Column:
    """STR-2: the class of a kind: of the family and member, else of the family, else Fatal."""
    family = F.substring_index(kind, ".", 1)
    pairs = F.create_map(*[F.lit(x) for p in ERROR_CLASSES.items() for x in p])
    return F.coalesce(F.element_at(pairs, kind), F.element_at(pairs, family), F.lit("Fatal"))


def recovery_actions(events: DataFrame, run: str, seq: str, error_class: str, reset: str = "GpuFallback") -> DataFrame:
    """STR-3: the action of every event. Counters of a run start again behind a reset event, so the count of a class less
    what it was at the last reset decides."""
    n = {c: f"__n_{c}" for c in PERIODS}
    rows = running_counts(events, run, seq, {n[c]: F.col(error_class) == c for c in PERIODS})
    at_reset = {f"__r_{c}": F.when(F.col(error_class) == reset, F.col(n[c])) for c in PERIODS}
    rows = carried_all(rows, run, seq, at_reset)
    action = F.element_at(F.create_map(*[F.lit(x) for p in SINGLE.items() for x in p]), F.col(error_class))
    for c, (period, often, last) in PERIODS.items():
        k = F.col(n[c]) - F.coalesce(f"__r_{c}", F.lit(0))
        action = F.when(F.col(error_class) == c, F.when(k % period != 0, often).otherwise(last)).otherwise(action)
    return rows.withColumn("action", action).select(*events.columns, "action")


def downgraded(setting: Column) -> Column:
    """STR-4: CPU for any other setting, null for CPU."""
    return F.when(F.upper(setting) != "CPU", "CPU")


def replay(events: DataFrame, key: str, seq: str, request: str, edges: set[tuple[str, str]] = TRANSITIONS, start: str = "Unloaded", anywhere: str = "Error", states: tuple[str, ...] | None = None) -> DataFrame:
    """STR-5, JON-10: key, seq, request, allowed, state of an ordered sequence of requested transitions: one that is no
    edge is rejected and leaves the state; a request of `anywhere` always holds. A null or unknown request is rejected."""
    known = list(states or dict.fromkeys([*STATES, start, anywhere, *(x for e in sorted(edges) for x in e)]))

    def step(state, r):
        ok = r == anywhere or (state, r) in edges
        state = r if ok else state
        return state, ok, state

    return automaton(events, key, seq, request, known, step, start, "allowed boolean, state string")


def carried_progress(events: DataFrame, run: str, seq: str, percent: str) -> DataFrame:
    """WIN-6: a fraction within (0, 1) is mapped to 20..95, any other repeats the last mapped one, first 15."""
    p = F.col(percent)
    return carried(events, run, seq, F.when((p > 0) & (p < 1), 20 + 75 * p), "shown").withColumn("shown", F.coalesce("shown", F.lit(15.0)))


def changed_percent(events: DataFrame, run: str, seq: str, percent: str) -> DataFrame:
    """WIN-7: the events at which the whole percentage changes; events without one are left aside."""
    rows = events.withColumn("pct", F.floor(F.col(percent) * 100))
    return carried(rows, run, seq, F.col("pct"), "__last", before=True).where("__last is null or __last <> pct").drop("__last")


def _quiet(samples: DataFrame, run: str, ts: str, size: str) -> DataFrame:
    """samples with us (time), changed (whether the size isn't that of the sample before) and since (us of the last change)."""
    rows = samples.withColumn("us", F.unix_micros(F.col(ts).cast("timestamp")))
    width = 3_600_000_000  # blocks of an hour
    rows = carried(rows, run, "us", F.col(size), "__before", width, before=True)
    rows = rows.withColumn("changed", F.col("__before").isNull() | (F.col("__before") != F.col(size)))
    return carried(rows, run, "us", F.when(F.col("changed"), F.col("us")), "since", width)


def stalls(samples: DataFrame, run: str, ts: str, size: str, seconds: float = STALL_S) -> DataFrame:
    """STR-6: run, ts, quiet_us of the samples at which the size hasn't changed for so many seconds."""
    rows = _quiet(samples, run, ts, size).withColumn("quiet_us", F.col("us") - F.col("since"))
    return rows.where(F.col("quiet_us") >= int(seconds * 1e6)).select(run, ts, "quiet_us")


def timeouts(samples: DataFrame, run: str, ts: str, size: str, startup_s: float, limit_s: float, stall_s: float = STALL_S) -> DataFrame:
    """STR-6: run, ts, verdict of the first sample that ends a run: complete (there is output, it stopped growing, and the
    startup is over), no output (none, for the length of the startup), too long (the limit is reached); in this order.
    A run that no sample ends has no row. An output starts at size 0, a run at its first sample."""
    start = samples.groupBy(run).agg(F.min(F.unix_micros(F.col(ts).cast("timestamp"))).alias("__start"))
    rows = _quiet(samples.withColumn(size, F.coalesce(size, F.lit(0))), run, ts, size).join(start, run)
    # the first sample of a run changes nothing unless it holds output
    quiet, age = F.col("us") - F.coalesce("since", F.col("__start")), F.col("us") - F.col("__start")
    still = ~F.col("changed") | ((F.col("us") == F.col("__start")) & (F.col(size) == 0))
    us = lambda x: int(x * 1e6)
    verdict = (
        F.when(still & (F.col(size) > 0) & (age >= us(startup_s)) & (quiet >= us(stall_s)), "complete")
        .when(still & (F.col(size) == 0) & (quiet >= us(startup_s)), "no output")
        .when(age >= us(limit_s), "too long")
    )
    ended = rows.withColumn("verdict", verdict).where("verdict is not null")
    return ended.groupBy(run).agg(F.min(F.struct("us", ts, "verdict")).alias("e")).select(run, F.col(f"e.{ts}").alias(ts), "e.verdict")


def stage_percent(stage: Column) -> Column:
    """STR-7: how far a run is at a stage; null at a stage that isn't fixed."""
    return F.element_at(F.create_map(*[F.lit(x) for p in STAGES.items() for x in p]), stage)


def model_percent(model: Column, models: Column) -> Column:
    """STR-7: how far a run is when model (from 0) of so many is fetched; LOADING more when it is loaded."""
    return MODELS_FROM + model / models * MODELS_SHARE


def chapter_percent(model: Column, models: Column, chapter: Column, chapters: Column) -> Column:
    """STR-7: how far a run is at a chapter (from 0) of a model."""
    return model_percent(model, models) + CHAPTERS_FROM + (chapter + 1) / chapters * CHAPTERS_SHARE / models


def error_record(ts: Column, error: Column, error_class: Column, action: Column) -> Column:
    """SNK-11: the record of an error in the error log."""
    return F.concat(F.lit("["), ts, F.lit("]\nERROR_CLASS: "), error_class, F.lit("\nERROR_TYPE: "), error, F.lit("\nACTION: "), action, F.lit("\n"))


def failures(events: DataFrame, run: str, model: str, chunk: str) -> DataFrame:
    """AGG-14: the distinct models and chunks that failed in a run, sorted."""
    return events.groupBy(run).agg(
        F.array_sort(F.collect_set(model)).alias("model_failures"), F.array_sort(F.collect_set(F.format_string("chunk_%03d", F.col(chunk)))).alias("failed_chunks")
    )


def complete_groups(rows: DataFrame, key: list[str], ok: str) -> DataFrame:
    """STR-8: the rows of the groups in which every row is ok."""
    good = rows.groupBy(*key).agg(F.bool_and(F.coalesce(F.col(ok), F.lit(False))).alias("__ok")).where("__ok").select(*key)
    return rows.join(good, key, "left_semi")
