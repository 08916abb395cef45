"""UDF-1: the boundary to a model. An analyzer takes prompts in batches and gives texts; the one shipped is lexical and
deterministic: it reports which patterns a text holds. It stands in for a language model and is not one."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.arrow import map_rows


class Analyzer(Protocol):
    """One output of each prompt. of(model), where there is one, is the analyzer of a model."""

    def __call__(self, prompts: Sequence[str]) -> list[str]: ...


class LexicalAnalyzer:
    """Lists the patterns, each with its count, that a prompt's text holds."""

    def __init__(self, patterns: Sequence[str]):
        self.patterns = sorted({p.lower() for p in patterns if p})

    def __call__(self, prompts: Sequence[str]) -> list[str]:
        out = []
        for p in prompts:
            low = p.lower()
            out.append("\n".join(f"- {w}: {n}" for w in self.patterns if (n := low.count(w))) or "No findings.")
        return out


def prompt(system: Column, text: Column) -> Column:
    """UDF-2: the system part, if there is one, and the text."""
    return F.concat_ws("\n\n", F.when(F.coalesce(system, F.lit("")) != "", system), text)


def analyze(texts: DataFrame, keys: list[str], analyzer: Analyzer, text: str = "text", model: str | None = None) -> DataFrame:
    """keys and output of every text that isn't null, batch by batch, by the analyzer of the model in that column (one of
    keys) if the analyzer tells models apart."""
    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for c in batches:
            at = [i for i, t in enumerate(c[text]) if t is not None]
            if model is None or not hasattr(analyzer, "of"):
                outputs = analyzer([c[text][i] for i in at])
                yield [(*(c[k][i] for k in keys), o) for i, o in zip(at, outputs)]
                continue
            for m in dict.fromkeys(c[model][i] for i in at):
                own = [i for i in at if c[model][i] == m]
                yield [(*(c[k][i] for k in keys), o) for i, o in zip(own, analyzer.of(m)([c[text][i] for i in own]))]

    return map_rows(texts.select(*keys, text), run, f"{kinds}, output string")


#: A log of at most so many lines is that of a start that failed (fixed value).
START_LINES = 6


def diagnosis(log: Column, size_mb: Column, vram_mb: Column, gpu: Column, empty: Column | None = None) -> Column:
    """UDF-3: why a run failed, from its log: memory; and where there was no output (empty): the first error line, a model
    larger than the memory with no layer on the GPU, a start that failed (a short log); else unknown."""
    low = F.lower(F.coalesce(log, F.lit("")))
    memory = low.rlike("out of memory|oom") & low.rlike("cuda|rocm|vulkan|ggml|alloc")
    line = F.get(F.filter(F.split(F.coalesce(log, F.lit("")), "\n"), lambda x: F.contains(F.lower(x), F.lit("error:"))), F.lit(0))
    # lines as they are counted: what follows the last line feed is one only if it holds anything
    text = F.coalesce(log, F.lit(""))
    n = F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n")))
    none = F.lit(True) if empty is None else empty
    return (
        F.when(memory, "out of memory")
        .when(none & line.isNotNull(), F.trim(line))
        .when(none & (size_mb > 0) & (vram_mb > 0) & (size_mb > vram_mb) & (gpu == 0), "model larger than memory")
        .when(none & (n <= START_LINES) & (size_mb > 0), "failed to start")
        .otherwise("unknown")
    )
