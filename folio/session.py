"""Session helpers shared by every operator: table access, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where the session names none (tests on one machine) is one made."""
    named = spark.sparkContext.getConf().get(CHECKPOINT) or spark.conf.get(CHECKPOINT, None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT} to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folio-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: computed once, and whole if an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """A scan of fewer parts than half the cores, spread over all of them before work on its texts. Such a table is a few
    small files; larger ones, which have parts enough, stay as they are, and so does what was shuffled (whose parts could
    be counted only by running it). scan: what df was made of by maps and filters, where df itself holds joins."""
    given = df if scan is None else scan
    if "Exchange" in given._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * given.rdd.getNumPartitions() <= cores else df


#: Keys that occur more than once are broadcast up to so many.
FEW_KEYS = 200_000


def first_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key (nulls are a key), where rows of a key are copies of each other.

    The keys that occur more than once are counted first, which moves keys alone. If they prove to be few, their rows are
    told by file and place, and all but the first are left out where they lie; no other column is moved. Else, and for
    tables that aren't read from files, the table is deduplicated whole."""
    again = cut(df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"))
    n = again.limit(FEW_KEYS + 1).count()
    if n == 0:
        return df
    if n > FEW_KEYS:
        return df.dropDuplicates(keys)
    try:
        placed = df.select("*", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).alias("__at"))
        placed.schema  # noqa: B018
    except AnalysisException:
        return df.dropDuplicates(keys)
    names = [f"__k{i}" for i in range(len(keys))]
    again = again.toDF(*names)

    def same(rows: DataFrame, small: DataFrame):
        out = F.lit(True)
        for k, x in zip(keys, names):
            out = out & rows[k].eqNullSafe(small[x])
        return out

    narrow = placed.select(*keys, "__at")
    first = narrow.join(F.broadcast(again), same(narrow, again)).groupBy(*names).agg(F.min("__at").alias("__first"))
    kept = placed.join(F.broadcast(first), same(placed, first), "left").where(F.col("__first").isNull() | (F.col("__first") == F.col("__at")))
    return kept.select(*df.columns)


def build_session(app: str = "folio", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use. Its shared folder is removed at the end."""
    folder = tempfile.mkdtemp(prefix="folio-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config(CHECKPOINT, folder)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
