"""Sources: rule packets, manifests, text and page files, weight-file headers, listings. All read distributed.

Malformed input is data here: readers return a reason beside each record that can't be used, instead of failing."""

from __future__ import annotations

import os
import struct
from importlib import resources

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import GRAPHIC, collapse_spacing, looks_sane, shifted_alphabet, spacing_density
from folio.operators.arrow import map_rows
from folio.operators.repair import byte_shift
from folio.session import cut

MAX_PACKETS, MAX_PACKET_BYTES = 500, 10_485_760
#: Density of single characters from which a text is spaced out.
SPACED_OUT = 0.40
PACKET = (
    "packet_id int, category string, description string, version string, "
    "rules array<struct<rule_id: string, name: string, pattern_type: string, patterns: array<string>, severity: string, explanation: string>>, "
    "hit_conditions struct<min_pattern_matches: int, confidence_weight: double>, model_behavior struct<inject_as: string, priority: int>"
)
MANIFEST = (
    "manifest_version string, engine_version string, run_id string, timestamp string, "
    "source_pdf struct<filename: string, hash_sha256: string, page_count: bigint>, mode string, "
    "models struct<model1: struct<name: string, path: string, active: boolean>, model2: struct<name: string, path: string, active: boolean>, "
    "model3: struct<name: string, path: string, active: boolean>, fusion: struct<name: string, path: string, active: boolean>>, "
    "rag_packets_used map<string, array<string>>, categories_active array<string>, resource_throttle struct<throttle_pct: bigint>, "
    "partial_run struct<model_failures: array<string>, failed_chunks: array<string>, fusion_partial: boolean>, notes string"
)


def packets(spark: SparkSession, *folders: str) -> DataFrame:
    """SRC-1, SRC-2, FLT-5: packets of the *.json right in each folder: ord (by folder as given, then by path), path,
    skipped (the reason of one that is too large or malformed) and the packet's fields.

    A folder that is missing or holds none gives no rows; without any folder the table is empty. More than MAX_PACKETS
    files in a folder is a ValueError (the scan is refused, as files that many are no packets)."""
    out = None
    for layer, folder in enumerate(folders):
        try:
            # the reader is checked when it is made: a missing folder shows here
            listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
        except AnalysisException:
            continue
        if listed.select("path").limit(MAX_PACKETS + 1).count() > MAX_PACKETS:
            raise ValueError(f"more than {MAX_PACKETS} packet files")
        rows = _parsed(listed.select("path", "length", F.when(F.col("length") <= MAX_PACKET_BYTES, F.col("content").cast("string")).alias("text")), layer)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = _parsed(spark.createDataFrame([], "path string, length long, text string"), 0)
    ranked = W.orderBy("layer", "path")  # at most MAX_PACKETS rows a folder
    return out.withColumn("ord", F.row_number().over(ranked) - 1).drop("layer")


def _parsed(files: DataFrame, layer: int) -> DataFrame:
    parsed = files.select(F.lit(layer).alias("layer"), "path", "length", F.from_json("text", PACKET).alias("p"))
    needed = F.col("p.packet_id").isNotNull() & F.col("p.category").isNotNull() & F.col("p.rules").isNotNull() & F.col("p.hit_conditions.confidence_weight").isNotNull()
    reason = F.when(F.col("length") > MAX_PACKET_BYTES, "too large").when(~F.coalesce(needed, F.lit(False)), "malformed")
    return parsed.select("layer", "path", reason.alias("skipped"), "p.*", F.col("p.hit_conditions.confidence_weight").alias("confidence_weight"))


def bundled_packets(spark: SparkSession) -> DataFrame:
    """SRC-3: the packets that come with the package, in the form of a scan."""
    folder = resources.files("folio.resources") / "packets"
    rows = [(f.name, len(t), t) for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".json") for t in [f.read_text("utf-8")]]
    return _parsed(spark.createDataFrame(rows, "path string, length long, text string"), 0).withColumn("ord", F.row_number().over(W.orderBy("path")) - 1).drop("layer")


def seed_packets(spark: SparkSession, folder: str) -> None:
    """SRC-3: the bundled packets written to a folder, one file each, over what is there."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in (resources.files("folio.resources") / "packets").iterdir():
        if f.name.endswith(".json"):
            stream = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{f.name}"), True)
            stream.write(bytearray(f.read_bytes()))
            stream.close()


def manifest_json(c: Column) -> Column:
    """SRC-7: a manifest from JSON; null if it isn't one."""
    parsed = F.from_json(c, MANIFEST)
    return F.when(parsed["run_id"].isNotNull() & parsed["manifest_version"].isNotNull(), parsed)


def embedded_manifest(info: Column, attachment: Column) -> Column:
    """SRC-8: struct(manifest, failed): the base64 value if there is one, else the attached JSON. A value that can't be
    read is a failure and doesn't fall through."""
    from_info = manifest_json(F.try_to_binary(F.trim(info), F.lit("base64")).cast("string"))
    value = F.when(info.isNotNull(), from_info).otherwise(manifest_json(attachment))
    failed = (info.isNotNull() | attachment.isNotNull()) & value.isNull()
    return F.struct(value.alias("manifest"), failed.alias("failed"))


def form_feed_pages(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """SRC-4: key, page_idx, text of the pages between form feeds, normalised, empty ones left out."""
    from folio.functions.text import normalize

    pages = F.filter(F.transform(F.split(text, "\f"), normalize), lambda x: x != "")
    return texts.select(key, F.posexplode(pages).alias("page_idx", "text"))


def extract(candidates: DataFrame, key: str) -> DataFrame:
    """SRC-6: key, text and failed of each document of candidates (key, primary, fallback: extractions, either may be null):
    the first that reads like text; else the first there is, with its characters moved back (byte shift), or with its
    spaced-out characters closed up and then moved back; else failed."""
    rows = candidates.select(key, "primary", "fallback")
    best = rows.withColumn("text", F.coalesce(F.when(looks_sane("primary"), F.col("primary")), F.when(looks_sane("fallback"), F.col("fallback"))))
    best = cut(best.withColumn("garbled", F.when(F.col("text").isNull(), F.coalesce("primary", "fallback"))).drop("primary", "fallback"))
    bad = best.where("garbled is not null").select(key, "garbled")
    spaced = bad.select(key, F.when(spacing_density("garbled") >= SPACED_OUT, collapse_spacing("garbled")).otherwise(F.col("garbled")).alias("closed"))
    first = byte_shift(bad, key, "garbled").withColumnRenamed("shift", "s1")
    second = byte_shift(spaced, key, "closed").withColumnRenamed("shift", "s2")
    tables = F.array(*[F.lit(shifted_alphabet(k)) for k in range(1, 256)])

    def moved(text: str, shift: str):
        return F.call_function("translate", F.col(text), F.lit(GRAPHIC), F.element_at(tables, F.col(shift).cast("int")))

    whole = best.join(first, key, "left").join(second, key, "left").join(spaced, key, "left")
    text = F.coalesce("text", F.when(F.col("s1").isNotNull(), moved("garbled", "s1")), F.when(F.col("s2").isNotNull(), moved("closed", "s2")))
    return whole.select(key, text.alias("text")).withColumn("failed", F.col("text").isNull())


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: path, text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-10, SRC-13: repo (parent folder), filename, size of files under a folder; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    parts = F.split("path", "/")
    return rows.select(F.element_at(parts, -2).alias("repo"), F.element_at(parts, -1).alias("filename"), F.col("length").alias("size"))


def remote_listing(rows: DataFrame) -> DataFrame:
    """SRC-12: repo, filename, size, sha256 from the rows of a listing (size, oid and an lfs struct); without a size, none."""
    return rows.select(
        "repo", "filename", F.coalesce("size", "lfs.size").alias("size"), F.coalesce("lfs.sha256", "lfs.oid").alias("sha256")
    ).where("size is not null")


#: Bytes of the fixed-size value types of a weight-file header, by type number; 8 is a string, 9 an array (fixed values).
SIZES = {0: 1, 1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 1, 10: 8, 11: 8, 12: 8}
MAX_STRING = 1_000_000


def header_value(data: bytes, suffix: str) -> int | None:
    """SRC-11: the first 32-bit value whose key ends in .suffix; None if the header isn't readable."""
    at = 24

    def string() -> bytes:
        nonlocal at
        (n,) = struct.unpack_from("<Q", data, at)
        if n > MAX_STRING:
            raise ValueError
        at += 8 + n
        return data[at - n : at]

    def skip(kind: int) -> None:
        nonlocal at
        if kind == 8:
            string()
        elif kind == 9:
            inner, n = struct.unpack_from("<IQ", data, at)
            at += 12
            for _ in range(n):
                skip(inner)
        else:
            at += SIZES[kind]

    try:
        magic, version, _, pairs = struct.unpack_from("<4sIQQ", data, 0)
        if magic != b"GGUF" or version not in (2, 3):
            return None
        for _ in range(pairs):
            key = string().decode("utf-8", "replace")
            (kind,) = struct.unpack_from("<I", data, at)
            at += 4
            if key.endswith("." + suffix) and kind == 4:
                return struct.unpack_from("<I", data, at)[0]
            skip(kind)
    except (struct.error, ValueError, KeyError, IndexError):
        return None
    return None


#: Bytes of a file that are read for its header, doubled while the header goes on behind them.
HEAD_BYTES = 1 << 20


def headers(files: DataFrame) -> DataFrame:
    """SRC-11: path, context_length, block_count from weight files (path, on a file system that all executors mount).

    Only the head of a file is read, in the task, and more of it only while the header goes on; contents of gigabytes are
    never loaded. A file that can't be read has null values."""

    def head(path: str, suffixes: tuple[str, ...]) -> tuple:
        name, n = path.removeprefix("file://").removeprefix("file:"), HEAD_BYTES
        try:
            size = os.path.getsize(name)
            while True:
                with open(name, "rb") as f:
                    data = f.read(n)
                found = tuple(header_value(data, s) for s in suffixes)
                if None not in found or len(data) >= size or data[:4] != b"GGUF":
                    return found
                n *= 2
        except OSError:
            return (None,) * len(suffixes)

    def run(batches):
        for c in batches:
            yield [(p, *head(p, ("context_length", "block_count"))) for p in c["path"] if p is not None]

    return map_rows(files.select("path"), run, "path string, context_length long, block_count long")
