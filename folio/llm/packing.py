"""Problem 4: filling containers of a fixed capacity with whole items, by best fit decreasing over a segment tree.

Items go in by decreasing size, each into the open container it leaves the least room in. The open containers are
leaves of a segment tree over remaining capacities, so the tightest one that fits is found in logarithmic time. An item
above the capacity is first divided, at character borders, into parts that fill containers, and its last part is packed
like any item.

Only keys and byte counts are moved, never texts. A run of many outputs is split by a hash of the item into groups of
about GROUP items, each packed for itself; best fit leaves at most one container of a group less than half full, so a
group wastes less than one container more.

Results: an output costs its UTF-8 bytes plus 2. Null and blank outputs take no part, repeated rows count once. An output
whose run has no manifest or no usable budget (null, or below MIN_BUDGET, in which no part would fit) has a null
container, part 0. Ties go by output_id.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import map_rows
from folio.session import cut, table

#: Items of a group at most about (a parameter of pack), and parts that the rows of a run are joined in.
GROUP, SALTS = 20_000, 32
EXTRA = 2
#: A container must hold a character of four bytes and the extra of a part.
MIN_BUDGET = 4 + EXTRA
BLANK = r"^[\s\p{Z}]*$"


class CapacityTree:
    """Multiset of open containers by remaining capacity, as counts in a segment tree over the values that occur."""

    def __init__(self, capacity: int):
        self.size = 1 << max(capacity, 1).bit_length()
        self.full: defaultdict[int, int] = defaultdict(int)  # only the nodes above values that occur
        self.open: defaultdict[int, list[int]] = defaultdict(list)

    def add(self, room: int, container: int) -> None:
        self.open[room].append(container)
        i = self.size + room
        while i:
            self.full[i] += 1
            i //= 2

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes the container with the least room of at least least: (room, container)."""
        i = self.size + least
        full = self.full.get
        if not full(i):
            while i > 1 and not (i % 2 == 0 and full(i + 1)):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if full(2 * i) else 2 * i + 1
        room = i - self.size
        container = self.open[room].pop()
        while i:
            self.full[i] -= 1
            i //= 2
        return room, container


def best_fit_decreasing(costs: list[int], capacity: int) -> list[int]:
    """The container of each item; items of a cost above the capacity aren't allowed."""
    tree, bins, out = CapacityTree(capacity), 0, [0] * len(costs)
    for i in sorted(range(len(costs)), key=lambda i: (-costs[i], i)):
        hit = tree.take(costs[i])
        room, container = hit or (capacity, bins)
        bins += hit is None
        out[i] = container
        tree.add(room - costs[i], container)
    return out


def divide(text: str, budget: int) -> list[tuple[int, int]]:
    """Byte ranges of the parts of a text of more than budget - EXTRA bytes, cut between characters."""
    raw, most, out, at = text.encode(), budget - EXTRA, [], 0
    while at < len(raw):
        to = min(len(raw), at + most)
        while to < len(raw) and raw[to] & 0xC0 == 0x80:
            to -= 1
        out.append((at, to))
        at = to
    return out


PART = "output_id long, run_id string, book_id long, budget long, groups long, part_no int, byte_start long, byte_end long, cost long"
PACKED = "run_id string, container string, output_id long, part_no int, byte_start long, byte_end long, cost long, budget long"


def parts(outputs: DataFrame, manifests: DataFrame, group: int | None = None) -> DataFrame:
    """The items to pack, with the number of groups of their run: whole outputs, and the parts of those above their run's
    budget.

    Runs are joined by (run_id, salt), so no task holds a large run, and nothing that grows with the runs is broadcast."""
    group = group or GROUP
    budgets = manifests.where("run_id is not null").groupBy("run_id").agg(F.max("fold_budget_bytes").alias("budget"))
    rows = outputs.where(F.col("text").isNotNull() & ~F.col("text").rlike(BLANK)).select("output_id", "run_id", "book_id", F.octet_length("text").cast("long").alias("bytes"), "text")
    # the texts stay behind: only sizes go through these joins, and they are written down, as they are read twice
    narrow = cut(rows.select("output_id", "run_id", "book_id", "bytes").dropDuplicates(["output_id"]))
    usable = F.when(F.col("budget") >= MIN_BUDGET, F.col("budget"))
    # at most so many items: each output, and one more for every budget its run's bytes fill
    items = F.col("n") + F.coalesce(F.col("total") / (usable - EXTRA), F.lit(0.0))
    sums = narrow.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total"))
    runs = sums.join(budgets.hint("merge"), "run_id").select("run_id", usable.alias("budget"), F.ceil(items / group).alias("groups"))
    salted = runs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    given = cut(narrow.withColumn("part", F.pmod(F.xxhash64("output_id"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["run_id", "part"], "left").drop("part"))
    over = F.coalesce(F.col("bytes") + EXTRA > F.col("budget"), F.lit(False))
    zero = F.lit(0).cast("long")
    whole = given.where(~over).select("output_id", "run_id", "book_id", "budget", "groups", F.lit(0).alias("part_no"), zero.alias("byte_start"), F.col("bytes").alias("byte_end"), (F.col("bytes") + EXTRA).alias("cost"))
    # only texts above the least budget can be above their own
    least = budgets.where(F.col("budget") >= MIN_BUDGET).agg(F.min("budget")).first()[0] or 0
    texts = rows.where(F.col("bytes") + EXTRA > least).select("output_id", "text").dropDuplicates(["output_id"])
    large = given.where(over).join(texts.hint("merge"), "output_id")

    def run(batches):
        for c in batches:
            out = []
            for o, r, b, w, g, t in zip(c["output_id"], c["run_id"], c["book_id"], c["budget"], c["groups"], c["text"]):
                out.extend((o, r, b, w, g, k, s, e, e - s + EXTRA) for k, (s, e) in enumerate(divide(t, w)))
            yield out

    return whole.unionByName(map_rows(large.select("output_id", "run_id", "book_id", "budget", "groups", "text"), run, PART))


def _pack(batches):
    """Groups lie one behind the other in a partition, sorted; a group is bounded by GROUP."""
    group: list[tuple] = []

    def packed() -> list[tuple]:
        bins = best_fit_decreasing([x[6] for x in group], group[0][7])
        return [(x[0], f"{x[1]}-{b}", *x[2:]) for x, b in zip(group, bins)]

    for c in batches:
        out: list[tuple] = []
        for row in zip(*(c[k] for k in ("run_id", "salt", "output_id", "part_no", "byte_start", "byte_end", "cost", "budget"))):
            if group and group[0][:2] != row[:2]:
                out.extend(packed())
                group = []
            group.append(row)
        yield out
    if group:
        yield packed()


def pack(outputs: DataFrame, manifests: DataFrame, group: int | None = None) -> DataFrame:
    """run_id, container, output_id, part_no, byte_start, byte_end, cost, budget of each item."""
    group = group or GROUP
    items = cut(parts(outputs, manifests, group))
    spark = outputs.sparkSession
    # a given number of tasks: small rows would be merged into one task, which then packs all runs
    tasks = max(spark.sparkContext.defaultParallelism, -(-items.count() // (4 * group)))
    salted = items.where("budget is not null").withColumn("salt", F.pmod(F.xxhash64("output_id", "part_no"), "groups"))
    placed = salted.select("run_id", "salt", "output_id", "part_no", "byte_start", "byte_end", "cost", "budget").repartition(tasks, "run_id", "salt")
    packed = map_rows(placed.sortWithinPartitions("run_id", "salt", "output_id", "part_no"), _pack, PACKED)
    none = items.where("budget is null").select("run_id", F.lit(None).cast("string").alias("container"), "output_id", "part_no", "byte_start", "byte_end", "cost", "budget")
    return packed.unionByName(none)


def fill(packed: DataFrame) -> DataFrame:
    """Containers, bytes used and unused of each run."""
    per = packed.where("container is not null").groupBy("run_id", "container").agg(F.sum("cost").alias("used"), F.max("budget").alias("budget"), F.count(F.lit(1)).alias("items"))
    return per.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("used_bytes"), F.sum(F.col("budget") - F.col("used")).alias("unused_bytes")
    )


def p4_containers(spark, sf_dir: str) -> DataFrame:
    """The container of every distinct non-blank output of a run."""
    return pack(table(spark, sf_dir, "model_outputs"), table(spark, sf_dir, "manifests"))


def p4_fill(spark, sf_dir: str) -> DataFrame:
    """How full the containers of each run are."""
    return fill(p4_containers(spark, sf_dir))


def p4_found(spark, sf_dir: str) -> DataFrame:
    """The outputs that the packing had to divide."""
    return p4_containers(spark, sf_dir).groupBy("output_id").agg(F.max("part_no").alias("last")).where("last > 0").select("output_id")


P4_FOUND_SQL = """
SELECT DISTINCT o.output_id FROM model_outputs o
JOIN (SELECT run_id, max(fold_budget_bytes) AS budget FROM manifests GROUP BY run_id) m USING (run_id)
WHERE octet_length(encode(o.text)) + 2 > m.budget AND trim(o.text) <> ''
"""
