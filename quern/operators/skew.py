"""Per-key work where a few keys hold most rows: fragment-replicate by estimated load.

``plan_loads`` counts rows per hash slot, looks into the slots that are too full for the keys that fill them,
bin-packs slots and keys to ``tasks`` bins by load (longest first) and cuts keys larger than their fair share
into proportionate shards.  ``place`` sends every row to the partition its bin names; what follows groups and
joins by the bin too, so Spark keeps that placement and shuffles nothing again.  ``balanced_join`` copies the
matching side to exactly the shards of a large key, ``per_key_counts`` merges the results of shards.

Both passes of the estimate are combined on the map side: a task sends at most ``SLOTS`` counters in the first
and the keys of the over-full slots in the second.  To the driver come the counters and at most
``1 / large_share`` large keys, whatever the number of rows or keys.

Defined results: a null key is a key like any other; ties in load are broken by key hash; repeated rows
count in the estimate but, where a row column is named, once in the result; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import shuffle_width

#: Hash slots that stand for the small keys in the bin packing.
SLOTS = 4096


def _constants(values: list[int], kind: str) -> Column:
    """An array of constants, folded into one literal when the plan is optimised."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


@dataclass
class LoadPlan:
    """Where keys go: ``bins[slot]`` for small keys, ``shards[key hash] = [bin, ...]`` for large ones."""

    keys: list[str]
    tasks: int
    total: int
    bins: list[int]
    shards: dict[int, list[int]] = field(default_factory=dict)

    def hash(self) -> Column:
        return F.xxhash64(*[F.col(f"`{k}`") for k in self.keys])

    def slot(self) -> Column:
        return F.pmod(self.hash(), F.lit(SLOTS))

    def is_large(self) -> Column:
        return F.array_contains(_constants(sorted(self.shards), "bigint"), self.hash()) if self.shards else F.lit(False)

    def shard_count(self) -> Column:
        """Number of shards of a row's key (1 for small keys)."""
        if not self.shards:
            return F.lit(1)
        hashes = sorted(self.shards)
        counts = F.map_from_arrays(_constants(hashes, "bigint"), _constants([len(self.shards[h]) for h in hashes], "int"))
        return F.coalesce(F.element_at(counts, self.hash()), F.lit(1))

    def shard(self, spread: Column) -> Column:
        """The shard of a row, by the hash of ``spread``; 0 for small keys."""
        return F.pmod(F.xxhash64(spread, F.lit(17)), self.shard_count()).cast("int")

    def bin(self, shard: Column) -> Column:
        """The bin of a row in ``shard``."""
        small = F.get(_constants(self.bins, "int"), self.slot().cast("int"))
        if not self.shards:
            return small
        hashes = sorted(self.shards)
        starts = [0]
        for h in hashes:
            starts.append(starts[-1] + len(self.shards[h]))
        first = F.element_at(F.map_from_arrays(_constants(hashes, "bigint"), _constants(starts[:-1], "int")), self.hash())
        return F.coalesce(F.get(_constants([b for h in hashes for b in self.shards[h]], "int"), first + shard), small)


def plan_loads(rows: DataFrame, keys: list[str], tasks: int | None = None, large_share: float | None = None) -> LoadPlan:
    """Estimate loads and pack them. ``large_share``: keys above it are cut into shards."""
    tasks = tasks or shuffle_width(rows.sparkSession)
    large_share = large_share or 1.0 / (2 * tasks)
    plan = LoadPlan(keys, tasks, 0, [0] * SLOTS)
    slots = {r.s: r.n for r in rows.groupBy(plan.slot().alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    plan.total = sum(slots.values())
    limit = max(1.0, plan.total * large_share)
    # A large key overfills its slot, so only keys of such slots need to be told apart.
    full = sorted(s for s, n in slots.items() if n > limit)
    large = []
    if full:
        counts = rows.where(plan.slot().isin(full)).groupBy(plan.hash().alias("h")).agg(F.count(F.lit(1)).alias("n"))
        large = [(r.h, r.n) for r in counts.where(F.col("n") > limit).collect()]
    for h, n in large:
        slots[h % SLOTS] -= n
    fair = max(1.0, plan.total / tasks)
    pieces: list[tuple[float, str, int]] = [(n, "slot", s) for s, n in slots.items()]
    for h, n in large:
        cuts = max(1, min(tasks, round(n / fair * 2)))
        pieces += [(n / cuts, "key", h)] * cuts
    heap = [(0.0, b) for b in range(tasks)]
    for n, kind, k in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        load, b = heapq.heappop(heap)
        heapq.heappush(heap, (load + n, b))
        if kind == "slot":
            plan.bins[k] = b
        else:
            plan.shards.setdefault(k, []).append(b)
    return plan


def place(rows: DataFrame, plan: LoadPlan, spread: Column) -> DataFrame:
    """Rows with ``__q_shard`` and ``__q_bin``, each in the partition its bin names.

    Group and join by ``__q_bin`` as well, and the placement is kept.
    """
    out = rows.withColumn("__q_shard", plan.shard(spread)).withColumn("__q_bin", plan.bin(F.col("__q_shard")))
    return out.repartitionById(plan.tasks, F.col("__q_bin"))


def per_key_counts(rows: DataFrame, plan: LoadPlan, distinct: str, row: str | None = None) -> DataFrame:
    """Rows and distinct values of ``distinct`` per key; with ``row``, rows of equal ``row`` and value count once.

    Small keys are whole in their bin and done there. Large keys are spread by ``row`` (else by the value);
    the results of their shards, counted per value first, are merged by one further shuffle.
    """
    keys = [F.col(f"`{k}`") for k in plan.keys]
    names = ["__q_bin", *plan.keys, "__q_shard"]
    value, unit = F.col(f"`{distinct}`").alias("__q_v"), F.col(f"`{row or distinct}`").alias("__q_u")

    def counted(part: DataFrame, large: bool) -> DataFrame:
        placed = place(part.select(*keys, value, *([unit] if row else [])), plan, F.col("__q_u" if row else "__q_v"))
        by = [F.col(f"`{n}`") for n in names]
        if row:
            placed = placed.groupBy(*by, "__q_v", "__q_u").agg(F.lit(1).cast("long").alias("__q_1"))
        each = placed.groupBy(*by, "__q_v").agg(F.count(F.lit(1)).alias("__q_n"))
        if large and row and row != distinct:
            each = each.groupBy(*keys, "__q_v").agg(F.sum("__q_n").alias("__q_n"))
            by = keys
        out = each.groupBy(*by).agg(F.sum("__q_n").alias("calls"), F.count("__q_v").alias("__q_d"))
        if large:
            out = out.groupBy(*keys).agg(F.sum("calls").alias("calls"), F.sum("__q_d").alias("__q_d"))
        return out.select(*keys, "calls", F.col("__q_d").alias("distinct_" + distinct))

    if not plan.shards:
        return counted(rows, False)
    return counted(rows.where(~plan.is_large()), False).unionByName(counted(rows.where(plan.is_large()), True))


def balanced_join(left: DataFrame, right: DataFrame, plan: LoadPlan, spread: Column, how: str = "left", placed: bool = True) -> DataFrame:
    """Equi-join on the plan's keys: left rows spread over shards, right rows copied to those shards only.

    Keys match null-safe. ``how``: left, inner, left_semi or left_anti; for the latter two ``right`` has one row
    per key. ``right`` columns that clash with left ones are dropped. Both sides are placed in the same bins, so
    the join itself shuffles nothing. Without ``placed`` Spark deals keys and shards to tasks by hash and may choose
    fewer tasks, which suits the many small joins of iterative operators.
    """
    copies = right.select(
        *[F.col(f"`{k}`") for k in plan.keys],
        *([F.col(f"`{c}`") for c in right.columns if c not in left.columns and c not in plan.keys] if how in ("left", "inner") else []),
        F.lit(True).alias("__q_met"),
        F.explode(F.sequence(F.lit(0), plan.shard_count() - 1)).alias("__q_rs"),
    )
    if placed:
        copies = copies.withColumn("__q_rb", plan.bin(F.col("__q_rs"))).repartitionById(plan.tasks, F.col("__q_rb"))
    copies = copies.withColumnsRenamed({k: f"__q_r{i}" for i, k in enumerate(plan.keys)})
    rows = place(left, plan, spread) if placed else left.withColumn("__q_shard", plan.shard(spread))
    on = [F.col("__q_shard") == F.col("__q_rs")] + [F.col("__q_bin") == F.col("__q_rb")] * placed
    on += [F.col(f"`{k}`").eqNullSafe(F.col(f"__q_r{i}")) for i, k in enumerate(plan.keys)]
    joined = rows.join(copies, on, "inner" if how in ("inner", "left_semi") else "left")
    if how == "left_anti":
        joined = joined.where("__q_met IS NULL")
    return joined.drop("__q_shard", "__q_bin", "__q_rs", "__q_rb", "__q_met", *[f"__q_r{i}" for i in range(len(plan.keys))])
