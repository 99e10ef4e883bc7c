"""Parent-child links to full hierarchies, by nested sets.

Subtree sizes are computed upwards, sizes give every sibling its share of a preorder range (prefix sums), and
ranges are handed down from the roots, so ``lo <= other.lo < hi`` tells descendants without any recursion.
Both directions go by pointer doubling: after round k a node knows the sum over its 2^k nearest levels and the
ancestor 2^k levels up, so a chain of a million nodes takes twenty rounds.  A round in which no node reaches a
root is the last: what is left then lies on cycles or hangs below one.

Leaves take part in neither direction: they are counted for their parent before the first round and read their
place from it after the last.  Joins on the parent go through ``skew.balanced_join`` and siblings are cut
into ranges of ids, so a parent of a third of all nodes is no task of its own.

Defined results: exact duplicate rows are one node; of several parents of one id the smallest non-null
one counts; a parent that is no node makes its child a root; null ids are no nodes; nodes that hang below
a cycle have no root, depth, path or range but a size; the size of a node on a cycle is that of all that hangs
on the cycle; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.skew import LoadPlan, balanced_join, plan_loads
from quern.session import cut

#: Preorder positions in one block of the search for descendants.
BLOCK = 256
#: Width of the id ranges in which siblings are summed up.
SIBLINGS = 65_536


def clean_links(rows: DataFrame, id: str, parent: str, label: str | None = None) -> DataFrame:
    """(id, parent, label): one row per id, parents that are no ids turned to null."""
    picked = rows.select(
        F.col(f"`{id}`").cast("long").alias("id"),
        F.col(f"`{parent}`").cast("long").alias("parent"),
        (F.col(f"`{label}`") if label else F.lit(None)).cast("string").alias("label"),
    ).where("id IS NOT NULL")
    nodes = cut(picked.groupBy("id").agg(F.min("parent").alias("parent"), F.min("label").alias("label")))
    kids = nodes.where("parent IS NOT NULL")
    ids = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_there"))
    sound = _lookup(kids, ids, "parent")
    return cut(nodes.where("parent IS NULL").unionByName(sound.select("id", F.when(F.col("_there"), F.col("parent")).alias("parent"), "label")))


def _inner_nodes(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes with ``leaf``, and the inner ones (id, parent, label, acc): acc counts the node and its leaves."""
    fan = links.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("_fan")).select(F.col("parent").alias("_p"), "_fan")
    nodes = cut(links.join(fan, F.col("id") == F.col("_p"), "left").select("id", "parent", "label", F.col("_fan").isNull().alias("leaf")))
    leaves = nodes.where("leaf AND parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("_n")).select(F.col("parent").alias("_p"), "_n")
    inner = nodes.where("NOT leaf").join(leaves, F.col("id") == F.col("_p"), "left")
    return nodes, cut(inner.select("id", "parent", "label", (F.coalesce("_n", F.lit(0)) + 1).alias("acc")))


def _lookup(rows: DataFrame, right: DataFrame, key: str, how: str = "left", plan: LoadPlan | None = None) -> DataFrame:
    return balanced_join(rows, right, plan or plan_loads(rows, [key]), F.col("id"), how, placed=False)


def _longer(pending: DataFrame, plan: LoadPlan) -> DataFrame:
    """Pointers twice as long, and the least id on the way; nodes whose pointer ends leave."""
    above = pending.select(F.col("id").alias("ptr"), F.col("ptr").alias("_next"), F.col("low").alias("_low"))
    met = _lookup(pending, above, "ptr", "inner", plan)
    kept = [c for c in pending.columns if c not in ("id", "ptr", "low", "moved")]
    return met.select("id", F.col("_next").alias("ptr"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("moved"), *kept)


def _climb(inner: DataFrame, sizes: bool) -> tuple[list[DataFrame], DataFrame]:
    """What every round adds to sizes (id, add), and (id, ptr, low) of nodes that never reach a root."""
    pending = inner.where("parent IS NOT NULL").select("id", F.col("parent").alias("ptr"), F.least("id", "parent").alias("low"), *(["acc"] if sizes else []))
    plan, adds = plan_loads(pending, ["ptr"]), []
    while plan.total:
        longer = _longer(pending, plan).drop("moved")
        if sizes:
            adds.append(pending.groupBy("ptr").agg(F.sum("acc").alias("add")).withColumnRenamed("ptr", "id"))
            longer = longer.join(adds[-1], "id", "left").withColumn("acc", F.col("acc") + F.coalesce("add", F.lit(0))).drop("add")
        pending = cut(longer)
        before, plan = plan.total, plan_loads(pending, ["ptr"])
        if plan.total == before:
            break
    return adds, pending.select("id", "ptr", "low")


def _rings(endless: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, cycle_id) of the nodes on cycles, and of all inner nodes on or below one.

    Pointers grow until they reach no fewer nodes than before, which are then just the nodes on cycles, and until
    no least id changes, which is then that of the cycle for those nodes.
    """
    size = endless.agg(F.count_distinct("ptr")).first()[0]
    while size:
        endless = cut(_longer(endless, plan_loads(endless, ["ptr"])))
        before, got = size, endless.agg(F.count_distinct("ptr").alias("n"), F.count_if("moved").alias("moved")).first()
        size = got["n"]
        if size == before and not got["moved"]:
            break
    on = endless.select(F.col("ptr").alias("id")).distinct()
    ring = cut(endless.join(on, "id", "left_semi").select("id", F.col("low").alias("cycle_id")))
    of = _lookup(endless.select("id", "ptr"), ring.withColumnRenamed("id", "ptr"), "ptr").select("id", "cycle_id")
    return ring, of


def cycles(links: DataFrame) -> DataFrame:
    """(cycle_id, id) of every node on a cycle; cycle_id is the smallest id on it. ``links``: of clean_links."""
    _, inner = _inner_nodes(links)
    ring, _ = _rings(_climb(inner, False)[1])
    return ring.select("cycle_id", "id")


def _offsets(kids: DataFrame) -> DataFrame:
    """(id, offset): sizes of the siblings with smaller ids; two steps, so no parent's children meet in one task."""
    kids = kids.withColumn("_b", F.floor(F.col("id") / SIBLINGS))
    per = kids.groupBy("parent", "_b").agg(F.sum("size").alias("_s"))
    sums = Window.partitionBy("parent").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("parent", "_b", F.coalesce(F.sum("_s").over(sums), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("parent", "_b").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    within = kids.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return within.join(before, ["parent", "_b"]).select("id", (F.col("_base") + F.col("_in")).alias("offset"))


def _descend(inner: DataFrame) -> DataFrame:
    """(id, root, depth, path, lo) of inner nodes that a root reaches. ``inner``: id, parent, label, step."""
    done = inner.where("parent IS NULL").select("id", F.col("id").alias("root"), F.lit(1).cast("long").alias("depth"), F.col("label").alias("path"), F.lit(0).cast("long").alias("lo"))
    pending = inner.where("parent IS NOT NULL").select("id", F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("d"), "label", "step")
    while True:
        plan = plan_loads(pending, ["ptr"])
        if not plan.total:
            return done
        none = F.lit(None)
        above = done.select(F.col("id").alias("ptr"), "root", F.col("depth").alias("_d"), F.col("path").alias("_l"), F.col("lo").alias("_s"), none.cast("long").alias("_next"))
        above = above.unionByName(pending.select("ptr", none.cast("long").alias("root"), F.col("d").alias("_d"), F.col("label").alias("_l"), F.col("step").alias("_s"), F.col("ptr").alias("_next"), "id").drop("ptr").withColumnRenamed("id", "ptr"))
        met = cut(
            _lookup(pending, above, "ptr", "inner", plan).select(
                "id", F.col("_next").alias("ptr"), "root", (F.col("d") + F.col("_d")).alias("d"), F.concat("_l", F.lit("/"), "label").alias("label"), (F.col("step") + F.col("_s")).alias("step")
            )
        )
        done = done.unionByName(met.where("ptr IS NULL").select("id", "root", F.col("d").alias("depth"), F.col("label").alias("path"), F.col("step").alias("lo")))
        pending = met.where("ptr IS NOT NULL").drop("root")


def hierarchy(links: DataFrame) -> DataFrame:
    """Per node: root, depth (roots: 1), path of labels, preorder range [lo, hi) within its root, size, cycle_id.

    ``size`` counts the node itself; ``size - 1`` is the number of descendants. ``links``: of clean_links.
    """
    nodes, inner = _inner_nodes(links)
    adds, endless = _climb(inner, True)
    ring, of = _rings(endless)
    of = cut(of)
    sized = inner.select("id", F.col("acc").alias("n"))
    for a in adds:
        sized = sized.unionByName(a.select("id", F.col("add").alias("n")))
    sized = sized.groupBy("id").agg(F.sum("n").alias("size"))
    # What hangs on a cycle: its inner nodes with their leaves.
    whole = of.join(inner.select("id", "acc"), "id").groupBy("cycle_id").agg(F.sum("acc").alias("_whole"))
    ring = ring.join(whole, "cycle_id")
    label = F.coalesce("label", F.lit(""))
    full = cut(
        nodes.join(sized, "id", "left").join(ring, "id", "left").select(
            "id", "parent", "leaf", label.alias("label"), F.coalesce("_whole", "size", F.lit(1)).cast("long").alias("size"), "cycle_id"
        )
    )
    kids = full.where("parent IS NOT NULL AND cycle_id IS NULL").select("id", "parent", "size")
    full = cut(full.join(_offsets(kids), "id", "left"))
    reached = full.where("NOT leaf").join(of.select("id"), "id", "left_anti")
    top = cut(_descend(cut(reached.select("id", "parent", "label", (F.col("offset") + 1).alias("step")))))
    # Leaves, and what hangs below a cycle, read their place from the parent.
    rest = full.where("leaf AND parent IS NOT NULL").select("id", "parent", "label", "offset", "size", "cycle_id")
    over = top.select(F.col("id").alias("parent"), "root", F.col("depth").alias("_d"), F.col("path").alias("_path"), F.col("lo").alias("_lo"))
    low = _lookup(rest, over, "parent").select(
        "id", "parent", "root", (F.col("_d") + 1).alias("depth"), F.concat("_path", F.lit("/"), "label").alias("path"), (F.col("_lo") + 1 + F.col("offset")).alias("lo"), "size", "cycle_id"
    )
    alone = full.where("leaf AND parent IS NULL").select("id", "parent", F.col("id").alias("root"), F.lit(1).cast("long").alias("depth"), F.col("label").alias("path"), F.lit(0).cast("long").alias("lo"), "size", "cycle_id")
    high = full.where("NOT leaf").join(top, "id", "left").select("id", "parent", "root", "depth", "path", "lo", "size", "cycle_id")
    every = high.unionByName(low).unionByName(alone)
    return every.select("id", "parent", "root", "depth", "path", "lo", (F.col("lo") + F.col("size")).alias("hi"), "size", "cycle_id")


def descendants(tree: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(ancestor, id) for every node below the nodes of ``of(id)`` (default: all), from nested ranges.

    Ranges are cut into blocks of ``BLOCK`` positions, so a join task holds a block of a tree, never a whole one.
    """
    placed = tree.where("root IS NOT NULL").select("id", "root", "lo", "hi")
    top = placed.where(F.col("hi") - F.col("lo") > 1)
    if of is not None:
        top = top.join(of.select("id").distinct(), "id", "left_semi")
    block = lambda at: F.floor(at / BLOCK)
    spans = top.select(F.col("id").alias("ancestor"), F.col("root").alias("_root"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.explode(F.sequence(block(F.col("lo") + 1), block(F.col("hi") - 1))).alias("_b"))
    inside = placed.withColumn("_block", block(F.col("lo")))
    hit = inside.join(spans, (F.col("root") == F.col("_root")) & (F.col("_block") == F.col("_b")) & (F.col("lo") > F.col("_lo")) & (F.col("lo") < F.col("_hi")))
    return hit.select("ancestor", "id")
