"""The general training-data operators against brute force and on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import hierarchy as H
from quern.operators import incremental as I
from quern.operators import orphans as O
from quern.operators import skew as S

FILES = "id long, path string, content_hash string, last_indexed long"
LEDGER = "entry_id long, run_id int, path string, content_hash string, _k string"
RUNS = "run_id int, status string"


def found(spark, files, ledger, runs):
    current = I.latest_by(spark.createDataFrame(files, FILES), "path", "last_indexed")
    state = I.state_from_ledger(spark.createDataFrame(ledger, LEDGER), spark.createDataFrame(runs, RUNS))
    return sorted(r.id for r in I.changed_records(current, state, "path").collect())


def test_changed_records(spark):
    files = [
        (1, "a", "AA", 5), (1, "a", "AA", 5), (1, "a", "old", 4),  # late and repeated rows of an unchanged path
        (2, "b", "bb", 1),  # changed
        (3, "c", "cc", None),  # never committed
        (4, "d", None, 2),  # hash gone
        (5, None, "ee", 2),  # null key, unknown
    ]
    ledger = [(1, 1, "a", "xx", "?"), (2, 3, "a", "aa", "?"), (3, 4, "a", "zz", "?"), (4, 3, "b", "b0", None), (5, 4, "c", "cc", None), (6, 3, "d", "dd", None)]
    runs = [(1, "committed"), (3, "Committed"), (4, "failed"), (5, None)]
    assert found(spark, files, ledger, runs) == [2, 3, 4, 5]
    assert found(spark, files, [], []) == [1, 2, 3, 4, 5]
    assert found(spark, [], ledger, runs) == []


def test_clashing_columns(spark):
    current = spark.createDataFrame([("a", "1", 5, "x", 1), ("b", "2", 6, "y", 2)], "path string, content_hash string, _k int, _known string, _shard int")
    state = spark.createDataFrame([("a", "1", 0), ("b", "0", 0)], "path string, content_hash string, _k int")
    assert [tuple(r) for r in I.changed_records(current, state, "path").collect()] == [("b", "2", 6, "y", 2)]
    plan = S.plan_loads(current, ["path"], 2)
    other = spark.createDataFrame([("a", 9, "w")], "path string, _shard int, _rs string")
    assert S.balanced_join(current, other, plan, F.col("_k")).where("_rs = 'w'").count() == 1


PAIR = "path string, content_hash string"


def test_state_store_is_exactly_once(spark, tmp_path):
    store = I.StateStore(spark, str(tmp_path), "path", merge_after=2)
    one = spark.createDataFrame([("a", "1"), ("b", "2")], PAIR)
    run = store.pending(one)
    assert run.rows.count() == 2
    # a run that fails before its commit leaves everything pending
    run = store.pending(one)
    assert run.rows.count() == 2 and store.commit(run) == 1
    assert store.commit(run) == 1  # repeated after a lost answer
    assert store.pending(one).rows.count() == 0
    two = spark.createDataFrame([("a", "1"), ("c", "3"), (None, "n")], PAIR)
    run = store.pending(two)
    assert sorted(str(r.path) for r in run.rows.collect()) == ["None", "c"]
    # a part that was written but never named is not in force
    assert store.version() == 1 and store.pending(two).rows.count() == 2
    store.commit(run)
    assert store.pending(one).rows.count() == 0  # b stays known
    run = store.pending(two, forget_missing=True)
    assert run.rows.count() == 0
    assert store.commit(run) == 3  # three parts are merged into one
    assert [r.path for r in store.pending(one).rows.collect()] == ["b"]
    assert store.clear(1, older_than_seconds=-5) > 0 and store.version() == 3
    assert sorted(str(r.path) for r in store.load().collect()) == ["None", "a", "c"]


def test_state_store_keeps_the_snapshot(spark, tmp_path):
    store, source = I.StateStore(spark, f"{tmp_path}/s", "path"), f"{tmp_path}/source"
    spark.createDataFrame([("a", "1"), ("b", "2")], PAIR).write.parquet(source)
    run = store.pending(spark.read.parquet(source))
    spark.createDataFrame([("a", "19"), ("b", "29")], PAIR).write.mode("overwrite").parquet(source)
    assert {(r.path, r.content_hash) for r in run.rows.collect()} == {("a", "1"), ("b", "2")}
    store.commit(run)
    again = store.pending(spark.read.parquet(source))
    assert {(r.path, r.content_hash) for r in again.rows.collect()} == {("a", "19"), ("b", "29")}


def test_state_store_of_two_committers(spark, tmp_path):
    store = I.StateStore(spark, str(tmp_path), "path")
    first, second = (store.pending(spark.createDataFrame([(k, "1")], PAIR)) for k in "xy")
    store.commit(first)
    with pytest.raises(I.StaleState):
        store.commit(second)
    with pytest.raises(I.StaleState):  # the number is taken, even if the version was read before
        store._publish(1, [second.part], "string")
    assert [r.path for r in store.load().collect()] == ["x"]
    late = store.pending(spark.createDataFrame([("y", "1")], PAIR))
    store.commit(late)
    assert sorted(r.path for r in store.load().collect()) == ["x", "y"]


def brute_counts(rows):
    out = {}
    for name, caller in rows:
        out.setdefault(name, []).append(caller)
    return {k: (len(v), len({c for c in v if c is not None})) for k, v in out.items()}


@pytest.mark.parametrize("tasks", [1, 4, 7])
def test_skewed_counts_match_brute_force(spark, tasks):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else None if rng.random() < 0.3 else f"k{rng.randrange(60)}", rng.choice([None, *range(40)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "name string, caller long")
    plan = S.plan_loads(df, ["name"], tasks)
    assert tasks == 1 or max(map(len, plan.shards.values())) > 1
    got = {r.name: (r.calls, r.distinct_caller) for r in S.per_key_counts(df, plan, "caller").collect()}
    assert got == brute_counts(rows)
    placed = S.place(df, plan, F.col("caller")).withColumn("p", F.spark_partition_id()).groupBy("p").count()
    assert max(r["count"] for r in placed.collect()) <= (2.2 * len(rows) / tasks if tasks > 1 else len(rows))


def test_balanced_join_and_empty(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [("x", 1), (None, 2)], "k string, v long")
    right = spark.createDataFrame([("hot", "H", 9), (None, "N", 9), ("y", "Y", 9)], "k string, w string, v long")
    plan = S.plan_loads(left, ["k"], 4)
    out = S.balanced_join(left, right, plan, F.col("v"))
    assert out.columns == ["k", "v", "w"]
    assert out.count() == 502 and out.where("w = 'H'").count() == 500 and out.where("w = 'N'").count() == 1
    none = left.limit(0)
    assert S.per_key_counts(none, S.plan_loads(none, ["k"], 4), "v").count() == 0


def test_placement_is_kept(spark):
    left = spark.createDataFrame([(i, 7 if i < 300 else None if i < 500 else i) for i in range(600)], "id long, k long")
    plan = S.plan_loads(left, ["k"], 4)
    assert {len(b) for b in plan.shards.values()} == {3, 4}
    counted = S.per_key_counts(left.where(~plan.is_large()), S.LoadPlan(["k"], 4, 100, plan.bins), "id", row="id")
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the placement itself
    right = spark.createDataFrame([(7, "a"), (550, "b"), (-1, "c"), (None, "n")], "k long, w string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for placed in (True, False):
            out = S.balanced_join(left, right, plan, F.col("id"), placed=placed)
            assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
            assert out.count() == 600 and out.where("w = 'a'").count() == 300 and out.where("w = 'n'").count() == 200 and out.where("w IS NOT NULL").count() == 501
            assert S.balanced_join(left, right, plan, F.col("id"), "left_anti", placed).count() == 99
            assert S.balanced_join(left, right, plan, F.col("id"), "left_semi", placed).columns == ["id", "k"]
            assert S.balanced_join(left, right, plan, F.col("id"), "inner", placed).count() == 501
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_repeated_rows_count_once(spark):
    rows = [(i % 200, "hot" if i % 200 < 150 else f"k{i % 7}", i % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, name string, caller long")
    want = brute_counts([(n, c) for _, n, c in set(rows)])
    got = {r.name: (r.calls, r.distinct_caller) for r in S.per_key_counts(df, S.plan_loads(df, ["name"], 4), "caller", row="id").collect()}
    assert got == want


def brute_tree(parents):
    info, cycles = {}, {}
    for n in parents:
        path, at = [], n
        while at is not None and at in parents and at not in path:
            path.append(at)
            at = parents[at]
        if at is not None and at in path:
            ring = path[path.index(at):]
            if n in ring:
                cycles[n] = min(ring)
            info[n] = None
        else:
            info[n] = (path[-1], len(path), tuple(reversed(path)))
    return info, cycles


@pytest.mark.parametrize("hub", [False, True])
def test_hierarchy_matches_brute_force(spark, hub):
    rng = random.Random(8)
    n = 120
    parents = {i: rng.choice([None, *range(max(0, i - 6), i)]) if i else None for i in range(n)}
    parents[50], parents[51], parents[90] = 51, 50, 90  # a ring of two, and a node that is its own parent
    parents[7] = 10_000  # no such node
    if hub:  # one parent of two thirds of all nodes, and one below a cycle
        parents |= {i: 20 for i in range(200, 500)} | {i: 50 for i in range(500, 520)} | {520: 519, 521: 520}
    rows = [(i, p, f"n{i}") for i, p in parents.items()] + [(3, parents[3], "n3"), (None, 1, "x")]
    links = H.clean_links(spark.createDataFrame(rows, "id long, up long, name string"), "id", "up", "name")
    info, cycles = brute_tree({i: p if p in parents else None for i, p in parents.items()})
    whole = H.hierarchy(links).cache()
    tree = {r.id: r for r in whole.collect()}
    assert set(tree) == set(parents)
    assert {i: r.cycle_id for i, r in tree.items() if r.cycle_id is not None} == cycles
    assert {(r.cycle_id, r.id) for r in H.cycles(links).collect()} == {(c, i) for i, c in cycles.items()}
    for i, want in info.items():
        r = tree[i]
        if want is None:
            assert (r.root, r.depth, r.path, r.lo) == (None, None, None, None)
            continue
        assert (r.root, r.depth, r.path) == (want[0], want[1], "/".join(f"n{k}" for k in want[2]))
        below = {j for j, w in info.items() if w and i in w[2]}
        assert r.size == len(below)
        assert {j for j, o in tree.items() if o.root == r.root and r.lo <= (o.lo if o.lo is not None else -1) < r.hi} == below
    assert tree[50].size == tree[51].size == 2 + (22 if hub else 0) + sum(1 for i in range(52, 120) if info[i] is None and i != 90 and i not in cycles and climbs_to(parents, i, 50))
    some = spark.createDataFrame([(0,), (20,)], "id long")
    got = {(r.ancestor, r.id) for r in H.descendants(whole, some).collect()}
    every = {(r.ancestor, r.id) for r in H.descendants(whole).collect()}
    assert every == {(a, j) for j, w in info.items() if w for a in w[2] if a != j}
    assert got == {(a, j) for a in (0, 20) for j, w in info.items() if w and a in w[2] and j != a}


def climbs_to(parents, at, goal):
    for _ in range(len(parents)):
        if at == goal:
            return True
        at = parents.get(at)
    return False


def test_hierarchy_of_a_long_chain_and_a_hub(spark):
    n = 2_000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    hub = spark.range(n, 11 * n).select("id", F.when(F.col("id") > n, F.lit(n)).alias("up"))
    links = H.clean_links(chain.unionByName(hub), "id", "up")
    tree = H.hierarchy(links).drop("path").cache()
    assert tuple(tree.where(F.col("id") < n).agg(F.max("depth"), F.sum("depth"), F.sum("size"), F.sum("lo")).first()) == (n, n * (n + 1) // 2, n * (n + 1) // 2, n * (n - 1) // 2)
    low = tree.where(F.col("id") >= n)
    assert tuple(low.agg(F.max("depth"), F.max("size"), F.count_distinct("lo"), F.max("lo")).first()) == (2, 10 * n, 10 * n, 10 * n - 1)
    ring = spark.range(n).select("id", ((F.col("id") + 1) % n).alias("up"))
    assert tuple(H.cycles(H.clean_links(ring, "id", "up")).agg(F.count("id"), F.max("cycle_id")).first()) == (n, 0)


def test_hierarchy_edges(spark):
    empty = spark.createDataFrame([], "id long, up long")
    assert H.hierarchy(H.clean_links(empty, "id", "up")).count() == 0
    assert H.cycles(H.clean_links(empty, "id", "up")).count() == 0
    big = spark.createDataFrame([(2**60 + 1, 2**60 + 3), (2**60 + 3, None)], "id long, up long")
    tree = {r.id: r.depth for r in H.hierarchy(H.clean_links(big, "id", "up")).collect()}
    assert tree == {2**60 + 1: 2, 2**60 + 3: 1}  # ids keep every digit


SYMBOLS = "id long, file_id long, name string, parent_symbol_id long, text string"
RELATIONS = "id long, source_symbol_id long, target_symbol_name string, target_symbol_id long, file_id long, name string"


def orphan_tables(spark):
    symbols = spark.createDataFrame([(1, 10, "f", None, "x"), (1, 10, "f", None, "x"), (2, 10, "g", 1, None), (3, 11, "h", 2, ""), (4, 11, "f", 99, "")], SYMBOLS)
    late = spark.createDataFrame([(5, 10, "k", None)], "id long, file_id long, name string, parent_symbol_id long")
    events = spark.createDataFrame(
        [(1, 1, "deleted", 5), (2, 1, "restored", 6), (3, 2, "deleted", 9), (4, 2, "restored", 8), (5, 5, "deleted", 3), (6, 5, "restored", 3)],
        "event_id long, symbol_id long, action string, t long",
    ).withColumn("logged_at", F.timestamp_seconds("t"))
    files = spark.createDataFrame([(10, "./libs\\x\\a.py", 1700000000), (10, "libs/x/old.py", 5), (11, "libs/y/b.py", 1710000000)], "id long, relative_path string, last_indexed long")
    relations = spark.createDataFrame(
        [
            (100, 1, "f", 1, 10, ""), (100, 1, "f", 1, 10, ""),  # sound, twice
            (101, 2, "f", 1, 10, ""),  # source deleted
            (102, None, "zz", None, 10, ""),  # no source, name unknown
            (103, 3, "f", 2, 11, ""),  # target deleted
            (104, 3, "nope", 1, 11, ""),  # name differs
            (105, 3, "k", None, 10, ""),  # name of a late symbol of the package
            (106, 3, "k", None, 11, ""),  # of another package
            (107, 3, None, None, 99, ""),  # no name, unknown file
        ],
        RELATIONS,
    )
    return relations, symbols, late, events, files


def test_orphans(spark):
    relations, symbols, late, events, files = orphan_tables(spark)
    live = O.live_symbols(symbols, late, events)
    assert sorted(r.id for r in live.collect()) == [1, 3, 4, 5]
    got = {(r.relation_id, r.ref_field) for r in O.direct_orphans(O.distinct_references(relations), live, O.current_files(files)).collect()}
    assert got == {
        (101, "source_symbol_id"), (102, "source_symbol_id"), (102, "target_symbol_name"), (103, "target_symbol_id"),
        (104, "target_symbol_name"), (106, "target_symbol_name"), (107, "target_symbol_name"),
    }
    assert sorted(r.id for r in O.cascade(live).collect()) == [3, 4]
    # a chain of 100 below a missing record, a ring, and one sound record
    deep = [(i, 1, "n", i - 1) for i in range(1, 101)] + [(200, 1, "n", 201), (201, 1, "n", 200), (300, 1, "n", None), (301, 1, "n", 300)]
    assert sorted(r.id for r in O.cascade(spark.createDataFrame(deep, "id long, file_id long, name string, parent_symbol_id long")).collect()) == list(range(1, 101))
    report = {(r.ref_field, r.month): (r.direct, r.inherited) for r in O.orphan_report(relations, symbols, late, events, files).collect()}
    assert report[("source_symbol_id", "2024-03")] == (0, 3)  # 103, 104 and 106 come from below a dead symbol
    assert report[("target_symbol_id", "2024-03")] == (1, 0)
    assert report[("target_symbol_name", None)] == (1, 0)
    none = O.direct_orphans(O.distinct_references(relations.limit(0)), live, O.current_files(files.limit(0)))
    assert none.count() == 0
