"""Grouping vectors into similarity clusters.

Every partition builds cluster features (count, linear sum, least similarity to the centre) in one pass;
leaves are merged tree-wise: first with leaves that share a coarse cross-polytope hash, then along links
found with many finer ones.  Linked leaves are agglomerated by Ward's criterion as long as the merged
centre keeps its members together, and every vector is assigned once, through its leaf.

The groups only say which vectors to compare; the result does not depend on them.  The centres of all groups are
held against each other, once per pair; where the angles of the farthest members leave room for similar vectors,
the vectors of the wider group are held against the centre of the narrower one and visit it if they could be similar
to a member.  Members and visitors of a group are then compared exactly, in blocks of bounded size: a cluster is a
set of vectors that have just each other as similar vectors in the whole table.  No hash takes part in this; its work
grows with the square of the groups, but only centres of one byte per dimension are copied to the blocks.

Only leaf summaries travel between tasks; a group of similar vectors, however large, is reduced to few
leaves per partition before anything is shuffled.  Links between leaves are found by hashing, so the
search is near-linear; the recall is that of the hash tables (see ``TABLES``) and is tested.

Defined results: vectors that are null, of another length, all zero or hold NaN or infinities are in no
cluster; of several vectors of one symbol the least (by its values) counts; exact duplicate rows are one;
fewer than ``least`` members make no cluster; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut, shuffle_width

#: Similarity of members; similarity of a leaf to its members; link between leaf centres; hash tables of two rotations.
THRESHOLD, LEAF, LINK, TABLES = 0.8, 0.9, 0.76, 28
#: Members compared in one block of the verification; centres in one block of the search for near groups, at most; typical members reported.
SHARD, REACH, TYPICAL = 4096, 262144, 3
#: Least cosine that counts as similar, rounding included.
SIMILAR = THRESHOLD - 1e-6


def rotations(dim: int, count: int, seed: int = 5) -> np.ndarray:
    """Random orthonormal bases, shape (count, dim, dim)."""
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)]).astype(np.float32)


def polytope(x: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """Cross-polytope hashes: per basis the axis a vector is closest to, with its sign. Shape (n, count)."""
    out = np.empty((len(x), len(bases)), dtype=np.int64)
    for k, b in enumerate(bases):
        y = x @ b
        at = np.abs(y).argmax(axis=1)
        out[:, k] = at * 2 + (y[np.arange(len(x)), at] > 0)
    return out


class Features:
    """Cluster features of unit vectors: counts, linear sums; a leaf takes what is close to its centre."""

    def __init__(self, dim: int, limit: float = LEAF) -> None:
        self.limit, self.n = limit, 0
        self.count = np.zeros(64, dtype=np.int64)
        self.sums = np.zeros((64, dim), dtype=np.float64)
        self.centre = np.zeros((64, dim), dtype=np.float32)

    def _grow(self) -> None:
        self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.centre = np.concatenate([self.centre, np.zeros_like(self.centre)])

    def add(self, centres: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Put summaries (or single vectors) into leaves; returns the leaf of each."""
        leaf = np.full(len(centres), -1, dtype=np.int64)
        for lo in range(0, len(centres), 512):
            block = slice(lo, lo + 512)
            c = centres[block]
            if self.n:
                sim = c @ self.centre[: self.n].T
                best = sim.argmax(axis=1)
                ok = sim[np.arange(len(c)), best] >= self.limit
                leaf[block][ok] = best[ok]
                np.add.at(self.count, best[ok], counts[block][ok])
                np.add.at(self.sums, best[ok], sums[block][ok])
                self._centre(np.unique(best[ok]))
            todo = lo + np.nonzero(leaf[block] < 0)[0]
            # The rest of the block opens leaves, each taking along what is close to it.
            while len(todo):
                if self.n == len(self.count):
                    self._grow()
                near = centres[todo] @ centres[todo[0]] >= self.limit
                near[0] = True
                took = todo[near]
                leaf[took] = self.n
                self.count[self.n] = counts[took].sum()
                self.sums[self.n] = sums[took].sum(axis=0)
                self.n += 1
                self._centre(np.array([self.n - 1]))
                todo = todo[~near]
        return leaf

    def _centre(self, at: np.ndarray) -> None:
        if len(at):
            s = self.sums[at]
            self.centre[at] = s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-30)


def _matrix(column: pa.Array, dim: int, dtype=np.float32) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, dim)


def _lists(x: np.ndarray, kind=pa.float32()) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1), kind), x.shape[1]).cast(pa.list_(kind))


def _codes(x: np.ndarray) -> pa.Array:
    """Directions in one byte per dimension."""
    code = np.round(x * 127 / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30)).astype(np.int8)
    return pa.array([r.tobytes() for r in code], pa.binary())


def _decoded(column: pa.Array, dim: int, dtype=np.float32) -> np.ndarray:
    """The unit vectors of ``_codes``."""
    x = np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8).reshape(-1, dim).astype(dtype)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30).astype(dtype)


def _radius(low: np.ndarray) -> np.ndarray:
    """The angle of the farthest member, rounding included."""
    return np.arccos(np.clip(low - 1e-6, -1, 1))


def _room(angle: np.ndarray | float) -> np.ndarray:
    """Least cosine at which vectors so much wider apart than similar ones can be; -2 where any can."""
    angle = np.arccos(SIMILAR) + angle
    return np.where(angle < np.pi, np.cos(np.minimum(angle, np.pi)) - 1e-5, -2).astype(np.float32)


def unit_vectors(vectors: DataFrame, dim: int, id: str = "symbol_id", vector: str = "vector") -> DataFrame:
    """(id, v): one unit vector of ``dim`` finite numbers per id."""
    v = F.col(f"`{vector}`").cast("array<float>")
    sound = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    one = vectors.where(F.col(f"`{id}`").isNotNull() & v.isNotNull()).where(sound).groupBy(F.col(f"`{id}`").cast("long").alias("id")).agg(F.min(v).alias("v"))

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim, np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(x.astype(np.float32))], names=["id", "v"])

    return one.mapInArrow(scale, "id long, v array<float>")


def _leaves(units: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Per partition, leaves of its vectors: (id, v, leaf) and (leaf, count, sums)."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        tree = Features(dim)
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            at = tree.add(x, np.ones(len(x), dtype=np.int64), x.astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base + at)], names=["id", "v", "leaf"])

    assigned = cut(units.mapInArrow(assign, "id long, v array<float>, leaf long"))
    sums = assigned.groupBy("leaf").agg(F.count(F.lit(1)).alias("count"), F.array(*[F.sum(F.col("v")[k].cast("double")) for k in range(dim)]).alias("sums"))
    return assigned, sums


def _hashed(leaves: DataFrame, dim: int, bases: np.ndarray, per_table: int) -> DataFrame:
    """(leaf, count, sums, keys): one key per table of ``per_table`` rotations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _matrix(batch.column(2), dim, np.float64)
            c = (s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-30)).astype(np.float32)
            h = polytope(c, bases).reshape(len(c), -1, per_table)
            key = np.zeros(h.shape[:2], dtype=np.int64)
            for k in range(per_table):
                key = key * (2 * dim) + h[:, :, k]
            key += np.arange(key.shape[1]) * (2 * dim) ** per_table
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(key, pa.int64())], names=["leaf", "count", "sums", "keys"])

    return leaves.select("leaf", "count", "sums").mapInArrow(run, "leaf long, count long, sums array<double>, keys array<long>")


def _merge_near(leaves: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """One level of the reduction: leaves with the same coarse hash are merged where close.

    Returns (leaf, into) and the merged leaves. Within a hash, leaves are dealt to groups of bounded size.
    """
    hashed = _hashed(leaves, dim, rotations(dim, 1, seed=3), 1)
    width = shuffle_width(leaves.sparkSession)
    keyed = hashed.select("leaf", "count", "sums", F.col("keys")[0].alias("key"))
    loads = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / 20_000).alias("_groups"))
    keyed = keyed.join(loads, "key").withColumn("grp", F.pmod(F.xxhash64("leaf"), F.col("_groups")))

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("count", "descending"), ("leaf", "ascending")])
        s = _matrix(table["sums"], dim, np.float64)
        c = (s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-30)).astype(np.float32)
        ids = table["leaf"].to_numpy()
        counts = table["count"].to_numpy()
        tree = Features(dim)
        at = tree.add(c, counts, s)
        first = np.full(tree.n, -1, dtype=np.int64)
        for k in range(len(at) - 1, -1, -1):
            first[at[k]] = ids[k]
        return pa.table({"leaf": ids, "into": first[at], "count": counts, "sums": table["sums"]})

    merged = cut(
        keyed.repartition(width, "key", "grp").groupBy("key", "grp").applyInArrow(
            lambda t: merge(t.select(["leaf", "count", "sums"])), "leaf long, into long, count long, sums array<double>"
        )
    )
    new = merged.groupBy(F.col("into").alias("leaf")).agg(F.sum("count").alias("count"), F.array(*[F.sum(F.col("sums")[k]) for k in range(dim)]).alias("sums"))
    return merged.select("leaf", "into"), new


def _links(leaves: DataFrame, dim: int) -> DataFrame:
    """(a, b), a < b: leaves whose centres are within the link similarity, found in shared hash buckets."""
    keyed = _hashed(leaves, dim, rotations(dim, 2 * TABLES, seed=9), 2)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _matrix(batch.column(1), dim, np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), _codes(s), batch.column(2)], names=["leaf", "code", "keys"])

    # Centres travel as one byte per dimension; the margin between LINK and THRESHOLD covers the rounding.
    coded = keyed.select("leaf", "sums", "keys").mapInArrow(small, "leaf long, code binary, keys array<long>")
    spread = coded.select("leaf", "code", F.explode("keys").alias("key"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by key; a bucket is compared block by block, never as a whole."""
        held_key, ids, vecs = None, [], []

        def flush() -> tuple[np.ndarray, np.ndarray]:
            if len(ids) < 2:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            i = np.array(ids, dtype=np.int64)
            x = np.frombuffer(b"".join(vecs), dtype=np.int8).reshape(len(ids), dim).astype(np.float32)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            out_a, out_b = [], []
            for lo in range(0, len(i), 1024):
                for lo2 in range(lo, len(i), 1024):
                    a, b = np.nonzero(x[lo : lo + 1024] @ x[lo2 : lo2 + 1024].T >= LINK)
                    a, b = i[a + lo], i[b + lo2]
                    less = a < b
                    swap = (a > b) & (lo != lo2)
                    out_a += [a[less], b[swap]]
                    out_b += [b[less], a[swap]]
            return np.concatenate(out_a), np.concatenate(out_b)

        for batch in batches:
            # A bucket can go on through a whole batch; then there is nothing to tell yet.
            found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for leaf, code, key in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if key != held_key:
                    a, b = flush()
                    found_a.append(a)
                    found_b.append(b)
                    held_key, ids, vecs = key, [], []
                ids.append(leaf)
                vecs.append(code)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], names=["a", "b"])
        a, b = flush()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    sorted_rows = spread.repartition(shuffle_width(leaves.sparkSession), "key").sortWithinPartitions("key")
    return sorted_rows.mapInArrow(pairs, "a long, b long").distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp): smallest node reachable, by passing the least label along and jumping pointers."""
    both = cut(edges.selectExpr("a", "b").unionByName(edges.selectExpr("b AS a", "a AS b")))
    label = cut(nodes.selectExpr("node", "node AS comp"))
    while True:
        low = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("_low"))
        nxt = label.join(low, F.col("node") == F.col("a"), "left").select("node", F.least("comp", F.coalesce("_low", "comp")).alias("_c"), "comp")
        jump = nxt.select(F.col("node").alias("_n"), F.col("_c").alias("_j"))
        nxt = cut(nxt.join(jump, F.col("_c") == F.col("_n"), "left").select("node", F.least("_c", F.coalesce("_j", "_c")).alias("new"), "comp"))
        if nxt.where("new <> comp").isEmpty():
            return nxt.select("node", "comp")
        label = nxt.select("node", F.col("new").alias("comp"))


def ward(counts: np.ndarray, sums: np.ndarray, least: float = THRESHOLD) -> np.ndarray:
    """Agglomerate leaves by Ward's criterion while the two centres stay within ``least``; group of each leaf."""
    n = len(counts)
    group = np.arange(n)
    count, total, alive = counts.astype(float).copy(), sums.astype(float).copy(), np.ones(n, dtype=bool)
    while alive.sum() > 1:
        at = np.nonzero(alive)[0]
        mean = total[at] / count[at, None]
        square = (mean**2).sum(axis=1)
        distance = np.maximum(square[:, None] + square[None, :] - 2 * mean @ mean.T, 0)
        cost = distance * (count[at][:, None] * count[at][None, :]) / (count[at][:, None] + count[at][None, :])
        unit = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-30)
        cost[unit @ unit.T < least] = np.inf
        np.fill_diagonal(cost, np.inf)
        # All mutually nearest pairs merge at once; Ward's criterion is reducible, so the order does not matter.
        near = cost.argmin(axis=1)
        best = cost[np.arange(len(at)), near]
        pairs = [(i, j) for i, j in enumerate(near.tolist()) if i < j and near[j] == i and np.isfinite(best[i])]
        if not pairs:
            break
        for i, j in pairs:
            a, b = at[i], at[j]
            count[a] += count[b]
            total[a] += total[b]
            alive[b] = False
            group[group == b] = a
    return group


def ward_in_chunks(counts: np.ndarray, sums: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """Ward's agglomeration with memory for ``chunk`` squared distances: chunks of like hashes first, then their groups.

    Groups of different chunks may stay apart; their members still meet as visitors (``_visits``).
    """
    group = np.arange(len(counts))
    bases = rotations(sums.shape[1], 1, seed=3)
    while True:
        at = np.unique(group)
        if len(at) <= chunk:
            inner = [np.arange(len(at))]
        else:
            unit = sums[at] / np.maximum(np.linalg.norm(sums[at], axis=1, keepdims=True), 1e-30)
            order = np.argsort(polytope(unit.astype(np.float32), bases)[:, 0], kind="stable")
            inner = [order[lo : lo + chunk] for lo in range(0, len(order), chunk)]
        counts, sums, before = counts.copy(), sums.copy(), len(at)
        for part in inner:
            ids = at[part]
            local = ids[ward(counts[ids], sums[ids])]
            moved = ids != local
            np.add.at(counts, local[moved], counts[ids[moved]])
            np.add.at(sums, local[moved], sums[ids[moved]])
            lookup = dict(zip(ids[moved].tolist(), local[moved].tolist()))
            group = np.array([lookup.get(g, g) for g in group.tolist()])
        if len(inner) == 1 or len(np.unique(group)) == before:
            return group


def _near_groups(groups: DataFrame, dim: int) -> DataFrame:
    """(grp, to): pairs of groups that could hold vectors similar to each other, the wider group first.

    Two vectors are no more similar than the angle of their centres, less those of the farthest members, allows.
    Centres meet in blocks, every pair of blocks in one task; what is copied per block is the code of a centre.
    """
    n = groups.count()
    blocks = max(1, -(-n // REACH), min(8, -(-n // 2048)))
    dealt = groups.select("grp", "code", "low", F.pmod(F.xxhash64("grp"), F.lit(blocks)).cast("int").alias("_b"))
    every = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_o"))
    pairs = every.select("grp", "code", "low", "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        i, j = (table[c][0].as_py() for c in ("_i", "_j"))
        radius = _radius(table["low"].to_numpy())
        # By radius, so that the groups of a tile leave about as much room.
        order = np.argsort(radius, kind="stable")
        radius, grp, low, block = (c[order] for c in (radius, *(table[c].to_numpy() for c in ("grp", "low", "_b"))))
        x = _decoded(table["code"], dim)[order]
        a, b = np.nonzero(block == i)[0], np.nonzero(block == j)[0]
        xb = np.ascontiguousarray(x[b].T)
        for lo in range(0, len(a), 512):
            part = a[lo : lo + 512]
            for lo2 in range(lo - lo % 4096 if i == j else 0, len(b), 4096):
                other = b[lo2 : lo2 + 4096]
                near = x[part] @ xb[:, lo2 : lo2 + 4096]
                least = _room(radius[part[-1]] + radius[other[-1]])
                if near.max() < least:
                    continue
                at, to = np.nonzero(near >= least)
                cos, at, to = near[at, to], part[at], other[to]
                close = cos >= _room(radius[at] + radius[to])
                if i == j:
                    close &= at < to
                at, to = at[close], to[close]
                wider = (low[at] < low[to]) | ((low[at] == low[to]) & (grp[at] < grp[to]))
                yield pa.RecordBatch.from_arrays([pa.array(np.where(wider, grp[at], grp[to])), pa.array(np.where(wider, grp[to], grp[at]))], names=["grp", "to"])

    # More partitions than pairs of blocks, so that few share one.
    return pairs.repartition(blocks * (blocks + 1), "_i", "_j").groupBy("_i", "_j").applyInArrow(meet, "grp long, to long")


def _visits(members: DataFrame, groups: DataFrame, dim: int) -> DataFrame:
    """(id, v, grp): vectors and the other groups that could hold vectors similar to them.

    A vector similar to a member is no farther from the centre than the member and the angle of similarity
    together. Of two groups the wider one visits the narrower one; so every similar pair of different groups
    meets, once.
    """
    told = cut(_near_groups(groups, dim)).join(groups.select(F.col("grp").alias("to"), "code", "low"), "to")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = (_matrix(batch.column(1), dim) * _decoded(batch.column(3), dim)).sum(axis=1)
            visits = batch.filter(pa.array(cos >= _room(_radius(batch.column(4).to_numpy()))))
            yield pa.RecordBatch.from_arrays(visits.columns[:3], names=["id", "v", "grp"])

    return members.join(told, "grp").select("id", "v", "to", "code", "low").mapInArrow(reach, "id long, v array<float>, grp long")


def _same_neighbours(rows: DataFrame, dim: int, least: int) -> DataFrame:
    """(cluster_id, id) of vectors whose similar vectors are the same as those of each of these.

    Compared is within ``grp``, exactly, in blocks: every pair of shards of a group meets once. Visitors (not ``own``)
    are compared with members, not with each other. Per vector its similar vectors are told by their number, least
    id and the exclusive or of their hashes.
    """
    totals = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    sharded = rows.join(totals, "grp").withColumn("shards", F.ceil(F.col("n") / SHARD).cast("int"))
    sharded = sharded.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    blocks = sharded.select("id", F.xxhash64("id").alias("hash"), "v", "grp", "own", "shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("_o")).select(
        "id", "hash", "v", "grp", "own", F.least("shard", "_o").alias("_i"), F.greatest("shard", "_o").alias("_j"), "shard"
    )

    def check(table: pa.Table) -> pa.Table:
        i, j = (table[c][0].as_py() for c in ("_i", "_j"))
        x, shard, ids = _matrix(table["v"], dim, np.float64), table["shard"].to_numpy(), table["id"].to_numpy()
        own, hashes = table["own"].to_numpy(), table["hash"].to_numpy()
        count, low, sig = np.zeros(len(ids), np.int64), np.full(len(ids), np.iinfo(np.int64).max), np.zeros(len(ids), np.int64)

        def note(at: np.ndarray, of: np.ndarray, near: np.ndarray) -> None:
            count[at] += near.sum(axis=1)
            low[at] = np.minimum(low[at], np.where(near, ids[of], np.iinfo(np.int64).max).min(axis=1))
            sig[at] ^= np.bitwise_xor.reduce(np.where(near, hashes[of], 0), axis=1)

        a, b = np.nonzero(shard == i)[0], np.nonzero(shard == j)[0]
        for lo in range(0, len(a), 512):
            part = a[lo : lo + 512]
            if len(b):
                near = (x[part] @ x[b].T >= SIMILAR) & (own[part][:, None] | own[b]) & (ids[part][:, None] != ids[b])
                note(part, b, near)
                if i != j:
                    note(b, part, near.T)
        some = count > 0
        return pa.table({"id": ids[some], "n": count[some], "low": low[some], "sig": sig[some]})

    kind = "id long, n long, low long, sig long"
    sets = blocks.groupBy("grp", "_i", "_j").applyInArrow(check, kind).groupBy("id").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.bit_xor("sig").alias("sig"))
    # Every vector is similar to itself.
    sets = sets.select("id", (F.col("n") + 1).alias("n"), F.least("low", "id").alias("low"), F.col("sig").bitwiseXOR(F.xxhash64("id")).alias("sig"))
    sets = cut(sets.where(F.col("n") >= least))
    whole = sets.groupBy("low", "n", "sig").agg(F.count(F.lit(1)).alias("_n")).where("_n = n").select("low", "n", "sig")
    return sets.join(whole, ["low", "n", "sig"]).select(F.col("low").alias("cluster_id"), "id")


def clusters(vectors: DataFrame, dim: int = 64, least: int = 3, id: str = "symbol_id", vector: str = "vector") -> DataFrame:
    """(cluster_id, id, similarity to the centre) of every member of a cluster."""
    assigned, first = _leaves(unit_vectors(vectors, dim, id, vector), dim)
    into, second = _merge_near(first, dim)
    into, second = cut(into), cut(second)
    edges = cut(_links(second, dim))
    linked = edges.selectExpr("a AS node").union(edges.selectExpr("b AS node")).distinct()
    comp = components(edges, linked)
    alone = second.join(linked, F.col("leaf") == F.col("node"), "left_anti").select("leaf", F.col("leaf").alias("grp"), "count", "sums")
    joined = second.join(comp, F.col("leaf") == F.col("node")).select("leaf", "count", "sums", "comp")

    def agglomerate(table: pa.Table) -> pa.Table:
        ids, counts = table["leaf"].to_numpy(), table["count"].to_numpy()
        order = np.argsort(ids)
        sums = _matrix(table["sums"], dim, np.float64)
        group = ward_in_chunks(counts[order], sums[order])
        return pa.table({"leaf": ids[order], "grp": ids[order][group], "count": counts[order], "sums": table["sums"].take(pa.array(order))})

    grouped = joined.groupBy("comp").applyInArrow(lambda t: agglomerate(t.select(["leaf", "count", "sums"])), "leaf long, grp long, count long, sums array<double>")
    final = cut(grouped.unionByName(alone))
    # One assignment pass: vector -> leaf -> merged leaf -> group.
    way = into.join(final.select(F.col("leaf").alias("into"), "grp"), "into").select("leaf", "grp")
    members = cut(assigned.join(way, "leaf").select("id", "v", "grp"))
    sums = final.groupBy("grp").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(dim)]).alias("sums"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, code = _matrix(batch.column(1), dim, np.float64), _codes(_matrix(batch.column(2), dim, np.float64))
            # The code itself is the centre that angles are told from, so its rounding costs nothing.
            low = (x * _decoded(code, dim, np.float64)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), code, pa.array(low)], names=["grp", "code", "low"])

    told = members.join(sums, "grp").select("grp", "v", "sums").mapInArrow(angles, "grp long, code binary, low double")
    groups = cut(told.groupBy("grp").agg(F.min("code").alias("code"), F.min("low").alias("low")))
    visitors = _visits(members, groups, dim).withColumn("own", F.lit(False))
    same = _same_neighbours(cut(members.withColumn("own", F.lit(True)).unionByName(visitors)), dim, least)
    found = cut(members.join(same, "id").select("cluster_id", "id", "v"))
    centres = found.groupBy("cluster_id").agg(F.array(*[F.sum(F.col("v")[k].cast("double")) for k in range(dim)]).alias("sums"))
    dot = F.aggregate(F.zip_with("v", "sums", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("sums", F.lit(0.0), lambda s, x: s + x * x))
    return found.join(centres, "cluster_id").select("cluster_id", F.col("id").alias(id), (dot / norm).alias("similarity"))


def describe(members: DataFrame, id: str = "symbol_id", typical: int = TYPICAL) -> DataFrame:
    """(cluster_id, size, typical): per cluster its size and the members nearest to its centre, nearest first.

    Nearness is told to four decimals, ties by id.
    """
    keyed = members.select("cluster_id", F.pmod(F.xxhash64(id), F.lit(64)).alias("_b"), F.struct((-F.round("similarity", 4)).alias("d"), F.col(id).alias("m")).alias("x"))
    # Two steps, so that the members of a huge cluster never meet in one list.
    part = keyed.groupBy("cluster_id", "_b").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.slice(F.array_sort(F.collect_list("x")), 1, typical).alias("top"))
    whole = part.groupBy("cluster_id").agg(F.sum("n").alias("size"), F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, typical).alias("top"))
    return whole.select("cluster_id", "size", F.transform("top", lambda t: t["m"]).alias("typical"))
