"""Clusters and entity matching against brute force."""

import random

import numpy as np
import pytest

from quern.llm import clustering as C
from quern.llm import matching as M


def brute_clusters(vectors, least=3):
    ids = sorted(vectors)
    x = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    near = x @ x.T >= C.THRESHOLD
    seen, out = set(), set()
    for k in range(len(ids)):
        if k in seen:
            continue
        group, front = {k}, [k]
        while front:
            front = [j for i in front for j in np.nonzero(near[i])[0].tolist() if j not in group and not group.add(j)]
        seen |= group
        g = sorted(group)
        if len(g) >= least and near[np.ix_(g, g)].all():
            out |= {(ids[g[0]], ids[m]) for m in g}
    return out


def planted(rng, dim, sizes, noise):
    out, i = {}, 0
    for n in sizes:
        c = rng.standard_normal(dim)
        c /= np.linalg.norm(c)
        for _ in range(n):
            out[i] = (c + rng.standard_normal(dim) * noise / np.sqrt(dim)) * rng.uniform(0.2, 9)
            i += 1
    return out


def test_clusters_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = planted(rng, 64, [1] * 60 + [2] * 10 + [3] * 15 + [7] * 8 + [120], 0.35)
    a = rng.standard_normal(64)
    a /= np.linalg.norm(a)
    b = rng.standard_normal(64)
    b -= a * (a @ b)
    b /= np.linalg.norm(b)
    for k, angle in enumerate((0, 30, 60)):  # a chain: neighbours are similar, the ends are not
        vectors[5000 + k] = a * np.cos(np.radians(angle)) + b * np.sin(np.radians(angle))
    rows = [(i, v.tolist()) for i, v in vectors.items()]
    rows += [(9000, None), (9001, []), (9002, [1.0] * 63), (9003, [0.0] * 64), (9004, [float("nan")] * 64), (9005, [float("inf")] * 64), (80, vectors[80].tolist()), (80, (vectors[80] * 2).tolist()), (None, vectors[80].tolist())]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "symbol_id long, vector array<float>, id int, v string").repartition(5)
    want = brute_clusters(vectors)
    members = C.clusters(df)
    assert {(r.cluster_id, r.symbol_id) for r in members.collect()} == want
    monkeypatch.setattr(C, "SHARD", 16)  # verification over several blocks
    assert {(r.cluster_id, r.symbol_id) for r in C.clusters(df).collect()} == want
    told = {r.cluster_id: r for r in C.describe(members).collect()}
    sizes = {}
    for c, _ in want:
        sizes[c] = sizes.get(c, 0) + 1
    assert {c: r.size for c, r in told.items()} == sizes and all(len(r.typical) == 3 for r in told.values())
    assert C.clusters(df.limit(0)).count() == 0


def from_cosines(gram, dim=64, seed=8):
    """Vectors with the given cosines."""
    x = np.linalg.cholesky(np.array(gram) + np.eye(len(gram)) * 1e-12)
    return np.pad(x, ((0, 0), (0, dim - len(gram)))) @ C.rotations(dim, 1, seed)[0]


def found_and_wanted(spark, vectors):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "symbol_id long, vector array<float>").repartition(3)
    return {(r.cluster_id, r.symbol_id) for r in C.clusters(df).collect()}, brute_clusters(vectors)


def test_merged_groups_are_split_again(spark):
    """Groups whose centres are close, though no member of one is similar to a member of the other."""
    gram = np.full((4, 4), 0.82)
    gram[3, :3] = gram[:3, 3] = 0.78
    np.fill_diagonal(gram, 1)
    vectors = dict(enumerate(from_cosines(gram)))
    two = np.full((24, 24), 0.75)
    two[:12, :12] = two[12:, 12:] = 0.82
    np.fill_diagonal(two, 1)
    vectors |= {100 + k: v for k, v in enumerate(from_cosines(two, seed=9))}
    got, want = found_and_wanted(spark, vectors)
    assert got == want and {c for c, _ in want} == {0, 100, 112}


def test_similar_vectors_outside(spark, monkeypatch):
    """A vector that is similar to one member alone, and links that no hash table finds."""
    gram = np.full((4, 4), 0.95)
    gram[3, :3] = gram[:3, 3] = 0.7
    gram[3, 0] = gram[0, 3] = 0.81
    np.fill_diagonal(gram, 1)
    vectors = dict(enumerate(from_cosines(gram)))
    rest = np.full((3, 3), 0.81)
    np.fill_diagonal(rest, 1)
    vectors |= {100 + k: v for k, v in enumerate(from_cosines(rest, seed=9))}
    got, want = found_and_wanted(spark, vectors)
    assert got == want and {c for c, _ in want} == {100}
    monkeypatch.setattr(C, "REACH", 3)
    monkeypatch.setattr(C, "_links", lambda leaves, dim: leaves.selectExpr("leaf AS a", "leaf AS b").limit(0))
    assert found_and_wanted(spark, vectors)[0] == want


def test_chunks_do_not_change_clusters(spark, monkeypatch):
    gram = np.full((12, 12), 0.82)
    np.fill_diagonal(gram, 1)
    vectors = dict(enumerate(from_cosines(gram)))
    whole = C.ward_in_chunks
    monkeypatch.setattr(C, "ward_in_chunks", lambda counts, sums: whole(counts, sums, 1))
    got, want = found_and_wanted(spark, vectors)
    assert got == want and len(want) == 12


def test_random_clusters_about_the_threshold(spark):
    """Groups whose inner, cross and outer similarities all lie about 0.8, at once."""
    rng = np.random.default_rng(17)
    vectors = {}
    for k, (inner, cross) in enumerate(((0.83, 0.72), (0.86, 0.76), (0.95, 0.78))):
        gram = np.full((10, 10), cross)
        gram[:5, :5] = gram[5:, 5:] = inner
        np.fill_diagonal(gram, 1)
        vectors |= {100 * k + i: v for i, v in enumerate(from_cosines(gram, seed=20 + k))}
    for k in range(40):
        n = int(rng.integers(3, 9))
        centre = rng.standard_normal(64)
        spread = rng.standard_normal((n, 64)) * rng.uniform(0.3, 0.6)
        vectors |= {1000 + 10 * k + i: v for i, v in enumerate(centre + spread)}
    got, want = found_and_wanted(spark, vectors)
    assert got == want and {0, 5, 100, 105, 200, 205} <= {c for c, _ in want} and len({c for c, _ in want}) < 46


def test_buckets_longer_than_a_batch(spark):
    """More leaves in one hash bucket than rows in a batch."""
    gram = np.full((24, 24), 0.82)
    np.fill_diagonal(gram, 1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        got, want = found_and_wanted(spark, dict(enumerate(from_cosines(gram))))
    finally:
        spark.conf.set(key, before)
    assert got == want and len(want) == 24


def test_search_for_visitors_copies_no_vectors(spark, monkeypatch):
    """Every two groups meet, whatever the blocks, and only codes of centres are copied to the blocks."""
    monkeypatch.setattr(C, "REACH", 16)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((90, 64))
    x[45:] = x[:45] + rng.standard_normal((45, 64)) * rng.uniform(0.2, 1.2, (45, 1))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    code = C._codes(x)
    centre, low = C._decoded(code, 64, np.float64), rng.uniform(0.9, 1, 90)
    groups = C.cut(spark.createDataFrame([(k, code[k].as_py(), float(low[k])) for k in range(90)], "grp long, code binary, low double"))
    room = np.cos(np.arccos(C.THRESHOLD) + np.arccos(low)[:, None] + np.arccos(low))
    near = centre @ centre.T
    want = {(a, b) for a in range(90) for b in range(90) if low[a] < low[b] and near[a, b] >= room[a, b] + 1e-4}
    maybe = {(a, b) for a in range(90) for b in range(90) if low[a] < low[b] and near[a, b] >= room[a, b] - 1e-3}
    got = [(r.grp, r.to) for r in C._near_groups(groups, 64).collect()]
    assert want <= set(got) <= maybe and len(got) == len(set(got)) and 20 < len(want) < 1000
    members = C.cut(spark.createDataFrame([(k, x[k].tolist(), k) for k in range(90)], "id long, v array<float>, grp long"))
    visits = C._visits(members, groups, 64)
    assert {(r.id, r.grp) for r in visits.collect()} <= set(got)
    plan = visits._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan


def test_link_recall():
    """Two leaves of one cluster share a hash bucket: recall at and above the threshold."""
    rng = np.random.default_rng(1)
    bases = C.rotations(64, 2 * C.TABLES, seed=9)
    x = rng.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for cos, least in ((0.8, 0.9), (0.86, 0.97), (0.95, 0.999)):
        y = rng.standard_normal((600, 64))
        y -= x * (x * y).sum(axis=1, keepdims=True)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        z = cos * x + np.sqrt(1 - cos**2) * y
        hx, hz = (C.polytope(v.astype(np.float32), bases).reshape(600, -1, 2) for v in (x, z))
        assert (hx == hz).all(axis=2).any(axis=1).mean() >= least, cos


def test_ward_in_chunks():
    rng = np.random.default_rng(2)
    centres = np.linalg.qr(rng.standard_normal((16, 16)))[0][:5]
    kind = rng.integers(0, 5, 60)
    sums = centres[kind] + rng.standard_normal((60, 16)) * 0.05
    for chunk in (100, 16):
        group = C.ward_in_chunks(np.ones(60, dtype=np.int64), sums, chunk)
        if chunk == 100:
            assert all((group[i] == group[j]) == (kind[i] == kind[j]) for i in range(60) for j in range(60))
        assert all(kind[i] == kind[j] for i in range(60) for j in range(60) if group[i] == group[j])


NAMES = {
    "(*self).schheduleSecondaryCredential": (["schhedule", "secondary", "credential"], "self"), "trimSession?.": (["trim", "session"], ""), "A.b_c(…)": (["b", "c"], "a"), "Self::x_y::<T>": (["x", "y"], "self"),
    " __SplitCtx->evict#merge-it!": (["merge", "it"], "evict"), "": ([], ""), "(lambda x: x)": ([], ""), "ALL_CAPS": (["all", "caps"], ""), "obj?.go": (["go"], "obj"),
}


@pytest.mark.parametrize("text", NAMES)
def test_read_name(text):
    words, owner, own = M.read_name(text)
    assert words == NAMES[text][0] and " ".join(owner) == NAMES[text][1] and own is (NAMES[text][1] == "self")


def test_align():
    known = frozenset("register sort message mesh quota observer partial session".split())
    yes = [("register sort", "sort register"), ("rgister quota", "register quota"), ("reg quota", "register quota"), ("sess mesh", "session mesh"), ("registerquota", "register quota"), ("regisetrquota", "register quota"), ("sort msg", "sort message")]
    no = [("sort mesh", "sort message"), ("register", "register quota"), ("register sort quota", "register quota"), ("observer quota", "register quota"), ("len", "register quota"), ("to string", "sort message")]
    assert all(M.align(u.split(), s.split(), known)[2:] == (0, 0) for u, s in yes)
    assert all(sum(M.align(u.split(), s.split(), known)[2:]) for u, s in no)
    # no limit on the number of words, slips in several words, any order
    long = "register sort message gateway quota observer partial session".split()
    assert M.align("quotta sort msg gateway registr observer session prtial".split(), long, known) == (3, 1, 0, 0)
    assert M.align("registersort messagegateway quota observer partial session".split(), long, frozenset()) == (0, 0, 0, 0)


def test_the_classifier_decides():
    """Where every word has found a partner, the distances still decide."""
    names = [(f"p{k % 9}", f"{a} {b}") for k, (a, b) in enumerate((a, b) for a in "register message gateway observer partial cursor".split() for b in "quota session tensor ledger canvas".split())] * 8
    model, none = M.train(names), frozenset()
    p = lambda u, s: float(model.probability(np.array([M.features(u.split(), s.split(), none)]))[0])
    assert p("register quota", "register quota") > p("registr quota", "register quota") > p("registr qouta", "register quota") > p("registr qouta x", "register quota")
    assert p("registr qutoa msg", "register quota message") < p("register quota msg", "register quota message")


def damerau(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_slips_match_edit_distance():
    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
        b = list(a)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "ba"])
        b = "".join(b)
        assert M.one_slip(a, b) is (damerau(a, b) == 1), (a, b)
        if damerau(a, b) == 2 and len(a) == len(b):
            assert M.two_slips(a, b), (a, b)


def test_held_out_accuracy_and_calibration():
    rng = random.Random(3)
    vocabulary = "register sort message gateway quota observer partial session cursor tensor barrier ledger render evict snapshot canvas worker policy".split()
    make = lambda: [(f"p{k % 12}", " ".join(rng.sample(vocabulary, rng.choice([2, 2, 3])))) for k in range(600)]
    model = M.train(make())
    known, x, y = frozenset(vocabulary), [], []
    for _, n in make():
        s = n.split()
        x.append(M.features(M.distort(s, rng), s, known))
        y.append(1)
        o = rng.sample(vocabulary, len(s))
        if sorted(o) != sorted(s):
            x.append(M.features(o, s, known))
            y.append(0)
    p, y = model.probability(np.array(x)), np.array(y)
    assert ((p >= 0.5) == y).mean() > 0.93 and ((p - y) ** 2).mean() < 0.06
    assert not ((p >= 0.5) & (y == 0)).any()


def tables(spark):
    files = spark.createDataFrame([(1, "./libs/a/x.py", 5, 0), (2, "libs\\a\\y.py", 5, 0), (3, "libs/b/z.py", 5, 0), (4, "top.py", 5, 0)], "id long, relative_path string, last_indexed long, package int")
    symbols = spark.createDataFrame(
        [
            (10, 1, "merge_gateway_quota", "libs/a/x.py::merge_gateway_quota", "function"), (11, 1, "evictCursor", "libs/a/x.py::BigCanvas::evictCursor", "method"), (12, 2, "evict_cursor", "libs/a/y.py::SmallLedger::evict_cursor", "method"),
            (13, 1, "render_canvas", "libs/a/x.py::render_canvas", "IMPORT"), (14, 3, "merge_gateway_quota", "libs/b/z.py::merge_gateway_quota", "function"), (15, 2, "twin_name", "a::twin_name", "function"), (16, 2, "twin_name", "a::twin_name", "function"),
            (10, 1, "merge_gateway_quota", "libs/a/x.py::merge_gateway_quota", "function"), (17, 4, "top_level", "top.py::top_level", "function"),
        ],
        "id long, file_id long, name string, qualified_name string, kind string",
    )
    written = [
        (1, "self.mergeGatewayQuota()", 1), (1, "self.mergeGatewayQuota()", 1), (2, "MERGE_GATEWAY_QUOAT", 2), (3, "quotaGatewayMerge", 3), (4, "evict_cursor", 1), (5, "evict_cursor", 2), (6, "small_ledger.evictCursor", 1), (7, "render_canvas", 1),
        (8, "merge_quota", 1), (9, "merge_gateway_quota_worker", 1), (10, None, 1), (11, "", 1), (12, "twin_name", 2), (13, "merge_gateway_quota", 99), (14, "top_level", 4), (15, "x" * 20_000, 1), (16, "mergegatewayquota<T>", 1),
    ]
    relations = spark.createDataFrame([(i, n, None, f, "w") for i, n, f in written] + [(50, "merge_gateway_quota", 10, 1, "w")], "id long, target_symbol_name string, target_symbol_id long, file_id long, words string")
    return relations, symbols, files


def test_matches(spark):
    relations, symbols, files = tables(spark)
    rows = M.match_names(relations, symbols, files).collect()
    assert {r.relation_id: r.symbol_id for r in rows} == {1: 10, 2: 10, 3: 14, 4: 11, 5: 12, 6: 12, 16: 10}
    assert len(rows) == 7 and all(0.5 <= r.confidence <= 1 for r in rows)
    for empty in range(3):
        t = [df.limit(0) if k == empty else df for k, df in enumerate((relations, symbols, files))]
        assert M.match_names(*t).count() == 0


def test_block_recall(spark):
    """MinHash blocking proposes nearly every pair that brute force aligns."""
    rng = random.Random(6)
    vocabulary = "register sort message gateway quota observer partial session cursor tensor barrier ledger render evict snapshot canvas worker policy manifest journal".split()
    names = sorted({" ".join(rng.sample(vocabulary, rng.choice([2, 3]))) for _ in range(150)})
    written = sorted({" ".join(M.distort(n.split(), rng)) for n in names})
    from pyspark.sql import functions as F

    frame = lambda ns: spark.createDataFrame([("p", n) for n in ns], "package string, words string").select(F.xxhash64("package", "words").alias("nid"), "package", "words")
    u, s = frame(written), frame(names)
    got = {(r.u, r.s) for r in M.candidate_pairs(u, s).collect()}
    code = {r.words: r.nid for r in u.unionByName(s).collect()}
    known = frozenset(vocabulary)
    want = {(code[a], code[b]) for a in written for b in names if M.align(a.split(), b.split(), known)[2:] == (0, 0)}
    assert len(want & got) >= 0.95 * len(want)
