"""Tree operators, fits, enumeration, search and clustering against brute force on small trees."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import cluster, fit, metrics, reads, trees
from arbora.operators.enumerate import enumerate_trees
from arbora.operators.search import SearchParams, package, search


def rooted(n):
    """All parents vectors of trees with root 0 and nodes 1..n."""
    for p in itertools.product(range(n + 1), repeat=n):
        ok = True
        for i in range(n):
            v, steps = i + 1, 0
            while v and steps <= n:
                v, steps = p[v - 1], steps + 1
            ok = ok and v == 0
        if ok:
            yield list(p)


def reaches(parents, a, v):
    while True:
        if v == a:
            return True
        if v == 0:
            return False
        v = parents[v - 1]


@pytest.fixture(scope="module")
def small(spark):
    rows = [(k, p) for k, p in enumerate(itertools.chain(rooted(1), rooted(2), rooted(3)))]
    return rows, trees.edges_of(spark.createDataFrame(rows, "t int, parents array<int>"), keys=["t"]).cache()


def test_ancestry(small):
    rows, edges = small
    got = {(r.t, r.anc, r.node) for r in trees.ancestry(edges, ["t"]).collect()}
    assert got == {(t, a, v) for t, p in rows for a in range(len(p) + 1) for v in range(len(p) + 1) if reaches(p, a, v)}


def test_ancestry_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 60)], "node int, parent int")
    got = trees.ancestry(edges).collect()
    assert len(got) == 60 * 61 // 2 and all(r.depth == r.node - r.anc for r in got)


def test_newick(small):
    rows, edges = small

    def text(p, v):
        kids = [text(p, i + 1) for i in range(len(p)) if p[i] == v]
        return f"({','.join(kids)}){v}" if kids else str(v)

    assert {r.t: r.newick for r in trees.newick(edges, ["t"]).collect()} == {t: text(p, 0) + ";" for t, p in rows}


def test_lineages_cover_each_node_once(small):
    rows, edges = small
    got = trees.lineages(edges, ["t"]).collect()
    for t, p in rows:
        own = [r for r in got if r.t == t]
        assert sorted(v for r in own for v in r.nodes) == list(range(1, len(p) + 1))
        for r in own:
            assert r.parent == p[r.head - 1] and (r.parent == 0 or p.count(r.parent) > 1)
            for v in set(r.nodes) - {r.head}:
                assert p[v - 1] in r.nodes and p.count(p[v - 1]) == 1


def test_contract_and_round_trip(small):
    rows, edges = small
    back = {r.t: r.parents for r in trees.parents_of(edges, ["t"]).collect()}
    assert back == dict(rows)
    got = {(r.t, r.node): r.parent for r in trees.contract(edges, F.lit(1), ["t"]).collect()}
    assert got == {(t, i + 1): (p[0] if x == 1 else x) for t, p in rows for i, x in enumerate(p) if i}


def test_subsets(spark):
    df = spark.createDataFrame([([3, 5, 9],), ([],), ([1],)], "c array<int>")
    got = [sorted(map(tuple, r.s)) for r in df.select(trees.subsets(F.when(F.size("c") > 0, F.col("c")), 2).alias("s")).where("s is not null").collect()]
    assert got == [[(3,), (3, 5), (3, 9), (5,), (5, 9), (9,)], [(1,)]]


def slow_fit(parents, target, weight, rounds=60_000):
    """Projected gradient on eta over the simplex."""
    n = len(parents)
    anc = np.array([[reaches(parents, a, v) for v in range(n + 1)] for a in range(n + 1)], float)[1:]
    h = anc.T @ (anc / weight[:, None])
    step = 1 / np.linalg.eigvalsh(h).max()
    eta = np.full(n + 1, 1 / (n + 1))
    for _ in range(rounds):
        z = eta - step * (anc.T @ ((anc @ eta - target) / weight))
        s = np.sort(z)[::-1]
        k = np.nonzero(s - (np.cumsum(s) - 1) / np.arange(1, n + 2) > 0)[0][-1]
        new = np.maximum(z - (s[: k + 1].sum() - 1) / (k + 1), 0)
        if np.abs(new - eta).max() < 1e-13:
            break
        eta = new
    return anc @ eta


def test_fit_is_the_optimum():
    rng = np.random.default_rng(0)
    shapes = [p for n in (1, 2, 3, 4) for p in rooted(n)]
    for i in rng.permutation(len(shapes))[:60].tolist() + [0, 1]:
        p = np.array(shapes[i])
        target, weight = rng.uniform(-0.2, 1.2, len(p)), rng.uniform(0.01, 1, len(p))
        f, eta = fit.fit_sample(p, target, weight)
        want = slow_fit(shapes[i], target, weight)
        cost = lambda x: float(((x - target) ** 2 / weight).sum())
        assert cost(f[1:]) <= cost(want) + 1e-7 and np.abs(f[1:] - want).max() < 1e-3
        assert abs(eta.sum() - 1) < 1e-9 and (eta >= 0).all() and f[0] == 1


def test_fit_of_partial_trees():
    f, eta = fit.fit_sample(np.array([0, -1, 1]), np.array([0.5, 0.9, 0.8]), np.ones(3))
    assert np.isnan(f[2]) and np.isnan(eta[2]) and abs(f[1] - 0.65) < 1e-12 and abs(f[3] - 0.65) < 1e-12


def reads_of(spark, eta, parents, depth=400):
    n = len(parents)
    f = np.array([[sum(eta[v][s] for v in range(n + 1) if reaches(parents, a, v)) for s in range(len(eta[0]))] for a in range(n + 1)])
    rows = [(i, s, int(round(f[i][s] * depth / 2)), depth, 0.5) for i in range(1, n + 1) for s in range(len(eta[0]))]
    return spark.createDataFrame(rows, "node int, sample int, v long, n long, omega double").cache()


ETA = [[0.05, 0.1, 0.05], [0.2, 0.1, 0.35], [0.3, 0.15, 0.2], [0.05, 0.4, 0.15], [0.4, 0.25, 0.25]]
TRUTH = [0, 1, 1, 2]


@pytest.mark.parametrize(("model", "e"), [("bs", 40), ("bs", 1), ("sbs", 40)])
def test_wide_search_finds_the_best_tree(spark, model, e):
    cells = reads_of(spark, ETA, TRUTH)
    every = spark.createDataFrame([(p,) for p in rooted(4)], "parents array<int>")
    best = fit.fit_trees(every, fit.pack(cells)).orderBy(F.desc("llh"), "parents").first()
    got = package(search(cells, SearchParams(beam_width=40, branching_factor=40, expansion_factor=e, model=model))).orderBy("rank").collect()
    assert got[0].parents == best.parents and abs(got[0].llh - best.llh) < 1e-6
    assert abs(sum(r.prob for r in got) - 1) < 1e-9 and [r.llh for r in got] == sorted((r.llh for r in got), reverse=True)


def test_search_does_not_depend_on_partitions(spark):
    cells = reads_of(spark, ETA, TRUTH)
    p = SearchParams(beam_width=2, branching_factor=3, instances=2, seed=5, node_order="diverse", expansion_factor=1)
    one = search(cells, p).select("instance", "parents").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        two = search(cells.repartition(5), p).select("instance", "parents").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(str, one)) == sorted(map(str, two)) and len({r.instance for r in one}) == 2


def test_monoprimary_search(spark):
    cells = reads_of(spark, ETA, TRUTH)
    got = search(cells, SearchParams(beam_width=3, branching_factor=5, expansion_factor=3, model="bs", force_monoprimary=True)).collect()
    assert got and all(r.parents.count(0) == 1 for r in got)
    with pytest.raises(ValueError):
        search(cells.where("node <> 2"))
    with pytest.raises(ValueError):
        SearchParams(model="x")


def test_enumeration(spark):
    cells = reads_of(spark, ETA, TRUTH)
    freq = reads.f_hat(cells)
    f = {(r.node, r.sample): r.f for r in freq.collect()}
    ok = [p for p in rooted(4) if all(sum(f[i + 1, s] for i in range(4) if p[i] == v) <= f[v, s] + 1e-10 for v in range(5) for s in range(3))]
    assert TRUTH in ok and sorted(r.parents for r in enumerate_trees(freq).collect()) == sorted(ok)
    with pytest.raises(RuntimeError):
        enumerate_trees(freq, max_trees=0)


def slow_pac(parents, x, kind):
    """The clone trees of one tree, one merge at a time."""
    parents, clusters, linear, out = list(parents), [[i] for i in range(len(parents))], True, []
    out.append((list(parents), [list(c) for c in clusters]))
    for _ in range(len(parents)):
        live = [i for i, p in enumerate(parents) if p >= 0]
        if all(parents[i] == 0 for i in live):
            pairs = list(itertools.combinations(live, 2))
        else:
            pairs = [(i, parents[i] - 1) for i in live if parents[i] > 0 and not (linear and parents.count(parents[i]) > 1)]
        if not pairs:
            linear = False
            continue

        def dist(a, b):
            d = [float(np.sqrt(((x[i] - x[j]) ** 2).sum())) for i in clusters[a] for j in clusters[b]]
            return min(d) if kind == "min" else sum(d) / len(d)

        _, one, two = min((round(dist(a, b), 12), a, b) for a, b in pairs)
        parents = [parents[two] if p == two + 1 else p for p in parents]
        parents[two] = -1
        clusters[one], clusters[two] = sorted(clusters[one] + clusters[two]), []
        out.append((list(parents), [list(c) for c in clusters]))
    return out


@pytest.mark.parametrize("kind", ["min", "avg"])
def test_agglomeration(spark, kind):
    rng = np.random.default_rng(1)
    shapes = [[0, 1, 1, 2], [0, 1, 2, 3], [0, 0, 0, 0], [0, 0, 1, 1]]
    x = [rng.uniform(0.01, 0.99, (4, 3)) for _ in shapes]
    freq = spark.createDataFrame([(t, i + 1, s, float(x[t][i][s])) for t in range(4) for i in range(4) for s in range(3)], "tree int, node int, sample int, f double")
    got = cluster.agglomerate(spark.createDataFrame(list(enumerate(shapes)), "tree int, parents array<int>"), freq, kind).collect()
    for t, p in enumerate(shapes):
        want = {(tuple(a), tuple(tuple(i + 1 for i in c) for c in b if c)) for a, b in slow_pac(p, x[t], kind)}
        own = [r for r in got if r.tree == t]
        assert {(tuple(r.parents), tuple(map(tuple, r.clusters))) for r in own} == want
        assert sorted(r.size for r in own) == [1, 2, 3, 4]


def test_ward_agglomeration_and_selection(spark):
    cells = reads_of(spark, ETA, TRUTH)
    freq = reads.f_hat(cells).where("node > 0").withColumn("tree", F.lit(0))
    start = spark.createDataFrame([(0, TRUTH)], "tree int, parents array<int>")
    data = freq.join(cells, ["node", "sample"])
    rows = cluster.clustering_llh(cluster.agglomerate(start, freq, "ward"), data).cache()
    assert sorted(r.size for r in rows.collect()) == [1, 2, 3, 4] and all(r.llh < 0 for r in rows.collect())
    one = cluster.select_clustering(rows, F.lit(4), F.lit(3)).collect()
    crit = {r.size: 2 * r.size * 3 * np.log(4) - 2 * r.llh for r in rows.collect()}
    assert [r.size for r in one] == [min(crit, key=crit.get)]
    assert [r.size for r in cluster.select_clustering(rows, F.lit(4), F.lit(3), num_clones=2).collect()] == [2]
    with pytest.raises(ValueError):
        cluster.agglomerate(start, freq, "ward", "cosine")


def test_truth_has_no_loss(spark):
    members = spark.createDataFrame([(m, 1 + m % 4) for m in range(7)], "mut int, node int")
    edges = spark.createDataFrame([("a", 0, i + 1, p) for i, p in enumerate(TRUTH)], "method string, tree int, node int, parent int")
    one = spark.createDataFrame([("a", 0, -3.0, 2)], "method string, tree int, llh double, count int")
    probs = metrics.relation_probs(one, edges, members)
    q = probs.select("a", "b", "rel", F.col("p").alias("q"))
    for strict in (False, True):
        assert [abs(r.score) < 1e-12 for r in metrics.relation_loss(probs, q, strict).collect()] == [True]
    anc = trees.ancestry(edges, ["method", "tree"])
    rel = metrics.relations(edges, ["method", "tree"], anc).collect()
    assert {(r.i, r.j) for r in rel if r.rel == metrics.ANCESTRAL} == {(a, v) for a in range(1, 5) for v in range(1, 5) if a != v and reaches(TRUTH, a, v)}
    assert len(rel) == 16


@pytest.mark.parametrize("strict", [False, True])
def test_loss_by_clones_is_the_loss_by_pairs(spark, strict):
    """Method and truth cluster the mutations differently; two trees weigh in, one method's clusters are mixed up."""
    own = spark.createDataFrame([(m, 1 + (3 * m + m // 5) % 3) for m in range(13)], "mut int, node int")
    true = spark.createDataFrame([(m, 1 + m % 4) for m in range(13)], "mut int, node int")
    shapes = {("a", 0): [0, 1, 1], ("a", 1): [0, 1, 2], ("b", 0): [0, 0, 0]}
    edges = spark.createDataFrame([(*k, i + 1, p) for k, t in shapes.items() for i, p in enumerate(t)], "method string, tree int, node int, parent int")
    found = spark.createDataFrame([("a", 0, -3.0, 2), ("a", 1, -2.5, 1), ("b", 0, -1.0, 1)], "method string, tree int, llh double, count int")
    truth = spark.createDataFrame([("t", 0, i + 1, p) for i, p in enumerate(TRUTH)], "method string, tree int, node int, parent int")
    once = spark.createDataFrame([("t", 0, 0.0, 1)], "method string, tree int, llh double, count int")
    want = metrics.relation_loss(metrics.relation_probs(found, edges, own), metrics.relation_probs(once, truth, true).select("a", "b", "rel", F.col("p").alias("q")), strict)
    q = metrics.clone_relation_probs(once, truth).select("i", "j", "rel", F.col("p").alias("q"))
    got = metrics.clone_relation_loss(metrics.clone_relation_probs(found, edges), q, own, true, strict)
    want, got = ({r.method: r.score for r in x.collect()} for x in (want, got))
    assert want.keys() == got.keys() == {"a", "b"} and all(abs(want[k] - got[k]) < 1e-12 and want[k] > 0.01 for k in want)


@pytest.mark.parametrize("metric", cluster.METRICS)
def test_distances(spark, metric):
    a, b = np.array([1.0, 2.0, -3.0]), np.array([0.5, 0.0, 4.0])
    d, c = np.abs(a - b), lambda x, y: 1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    want = {
        "euclidean": np.linalg.norm(a - b), "sqeuclidean": d @ d, "cityblock": d.sum(), "chebyshev": d.max(), "canberra": (d / (np.abs(a) + np.abs(b))).sum(),
        "braycurtis": d.sum() / np.abs(a + b).sum(), "cosine": c(a, b), "correlation": c(a - a.mean(), b - b.mean()), "hamming": 1.0,
    }[metric]
    df = spark.createDataFrame([(1, a.tolist()), (2, b.tolist())], "id int, x array<double>")
    assert abs(cluster.pairwise_distance(df, metric).first().dist - want) < 1e-12
