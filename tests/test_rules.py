"""Rules on inputs and methods, searches over many inputs, and tables that go when they are no longer needed."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import cluster, metrics
from arbora.operators.search import SearchParams, package, search
from arbora.plans import drop, save, shared_dir, stash, temporary
from arbora.sources import archive, formats


def cells_of(spark, shift, nodes=3, samples=2):
    rows = [(i, s, (7 * i + 3 * s + shift) % 11 + 2, 20 + s, 0.5) for i in range(1, nodes + 1) for s in range(samples)]
    return spark.createDataFrame(rows, "node int, sample int, v long, n long, omega double")


def test_many_runs_equal_single_ones(spark):
    """Inputs of different sizes searched together give what each gives by itself, counters included."""
    p = SearchParams(beam_width=2, branching_factor=3, instances=2, node_order="diverse", seed=5)
    inputs = {"a": cells_of(spark, 0, 2), "b": cells_of(spark, 4, 3, 3)}
    alone = {run: search(cells, p) for run, cells in inputs.items()}
    both = search(inputs["a"].withColumn("run", F.lit("a")).unionByName(inputs["b"].withColumn("run", F.lit("b"))), p)
    key = lambda r: (r.instance, tuple(r.parents), round(r.llh, 9), round(r.score, 9), r.explored, r.cut)
    got = both.collect()
    for run, rows in alone.items():
        assert sorted(key(r) for r in got if r.run == run) == sorted(key(r) for r in rows.collect())
    ranked = package(both, ["run"]).collect()
    assert {r.run for r in ranked} == {"a", "b"} and all(abs(sum(r.prob for r in ranked if r.run == run) - 1) < 1e-9 for run in "ab")
    with pytest.raises(ValueError):
        search(cells_of(spark, 0).where("node <> 2"), p)


def test_counters(spark):
    """Beam width 1, branching 2: one tree expanded a step; each step gives up what it fitted and did not keep."""
    (r,) = search(cells_of(spark, 0), SearchParams(beam_width=1, branching_factor=2, model="bs")).collect()
    assert r.explored == 3 and r.cut == 0 + 1 + 1  # one way to place the first node, two are fitted for each later one


def test_methods_are_named_once_and_have_one_shape(spark):
    names, scored = spark.createDataFrame([("a",), ("b",)], "method string"), spark.createDataFrame([("a", 1.0)], "method string, score double")
    assert [tuple(r) for r in metrics.method_scores(names, scored).collect()] == [("a", 1.0), ("b", -1.0)]
    for twice in ((names.unionByName(names), scored), (names, scored.unionByName(scored))):
        with pytest.raises(formats.InvalidInput):
            metrics.method_scores(*twice)
    metrics.require_same_shape(spark.createDataFrame([("a", 6), ("b", 6)], "method string, size int"))
    with pytest.raises(formats.InvalidInput):
        metrics.require_same_shape(spark.createDataFrame([("a", 6), ("b", 5)], "method string, size int"))


def test_a_size_that_no_clustering_has(spark):
    rows = spark.createDataFrame([(0, 3, -1.0), (0, 2, -2.0), (1, 2, -3.0)], "tree int, size int, llh double")
    n, m = F.lit(5), F.lit(2)
    assert sorted((r.tree, r.size) for r in cluster.select_clustering(rows, n, m, num_clones=2).collect()) == [(0, 2), (1, 2)]
    with pytest.raises(formats.InvalidInput):
        cluster.select_clustering(rows, n, m, num_clones=3)


def test_truth(spark, tmp_path):
    row = ([[1.0, 1.0], [0.6, 0.5], [0.3, 0.5]], [0, 1], [["s0"], ["s1", "s2"]], ["s9"])
    spark.createDataFrame([row], formats.TRUTH).write.parquet(str(tmp_path / "truth"))
    truth = formats.read_truth(spark, str(tmp_path / "truth"))
    assert {tuple(r) for r in formats.truth_frequencies(truth).collect()} == {(0, 0, 1.0), (0, 1, 1.0), (1, 0, 0.6), (1, 1, 0.5), (2, 0, 0.3), (2, 1, 0.5)}
    got = formats.truth_trees(truth).first()
    assert (got.method, got.tree_idx, got.parents, got.llh, got["count"], got.prob) == ("truth", 0, [0, 1], 0.0, 1, 1.0)
    spark.createDataFrame([(row[0][:2], *row[1:])], formats.TRUTH).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(formats.InvalidInput):
        formats.read_truth(spark, str(tmp_path / "bad"))


@pytest.mark.parametrize("wrong", [{"parents": [0, 3]}, {"phi": [[1.0], [float("nan")], [0.1]]}, {"eta": [[1.0], [0.5]]}, {"count": None}, {"llh": None}])
def test_wrong_trees_are_not_written(spark, tmp_path, wrong):
    row = {"method": "m", "tree_idx": 0, "parents": [0, 1], "phi": [[1.0], [0.5], [0.1]], "eta": [[0.5], [0.4], [0.1]], "count": 1, "llh": -1.0, "prob": 1.0, "newick": "((2)1)0;", "clusters": [["s0"], ["s1"]]}
    table = lambda *rows: spark.createDataFrame([tuple(r.values()) for r in rows], formats.TREE)
    with pytest.raises(formats.InvalidInput):
        formats.write_trees(table(row | wrong), str(tmp_path / "no"))
    with pytest.raises(formats.InvalidInput):
        formats.write_trees(table(row, row), str(tmp_path / "no"))
    formats.write_trees(table(row), str(tmp_path / "yes"))
    trees = formats.read_trees(spark, str(tmp_path / "yes"))
    assert formats.one_tree(trees, 0).first().newick == "((2)1)0;"
    with pytest.raises(formats.InvalidInput):
        formats.one_tree(trees, 1)


def test_archives(spark, tmp_path):
    one = {"struct": np.array([[0, 1], [0, 0]]), "phi": np.ones((2, 3, 2)), "count": np.array([2, 1]), "llh": np.array([-1.0, -2.0])}
    (tmp_path / "runs" / "a").mkdir(parents=True)
    np.savez(tmp_path / "runs" / "a" / "x.npz", **one, **{"clusters.json": json.dumps([["s0"], ["s1"]]), "sampnames": np.array(["p", "q"])})
    np.savez(tmp_path / "runs" / "y.npz", struct=np.array([[0]]))
    got = archive.read_archives(spark, str(tmp_path / "runs"))
    rows = {(r.path.rsplit("/", 1)[1], r.tree_idx): r for r in got.collect()}
    assert set(rows) == {("x.npz", 0), ("x.npz", 1), ("y.npz", 0)}
    x = rows["x.npz", 1]
    assert (x.parents, x.phi, x["count"], x.llh, x.clusters, x.samples, x.eta) == ([0, 0], [[1.0] * 2] * 3, 1, -2.0, [["s0"], ["s1"]], ["p", "q"], None)
    params = spark.createDataFrame([(["u"],)], "samples array<string>")
    assert {(r.path[-5:], tuple(r.samples)) for r in formats.with_sample_names(got, params).collect()} == {("x.npz", ("p", "q")), ("y.npz", ("u",))}
    np.savez(tmp_path / "bad.npz", **(one | {"llh": np.array([-1.0])}))
    with pytest.raises(Exception, match="different lengths"):
        archive.read_archives(spark, str(tmp_path / "bad.npz")).collect()


def test_tables_go_when_dropped(spark):
    base = Path(shared_dir(spark)) / "arbora"
    base.mkdir(parents=True, exist_ok=True)
    before = set(base.iterdir())
    table = stash(spark.range(5), "five")
    path = save(spark.range(3), "three")
    assert table.count() == 5 and len(set(base.iterdir()) - before) == 2
    drop(spark, table, path)
    with temporary(spark):
        assert stash(spark.range(7), "seven").count() == 7 and len(set(base.iterdir()) - before) == 1
    assert set(base.iterdir()) == before


def test_search_reads_only_trees_of_its_childrens_sizes_and_tells_its_progress(spark, monkeypatch):
    from arbora.operators import search as S

    rows = [(v, s, 5 * (6 - v) + s, 60, 0.5) for v in range(1, 6) for s in range(2)]
    cells = spark.createDataFrame(rows, "node int, sample int, v long, n long, omega double")
    told, read, real = [], [], S.load
    monkeypatch.setattr(S, "load", lambda spark, schema, *paths: read.append(len(paths)) or real(spark, schema, *paths))
    done = S.search(cells, S.SearchParams(beam_width=2, branching_factor=3, instances=2, node_order="diverse"), progress=told.append).collect()
    assert [x["step"] for x in told] == list(range(1, len(told) + 1)) and told[-1]["waiting"] == 0
    assert all(a["explored"] < b["explored"] and a["cut"] <= b["cut"] for a, b in zip(told, told[1:]))
    one = {r.instance: r for r in done}
    assert sum(r.explored for r in one.values()) == told[-1]["explored"] and sum(r["cut"] for r in one.values()) == told[-1]["cut"]
    assert max(r.llh for r in done) <= max(x["best"] for x in told if x["best"] is not None)
    probes = [n for n in read[:-1] if n != 1]  # one path: the step's own state; the last call gathers all
    assert read[-1] == len(told) and all(n < len(told) - 1 for n in probes)
    assert len({(r.instance, tuple(r.parents)) for r in done}) == len(done)
