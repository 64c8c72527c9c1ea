"""Archives out and in, and folders of inputs, one of them broken."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import metrics
from arbora.operators.search import SearchParams
from arbora.sources import archive, batch
from arbora.sources.formats import InvalidInput

ALL = "run string, tree_idx int, " + archive.schema_of(list(archive.COLUMNS))


def one(run, i, n, samples=2):
    matrix = [[1.0 - 0.1 * k + 0.01 * i for _ in range(samples)] for k in range(n + 1)]
    return (run, i, list(range(n)), matrix, matrix, 2 + i, -3.5 - i, 0.5, f"({n})0;", [[0, 1, 0, 2]] * (i + 1), [["s1", "s2"], ["s3"]], ["a", "b"], [], 7, 20, 4, ["s1", "s2"], [[[0.5, 0.5], [1.0, 0.0]]])


def test_all_keys_go_out_and_come_back(spark, tmp_path):
    rows = [one("r1", i, 3) for i in range(3)] + [one("r2", 0, 5)] + [("r3", 0, [0], *[None] * 15)]
    archive.write_archives(spark.createDataFrame(rows, ALL).repartition(4), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["r1.npz", "r2.npz", "r3.npz"]
    back = archive.read_archives(spark, str(tmp_path / "out"))
    got = {(r.run, r.tree_idx): r for r in back.collect()}
    for row in rows:
        r = got.pop((row[0], row[1]))
        assert [r[c] for c in archive.COLUMNS] == list(row[2:]) and r.path.endswith(f"{row[0]}.npz")
    assert not got
    with np.load(tmp_path / "out" / "r1.npz") as z:
        keys = {k.removesuffix(".json") for k in z.files}
        assert keys == {k for k, *_ in archive.COLUMNS.values()} and len(keys) == 16 and z["phi"].shape == (3, 4, 2) and z["struct"].tolist() == [[0, 1, 2]] * 3


def test_only_asked_arrays_are_opened(spark, tmp_path):
    np.savez(tmp_path / "x.npz", struct=np.array([[0, 1]]), llh=np.array([-1.0]), phi=np.array([{"no": 1}], dtype=object))
    got = archive.read_archives(spark, str(tmp_path), ["parents", "llh", "newick"]).collect()
    assert [(r.run, r.parents, r.llh, r.newick) for r in got] == [("x", [0, 1], -1.0, None)]
    with pytest.raises(Exception, match="pickle"):
        archive.read_archives(spark, str(tmp_path), ["phi"]).collect()
    with pytest.raises(InvalidInput):
        np.savez(tmp_path / "y.npz", struct=np.array([[0, 1]]), llh=np.array([-1.0, -2.0]))
        archive.unpacked(str(tmp_path / "y.npz"), "y.npz", ["llh"])


def test_failed_writes_leave_nothing(spark, tmp_path):
    rows = spark.createDataFrame([one("r1", 0, 3), one("a/b", 0, 3)], ALL)
    with pytest.raises(Exception, match="plain names"):
        archive.write_archives(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
    archive.write_archives(rows.where("run = 'r1'"), str(tmp_path / "out"))
    archive.write_archives(rows.where("run = 'r1'").withColumn("run", F.lit("r2")), str(tmp_path / "out"), "overwrite")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["r2.npz"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("folder")
    for k in range(10):
        at = base / f"run{k}" / ("truth" if k % 2 else "")
        at.mkdir(parents=True)
        lines = ["id\tname\tvar_reads\ttotal_reads\tvar_read_prob"]
        for i, share in enumerate((0.9, 0.6, 0.25)[: 2 + k % 2]):
            lines.append(f"s{i}\tn{i}\t{int(50 * share)},{40 + k}\t100,100\t0.5,0.5")
        lines[1] = lines[1].replace("100,100", "100,x") if k == 4 else lines[1]
        (at / f"run{k}.ssm").write_text("\n".join(lines) + "\n")
        (at / f"run{k}.params.json").write_text(json.dumps({"samples": ["a", "b"], "clusters": [[f"s{i}"] for i in range(2 + k % 2)]}))
    return base


def test_problems(spark, folder, tmp_path):
    cells, params, bad = batch.read_inputs(spark, str(folder))
    assert [tuple(r) for r in bad.collect()] == [("run4", "read counts must be whole numbers of 0 or more")]
    assert {r.run: r.n for r in cells.groupBy("run").agg(F.count_distinct("node").alias("n")).collect()} == {f"run{k}": 2 + k % 2 for k in range(10) if k != 4}
    assert params.count() == 9
    head = "id\tname\tvar_reads\ttotal_reads\tvar_read_prob\n"
    wrong = {
        "a": (head + "s1\tn\t1,2\t3,4\t1,1\n", None), "b": (None, {"samples": ["x"], "clusters": [["s1"]]}), "c": (head + "s1\tn\t1\t3\t0\ns1\tn\t1\t3\t1\n", {"samples": ["x"], "clusters": [["s1"], ["s2"]]}),
        "d": (head + "s1\tn\t1,2\t3,4\t1,1\n", {"samples": ["x", "x"], "clusters": []}), "e": (head + "s1\tn\t1,2\t3\t1\n", {"samples": ["x"], "clusters": [["s1"]]}),
    }
    for name, (ssm, par) in wrong.items():
        if ssm:
            (tmp_path / f"{name}.ssm").write_text(ssm)
        if par:
            (tmp_path / f"{name}.params.json").write_text(json.dumps(par))
    got = {}
    for r in batch.read_inputs(spark, str(tmp_path))[2].collect():
        got.setdefault(r.run, set()).add(r.problem)
    assert got == {
        "a": {"no parameter file"}, "b": {"no mutation file", "clusters name ids that the mutation file lacks"},
        "c": {"probabilities must lie in (0, 1]", "repeated ids", "clusters name ids that the mutation file lacks"},
        "d": {"repeated sample names", "no clusters, or an empty one"}, "e": {"lists of different lengths", "as many reads as samples are asked for"},
    }


def test_search_conversion_and_scores_of_a_folder(spark, folder, tmp_path):
    bad = batch.search_folder(spark, str(folder), str(tmp_path / "out"), SearchParams(beam_width=2, branching_factor=4, expansion_factor=2, model="bs"))
    assert [r.run for r in bad.collect()] == ["run4"]
    trees = archive.read_archives(spark, str(tmp_path / "out" / "archives"))
    rows = trees.collect()
    assert {r.run for r in rows} == {f"run{k}" for k in range(10) if k != 4} and all(r.newick.endswith("0;") and r.seed == 0 and r.explored > 0 and r.samples == ["a", "b"] for r in rows)
    cells = batch.read_inputs(spark, str(folder))[0]
    name = lambda c: F.concat_ws("/", "run", c)
    found = trees.select(F.col("run").alias("method"), F.col("tree_idx").alias("tree"), "llh", "run", "phi")
    freq = found.select("method", "tree", "run", F.posexplode("phi").alias("node", "row")).select("method", "tree", name("node").alias("node"), F.posexplode("row").alias("sample", "f"))
    members = cells.select(name("node").alias("mut"), name("node").alias("node")).distinct()
    scores = metrics.perplexity(found.select("method", "tree", "llh"), freq, members, cells.withColumn("mut", name("node"))).collect()
    assert len(scores) == 9 and all(0 < r.score < 50 for r in scores)
