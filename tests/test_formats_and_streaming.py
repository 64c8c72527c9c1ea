"""Files in and out, and counts of a stream."""

import json

import pytest
from pyspark.sql import functions as F

from arbora.operators import cluster
from arbora.operators.search import SearchParams, package, search
from arbora.sources import formats
from arbora.streaming import count_reads

# The reads of the worked example (depth 50 and probability one half everywhere) and its order of clusters.
READS = {
    "s0": "30,20,22", "s1": "0,9,0", "s2": "28,1,19", "s3": "0,0,9", "s4": "0,0,11",
    "s5": "20,1,13", "s6": "0,1,8", "s7": "1,0,9", "s8": "26,1,21", "s9": "21,21,22",
}
ORDER = ["s9", "s0", "s1", "s2", "s4", "s3", "s7", "s5", "s8", "s6"]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    base = tmp_path_factory.mktemp("in")
    lines = ["id\tname\tvar_reads\ttotal_reads\tvar_read_prob"] + [f"{i}\tn{i}\t{v}\t50,50,50\t0.5,0.5,0.5" for i, v in READS.items()]
    (base / "x.ssm").write_text("\n".join(lines) + "\n")
    (base / "x.params.json").write_text(json.dumps({"samples": ["a", "b", "c"], "clusters": [[i] for i in ORDER], "more": 1}))
    return base


def test_cells_of_the_example(spark, files):
    ssm, params = formats.read_ssm(spark, str(files / "x.ssm")), formats.read_params(spark, str(files / "x.params.json"))
    cells = {(r.node, r.sample): (r.v, r.n, r.omega) for r in formats.cells_of(ssm, params).collect()}
    assert cells == {(k + 1, s): (int(v), 50, 0.5) for k, i in enumerate(ORDER) for s, v in enumerate(READS[i].split(","))}
    assert params.first().garbage == []


@pytest.mark.parametrize("line", ["s1\tn\t1,2\t3,4,5\t1,1,1", "s1\tn\t-1\t3\t1", "s1\tn\tx\t3\t1", "s1\tn\t1\t3\t0", "s1\tn\t1\t3\t1\ns1\tn\t1\t3\t1"])
def test_wrong_mutation_files(spark, tmp_path, line):
    (tmp_path / "y.ssm").write_text("id\tname\tvar_reads\ttotal_reads\tvar_read_prob\n" + line + "\n")
    with pytest.raises(formats.InvalidInput):
        formats.read_ssm(spark, str(tmp_path / "y.ssm"))


def test_rescaled_depth(spark, tmp_path):
    (tmp_path / "z.ssm").write_text("id\tname\tvar_reads\ttotal_reads\tvar_read_prob\ns0\ta\t10,0\t100,0\t0.5,0.5\ns1\tb\t10,4\t50,8\t0.5,1\n")
    got = {r.id: (r.var_reads, r.total_reads) for r in formats.read_ssm(spark, str(tmp_path / "z.ssm"), rescale_depth=True).collect()}
    assert got == {"s0": ([8, 0], [75, 4]), "s1": ([15, 2], [75, 4])}


def test_example_search_tables(spark, files, tmp_path):
    ssm, params = formats.read_ssm(spark, str(files / "x.ssm")), formats.read_params(spark, str(files / "x.params.json"))
    small = formats.cells_of(ssm, params).where("node <= 4")
    trees = formats.tree_table(package(search(small, SearchParams(beam_width=2, branching_factor=4, expansion_factor=2, model="bs"))))
    full = formats.to_method(trees, "arbora", params)
    formats.write_trees(full, str(tmp_path / "trees"))
    got = formats.read_trees(spark, str(tmp_path / "trees")).orderBy("tree_idx").collect()
    assert len(got) == 2 and got[0].llh >= got[1].llh and got[0].newick.endswith("0;") and len(got[0].phi) == 5 and got[0].phi[0] == [1.0] * 3
    with pytest.raises(formats.InvalidInput):
        formats.write_trees(full.withColumn("phi", F.slice("phi", 1, 2)), str(tmp_path / "no"))


def test_clusters_csv_and_params(spark, files, tmp_path):
    params = formats.read_params(spark, str(files / "x.params.json"))
    chosen = spark.createDataFrame([([["s10", "s2"], ["s9"]],)], "clusters array<array<string>>")
    formats.write_assignment(cluster.assignment(chosen, keys=()), str(tmp_path / "csv"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()] == [("s2", "0"), ("s9", "1"), ("s10", "0")]
    formats.write_params(formats.with_clusters(params, chosen), str(tmp_path / "params"))
    again = formats.read_params(spark, str(tmp_path / "params")).first()
    assert again.clusters == [["s10", "s2"], ["s9"]] and again.samples == ["a", "b", "c"]


def test_counts_of_a_stream(spark, tmp_path):
    rows = [(i % 3, i % 2, i % 5 == 0) for i in range(60)] + [(None, 1, True), (1, 1, None)]
    schema = "node int, sample int, variant boolean"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(str(tmp_path / "reads"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "reads"))
    q = count_reads(stream).writeStream.outputMode("complete").format("memory").queryName("read_counts").start()
    try:
        q.processAllAvailable()
        got = {tuple(r) for r in spark.table("read_counts").collect()}
    finally:
        q.stop()
    assert got == {tuple(r) for r in count_reads(spark.createDataFrame(rows, schema)).collect()} and len(got) == 6
