"""Folders of inputs: all mutation and parameter files below a path as tables with a column ``run``.

Inputs that break a rule are set aside with the reason; the others go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators.reads import supervariants
from arbora.sources.archive import write_archives
from arbora.sources.formats import PARAMS, SSM, tree_table

MUTATIONS, PARAMETERS = "*.ssm", "*.params.json"


def _run(by_folder: bool) -> Column:
    """A file's name up to its first dot; or the name of its folder, without what stands before an equals sign there."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -2 if by_folder else -1)
    return F.substring_index(name, "=", -1) if by_folder else F.substring_index(name, ".", 1)


def read_mutations(spark: SparkSession, path: str, names: str = MUTATIONS, by_folder: bool = False) -> DataFrame:
    """run, id, name, var_reads, total_reads, var_read_prob of all mutation files, columns by position; what isn't a number is null."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=SSM, recursiveFileLookup=True, pathGlobFilter=names)
    cast = lambda c, t: F.transform(F.split(c, r"\s*,\s*"), lambda x: x.try_cast(t)).alias(c)
    return raw.select(_run(by_folder).alias("run"), "id", "name", cast("var_reads", "bigint"), cast("total_reads", "bigint"), cast("var_read_prob", "double"))


def read_parameters(spark: SparkSession, path: str, names: str = PARAMETERS, by_folder: bool = False) -> DataFrame:
    """run, samples, clusters, garbage of all parameter files; what can't be read as such is null."""
    rows = spark.read.json(path, multiLine=True, schema=PARAMS, recursiveFileLookup=True, pathGlobFilter=names)
    return rows.select(_run(by_folder).alias("run"), "samples", "clusters", F.coalesce("garbage", F.array().cast("array<string>")).alias("garbage"))


def problems(mutations: DataFrame, params: DataFrame) -> DataFrame:
    """run, problem: each rule that a run breaks, all rules in one pass over each table and one join of both."""
    wrong = lambda c, bad: F.exists(c, lambda x: x.isNull() | bad(x))
    no = lambda x: F.coalesce(x, F.lit(True))
    by_id = mutations.groupBy("run", "id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("var_reads")).alias("most"), F.min(F.size("var_reads")).alias("least"),
        F.bool_or(no((F.size("var_reads") != F.size("total_reads")) | (F.size("var_reads") != F.size("var_read_prob")))).alias("lists"),
        F.bool_or(no(wrong("var_reads", lambda x: x < 0) | wrong("total_reads", lambda x: x < 0))).alias("counts"),
        F.bool_or(no(wrong("var_read_prob", lambda x: (x <= 0) | (x > 1)))).alias("chances"),
    )
    of_files = by_id.groupBy("run").agg(
        F.bool_or("lists").alias("lists of different lengths"), F.bool_or("counts").alias("read counts must be whole numbers of 0 or more"), F.bool_or("chances").alias("probabilities must lie in (0, 1]"),
        F.bool_or(F.col("n") > 1).alias("repeated ids"), F.max("most").alias("most"), F.min("least").alias("least"),
    )
    named = params.select("run", F.explode_outer(F.flatten("clusters")).alias("id")).join(by_id.select("run", "id", "n"), ["run", "id"], "left")
    named = named.groupBy("run").agg(F.bool_or(F.col("id").isNotNull() & F.col("n").isNull()).alias("clusters name ids that the mutation file lacks"))
    of_params = params.groupBy("run").agg(
        F.bool_or(no(F.size("samples") != F.size(F.array_distinct("samples")))).alias("repeated sample names"), F.bool_or(no(F.size("clusters") <= 0) | F.exists("clusters", lambda c: F.size(c) == 0)).alias("no clusters, or an empty one"),
        F.max(F.size("samples")).alias("samples"), (F.count(F.lit(1)) > 1).alias("two files of the same name"),
    )
    both = of_files.join(of_params.join(named, "run"), "run", "full")
    found = [c for c in both.columns if c not in ("run", "most", "least", "samples")]
    rules = {c: F.coalesce(F.col(f"`{c}`"), F.lit(False)) for c in found}
    rules["no mutation file"] = F.col("most").isNull()
    rules["no parameter file"] = F.col("samples").isNull()
    rules["as many reads as samples are asked for"] = F.coalesce((F.col("most") != F.col("samples")) | (F.col("least") != F.col("samples")), F.lit(False))
    listed = F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()])
    return both.select("run", F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("problem"))


def read_inputs(spark: SparkSession, path: str, mutations: str = MUTATIONS, parameters: str = PARAMETERS, by_folder: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, params, problems): run, node, sample, v, n, omega of all good runs, as ``search`` takes them; their parameters; and
    run, problem of the others. ``by_folder`` takes a run's name from its folder instead of its files."""
    mutations, params = read_mutations(spark, path, mutations, by_folder), read_parameters(spark, path, parameters, by_folder)
    bad = problems(mutations, params)
    good = lambda rows: rows.join(bad.select("run"), "run", "left_anti")
    members = good(params).select("run", F.posexplode("clusters").alias("i", "ids")).select("run", (F.col("i") + 1).alias("node"), F.explode("ids").alias("id"))
    reads = F.arrays_zip("var_reads", "total_reads", "var_read_prob")
    rows = mutations.join(members, ["run", "id"]).select("run", "node", F.posexplode(reads).alias("sample", "z"))
    rows = rows.select("run", "node", "sample", F.col("z.var_reads").alias("v"), F.col("z.total_reads").alias("n"), F.col("z.var_read_prob").alias("omega"))
    return supervariants(rows, "run", "node", "sample"), good(params), bad


def search_folder(spark: SparkSession, path: str, out: str, search_params=None) -> DataFrame:
    """Search all inputs below a path together, write an archive for each good run to ``out`` and the problems of the others to
    ``out``/problems (JSON lines), and return those."""
    from arbora.operators.search import SearchParams, package, search

    p = search_params or SearchParams()
    cells, params, bad = read_inputs(spark, path)
    bad.write.mode("overwrite").json(f"{out}/problems")
    if not cells.isEmpty():
        done = search(cells, p)
        counters = done.groupBy("run", "instance").agg(F.max("explored").alias("explored"), F.max("cut").alias("cut")).groupBy("run").agg(F.sum("explored").alias("explored"), F.sum("cut").alias("cut"))
        trees = tree_table(package(done, ["run"]), keys=["run"]).join(counters, "run").join(params, "run").withColumn("seed", F.lit(p.seed).cast("long"))
        write_archives(trees, f"{out}/archives", "overwrite")
    return spark.read.schema("run string, problem string").json(f"{out}/problems")
