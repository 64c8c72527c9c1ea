"""Readers and writers of the tool's files: mutation tables, parameters, trees, clusterings and scores.

Tables of trees and clusterings are Parquet with the columns of ``TREE`` and ``CLUSTERING``; run metadata is a table too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SSM = "id string, name string, var_reads string, total_reads string, var_read_prob string"
PARAMS = "samples array<string>, clusters array<array<string>>, garbage array<string>"
TREE = "method string, tree_idx int, parents array<int>, phi array<array<double>>, eta array<array<double>>, count bigint, llh double, prob double, newick string, clusters array<array<string>>"
TRUTH = "phi array<array<double>>, structure array<int>, clusters array<array<string>>, vids_garbage array<string>"
CLUSTERING = "step int, size int, llh double, parents array<int>, clusters array<array<string>>, sv_clusters array<array<string>>"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class InvalidInput(ValueError):
    """Raised with the number of offending rows."""


def require(rows: DataFrame, problem: str) -> None:
    """Fail if there are any ``rows``."""
    if n := rows.count():
        raise InvalidInput(f"{n} rows: {problem}")


def check(rows: DataFrame, problems: dict[str, Column], unique: dict[str, list[str]]) -> None:
    """Fail if any row has a problem, or if rows agree in the columns that tell them apart: all rules in one job, the first that
    is broken is named."""
    ((repeated, keys),), counts = unique.items(), [F.count_if(x).alias(f"p{k}") for k, x in enumerate(problems.values())]
    own = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *counts)
    found = own.agg(*[F.sum(f"p{k}") for k in range(len(problems))], F.count_if(F.col("n") > 1)).first()
    for problem, n in zip([*problems, repeated], found):
        if n:
            raise InvalidInput(f"{n} rows: {problem}")


def read_ssm(spark: SparkSession, path: str, rescale_depth: bool = False) -> DataFrame:
    """id, name, var_reads, total_reads, var_read_prob (arrays over samples) of a tab-separated mutation file.

    Lists of different lengths, negative or non-numeric counts and probabilities outside (0, 1] are errors, as are repeated
    ids. ``rescale_depth`` sets each sample's total reads to their mean and scales the variant reads alike, both rounded.
    """
    raw = spark.read.csv(path, sep="\t", header=True, schema=SSM, enforceSchema=False)
    cast = lambda c, t: F.transform(F.split(c, r"\s*,\s*"), lambda x: x.try_cast(t)).alias(c)
    rows = raw.select("id", "name", cast("var_reads", "bigint"), cast("total_reads", "bigint"), cast("var_read_prob", "double"))
    bad = lambda c, test: F.exists(c, lambda x: x.isNull() | test(x))
    check(
        rows,
        {
            "lists of different lengths": (F.size("var_reads") != F.size("total_reads")) | (F.size("var_reads") != F.size("var_read_prob")),
            "read counts must be whole numbers of 0 or more": bad("var_reads", lambda x: x < 0) | bad("total_reads", lambda x: x < 0),
            "probabilities must lie in (0, 1]": bad("var_read_prob", lambda x: (x <= 0) | (x > 1)),
        },
        {"repeated ids": ["id"]},
    )
    if not rescale_depth:
        return rows
    long = read_cells(rows)
    mean = long.groupBy("sample").agg(F.avg("n").alias("mean"))
    part = long.join(mean, "sample").select("id", "sample", F.coalesce(F.round(F.try_divide(F.col("v") * F.col("mean"), F.col("n"))), F.lit(0)).cast("bigint").alias("v"), F.round("mean").cast("bigint").alias("n"), "omega")
    packed = part.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sample", "v", "n", "omega"))).alias("x"))
    field = lambda c: F.transform("x", lambda y: y[c])
    return rows.select("id", "name").join(packed, "id").select("id", "name", field("v").alias("var_reads"), field("n").alias("total_reads"), field("omega").alias("var_read_prob"))


def read_cells(ssm: DataFrame) -> DataFrame:
    """id, sample (from 0), v, n, omega: one row for each mutation and sample."""
    zipped = F.arrays_zip("var_reads", "total_reads", "var_read_prob")
    return ssm.select("id", F.posexplode(zipped).alias("sample", "z")).select("id", "sample", F.col("z.var_reads").alias("v"), F.col("z.total_reads").alias("n"), F.col("z.var_read_prob").alias("omega"))


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """One row: samples, clusters, garbage (empty if absent). Other keys are ignored; repeated sample names are an error."""
    rows = spark.read.json(path, multiLine=True, schema=PARAMS).withColumn("garbage", F.coalesce("garbage", F.array().cast("array<string>")))
    require(rows.where(F.size("samples") != F.size(F.array_distinct("samples"))), "repeated sample names")
    return rows


def cluster_members(params: DataFrame) -> DataFrame:
    """node (from 1, in the order of clusters), id."""
    return params.select(F.posexplode("clusters").alias("i", "ids")).select((F.col("i") + 1).alias("node"), F.explode("ids").alias("id"))


def cells_of(ssm: DataFrame, params: DataFrame) -> DataFrame:
    """node, sample, v, n, omega: each cluster's pseudo-variant. Every cluster id must be in the mutation file."""
    from arbora.operators.reads import supervariants

    members = cluster_members(params)
    require(members.join(ssm, "id", "left_anti"), "clusters name ids that the mutation file lacks")
    return supervariants(read_cells(ssm).join(members, "id"), "node", "sample")


def write_params(params: DataFrame, path: str) -> None:
    params.coalesce(1).write.json(path)


def with_clusters(params: DataFrame, clustering: DataFrame) -> DataFrame:
    """The one row of params with its clusters replaced by those of the one row of ``clustering``."""
    one = F.lit(1).alias("_one")
    return params.drop("clusters").select("*", one).join(clustering.select("clusters", one), "_one").select("samples", "clusters", "garbage")


def write_trees(trees: DataFrame, path: str) -> None:
    """Trees of ``TREE``'s columns, checked for rows of frequencies and for whole, finite values."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    problems = {f"{m} needs a row for the root and each node": F.size(m) != F.size("parents") + 1 for m in ("phi", "eta")}
    problems |= {f"{m} holds values that are not finite": F.exists(m, lambda row: F.exists(row, odd)) for m in ("phi", "eta")}
    problems["parents must be nodes of the tree"] = F.exists("parents", lambda p: p.isNull() | (p < 0) | (p > F.size("parents")))
    problems["every tree needs a count and a log likelihood"] = F.col("count").isNull() | (F.col("count") < 1) | F.col("llh").isNull()
    check(trees, problems, {"a method's trees need numbers of their own": ["method", "tree_idx"]})
    trees.select(*_names(TREE)).write.parquet(path)


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TREE).parquet(path)


def with_sample_names(trees: DataFrame, params: DataFrame) -> DataFrame:
    """``trees`` of ``archive.read_archives`` with the sample names of the one row of params where a file has none."""
    one = F.lit(1).alias("_one")
    rows = trees.select("*", one).join(params.select(F.col("samples").alias("_samples"), one), "_one")
    return rows.withColumn("samples", F.coalesce("samples", "_samples")).drop("_one", "_samples")


def one_tree(trees: DataFrame, tree_idx: int) -> DataFrame:
    """The tree of that number; an error if there is none."""
    rows = trees.where(F.col("tree_idx") == tree_idx)
    if rows.isEmpty():
        raise InvalidInput(f"no tree has the number {tree_idx}")
    return rows


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a simulation's truth: frequencies (rows: the root and its nodes), parents, clusters and garbage."""
    rows = spark.read.schema(TRUTH).parquet(path)
    require(rows.where(F.size("phi") != F.size("structure") + 1), "phi needs a row for the root and each node")
    return rows


def truth_frequencies(truth: DataFrame) -> DataFrame:
    """node, sample, f of a truth, the root too."""
    rows = truth.select(F.posexplode("phi").alias("node", "row"))
    return rows.select("node", F.posexplode("row").alias("sample", "f"))


def truth_trees(truth: DataFrame, trees: DataFrame | None = None) -> DataFrame:
    """``TREE``'s columns but eta and newick, as method ``truth``: the true tree, or those of ``trees`` (parents; see
    ``enumerate_trees``) with the true frequencies and clusters. All weigh the same: llh is 0 and count 1."""
    one = F.lit(1).alias("_one")
    rows = (truth.select(F.col("structure").alias("parents")) if trees is None else trees.select("parents")).select("parents", one)
    every = Window.partitionBy("_one")  # the trees of one truth
    rows = rows.withColumns({"tree_idx": F.row_number().over(every.orderBy("parents")) - 1, "prob": 1.0 / F.count(F.lit(1)).over(every)})
    rows = rows.join(truth.select("phi", "clusters", one), "_one")
    return rows.select(F.lit("truth").alias("method"), "tree_idx", "parents", "phi", F.lit(1).cast("long").alias("count"), F.lit(0.0).alias("llh"), "prob", "clusters")


def write_clusterings(clusterings: DataFrame, path: str) -> None:
    clusterings.select(*_names(CLUSTERING)).write.parquet(path)


def read_clusterings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLUSTERING).parquet(path)


def to_method(trees: DataFrame, method: str, params: DataFrame) -> DataFrame:
    """Trees of a run under a method's name, each with the run's clusters."""
    one = F.lit(1).alias("_one")
    rows = trees.drop("method", "clusters").select(F.lit(method).alias("method"), "*", one)
    return rows.join(params.select("clusters", one), "_one").drop("_one")


def write_assignment(rows: DataFrame, path: str) -> None:
    """The CSV ``id,clusters``, ordered by the number in the id."""
    rows.orderBy(F.expr("try_cast(substr(id, 2) AS bigint)"), "id").coalesce(1).write.csv(path, header=True)


def matrix_column(freq: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, matrix array<array<double>>: rows are nodes 0..n, columns samples."""
    row = freq.groupBy(*keys, "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", value))), lambda s: s[value]).alias("row"))
    return row.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "row"))), lambda s: s["row"]).alias("matrix"))


def tree_table(packaged: DataFrame, method: str = "arbora", keys: Sequence[str] = ()) -> DataFrame:
    """``search.package``'s rows (with ``keys``, such as run) with ``TREE``'s columns but clusters."""
    from arbora.operators.trees import edges_of, newick

    keys = list(keys)
    turned = lambda c: F.transform(F.sequence(F.lit(0), F.size("parents")), lambda i: F.transform("fits", lambda s: F.get(s[c], i)))
    rows = packaged.select(*keys, F.lit(method).alias("method"), (F.col("rank") - 1).alias("tree_idx"), "parents", turned("f").alias("phi"), turned("eta").alias("eta"), "count", "llh", "prob")
    return rows.join(newick(edges_of(rows, keys=[*keys, "tree_idx"]), [*keys, "tree_idx"]), [*keys, "tree_idx"])
