"""Placements of one node into partial trees: candidates, scores, and the best of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import EPSILON, clip, softmax, wald_interval
from arbora.functions.numeric import MIN_OMEGA, MIN_VAR_READS, betainc_arrays
from arbora.operators.trees import child_sets

#: Codes of the two kinds of action (fixed values): u takes over children of v, or becomes a leaf under v.
SPLIT, LEAF = 1, 2


def candidate_columns(monoprimary: bool = False) -> dict[str, Column]:
    """The columns that ``candidates`` works with. Building them takes longer than using them: loops build them once."""
    placed = F.filter(F.transform("parents", lambda p, i: F.when(p >= 0, i + 1).otherwise(-1)), lambda v: v > 0)
    below = F.filter(F.transform("parents", lambda p, i: F.when(p == F.col("v"), i + 1).otherwise(-1)), lambda x: x > 0)
    lone = F.forall("parents", lambda p: p < 0) if monoprimary else F.lit(False)
    none, leaf = F.array().cast("array<array<int>>"), F.array(F.array().cast("array<int>"))
    leaves = F.when((F.col("v") != 0) | lone, leaf).otherwise(none) if monoprimary else leaf
    return {"v": F.explode(F.concat(F.array(F.lit(0)), placed)), "children": below, "leaves": leaves, "fallback": lone, "model": F.when(F.size("c") > 0, SPLIT).otherwise(LEAF)}


def candidates(branches: DataFrame, max_placements: int = 10, monoprimary: bool = False, columns: dict[str, Column] | None = None) -> DataFrame:
    """``branches`` (parents, u, ...) with v, c, model: each way to put u under the root or a placed node v.

    Leaf: c is empty. Split: c is a non-empty set of at most ``max_placements`` children of v. ``monoprimary`` forbids leaves
    under the root; where that leaves nothing, u may become a leaf under any node, the root too (``fallback``). Any number of
    children will do: sets grow as rows, up to the size asked for.
    """
    x = columns or candidate_columns(monoprimary)
    at = branches.select("*", x["v"].alias("v")).select("*", x["children"].alias("children"))
    return child_sets(at, max_placements, "children", x["leaves"]).select("*", x["fallback"].alias("fallback"), x["model"].alias("model"))


def _cases(valid: Column, parents: Column, value: Column, any_valid: Column) -> Column:
    return F.when(~any_valid, EPSILON).when(valid, value).when(parents, EPSILON).otherwise(1 - EPSILON)


def _per_sample(sample: Column) -> Column:
    """What the score of one candidate takes from one sample (of ``fit.pack``, with the fit of the candidate's tree).

    vu, nu, ou: reads of u. root: whether v is the root. vv, nv, ov: reads of v. x: the frequency that v leaves for u (F_v less
    the children that stay, or eta_v for a leaf). For splits also vc, nc2 (summed reads, and summed 2 n omega, of c) and fc (the
    summed frequency of c); null for leaves.
    """
    s, fit = sample["samples"], sample["fits"]
    at = lambda a, i: F.element_at(a, i.cast("int"))
    freq = lambda i: at(fit["f"], i + 1)
    total = lambda nodes, value: F.aggregate(nodes, F.lit(0.0), lambda a, i: a + value(i).cast("double"))
    split, c = F.col("model") == SPLIT, F.col("c")
    v, u = F.greatest(F.col("v"), F.lit(1)), F.col("u")
    values = {
        "root": F.col("v") == 0,
        "vu": at(s["v"], u), "nu": at(s["n"], u), "ou": at(s["omega"], u),
        "vv": F.when(F.col("v") == 0, MIN_VAR_READS + 1).otherwise(at(s["v"], v)), "nv": at(s["n"], v), "ov": F.when(F.col("v") == 0, MIN_OMEGA).otherwise(at(s["omega"], v)),
        "x": F.when(split, freq(F.col("v")) - total(F.array_except("children", "c"), freq)).otherwise(at(fit["eta"], F.col("v") + 1)),
        "vc": F.when(split, total(c, lambda i: at(s["v"], i))), "nc": F.when(split, F.floor(total(c, lambda i: 2.0 * at(s["n"], i) * at(s["omega"], i)))), "fc": F.when(split, total(c, freq)),
    }
    return F.struct(*[x.alias(name) for name, x in values.items()])


def _orders(r: Column, v: Column, o: Column) -> tuple[Column, Column]:
    """Whether a sample can order u and the other node, and whether u alone has reads there."""
    seen = r["vu"] > MIN_VAR_READS
    parents = seen & (v <= MIN_VAR_READS)
    return ~(~seen | (r["ou"] < MIN_OMEGA) | (o < MIN_OMEGA) | parents), parents


def _marked(r: Column) -> Column:
    """Which samples decide, and the parameters of u's frequency and of the bounds on it there."""
    valid_v, parents_v = _orders(r, r["vv"], r["ov"])
    valid_c, parents_c = _orders(r, F.least(r["vc"], r["nc"]), F.lit(0.5))
    split = r["fc"].isNotNull()
    high = F.when(r["root"], r["x"]).otherwise(wald_interval(r["x"], r["nv"])[1])
    low = wald_interval(r["fc"], r["nc"])[0]
    values = {
        "valid_v": valid_v, "parents_v": parents_v, "valid_c": valid_c & split, "parents_c": parents_c & split, "split": split,
        "a": r["vu"] + 1.0, "b": r["nu"] - r["vu"] + 1.0,
        "high": F.when(valid_v, clip(r["ou"] * high, 0.0, 1.0)), "low": F.when(valid_c & split, clip(r["ou"] * low, 0.0, 1.0)),
    }
    return F.struct(*[F.coalesce(x, F.lit(False)).alias(name) if name.startswith(("valid", "parents")) else x.alias(name) for name, x in values.items()])


def score_columns() -> list[dict[str, Column]]:
    """The columns that ``scores`` adds, step by step."""
    marked = F.transform(F.transform(F.arrays_zip("samples", "fits"), _per_sample), _marked)

    def term(z: Column) -> Column:
        r = z["r"]
        mass = _cases(r["valid_v"], r["parents_v"], z["tail_v"], F.col("any_v"))
        less = F.when(r["split"], _cases(r["valid_c"], r["parents_c"], z["tail_c"], F.col("any_c"))).otherwise(0.0)
        return F.ln(F.greatest(mass - less, F.lit(EPSILON)))

    tails = {"tail_v": betainc_arrays("r.a", "r.b", "r.high"), "tail_c": betainc_arrays("r.a", "r.b", "r.low")}
    some = {"any_v": F.exists("r", lambda r: r["valid_v"]), "any_c": F.exists("r", lambda r: r["valid_c"])}
    score = F.aggregate(F.arrays_zip("r", "tail_v", "tail_c"), F.lit(0.0), lambda total, z: total + term(z))
    return [{"r": marked}, tails | some, {"score": score}]


def scores(cands: DataFrame, columns: list[dict[str, Column]] | None = None) -> DataFrame:
    """``cands`` (of ``candidates``, with samples of ``fit.pack`` and the fits of their trees) with score, samples and fits dropped.

    Samples can order two nodes if u has more than 3 variant reads and the other node too, and neither omega is tiny. There
    the score takes u's incomplete beta mass below x (raised by the Wald width of v's reads) less that below fc (lowered by
    c's). Where u has reads and the other has none the mass is epsilon, elsewhere 1 - epsilon; if no sample can order the two
    nodes, it is epsilon everywhere. Logs of the differences, raised to epsilon, are summed over samples. A candidate is one
    row with all its samples, so nothing is shuffled.
    """
    rows, keep = cands, [c for c in cands.columns if c not in ("samples", "fits")]
    for step in columns or score_columns():
        rows = rows.withColumns(step)
    return rows.select(*keep, "score")


def best(cands: DataFrame, branch: list[str], branching_factor: int = 20, ignore_zero_probs: bool = False) -> DataFrame:
    """The placements (score, v, model, c, ...) of largest probability for each branch, with prob and i (their rank from 0)."""
    over = Window.partitionBy(*branch)
    by_rank = over.orderBy(F.desc(F.round("prob", 12)), "v", "model", "c")
    rows = cands.withColumn("prob", softmax(F.col("score"), over)).withColumn("i", F.row_number().over(by_rank) - 1)
    if ignore_zero_probs:
        rows = rows.where("prob > 0")
    return rows.where(F.col("i") < branching_factor)


