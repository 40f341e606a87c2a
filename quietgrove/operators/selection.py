"""Choosing one split per node: utilities, probabilities, private draws, argmax."""

from __future__ import annotations

from typing import Optional, Sequence, Union

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietgrove.functions import text
from quietgrove.functions.draws import fresh_seed, uniform_sql
from quietgrove.operators.histogram import CANDIDATE
from quietgrove.operators.prefix import chunk_of, running_sums


def utility_sql(gain: str, node_budget: Union[float, str], delta_g: float) -> str:
    """``node_budget`` is a number or SQL text."""
    budget = node_budget if isinstance(node_budget, str) else text.literal(float(node_budget))
    return f"{budget} * {gain} / {text.literal(2.0 * delta_g)}"


def utility(cands: DataFrame, node_budget: Union[float, str], delta_g: float, gain: str = "gain",
            name: str = "utility") -> DataFrame:
    """Add the budget-scaled gain."""
    return cands.selectExpr("*", f"{utility_sql(text.name(gain), node_budget, delta_g)} AS {name}")


def _group_join(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach one aggregate row per group. There are as many groups as tree nodes; the
    planner broadcasts them while they are below its own size limit."""
    if keys:
        return df.join(side, list(keys))
    one = side.first()
    return df.select("*", *[F.lit(one[c]).alias(c) for c in side.columns])


def log_sum_exp(df: DataFrame, keys: Sequence[str], col: str, name: str = "lse") -> DataFrame:
    """Stable log(sum(exp(col))) per group, in two partial-aggregating passes."""
    tops = df.groupBy(*keys).agg(F.max(col).alias("_top"))
    shifted = _group_join(df, tops, keys)
    total = F.log(F.sum(F.exp(F.col(col) - F.col("_top")))) + F.max("_top")
    return shifted.groupBy(*keys).agg(total.alias(name))


def split_probabilities(cands: DataFrame, by: Sequence[str] = (), score: str = "utility",
                        include_zero: bool = False) -> DataFrame:
    """Add ``probability``: softmax of the utilities, 0 where a utility is not positive.

    ``include_zero`` lets candidates without gain count in the normaliser, so that the
    probabilities of a node may add up to less than 1.
    """
    counted = cands if include_zero else cands.where(F.col(score) > 0)
    norms = log_sum_exp(counted, by, score, "_norm")
    if by:
        joined = cands.join(norms, list(by), "left")
    else:
        one = norms.first()
        joined = cands.withColumn("_norm", F.lit(one["_norm"] if one else None).cast("double"))
    p = F.when(F.col(score) > 0, F.exp(F.col(score) - F.col("_norm"))).otherwise(F.lit(0.0))
    return joined.withColumn("probability", p).drop("_norm")


def split_cdf(cands: DataFrame, by: Sequence[str] = (), probability: str = "probability",
              rows_per_chunk: int = 500_000) -> DataFrame:
    """Add ``cdf``: running sum of the probabilities in candidate order. The running sum is
    chunked by feature and, where a feature has many candidates, by ranges of its values, so
    neither a node nor a (node, feature) is one window."""
    summed = running_sums(cands, by, ["value", "category"], [probability],
                          _cdf_chunk(cands, rows_per_chunk), totals=False)
    return summed.withColumn("cdf", F.col(f"before_{probability}") + F.col(probability)).drop(
        f"before_{probability}")


#: The first six bytes of a category as a number; equal or rising along the categories.
_LEADING = "CAST(conv(hex(rpad(substring(CAST(category AS binary), 1, 6), 6, X'00')), 16, 10) AS double)"


def _cdf_chunk(cands: DataFrame, rows_per_chunk: int) -> str:
    """Feature and range of values, as SQL text that rises along the candidates."""
    sizes = {r["feature_idx"]: r["n"] for r in cands.groupBy("feature_idx").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    large = {i: n // rows_per_chunk for i, n in sizes.items() if n > rows_per_chunk}
    if not large:
        return "feature_idx"
    key = f"coalesce(value, {_LEADING})"
    most = max(large.values())
    shares = [j / (most + 1) for j in range(1, most + 1)]
    found = cands.where(F.col("feature_idx").isin(list(large))).groupBy("feature_idx").agg(F.percentile_approx(
        F.expr(key), shares, max(20_000, 20 * most)).alias("bounds")).collect()
    cases = []
    for r in found:
        step = max(1, most // large[r["feature_idx"]])
        bounds = sorted(set((r["bounds"] or [])[step - 1::step]))
        cases.append((f"feature_idx = {r['feature_idx']}", chunk_of(key, bounds) if bounds else "0"))
    return f"struct(feature_idx AS f, {text.case(cases, '0')} AS part)"


def _row(cands: DataFrame, by: Sequence[str]) -> str:
    return "struct({})".format(", ".join(text.names([c for c in cands.columns if c not in by])))


def _pick(cands: DataFrame, by: Sequence[str], pick: str, order: str) -> DataFrame:
    chosen = cands.groupBy(*by).agg(F.expr(f"{pick}({_row(cands, by)}, {order}) AS _best"))
    if not by:  # a global aggregate yields a row even without candidates
        chosen = chosen.where("_best IS NOT NULL")
    return chosen.selectExpr(*text.names(by), "_best.*")


def with_noise(cands: DataFrame, by: Sequence[str] = (), seed=None, score: str = "utility",
               reverse: bool = False, keys: Optional[Sequence[str]] = None) -> DataFrame:
    """Candidates with positive utility and ``noisy`` = utility + Gumbel noise.

    ``keys`` are the SQL expressions that a draw depends on besides the seed; by default group,
    feature, value and category.
    """
    u = uniform_sql(fresh_seed(seed), *(keys or text.names([*by, *CANDIDATE])))
    return cands.where(f"{text.name(score)} > 0").selectExpr(
        "*", f"{'-' if reverse else ''}{text.name(score)} - ln(-ln({u})) AS noisy")


def exponential_mechanism(cands: DataFrame, by: Sequence[str] = (), seed=None,
                          score: str = "utility", reverse: bool = False) -> DataFrame:
    """Draw one candidate per group with probability proportional to exp(utility), among
    those with positive utility; groups without one yield no row.

    The maximum of utility + Gumbel noise has exactly this distribution and needs no
    normaliser, so the draw is a plain ``max_by``. ``reverse`` prefers low utilities.
    """
    return _pick(with_noise(cands, by, seed, score, reverse), by, "max_by", "noisy").drop("noisy")


def _gain_order(gain: str) -> str:
    """Ascending order of preference: gain, then first feature, then lowest value."""
    return f"struct(-{text.name(gain)}, {', '.join(CANDIDATE)})"


def best_split(cands: DataFrame, by: Sequence[str] = (), gain: str = "gain") -> DataFrame:
    """Candidate with the highest positive gain per group; ties go to the first feature,
    then to the lowest value."""
    return _pick(cands.where(f"{text.name(gain)} > 0"), by, "min_by", _gain_order(gain))


def best_per_feature(cands: DataFrame, by: Sequence[str], noisy: bool) -> DataFrame:
    """The winner of each (group, feature). The running sums left the candidates partitioned
    by group and feature, so this costs no exchange; the winner over the features of a node
    is then found among a handful of rows."""
    by = [*by, "feature_idx"]
    if noisy:
        return _pick(cands, by, "max_by", "noisy")
    return _pick(cands.where("gain > 0"), by, "min_by", "struct(-gain, value, category)")


def best_by_budget(cands: DataFrame, by: Sequence[str], budgets: Sequence[float], delta_g: float, seed,
                   keys: Sequence[str], gain: str = "gain") -> DataFrame:
    """The private winner of each (group, feature) for each of several node budgets; ``budget`` is its
    number. A candidate is drawn once: budgets scale its gain, and its noise is the same for all."""
    by = [*by, "feature_idx"]
    drawn = cands.where(f"{text.name(gain)} > 0").selectExpr("*", f"ln(-ln({uniform_sql(seed, *keys)})) AS _noise")
    fields = ", ".join(text.names([c for c in cands.columns if c not in (*by, "_word")]))
    picks = []
    for i, b in enumerate(budgets):
        score = utility_sql(text.name(gain), b, delta_g)
        noisy = f"{score} - _noise"
        picks.append(F.expr(f"max_by(struct({fields}, {noisy} AS noisy), CASE WHEN {score} > 0 THEN {noisy} END) "
                            f"AS _best_{i}"))
    chosen = drawn.groupBy(*by).agg(*picks)
    listed = ", ".join(f"_best_{i}" for i in range(len(budgets)))
    return chosen.selectExpr(*text.names(by), f"posexplode(array({listed})) AS (budget, _best)").where(
        "_best IS NOT NULL").selectExpr(*text.names(by), "budget", "_best.*")


def best_per_node(winners: DataFrame, by: Sequence[str], noisy: bool) -> DataFrame:
    """The winner over the features of each group, from those of its features."""
    score = "-noisy" if noisy else "-gain"
    return _pick(winners, by, "min_by", f"struct({score}, feature_idx)")
