"""Scoring company rows: loss probability, cost of a loss, profile statistics.

The lookup tables are constants of a few dozen rows; they become literals in the
expression, so scoring is a map-only projection.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietgrove.functions import risk_tables as rt
from quietgrove.functions import text
from quietgrove.functions.columns import clamp
from quietgrove.functions.draws import fresh_seed, normal, triangular, uniform

SIZE, SECTOR = "company_size", "company_sector"
LOSS, COST = "company_suffers_a_loss", "cost_of_loss"
JITTER_PERCENT = 15.0


def feature_probability(flag: str, table: Mapping[str, float]) -> Column:
    """p if the flag is set, else 1 - p."""
    p = float(table[flag])
    return F.when(F.col(flag) == 1, F.lit(p)).otherwise(F.lit(1.0 - p))


def _flag_map(keys: Sequence[str], rows) -> Column:
    """Probability of a flag combination, from a literal map over the joined flags."""
    cases = ", ".join(f"'{''.join(str(v) for v in r[:-1])}', {text.literal(float(r[-1]))}"
                      for r in rows)
    key = ", ".join(f"CAST({text.name(k)} AS string)" for k in keys)
    return F.expr(f"element_at(map({cases}), concat({key}))")


def cpt_lookup(df: DataFrame, table: str, name: str = "p") -> DataFrame:
    """Add the probability of the row's flags in a conditional table."""
    keys, rows = rt.CONDITIONAL_TABLES[table]
    return df.withColumn(name, _flag_map(keys, rows))


def _by_size(values: Mapping[str, float]) -> Column:
    return F.when(F.col(SIZE) == "small", F.lit(float(values["small"]))).when(
        F.col(SIZE) == "large", F.lit(float(values["large"])))


def _by_size_and_sector(values: Mapping[str, Mapping[str, float]]) -> Column:
    cases = ", ".join(f"'{size}|{sector}', {text.literal(float(v))}"
                      for size, inner in values.items() for sector, v in inner.items())
    return F.expr(f"element_at(map({cases}), concat({SIZE}, '|', {SECTOR}))")


def _product(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out * p
    return out


def loss_probability(df: DataFrame, version: str = "new", name: str = LOSS) -> DataFrame:
    """Probability that the company suffers a loss, by Bayes' rule over its protections,
    at most 1."""
    if version == "old":
        return df.withColumn(name, _old_loss())
    sector = _by_size_and_sector(rt.SECTOR_GIVEN_SIZE)
    single = list(rt.FEATURE_GIVEN_LOSS)
    lookup = {t: _flag_map(*rt.CONDITIONAL_TABLES[t]) for t in rt.CONDITIONAL_TABLES}
    given_loss = _product([sector, *[feature_probability(f, rt.FEATURE_GIVEN_LOSS)
                                     for f in single], lookup["R2PS"], lookup["PDTI"]])
    # The sector term stands above and below the line; the size only below.
    overall = _product([
        sector, _by_size(rt.SIZE_PROBABILITY),
        *[feature_probability(f, rt.FEATURE_PROBABILITY) for f in single],
        *[feature_probability(f, rt.FEATURE_PROBABILITY)
          for f in ("company_does_red_teaming", "company_has_2FA", "company_has_IDS")],
        *[lookup[t] for t in ("PWD", "SOC", "IPS", "THREAT", "IOC")]])
    return df.withColumn(name, F.least(given_loss * F.lit(rt.LOSS_PRIOR) / overall, F.lit(1.0)))


def _old_loss() -> Column:
    flags = list(rt.OLD_FEATURE_PROBABILITY)

    def given(flag):
        by_size = {s: rt.OLD_FEATURE_GIVEN_LOSS[s][flag] for s in ("small", "large")}
        p = _by_size(by_size)
        return F.when(F.col(flag) == 1, p).otherwise(F.lit(1.0) - p)

    above = _product([given(f) for f in flags]) * F.lit(rt.OLD_LOSS_PRIOR)
    below = _product([feature_probability(f, rt.OLD_FEATURE_PROBABILITY) for f in flags])
    return clamp(F.round(above / below, 4), 0.0, 1.0)


def _leaked_cost() -> Column:
    """Cost of the data types that the company holds and that its sector may hold."""
    total = F.lit(0.0)
    for kind in ("pii", "pci", "phi", "credentials", "other"):
        sectors = [s for s, kinds in rt.SECTOR_DATA.items() if kind in kinds]
        held = (F.col(f"company_has_{kind}") == 1) & F.col(SECTOR).isin(sectors)
        cost = _by_size({s: rt.DATA_COST[s][kind] for s in ("small", "large")})
        total = total + F.when(held, cost).otherwise(F.lit(0.0))
    return total


def _fraction(changes: Mapping[str, tuple[float, float]]) -> Column:
    total = F.lit(1.0)
    for flag, (yes, no) in changes.items():
        total = total + F.when(F.col(flag) == 1, F.lit(yes)).otherwise(F.lit(no))
    return F.greatest(total, F.lit(0.0))


def _breach(part: int) -> Column:
    return _by_size_and_sector({size: {s: v[part] for s, v in inner.items()}
                                for size, inner in rt.BREACH_COST.items()})


def potential_cost(df: DataFrame, version: str = "new", seed=None, key: str = "row_id",
                   name: str = COST) -> DataFrame:
    """Cost of a loss in thousands. The older version draws the breach cost from a
    triangular distribution."""
    crisis = _by_size_and_sector(rt.CRISIS_COST)
    if version == "old":
        lo, mode, hi = (_breach(i) for i in range(3))
        lo = F.when(lo == hi, lo - 1).otherwise(lo)
        out = df.withColumns({"_lo": lo, "_mode": mode, "_hi": hi,
                              "_u": uniform(f"{fresh_seed(seed)}|breach", key)})
        draw = triangular(F.col("_u"), F.col("_lo"), F.col("_mode"), F.col("_hi"))
        return out.withColumn(name, F.round(_leaked_cost() + crisis + draw, 2)).drop(
            "_lo", "_mode", "_hi", "_u")
    breach = clamp(_breach(1) * _fraction(rt.BREACH_FRACTION), _breach(0), _breach(2))
    total = _leaked_cost() + breach + crisis * _fraction(rt.CRISIS_FRACTION)
    return df.withColumn(name, F.round(total, 2))


def profile_distribution(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of each combination of values, in percent with two decimals."""
    n = df.count()
    return df.groupBy(*cols).agg(
        F.round(F.count(F.lit(1)) / F.lit(float(n)) * F.lit(100.0), 2).alias("percent"))


def _lognormal(value: str, percent: float, seed: str, key: str) -> Column:
    """Log-normal draw with the column's value as mean and a share of it as deviation."""
    mean = F.col(value)
    std = mean / 100.0 * percent
    mu = F.log(mean * mean / F.sqrt(mean * mean + std * std))
    sigma = F.sqrt(F.log(F.lit(1.0) + std * std / (mean * mean)))
    z = normal(uniform(f"{seed}|{value}|1", key, "copy"), uniform(f"{seed}|{value}|2", key, "copy"))
    return F.round(F.exp(mu + sigma * z), 3)


def augment_rows(df: DataFrame, n: int, percent: float = JITTER_PERCENT, seed=None,
                 key: str = "row_id", loss: str = LOSS, cost: str = COST) -> DataFrame:
    """n copies of each row with jittered targets; ``copy`` numbers them from 1."""
    seed = fresh_seed(seed)
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(int(n)))))
    return copies.withColumns({
        loss: clamp(_lognormal(loss, percent, seed, key), 0.0, 1.0),
        cost: _lognormal(cost, percent, seed, key)})
