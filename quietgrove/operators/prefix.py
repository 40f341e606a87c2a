"""Running sums inside groups that may be too large for one task.

A group is cut into value chunks. Chunk totals are small and get their own running sum; the
rows only need a window inside their chunk plus the total of the chunks before it.
"""

from __future__ import annotations

from typing import Mapping, Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietgrove.functions import text


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Sequence[str],
                 chunk: Optional[str] = None, totals: bool = True,
                 next_of: Optional[str] = None) -> DataFrame:
    """Add ``before_<s>`` (sum over earlier rows), ``total_<s>`` (sum over the group) and, on
    request, ``next_<c>`` (value of ``c`` in the following row, null in the last).

    ``chunk`` is SQL text that must not decrease along ``order``. Without it each group is
    one window.
    """
    by = text.names(by)

    def window(keys, ordering=None, frame=""):
        parts = (["PARTITION BY " + ", ".join(keys)] if keys else [])
        parts += ["ORDER BY " + ", ".join(ordering)] if ordering else []
        return f"OVER ({' '.join([*parts, frame])})"

    earlier = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    order = text.names(order)
    if chunk is None:
        cols = [f"coalesce(sum({s}) {window(by, order, earlier)}, 0) AS before_{s}" for s in sums]
        if totals:
            cols += [f"sum({s}) {window(by)} AS total_{s}" for s in sums]
        if next_of:
            cols.append(f"lead({next_of}) {window(by, order)} AS next_{next_of}")
        return df.selectExpr("*", *cols)

    cut = df.selectExpr("*", f"{chunk} AS _chunk")
    heads = cut.groupBy(*by, "_chunk").agg(
        *[F.sum(s).alias(f"_c_{s}") for s in sums],
        *([F.min(next_of).alias("_first")] if next_of else []))
    cols = [f"coalesce(sum(_c_{s}) {window(by, ['_chunk'], earlier)}, 0) AS _o_{s}" for s in sums]
    if totals:
        cols += [f"sum(_c_{s}) {window(by)} AS total_{s}" for s in sums]
    if next_of:
        cols.append(f"lead(_first) {window(by, ['_chunk'])} AS _follow")
    heads = heads.selectExpr(*by, "_chunk", *cols)
    inside = [*by, "_chunk"]
    out = [*text.names(df.columns),
           *[f"coalesce(sum({s}) {window(inside, order, earlier)}, 0) + _o_{s} AS before_{s}"
             for s in sums]]
    if totals:
        out += [f"total_{s}" for s in sums]
    if next_of:
        out.append(f"coalesce(lead({next_of}) {window(inside, order)}, _follow) "
                   f"AS next_{next_of}")
    return cut.join(heads, [c.strip("`") for c in inside]).selectExpr(*out)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Row count and approximate number of distinct values per column, in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(c).alias(f"d{i}")
                                                 for i, c in enumerate(columns)]).first()
    return row["n"], {c: row[f"d{i}"] for i, c in enumerate(columns)}


def chunk_bounds(df: DataFrame, counts: Mapping[str, int], rows_per_chunk: int = 500_000
                 ) -> dict[str, list[float]]:
    """Value boundaries per column that keep chunks of distinct values near a target size.

    ``counts`` are approximate distinct counts; columns with few distinct values get no
    boundaries. Boundaries are quantiles of the distinct values, so a value that most rows have
    does not draw them all to itself. They steer only the parallelism, never the result.
    """
    out = {}
    for c, n in counts.items():
        wanted = n // rows_per_chunk
        if wanted > 0:
            shares = [j / (wanted + 1) for j in range(1, wanted + 1)]
            values = df.select(F.col(text.name(c)).cast("double").alias("v")).distinct()
            found = values.agg(F.percentile_approx("v", shares, max(20_000, 20 * wanted))).first()[0]
            out[c] = sorted(set(found or []))
    return out


def chunk_of(value: str, bounds: Sequence[float]) -> str:
    """Number of boundaries <= value, as SQL text (a binary search); 0 for null."""
    def search(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        edge = text.literal(float(bounds[mid]))
        return f"CASE WHEN {value} < {edge} THEN {search(lo, mid)} ELSE {search(mid + 1, hi)} END"

    return f"CASE WHEN {value} IS NULL THEN 0 ELSE {search(0, len(bounds))} END"
