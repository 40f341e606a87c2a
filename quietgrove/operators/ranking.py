"""Positions under a total order, without funnelling rows through one task.

``global_rank`` numbers every row. ``position_cuts`` only finds the keys that sit at a few
given positions; folds, splits and row allotments need nothing more, so they stay map-only
over the wide rows: a handful of narrow counting passes finds the cut keys, then each row
compares its own key with them.
"""

from __future__ import annotations

import math
import sys
from decimal import Context, Decimal
from typing import Callable, Sequence, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietgrove.functions.columns import choose, interval_index
from quietgrove.functions.text import literal_array
from quietgrove.scratch import Scratch, materialize

_BUCKETS = 1024  # histogram buckets per search range and pass
_DIRECT_ROWS = 20_000  # keys that may be listed on the driver once the search is narrow
_INTEGRAL = ("tinyint", "smallint", "int", "bigint", "boolean", "date", "timestamp")
_FLOATING = ("float", "double")
_LONG_DIGITS = 18  # decimal digits that any long integer holds
_EXACT = Context(prec=80)
_TEXT_BYTES = 6  # bytes of a text in one number
_TEXT_PLACES = 40  # such numbers at most
_ROW_BITS = 33  # low bits of monotonically_increasing_id: row number inside a partition


def global_rank(df: DataFrame, order_cols: Sequence[str], name: str = "position") -> DataFrame:
    """Add the 0-based position of every row under ``order_cols`` (ties: arbitrary).

    Range exchange and local sort, written out with (partition, row) numbers; the counts per
    partition, one row each, turn those into global positions.
    """
    stored = materialize(df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", _ROW_BITS)
    counts = {r["_part"]: r["count"] for r in stored.groupBy(part.alias("_part")).count().collect()}
    starts, total = [], 0
    for p in range(max(counts, default=0) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    offset = F.get(F.expr(literal_array(starts, "bigint")), part.cast("int"))
    row_no = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return stored.withColumn(name, offset + row_no).drop("_mid")


class _Form:
    """An order column as numbers that sort alike, and the way back from these to a value."""

    def __init__(self, numbers: Sequence[Column], expr: Column, value: Callable = lambda numbers: numbers[0]):
        self.numbers, self.expr, self.value = list(numbers), expr, value


def _simple(column: Column, kind: str) -> Union[Column, None]:
    """A column that is one number itself."""
    if kind in _FLOATING:
        return column.cast("double")
    if kind == "timestamp":
        return F.unix_micros(column)
    if kind == "date":
        return F.unix_date(column).cast("bigint")
    return column.cast("bigint") if kind in _INTEGRAL else None


def _decimal_form(column: Column, kind: str) -> Union[_Form, None]:
    """Whole part and decimals, each as long integers; both carry the sign."""
    digits, scale = (int(d) for d in kind[len("decimal("):-1].split(","))
    if scale > _LONG_DIGITS or digits - scale > 2 * _LONG_DIGITS:
        return None
    rest = column % F.lit(1).cast("decimal(1,0)")
    whole = (column - rest).cast(f"decimal({min(38, digits - scale + 1)},0)")
    parts = [whole.cast("bigint")]
    if digits - scale > _LONG_DIGITS:
        unit = F.lit(10 ** _LONG_DIGITS).cast(f"decimal({_LONG_DIGITS + 1},0)")
        upper = F.call_function("div", whole, unit).cast("bigint")
        parts = [upper, (whole - upper * unit).cast("bigint")]
    if scale:
        parts.append((rest.cast(f"decimal({scale + 1},{scale})") * F.lit(10 ** scale).cast(f"decimal({scale + 1},0)")).cast("bigint"))

    def value(numbers):
        whole_value = numbers[0] if len(parts) - bool(scale) == 1 else numbers[0] * 10 ** _LONG_DIGITS + numbers[1]
        return Decimal(whole_value * 10 ** scale + (numbers[-1] if scale else 0)).scaleb(-scale, _EXACT)

    return _Form(parts, column, value)


def _text_form(column: Column, longest: int) -> Union[_Form, None]:
    """Six bytes to a number, and the length: a text sorts before those it begins."""
    places = max(1, -(-longest // _TEXT_BYTES))
    if places > _TEXT_PLACES:
        return None
    data = column.cast("binary")
    numbers = [F.conv(F.hex(F.rpad(F.substring(data, _TEXT_BYTES * i + 1, _TEXT_BYTES), _TEXT_BYTES,
                                   F.lit(bytes(1)))), 16, 10).cast("bigint") for i in range(places)]

    def value(found):
        data = b"".join(n.to_bytes(_TEXT_BYTES, "big") for n in found[:-1])[:found[-1]]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return F.lit(data).cast("string")

    return _Form([*numbers, F.octet_length(column).cast("bigint")], column, value)


def _forms(df: DataFrame, order_cols: Sequence[str]) -> Union[list[_Form], None]:
    """The order columns as numbers, or None when one has no such form."""
    types = dict(df.dtypes)
    texts = [c for c in order_cols if types[c] == "string"]
    longest = df.agg(*[F.max(F.octet_length(c)).alias(f"t{i}") for i, c in enumerate(texts)]).first() if texts else []
    out = []
    for c in order_cols:
        column, kind = F.col(c), types[c]
        if kind == "string":
            form = _text_form(column, longest[texts.index(c)] or 0)
        elif kind.startswith("decimal"):
            form = _decimal_form(column, kind)
        else:
            number = _simple(column, kind)
            form = None if number is None else _Form([number], number)
        if form is None:
            return None
        out.append(form)
    return out


_NAN = float("nan")


def _plain(v):
    """One object for every NaN, so that equal ranges compare equal."""
    return _NAN if isinstance(v, float) and v != v else v


def _sortable(key):
    """Key values in Spark's order, where NaN comes last."""
    return tuple((1, 0.0) if v is _NAN else (0, v) for v in map(_plain, key))


class _Search:
    """Looks for the key at ``rank`` among rows whose leading keys equal ``prefix`` and whose
    next key lies in [lo, hi]."""

    def __init__(self, target: int, rank: int, prefix: tuple, lo, hi, rows: int):
        self.target, self.rank, self.prefix = target, rank, prefix
        self.lo, self.hi, self.rows = _plain(lo), _plain(hi), rows

    @property
    def region(self):
        return (*self.prefix, self.lo), self.hi


class _Regions:
    """The disjoint key ranges under search, as lookup arrays over a region number.

    The number comes from a binary search over the range starts; nothing here filters rows,
    because a pushed filter would evaluate costly key expressions again and again."""

    def __init__(self, keys: Sequence[str], searches):
        self.keys = keys
        unique = {s.region: s for s in searches}
        self.items = [unique[r] for r in sorted(unique, key=lambda r: _sortable((*r[0], r[1])))]
        self.place = {s.region: i for i, s in enumerate(self.items)}
        self.rows = sum(s.rows for s in self.items)

    def _lookup(self, values) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("_i"))

    def _filler(self, d: int):
        return next(s.lo for s in self.items if len(s.prefix) == d)

    def tag(self, narrow: DataFrame) -> DataFrame:
        """Add ``_r`` (region number, null outside) and ``_b`` (bucket inside the region)."""
        starts = [(*s.prefix, s.lo) for s in self.items]
        cols = [F.col(k) for k in self.keys]
        number = interval_index(cols, starts) - 1
        inside, bucket = [], []
        for d in sorted({len(s.prefix) for s in self.items}):
            mine = self._lookup([len(s.prefix) == d for s in self.items])
            at = lambda f: self._lookup([f(s) if len(s.prefix) == d else self._filler(d)
                                         for s in self.items])
            fits = mine & (cols[d] <= at(lambda s: s.hi))
            for j in range(d):
                start = next(s.prefix[j] for s in self.items if len(s.prefix) > j)
                fits = fits & (cols[j] == self._lookup(
                    [s.prefix[j] if len(s.prefix) > j else start for s in self.items]))
            inside.append(fits)
            bucket.append((mine, self._bucket(d)))
        fits = inside[0]
        for other in inside[1:]:
            fits = fits | other
        return (narrow.withColumn("_i", number)
                .withColumn("_r", F.when((F.col("_i") >= 0) & fits, F.col("_i")))
                .withColumn("_b", F.when(F.col("_r").isNotNull(), choose(bucket))))

    def _bucket(self, d: int) -> Column:
        """Bucket of key ``d``, monotone: lo falls in bucket 0 and hi in the last one."""
        los = [s.lo if len(s.prefix) == d else self._filler(d) for s in self.items]
        spans = [s.hi - s.lo if len(s.prefix) == d else 0 for s in self.items]
        # No linear share where the range is not finite: those values are told apart by size.
        wide = [not math.isfinite(v) for v in spans]
        spans = [0 if w else v for v, w in zip(spans, wide)]
        by_size = F.when(self._lookup(wide), _size_bucket(F.col(self.keys[d]))) if any(wide) else None
        if not any(spans):
            return F.lit(0) if by_size is None else F.coalesce(by_size, F.lit(0))
        key = F.col(self.keys[d])
        if isinstance(max(spans), int) and max(spans) >= 1 << 62:
            key = key.cast("decimal(20,0)")  # the difference could overflow a long
        share = (key - self._lookup(los)).cast("double") / self._lookup(
            [float(v) if v else None for v in spans])
        top = _BUCKETS - 1
        scaled = F.least(F.floor(share * F.lit(float(top))), F.lit(top)).cast("int")
        return F.coalesce(scaled, F.lit(0)) if by_size is None else F.coalesce(
            by_size, scaled, F.lit(0))


def _size_bucket(key: Column) -> Column:
    """Monotone bucket of any double: minus infinity first, then by sign and magnitude, then
    infinity and NaN each in a bucket of its own."""
    middle = (_BUCKETS - 2) // 2
    size = F.log1p(F.abs(key)) / F.lit(math.log(sys.float_info.max) + 1)
    place = F.floor(F.lit(float(middle)) * (F.lit(1.0) + F.signum(key) * size)).cast("int") + 1
    return (F.when(F.isnan(key), _BUCKETS + 1).when(key == F.lit(float("inf")), _BUCKETS)
            .when(key == F.lit(float("-inf")), 0).otherwise(place))


def position_cuts(df: DataFrame, order_cols: Sequence[str],
                  positions: Union[Sequence[int], Callable[[int], Sequence[int]]],
                  )  -> tuple[int, list[tuple]]:
    """Return (row count, key tuple at each 0-based position).

    ``positions`` may be a function of the row count. Keys must not be null. The search
    narrows all positions together: each pass counts rows per bucket (partial aggregation on
    the map side, at most buckets x positions result rows), so hot keys cost nothing extra.
    A range that has shrunk to one value moves on to the next order column. Texts are searched
    byte by byte, six at a time, and decimals as their whole part and their decimals, with the same
    passes.
    """
    forms = _forms(df, order_cols)
    if forms is None:
        return _cuts_by_rank(df, order_cols, positions)
    cols = [n for form in forms for n in form.numbers]
    keys = [f"_k{i}" for i in range(len(cols))]
    narrow = df.select(*[c.alias(k) for c, k in zip(cols, keys)])
    edge = narrow.agg(F.count(F.lit(1)).alias("n"), F.count(keys[0]).alias("valid"),
                      F.min(keys[0]).alias("lo"), F.max(keys[0]).alias("hi")).first()
    n = edge["n"]
    if edge["valid"] != n:
        raise ValueError(f"order column {order_cols[0]} holds nulls")
    wanted = list(positions(n) if callable(positions) else positions)
    if any(p < 0 or p >= n for p in wanted):
        raise ValueError(f"positions must lie in [0, {n})")
    found: dict[int, tuple] = {}
    active = [_Search(i, p, (), edge["lo"], edge["hi"], n) for i, p in enumerate(wanted)]
    while active:
        regions = _Regions(keys, active)
        if regions.rows <= _DIRECT_ROWS:
            _finish(narrow, active, regions, found)
            break
        active = _narrow_down(narrow, active, regions, found)
    ends = [0]
    for form in forms:
        ends.append(ends[-1] + len(form.numbers))
    return n, [tuple(form.value(found[i][a:b]) for form, a, b in zip(forms, ends, ends[1:]))
               for i in range(len(wanted))]


def _finish(narrow, active, regions, found) -> None:
    """List the few remaining keys and pick by rank."""
    item = F.when(F.col("_r").isNotNull(), F.struct("_r", *regions.keys))
    listed = regions.tag(narrow).agg(F.collect_list(item).alias("rows")).first()["rows"]
    groups: dict[int, list] = {}
    for row in listed:
        groups.setdefault(row["_r"], []).append(tuple(_plain(row[k]) for k in regions.keys))
    for g in groups.values():
        g.sort(key=_sortable)
    for s in active:
        found[s.target] = groups[regions.place[s.region]][s.rank]


def _narrow_down(narrow, active, regions, found) -> list:
    """Count rows per (region, bucket) and keep, for each search, the bucket of its rank."""
    keys = regions.keys
    last = len(keys) - 1
    depths = {len(s.prefix) for s in active}
    depths |= {min(d + 1, last) for d in depths}
    aggs = [F.count(F.lit(1)).alias("n")]
    for d in sorted(depths):
        aggs += [F.min(keys[d]).alias(f"lo{d}"), F.max(keys[d]).alias(f"hi{d}")]
    table: dict[int, list] = {}
    for row in regions.tag(narrow).groupBy("_r", "_b").agg(*aggs).collect():
        if row["_r"] is not None:
            table.setdefault(row["_r"], []).append(row)
    left = []
    for s in active:
        rank, depth = s.rank, len(s.prefix)
        for row in sorted(table[regions.place[s.region]], key=lambda r: r["_b"]):
            if rank < row["n"]:
                break
            rank -= row["n"]
        lo, hi = _plain(row[f"lo{depth}"]), _plain(row[f"hi{depth}"])
        if lo is not hi and lo != hi:
            left.append(_Search(s.target, rank, s.prefix, lo, hi, row["n"]))
        elif depth == last:
            found[s.target] = (*s.prefix, lo)
        else:
            left.append(_Search(s.target, rank, (*s.prefix, lo), row[f"lo{depth + 1}"],
                                row[f"hi{depth + 1}"], row["n"]))
    return left


def order_exprs(df: DataFrame, order_cols: Sequence[str]) -> list[Column]:
    """Columns to compare with the result of ``position_cuts``."""
    types = dict(df.dtypes)
    simple = [_simple(F.col(c), types[c]) for c in order_cols]
    return [F.col(c) if s is None else s for c, s in zip(order_cols, simple)]


def _cuts_by_rank(df, order_cols, positions):
    """Order columns without a form as a few numbers (texts of more than 240 bytes, other types): rank
    the narrow keys and pick the positions."""
    keys = [f"_k{i}" for i in range(len(order_cols))]
    narrow = df.select(*[e.alias(k) for k, e in zip(keys, order_exprs(df, order_cols))])
    with Scratch(df.sparkSession) as scratch:
        ranked = scratch.save(global_rank(narrow, keys, "_pos"))
        n = ranked.count()
        wanted = list(positions(n) if callable(positions) else positions)
        rows = ranked.where(F.col("_pos").isin(wanted)).collect() if wanted else []
    at = {r["_pos"]: tuple(r[k] for k in keys) for r in rows}
    return n, [at[p] for p in wanted]
