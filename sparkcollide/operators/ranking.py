"""Ranks and running sums that never gather a whole group into one task."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcollide.session import join_null_safe


def leading_n(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """First ``n`` rows per group.

    ``row_number() <= n`` is planned with a partial group limit before the
    shuffle, so a hot group sends at most ``n`` rows per input partition.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


#: Quantiles taken for each bucket, and their accuracy: shares of a bucket.
FINE = 10
ACCURACY = 40
_LARGEST = 1.7976931348623157e308


def sort_code(df: DataFrame, column: Column) -> Column:
    """A double that never falls where ``column`` rises; nulls come first, NaN last.

    Different values may share a code: numbers beyond 2**53, strings that agree
    in six bytes, and all values of types without a number.
    """
    kind = df.select(column.alias("c")).schema["c"].dataType
    if isinstance(kind, T.StringType):
        lead = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 6)), 12, "0")
        code = F.conv(lead, 16, 10).cast("double")
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        code = F.least(F.greatest(column.cast("double"), F.lit(-_LARGEST)), F.lit(_LARGEST))
        code = F.when(F.isnan(column.cast("double")), _LARGEST).otherwise(code)
    elif isinstance(kind, T.DateType):
        code = F.unix_date(column).cast("double")
    elif isinstance(kind, T.TimestampType):
        code = F.unix_micros(column).cast("double")
    else:
        code = F.when(column.isNotNull(), 0.0)
    return F.coalesce(code, F.lit(-_LARGEST))


def split_points(df: DataFrame, codes: list[Column], buckets: int) -> list[tuple[float, ...]]:
    """Ascending boundaries that cut the rows into about ``buckets`` equal parts by their codes.

    One aggregate, a mergeable quantile sketch over all rows, gives the
    boundaries of the first code; only ``FINE * buckets`` quantiles reach the
    driver.  Values that fill a bucket alone are refined by the next code, in a
    scan of just their rows, and those that fill one by all codes get a bucket
    of their own.
    """
    fractions = [i / (FINE * buckets) for i in range(1, FINE * buckets)]
    names = [f"_c{i}" for i in range(len(codes))]
    rows = df.select(*[c.alias(n) for c, n in zip(codes, names, strict=True)])
    sketch = lambda name: F.percentile_approx(name, fractions, ACCURACY * buckets).alias("q")
    found = rows.agg(sketch(names[0])).first()["q"] or []
    cells = {(v,): w for v, w in _counted(found, 1.0).items()}
    for depth in range(1, len(codes)):
        hot = [c for c, w in cells.items() if len(c) == depth and w >= FINE]
        if not hot:
            break
        known = df.sparkSession.createDataFrame([tuple(map(float, h)) for h in hot], ", ".join(f"{n} double" for n in names[:depth]))
        for row in rows.join(F.broadcast(known), names[:depth]).groupBy(*names[:depth]).agg(sketch(names[depth])).collect():
            value = tuple(row)[:depth]
            weight = cells.pop(value)
            cells |= {(*value, v): w for v, w in _counted(row["q"], weight / len(row["q"])).items()}
    low = lambda c: c + (-_LARGEST,) * (len(codes) - len(c))
    cells = sorted((low(c), w) for c, w in cells.items())
    alone = {c for c, w in cells if w >= FINE}
    target = sum(w for c, w in cells if c not in alone) / max(1, buckets - len(alone))
    points, filled = set(), 0.0
    for c, w in cells:
        if c in alone:
            points |= {c, (*c[:-1], math.nextafter(c[-1], math.inf))}
            filled = 0.0
            continue
        filled += w
        if filled >= target - 0.5:
            points.add(c)
            filled = 0.0
    return sorted(points)


def _counted(values: list[float], weight: float) -> dict[float, float]:
    out: dict[float, float] = {}
    for v in values:
        out[v] = out.get(v, 0.0) + weight
    return out


def _kind(n: int) -> str:
    return "array<struct<" + ",".join(f"c{i}:double" for i in range(n)) + ">>"


def _json(points: list[tuple[float, ...]]) -> str:
    return json.dumps([{f"c{i}": v for i, v in enumerate(p)} for p in points])


def bucket_of(codes: list[Column], points: list[tuple[float, ...]]) -> Column:
    """Number of boundaries at or below a row's codes: binary search in one array literal.

    Only the codes that tell boundaries apart are computed, once a row.
    """
    if not points:
        return F.lit(0)
    used = max(k + 1 for p in points for k in range(len(p)) if k == 0 or p[k] != -_LARGEST)
    if used == 1:
        bounds, key = F.from_json(F.lit(json.dumps([p[0] for p in points])), "array<double>"), codes[0]
    else:
        bounds = F.from_json(F.lit(_json([p[:used] for p in points])), _kind(used))
        key = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(codes[:used])])
    steps = F.array(*[F.lit(1 << k) for k in range(len(points).bit_length() - 1, -1, -1)])

    def step(at, size):
        to = at["i"] + size
        return F.struct(F.when(F.get(bounds, to - 1) <= at["k"], to).otherwise(at["i"]).alias("i"), at["k"].alias("k"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("i"), key.alias("k")), step, lambda at: at["i"])


def bucket_count(df: DataFrame) -> int:
    """Ranges to cut into: as many as the session shuffles into, 64 at least."""
    return max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running_sums(
    df: DataFrame,
    key: str,
    sums: dict[str, str],
    group: list[str] | None = None,
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Inclusive running totals over distinct ``key`` values, ties collapsed.

    Two levels: totals per quantile bucket are accumulated over a table whose
    size is groups x buckets, then each bucket is accumulated on its own, so
    neither a global order nor a hot group is handled by a single task.
    """
    group = group or []
    tied = df.groupBy(*group, key).agg(*[F.sum(src).alias(out) for out, src in sums.items()])
    codes = [sort_code(df, F.col(key))]
    tied = tied.withColumn("_b", bucket_of(codes, split_points(df, codes, buckets or bucket_count(df))))
    order = [F.col("_b").desc() if descending else F.col("_b").asc()]
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = tied.groupBy(*group, "_b").agg(*[F.sum(o).alias(o) for o in sums])
    offsets = per_bucket.select(
        *group, "_b", *[F.coalesce(F.sum(o).over(before), F.lit(0)).alias("_off_" + o) for o in sums]
    )
    inner = [F.col(key).desc() if descending else F.col(key).asc()]
    w = Window.partitionBy(*group, "_b").orderBy(*inner).rowsBetween(Window.unboundedPreceding, 0)
    joined = join_null_safe(tied, offsets, [*group, "_b"])
    keep = [c for c in tied.columns if c not in sums and c != "_b"]
    return joined.select(
        *keep,
        *[F.col(o).alias(o + "_here") for o in sums],
        *[(F.sum(o).over(w) + F.col("_off_" + o)).alias(o) for o in sums],
    )


WHOLE = 200_000  # rows of a group that one task may rank


def distributed_row_number(
    df: DataFrame, group: list[str], order: list[str], rank: str = "rn", buckets: int | None = None
) -> DataFrame:
    """Exact row_number per group, with the work of large groups split by order-key ranges.

    Groups of at most WHOLE rows are ranked by a plain window. ``order`` must
    identify a row within its group; prefix a name with ``-`` for descending
    numeric order. The names of large groups, at most one in WHOLE rows, go to
    every task, so that the rows of a group are not brought into one to be told.
    """
    fields = [(-F.col(c[1:]) if c.startswith("-") else F.col(c)).alias(f"o{i}") for i, c in enumerate(order)]
    plain = Window.partitionBy(*group).orderBy(*[f.asc() for f in fields])
    busy = df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > WHOLE).select(*group, F.lit(True).alias("_hot"))
    if busy.isEmpty():
        return df.withColumn(rank, F.row_number().over(plain).cast("long"))
    told = join_null_safe(df, F.broadcast(busy), group, "left")
    small = told.where("_hot is null").drop("_hot").withColumn(rank, F.row_number().over(plain).cast("long"))
    return small.unionByName(_split_row_number(told.where("_hot").drop("_hot"), group, fields, rank, buckets))


def _split_row_number(df: DataFrame, group: list[str], fields: list[Column], rank: str, buckets: int | None) -> DataFrame:
    codes = [sort_code(df, f) for f in fields]
    points = split_points(df, codes, buckets or bucket_count(df))
    keyed = df.withColumns({"_o": F.struct(*fields), "_b": bucket_of(codes, points)})
    w = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    offsets = offsets.select(*group, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*group, "_b").orderBy("_o")
    return (
        join_null_safe(keyed.withColumn("_r", F.row_number().over(inner)), offsets, [*group, "_b"])
        .withColumn(rank, F.col("_r") + F.col("_off"))
        .drop("_o", "_b", "_r", "_off")
    )


TILE = 2048  # rows of one side of one tile


def tiled(left: DataFrame, right: DataFrame, keys: list[str], tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``keys`` with tile numbers ``_i`` and ``_j`` to join on as well.

    Keys with more than ``tile`` rows on a side are cut into parts by a hash of
    their rows; a part goes to every part of the other side, so that all pairs
    still meet, each in one tile of bounded size. Rows of a side must differ.
    """
    parts = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / tile).cast("int").alias(name))
    busy = parts(left, "_n").join(parts(right, "_m"), keys).where("_n > 1 or _m > 1")

    def dealt(df, own, other, mine, theirs):
        out = df.join(busy, keys, "left").withColumn(mine, F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1))).cast("int"))
        return out.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).select(*df.columns, "_i", "_j")

    return dealt(left, "_n", "_m", "_i", "_j"), dealt(right, "_m", "_n", "_j", "_i")
