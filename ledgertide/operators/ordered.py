"""Ordered windows that stay balanced when one group holds most of the rows.

A window over ``PARTITION BY key ORDER BY ts`` sorts each key inside one task. That is the best
plan for keys of ordinary size, and it is the plan used here for such keys. Keys with more than
``group_rows`` rows, and windows over a whole table of any size, take another way:

* the rows of those keys alone are range-partitioned on (key, order) and written once to the
  shared folder, so a place in the order becomes a count inside a part plus the counts before it;
* places in a whole table need no window at all: rows are written sorted, each with its number
  inside its range, and one count per range does the rest; a rank is the first place of a value;
* functions that look at neighbours then run over blocks of consecutive places, each block
  carrying copies of the few rows it needs from the next or previous block.

Both ways give the same rows; the tests force the second one and compare. A query that uses
several operators on one key looks for its frequent keys once, with `hot_groups`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgertide.functions.compat import micros
from ledgertide.session import cut_lineage, settle

#: Rows of a key that one task sorts, and consecutive places in a block.
GROUP_ROWS = 20_000_000
BLOCK_ROWS = 1_000_000
#: Buckets of keys that are counted before any key is, and crowded ones that are looked up by a list.
BUCKETS = 1 << 16
LISTED = 1000


def sort_columns(order: list) -> list[Column]:
    """Names in ascending order (NULL last); a leading minus means descending (NULL first)."""
    out = []
    for item in order:
        if isinstance(item, Column):
            out.append(item)
        elif item.startswith("-"):
            out.append(F.col(item[1:]).desc_nulls_first())
        else:
            out.append(F.col(item).asc_nulls_last())
    return out


def large_groups(
    df: DataFrame, keys: list[str], group_rows: int | None = None, bounded_by: DataFrame | None = None,
    counted: DataFrame | None = None,
) -> DataFrame | None:
    """The keys with more rows than one task should sort, or None when there are none.

    At most rows / group_rows keys can qualify, so the result is small beside the input.
    `bounded_by` names a table whose groups are at least as large as those of `df`; being
    nearer to the source, it is cheaper to count. `counted` holds the keys and their `_rows` where that is known; else
    buckets of keys are counted first, of which there are far fewer, and keys only where their bucket is large enough.
    """
    large = F.col("_rows") > (group_rows or GROUP_ROWS)
    if counted is None:
        source = bounded_by if bounded_by is not None and set(keys) <= set(bounded_by.columns) else df
        rows, bucket = F.count(F.lit(1)).alias("_rows"), F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
        crowded = source.groupBy(bucket.alias("_bucket")).agg(rows).filter(large).limit(LISTED + 1).collect()
        if not crowded:
            return None
        if len(crowded) <= LISTED:
            source = source.filter(bucket.isin([r[0] for r in crowded]))
        counted = source.groupBy(*keys).agg(rows)
    counted = counted.filter(large)
    return None if counted.isEmpty() else cut_lineage(counted)


def _matching(df: DataFrame, hot: DataFrame, keys: list[str], how: str) -> DataFrame:
    if not keys:
        return df if how == "left_semi" else df.limit(0)
    marks = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    return df.join(marks, same, how)


def divide(
    df: DataFrame, keys: list[str], hot: DataFrame | None
) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of ordinary keys and rows of the keys in `hot`; None for a side without rows."""
    if hot is None:
        return df, None
    return None if not keys else _matching(df, hot, keys, "left_anti"), _matching(df, hot, keys, "left_semi")


@dataclass(frozen=True)
class Hot:
    """The frequent keys of a table (None: there are none) and the ranges to cut their rows into."""

    keys: list[str]
    found: DataFrame | None
    parts: int

    @property
    def plain(self) -> bool:
        """Whether one window per key will do."""
        return bool(self.keys) and self.found is None

    def divide(self, df: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        return divide(df, self.keys, self.found) if self.keys else (None, df)


def hot_groups(
    df: DataFrame, keys: list[str], group_rows: int | None = None, bounded_by: DataFrame | None = None,
    counted: DataFrame | None = None,
) -> Hot:
    """What the operators below need to know of the keys; a whole table needs no counting."""
    if not keys:
        return Hot(keys, None, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = large_groups(df, keys, group_rows, bounded_by, counted)
    rows = found.agg(F.sum("_rows")).first()[0] if found is not None else 0
    return Hot(keys, found, ceil(rows / (group_rows or GROUP_ROWS)) + 1)


def _union(cold: DataFrame | None, hot: DataFrame) -> DataFrame:
    return hot if cold is None else cold.unionByName(hot.select(*cold.columns))


def _summed(df: DataFrame, totals: dict[str, Column], spec: WindowSpec) -> DataFrame:
    span = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[F.sum(value).over(span).alias(name) for name, value in totals.items()])


def _ranged_totals(df: DataFrame, keys: list[str], order: list, totals: dict[str, Column], parts: int) -> DataFrame:
    """Running sums by ranges: those inside a part plus the sums of the parts before it."""
    sort = sort_columns(order)
    ranged = cut_lineage(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *sort).withColumn("_part", F.spark_partition_id())
    )
    local = _summed(ranged, totals, Window.partitionBy(*keys, "_part").orderBy(*sort))
    sums = ranged.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_in_{n}") for n, v in totals.items()])
    # One row per key and part, so at most keys + parts rows are ordered here.
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_k_part"),
        *[F.coalesce(F.sum(f"_in_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in totals],
    )
    same = [F.col("_part") == F.col("_k_part")] + [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = local.join(offsets, same, "inner")
    kinds = {f.name: f.dataType for f in local.schema}
    return joined.select(
        *df.columns, *[(F.col(n) + F.col(f"_before_{n}")).cast(kinds[n]).alias(n) for n in totals]
    )


#: How `monotonically_increasing_id` puts a part and a number inside it into one.
PART_SHIFT = 33


def _ranges(df: DataFrame, order: list) -> DataFrame:
    """Rows sorted by ranges, numbered inside their range."""
    sort = sort_columns(order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
    return ranged.withColumn("_mark", F.monotonically_increasing_id())


def _counted(rows: DataFrame, marks: dict[str, str]) -> tuple[DataFrame, list[int]]:
    """Stored rows with, for each mark, the place it stands for under the name given; and the number of places of each."""
    part = F.shiftright(next(iter(marks)), PART_SHIFT)
    inside = {mark: F.col(mark).bitwiseAND(F.lit((1 << PART_SHIFT) - 1)) for mark in marks}
    counts = rows.groupBy(part.alias("part")).agg(*[(F.max(c) + 1).alias(mark) for mark, c in inside.items()]).collect()  # a row per part
    before, starts = [0] * len(marks), []
    for r in sorted(counts):
        starts.append((r[0], *before))
        before = [b + n for b, n in zip(before, r[1:], strict=True)]
    fields = ["_part", *[f"_before{mark}" for mark in marks]]
    # As constants, whose size is known, so that the rows stay where they are.
    lines = ", ".join(f"({', '.join(f'{n}L' for n in start)})" for start in starts or [(0,) * len(fields)])
    offsets = rows.sparkSession.sql(f"SELECT * FROM VALUES {lines} AS t({', '.join(fields)})")
    places = [(F.col(f"_before{mark}") + c + 1).cast("bigint").alias(marks[mark]) for mark, c in inside.items()]
    kept = [c for c in rows.columns if c not in marks]
    return rows.withColumn("_part", part).join(offsets, "_part").select(*kept, *places), before


def _in_order(df: DataFrame, order: list, name: str) -> tuple[DataFrame, int]:
    """`placed`, and the number of rows."""
    rows, totals = _counted(settle(_ranges(df, order), "placed"), {"_mark": name})
    return rows, totals[0]


def placed_parts(df: DataFrame, order: list, parts: str, name: str, number: str) -> DataFrame:
    """A row per element of the array column `parts`: the fields of the element, the place of its row, its own number.

    `placed` and, in the same sorted write, the ROW_NUMBER of the elements over the whole table. No array may be empty:
    such a row would take no place.
    """
    rows = _ranges(df, order).select("_mark", F.explode(parts).alias("_element")).select("_mark", "_element.*")
    rows = settle(rows.withColumn("_number", F.monotonically_increasing_id()), "placed")
    return _counted(rows, {"_mark": name, "_number": number})[0]


def placed(df: DataFrame, order: list, name: str) -> DataFrame:
    """ROW_NUMBER over the whole table as a bigint. The order must be total (end it with a unique column)."""
    return _in_order(df, order, name)[0]


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list,
    totals: dict[str, Column],
    group_rows: int | None = None,
    bounded_by: DataFrame | None = None,
    hot: Hot | None = None,
) -> DataFrame:
    """Inclusive running sums per key. The order must be total (end it with a unique column)."""
    hot = hot or hot_groups(df, keys, group_rows, bounded_by)
    cold, frequent = hot.divide(df)
    if cold is not None:
        cold = _summed(cold, totals, Window.partitionBy(*keys).orderBy(*sort_columns(order)))
    if frequent is None:
        return cold
    return _union(cold, _ranged_totals(frequent, keys, order, totals, hot.parts))


def numbered(
    df: DataFrame,
    keys: list[str],
    order: list,
    name: str,
    group_rows: int | None = None,
    bounded_by: DataFrame | None = None,
    hot: Hot | None = None,
) -> DataFrame:
    """ROW_NUMBER per key as a bigint."""
    if not keys:
        return placed(df, order, name)
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")}, group_rows, bounded_by, hot)


def ranked(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    rank: str | None = None,
    dense: str | None = None,
    group_rows: int | None = None,
    bounded_by: DataFrame | None = None,
    hot: Hot | None = None,
    place: str | None = None,
) -> DataFrame:
    """RANK and DENSE_RANK per key. Beyond the plain way, ties are counted once per value.

    For a whole table `place` may name the column that `placed` has made under an order that begins with this one.
    """
    hot = hot or hot_groups(df, keys, group_rows, bounded_by)
    wanted = [n for n in (rank, dense) if n]
    if hot.plain:
        spec = Window.partitionBy(*keys).orderBy(*sort_columns(order))
        if rank:
            df = df.withColumn(rank, F.rank().over(spec).cast("bigint"))
        if dense:
            df = df.withColumn(dense, F.dense_rank().over(spec).cast("bigint"))
        return df
    columns, kept = [c.lstrip("-") for c in order], df.columns
    if keys:
        values = df.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("_ties"))
        values = running_totals(
            values, keys, order, {"_upto": F.col("_ties"), "_dense": F.lit(1).cast("bigint")}, hot=hot
        ).withColumn("_first", F.col("_upto") - F.col("_ties") + 1)
    else:
        if not place:  # equal values lie in any order, so that many of them fill several ranges
            place = "_at"
            df = placed(df, [*order, F.xxhash64(*df.columns)], place)
        values = df.groupBy(*columns).agg(F.min(place).alias("_first"))
        if dense:
            values = placed(values, ["_first"], "_dense")
    given = {rank: "_first", dense: "_dense"}
    table = values.select(
        *[F.col(c).alias(f"_v_{c}") for c in keys + columns], *[F.col(given[n]).cast("bigint").alias(n) for n in wanted]
    )
    same = [F.col(c).eqNullSafe(F.col(f"_v_{c}")) for c in keys + columns]
    return df.join(table, same, "inner").select(*kept, *wanted)


def tiled(
    df: DataFrame,
    keys: list[str],
    order: list,
    tiles: int,
    name: str,
    group_rows: int | None = None,
    bounded_by: DataFrame | None = None,
    hot: Hot | None = None,
) -> DataFrame:
    """NTILE: the first groups take one row more when the rows do not divide evenly."""
    hot = hot or hot_groups(df, keys, group_rows, bounded_by)
    if hot.plain:
        spec = Window.partitionBy(*keys).orderBy(*sort_columns(order))
        return df.withColumn(name, F.ntile(tiles).over(spec).cast("bigint"))
    if keys:
        rows = numbered(df, keys, order, "_place", hot=hot)
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        sizes = sizes.select(*[F.col(k).alias(f"_s_{k}") for k in keys], "_rows")
        rows = rows.join(sizes, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys], "inner")
    else:
        rows, total = _in_order(df, order, "_place")
        rows = rows.withColumn("_rows", F.lit(total).cast("bigint"))
    small, extra = F.expr(f"_rows div {tiles}"), F.expr(f"_rows % {tiles}")
    wide = extra * (small + 1)
    tile = F.when(F.col("_place") <= wide, F.ceil(F.col("_place") / (small + 1))).otherwise(
        extra + F.ceil((F.col("_place") - wide) / F.greatest(small, F.lit(1)))
    )
    return rows.withColumn(name, tile.cast("bigint")).select(*df.columns, name)


def framed(
    df: DataFrame,
    keys: list[str],
    order: list,
    build: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    group_rows: int | None = None,
    bounded_by: DataFrame | None = None,
    hot: Hot | None = None,
    place: str | None = None,
) -> DataFrame:
    """Window columns that look at most `before` rows back and `after` rows ahead.

    `build` gets a spec (partition and order) and returns the columns, for example
    ``{"previous": F.lag("x").over(spec)}``. For a whole table `place` may name the column that `placed` has made.
    """
    hot = hot or hot_groups(df, keys, group_rows, bounded_by)
    cold, frequent = hot.divide(df)
    made = []
    if cold is not None:
        columns = build(Window.partitionBy(*keys).orderBy(*sort_columns(order)))
        made = list(columns)
        cold = cold.select("*", *[c.alias(n) for n, c in columns.items()])
    if frequent is None:
        return cold
    size = max(group_rows or BLOCK_ROWS, before + after + 1)
    if keys:
        rows = _ranged_totals(frequent, keys, order, {"_place": F.lit(1).cast("bigint")}, hot.parts)
    else:
        rows = frequent.withColumn("_place", F.col(place)) if place else placed(frequent, order, "_place")
    block, within = F.expr(f"(_place - 1) div {size}"), F.expr(f"(_place - 1) % {size}")
    own = F.struct(block.alias("block"), F.lit(True).alias("own"))
    copies = [own]
    if before:
        copies.append(F.when(within >= size - before, F.struct((block + 1).alias("block"), F.lit(False).alias("own"))))
    if after:
        copies.append(
            F.when((within < after) & (block > 0), F.struct((block - 1).alias("block"), F.lit(False).alias("own")))
        )
    spread = rows.withColumn("_copy", F.explode(F.array_compact(F.array(*copies)))).withColumn(
        "_block", F.col("_copy.block")
    )
    columns = build(Window.partitionBy(*keys, "_block").orderBy("_place"))
    made = list(columns)
    done = spread.select("*", *[c.alias(n) for n, c in columns.items()]).filter("_copy.own")
    return _union(cold, done.select(*df.columns, *made))


def trailing_count(
    df: DataFrame,
    keys: list[str],
    ts: str,
    span_micros: int,
    name: str,
    group_rows: int | None = None,
    bounded_by: DataFrame | None = None,
    hot: Hot | None = None,
) -> DataFrame:
    """COUNT(*) over the trailing time span of the same key, peers included.

    Keys with many rows are cut into time slots of the span's length; a row also goes to the
    next slot, which therefore sees everything within reach.
    """
    hot = hot or hot_groups(df, keys, group_rows, bounded_by)
    cold, frequent = hot.divide(df)
    at = micros(ts)
    reach = (-span_micros, 0)
    if cold is not None:
        spec = Window.partitionBy(*keys).orderBy(at).rangeBetween(*reach)
        cold = cold.withColumn(name, F.count(F.lit(1)).over(spec))
    if frequent is None:
        return cold
    slot = F.floor(at / F.lit(span_micros))
    spread = frequent.withColumn("_slot0", slot).withColumn(
        "_slot", F.explode(F.array(F.col("_slot0"), F.col("_slot0") + 1))
    )
    spec = Window.partitionBy(*keys, "_slot").orderBy(at).rangeBetween(*reach)
    done = spread.withColumn(name, F.count(F.lit(1)).over(spec)).filter(F.col("_slot") == F.col("_slot0"))
    return _union(cold, done.select(*df.columns, name))
