"""Readers and writers of model tables: schemas, defaults, derived columns, keys and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.operators.ordered import numbered
from ledgertide.sources.schemas import DEFAULTS, model_schema

# -- reading ----------------------------------------------------------------------------


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    for name, value in DEFAULTS.get(table, {}).items():
        if name in df.columns:
            df = df.withColumn(name, F.coalesce(name, F.lit(value).cast(df.schema[name].dataType)))
    return df


def net_amount() -> Column:
    zero = F.lit(0).cast("decimal(10,2)")
    return (
        F.col("total_amount") - F.coalesce("discount_amount", zero) + F.coalesce("tax_amount", zero)
    ).cast("decimal(12,2)")


def line_total() -> Column:
    """quantity * unit price * (1 - percent / 100), kept to cents."""
    gross = F.col("quantity").cast("decimal(10,0)") * F.col("unit_price")
    rest = (F.lit(100).cast("decimal(5,2)") - F.col("discount_percent")) * F.lit("0.01").cast("decimal(3,2)")
    return F.round(gross * rest, 2).cast("decimal(12,2)")


def with_generated(df: DataFrame, table: str) -> DataFrame:
    if table == "orders":
        return df.withColumn("net_amount", net_amount())
    if table == "order_items":
        return df.withColumn("line_total", line_total())
    return df


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A model table from parquet: fixed schema, defaults filled, derived columns added."""
    stored = spark.read.schema(model_schema(table)).parquet(path)
    return with_generated(with_defaults(stored, table), table)


def add_missing_columns(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Add each column (name to type and default) that is not there yet."""
    for name, (kind, default) in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(kind))
    return df


# Return history kept on customers.
RETURN_HISTORY = {
    "store_credit": ("decimal(10,2)", 0),
    "total_returns": ("bigint", 0),
    "last_return_date": ("timestamp_ntz", None),
    "total_refund_amount": ("decimal(12,2)", 0),
}


def zip_arrays(df: DataFrame, first: str, second: str, keep: list[str], names: list[str]) -> DataFrame:
    """Two parallel arrays as rows with their position; an empty pair keeps one empty row."""
    zipped = F.arrays_zip(F.col(first).alias("a"), F.col(second).alias("b"))
    rows = df.select(*keep, F.posexplode_outer(zipped).alias("position", "pair"))
    return rows.select(*keep, "position", F.col("pair.a").alias(names[0]), F.col("pair.b").alias(names[1]))


def one_row(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 'X' AS dummy")


# -- keys and updates -------------------------------------------------------------------


def with_surrogate_key(df: DataFrame, order: list, name: str, existing: DataFrame | None = None, first: int = 1):
    """Consecutive keys in a given order, after the largest key of `existing`."""
    start = first
    if existing is not None:
        start = (existing.agg(F.max(name)).first()[0] or first - 1) + 1
    placed = numbered(df, [], order, "_place")
    return placed.withColumn(name, F.col("_place") + (start - 1)).drop("_place")


def with_hash_key(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """A stable key where order does not matter: no shuffle at all."""
    return df.withColumn(name, F.xxhash64(*columns))


def apply_changes(
    table: DataFrame, key: str, changes: DataFrame, add: dict[str, str] | None = None,
    replace: dict[str, str] | None = None,
) -> DataFrame:
    """A new version of a table: per key, add numbers to columns or replace values.

    `changes` holds one row per key (aggregate deltas first); `add` and `replace` map a table
    column to the column of `changes`.
    """
    add, replace = add or {}, replace or {}
    marks = changes.select(
        F.col(key).alias("_key"),
        *[F.col(src).alias(f"_add_{c}") for c, src in add.items()],
        *[F.col(src).alias(f"_new_{c}") for c, src in replace.items()],
    )
    joined = table.join(marks, F.col(key) == F.col("_key"), "left")
    kinds = {f.name: f.dataType for f in table.schema}
    columns = []
    for c in table.columns:
        if c in add:
            columns.append((F.coalesce(c, F.lit(0)) + F.coalesce(f"_add_{c}", F.lit(0))).cast(kinds[c]).alias(c))
        elif c in replace:
            columns.append(F.coalesce(f"_new_{c}", c).cast(kinds[c]).alias(c))
        else:
            columns.append(F.col(c))
    return joined.select(*columns)


# -- writing ----------------------------------------------------------------------------


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def current_version(spark: SparkSession, folder: str) -> int | None:
    """The newest complete version; a version without its success mark does not exist."""
    system, path = _files(spark, folder)
    if not system.exists(path):
        return None
    done = []
    for entry in system.listStatus(path):
        name = entry.getPath().getName()
        if name.startswith("v") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
            done.append(int(name[1:]))
    return max(done) if done else None


def publish_version(df: DataFrame, folder: str) -> str:
    """Write the next version beside the one being read; readers move on when it is complete."""
    spark = df.sparkSession
    number = (current_version(spark, folder) or 0) + 1
    target = f"{folder}/v{number:08d}"
    df.write.mode("overwrite").parquet(target)
    return target


def read_version(spark: SparkSession, folder: str, table: str | None = None) -> DataFrame:
    number = current_version(spark, folder)
    if number is None:
        raise FileNotFoundError(folder)
    target = f"{folder}/v{number:08d}"
    return read_table(spark, target, table) if table else spark.read.parquet(target)


def publish_batch(outputs: dict[str, DataFrame], folder: str, batch_id: str) -> dict[str, str]:
    """Write every output of a job under one batch id; running the batch again replaces it.

    The list of outputs is written last, so `read_batches` sees a batch whole or not at all.
    """
    paths = {name: f"{folder}/{name}/batch_id={batch_id}" for name in outputs}
    for name, df in outputs.items():
        df.write.mode("overwrite").parquet(paths[name])
    spark = next(iter(outputs.values())).sparkSession
    listed = spark.createDataFrame(list(paths.items()), "name string, path string")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/_complete/batch_id={batch_id}")
    return paths


def read_batches(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One output over all complete batches."""
    listed = spark.read.parquet(f"{folder}/_complete").filter(F.col("name") == name)
    return spark.read.option("basePath", f"{folder}/{name}").parquet(*[r.path for r in listed.collect()])


def publish_if_clean(staged: DataFrame, checks: DataFrame, folder: str) -> str | None:
    """Publish a staged load only when no check reports a violation."""
    if not checks.filter(F.col("violations") > 0).isEmpty():
        return None
    return publish_version(staged, folder)


def write_archive(df: DataFrame, ts: str, folder: str) -> None:
    """Archive by month, so that later reads prune to the months asked for; other months stay as they are."""
    monthly = df.withColumn("archive_month", F.date_format(ts, "yyyy-MM"))
    monthly.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("archive_month").parquet(folder)
