"""Work tables in the shared folder and small helpers that several operators use."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.session import shared_folder, tune

#: Rows in an Arrow batch. Texts can be long, so a batch holds few of them.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators count on."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it from there: short lineage, safe from lost executors."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def whole(column: str | Column = "text") -> Column:
    """A text column where null counts as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def place_name(df: DataFrame, name: str = "__at") -> str:
    """A name for the place of a row that no column has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def located(df: DataFrame, as_name: str) -> DataFrame:
    """Add the place of each row (file, row in the file) as a struct that tells even equal rows apart.

    A frame that does not come straight from files is written to the shared folder first.
    """

    def placed(frame: DataFrame) -> DataFrame:
        meta = frame.metadataColumn("_metadata")
        return frame.withColumn(as_name, F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row")))

    try:
        found = placed(df)
        found.schema  # noqa: B018  resolves the columns
        return found
    except AnalysisException:
        return placed(settle(df, "located"))
