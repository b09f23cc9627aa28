"""What the operators of this subpackage share: column access, written tables, text as words."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlake.staging import new_path, stage_at

#: Fixed value: everything but ASCII white space belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its literal name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(named(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that helper columns cannot clash with them."""
    return F.struct(*[named(c) for c in df.columns])


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written under the shared folder and read back; cuts lineage and outlives executors."""
    path = new_path(df.sparkSession, f"llm-{label}")
    table = stage_at(df, path)
    table._written_to = path
    return table


def sweep(spark: SparkSession) -> None:
    """Free the disk of finished steps now.

    Spark removes shuffle files when the driver's garbage collection finds that
    nothing refers to them, which may be long after a step was written.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Remove written tables; what was made from them must have been written, too."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
