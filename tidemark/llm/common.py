"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument

#: What separates words: space and the ASCII control characters from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: Stands for a null doc_id where ids are keys.
NO_ID = -(1 << 63)

#: str.translate table that makes every separator a space.
TO_SPACE = {i: " " for i in range(9, 14)}


def words_of(text: str | None) -> list[str]:
    """Words of a text, as runs of characters other than space and \\t to \\r. None has none."""
    if not text:
        return []
    return [w for w in text.translate(TO_SPACE).split(" ") if w]


def known_id(doc_id: F.Column) -> F.Column:
    """doc_id, or NO_ID for null: pandas would make floats of a column of longs with nulls in it."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def word_array(text) -> F.Column:
    """The same as a column of arrays. A null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder for data between jobs: the session's spark.checkpoint.dir. Where that is unset, a local session gets a temporary one, and any other is refused."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise InvalidArgument("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder as a checkpoint, so that a lost executor costs no recomputation. Spark removes it when unused."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again. The files stay until the folder goes."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)
