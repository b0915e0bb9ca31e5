"""Helpers shared by the training-data operators: shared folders, Arrow loops, word primitives, hash folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serploom.shipping import ship

#: The white space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session has none, a temporary one is set if driver and executors are one process (tests, a local shell); on a
    cluster that is an error, since no machine-local folder can serve there.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir()
    if not isinstance(place, str):
        place = place.get() if place.isDefined() else None
    if not place:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="serploom-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(place)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    whole = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return whole if "://" in whole else whole.replace(":/", ":///", 1)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; nothing is created."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet to ``path`` and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def persisted(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there, losing executors costs nothing."""
    return written(df, scratch(df.sparkSession, name))


def forgotten(spark: SparkSession, path: str) -> None:
    """Deletes a folder below the shared one that nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def packed(df: DataFrame) -> Column:
    """A row as one column, so that no name of it can clash with names made beside it; ``row.*`` unpacks it."""
    return F.struct(*[F.col(f"`{n}`") for n in df.columns])


def fold(column: Column, parts: int) -> Column:
    """crc32 of a value's text modulo ``parts``; null stays null."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(parts)


def unit_hash(*columns: Column) -> Column:
    """A number in [0, 1) from a hash of the columns: the same for the same row at every run."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = step(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def columns_of(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    return dict(zip(batch.schema.names, batch.columns, strict=True))


def lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text with A-Z lower-cased; bytes.split() cuts at exactly the white space in SPACES."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def check_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names can't interfere."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
    return df.select(*names)
