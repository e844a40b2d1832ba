"""What the operators share: words, let-bindings, durable cuts of lineage, names that clash with none."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.plans.session import cut as durable
from terraloom.plans.session import shared_dir, tidy

__all__ = ["BROADCAST_BYTES", "SPACE", "UNIT_SQL", "Scratch", "bounded_broadcast", "bounded_sample", "dealt_anew", "durable", "lean", "let", "packed_rows", "partitions", "shared_dir", "table", "unit_hash", "unpacked", "words"]

#: A word is a run of anything but these characters.
SPACE = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast only if its rows were counted and its bytes summed, and are within this.
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit_hash(*parts: Column | str) -> Column:
    """A number above 0 and below 1 from a hash (the first 52 bits of an MD5, which SQL engines have too) of texts joined by |. A null counts as a zero byte."""
    texts = [F.coalesce((F.lit(x) if isinstance(x, str) else x).cast("string"), F.lit("\x00")) for x in parts]
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


#: SQL of unit_hash() of a text.
UNIT_SQL = "(('0x' || substr(md5({}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"


def packed_rows(df: DataFrame, **more: Column) -> DataFrame:
    """(row, ...): every row of df as one struct, beside columns made from it. No column of df can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that packed_rows() packed, with the columns that they had."""
    return df.select(*[F.col("row")[c].alias(c) for c in columns])


class Scratch:
    """Tables of an operator's steps, as Parquet in the shared folder; each can be dropped once it isn't read any more.

    The shuffle files of a step go when its table is written.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.at = spark, f"{shared_dir(spark)}/steps-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        with tidy(self.spark):
            df.write.parquet(f"{self.at}/{self.n}")
        kept = self.spark.read.schema(df.schema).parquet(f"{self.at}/{self.n}")
        kept._steps_path = f"{self.at}/{self.n}"
        return kept

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            self._delete(df._steps_path)

    def close(self) -> None:
        """Drops all that is left; results must have been made durable before."""
        self._delete(self.at)


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint where its counted bytes are within the limit, else as it is. df must be durable."""
    held = F.octet_length(F.to_json(F.struct("*")))
    n = df.agg(F.sum(held + 16)).collect()[0][0] or 0
    return F.broadcast(df) if n <= limit else df


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The `rows` rows of the smallest hashed key, or all if there are no more; keys must be distinct.

    Rows are first thinned by hash to about half as many again, so that what tasks send to the
    driver doesn't grow with their number.
    """
    share = min(1.0, 1.5 * rows / max(1, df.count()))
    thin = df.where(F.shiftrightunsigned(F.xxhash64(key), 33) <= int(share * (1 << 31)))
    return thin.orderBy(F.xxhash64(key), key).limit(rows)


def dealt_anew(key: str) -> Column:
    """A key for one side of a join that was grouped by it before.

    As an expression of its own it doesn't stand for the old dealing, so both sides are shuffled
    for the join, and adaptive execution can split a key that is hot in one of them.
    """
    return F.coalesce(F.col(key), F.lit(0).cast("long"))


def hand_back() -> None:
    """Gives memory that is free in this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # the C library of Linux has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which what it held goes: workers stay beside the JVM when they have ended."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        hand_back()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    """How many partitions the session deals shuffles over."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
