"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import apply_runtime_conf, written

#: Rows of an Arrow batch, so that a batch of long texts stays small beside a worker's memory.
BATCH_ROWS = 500

#: Most bytes of a bitmap that is sent to all tasks.
BITMAP_BYTES = 64_000_000

#: A word: no space, tab, line feed, vertical tab, form feed or carriage return.
WHITE_RUN = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on."""
    apply_runtime_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def give_back() -> None:
    """Return freed memory to the system, so that a worker that waits stays small beside the next stage's work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def word_count(text: Column) -> Column:
    """Number of words, in the JVM. Null: 0."""
    words = F.split(F.coalesce(text, F.lit("")), WHITE_RUN)
    edges = (F.element_at(words, 1) == "").cast("int") + (
        (F.size(words) > 1) & (F.element_at(words, -1) == "")
    ).cast("int")
    return (F.size(words) - edges).cast("long")


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from. A null id is never held out and never labelled."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _bitmaps(keys: DataFrame, place: Column) -> DataFrame | None:
    """marked_block, marked_bits: the places in blocks of 32,768; None if all blocks exceed ``BITMAP_BYTES``."""
    placed = keys.select(F.shiftright(place, 15).alias("marked_block"), place.bitwiseAND(32767).alias("bit"))
    found = written(placed.repartition("marked_block").groupBy("marked_block").agg(F.bitmap_construct_agg("bit").alias("marked_bits")))
    return found if found.count() * 4096 <= BITMAP_BYTES else None


def _marked(rows: DataFrame, place: Column, bitmaps: DataFrame) -> DataFrame:
    """Rows whose place is marked. No row is moved."""
    bit = place.bitwiseAND(32767)
    byte = F.substring("marked_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))
    marked = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), bit.bitwiseAND(7).cast("int")) == 1
    return rows.join(F.broadcast(bitmaps), F.shiftright(place, 15) == F.col("marked_block")).where(marked).select(*rows.columns)


def only(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose number in ``column`` is among ``keys`` (one column of numbers of ``monotonically_increasing_id``).

    Such numbers run without gaps in a partition, so a bit each is sent to all tasks and the rows stay where
    they lie. Beyond ``BITMAP_BYTES`` of bits it is a join by shuffle.
    """
    bitmaps = _bitmaps(keys, F.col(keys.columns[0]))
    if bitmaps is None:
        return rows.join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_semi")
    return _marked(rows, F.col(column), bitmaps)


def likely(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """All rows whose ``column`` is among ``keys``, and at most a sixteenth of the others; all, beyond ``BITMAP_BYTES``.

    A filter to run before a join by shuffle: 16 bits a key are sent to all tasks.
    """
    bits = 1 << max(15, (16 * keys.count() - 1).bit_length())
    if bits // 8 > BITMAP_BYTES:
        return rows
    bitmaps = _bitmaps(keys, F.pmod(F.xxhash64(keys.columns[0]), F.lit(bits)))
    return rows if bitmaps is None else _marked(rows, F.pmod(F.xxhash64(column), F.lit(bits)), bitmaps)
