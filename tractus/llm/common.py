"""What the operators share: reading tables, the shared folder, Arrow batches and stable hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ensure

MAX_WORDS_CACHED = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, so that a Python worker's memory follows one batch of texts; sends the package."""
    ensure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that has none gets one here; a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tractus-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Removes a query's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For tables of packed arrays: small row groups, so that writers hold little and a filter on a row's kind skips the others.
PACKED = {"parquet.block.size": 2 << 20, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4, "parquet.enable.dictionary": "false", "compression": "uncompressed"}


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and lost executors lose nothing. Shuffle
    files of the query go at once. options: those of the Parquet writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tractus-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more; whatever store the shared folder is in."""
    for df in tables:
        paths = getattr(df, "_written_to", None) or []
        for path in [paths] if isinstance(paths, str) else paths:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(conf).delete(there, True)


#: A key with more than this share of all rows is joined apart from the others; there are at most so many of these.
HOT_KEYS = 1000


def split_join(rows: DataFrame, counts: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with counts (one row for each of the keys, m: its number of rows), without m. Keys with more than
    total / HOT_KEYS rows are less than HOT_KEYS, so their part of counts is broadcast; of the others none fills a task."""
    hot = F.broadcast(counts.filter(F.col("m") * HOT_KEYS > total))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(counts.filter(F.col("m") * HOT_KEYS <= total), keys, how)
    return rows.join(hot, keys).drop("m").unionByName(rest.drop("m"))


#: Rows of one key that one task may meet, and the slots of hashed keys whose rows are counted.
KEY_ROWS, KEY_SLOTS = 500_000, 1 << 14


def salted_join(rows: DataFrame, counts: DataFrame, keys: list[str], key_rows: int = KEY_ROWS) -> DataFrame:
    """rows joined with counts (one row for each of the keys, m: its number of rows), without m. Keys are counted in a
    bounded number of slots; those of a slot with s times key_rows rows are dealt to s salts, and counts' rows repeated so
    often. What is broadcast is the slots' table, whatever the input; no task meets more than key_rows rows of one key, and
    what is repeated is in proportion to the rows."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(KEY_SLOTS))
    slots = counts.groupBy(slot.alias("_slot")).agg(F.ceil(F.sum("m") / key_rows).cast("int").alias("_salts")).filter("_salts > 1")
    if slots.isEmpty():
        return rows.join(counts.drop("m"), keys)
    dealt = lambda df: df.withColumn("_slot", slot).join(F.broadcast(slots), "_slot", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    left = dealt(rows).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.col("_salts")).cast("int"))
    right = dealt(counts.drop("m")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    return left.drop("_slot", "_salts").join(right.drop("_slot", "_salts"), [*keys, "_salt"]).drop("_salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(total_bytes: int, bucket_bytes: int) -> int:
    return max(1, -(-int(total_bytes or 0) // bucket_bytes))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def h64(data: bytes) -> int:
    return signed(xxhash.xxh3_64_intdigest(data))


_RESIDENT: dict = {}


def resident(key, make):
    """What make() gives, kept in the Python worker for later tasks. A worker keeps one such thing at a time, so operators
    that run one after the other do not add up their caches."""
    if key not in _RESIDENT:
        if _RESIDENT:
            _RESIDENT.clear()
            released()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def vacate() -> None:
    """Drops what a worker keeps for another operator; for tasks that need the room."""
    if _RESIDENT:
        _RESIDENT.clear()
        released()


def released() -> None:
    """Gives freed memory back to the system, which an allocator otherwise keeps for the worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Memo(dict):
    """A bounded cache of a pure function of a word; it is emptied when full, so results never depend on it."""

    def __init__(self, make, limit: int = MAX_WORDS_CACHED, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def arrow_schema(df: DataFrame, names: list[str]) -> list[str]:
    """DDL of those columns of df, to be carried through a mapInArrow."""
    return [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names]
