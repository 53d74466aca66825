"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name, as bytes and as a Java class.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none gets one of its own; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = held.rsplit("/", 1)[0] if held else f"file://{tempfile.mkdtemp(prefix='tideline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


_HELD: dict[str, str | None] = {}


def shared_path(spark: SparkSession, kind: str, table: str | None = None) -> str:
    """A new path in the shared folder, which :func:`release` removes."""
    path = f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"
    _HELD[path] = table
    return path


def release(spark: SparkSession) -> None:
    """Removes everything that operators have written so far; results that were not taken yet are lost."""
    while _HELD:
        path, table = _HELD.popitem()
        if table:
            spark.sql(f"DROP TABLE IF EXISTS `{table}`")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, parts: int | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder, in at most ``parts`` files, and read again; survives lost executors."""
    spark = df.sparkSession
    df = df.coalesce(parts) if parts else df
    path = shared_path(spark, "tables")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, n: int) -> DataFrame:
    """``df`` written as a table of ``n`` buckets by a column, so that later joins on it leave these rows where they are."""
    spark = df.sparkSession
    name = f"tideline_{uuid.uuid4().hex}"
    path = shared_path(spark, "tables", name)
    df.repartition(n, by).write.format("parquet").bucketBy(n, by).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def hot_keys(counts: DataFrame, on: list[str]) -> DataFrame | None:
    """Of ``counts`` (on, n), the values with more than a thousandth of all rows and in how many parts (_tl_m) each is dealt; None where there are none."""
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    per = max(1000, math.ceil((total or 0) / 1000))
    if (most or 0) <= per:
        return None
    hot = counts.where(F.col("n") > per).select(*on, F.ceil(F.col("n") / per).cast("int").alias("_tl_m"))
    return counts.sparkSession.createDataFrame(hot.limit(1001).collect(), hot.schema)


def dealt_join(rows: DataFrame, table: DataFrame, on: list[str], by: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, whose ``on`` values are unique, with a hot value's rows dealt over several tasks.

    ``counts`` (on, n) tells how many rows each value has. Values with more than a thousandth of all rows are hot: at most a
    thousand of them, whose list goes to all tasks. A hot value's rows are salted by ``by``, and its table row is repeated for each salt.
    """
    return salted_join(rows, table, on, by, hot_keys(counts, on), how)


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], by: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """:func:`dealt_join` with the hot values of :func:`hot_keys`, for joins that repeat with the same values."""
    if hot is None:
        return rows.join(table, on, how)
    listed = F.broadcast(hot)
    many = F.coalesce("_tl_m", F.lit(1))
    left = rows.join(listed, on, "left").withColumn("_tl_salt", F.pmod(F.xxhash64(by), many).cast("int")).drop("_tl_m")
    right = table.join(listed, on, "left").withColumn("_tl_salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("_tl_m")
    return left.join(right, [*on, "_tl_salt"], how).drop("_tl_salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An Arrow string column as (bytes, starts, ends); a null is an empty text."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if "large" in str(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


#: white[b]: byte b separates words.
WHITE = np.zeros(256, bool)
WHITE[list(SPACE_BYTES)] = True
#: lower[b]: byte b with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([[np.uint64(1)], np.full(size - 1, BASE)]).astype(np.uint64).cumprod(dtype=np.uint64)
            _INVERSES = np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]).astype(np.uint64).cumprod(dtype=np.uint64)
    return _POWERS, _INVERSES


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Word starts and ends in ``data`` and the number of words of each text.

    Texts lie one behind the other; a word never runs from one into the next.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    solid = ~WHITE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = starts[(starts > 0) & (starts < n)]
    first[edge] |= solid[edge]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = ends[(ends > 0) & (ends < n)] - 1
    last[edge] |= solid[edge]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, ends) - np.searchsorted(begin, starts)


def slice_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[begin:end], whatever stands around it."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    # in runs of slices, so that the powers stay few and the sums in the cache
    out = np.empty(len(begin), np.uint64)
    done = 0
    while done < len(begin):
        lo = int(begin[done])
        stop = max(done + 1, int(np.searchsorted(end, lo + (1 << 20), "right")))
        hi = int(end[stop - 1])
        power, inverse = _powers(hi - lo + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
            b, e = begin[done:stop] - lo, end[done:stop] - lo
            out[done:stop] = (sums[e] - sums[b]) * inverse[b]
            out[done:stop] += (e - b).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        done = stop
    return mix(out)


def window_hashes(unit: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` successive values of ``unit``, by doubling."""
    if len(unit) < width:
        return np.zeros(0, np.uint64)
    n = len(unit) - width + 1
    with np.errstate(over="ignore"):
        part, size, factor = unit.astype(np.uint64), 1, BASE
        out, covered = None, 0
        while True:
            if width & size:
                if out is None:
                    out = part[:n].copy()
                else:
                    out *= factor
                    out += part[covered : covered + n]
                covered += size
            if size * 2 > width:
                break
            part = part[:-size] * factor + part[size:]
            size *= 2
            factor = factor * factor
    return mix(out)
