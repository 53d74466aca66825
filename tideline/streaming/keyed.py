"""Append-only tables with an index of their keys: a batch opens only the files that may hold its keys.

Layout of a table at ``<path>``:

* ``<path>/batch=<name>/part=<p>`` - the rows of a batch, dealt over ``PARTS`` parts by a hash of their keys; a part of a batch is a file;
* ``<path>-index/batch=<name>/part=<p>`` - a Bloom filter of each of these files, a row per 64 bits;
* ``<path>-manifest/<n>-<name>.json`` - written last: batches, rows, filter sizes and the newest time so far.

A batch counts when its manifest is there; what a failed one left behind is written again by its replay. The driver reads
names and the newest manifest, never keys.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import files

PARTS, PROBES, BITS_PER_KEY = 16, 4, 16


def stored_or_none(spark: SparkSession, *paths: str, base: str | None = None) -> DataFrame | None:
    try:
        return (spark.read.option("basePath", base) if base else spark.read).parquet(*paths)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _hash(keys: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def part_of(keys: list[str]) -> Column:
    return F.pmod(_hash(keys, 0), F.lit(PARTS)).cast("int")


def probes(keys: list[str], size: Column) -> Column:
    """The (word, bits) pairs that a key sets in a filter of ``size`` bits: several pairs may share a word."""
    at, step = (F.pmod(_hash(keys, n), F.lit(1 << 40)) for n in (1, 2))
    bit = [F.pmod(at + F.lit(i) * step.bitwiseOR(F.lit(1)), size) for i in range(PROBES)]
    return F.array(*[F.struct(F.shiftright(b, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)).cast("int")).alias("bits")) for b in bit])


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of batches that count, with their ``batch`` and ``part``."""
    return KeyedTable(spark, path, [], "").rows()


class KeyedTable:
    """The table at ``path`` whose rows are told apart by ``keys`` and ordered by ``at``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], at: str):
        self.spark, self.path, self.keys, self.at = spark, path, keys, at
        names = [n for n in files.names(spark, f"{path}-manifest") if n.endswith(".json")]
        self.batches = [n[: -len(".json")].split("-", 1)[1] for n in names]
        self.newest = json.loads(files.text(spark, f"{path}-manifest/{names[-1]}")) if names else {"rows": 0, "head": None, "sizes": []}

    def has(self, name: str) -> bool:
        return name in self.batches

    @property
    def head(self) -> int | None:
        """The newest ``at`` of all rows, in microseconds."""
        return self.newest["head"]

    def rows(self) -> DataFrame | None:
        """All rows of batches that count."""
        return stored_or_none(self.spark, *[f"{self.path}/batch={b}" for b in self.batches], base=self.path) if self.batches else None

    def candidates(self, batch: DataFrame) -> list[tuple[str, int]]:
        """The (batch, part) files whose filters let at least one key of ``batch`` through."""
        if not self.newest["sizes"]:
            return []
        parts = [r.part for r in batch.select(part_of(self.keys).alias("part")).distinct().collect()]  # PARTS at most
        known = [f"{self.path}-index/batch={b}/part={p}" for b in self.batches for p in parts]
        known = [x for x in known if files.exists(self.spark, x)]
        if not known:
            return []
        index = self.spark.read.option("basePath", f"{self.path}-index").parquet(*known).withColumn("batch", F.col("batch").cast("string"))
        size = F.explode(F.array(*[F.lit(x).cast("long") for x in self.newest["sizes"]]))
        key = _hash(self.keys, 3)
        asked = batch.select(*self.keys, key.alias("key"), part_of(self.keys).alias("part"), size.alias("size"))
        asked = asked.select("key", "part", "size", F.explode(probes(self.keys, F.col("size"))).alias("p")).select("key", "part", "size", "p.word", "p.bits")
        asked = asked.groupBy("key", "part", "size", "word").agg(F.bit_or("bits").alias("ask"))
        held = index.select("batch", "part", "size", "word", F.col("bits").alias("have"))
        met = asked.join(held, ["part", "size", "word"]).where(F.col("ask").bitwiseAND(F.col("have")) == F.col("ask"))
        # all words that a key asks for must have answered
        wanted = asked.groupBy("key", "part", "size").agg(F.count("*").alias("want"))
        through = met.groupBy("key", "part", "size", "batch").agg(F.count("*").alias("got")).join(wanted, ["key", "part", "size"]).where("got = want")
        return [(r.batch, r.part) for r in through.select("batch", "part").distinct().collect()]  # a row per file

    def unknown(self, batch: DataFrame) -> tuple[DataFrame, int]:
        """The rows of ``batch`` whose keys aren't stored, and how many files had to be opened for that."""
        found = self.candidates(batch)
        if not found:
            return batch, 0
        old = self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/batch={b}/part={p}" for b, p in found]).select(*self.keys)
        return batch.join(old, self.keys, "left_anti"), len(found)

    def append(self, name: str, rows: DataFrame, late: int = 0) -> None:
        """Writes a batch of new rows: data, then filters, then the manifest."""
        part = part_of(self.keys)
        out = f"{self.path}/batch={name}"
        rows.withColumn("part", part).repartition(PARTS, "part").write.mode("overwrite").partitionBy("part").parquet(out)
        back = stored_or_none(self.spark, out)
        n, head, sizes = 0, None, set(self.newest["sizes"])
        if back is not None:
            per = back.groupBy("part").agg(F.count("*").alias("n"), F.max(F.unix_micros(F.col(self.at))).alias("head"))
            per = {r.part: r for r in per.collect()}  # PARTS rows at most
            n, head = sum(r.n for r in per.values()), max((r.head for r in per.values() if r.head is not None), default=None)
            bits = {p: 1 << max(6, (BITS_PER_KEY * r.n - 1).bit_length()) for p, r in per.items()}
            size = reduce(lambda c, p: c.when(F.col("part") == p, F.lit(bits[p]).cast("long")), list(bits)[1:], F.when(F.col("part") == list(bits)[0], F.lit(bits[list(bits)[0]]).cast("long")))
            words = back.withColumn("size", size).select("part", "size", F.explode(probes(self.keys, F.col("size"))).alias("p"))
            index = words.groupBy("part", "size", F.col("p.word").alias("word")).agg(F.bit_or("p.bits").alias("bits"))
            index.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}-index/batch={name}")
            sizes |= set(bits.values())
        heads = [h for h in (head, self.head) if h is not None]
        manifest = {"batch": name, "rows": self.newest["rows"] + n, "head": max(heads) if heads else None, "sizes": sorted(sizes), "late": late}
        if not files.create(self.spark, f"{self.path}-manifest/{len(self.batches):08d}-{name}.json", json.dumps(manifest)):
            raise RuntimeError(f"another writer has appended to {self.path}")
