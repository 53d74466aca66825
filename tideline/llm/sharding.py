"""Sharding by a weighted hash tree: region, then rack, then shard.

At each level a row draws ``-ln(u) / weight`` for every child of the node it has
reached, u being a hash of doc_id and the child's name, and goes to the smallest
draw. A child's draw depends on nothing but the row, its name and its weight, so a
child whose weight grows only gains rows and one whose weight falls only loses
some; movement stays in the subtrees whose weights change. :func:`grow` opens each new
shard in a region of its own, however many there are, so that the rows which move all
land in that shard. (A shard added to a region that holds others would raise that region's weight, and
some of the rows it draws would reach the others.)

Everything is DataFrame expressions. A null doc_id hashes as the text ``null``; a
null text counts as empty. Rows that repeat get successive slots (rows with equal doc_id and text in any order). Extra columns are
left out, whatever their names. A long text is only measured and checksummed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import documents

N_SHARDS = 40
RACKS, SHARDS = 4, 5  # of a region, of a rack
ROWS_PER_CHUNK = 4096

Tree = dict[str, dict[str, dict[int, float]]]


def tree(n_shards: int, weights: dict[int, float] | None = None) -> Tree:
    """n_shards leaves in racks of SHARDS and regions of RACKS racks; weight 1 unless given."""
    out: Tree = {}
    for s in range(n_shards):
        region, rack = s // (RACKS * SHARDS), s // SHARDS
        out.setdefault(f"g{region}", {}).setdefault(f"k{rack}", {})[s] = (weights or {}).get(s, 1.0)
    return out


def grow(topology: Tree) -> Tree:
    """``topology`` with one more shard, alone in a new rack of a new region."""
    racks = [k for region in topology.values() for k in region]
    shards = [s for region in topology.values() for rack in region.values() for s in rack]
    return topology | {f"g{len(topology)}": {f"k{len(racks)}": {len(shards): 1.0}}}


def _unit(name: Column, key: Column) -> Column:
    """A uniform draw in (0, 1) for the node ``name``; the top 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(name, F.lit(":"), key)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def _pick(children: Column, key: Column, prefix: str) -> Column:
    """The name of the child with the smallest draw; children: an array of (c: name, w: weight)."""
    draw = lambda x: F.struct((-F.log(_unit(F.concat(F.lit(prefix), x["c"]), key)) / x["w"]).alias("d"), x["c"].alias("c"))
    return F.array_min(F.transform(children, draw))["c"]


def _children(node: Column | None, table: dict[str, dict]) -> Column:
    """The children of ``node`` as a literal array of (c, w)."""
    lists = {n: F.array(*[F.struct(F.lit(str(c)).alias("c"), F.lit(float(w)).alias("w")) for c, w in x.items()]) for n, x in table.items()}
    if node is None:
        return next(iter(lists.values()))
    found = None
    for n, x in lists.items():
        found = F.when(node == n, x) if found is None else found.when(node == n, x)
    return found


def assign(df: DataFrame, key: Column, topology: Tree, out: str) -> DataFrame:
    """Adds the shard column ``out``; the descent takes one small projection per level."""
    k, g, r = "_tl_key", "_tl_region", "_tl_rack"
    regions = {"": {n: sum(sum(x.values()) for x in racks.values()) for n, racks in topology.items()}}
    racks = {n: {m: sum(x.values()) for m, x in racks.items()} for n, racks in topology.items()}
    shards = {m: x for racks in topology.values() for m, x in racks.items()}
    df = df.withColumn(k, key)
    df = df.withColumn(g, _pick(_children(None, regions), F.col(k), ""))
    df = df.withColumn(r, _pick(_children(F.col(g), racks), F.col(k), ""))
    df = df.withColumn(out, _pick(_children(F.col(r), shards), F.col(k), "s").cast("int"))
    return df.drop(k, g, r)


def shard_documents(docs: DataFrame, topology: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Slots number a shard's rows without gaps in the order of MD5(doc_id). A shard is
    numbered in chunks of that order: chunk sizes give each chunk its first slot, so no
    task ever holds a whole shard.
    """
    topology = tree(N_SHARDS) if topology is None else topology
    n_shards = sum(len(rack) for region in topology.values() for rack in region.values())
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    chunks = max(4, math.ceil(docs.count() / n_shards / ROWS_PER_CHUNK))
    order = F.md5(key)
    chunk = F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * chunks / float(1 << 32)).cast("int")
    placed = assign(docs.select("doc_id", "text"), key, topology, "shard").withColumn("_tl_chunk", chunk)
    first = F.sum("_tl_n").over(W.Window.partitionBy("shard").orderBy("_tl_chunk").rowsBetween(W.Window.unboundedPreceding, -1))
    starts = placed.groupBy("shard", "_tl_chunk").agg(F.count("*").alias("_tl_n")).select("shard", "_tl_chunk", F.coalesce(first, F.lit(0)).alias("_tl_first"))
    rows = placed.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "_tl_chunk", order.alias("_tl_order"),
    )
    rows = assign(rows, key, grow(topology), "grown_shard")
    within = F.row_number().over(W.Window.partitionBy("shard", "_tl_chunk").orderBy("_tl_order", "text_crc32"))
    return rows.join(starts, ["shard", "_tl_chunk"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_tl_first") + within - 1).cast("long").alias("slot"), "grown_shard")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def _sql_pick(children: dict, prefix: str) -> str:
    draws = ", ".join(f"{{'d': -ln((('0x' || substr(md5('{prefix}{c}:' || k), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / {float(w)}::DOUBLE, 'c': {c if isinstance(c, int) else repr(c)}}}" for c, w in sorted(children.items()))
    return f"list_min([{draws}])['c']"


def _sql_shard(t: Tree) -> str:
    region = _sql_pick({g: sum(sum(x.values()) for x in racks.values()) for g, racks in t.items()}, "")
    rack = "CASE g " + " ".join(f"WHEN '{g}' THEN {_sql_pick({m: sum(x.values()) for m, x in racks.items()}, '')}" for g, racks in t.items()) + " END"
    shard = "CASE r " + " ".join(f"WHEN '{m}' THEN {_sql_pick(x, 's')}" for racks in t.values() for m, x in racks.items()) + " END"
    return f"SELECT k, {shard} AS s FROM (SELECT k, {rack} AS r FROM (SELECT k, {region} AS g FROM keys))"


ORACLE = f"""
WITH keys AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
now AS ({_sql_shard(tree(N_SHARDS))}), grown AS ({_sql_shard(grow(tree(N_SHARDS)))}),
steps AS (SELECT list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c, i FROM range(256) t(i)),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps),
crc AS (SELECT doc_id, coalesce(text, '') AS text,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS crc
  FROM documents, crc_table)
SELECT doc_id, (strlen(text) + 16)::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, now.s::INTEGER AS shard,
  (row_number() OVER (PARTITION BY now.s ORDER BY md5(now.k), crc) - 1)::BIGINT AS slot, grown.s::INTEGER AS grown_shard
FROM crc JOIN now ON now.k = coalesce(doc_id::VARCHAR, 'null') JOIN grown USING (k)
"""
