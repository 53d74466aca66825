"""Append-only tables: selection, dedupe, hash chains, references and content hashes.

Chains are checked by joining each row's previous hash to the row that has it, so a ledger of
any length is checked in parallel; nothing needs one global order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def unseen(candidates: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(stored.select(*keys).distinct(), keys, "left_anti")


def first_wins(rows: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row per key, and the keys that come with more than one payload."""
    w = W.Window.partitionBy(*keys).orderBy(*order)
    kept = rows.withColumn("_tl_n", F.row_number().over(w)).where("_tl_n = 1").drop("_tl_n")
    conflicts = rows.groupBy(*keys).agg(F.countDistinct(F.struct(*payload)).alias("payloads")).where("payloads > 1")
    return kept, conflicts


def numbered(rows: DataFrame, keys: list[str], order: list[str], width: float, name: str = "seq") -> DataFrame:
    """``rows`` with their place from 1 within ``keys``, in two levels: no task holds a whole key.

    The first of ``order`` (a number or a time) is cut into chunks of ``width`` (seconds for times). A row's place is the number of rows in the chunks
    before, a running sum over chunk counts, and its place in its chunk."""
    chunk = F.floor(F.col(order[0]).cast("double") / width)
    d = rows.withColumn("_tl_chunk", chunk)
    before = F.sum("_tl_n").over(W.Window.partitionBy(*keys).orderBy(F.col("_tl_chunk").asc_nulls_first()).rowsBetween(W.Window.unboundedPreceding, -1))
    starts = d.groupBy(*keys, "_tl_chunk").agg(F.count("*").alias("_tl_n")).select(*keys, F.col("_tl_chunk").alias("_tl_of"), F.coalesce(before, F.lit(0)).alias("_tl_before"))
    starts = starts.select(*[F.col(k).alias(f"_tl_{i}") for i, k in enumerate(keys)], "_tl_of", "_tl_before")
    inside = F.row_number().over(W.Window.partitionBy(*keys, "_tl_chunk").orderBy(*order))
    same = F.col("_tl_chunk").eqNullSafe(F.col("_tl_of"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_tl_{i}"))
    placed = d.withColumn("_tl_inside", inside).join(starts, same)
    return placed.select(*rows.columns, (F.col("_tl_before") + F.col("_tl_inside")).alias(name))


def chain(rows: DataFrame, ledger: str, order: list[str], payload: Column, width: float = 86_400) -> DataFrame:
    """``rows`` with seq, sha and prev_sha: each row's hash covers its payload and place, and names its predecessor's.

    Places are numbered in chunks of ``width``; the predecessor's hash comes by a join on the place before."""
    d = numbered(rows, [ledger], order, width).withColumn("sha", F.sha2(F.concat_ws("|", F.col(ledger), F.col("seq"), payload), 256))
    before = d.select(F.col(ledger).alias("_tl_ledger"), (F.col("seq") + 1).alias("_tl_seq"), F.col("sha").alias("prev_sha"))
    return d.join(before, (d[ledger] == before["_tl_ledger"]) & (d["seq"] == before["_tl_seq"]), "left").drop("_tl_ledger", "_tl_seq")


def extend(stored: DataFrame | None, entries: DataFrame, ledger: str, at: str, payload: list[str]) -> DataFrame:
    """``stored`` with one more entry per ledger, whose hash also covers its predecessor's.

    An entry equal to its ledger's last one adds nothing; another one that isn't later than it raises an error."""
    hash_ = F.sha2(F.concat_ws("|", F.col(ledger), F.col("seq"), F.concat_ws(":", *payload), F.coalesce("prev_sha", F.lit(""))), 256)
    if stored is None:
        return entries.withColumns({"seq": F.lit(1).cast("long"), "prev_sha": F.lit(None).cast("string")}).withColumn("sha", hash_)
    last = stored.groupBy(ledger).agg(F.max_by(F.struct("seq", "sha", F.col(at).alias("at"), F.concat_ws(":", *payload).alias("payload")), "seq").alias("_tl_last"))
    d = entries.join(last, ledger, "left").where(~F.col("_tl_last.payload").eqNullSafe(F.concat_ws(":", *payload)))
    later = F.col("_tl_last").isNull() | (F.col(at) > F.col("_tl_last.at"))
    d = d.withColumn("seq", F.when(later, F.coalesce(F.col("_tl_last.seq"), F.lit(0)) + 1).otherwise(F.raise_error(F.concat(F.lit("an entry is not later than the last one of "), F.col(ledger))).cast("long")))
    d = d.withColumn("prev_sha", F.col("_tl_last.sha")).drop("_tl_last").withColumn("sha", hash_)
    return stored.unionByName(d.select(*stored.columns))


def chain_report(rows: DataFrame, ledger: str) -> DataFrame:
    """Per ledger: rows, roots, links to nowhere, forks and links that go back in time."""
    own = rows.select(F.col(ledger).alias("l2"), F.col("sha").alias("s2"), F.col("seq").alias("q2"))
    d = rows.join(own, (rows[ledger] == own["l2"]) & (rows["prev_sha"] == own["s2"]), "left")
    g = d.groupBy(ledger).agg(F.count("*").alias("rows"), F.count_if(F.col("prev_sha").isNull()).alias("roots"), F.count_if(F.col("prev_sha").isNotNull() & F.col("s2").isNull()).alias("broken"), F.count_if(F.col("q2") >= F.col("seq")).alias("disordered"))
    forks = rows.where("prev_sha IS NOT NULL").groupBy(ledger, "prev_sha").agg(F.count("*").alias("n")).where("n > 1").groupBy(ledger).agg(F.count("*").alias("forks"))
    return g.join(forks, ledger, "left").withColumn("forks", F.coalesce("forks", F.lit(0)))


def dangling(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``child`` whose keys ``parent`` lacks."""
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def disagreeing(child: DataFrame, parent: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Joined rows whose ``columns`` differ between both sides."""
    p = parent.select(*keys, *[F.col(c).alias(f"_tl_{c}") for c in columns])
    return child.join(p, keys).where(F.lit(False) if not columns else ~F.array_min(F.array(*[F.col(c).eqNullSafe(F.col(f"_tl_{c}")) for c in columns])))


def content_hash(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A hash of a table's rows in any order: each row's SHA-256 in four parts of 60 bits, the sums of these parts and the number of rows,
    and one digest over them. Sums are combined before the shuffle, so a table of any size costs a row per task and key."""
    keys = keys or []
    row = F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("<null>"))) for c in df.columns if c not in keys]), 256)
    r = df.select(*keys, row.alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"_tl_{i}") for i in range(4)]
    g = r.groupBy(*keys).agg(*parts, F.count("*").alias("rows"))
    sums = [F.coalesce(F.col(f"_tl_{i}").cast("string"), F.lit("0")) for i in range(4)]
    return g.select(*keys, F.sha2(F.concat_ws("|", *sums, F.col("rows").cast("string")), 256).alias("content_sha"), "rows")


def round_robin(rows: DataFrame, source: str, order: list[str], declared: list[str], width: float = 86_400) -> DataFrame:
    """Adds turn and source rank: sources in declared order, then by name, each in its own order."""
    place = F.array_position(F.array(*map(F.lit, declared)), F.col(source))
    d = numbered(rows, [source], order, width, "turn")
    return d.withColumn("source_rank", F.when(place > 0, place).otherwise(len(declared) + 1))


def select_round_robin(rows: DataFrame, source: str, order: list[str], declared: list[str], budget: int, width: float = 86_400) -> DataFrame:
    return round_robin(rows, source, order, declared, width).orderBy("turn", "source_rank", source).limit(budget)


#: Workflows that store states, the preferred one last.
WORKFLOWS = ("longitudinal", "pilot")


def judge_states(candidates: DataFrame, key: str, id_: str, since: Column | None = None) -> DataFrame:
    """Candidates (key, id, created_at, completed_at, workflow, run, expired) with their decision: per key one is selected.

    Of those that haven't expired and aren't older than ``since`` the newest by creation, completion, workflow and run wins, then the largest
    id; the others are rejected as expired, too old or older. Only the winner is looked for per key, by a partial maximum; ids that come twice for a key raise an error."""
    c = F.col
    old = c("created_at") < since if since is not None else F.lit(False)
    decision = F.when(c("expired"), "rejected_expired").when(old, "rejected_too_old")
    order = F.struct("created_at", "completed_at", F.array_position(F.array(*map(F.lit, WORKFLOWS)), c("workflow")), "run", c(id_).alias("id"))
    best = candidates.where(~c("expired") & ~old).groupBy(key).agg(F.max(order)["id"].alias("_tl_best"))
    twice = candidates.groupBy(key, id_).agg(F.count("*").alias("_tl_n"))
    one = F.when(c("_tl_n") > 1, F.raise_error(F.lit("a candidate comes twice"))).otherwise(F.lit("rejected_older"))
    d = candidates.join(best, key, "left").join(twice, [key, id_])
    return d.withColumn("decision", F.coalesce(decision, F.when((c("_tl_n") == 1) & (c(id_) == c("_tl_best")), "selected"), one)).drop("_tl_best", "_tl_n")


def selected_states(judged: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key the selected candidate's ``columns`` (null where none is eligible) and how many were considered and rejected, by reason."""
    is_ = lambda d: F.col("decision") == d
    picked = [F.max(F.when(is_("selected"), F.col(x))).alias(x) for x in columns]
    return judged.groupBy(key).agg(*picked, F.count("*").alias("considered"), F.count_if(~is_("selected")).alias("rejected"), F.count_if(is_("rejected_expired")).alias("expired"), F.count_if(is_("rejected_too_old")).alias("too_old"))
