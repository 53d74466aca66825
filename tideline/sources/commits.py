"""Several tables published as one commit: data first, a manifest last, compared with the commit before.

Layout: ``<root>/data/<id>/<table>`` holds what a run wrote, ``<root>/commits/<n>.json`` names the tables of commit n, the hash of
the commit before and its own. Readers follow the newest manifest, so a run that dies between two tables leaves the
old state; its data is never read. A manifest is created under a name that must be free: of two runs that build on
the same commit one fails.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

from tideline.functions import files


class Conflict(RuntimeError):
    """The head is not the commit that the run has built on."""


class Commit(NamedTuple):
    """Position from 1, hash, the hash before (None for the first), table paths and what else the run noted."""

    seq: int
    sha: str
    previous: str | None
    tables: dict[str, str]
    notes: dict[str, Any]


def _sha(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _read(spark: SparkSession, root: str, name: str) -> Commit:
    body = json.loads(files.text(spark, f"{root}/commits/{name}"))
    sha = body.pop("sha")
    if _sha(body) != sha:
        raise ValueError(f"manifest {name} has been changed")
    return Commit(body["seq"], sha, body["previous"], body["tables"], body["notes"])


def history(spark: SparkSession, root: str) -> list[Commit]:
    """All commits in order; raises if the chain of hashes is broken."""
    found = [_read(spark, root, n) for n in files.names(spark, f"{root}/commits") if n.endswith(".json")]
    for i, commit in enumerate(found):
        if commit.seq != i + 1 or commit.previous != (found[i - 1].sha if i else None):
            raise ValueError(f"commit {commit.seq} doesn't follow the one before")
    return found


def head(spark: SparkSession, root: str) -> Commit | None:
    names = [n for n in files.names(spark, f"{root}/commits") if n.endswith(".json")]
    return _read(spark, root, names[-1]) if names else None


def table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A table as of the newest commit that has one of this name."""
    now = head(spark, root)
    return spark.read.parquet(now.tables[name]) if now and name in now.tables else None


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], notes: dict[str, Any], previous: str | None) -> Commit:
    """Writes ``tables`` and makes them the next commit, if ``previous`` still is the head's hash; other tables of the head stay."""
    now = head(spark, root)
    if (now.sha if now else None) != previous:
        raise Conflict(f"the head of {root} has moved")
    data = f"{root}/data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{data}/{name}")
    body = {"seq": now.seq + 1 if now else 1, "previous": previous, "tables": (now.tables if now else {}) | {name: f"{data}/{name}" for name in tables}, "notes": notes}
    sha = _sha(body)
    if not files.create(spark, f"{root}/commits/{body['seq']:012d}.json", json.dumps(body | {"sha": sha})):
        raise Conflict(f"another run has published commit {body['seq']} of {root}")
    return Commit(body["seq"], sha, previous, body["tables"], notes)
