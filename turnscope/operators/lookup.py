"""Lookups over the index: projects, sessions, and a turn with its neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnscope.functions.names import jaro_winkler
from turnscope.operators.errors import BadRequest, Unknown

FUZZY = 0.85


def project_rollup(turns: DataFrame) -> DataFrame:
    """(key, name, name_lower, turns), most turns first."""
    grouped = turns.groupBy(F.col("project_key").alias("key")).agg(F.max("project_name").alias("name"), F.count("*").alias("turns"))
    return grouped.select("key", "name", F.lower("name").alias("name_lower"), "turns").orderBy(F.desc("turns"), "name")


def project_tiers(projects: DataFrame, name: str) -> DataFrame:
    """``projects`` with ``similarity`` and the first ``tier`` (1 to 5) in which the name fits, null if none."""
    lower = name.lower()

    @F.pandas_udf(T.DoubleType())
    def alike(names: pd.Series) -> pd.Series:
        return names.map(lambda n: jaro_winkler(n or "", lower))

    rows = projects.withColumn("similarity", alike("name_lower"))
    tier = (
        F.when(F.col("key") == name, 1)
        .when(F.col("name") == name, 2)
        .when(F.col("name_lower") == lower, 3)
        .when(F.contains("name_lower", F.lit(lower)), 4)
        .when(F.col("similarity") >= FUZZY, 5)
    )
    return rows.withColumn("tier", tier)


def resolve_project(projects: DataFrame, name: str) -> dict:
    """The one project that the name means. The first tier with a candidate decides."""
    name = name.strip()
    if not name:
        raise BadRequest("empty project name")
    tiers = project_tiers(projects, name).persist()
    try:
        best = tiers.agg(F.min("tier")).first()[0]
        if best is None:
            close = [r["name"] for r in tiers.orderBy(F.desc("similarity"), F.desc("turns"), "name").limit(3).collect()]
            raise Unknown(f"no project matches '{name}'; closest: {', '.join(close)}" if close else f"no project matches '{name}': the index has no projects yet")
        found = tiers.filter(F.col("tier") == best).orderBy(F.desc("turns"), "name").collect()  # projects are few
    finally:
        tiers.unpersist()
    if len(found) > 1:
        listed = ", ".join(f"{r['name']} ({r['key']})" for r in found)
        raise Unknown(f"project '{name}' is ambiguous: {listed}; pass a full name or path")
    return {"key": found[0]["key"], "name": found[0]["name"], "turns": found[0]["turns"]}


def session_candidates(sessions: DataFrame, prefix: str, most: int = 11) -> DataFrame:
    """The exact session if there is one, else those that start with the prefix, in order."""
    fits = sessions.filter(F.startswith("session", F.lit(prefix))).select("session", (F.col("session") == prefix).alias("exact"))
    return fits.orderBy(F.desc("exact"), "session").limit(most)


def resolve_session(sessions: DataFrame, prefix: str) -> str:
    found = session_candidates(sessions, prefix).collect()
    if not found:
        raise Unknown(f"no session matches '{prefix}'")
    if found[0]["exact"] or len(found) == 1:
        return found[0]["session"]
    raise Unknown(f"session prefix '{prefix}' is ambiguous: {', '.join(r['session'] for r in found[:10])}")


def neighbours(turns: DataFrame, session: str, entry_id: int, around: int) -> DataFrame:
    """The turn and ``around`` turns on each side of it, by entry id."""
    own = turns.filter(F.col("session") == session)
    before = own.filter(F.col("entry_id") < entry_id).orderBy(F.desc("entry_id")).limit(around)
    after = own.filter(F.col("entry_id") > entry_id).orderBy("entry_id").limit(around)
    return before.unionByName(own.filter(F.col("entry_id") == entry_id).limit(1)).unionByName(after).orderBy("entry_id")


def neighbours_of_all(turns: DataFrame, targets: DataFrame, around: int) -> DataFrame:
    """For many targets (session, entry_id) at once: (target, session, entry_id) of each and its neighbours."""
    numbered = turns.select("session", "entry_id", F.row_number().over(Window.partitionBy("session").orderBy("entry_id")).alias("at"))
    wanted = targets.join(numbered, ["session", "entry_id"]).select("session", F.col("entry_id").alias("target"), F.explode(F.sequence(F.col("at") - around, F.col("at") + around)).alias("at"))
    return wanted.join(numbered, ["session", "at"]).select("target", "session", "entry_id")


def upsert(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` with the rows of ``fresh`` in place of those with the same key."""
    return stored.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh)
