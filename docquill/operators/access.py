"""Row-level access: who may see which rows. ``uid`` null stands for an anonymous caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible_document(uid: int | None, level: Column = None, owner: Column = None) -> Column:
    """Public, or for anyone who is logged in, or the caller's own."""
    level, owner = F.col("access_level") if level is None else level, F.col("user_id") if owner is None else owner
    public = level == "public"
    return public if uid is None else public | (level == "auth") | (owner == uid)


def owned_projects(projects: DataFrame, uid: int | None) -> DataFrame:
    return projects.where(F.lit(False) if uid is None else F.col("user_id") == uid)


def visible_runs(runs: DataFrame, projects: DataFrame, uid: int | None) -> DataFrame:
    """Public uploads by mail, or for anyone who is logged in, or own, or of an own project."""
    seen = (F.col("access_level") == "public") & (F.col("upload_type") == "email")
    if uid is None:
        return runs.where(seen)
    mine = owned_projects(projects, uid).select(F.col("project_id").alias("mine")).distinct()
    marked = runs.join(mine, F.col("project_id") == F.col("mine"), "left")
    return marked.where(seen | (F.col("access_level") == "auth") | (runs["user_id"] == uid) | F.col("mine").isNotNull()).drop("mine")


def visible_chunks(chunks: DataFrame, documents: DataFrame, runs: DataFrame, uid: int | None) -> DataFrame:
    """Chunks of a visible document or of a visible run; ``runs``: those the caller sees."""
    d = documents.where(visible_document(uid)).select(F.col("doc_id").alias("d")).distinct()
    r = runs.select(F.col("run_id").alias("r")).distinct()
    marked = chunks.join(d, F.col("doc_id") == F.col("d"), "left").join(r, F.col("run_id") == F.col("r"), "left")
    return marked.where("d IS NOT NULL OR r IS NOT NULL").drop("d", "r")


def accessible_ids(documents: DataFrame, uid: int | None) -> DataFrame:
    """The set of document ids that the caller may read. An empty set means no rows, not no filter."""
    open_ = documents.where(F.col("access_level") == "public" if uid is None else F.col("access_level").isin("public", "auth")).select("doc_id")
    return open_.distinct() if uid is None else open_.union(documents.where(F.col("user_id") == uid).select("doc_id")).distinct()
