"""Deletes that follow foreign keys: which rows go with the rows that are to go, in the order in which tables can be cleared."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquill.scratch import materialize


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` refers to ``parent.refers_to``; rows go with their parent, or lose the reference where ``action`` is set null."""

    child: str
    column: str
    parent: str
    refers_to: str
    action: str = "cascade"


def components(tables: list[str], keys: list[ForeignKey]) -> list[list[str]]:
    """The tables, parents first; tables that refer to each other in a circle (or to themselves) stand together."""
    below = {t: {k.parent for k in keys if k.child == t} for t in tables}

    def reached(t: str) -> set[str]:
        seen: set[str] = set()
        todo = [*below[t]]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += below[x]
        return seen

    reach = {t: reached(t) for t in tables}
    circle = {t: frozenset({t} | {u for u in tables if u in reach[t] and t in reach[u]}) for t in tables}
    graph = {circle[t]: {circle[p] for p in below[t]} - {circle[t]} for t in tables}
    return [sorted(c, key=tables.index) for c in TopologicalSorter(graph).static_order()]


def deletion_order(tables: list[str], keys: list[ForeignKey]) -> list[list[str]]:
    """The tables in the order in which their rows can be deleted: children first."""
    return components(tables, keys)[::-1]


def cascade(tables: dict[str, DataFrame], primary: dict[str, list[str]], keys: list[ForeignKey], doomed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The surviving rows of each table when the rows of ``doomed`` go, and all that refer to them.

    ``primary`` names the columns that tell a table's rows apart; ``doomed`` has
    these columns, or rows of the table. References are followed by semi joins,
    parents first, within a circle until nothing is added, each round written. A
    null reference goes with nothing. Rows whose key is null are kept.
    """
    gone = {t: df.select(*primary[t]).distinct() for t, df in doomed.items()}
    for circle in components(list(tables), keys):
        inner = [k for k in keys if k.child in circle and k.parent in circle and k.action == "cascade"]
        for t in circle:
            for k in keys:
                if k.child == t and k.parent not in circle and k.action == "cascade" and k.parent in gone:
                    gone[t] = _added(gone.get(t), _referring(tables, primary, k, gone[k.parent]))
        fresh = {t: materialize(gone[t], "doomed") for t in circle if inner and t in gone}
        gone |= fresh
        while fresh:
            found: dict[str, DataFrame] = {}
            for k in inner:
                if k.parent in fresh:
                    found[k.child] = _added(found.get(k.child), _referring(tables, primary, k, fresh[k.parent]))
            known = {t: rows.join(gone[t], primary[t], "left_anti") if t in gone else rows for t, rows in found.items()}
            fresh = {t: rows for t, rows in ((t, materialize(rows, "doomed")) for t, rows in known.items()) if rows.take(1)}
            gone |= {t: _added(gone.get(t), rows) for t, rows in fresh.items()}
    return {t: _without(_cleared(df, t, tables, keys, gone), primary[t], gone.get(t)) for t, df in tables.items()}


def _added(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b).distinct()


def _values(tables: dict[str, DataFrame], k: ForeignKey, gone: DataFrame) -> DataFrame:
    """What references to doomed rows hold; ``gone`` has the primary key, ``refers_to`` may be another column."""
    have = gone if k.refers_to in gone.columns else tables[k.parent].join(gone, gone.columns, "left_semi")
    return have.select(F.col(k.refers_to).alias("__refers")).distinct()


def _referring(tables: dict[str, DataFrame], primary: dict[str, list[str]], k: ForeignKey, gone: DataFrame) -> DataFrame:
    child = tables[k.child].select(*dict.fromkeys([*primary[k.child], k.column]))
    return child.join(_values(tables, k, gone), F.col(k.column) == F.col("__refers"), "left_semi").select(*primary[k.child]).distinct()


def _cleared(df: DataFrame, t: str, tables: dict[str, DataFrame], keys: list[ForeignKey], gone: dict[str, DataFrame]) -> DataFrame:
    """References to doomed rows as nulls, where that is their action."""
    for k in keys:
        if k.child == t and k.action == "set null" and k.parent in gone:
            lost = _values(tables, k, gone[k.parent]).withColumn("__lost", F.lit(True))
            kept = F.when(F.col("__lost").isNull(), F.col(k.column)).alias(k.column)
            df = df.join(lost, F.col(k.column) == F.col("__refers"), "left").select(*[kept if c == k.column else c for c in df.columns])
    return df


def _without(df: DataFrame, key: list[str], gone: DataFrame | None) -> DataFrame:
    if gone is None:
        return df
    renamed = gone.select(*[F.col(c).alias(f"__{c}") for c in key])
    return df.join(renamed, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in key]), "left_anti")
