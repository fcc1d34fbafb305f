"""Structured queries: filters, order, limit and aggregation folded into one lazy plan."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import temporal


@dataclass(frozen=True)
class Filter:
    """``op``: eq neq gt lt gte lte between in contains matches."""

    column: str
    op: str
    value: Any


@dataclass(frozen=True)
class Query:
    """``kind``: identifier, attributes, aggregate, temporal, history or changes; all but history fold into one select."""

    kind: str = "attributes"
    filters: tuple[Filter, ...] = ()
    columns: tuple[str, ...] = ()
    sort_by: str | None = None
    ascending: bool = True
    limit: int | None = None
    offset: int = 0
    group_by: str | None = None
    since: dt.datetime | None = None
    until: dt.datetime | None = None
    options: dict = field(default_factory=dict)


def predicate(f: Filter) -> Column:
    """neq keeps nulls; contains looks for the literal text without case and never matches null; matches takes a pattern."""
    c, v = F.col(f.column), f.value
    if f.op == "eq":
        return c == v
    if f.op == "neq":
        return ~c.eqNullSafe(F.lit(v))
    if f.op in ("gt", "lt", "gte", "lte"):
        return {"gt": c > v, "lt": c < v, "gte": c >= v, "lte": c <= v}[f.op]
    if f.op == "between":
        return c.between(*v)
    if f.op == "in":
        return c.isin(list(v))
    if f.op == "contains":
        return F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(str(v).lower())), F.lit(False))
    if f.op == "matches":
        return F.coalesce(c.cast("string").rlike(f"(?i){v}"), F.lit(False))
    raise ValueError(f"unknown operator {f.op}")


def run(df: DataFrame, query: Query, ignore_unknown: bool = False, at: str = "UpdateDate", seq: str = "record_id") -> DataFrame:
    """The query's rows, still lazy. Unknown columns raise unless they are to be ignored."""
    if query.kind == "history":
        return history(df, query, at, seq)
    if query.kind == "changes":
        obs = temporal.observations(df, {"flag": "flag"}, at, seq)
        return temporal.changes(temporal.islands(obs), "flag", query.since)
    for f in query.filters:
        if f.column in df.columns:
            df = df.where(predicate(f))
        elif not ignore_unknown:
            raise ValueError(f"unknown column {f.column}")
    if query.since is not None:
        df = df.where(F.col(at) >= F.lit(query.since).cast("timestamp_ntz"))
    if query.until is not None:
        df = df.where(F.col(at) <= F.lit(query.until).cast("timestamp_ntz"))
    if query.kind == "aggregate":
        if query.group_by is None:
            return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(c).alias(f"unique_{c}") for c in ("imo", "mmsi", "flag") if c in df.columns])
        return df.where(F.col(query.group_by).isNotNull()).groupBy(query.group_by).agg(F.count(F.lit(1)).alias("n")).orderBy(query.group_by)
    if query.sort_by:
        c = F.col(query.sort_by)
        order = [c.asc_nulls_last() if query.ascending else c.desc_nulls_last()]
        df = df.orderBy(*order, *([seq] if seq in df.columns else []))
    if query.offset:
        df = df.offset(query.offset)
    if query.limit is not None:
        df = df.limit(query.limit)
    return df.select(*query.columns) if query.columns else df


def page(df: DataFrame, query: Query) -> DataFrame:
    """The rows of ``query`` with ``total_count``, the number of rows that it has without limit and offset."""
    whole = run(df, replace(query, limit=None, offset=0, sort_by=None, columns=())).agg(F.count(F.lit(1)).alias("total_count"))  # one row
    return run(df, query).crossJoin(F.broadcast(whole))


def history(df: DataFrame, query: Query, at: str, seq: str) -> DataFrame:
    """(attribute, value, start_date, end_date) of mmsi, name and flag for the filtered vessels."""
    for f in query.filters:
        df = df.where(predicate(f))
    obs = temporal.observations(df, {"mmsi": "mmsi", "name": "name", "flag": "flag"}, at, seq)
    return temporal.islands(obs).select("entity_id", "attribute", "value", "start_date", "end_date")


def by_imo(imo: int) -> Query:
    return Query("identifier", (Filter("imo", "eq", imo),))


def by_mmsi(mmsi: int) -> Query:
    return Query("identifier", (Filter("mmsi", "eq", mmsi),))


def by_name(name: str) -> Query:
    return Query("attributes", (Filter("name", "contains", name),))


def by_flag(flag: str) -> Query:
    return Query("attributes", (Filter("flag", "eq", flag.upper()),))


def history_of(imo: int) -> Query:
    return Query("history", (Filter("imo", "eq", imo),))


def search(imo: int | None = None, mmsi: int | None = None, name: str | None = None, vessel_type: str | None = None, flag: str | None = None, longer: float | None = None, shorter: float | None = None, limit: int = 100) -> Query:
    """A query from optional criteria, by name."""
    wanted = [("imo", "eq", imo), ("mmsi", "eq", mmsi), ("name", "contains", name), ("vessel_type", "eq", vessel_type), ("flag", "eq", flag), ("length", "gte", longer), ("length", "lte", shorter)]
    return Query("attributes", tuple(Filter(*w) for w in wanted if w[2] is not None), sort_by="name", limit=limit)


def free_text(df: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Vessels whose name or callsign contains the text or whose imo or mmsi is it; texts under two letters find none."""
    low = F.lit(text.strip().lower())
    c = F.col
    hit = F.contains(F.lower(c("name")), low) | F.contains(F.lower(c("callsign")), low) | (c("imo").cast("string") == low) | (c("mmsi").cast("string") == low)
    return df.where(F.coalesce(hit, F.lit(False)) if len(text.strip()) >= 2 else F.lit(False)).limit(limit)
