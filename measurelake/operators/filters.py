"""Filters, search and row access."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelake.model import ALL_STATES, FilterState


def state_condition(states: Iterable[str] | None) -> Column | None:
    """Membership in ``states``; None when there is nothing to filter."""
    states = list(states or ())
    if not states or ALL_STATES in states:
        return None
    return F.col("state_name").isin(states)


def in_states(df: DataFrame, states: Iterable[str] | None) -> DataFrame:
    condition = state_condition(states)
    return df if condition is None else df.where(condition)


def apply_filter(
    df: DataFrame, selection: FilterState, extra: Iterable[Column] = ()
) -> DataFrame:
    """States, inclusive dates and further conditions, as one pushable predicate.

    On a table with the columns year and month, as month folders give them, the
    dates also say which folders are read.
    """
    conditions = [state_condition(selection.states), *extra]
    if {"year", "month"} <= set(df.columns):
        month = F.col("year") * 12 + F.col("month")
        if (day := selection.date_from) is not None:
            conditions.append(month >= day.year * 12 + day.month)
        if (day := selection.date_to) is not None:
            conditions.append(month <= day.year * 12 + day.month)
    if selection.date_from is not None:
        conditions.append(F.col("date_local") >= F.lit(selection.date_from))
    if selection.date_to is not None:
        conditions.append(F.col("date_local") <= F.lit(selection.date_to))
    conditions = [c for c in conditions if c is not None]
    return df.where(reduce(and_, conditions)) if conditions else df


def with_label(df: DataFrame, column: str, labels: Iterable[str]) -> DataFrame:
    """Rows whose derived label is one of ``labels``."""
    return df.where(F.col(column).isin(list(labels)))


def search(df: DataFrame, term: str, literal: bool = False) -> DataFrame:
    """Rows in which any column, as text, matches ``term`` regardless of case.

    ``term`` is a (Java) regular expression unless ``literal``; a null cell
    never matches.
    """
    pattern = "(?iu)" + (re.escape(term) if literal else term)
    hits = [F.coalesce(F.col(c).cast("string").rlike(pattern), F.lit(False)) for c in df.columns]
    return df.where(reduce(or_, hits))


def explorer_rows(
    df: DataFrame,
    selection: FilterState = FilterState(),
    limit: int | None = 1000,
    term: str | None = None,
) -> DataFrame:
    """Filtered rows for browsing: search first, then a stable order, then the limit.

    The order takes in every column, so the limit always keeps the same rows;
    Spark keeps only ``limit`` rows per task for it.
    """
    rows = apply_filter(df, selection)
    if term:
        rows = search(rows, term)
    if limit is None:
        return rows
    lead = [c for c in ("date_local", "state_name", "county_name", "site_name") if c in df.columns]
    rest = [c for c in df.columns if c not in lead]
    return rows.orderBy(*[F.col(c).asc_nulls_last() for c in lead + rest]).limit(limit)


def states_list(df: DataFrame) -> DataFrame:
    """Distinct states, sorted, without null."""
    return (
        df.where(F.col("state_name").isNotNull()).select("state_name").distinct().orderBy("state_name")
    )
