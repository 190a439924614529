"""Newest-first pages, snapshots and per-group newest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilflow import fixed_values as V
from vigilflow.functions.expr import all_of, severity_rank


def newest_first(ts: str, key: str = "id") -> list[Column]:
    return [F.desc(ts), F.desc(key)]


def page(df: DataFrame, ts: str, limit: int | None, offset: int = 0, key: str = "id") -> DataFrame:
    """Rows ``offset .. offset+limit`` newest first (a distributed top-k); all of them without ``limit``."""
    if limit is not None and limit < 1:
        raise ValueError("a limit is at least 1")
    ordered = df.orderBy(*newest_first(ts, key)).offset(max(0, offset))
    return ordered if limit is None else ordered.limit(limit)


def page_after(df: DataFrame, ts: str, limit: int, cursor: tuple | None, key: str = "id") -> DataFrame:
    """The page that follows ``cursor = (timestamp literal, key)``.

    Deep pages cost the same as the first: the cursor is a pushed-down filter
    instead of rows sorted only to be skipped.
    """
    if cursor:
        at, last = cursor
        df = df.filter((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < F.lit(last))))
    return page(df, ts, limit, 0, key)


def newest_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows per group.

    Spark trims each task to n rows per group before the shuffle, so a group
    with a third of all rows sends only n rows per task.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= n)


def equal_filters(**wanted) -> Column:
    """AND of ``column = value`` for every value that is given."""
    return all_of([F.col(c) == v for c, v in wanted.items() if v is not None])


def checked(value: str | None, allowed: list[str], what: str) -> str | None:
    """Upper-case, trimmed and one of the allowed values."""
    if value is None:
        return None
    value = value.strip().upper()
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}")
    return value


def alerts_filter(alerts: DataFrame, severity: str | None = None, status: str | None = None) -> DataFrame:
    return alerts.filter(
        equal_filters(
            severity=checked(severity, V.SEVERITIES, "severity"),
            status=checked(status, V.ALERT_STATUSES, "status"),
        )
    )


def incidents_filter(incidents: DataFrame, status=None, severity=None, category=None, assigned_to=None) -> DataFrame:
    return incidents.filter(
        equal_filters(
            status=status and status.strip().upper(),
            severity=severity and severity.strip().upper(),
            category=category and category.strip(),
            assigned_to=assigned_to and assigned_to.strip(),
        )
    )


def audit_filter(
    audit: DataFrame, username=None, action=None, outcome=None, resource_type=None, start=None, end=None
) -> DataFrame:
    wanted = [
        equal_filters(
            action=action and action.strip().upper(),
            outcome=outcome and outcome.strip().upper(),
            resource_type=resource_type and resource_type.strip().upper(),
        )
    ]
    if username:
        wanted.append(F.col("username").ilike(like_pattern(username.strip())))
    if start is not None:
        wanted.append(F.col("timestamp") >= start)
    if end is not None:
        wanted.append(F.col("timestamp") <= end)
    return audit.filter(all_of(wanted))


def like_pattern(text: str) -> str:
    """``%text%``; a backslash in the text is plain text, not an escape."""
    return "%" + text.replace("\\", "\\\\") + "%"


def by_severity(df: DataFrame, column: str, *then: Column) -> DataFrame:
    return df.orderBy(F.desc(severity_rank(column)), *then)


def lookup(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is asked for; Spark broadcasts the ids when they are few."""
    return df.join(ids.select(key).distinct(), key, "left_semi")
