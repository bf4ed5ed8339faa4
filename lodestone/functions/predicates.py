"""Filter conditions as Columns. Plain comparisons reach the Parquet reader; array conditions are evaluated after it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ADMIN_USER, ROLLBACK_STATUSES, STATUSES


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of those given; none: true."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given) if given else F.lit(True)


def has_role(roles: Iterable[int], col: str = "role_ids") -> Column:
    """Any of the caller's roles is among the row's."""
    return F.arrays_overlap(F.col(col), F.array(*[F.lit(int(r)).cast("bigint") for r in roles]))


def unexpired(now: int, user_id: int | None = None, col: str = "expiration_date") -> Column:
    return (F.col(col) > now) | F.lit(user_id == ADMIN_USER)


def unexpired_keyword(now: int, col: str = "expiration_date") -> Column:
    """The keyword side counts the last second in."""
    return F.col(col) >= now


def contains(col: str, part: str | None, lower: bool = False) -> Column | None:
    """Substring condition, literal (no wildcards). With lower, the pattern is lower-cased and the column is not."""
    return F.col(col).contains(part.lower() if lower else part) if part else None


def hash_is(value: str | Iterable[str] | None, col: str = "hash_sha256") -> Column | None:
    if value is None:
        return None
    return F.col(col) == value if isinstance(value, str) else F.col(col).isin(list(value))


def status_is(status: str | None, col: str = "status") -> Column | None:
    if status is None:
        return None
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    return F.col(col) == status


def equals(**values) -> Column:
    return all_of(*[F.col(k) == v for k, v in values.items() if v is not None])


def matches(filters: Mapping[str, object]) -> Column:
    """Equality dictionary; an empty one is refused, as it would name every row."""
    if not filters:
        raise ValueError("no filter given")
    return equals(**filters)


def expiring(now: int, days: int = 7, col: str = "expiration_date") -> Column:
    return (F.col(col) > now) & (F.col(col) <= now + days * 86_400)


def without(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*cols)


def log_filter(user_id=None, action_type=None, start=None, end=None, success: bool | None = None) -> Column:
    """Audit-log conditions; success: True for SUCCESS rows, False for the others, None for all."""
    return all_of(
        equals(user_id=user_id, action_type=action_type), F.col("created_at") >= F.lit(start) if start is not None else None, F.col("created_at") <= F.lit(end) if end is not None else None,
        None if success is None else (F.col("success") == "SUCCESS") if success else (F.col("success") != "SUCCESS"),
    )


def due(now: int) -> Column:
    return F.col("is_active") & F.col("deleted_at").isNull() & (F.col("scheduled_at") <= now)


def visible(col: str = "deleted_at") -> Column:
    return F.col(col).isNull()


def stale(pending_before: int, running_before: int) -> Column:
    waiting = (F.col("status") == "pending") & F.col("started_at").isNull() & (F.col("created_at") < pending_before)
    return waiting | ((F.col("status") == "running") & (F.col("started_at") < running_before))


def owned(user_id: int, role_ids: Iterable[int]) -> Column:
    """Role 1 sees all rows, others their own."""
    return F.lit(True) if 1 in set(role_ids) else F.col("user_id") == user_id


def score_at_least(threshold: float, col: str = "score") -> Column:
    """No condition for a threshold of 0 or less."""
    return F.col(col) >= threshold if threshold > 0 else F.lit(True)


def can_roll_back(col: str = "status") -> Column:
    return F.col(col).isin(*ROLLBACK_STATUSES)


def root_or_child(parent: int | None) -> Column:
    return F.col("parent_id").isNull() if parent is None else F.col("parent_id") == parent


def logged_path(excluded: Iterable[str], col: str = "endpoint") -> Column:
    """The path holds none of the excluded parts."""
    return ~reduce(lambda a, b: a | b, [F.col(col).contains(x) for x in excluded], F.lit(False))


def text_fits(limit: Column, col: str = "text") -> Column:
    return (F.length(F.trim(F.col(col))) > 0) & (F.length(col) <= limit)


def unique_title_hash(meta: DataFrame, roles: Iterable[int], now: int) -> DataFrame:
    """(title, hash_sha256) of the visible, unexpired titles that a single row has."""
    seen = meta.where(has_role(roles) & unexpired(now))
    return seen.groupBy("title").agg(F.count("*").alias("n"), F.min("hash_sha256").alias("hash_sha256")).where("n = 1").select("title", "hash_sha256")


def exists_in(keys: DataFrame, table: DataFrame, key: str = "hash_sha256") -> DataFrame:
    """keys with found: whether the table has the key."""
    have = table.select(key).distinct().withColumn("found", F.lit(True))
    return keys.join(have, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
