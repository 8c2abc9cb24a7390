"""Table constraints as data-quality checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from docwarden import schemas as S
from docwarden.functions.temporal import days
from docwarden.functions.validation import ROLES

SCHEMAS = {
    "users": S.USERS, "organizations": S.ORGANIZATIONS, "org_memberships": S.ORG_MEMBERSHIPS, "support_access_grants": S.SUPPORT_ACCESS_GRANTS,
    "org_invitations": S.ORG_INVITATIONS, "audit_log": S.AUDIT_LOG, "document_uploads": S.DOCUMENT_UPLOADS,
}

UPLOAD_STATUSES = ("processing", "completed", "failed")  # fixed values
ORG_STATUSES = ("active", "suspended", "closed")  # fixed values


def _col(name: str) -> Column:
    return F.col(name)


def _both_or_neither(a: str, b: str) -> Column:
    return _col(a).isNull() == _col(b).isNull()


def checks(table: str) -> dict[str, Column]:
    """Named row constraints of a table. NULL counts as satisfied, as in SQL."""
    if table == "document_uploads":
        return {"status_known": _col("status").isin(*UPLOAD_STATUSES)}
    if table == "users":
        return {
            "email_normalized": _col("email") == F.lower(F.btrim("email")),
            "email_not_empty": _col("email") != "",
        }
    if table == "organizations":
        return {
            "legal_name_not_blank": F.btrim("legal_name") != "",
            "status_known": _col("status").isin(*ORG_STATUSES),
        }
    if table == "org_memberships":
        return {
            "role_known": _col("role").isin(*ROLES),
            "not_self_granted": _col("granted_by") != _col("user_id"),
            "revocation_complete": _both_or_neither("revoked_at", "revoked_by"),
            "revoked_after_granted": _col("revoked_at") >= _col("granted_at"),
        }
    if table == "support_access_grants":
        return {
            "reason_not_blank": F.btrim("reason") != "",
            "not_self_consented": _col("consented_by") != _col("support_user_id"),
            "length_in_range": (_col("expires_at") > _col("starts_at")) & (_col("expires_at") <= _col("starts_at") + days(14)),
            "revocation_complete": _both_or_neither("revoked_at", "revoked_by"),
        }
    if table == "org_invitations":
        closed = sum((_col(c).isNotNull().cast("int") for c in ("accepted_at", "declined_at", "revoked_at")), F.lit(0))
        return {
            "role_known": _col("role").isin(*ROLES),
            "not_self_invited": _col("invited_by") != _col("invited_user_id"),
            "length_in_range": (_col("expires_at") > _col("invited_at")) & (_col("expires_at") <= _col("invited_at") + days(14)),
            "one_terminal_state": closed <= 1,
            "revocation_complete": _both_or_neither("revoked_at", "revoked_by"),
        }
    if table == "audit_log":
        return {"actor_or_job": _col("actor_user_id").isNotNull() | F.map_contains_key("detail", "system_job")}
    raise ValueError(f"no constraints known for {table!r}")


def violations(df: DataFrame, table: str) -> DataFrame:
    """``table_name, constraint_name, violations`` in one pass over the table."""
    rules = checks(table)
    counted = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    long = counted.unpivot([], list(rules), "constraint_name", "violations")
    return long.select(F.lit(table).alias("table_name"), "constraint_name", "violations")


def violating_rows(df: DataFrame, table: str) -> DataFrame:
    """Rows that break something, with the names of what they break."""
    broken = F.array_compact(F.array(*[F.when(~rule, name) for name, rule in checks(table).items()]))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def duplicate_keys(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys that occur more than once (among the rows of a partial unique index). Counting needs
    no window, so a key with very many copies is no burden."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose reference finds no parent."""
    known = parent.select(F.col(key).alias(column))
    return child.where(F.col(column).isNotNull()).join(known, column, "left_anti")


# What references point to, by table and column.
REFERENCES = {
    "organizations": {"created_by": "users"},
    "org_memberships": {"org_id": "organizations", "user_id": "users", "granted_by": "users", "revoked_by": "users"},
    "support_access_grants": {"org_id": "organizations", "support_user_id": "users", "consented_by": "users", "revoked_by": "users"},
    "org_invitations": {"org_id": "organizations", "invited_user_id": "users", "invited_by": "users", "revoked_by": "users"},
    "audit_log": {"actor_user_id": "users", "org_id": "organizations"},
}
KEYS = {"users": "user_id", "organizations": "org_id"}


def required_columns(table: str) -> list[str]:
    """Columns that may not be NULL, in the order of the table's schema."""
    return re.findall(r"(\w+) [A-Z]+(?:<[A-Z, ]+>)? NOT NULL", SCHEMAS[table])


def integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, constraint_name, violations`` of every reference and every NOT NULL column, zero
    included. A column that a frame does not have is not checked.

    Each table is read once: a row becomes one tagged value per reference, per key it offers and per missing
    value. One aggregation by (parent, value) then knows all keys that exist beside all references to them,
    so there is one exchange whatever the number of constraints. Values are counted before they are
    exchanged, so a key with very many references is one row per task. A row of counts is as wide as the
    references to one parent: each has a slot there, and missing values count in the first slot of a parent
    of their own."""
    tag = "struct<parent: int, value: string, slot: int>"
    parents, slots = list(tables), dict.fromkeys(tables, 0)
    rows, found = None, []
    for table, df in tables.items():
        tags = []
        if KEYS.get(table) in df.columns:
            tags.append(_tag(df, KEYS[table], parents.index(table), _IS_KEY))
        for column, parent in REFERENCES.get(table, {}).items():
            if column in df.columns and parent in tables:
                place, slot = parents.index(parent), slots[parent]
                slots[parent] += 1
                found.append((table, f"{column}_references_{parent}", F.col("parent") == place, slot))
                tags.append(_tag(df, column, place, slot))
        for column in required_columns(table):
            if column in df.columns:
                label = f"{table} {column}"
                found.append((table, f"{column}_not_null", (F.col("parent") == _MISSING) & (F.col("value") == label), 0))
                missing = F.struct(F.lit(_MISSING).alias("parent"), F.lit(label).alias("value"), F.lit(0).alias("slot"))
                tags.append(F.when(df[column].isNull(), missing))
        part = df.select(F.explode(F.array_compact(F.array(*[t.cast(tag) for t in tags]))).alias("t")).select("t.*")
        rows = part if rows is None else rows.unionByName(part)
    counts = [F.count_if(F.col("slot") == slot).alias(f"c{slot}") for slot in range(max(1, *slots.values()))]
    by_value = rows.groupBy("parent", "value").agg(F.bool_or(F.col("slot") == _IS_KEY).alias("_known"), *counts)
    lost = by_value.where(~F.col("_known")).agg(*[
        F.coalesce(F.sum(F.when(of, F.col(f"c{slot}"))), F.lit(0)).alias(str(n)) for n, (_, _, of, slot) in enumerate(found)
    ])
    listed = F.array(*[
        F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("constraint_name"), F.col(str(n)).cast("long").alias("violations"))
        for n, (t, c, _, _) in enumerate(found)
    ])
    return lost.select(F.explode(listed).alias("r")).select("r.*")


# In place of a slot: the value is a key of the parent. In place of a parent: the value names a column.
_IS_KEY = _MISSING = -1


def _tag(df: DataFrame, column: str, parent: int, slot: int) -> Column:
    value = F.struct(F.lit(parent).alias("parent"), df[column].cast("string").alias("value"), F.lit(slot).alias("slot"))
    return F.when(df[column].isNotNull(), value)
