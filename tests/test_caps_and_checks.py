"""Rolling counts, constraints and the migration ledger."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docwarden.operators import caps, constraints, migrations as M


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_rolling_counts_match_brute_force(spark, kind):
    rng = random.Random(2)
    t0 = datetime(2024, 2, 28)
    day = timedelta(hours=24)
    rows = []
    for n in range(900):
        key = "hot" if n % 3 else f"k{rng.randint(0, 5)}"
        t = t0 + timedelta(seconds=rng.randint(0, 4 * 86400)) + timedelta(microseconds=rng.choice([0, 0, 1, 999999]))
        rows.append((key, t))
        if rng.random() < 0.3:
            rows.append((key, t + rng.choice([day, -day, timedelta(0), day + timedelta(microseconds=1)])))
    df = spark.createDataFrame(rows, f"k string, t {kind}")
    counts = Counter(rows)
    times = {}
    for k, t in counts:
        times.setdefault(k, []).append(t)
    want = {(k, t): (n, sum(counts[k, u] for u in times[k] if t - day < u < t)) for (k, t), n in counts.items()}
    got = {(r.k, r.t): (r.at_time, r.before) for r in caps.rolling_counts(df, "k", "t").collect()}
    assert got == want
    over = {(r.k, r.t): r.over for r in caps.cap_breaches(df, "k", "t", 40).collect()}
    assert over == {key: min(n, n + b - 40) for key, (n, b) in want.items() if n + b > 40}


def test_constraints_count_and_name_what_is_broken(spark):
    t = datetime(2024, 1, 1)
    rows = [("1", "o", "u", "contributor", "g", t, None, None), ("2", "o", "u", "boss", "u", t, t - timedelta(days=1), None), ("3", "o", "u", "contributor", "g", t, None, None)]
    df = spark.createDataFrame(rows, "membership_id string, org_id string, user_id string, role string, granted_by string, granted_at timestamp, revoked_at timestamp, revoked_by string")
    got = {r.constraint_name: r.violations for r in constraints.violations(df, "org_memberships").collect()}
    assert got == {"role_known": 1, "not_self_granted": 1, "revocation_complete": 1, "revoked_after_granted": 1}
    (bad,) = constraints.violating_rows(df, "org_memberships").collect()
    assert bad.membership_id == "2" and set(bad.broken) == set(got)
    (dup,) = constraints.duplicate_keys(df, ["org_id", "user_id", "role"], F.col("revoked_at").isNull()).collect()
    assert (dup.role, dup.copies) == ("contributor", 2)
    log = spark.createDataFrame([("a", {}), (None, {"system_job": "x"}), (None, {})], "actor_user_id string, detail map<string,string>")
    assert constraints.violations(log, "audit_log").first().violations == 1
    with pytest.raises(ValueError):
        constraints.checks("nothing")


def test_migration_ledger(spark):
    files = spark.createDataFrame([("0001_a", "x\r\ny"), ("0002_b", "z"), ("0003_c", "w")], "version string, sql_text string")
    sums = {r.version: r.c for r in files.select("version", M.checksum(F.col("sql_text")).alias("c")).collect()}
    lf = spark.createDataFrame([("x\ny",)], "t string").select(M.checksum(F.col("t"))).first()[0]
    assert sums["0001_a"] == lf
    applied = spark.createDataFrame([("0001_a", lf), ("0002_b", "other"), ("0009_z", "q")], "version string, checksum string")
    assert {r.version: r.status for r in M.migration_status(files, applied).collect()} == {
        "0001_a": "applied", "0002_b": "edited", "0003_c": "pending", "0009_z": "unknown"}
    assert [r.version for r in M.pending(files, applied).collect()] == ["0003_c"]
    assert not M.is_current(files, applied)
    assert M.is_current(files, files.select("version", M.checksum(F.col("sql_text")).alias("checksum")))
    names = spark.createDataFrame([("0001_a",), ("0001_b",), ("12_c",), ("00x1_d",)], "version string")
    assert {r.version: r.problem for r in M.file_problems(names).collect()} == {
        "0001_b": "duplicate migration number", "12_c": "must start with a 4-digit number", "00x1_d": "must start with a 4-digit number"}


def test_all_references_in_one_exchange(spark):
    users = spark.createDataFrame([("u1", "s", "u1@x"), ("u2", None, "u2@x"), (None, "t", None)], "user_id string, cognito_sub string, email string")
    orgs = spark.createDataFrame([("o1", "u1"), ("o2", "gone"), ("o3", None)], "org_id string, created_by string")
    members = spark.createDataFrame(
        [("m1", "o1", "u1", "gone", None), ("m2", "o9", "u1", "u2", "gone"), ("m3", None, "u8", "gone", "u1")] + [(f"h{k}", "o1", "u1", "u2", None) for k in range(50)],
        "membership_id string, org_id string, user_id string, granted_by string, revoked_by string")
    found = constraints.integrity({"users": users, "organizations": orgs, "org_memberships": members})
    assert found._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(") == 1
    got = {(r.table_name, r.constraint_name): r.violations for r in found.collect()}
    assert {k: v for k, v in got.items() if v} == {
        ("users", "user_id_not_null"): 1, ("users", "cognito_sub_not_null"): 1, ("users", "email_not_null"): 1,
        ("organizations", "created_by_references_users"): 1, ("organizations", "created_by_not_null"): 1,
        ("org_memberships", "org_id_references_organizations"): 1, ("org_memberships", "org_id_not_null"): 1, ("org_memberships", "user_id_references_users"): 1,
        ("org_memberships", "granted_by_references_users"): 2, ("org_memberships", "revoked_by_references_users"): 1,
    }
    assert len(got) == 3 + 2 + 1 + 4 + 4
    empty = constraints.integrity({"users": users.limit(0), "organizations": orgs.limit(0)})
    assert {r.violations for r in empty.collect()} == {0}


def test_rows_of_reference_counts_are_as_wide_as_one_parent_needs(spark):
    users = spark.createDataFrame([("x1", "s", "e"), ("x2", "s", "e")], "user_id string, cognito_sub string, email string")
    orgs = spark.createDataFrame([("x1", "x1"), ("x3", "x8")], "org_id string, created_by string")
    members = spark.createDataFrame(
        [("m1", "x1", "x2", "x3", "x8"), ("m2", "x2", "x8", "x8", None), ("m3", "x3", "x1", "x2", "x2")],
        "membership_id string, org_id string, user_id string, granted_by string, revoked_by string")
    log = spark.createDataFrame([("x8", "x8"), ("x1", "x2"), (None, "x3")], "actor_user_id string, org_id string")
    found = constraints.integrity({"users": users, "organizations": orgs, "org_memberships": members, "audit_log": log})
    assert {(r.table_name, r.constraint_name): r.violations for r in found.collect() if r.violations} == {
        ("organizations", "created_by_references_users"): 1, ("org_memberships", "org_id_references_organizations"): 1,
        ("org_memberships", "user_id_references_users"): 1, ("org_memberships", "granted_by_references_users"): 2,
        ("org_memberships", "revoked_by_references_users"): 1, ("audit_log", "actor_user_id_references_users"): 1,
        ("audit_log", "org_id_references_organizations"): 2,
    }
    node, widths = found._jdf.queryExecution().sparkPlan(), []
    while node.children().size() == 1:
        if node.nodeName() == "HashAggregate":
            widths.append(node.output().size())
        node = node.children().apply(0)
    assert widths[-1] <= 2 + 1 + 5  # parent and value, whether it is a key, the references to users


def test_every_constraint_is_broken_somewhere_in_the_registered_query(spark):
    from docwarden.plans import access, registry  # noqa: F401

    rows = registry.QUERIES["f12_all_references"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 49 and all(r.violations > 0 for r in rows)
