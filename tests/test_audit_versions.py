"""Audit events from row versions, and from one reading of each table."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docwarden.operators import audit
from docwarden.plans import access, registry  # noqa: F401
from docwarden.sources.derived import derive

SF = "/root/testdata/sf0.001"


def test_previous_versions_equal_a_sorted_walk(spark):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = []
    for n in range(600):  # a third belongs to one key; times repeat, hours and days are skipped
        key = "hot" if n % 3 == 0 else rng.choice([*"abcdefgh", None])
        rows.append((key, start + timedelta(minutes=15 * rng.randrange(400)), n, rng.choice(["x", "y", None])))
    df = spark.createDataFrame(rows, "key string, at timestamp_ntz, version int, v string")
    got = {r.version: r.old and r.old.v for r in audit.with_previous(df, "key", ("v",)).collect()}
    firsts = {r.version for r in audit.with_previous(df, "key", ("v",)).where("old is null").collect()}
    want, seen, first = {}, {}, set()
    for key, _, version, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[version] = seen.get(key)
        if key not in seen:
            first.add(version)
        seen[key] = v
    assert got == want and firsts == first and len(first) == len({r[0] for r in rows})


def test_no_versions(spark):
    none = spark.createDataFrame([], "key string, at timestamp_ntz, version int, v string")
    assert audit.with_previous(none, "key", ("v",)).isEmpty()


def test_details_are_cleaned_and_stamped(spark):
    df = spark.createDataFrame([(1, None, False), (2, "nightly", False), (3, None, True)], "id int, job string, operator boolean")
    claimed = F.create_map(F.lit("source"), F.lit("me"), F.lit("system_job"), F.lit("mine"), F.lit("kept"), F.lit("1"))
    got = {r.id: r.d for r in df.select("id", audit.stamped(claimed, F.col("job"), F.col("operator")).alias("d")).collect()}
    assert got == {1: {"kept": "1", "source": "database"}, 2: {"kept": "1", "source": "system", "system_job": "nightly"},
                   3: {"kept": "1", "source": "operator"}}


def test_user_versions(spark):
    at = datetime(2024, 1, 1)
    rows = [("u", at, 0, "s", "a@x", None, False, None, "p", "import", True),
            ("u", at, 1, "s", "b@x", "B", False, None, "p", " ", True)]
    df = spark.createDataFrame(rows, "user_id string, at timestamp_ntz, version int, cognito_sub string, email string, display_name string,"
                                     " is_platform_admin boolean, disabled_at timestamp_ntz, actor string, system_job string, privileged boolean")
    pairs = audit.with_previous(df, "user_id", audit.USER_AUDITED)
    events = audit.version_events(pairs, "user", "user", "user_id", audit.USER_AUDITED, ("email", "is_platform_admin"), F.lit(None).cast("string"))
    got = {r.action: r.detail for r in events.collect()}
    assert got == {
        "user.create": {"email": "a@x", "is_platform_admin": "false", "source": "system", "system_job": "import"},
        "user.update": {"changed": '{"email":["a@x","b@x"],"display_name":[null,"B"]}', "source": "operator"}}


def test_every_outcome_occurs(spark):
    organizations = registry.QUERIES["p14_a4_organization_versions"](spark, SF).collect()
    assert {r.source for r in organizations} == {"database", "operator", "system"}
    assert {r.action for r in organizations} == {"org.create", "org.update"}
    changes = " ".join(r.changed or "" for r in organizations)
    assert all(f'"{c}"' in changes for c in ("legal_name", "display_name", "status")) and "null" in changes
    invitations = registry.QUERIES["p14_invitation_versions"](spark, SF).collect()
    assert {r.action for r in invitations} == {f"invitation.{a}" for a in ("create", "accept", "decline", "revoke")}
    assert {r.renewed for r in invitations} == {None, "true"} and {r.by_sender for r in invitations} == {None, "true", "false"}


def test_one_scan_per_table(spark):
    events = audit.invitation_events(derive(spark, SF, "invitations"))
    assert events._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
