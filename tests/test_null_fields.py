"""NULLs in fields that must be given are refused; ids are compared in their normal form; questions may be absent."""

from datetime import timedelta

from pyspark.sql import functions as F

from docwarden.operators import commands as K, retrieval as R
from test_access import AS_OF, DAY, NOW, decisions, uid, world


def test_null_fields_are_refused(spark):
    s = world(spark, [("o1", "a", "org_admin")])
    new = spark.createDataFrame(
        [(1, "pa1", None, None, None, None, None), (2, "pa1", None, "Name", None, None, None)],
        "command_id int, actor string, system_job string, legal_name string, display_name string, status string, billing_account_id string")
    assert decisions(K.create_organizations(new, s, AS_OF)) == {1: "legal name must not be blank", 2: None}
    grants = spark.createDataFrame(
        [(1, "a", "o1", "pa1", None, NOW, NOW + DAY), (2, "a", "o1", "pa1", "help", NOW, None), (3, "a", "o1", "pa1", "help", NOW, NOW + timedelta(days=14))],
        "command_id int, actor string, org_id string, support_user_id string, reason string, starts_at timestamp_ntz, expires_at timestamp_ntz")
    assert decisions(K.grant_support(grants, s, AS_OF)) == {1: "a reason is required", 2: "support access lasts at most 14 days", 3: None}


def test_organization_ids_are_normalized(spark):
    org = uid(255).replace("000000000255", "0000000000af")
    s = world(spark, orgs=((org, "active"),))
    seats = spark.createDataFrame(
        [(1, f" {org.upper()} ", "a@example.org", "pa1@example.org", "first admin of the tenant"), (2, None, "a@example.org", "pa1@example.org", "first admin of the tenant")],
        "command_id int, org_id string, user_email string, operator_email string, reason string")
    assert {r.command_id: r.accepted for r in K.seat_org_admins(seats, s).collect()} == {1: True, 2: False}


def test_absent_questions(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], 3), (2, [0.0, 1.0], 4)], "chunk_id long, embedding array<float>, est_tokens long")
    none = spark.createDataFrame([], "query_id long, embedding array<float>")
    assert R.top_k(none, corpus, 2).count() == 0 and R.retrieve(none, corpus).count() == 0
    one = spark.createDataFrame([(7, None), (8, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert sorted((r.query_id, r.chunk_id) for r in R.retrieve(one, corpus).collect()) == [(7, None), (8, 1)]
