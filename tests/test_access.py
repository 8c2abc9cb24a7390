"""Access rules on a small world of people and organizations."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docwarden import schemas as S
from docwarden.operators import access as A, audit, commands as K, outcomes as O

NOW = datetime(2026, 1, 15, 12)
AS_OF = "2026-01-15 12:00:00"
DAY = timedelta(days=1)
NTZ = lambda ddl: ddl.replace("TIMESTAMP", "TIMESTAMP_NTZ")

PEOPLE = [("pa1", True, None), ("pa2", True, None), ("a", False, None), ("b", False, None), ("c", False, None), ("d", False, NOW - DAY)]


def uid(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def world(spark, members=(), invitations=(), grants=(), orgs=(("o1", "active"), ("o2", "suspended"), ("o3", "closed"))):
    """``members``: (org, person, role[, revoked]); ``invitations``: (id, org, person, role, by, invited_at, closed column or None)."""
    users = [(p, f"sub-{p}", f"{p}@example.org", None, staff, off, NOW - 30 * DAY) for p, staff, off in PEOPLE]
    organizations = [(o, f"Org {o}", None, s, None, "pa1", NOW - 30 * DAY) for o, s in orgs]
    memberships = [
        (f"m{i}", m[0], m[1], m[2], "pa1", NOW - 20 * DAY, m[3] if len(m) > 3 else None, "pa1" if len(m) > 3 else None) for i, m in enumerate(members)
    ]
    invs = []
    for i, org, person, role, by, at, closed in invitations:
        ends = {c: (at + timedelta(hours=1) if closed == c else None) for c in ("accepted_at", "declined_at", "revoked_at")}
        invs.append((i, org, person, role, by, at, at + 14 * DAY, ends["accepted_at"], ends["declined_at"], ends["revoked_at"],
                     by if closed == "revoked_at" else None))
    given = [(g, org, who, "a", start, "help", start, end, revoked, "a" if revoked else None) for g, org, who, start, end, revoked in grants]
    return A.AccessState(
        spark.createDataFrame(users, NTZ(S.USERS)), spark.createDataFrame(organizations, NTZ(S.ORGANIZATIONS)),
        spark.createDataFrame(memberships, NTZ(S.ORG_MEMBERSHIPS)), spark.createDataFrame(given, NTZ(S.SUPPORT_ACCESS_GRANTS)),
        spark.createDataFrame(invs, NTZ(S.ORG_INVITATIONS)),
    )


def decisions(df):
    return {r.command_id: (r.refusal_reason if not r.accepted else None) for r in df.collect()}


def test_membership_needs_everything_active(spark):
    s = world(spark, [("o1", "a", "org_admin"), ("o1", "b", "contributor", NOW - DAY), ("o1", "d", "org_admin"), ("o1", "pa1", "org_admin"), ("o2", "c", "org_admin")])
    assert [(r.org_id, r.user_id) for r in A.active_memberships(s).collect()] == [("o1", "a")]
    assert {r.user_id: r.visible for r in A.visible_organization_counts(s).collect()} == {"pa1": 3, "pa2": 3, "a": 1, "b": 0, "c": 0}
    assert [r.org_id for r in A.list_organizations(s, "a", False).collect()] == ["o1"]
    assert [r.org_id for r in A.list_organizations(s, "pa1", True).collect()] == ["o1", "o2", "o3"]


def test_support_window_is_half_open(spark):
    s = world(spark, grants=[
        ("now", "o1", "pa1", NOW, NOW + DAY, None), ("over", "o1", "pa2", NOW - DAY, NOW, None), ("later", "o1", "pa2", NOW + DAY, NOW + 2 * DAY, None),
        ("revoked", "o1", "pa2", NOW - DAY, NOW + DAY, NOW - DAY), ("not staff", "o1", "a", NOW - DAY, NOW + DAY, None), ("org off", "o2", "pa2", NOW - DAY, NOW + DAY, None)])
    assert [(r.org_id, r.support_user_id) for r in A.active_support(s, AS_OF).collect()] == [("o1", "pa1")]


def test_organization_creation(spark):
    rows = [(1, "pa1", None, "X"), (2, "a", None, "X"), (3, None, None, "X"), (4, "a", "recovery", "X"), (5, "pa1", None, " ")]
    c = spark.createDataFrame([(*r, None, "suspended", "bill") for r in rows],
                              "command_id int, actor string, system_job string, legal_name string, display_name string, status string, billing_account_id string")
    done = K.create_organizations(c, world(spark), AS_OF)
    assert decisions(done) == {1: None, 2: "only a platform admin can create an organization", 3: K.NO_ACTOR, 4: None, 5: "legal name must not be blank"}
    got = {r.command_id: (r.new_status, r.new_billing_account_id, r.created_by) for r in done.collect()}
    assert got[1] == ("active", None, "pa1") and got[4] == ("suspended", "bill", "a")


def test_organization_updates(spark):
    s = world(spark, [("o1", "a", "org_admin"), ("o1", "b", "point_person")])

    def change(cid, actor, org="o1", job=None, **new):
        base = {"new_org_id": org, "new_created_by": "pa1", "new_legal_name": f"Org {org}", "new_display_name": None,
                "new_status": {"o1": "active", "o2": "suspended", "o3": "closed"}.get(org, "active"), "new_billing_account_id": None}
        return (cid, actor, job, org, *{**base, **new}.values())

    c = spark.createDataFrame([
        change(1, "a", new_display_name="New"), change(2, "b", new_display_name="New"), change(3, "pa1", new_status="suspended"), change(4, "a", new_status="suspended"),
        change(5, "pa1", org="o3", new_status="active"), change(6, "a", job="fix", org="o3", new_status="active"), change(7, "pa1", new_legal_name="Other"),
        change(8, "pa1", job="fix", new_legal_name="Other"), change(9, "a", new_billing_account_id="b"), change(10, "a", new_created_by="a"), change(11, "a", org="o9"), change(12, "b"),
    ], """command_id int, actor string, system_job string, org_id string, new_org_id string, new_created_by string, new_legal_name string, new_display_name string,
          new_status string, new_billing_account_id string""")
    assert decisions(K.update_organizations(c, s)) == {
        1: None, 2: "only an org admin can rename the organization", 3: None, 4: "only a platform admin can change an organization's status",
        5: "a closed organization cannot be reopened", 6: "a closed organization cannot be reopened", 7: "legal name changes need the privileged path", 8: None,
        9: "billing can only be changed by the privileged path", 10: "organization identity fields cannot change", 11: "no such organization", 12: None}


def test_membership_inserts(spark):
    s = world(spark, [("o1", "a", "org_admin"), ("o1", "b", "contributor")], [
        ("i1", "o1", "c", "contributor", "a", NOW - DAY, None), ("i2", "o1", "b", "contributor", "a", NOW - DAY, None),
        ("i3", "o1", "c", "budget_owner", "b", NOW - DAY, None), ("i4", "o1", "c", "point_person", "a", NOW - 15 * DAY, None)])
    c = spark.createDataFrame([
        (1, "c", None, "i1", "o1", "c", "contributor", None), (2, "c", None, None, "o1", "c", "contributor", None), (3, "c", None, "i1", "o1", "c", "org_admin", None),
        (4, "b", None, "i2", "o1", "b", "contributor", None), (5, "c", None, "i3", "o1", "c", "budget_owner", None), (6, "c", None, "i4", "o1", "c", "point_person", None),
        (7, "pa1", "boot", None, "o1", "c", "org_admin", None), (8, "c", "boot", None, "o1", "c", "org_admin", None), (9, "c", None, "i1", "o1", "c", "contributor", NOW),
        (10, None, "boot", None, "o1", "c", "org_admin", None)],
        "command_id int, actor string, system_job string, accepting_invitation string, org_id string, user_id string, role string, revoked_at timestamp_ntz")
    done = K.insert_memberships(c, s, AS_OF)
    direct = "memberships are created by accepting an invitation"
    assert decisions(done) == {
        1: None, 2: direct, 3: direct, 4: "that role is already held", 5: K.STALE_INVITATION, 6: direct, 7: None,
        8: "nobody grants themselves a membership", 9: "a new membership cannot start revoked", 10: K.NO_ACTOR}
    got = {r.command_id: (r.granted_by, r.closes_invitation) for r in done.collect()}
    assert got[1] == ("a", "i1") and got[7] == ("pa1", None)
    closed = K.close_accepted(s.invitations, done.where("accepted"), AS_OF)
    assert {r.invitation_id: r.accepted_at for r in closed.collect()} == {"i1": NOW, "i2": None, "i3": None, "i4": None}


def test_last_admin_stays(spark):
    s = world(spark, [("o1", "a", "org_admin"), ("o1", "d", "org_admin"), ("o1", "b", "contributor"), ("o1", "c", "contributor", NOW - DAY)])
    c = spark.createDataFrame([(1, "a", None, "o1", "m0"), (2, "a", "fix", "o1", "m0"), (3, "a", None, "o1", "m1"), (4, "b", None, "o1", "m2"), (5, "c", None, "o1", "m2"),
                               (6, "a", None, "o1", "m3"), (7, "a", None, "o2", "m0"), (8, "d", None, "o1", "m1")],
                              "command_id int, actor string, system_job string, org_id string, membership_id string")
    last, no = "an organization must keep at least one active admin", "not allowed to remove this membership"
    assert decisions(K.revoke_memberships(c, s)) == {
        1: last, 2: None, 3: None, 4: None, 5: no, 6: "membership already revoked; grant a new one instead", 7: "No such membership in this organization.", 8: no}
    two = world(spark, [("o1", "a", "org_admin"), ("o1", "b", "org_admin")])
    assert decisions(K.revoke_memberships(c.where("command_id = 1"), two)) == {1: None}


def test_support_grants(spark):
    s = world(spark, [("o1", "a", "org_admin"), ("o1", "b", "point_person"), ("o2", "a", "org_admin")], grants=[("g", "o1", "pa1", NOW - DAY, NOW + DAY, None), ("h", "o1", "pa1", NOW - DAY, NOW + DAY, NOW)])
    row = lambda cid, actor, org="o1", who="pa1", start=None, end=NOW + 14 * DAY, why="help": (cid, actor, org, who, why, start, end)
    c = spark.createDataFrame([
        row(1, "a"), row(2, "b"), row(3, "a", who="a"), row(4, "a", who="b"), row(5, "a", org="o2"), row(6, "a", end=NOW + 14 * DAY + timedelta(seconds=1)),
        row(7, "a", start=NOW - 5 * DAY), row(8, "a", end=NOW), row(9, "a", why=" ")],
        "command_id int, actor string, org_id string, support_user_id string, reason string, starts_at timestamp_ntz, expires_at timestamp_ntz")
    done = K.grant_support(c, s, AS_OF)
    short = "support access lasts at most 14 days"
    assert decisions(done) == {
        1: None, 2: "only an org admin can grant support access", 3: "you cannot grant support access to yourself",
        4: "support access can only go to an active platform admin", 5: K.ORG_INACTIVE, 6: short, 7: None, 8: short, 9: "a reason is required"}
    assert {r.command_id: r.starts_at_effective for r in done.collect()}[7] == NOW
    r = spark.createDataFrame([(1, "a", None, "o1", "g"), (2, "pa1", None, "o1", "g"), (3, "b", None, "o1", "g"), (4, "b", "fix", "o1", "g"), (5, "a", None, "o1", "h"), (6, "a", None, "o2", "g")],
                              "command_id int, actor string, system_job string, org_id string, grant_id string")
    assert decisions(K.revoke_support(r, s)) == {
        1: None, 2: None, 3: "not allowed to revoke this support grant", 4: None, 5: "support grant already revoked", 6: "No such support grant in this organization."}


def sent(n, by="a", org="o1", hours_ago=1.0, start=0):
    return [(f"i{start + k}", org, "c", "contributor", by, NOW - timedelta(hours=hours_ago), "declined_at") for k in range(n)]


@pytest.mark.parametrize("history,reason", [
    (sent(9), None),
    (sent(10), "you have sent too many invitations today"),
    (sent(10, hours_ago=24), None),
    (sent(10, hours_ago=23.99), "you have sent too many invitations today"),
    (sent(10, by="b") + sent(9, by="x", start=20), None),
    (sent(10, by="b") + sent(10, by="x", start=20), "too many invitations today for this organization"),
    (sent(29, by="x", org="o9"), None),
    (sent(30, by="x", org="o9"), "invitations are limited right now; try again later"),
])
def test_caps(spark, history, reason):
    s = world(spark, [("o1", "a", "org_admin")], history)
    c = spark.createDataFrame([(1, "a", "o1", "contributor")], "command_id int, actor string, org_id string, role string")
    assert decisions(K.invitation_gate(c, s, AS_OF)) == {1: reason}


def test_gate_asks_for_authority_first(spark):
    s = world(spark, [("o1", "a", "org_admin"), ("o1", "b", "point_person"), ("o1", "c", "contributor"), ("o1", "pa1", "org_admin")], sent(30))
    c = spark.createDataFrame([(1, "c", "o1", "contributor"), (2, "b", "o1", "org_admin"), (3, "a", "o1", "owner"), (4, "pa1", "o1", "contributor"), (5, "a", "nowhere", "contributor"), (6, "d", "o1", "contributor")],
                              "command_id int, actor string, org_id string, role string")
    no = K.MAY_NOT_INVITE
    assert decisions(K.invitation_gate(c, s, AS_OF)) == {1: no, 2: no, 3: "unknown role", 4: no, 5: no, 6: no}


def test_inviting(spark):
    s = world(spark, [("o1", "a", "org_admin")], [("open", "o1", "b", "contributor", "a", NOW - 2 * DAY, None), ("old", "o1", "c", "contributor", "a", NOW - 20 * DAY, None)])
    rows = [(1, " B@Example.org ", "contributor", None, None), (2, "c@example.org", "contributor", None, None), (3, "b@example.org", "point_person", None, None),
            (4, "new@example.org", "contributor", "N", uid(1).upper()), (5, "new2@example.org", "contributor", None, None), (6, "a@example.org", "contributor", None, None),
            (7, "not mail", "contributor", None, None), (8, "b@example.org", "contributor", "bell\x07", None), (9, "new3@example.org", "contributor", None, "nope")]
    c = spark.createDataFrame([(cid, "a", "o1", e, r, n, acc) for cid, e, r, n, acc in rows],
                              "command_id int, actor string, org_id string, email string, role string, display_name string, account_id string")
    done = {r.command_id: r for r in K.invite(c, s, AS_OF).collect()}
    assert {k: r.result for k, r in done.items() if r.accepted} == {1: "existing", 2: "renewed", 3: "created", 4: "created"}
    assert done[1].invitation_id == "open" and done[2].invitation_id == "old" and done[2].expires_at == NOW + 14 * DAY and done[4].new_user
    assert {k: r.refusal_reason for k, r in done.items() if not r.accepted} == {
        5: "account_needed", 6: "you cannot invite yourself", 7: "that is not a valid email address", 8: "that name is not acceptable", 9: "invalid account id"}


def test_answering_invitations(spark):
    s = world(spark, [("o1", "a", "org_admin"), ("o1", "b", "contributor")], [
        ("ok", "o1", "c", "contributor", "a", NOW - DAY, None), ("used", "o1", "c", "budget_owner", "a", NOW - DAY, "accepted_at"),
        ("expired", "o1", "c", "point_person", "a", NOW - 14 * DAY, None), ("stale", "o1", "c", "authorized_approver", "b", NOW - DAY, None), ("held", "o1", "b", "contributor", "a", NOW - DAY, None)])
    c = spark.createDataFrame([("ok", "c"), ("used", "c"), ("expired", "c"), ("stale", "c"), ("held", "b"), ("none", "c")], "invitation_id string, actor string")
    c = c.select(F.col("invitation_id").alias("command_id"), "invitation_id", "actor")
    other = c.where("command_id = 'ok'").withColumn("actor", F.lit("b"))
    assert {k for k, v in decisions(K.accept_invitations(c, s, AS_OF)).items() if v is None} == {"ok"}
    assert set(decisions(K.accept_invitations(c, s, AS_OF)).values()) == {None, K.GONE}
    assert decisions(K.accept_invitations(other, s, AS_OF)) == {"ok": K.GONE}
    assert {k for k, v in decisions(K.decline_invitations(c, s, AS_OF)).items() if v is None} == {"ok", "stale", "held"}
    by_admin, by_sender = c.withColumn("actor", F.lit("a")), c.withColumn("actor", F.lit("b"))
    assert {k for k, v in decisions(K.revoke_invitations(by_admin, s)).items() if v is None} == {"ok", "expired", "stale", "held"}
    assert {k for k, v in decisions(K.revoke_invitations(by_sender, s)).items() if v is None} == set()


def test_stale_flag_and_lists(spark):
    s = world(spark, [("o1", "a", "org_admin"), ("o1", "b", "point_person")], [
        ("i1", "o1", "c", "contributor", "b", NOW - DAY, None), ("i2", "o1", "c", "org_admin", "b", NOW - 2 * DAY, None), ("i3", "o2", "c", "contributor", "a", NOW - DAY, None)])
    assert [(r.invitation_id, r.stale) for r in A.list_open_invitations(s, AS_OF).orderBy("org_id", "rank").collect()] == [("i1", False), ("i2", True), ("i3", True)]
    assert [(r.invitation_id, r.invited_by_name) for r in A.list_my_invitations(s, AS_OF).orderBy("invited_user_id", "rank").collect()] == [("i1", "b@example.org"), ("i2", "b@example.org")]
    assert [(r.email, r.role) for r in A.list_members(s).orderBy("org_id", "rank").collect()] == [("a@example.org", "org_admin"), ("b@example.org", "point_person")]


def test_reading_needs_a_role(spark):
    s = world(spark, [("o1", "a", "org_admin"), ("o1", "b", "point_person"), ("o2", "a", "org_admin")])
    count = lambda who, roles: A.readable_by(A.list_members(s), s, who, roles).count()
    assert (count("a", A.ADMIN), count("b", A.ADMIN), count("b", A.INVITERS), count("c", A.INVITERS)) == (2, 0, 2, 0)


def test_first_wave(spark):
    c = spark.createDataFrame([(1, "k"), (2, "k"), (3, "j")], "seq int, key string")
    first, rest = K.first_wave(c, ["key"], "seq")
    assert sorted(r.seq for r in first.collect()) == [1, 3] and [r.seq for r in rest.collect()] == [2]


def test_audit(spark):
    s = world(spark, [("o1", "a", "org_admin")], grants=[("g", "o1", "pa1", NOW - DAY, NOW + DAY, None)])
    rows = [(1, "a", None, False, "document.view", "o1"), (2, "pa1", None, False, "document.view", "o1"), (3, "b", None, False, "document.view", "o1"),
            (4, "a", None, False, "org.create", None), (5, "a", None, False, "Document.View", None), (6, None, None, False, "x.y", None),
            (7, None, "job", True, "org.fix", "o1"), (8, None, " ", True, "x.y", None), (9, "pa1", None, True, "x.y", None), (10, "b", None, False, "x.y", None)]
    e = spark.createDataFrame(rows, "command_id int, actor string, system_job string, privileged boolean, action string, org_id string")
    done = K.check_audit_writes(e, s, AS_OF)
    assert {r.command_id: r.source for r in done.collect() if r.accepted} == {1: "api", 2: "api", 7: "system", 9: "operator", 10: "api"}
    assert {k: v for k, v in decisions(done).items() if v} == {
        3: "cannot write to that organization's audit trail", 4: "audit action is reserved for the database",
        5: 'audit action must look like "area.event" in lowercase', 6: K.NO_ACTOR, 8: "privileged change without an actor or app.system_job reason"}
    change = spark.createDataFrame([(NOW, "a", ("X", None, "active", None), ("X", "Y", "active", None))],
                                   "at timestamp_ntz, actor string, old struct<legal_name: string, display_name: string, status: string, billing_account_id: string>,"
                                   " new struct<legal_name: string, display_name: string, status: string, billing_account_id: string>")
    (ev,) = audit.update_events(change.withColumn("new", F.col("new").withField("org_id", F.lit("o1"))), "org.update", "organization", "org_id",
                                audit.ORG_AUDITED, F.col("new.org_id")).collect()
    assert ev.detail == {"changed": '{"display_name":[null,"Y"]}', "source": "database"}


def test_operator_commands(spark):
    s = world(spark, [(uid(7), "a", "org_admin")], orgs=[(uid(7), "active"), (uid(8), "closed")])
    users = spark.createDataFrame([
        (1, uid(1), "New@Example.org", None, False, None, "why"), (2, uid(2), "boss@example.org", None, True, None, "why"), (3, uid(2), "boss@example.org", None, True, "pa1@example.org", "why"),
        (4, uid(3), "a@example.org", None, False, None, "why"), (5, "x", "n@example.org", None, False, None, "why"), (6, uid(4), "n@example.org", "a‮b", False, None, "why"), (7, uid(5), "m@example.org", None, False, None, " ")],
        "command_id int, cognito_sub string, email string, display_name string, platform_admin boolean, operator_email string, reason string")
    got = {r.command_id: (r.result, r.refusal_code) for r in K.create_users(users, s).collect()}
    assert got == {1: ("created", None), 2: (None, K.PRIVILEGE), 3: ("created", None), 4: (None, K.UNIQUE), 5: (None, K.INPUT), 6: (None, K.INPUT), 7: (None, K.INPUT)}
    seats = spark.createDataFrame([(1, uid(7), "b@example.org"), (2, uid(7), "a@example.org"), (3, uid(8), "b@example.org"), (4, uid(7), "d@example.org"), (5, uid(7), "pa2@example.org"), (6, uid(9), "b@example.org"), (7, "o", "b@example.org")],
                                  "command_id int, org_id string, user_email string").withColumns({"operator_email": F.lit("pa1@example.org"), "reason": F.lit("why")})
    got = {r.command_id: (r.result, r.refusal_code) for r in K.seat_org_admins(seats, s).collect()}
    assert got == {1: ("created", None), 2: ("exists", None), 3: (None, K.CHECK), 4: (None, K.CHECK), 5: (None, K.PRIVILEGE), 6: (None, K.NOT_FOUND), 7: (None, K.INPUT)}
    orgs = spark.createDataFrame([(1, f" org {uid(7)} "), (2, "Fresh")], "command_id int, legal_name string").withColumns({"operator_email": F.lit("pa1@example.org"), "reason": F.lit("why")})
    assert {r.command_id: r.result for r in K.create_organizations_as_operator(orgs, s).collect()} == {1: "exists", 2: "created"}


def test_statuses(spark):
    codes = [None, *O.REFUSAL_STATUS, "other"]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    got = {r.code: r.s for r in df.select("code", O.refusal_status(F.col("code")).alias("s")).collect()}
    assert got == {None: 204, **O.REFUSAL_STATUS, "other": 500}


def test_last_admins_are_those_without_others(spark):
    users = spark.createDataFrame([("u1", False), ("u2", False), ("u3", True)], "user_id string, off boolean").selectExpr(
        "user_id", "if(off, timestamp_ntz'2020-01-01 00:00:00', null) as disabled_at")
    rows = [("m1", "one", "u1"), ("m2", "one", "u3"), ("m3", "none", "u3"), ("m4", "two", "u1"), ("m5", "two", "u2"), ("m6", "lone", "u2")]
    members = spark.createDataFrame(rows, "membership_id string, org_id string, user_id string").selectExpr("*", "'org_admin' as role", "cast(null as timestamp_ntz) as revoked_at")
    state = A.AccessState(users, None, members)
    last = members.join(A.last_admins(state), "org_id").where("_admins = 0 or _only_admin = membership_id")
    alone = A.other_admin_counts(state).where("other_admins = 0")
    assert {r.membership_id for r in last.collect()} == {r.membership_id for r in alone.collect()} == {"m1", "m3", "m6"}
