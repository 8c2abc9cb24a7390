"""A batch of invitations in its order, beside a model that goes through it one by one."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from docwarden import schemas as S
from docwarden.operators import admission, caps
from docwarden.operators.access import AccessState
from docwarden.plans import access, registry  # noqa: F401  (access registers its queries)

NOW = datetime(2026, 1, 15, 12)
DAY = timedelta(days=1)
NTZ = lambda ddl: ddl.replace("TIMESTAMP", "TIMESTAMP_NTZ")
ROLES = ("org_admin", "point_person", "contributor")
COMMANDS = "seq string, command_id string, actor string, org_id string, email string, role string, display_name string, account_id string"


def account(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def random_world(draw):
    """Two organizations; people 0 to 5, of whom 4 is staff and 5 disabled; memberships and invitations."""
    users = [(f"u{i}", account(i), f"u{i}@x.org", None, i == 4, NOW - DAY if i == 5 else None, NOW - 30 * DAY) for i in range(6)]
    orgs = [(f"o{i}", f"Org {i}", None, "active" if i < 2 else "suspended", None, "u4", NOW - 30 * DAY) for i in range(3)]
    members = [(f"m{k}", f"o{k % 3}", f"u{draw.randrange(6)}", draw.choice(ROLES), "u4", NOW - 20 * DAY, None, None) for k in range(10)]
    members += [(f"a{k}", f"o{k}", f"u{k}", "org_admin", "u4", NOW - 20 * DAY, None, None) for k in range(2)]
    invitations, keys = [], set()
    for k in range(draw.randrange(10)):
        org, who, role, by = f"o{draw.randrange(2)}", draw.randrange(6), draw.choice(ROLES), draw.randrange(6)
        sent = NOW - draw.choice([timedelta(hours=2), timedelta(hours=23), DAY, 3 * DAY])
        ends = sent + draw.choice([timedelta(hours=1), 2 * DAY, 14 * DAY])
        closed = sent if draw.random() < 0.4 else None
        if by == who or (not closed and (org, who, role) in keys):
            continue
        if not closed:
            keys.add((org, who, role))
        invitations.append((f"i{k}", org, f"u{who}", role, f"u{by}", sent, ends, None, closed, None, None))
    return users, orgs, members, invitations


def random_commands(draw, n):
    def one(k):
        email = draw.choice([f"U{draw.randrange(6)}@x.org ", f"new{draw.randrange(3)}@x.org", "bad", None])
        given = draw.choice([account(draw.randrange(4)), account(100 + draw.randrange(3)).upper(), "zz", " ", None])
        return (
            f"{draw.randrange(n):03d}" if draw.random() < 0.95 else None, f"c{k}", draw.choice([f"u{draw.randrange(6)}", f"u{draw.randrange(2)}", None]),
            f"o{draw.randrange(2)}" if draw.random() < 0.9 else draw.choice(["o2", "o9", None]), email, draw.choice([*ROLES, *ROLES, "owner", None]),
            draw.choice([None, "Name", "x\x07"]) if draw.random() < 0.2 else "Name", given,
        )
    return [one(k) for k in range(n)]


def one_by_one(world, commands, limits):
    """The rules as a person would apply them, on plain lists."""
    users, orgs, members, invitations = world
    people = {u[0]: {"sub": u[1], "email": u[2], "staff": u[4], "off": u[5] is not None} for u in users}
    status = {o[0]: o[3] for o in orgs}
    rows = [dict(zip(("id", "org", "who", "role", "by", "at", "ends"), i[:7]), closed=i[8] is not None) for i in invitations]
    out = {}
    for seq, cid, actor, org, email, role, name, given in sorted(commands, key=lambda c: (c[0] is not None, c[0] or "", c[1])):
        mail, acct = (email or "").strip().lower(), None if given is None else given.lower()
        holds = {m[3] for m in members if m[1] == org and m[2] == actor} if status.get(org) == "active" else set()
        recent = [r for r in rows if r["at"] > NOW - DAY]
        me = people.get(actor)
        target = next((u for u, p in people.items() if p["email"] == mail), None)
        if actor is None:
            refusal = "insufficient_privilege"
        elif me is None or me["off"] or me["staff"]:
            refusal = "insufficient_privilege"
        elif role not in ROLES:
            refusal = "invalid_parameter_value"
        elif not holds & ({"org_admin"} if role == "org_admin" else {"org_admin", "point_person"}):
            refusal = "insufficient_privilege"
        elif sum(r["org"] == org for r in recent) >= limits[0] or sum(r["by"] == actor for r in recent) >= limits[1] or len(recent) >= limits[2]:
            refusal = "invitation_cap"
        elif "@" not in mail or (name and "\x07" in name):
            refusal = "invalid_parameter_value"
        elif mail == me["email"]:
            refusal = "insufficient_privilege"
        elif target is None and not (given or "").strip():
            refusal = "account_needed"
        elif target is None and acct == "zz":
            refusal = "invalid_parameter_value"
        elif target is None and any(p["sub"] == acct for p in people.values()):
            refusal = "check_violation"
        else:
            refusal = None
        if refusal:
            out[cid] = (refusal, None, None)
            continue
        fresh = target is None
        if fresh:
            target = f"new-{acct}"
            people[target] = {"sub": acct, "email": mail, "staff": False, "off": False}
        found = next((r for r in rows if (r["org"], r["who"], r["role"]) == (org, target, role) and not r["closed"]), None)
        if found is None:
            rows.append({"id": cid, "org": org, "who": target, "role": role, "by": actor, "at": NOW, "ends": NOW + 14 * DAY, "closed": False})
            result = "created"
        elif found["ends"] > NOW:
            result = "existing"
        else:
            found.update(by=actor, at=NOW, ends=NOW + 14 * DAY)
            result = "renewed"
        out[cid] = (None, result, fresh)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_batches_equal_one_by_one(spark, monkeypatch, seed):
    draw = random.Random(seed)
    limits = draw.choice([(4, 3, 6), (20, 10, 30), (3, 5, 8), (5, 2, 100)])
    for name, value in zip(("ORG_CAP", "SENDER_CAP", "GLOBAL_CAP"), limits):
        monkeypatch.setattr(caps, name, value)
    monkeypatch.setattr(admission, "WAVE", draw.choice([2, 5, 64]))
    users, orgs, members, invitations = world = random_world(draw)
    commands = random_commands(draw, 120)
    state = AccessState(
        spark.createDataFrame(users, NTZ(S.USERS)), spark.createDataFrame(orgs, NTZ(S.ORGANIZATIONS)), spark.createDataFrame(members, NTZ(S.ORG_MEMBERSHIPS)),
        None, spark.createDataFrame(invitations, NTZ(S.ORG_INVITATIONS)))
    done = admission.admit(spark.createDataFrame(commands, COMMANDS), state, NOW).collect()
    got = {r.command_id: (r.refusal_code, r.result, r.new_user) for r in done}
    assert len(done) == 120 and got == one_by_one(world, commands, limits)
    assert {r.accepted for r in done} == {True, False}


@pytest.mark.parametrize("seed, block, blocks", [(0, 5, 3), (1, 40, 4), (4, 16, 0)])
def test_blocks_of_the_batch_do_not_show(spark, monkeypatch, seed, block, blocks):
    monkeypatch.setattr(admission, "BLOCK", block)
    monkeypatch.setattr(admission, "BLOCKS", blocks)
    test_batches_equal_one_by_one(spark, monkeypatch, seed)


def test_persons_are_looked_up_for_commands_before_the_full_cap_only(spark, monkeypatch):
    looked_up = []
    facts = admission._facts

    def counted(fit, *args):
        looked_up.append(fit.count())
        return facts(fit, *args)

    monkeypatch.setattr(admission, "_facts", counted)
    monkeypatch.setattr(admission, "BLOCK", 512)
    done = registry.QUERIES["p9_u7_invite_batch"](spark, "/root/testdata/sf0.001")
    refused_by_rights = done.where("refusal_code = 'insufficient_privilege' or refusal_reason = 'unknown role'").count()
    assert max(looked_up) <= 512 < done.count() - refused_by_rights


def test_an_empty_batch(spark):
    users, orgs, members, invitations = random_world(random.Random(1))
    state = AccessState(
        spark.createDataFrame(users, NTZ(S.USERS)), spark.createDataFrame(orgs, NTZ(S.ORGANIZATIONS)), spark.createDataFrame(members, NTZ(S.ORG_MEMBERSHIPS)),
        None, spark.createDataFrame([], NTZ(S.ORG_INVITATIONS)))
    assert admission.admit(spark.createDataFrame([], COMMANDS), state, NOW).count() == 0


def test_the_registered_batch_meets_every_outcome(spark):
    rows = registry.QUERIES["p9_u7_invite_batch"](spark, "/root/testdata/sf0.001").groupBy("refusal_reason", "result", "new_user").count().collect()
    assert {r.result for r in rows if r.result} == {"created", "renewed", "existing"}
    assert sum(r["count"] for r in rows if r.result in ("created", "renewed")) == caps.GLOBAL_CAP
    reasons = Counter(r.refusal_reason for r in rows if r.refusal_reason)
    assert len(reasons) == 12 and all(text in reasons for _, text in caps.REFUSALS.values())


def exchanged(done):
    """Rows that the exchanges of a result wrote when it was collected."""
    def of(node):
        name = node.getClass().getSimpleName()
        inner = node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan() if name.endswith("QueryStageExec") else None
        if inner is not None:
            return of(inner)
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(of(node.children().apply(i)) for i in range(node.children().size()))
    return of(done._jdf.queryExecution().executedPlan())


def test_commands_of_people_without_rights_are_not_exchanged(spark, monkeypatch):
    monkeypatch.setattr(admission, "BLOCK", 16)
    users = [(f"u{i}", account(i), f"u{i}@x.org", None, False, None, NOW - 30 * DAY) for i in range(300)]
    orgs = [("o0", "Org", None, "active", None, "u0", NOW - 30 * DAY)]
    members = [("m0", "o0", "u0", "org_admin", "u1", NOW - 20 * DAY, None, None), ("m1", "o0", "u1", "contributor", "u0", NOW - 20 * DAY, None, None)]
    state = AccessState(
        spark.createDataFrame(users, NTZ(S.USERS)), spark.createDataFrame(orgs, NTZ(S.ORGANIZATIONS)), spark.createDataFrame(members, NTZ(S.ORG_MEMBERSHIPS)),
        None, spark.createDataFrame([], NTZ(S.ORG_INVITATIONS)))
    commands = [(f"{k:04d}", f"c{k}", f"u{k % 300}", "o0", f"u{k % 7 + 8}@x.org", "contributor", None, None) for k in range(3000)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = admission.admit(spark.createDataFrame(commands, COMMANDS), state, NOW)
        codes = Counter((r.actor == "u0", r.refusal_code, r.result) for r in done.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # u0 writes for seven people, then finds what was written.
    assert codes == {(False, "insufficient_privilege", None): 2990, (True, None, "created"): 7, (True, None, "existing"): 3}
    assert exchanged(done) < 1000


def test_persons_that_come_twice_are_judged_by_each_row(spark):
    users = [(f"u{i}", account(i), f"u{i}@x.org", None, False, off, NOW - 30 * DAY) for i, off in ((0, None), (0, NOW - DAY), (1, None), (1, None), (2, None))]
    orgs = [("o0", "Org", None, "active", None, "u2", NOW - 30 * DAY)]
    members = [("m0", "o0", "u0", "org_admin", "u1", NOW - 20 * DAY, None, None)]
    state = AccessState(
        spark.createDataFrame(users, NTZ(S.USERS)), spark.createDataFrame(orgs, NTZ(S.ORGANIZATIONS)), spark.createDataFrame(members, NTZ(S.ORG_MEMBERSHIPS)),
        None, spark.createDataFrame([], NTZ(S.ORG_INVITATIONS)))
    commands = [(str(k), f"c{k}", f"u{k % 3}", "o0", "bad", "owner" if k > 2 else "contributor", None, None) for k in range(6)]
    done = admission.admit(spark.createDataFrame(commands, COMMANDS), state, NOW).collect()
    refused, unknown = "not allowed to invite people to this organization", "unknown role"
    # An address that is looked up meets the two rows of the actor once more.
    assert Counter((r.command_id, r.refusal_reason) for r in done) == {
        ("c0", "that is not a valid email address"): 2, ("c0", refused): 1, ("c1", refused): 2, ("c2", refused): 1,
        ("c3", unknown): 1, ("c3", refused): 1, ("c4", unknown): 2, ("c5", unknown): 1}
