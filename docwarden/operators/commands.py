"""Evaluation of access commands: may each one run now, and what does it leave behind?

A batch is one wave: every command is judged against the same state, as if it were the next to
run. Commands that touch the same key must go in different waves (:func:`first_wave`), with the
state written in between. Each evaluator joins the facts its rules need and applies the rules in
order; the first that matches is the refusal. Results carry ``accepted``, ``refusal_code`` and
``refusal_reason``.

The wording of the refusals is fixed, as it is part of the results.

Commands name their actor and, for privileged changes, the reason in ``system_job``; nothing
depends on hidden session state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docwarden.functions import validation as V
from docwarden.functions.temporal import at, days
from docwarden.functions.text import stable_id
from docwarden.operators import caps
from docwarden.operators.access import (
    ADMIN, INVITERS, AccessState, active_support, authority, grants_role, invitation_is_open, last_admins,
    platform_admins, with_authority, with_org_status, with_person,
)
from docwarden.sources.tables import written

PRIVILEGE = "insufficient_privilege"
CHECK = "check_violation"
INPUT = "invalid_parameter_value"
UNIQUE = "unique_violation"
CAP = "invitation_cap"
NO_INVITATION = "no_such_invitation"
NOT_FOUND = "not_found"
ACCOUNT_NEEDED = "account_needed"

MAX_GRANT_DAYS = 14  # fixed value

# Refusals as they are worded for people.
NO_ACTOR = "no acting user on this connection (app.user_id not set)"
MAY_NOT_INVITE = "not allowed to invite people to this organization"
ORG_INACTIVE = "the organization is not active"
GONE = "no such invitation"
STALE_INVITATION = "that invitation can no longer be accepted"


def refusal_of(rules: list[tuple[Column, str, str]]) -> Column:
    """The first refusal whose condition holds, as ``(code, reason)``. A condition that is NULL does not refuse."""
    refusal = F.lit(None).cast("struct<code: string, reason: string>")
    for condition, code, reason in reversed(rules):
        refusal = F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason"))).otherwise(refusal)
    return refusal


def decide(df: DataFrame, rules: list[tuple[Column, str, str]]) -> DataFrame:
    """Applies refusal rules in order."""
    judged = df.withColumn("_refusal", refusal_of(rules))
    return judged.withColumns({
        "accepted": F.col("_refusal").isNull(),
        "refusal_code": F.col("_refusal.code"),
        "refusal_reason": F.col("_refusal.reason"),
    }).drop("_refusal")


def first_wave(commands: DataFrame, keys: list[str], seq: str) -> tuple[DataFrame, DataFrame]:
    """Splits commands into those that come first for their keys, and the rest for later waves."""
    first = commands.groupBy(*keys).agg(F.min(seq).alias(seq)).withColumn("_first", F.lit(True))
    marked = commands.join(first, [*keys, seq], "left")
    return marked.where(F.col("_first")).drop("_first"), marked.where(F.col("_first").isNull()).drop("_first")


def privileged() -> Column:
    return F.coalesce(F.btrim("system_job") != "", F.lit(False))


def _changed(new: str, old: str) -> Column:
    return ~F.col(new).eqNullSafe(F.col(old))


def _only(df: DataFrame, commands: DataFrame, *extra) -> DataFrame:
    return df.select(*commands.columns, "accepted", "refusal_code", "refusal_reason", *extra)


# --- organizations ---------------------------------------------------------------


def create_organizations(commands: DataFrame, state: AccessState, as_of) -> DataFrame:
    """``commands(command_id, actor, system_job, legal_name, display_name, status,
    billing_account_id)``. Adds the new row's columns; an ordinary platform admin cannot choose
    the status or the billing account."""
    j = with_person(commands, state.users, "actor", "_me")
    job = privileged()
    rules = [
        (F.col("actor").isNull(), PRIVILEGE, NO_ACTOR),
        (~job & ~F.col("_me_platform"), PRIVILEGE, "only a platform admin can create an organization"),
        (F.coalesce(F.btrim("legal_name"), F.lit("")) == "", CHECK, "legal name must not be blank"),
        (job & ~F.col("status").isin("active", "suspended", "closed"), CHECK, "unknown status"),
    ]
    return _only(
        decide(j, rules), commands,
        stable_id(F.lit("org"), F.col("command_id").cast("string")).alias("org_id"),
        F.when(job, F.coalesce("status", F.lit("active"))).otherwise("active").alias("new_status"),
        F.when(job, F.col("billing_account_id")).alias("new_billing_account_id"),
        F.col("actor").alias("created_by"),
        at(as_of).alias("created_at"),
    )


def update_organizations(commands: DataFrame, state: AccessState) -> DataFrame:
    """``commands(command_id, actor, system_job, org_id, new_org_id, new_created_by,
    new_legal_name, new_display_name, new_status, new_billing_account_id)``, each ``new_`` column
    holding the value after the change."""
    old = state.organizations.select(
        "org_id", F.lit(True).alias("_found"),
        *[F.col(c).alias(f"_{c}") for c in ("created_by", "legal_name", "display_name", "status", "billing_account_id")],
    )
    j = commands.join(old, "org_id", "left")
    j = with_person(j, state.users, "actor", "_me")
    j = with_authority(j, authority(state), "actor", "_me")
    ordinary = ~privileged()
    status = _changed("new_status", "_status")
    rename = _changed("new_display_name", "_display_name")
    rules = [
        (F.col("_found").isNull(), NOT_FOUND, "no such organization"),
        ((F.col("new_org_id") != F.col("org_id")) | (F.col("new_created_by") != F.col("_created_by")),
         PRIVILEGE, "organization identity fields cannot change"),
        (ordinary & (F.col("new_legal_name") != F.col("_legal_name")), PRIVILEGE, "legal name changes need the privileged path"),
        (status & (F.col("_status") == "closed"), CHECK, "a closed organization cannot be reopened"),
        (ordinary & status & F.col("actor").isNull(), PRIVILEGE, NO_ACTOR),
        (ordinary & status & ~F.col("_me_platform"), PRIVILEGE, "only a platform admin can change an organization's status"),
        (ordinary & rename & F.col("actor").isNull(), PRIVILEGE, NO_ACTOR),
        (ordinary & rename & ~F.col("_me_admin"), PRIVILEGE, "only an org admin can rename the organization"),
        (ordinary & _changed("new_billing_account_id", "_billing_account_id"),
         PRIVILEGE, "billing can only be changed by the privileged path"),
        (F.coalesce(F.btrim("new_legal_name"), F.lit("")) == "", CHECK, "legal name must not be blank"),
        (~F.coalesce(F.col("new_status").isin("active", "suspended", "closed"), F.lit(False)), CHECK, "unknown status"),
    ]
    return _only(decide(j, rules), commands)


# --- memberships -----------------------------------------------------------------


def insert_memberships(commands: DataFrame, state: AccessState, as_of) -> DataFrame:
    """``commands(command_id, actor, system_job, accepting_invitation, org_id, user_id, role,
    revoked_at)``. A membership comes from accepting one's own matching open invitation, or from
    the privileged path. Adds ``granted_by`` and ``closes_invitation``."""
    j = with_org_status(commands, state.organizations)
    j = with_person(j, state.users, "actor", "_me")
    invited = state.invitations.where(invitation_is_open(as_of)).select(
        F.col("invitation_id").alias("accepting_invitation"),
        F.struct("org_id", "invited_user_id", "role", "invited_by").alias("_inv"),
    )
    j = j.join(invited, "accepting_invitation", "left")
    matches = (
        (F.col("_inv.org_id") == F.col("org_id")) & (F.col("_inv.invited_user_id") == F.col("user_id"))
        & (F.col("_inv.role") == F.col("role")) & (F.col("user_id") == F.col("actor"))
    )
    j = j.withColumns({"_match": F.coalesce(matches, F.lit(False)), "_inviter": F.col("_inv.invited_by")})
    j = with_authority(j, authority(state, INVITERS), "_inviter", "_by")
    j = _with_held_role(j, state)
    match, job = F.col("_match"), privileged()
    granter = F.when(match, F.col("_inviter")).otherwise(F.col("actor"))
    stale = (
        ~F.col("org_status").eqNullSafe(F.lit("active")) | ~F.col("_me_active") | F.col("_me_platform")
        | ~grants_role("_by", F.col("role"))
    )
    rules = [
        (F.col("actor").isNull(), PRIVILEGE, NO_ACTOR),
        (F.col("revoked_at").isNotNull(), CHECK, "a new membership cannot start revoked"),
        (match & stale, PRIVILEGE, STALE_INVITATION),
        (~match & ~job, PRIVILEGE, "memberships are created by accepting an invitation"),
        (granter == F.col("user_id"), CHECK, "nobody grants themselves a membership"),
        (~V.valid_role(F.col("role")), CHECK, "unknown role"),
        (F.col("_held"), UNIQUE, "that role is already held"),
    ]
    done = decide(j, rules)
    return _only(
        done, commands,
        stable_id(F.lit("membership"), F.col("command_id").cast("string")).alias("membership_id"),
        F.when(F.col("accepted"), granter).alias("granted_by"),
        F.when(F.col("accepted") & match, F.col("accepting_invitation")).alias("closes_invitation"),
        at(as_of).alias("granted_at"),
    )


def _with_held_role(rows: DataFrame, state: AccessState) -> DataFrame:
    held = state.memberships.where(F.col("revoked_at").isNull()).select("org_id", "user_id", "role").distinct()
    j = rows.join(held.withColumn("_held", F.lit(True)), ["org_id", "user_id", "role"], "left")
    return j.withColumn("_held", F.coalesce("_held", F.lit(False)))


def close_accepted(invitations: DataFrame, new_memberships: DataFrame, as_of) -> DataFrame:
    """Invitations after acceptance: the open one that matches a new membership in organization,
    person, role and sender is stamped accepted."""
    keys = new_memberships.select(
        "org_id", F.col("user_id").alias("invited_user_id"), "role", F.col("granted_by").alias("invited_by"),
        F.lit(True).alias("_joined"),
    ).distinct()
    # Closed and expired ones stay as they are, so they do not meet the keys.
    is_open = F.coalesce(invitation_is_open(as_of), F.lit(False))
    j = invitations.where(is_open).join(keys, ["org_id", "invited_user_id", "role", "invited_by"], "left")
    kind = invitations.schema["accepted_at"].dataType
    stamped = j.withColumn("accepted_at", F.when(F.col("_joined"), at(as_of).cast(kind)).otherwise(F.col("accepted_at")))
    return stamped.select(invitations.columns).unionByName(invitations.where(~is_open))


def revoke_memberships(commands: DataFrame, state: AccessState) -> DataFrame:
    """``commands(command_id, actor, system_job, org_id, membership_id)``.

    What the membership decides becomes flags before the actor is looked up, so that a command meets its
    actor without the columns behind them, and only admins' rights are worked out."""
    old = state.memberships.select(
        "org_id", "membership_id", F.lit(True).alias("_found"), F.col("user_id").alias("_member"),
        F.col("role").alias("_role"), F.col("revoked_at").isNotNull().alias("_revoked"),
    )
    j = commands.join(old, ["org_id", "membership_id"], "left").join(last_admins(state), "org_id", "left")
    only = F.col("_admins").isNotNull() & ((F.col("_admins") == 0) | (F.col("_only_admin") == F.col("membership_id")))
    j = j.select(
        *commands.columns, F.col("_found").isNull().alias("_lost"), "_revoked", (F.col("_member") == F.col("actor")).alias("_self"),
        privileged().alias("_job"), ((F.col("_role") == "org_admin") & only).alias("_last"),
    )
    j = with_person(j, state.users, "actor", "_me")
    j = with_authority(j, authority(state, ADMIN), "actor", "_me")
    job = F.col("_job")
    rules = [
        (F.col("actor").isNull(), PRIVILEGE, NO_ACTOR),
        (F.col("_lost"), NOT_FOUND, "No such membership in this organization."),
        (F.col("_revoked"), CHECK, "membership already revoked; grant a new one instead"),
        (~job & ~(F.col("_me_admin") | (F.col("_self") & F.col("_me_active"))), PRIVILEGE, "not allowed to remove this membership"),
        (~job & F.col("_last"), CHECK, "an organization must keep at least one active admin"),
    ]
    return _only(decide(j, rules), commands)


# --- support access ----------------------------------------------------------------


def grant_support(commands: DataFrame, state: AccessState, as_of) -> DataFrame:
    """``commands(command_id, actor, org_id, support_user_id, reason, starts_at, expires_at)``.
    Access never starts before now. Adds the new row's ``consented_by`` and ``starts_at_effective``."""
    now = at(as_of)
    j = with_org_status(commands, state.organizations)
    j = with_authority(j, authority(state), "actor", "_me")
    j = with_person(j, state.users, "support_user_id", "_staff")
    starts = F.greatest(F.coalesce("starts_at", now), now)
    rules = [
        (F.col("actor").isNull(), PRIVILEGE, NO_ACTOR),
        (~F.col("org_status").eqNullSafe(F.lit("active")), CHECK, ORG_INACTIVE),
        (~F.col("_me_admin"), PRIVILEGE, "only an org admin can grant support access"),
        (F.col("support_user_id") == F.col("actor"), PRIVILEGE, "you cannot grant support access to yourself"),
        (~F.col("_staff_platform"), CHECK, "support access can only go to an active platform admin"),
        (F.coalesce(F.btrim("reason"), F.lit("")) == "", CHECK, "a reason is required"),
        (F.col("expires_at").isNull() | (F.col("expires_at") <= starts) | (F.col("expires_at") > starts + days(MAX_GRANT_DAYS)),
         CHECK, "support access lasts at most 14 days"),
    ]
    done = decide(j.withColumn("starts_at_effective", starts), rules)
    return _only(
        done, commands, "starts_at_effective",
        stable_id(F.lit("grant"), F.col("command_id").cast("string")).alias("grant_id"),
        F.col("actor").alias("consented_by"),
    )


def revoke_support(commands: DataFrame, state: AccessState) -> DataFrame:
    """``commands(command_id, actor, system_job, org_id, grant_id)``."""
    old = state.support_grants.select(
        "org_id", "grant_id", F.lit(True).alias("_found"),
        F.col("support_user_id").alias("_staff"), F.col("revoked_at").alias("_revoked_at"),
    )
    j = commands.join(old, ["org_id", "grant_id"], "left")
    j = with_authority(j, authority(state), "actor", "_me")
    rules = [
        (F.col("actor").isNull(), PRIVILEGE, NO_ACTOR),
        (F.col("_found").isNull(), NOT_FOUND, "No such support grant in this organization."),
        (F.col("_revoked_at").isNotNull(), CHECK, "support grant already revoked"),
        (~(F.col("_me_admin") | F.coalesce(F.col("_staff") == F.col("actor"), F.lit(False)) | privileged()),
         PRIVILEGE, "not allowed to revoke this support grant"),
    ]
    return _only(decide(j, rules), commands)


# --- invitations -----------------------------------------------------------------


def gate(j: DataFrame, state: AccessState, as_of) -> tuple[DataFrame, list]:
    """Facts and rules of the invitation gate: authorization first, then the caps from the
    narrowest scope to the widest."""
    j = with_person(j, state.users, "actor", "_me")
    j = with_authority(j, authority(state), "actor", "_me")
    by_org = caps.recent_counts(state.invitations, as_of, "org_id").withColumnRenamed("recent", "_org_recent")
    by_sender = caps.recent_counts(state.invitations, as_of, "invited_by").select(
        F.col("invited_by").alias("actor"), F.col("recent").alias("_sender_recent")
    )
    overall = caps.recent(state.invitations, as_of).agg(F.count("*")).scalar()
    j = j.join(by_org, "org_id", "left").join(by_sender, "actor", "left").withColumn("_all_recent", overall)
    return j, gate_rules()


def gate_rules() -> list:
    return [
        (F.col("actor").isNull(), PRIVILEGE, NO_ACTOR),
        (~F.col("_me_active") | F.col("_me_platform"), PRIVILEGE, MAY_NOT_INVITE),
        (~V.valid_role(F.col("role")), INPUT, "unknown role"),
        (~grants_role("_me", F.col("role")), PRIVILEGE, MAY_NOT_INVITE),
        (F.col("_org_recent") >= caps.ORG_CAP, *caps.REFUSALS["org"]),
        (F.col("_sender_recent") >= caps.SENDER_CAP, *caps.REFUSALS["sender"]),
        (F.col("_all_recent") >= caps.GLOBAL_CAP, *caps.REFUSALS["global"]),
    ]


def invitation_gate(commands: DataFrame, state: AccessState, as_of) -> DataFrame:
    """``commands(command_id, actor, org_id, role)``: may this person invite for this role now?"""
    j, rules = gate(commands, state, as_of)
    return _only(decide(j, rules), commands)


def invite(commands: DataFrame, state: AccessState, as_of) -> DataFrame:
    """``commands(command_id, actor, org_id, email, role, display_name, account_id)``.

    Adds ``result`` (``existing``, ``renewed``, ``created``), ``invitation_id``, ``invited_user_id``,
    ``new_user`` and the normalized ``invited_email``. An open invitation is returned as it is, an
    expired one renewed in place; an unknown person is added when an account id is given."""
    now = at(as_of)
    email = V.normalized_email(F.coalesce("email", F.lit("")))
    people = state.users.select(F.col("email").alias("invited_email"), F.col("user_id").alias("_target"))
    accounts = state.users.select(F.col("cognito_sub").alias("_account"), F.lit(True).alias("_account_taken"))
    mine = state.users.select(F.col("user_id").alias("actor"), F.col("email").alias("_my_email"))
    j = commands.withColumns({"invited_email": email, "_account": F.lower("account_id")})
    j = j.join(people, "invited_email", "left").join(mine, "actor", "left").join(accounts, "_account", "left")
    opened = state.invitations.where(invitation_is_open()).groupBy(
        "org_id", F.col("invited_user_id").alias("_target"), "role"
    ).agg(F.max_by(F.struct("invitation_id", "expires_at"), F.struct("invited_at", "invitation_id")).alias("_open"))
    j = j.join(opened, ["org_id", "_target", "role"], "left")
    j, rules = gate(j, state, as_of)
    unknown = F.col("_target").isNull()
    rules += [
        (~V.valid_email(F.col("invited_email")), INPUT, "that is not a valid email address"),
        (~V.valid_display_name(F.col("display_name"), V.CONTROL), INPUT, "that name is not acceptable"),
        (F.col("invited_email") == F.col("_my_email"), PRIVILEGE, "you cannot invite yourself"),
        (unknown & (F.coalesce(F.btrim("account_id"), F.lit("")) == ""), ACCOUNT_NEEDED, "account_needed"),
        (unknown & ~F.col("_account").rlike(V.UUID), INPUT, "invalid account id"),
        (unknown & F.col("_account_taken"), CHECK, "that account could not be set up"),
    ]
    done = decide(j, rules)
    live = F.col("_open.expires_at") > now
    result = F.when(F.col("_open").isNull(), "created").when(live, "existing").otherwise("renewed")
    ok = F.col("accepted")
    return _only(
        done, commands, "invited_email",
        F.when(ok, result).alias("result"),
        F.when(ok, F.coalesce("_open.invitation_id", stable_id(F.lit("invitation"), F.col("command_id").cast("string")))).alias("invitation_id"),
        F.when(ok, F.coalesce("_target", stable_id(F.lit("user"), F.col("_account")))).alias("invited_user_id"),
        F.when(ok, unknown).alias("new_user"),
        F.when(ok & ~(F.col("_open").isNotNull() & live), now + days(MAX_GRANT_DAYS)).otherwise(F.col("_open.expires_at")).alias("expires_at"),
    )


def _invitation_facts(commands: DataFrame, state: AccessState) -> DataFrame:
    inv = state.invitations.select("invitation_id", F.struct(*[c for c in state.invitations.columns if c != "invitation_id"]).alias("_i"))
    j = commands.join(inv, "invitation_id", "left")
    return with_person(j, state.users, "actor", "_me")


def _closed(i: str = "_i") -> Column:
    return F.coalesce(f"{i}.accepted_at", f"{i}.declined_at", f"{i}.revoked_at").isNotNull()


def accept_invitations(commands: DataFrame, state: AccessState, as_of) -> DataFrame:
    """``commands(command_id, actor, invitation_id)``. Whatever stands in the way, the answer is the
    same "no such invitation". Adds the membership that results."""
    now = at(as_of)
    j = _invitation_facts(commands, state)
    j = j.withColumns({
        "org_id": F.col("_i.org_id"), "role": F.col("_i.role"), "user_id": F.col("actor"), "_inviter": F.col("_i.invited_by"),
    })
    j = with_org_status(j, state.organizations)
    j = with_authority(j, authority(state, INVITERS), "_inviter", "_by")
    j = _with_held_role(j, state)
    blocked = (
        F.col("_i").isNull() | ~F.col("_i.invited_user_id").eqNullSafe(F.col("actor")) | _closed() | (F.col("_i.expires_at") <= now)
        | ~F.col("org_status").eqNullSafe(F.lit("active")) | ~F.col("_me_active") | F.col("_me_platform")
        | ~grants_role("_by", F.col("role")) | F.col("_held")
    )
    done = decide(j, [(F.col("actor").isNull(), PRIVILEGE, NO_ACTOR), (F.coalesce(blocked, F.lit(True)), NO_INVITATION, GONE)])
    ok = F.col("accepted")
    return _only(
        done, commands,
        F.when(ok, stable_id(F.lit("membership"), F.col("invitation_id"))).alias("membership_id"),
        F.when(ok, F.col("org_id")).alias("org_id"),
        F.when(ok, F.col("role")).alias("role"),
        F.when(ok, F.col("_inviter")).alias("granted_by"),
    )


def decline_invitations(commands: DataFrame, state: AccessState, as_of) -> DataFrame:
    j = _invitation_facts(commands, state)
    blocked = (
        F.col("_i").isNull() | ~F.col("_i.invited_user_id").eqNullSafe(F.col("actor")) | _closed()
        | (F.col("_i.expires_at") <= at(as_of)) | ~F.col("_me_active")
    )
    return _only(decide(j, [(F.col("actor").isNull(), PRIVILEGE, NO_ACTOR), (F.coalesce(blocked, F.lit(True)), NO_INVITATION, GONE)]), commands)


def revoke_invitations(commands: DataFrame, state: AccessState) -> DataFrame:
    """An org admin may withdraw any invitation that is not closed, its sender their own while
    still able to invite."""
    j = _invitation_facts(commands, state).withColumn("org_id", F.col("_i.org_id"))
    j = with_authority(j, authority(state), "actor", "_me")
    allowed = F.col("_me_admin") | (F.col("_i.invited_by").eqNullSafe(F.col("actor")) & F.col("_me_inviter"))
    blocked = F.col("_i").isNull() | _closed() | ~allowed
    return _only(decide(j, [(F.col("actor").isNull(), PRIVILEGE, NO_ACTOR), (F.coalesce(blocked, F.lit(True)), NO_INVITATION, GONE)]), commands)


def check_invitation_updates(updates: DataFrame, as_of) -> DataFrame:
    """Legality of direct changes: ``updates(old, new)``, two structs of an invitation's columns."""
    def differs(name):
        return F.col(f"new.{name}") != F.col(f"old.{name}")

    ends = [F.col(f"new.{c}").isNotNull() for c in ("accepted_at", "declined_at", "revoked_at")]
    renewal = differs("invited_at")
    status_only = "only the status of an invitation may change"
    rules = [
        (differs("invitation_id") | differs("org_id") | differs("invited_user_id") | differs("role"), PRIVILEGE, status_only),
        (_closed("old"), CHECK, "that invitation is closed"),
        (renewal & ((F.col("old.expires_at") > at(as_of)) | ends[0] | ends[1] | ends[2]),
         CHECK, "only an expired open invitation can be renewed"),
        (~F.coalesce(renewal, F.lit(False)) & (differs("invited_by") | differs("expires_at")), PRIVILEGE, status_only),
    ]
    return decide(updates, rules)


# --- operator commands ---------------------------------------------------------------


def create_users(commands: DataFrame, state: AccessState) -> DataFrame:
    """``commands(command_id, cognito_sub, email, display_name, platform_admin, operator_email,
    reason)``. Adds ``result`` (``created`` or ``exists``); repeating a command changes nothing.
    Run without writing the result for a dry run."""
    sub, email = F.lower(V.strip(F.col("cognito_sub"))), V.normalized_email(F.col("email"))
    by_email = state.users.select(F.col("email").alias("_email"), F.struct("user_id", "cognito_sub", "is_platform_admin").alias("_by_email"))
    by_sub = state.users.select(F.col("cognito_sub").alias("_sub"), F.struct("user_id", "email").alias("_by_sub"))
    staff = platform_admins(state.users)
    any_admin = staff.agg(F.count("*")).scalar() > 0
    operators = staff.select(F.col("email").alias("_operator"), F.col("user_id").alias("operator_id"))
    j = commands.withColumns({"_sub": sub, "_email": email, "_operator": V.normalized_email(F.col("operator_email"))})
    j = j.join(by_email, "_email", "left").join(by_sub, "_sub", "left").join(operators, "_operator", "left")
    j = j.withColumn("_any_admin", any_admin)
    same = (F.col("_by_email.cognito_sub") == F.col("_sub")) & (F.col("_by_email.is_platform_admin") == F.col("platform_admin"))
    same = F.coalesce(same, F.lit(False))
    admin = F.col("platform_admin") & ~same
    rules = [
        (~V.valid_uuid(F.col("cognito_sub")), INPUT, "--cognito-sub must be the user's UUID from the Cognito console"),
        (~V.valid_email(F.col("email")), INPUT, "not a plain email address"),
        (~V.valid_display_name(F.col("display_name"), V.INVISIBLE), INPUT, "--display-name is too long or has control characters"),
        (admin & F.col("_any_admin") & F.col("operator_email").isNull(),
         PRIVILEGE, "a platform admin already exists, so creating another needs --as <an active platform admin>"),
        (admin & F.col("operator_email").isNotNull() & F.col("operator_id").isNull(), PRIVILEGE, "--as is not an active platform admin"),
        (~same & ~V.valid_job_reason(F.col("reason")), INPUT, "--reason must be a short sentence"),
        (~same & (F.col("_by_email").isNotNull() | F.col("_by_sub").isNotNull()),
         UNIQUE, "that email or Cognito sub already belongs to a different account; nothing changed"),
    ]
    done = decide(j, rules)
    return _only(
        done, commands,
        F.when(F.col("accepted"), F.when(same, "exists").otherwise("created")).alias("result"),
        F.when(F.col("accepted"), F.coalesce("_by_email.user_id", stable_id(F.lit("user"), F.col("_sub")))).alias("user_id"),
    )


def create_organizations_as_operator(commands: DataFrame, state: AccessState) -> DataFrame:
    """``commands(command_id, legal_name, operator_email, reason)``. A name is taken if it matches
    after trimming and lower-casing."""
    name = V.strip(F.col("legal_name"))
    taken = state.organizations.groupBy(F.lower(F.btrim("legal_name")).alias("_name")).agg(
        F.count("*").alias("_same_name"), F.min("org_id").alias("_org_id")
    )
    operators = platform_admins(state.users).select(F.col("email").alias("_operator"), F.col("user_id").alias("operator_id"))
    j = commands.withColumns({"_name": F.lower(name), "_operator": V.normalized_email(F.col("operator_email"))})
    j = j.join(taken, "_name", "left").join(operators, "_operator", "left")
    rules = [
        (~V.valid_plain_name(F.col("legal_name")), INPUT, "--legal-name must be 1-300 characters without control characters"),
        (F.col("operator_id").isNull(), PRIVILEGE, "--as is not an active platform admin"),
        (~V.valid_job_reason(F.col("reason")), INPUT, "--reason must be a short sentence"),
        (F.col("_same_name") > 1, UNIQUE, "several organizations already have that name; nothing changed"),
    ]
    done = decide(j, rules)
    exists = F.col("_same_name") == 1
    return _only(
        done, commands,
        F.when(F.col("accepted"), F.when(exists, "exists").otherwise("created")).alias("result"),
        F.when(F.col("accepted"), F.coalesce("_org_id", stable_id(F.lit("org"), F.col("_name")))).alias("org_id"),
    )


def seat_org_admins(commands: DataFrame, state: AccessState) -> DataFrame:
    """``commands(command_id, org_id, user_email, operator_email, reason)``: the privileged way to
    seat a first or replacement admin."""
    person = state.users.select(
        F.col("email").alias("_email"), F.col("user_id").alias("user_id"),
        F.col("disabled_at").isNull().alias("_enabled"), F.col("is_platform_admin").alias("_staff"),
    )
    # Written, so that its size is known: one operator gives very many commands, which stay where they are if it is small.
    operators = written(platform_admins(state.users).select(F.col("email").alias("_operator"), F.lit(True).alias("_by_operator")), "operators")
    seat = F.lower(F.btrim("org_id"))
    j = commands.withColumns({
        "_email": V.normalized_email(F.col("user_email")), "_operator": V.normalized_email(F.col("operator_email")),
        "_bad_org": ~F.coalesce(V.valid_uuid(seat), F.lit(False)), "_bad_email": ~V.valid_email(F.col("user_email")),
        "_bad_reason": ~V.valid_job_reason(F.col("reason")), "_seat_id": seat,
    })
    status = state.organizations.select(F.col("org_id").alias("_seat_id"), F.col("status").alias("org_status"))
    j = j.join(status, "_seat_id", "left").join(operators, "_operator", "left").join(person, "_email", "left")
    held = state.memberships.where(F.col("revoked_at").isNull() & (F.col("role") == "org_admin")).select(
        F.col("org_id").alias("_seat_id"), "user_id").distinct().withColumn("_held", F.lit(True))
    j = j.join(held, ["_seat_id", "user_id"], "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    rules = [
        (F.col("_bad_org"), INPUT, "--org must be the organization's id (a UUID)"),
        (F.col("_bad_email"), INPUT, "not a plain email address"),
        (F.col("_by_operator").isNull(), PRIVILEGE, "--as is not an active platform admin"),
        (F.col("_bad_reason"), INPUT, "--reason must be a short sentence"),
        (F.col("org_status").isNull(), NOT_FOUND, "no such organization"),
        (F.col("org_status") != "active", CHECK, ORG_INACTIVE),
        (~F.coalesce("_enabled", F.lit(False)), CHECK, "has no active account (run create-user first)"),
        (F.col("_staff"), PRIVILEGE, "is a platform admin; vendor staff are never members"),
    ]
    done = decide(j, rules)
    ok = F.col("accepted")
    return _only(
        done, commands,
        F.when(ok, F.when(F.col("_held"), "exists").otherwise("created")).alias("result"),
        F.when(ok, F.col("user_id")).alias("user_id"),
    )


# --- audit entries -----------------------------------------------------------------


def check_audit_writes(entries: DataFrame, state: AccessState, as_of) -> DataFrame:
    """Entries somebody wants in the audit trail: ``(command_id, actor, system_job, privileged,
    action, org_id, ...)``. An ordinary caller acts as a person, uses ``area.event`` outside the
    areas the system writes itself, and belongs to the organization or supports it at the time.
    Adds ``source``."""
    j = with_authority(entries, authority(state), "actor", "_me")
    support = active_support(state, as_of).select("org_id", F.col("support_user_id").alias("actor"), F.lit(True).alias("_support"))
    j = j.join(support, ["org_id", "actor"], "left")
    ordinary = ~F.col("privileged")
    job = F.coalesce(F.btrim("system_job") != "", F.lit(False))
    area = F.split_part("action", F.lit("."), F.lit(1))
    belongs = F.col("_me_member") | F.coalesce("_support", F.lit(False))
    rules = [
        (ordinary & F.col("actor").isNull(), PRIVILEGE, NO_ACTOR),
        (ordinary & ~V.valid_audit_action(F.col("action")), INPUT, 'audit action must look like "area.event" in lowercase'),
        (ordinary & area.isin("org", "membership", "support_access", "user", "invitation"),
         PRIVILEGE, "audit action is reserved for the database"),
        (ordinary & F.col("org_id").isNotNull() & ~belongs, PRIVILEGE, "cannot write to that organization's audit trail"),
        (~ordinary & ~job & F.col("actor").isNull(), PRIVILEGE, "privileged change without an actor or app.system_job reason"),
    ]
    done = decide(j, rules)
    source = F.when(ordinary, "api").when(job, "system").otherwise("operator")
    return _only(done, entries, F.when(F.col("accepted"), source).alias("source"))
