"""Who may see and do what: point-in-time reads over users, organizations, memberships,
invitations and support grants.

Rights are worked out once per (organization, person) by mergeable aggregates, then joined by that
pair. The pair spreads a large organization over many tasks, which the organization id alone
would not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from docwarden.functions.temporal import at
from docwarden.functions.validation import ROLES
from docwarden.operators.ranking import ranked
from docwarden.schemas import PRINCIPAL_COLUMNS
from docwarden.sources.tables import written

# Roles that satisfy a question about an organization.
ADMIN = ("org_admin",)
INVITERS = ("org_admin", "point_person")


@dataclass(frozen=True)
class AccessState:
    """The tables of one point in time."""

    users: DataFrame
    organizations: DataFrame
    memberships: DataFrame
    support_grants: DataFrame | None = None
    invitations: DataFrame | None = None


def roles_to_grant(role: Column) -> Column:
    """Roles of which one is needed to hand out ``role``."""
    return F.when(role == "org_admin", F.array(*map(F.lit, ADMIN))).otherwise(F.array(*map(F.lit, INVITERS)))


# --- predicates on rows ------------------------------------------------------


def invitation_is_open(as_of=None) -> Column:
    """Not accepted, declined or revoked; with ``as_of``, also not expired by then."""
    closed = F.coalesce("accepted_at", "declined_at", "revoked_at")
    return closed.isNull() if as_of is None else closed.isNull() & (F.col("expires_at") > at(as_of))


def grant_is_running(as_of) -> Column:
    now = at(as_of)
    return F.col("revoked_at").isNull() & (F.col("starts_at") <= now) & (F.col("expires_at") > now)


# --- sets ---------------------------------------------------------------------


def active_users(users: DataFrame) -> DataFrame:
    return users.where(F.col("disabled_at").isNull())


def platform_admins(users: DataFrame) -> DataFrame:
    return active_users(users).where("is_platform_admin")


def active_memberships(state: AccessState, roles=None) -> DataFrame:
    """Memberships that count: not revoked, of an enabled person who is not a platform admin, in
    an active organization; with ``roles``, only those, and no others are exchanged."""
    people = active_users(state.users).where(~F.col("is_platform_admin")).select("user_id")
    orgs = state.organizations.where(F.col("status") == "active").select("org_id")
    current = state.memberships.where(F.col("revoked_at").isNull())
    if roles is not None:
        current = current.where(F.col("role").isin(*roles))
    return current.join(people, "user_id", "left_semi").join(orgs, "org_id", "left_semi")


def authority(state: AccessState, roles=None) -> DataFrame:
    """One row per (organization, person) with an active membership: ``is_admin``, ``is_inviter``
    (admin or point person); presence means member. A caller that asks for admins or inviters alone
    names their ``roles``; presence then says nothing of other roles."""
    def holds(roles):
        return F.bool_or(F.col("role").isin(*roles))
    return active_memberships(state, roles).groupBy("org_id", "user_id").agg(
        holds(ADMIN).alias("is_admin"), holds(INVITERS).alias("is_inviter")
    )


def members_among(pairs: DataFrame, state: AccessState, roles=ROLES) -> DataFrame:
    """The ``(org_id, user_id)`` rows of ``pairs`` whose person holds one of ``roles`` there."""
    holders = active_memberships(state).where(F.col("role").isin(*roles)).select("org_id", "user_id")
    return pairs.join(holders, ["org_id", "user_id"], "left_semi")


def active_support(state: AccessState, as_of) -> DataFrame:
    """``(org_id, support_user_id)`` pairs with support access running at ``as_of``."""
    running = state.support_grants.where(grant_is_running(as_of)).select("org_id", "support_user_id")
    orgs = state.organizations.where(F.col("status") == "active").select("org_id")
    staff = platform_admins(state.users).select(F.col("user_id").alias("support_user_id"))
    return running.join(orgs, "org_id", "left_semi").join(staff, "support_user_id", "left_semi").distinct()


def can_invite(requests: DataFrame, state: AccessState) -> DataFrame:
    """Adds ``can_invite`` to ``(org_id, user_id, role, ...)``: may this person hand out this role?"""
    return with_authority(requests, authority(state, INVITERS), "user_id", "_by").withColumn(
        "can_invite", grants_role("_by", F.col("role"))
    ).drop("_by_member", "_by_admin", "_by_inviter")


def grants_role(prefix: str, role: Column) -> Column:
    return F.when(role == "org_admin", F.col(f"{prefix}_admin")).otherwise(F.col(f"{prefix}_inviter"))


def member_organizations(state: AccessState) -> DataFrame:
    """``(user_id, org_id)`` of everyone's own organizations."""
    return authority(state).select("user_id", "org_id")


def visible_organizations(state: AccessState, user_id: str, is_platform_admin: bool) -> DataFrame:
    """``org_id`` of the organizations one viewer sees: all of them for a platform admin, else the
    viewer's own."""
    if is_platform_admin:
        return state.organizations.select("org_id")
    return member_organizations(state).where(F.col("user_id") == user_id).select("org_id")


def visible_organization_counts(state: AccessState) -> DataFrame:
    """How many organizations each active person sees. For platform admins that is the number
    there are, so no list per admin is ever built."""
    own = member_organizations(state).groupBy("user_id").agg(F.count("*").alias("_own"))
    everything = state.organizations.agg(F.count("*")).scalar()
    seen = F.when(F.col("is_platform_admin"), everything).otherwise(F.coalesce("_own", F.lit(0)))
    return active_users(state.users).join(own, "user_id", "left").select(
        "user_id", "is_platform_admin", seen.cast("long").alias("visible")
    )


# --- facts joined to commands ----------------------------------------------------


def with_person(rows: DataFrame, users: DataFrame, column: str, prefix: str) -> DataFrame:
    """Adds ``{prefix}_exists``, ``{prefix}_active``, ``{prefix}_platform`` (active platform admin)."""
    facts = users.select(
        F.col("user_id").alias(column),
        F.lit(True).alias(f"{prefix}_exists"),
        F.col("disabled_at").isNull().alias(f"{prefix}_active"),
        (F.col("disabled_at").isNull() & F.col("is_platform_admin")).alias(f"{prefix}_platform"),
    )
    return _left_false(rows, facts, [column], [f"{prefix}_exists", f"{prefix}_active", f"{prefix}_platform"])


def with_authority(rows: DataFrame, rights: DataFrame, column: str, prefix: str) -> DataFrame:
    """Adds ``{prefix}_member``, ``{prefix}_admin``, ``{prefix}_inviter`` for the person in ``column``
    in the row's ``org_id``."""
    facts = rights.select(
        "org_id",
        F.col("user_id").alias(column),
        F.lit(True).alias(f"{prefix}_member"),
        F.col("is_admin").alias(f"{prefix}_admin"),
        F.col("is_inviter").alias(f"{prefix}_inviter"),
    )
    return _left_false(rows, facts, ["org_id", column], [f"{prefix}_member", f"{prefix}_admin", f"{prefix}_inviter"])


def with_org_status(rows: DataFrame, organizations: DataFrame) -> DataFrame:
    return rows.join(organizations.select("org_id", F.col("status").alias("org_status")), "org_id", "left")


def _left_false(rows: DataFrame, facts: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    joined = rows.join(facts, keys, "left")
    return joined.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})


# --- lists -----------------------------------------------------------------------


def principals(users: DataFrame) -> DataFrame:
    """People who may sign in. Filter by ``cognito_sub`` to look one up; the filter reaches the scan."""
    return active_users(users).select(*PRINCIPAL_COLUMNS)


ORG_COLUMNS = ("org_id", "legal_name", "display_name", "status", "created_at")


def list_organizations(state: AccessState, user_id: str, is_platform_admin: bool) -> DataFrame:
    """The organizations one viewer sees, by name."""
    seen = visible_organizations(state, user_id, is_platform_admin)
    return state.organizations.select(*ORG_COLUMNS).join(seen, "org_id", "left_semi").orderBy("legal_name", "org_id")


def list_member_organizations(state: AccessState) -> DataFrame:
    """Everyone's own organizations; ``rank`` orders each person's by name."""
    orgs = state.organizations.select(*ORG_COLUMNS)
    return ranked(member_organizations(state).join(orgs, "org_id"), "user_id", [F.col("legal_name"), F.col("org_id")])


def list_members(state: AccessState) -> DataFrame:
    """Current memberships; ``rank`` orders those of an organization by e-mail, role and id."""
    people = state.users.select("user_id", "email", "display_name")
    current = state.memberships.where(F.col("revoked_at").isNull())
    listed = current.select("org_id", "membership_id", "user_id", "role", "granted_at").join(people, "user_id")
    return ranked(listed, "org_id", [F.col("email"), F.col("role"), F.col("membership_id")])


def list_support_grants(state: AccessState) -> DataFrame:
    """Support grants; ``rank`` orders those of an organization, newest first."""
    people = state.users.select(F.col("user_id").alias("support_user_id"), "email")
    columns = ["org_id", "grant_id", "support_user_id", "reason", "starts_at", "expires_at", "revoked_at"]
    listed = state.support_grants.select(*columns).join(people, "support_user_id")
    return ranked(listed, "org_id", [F.col("starts_at").desc(), F.col("grant_id")])


def list_open_invitations(state: AccessState, as_of) -> DataFrame:
    """Open invitations; ``rank`` orders those of an organization, newest first. ``stale`` marks those whose sender
    could no longer hand out the role, so that they cannot be accepted."""
    opened = state.invitations.where(invitation_is_open(as_of))
    invitee = state.users.select(F.col("user_id").alias("invited_user_id"), "email")
    sender = state.users.select(F.col("user_id").alias("invited_by"), F.col("email").alias("invited_by_email"))
    judged = with_authority(opened, authority(state, INVITERS), "invited_by", "_by")
    listed = (
        judged.withColumn("stale", ~grants_role("_by", F.col("role")))
        .join(invitee, "invited_user_id")
        .join(sender, "invited_by")
        .select("org_id", "invitation_id", "email", "role", "invited_by_email", "invited_at", "expires_at", "stale")
    )
    return ranked(listed, "org_id", [F.col("invited_at").desc(), F.col("invitation_id")])


def readable_by(listing: DataFrame, state: AccessState, user_id: str, roles=ADMIN) -> DataFrame:
    """Rows of a listing of all organizations that one person may read: those of organizations
    where they hold one of ``roles``. An organization that does not exist and one of others look
    the same."""
    own = active_memberships(state).where((F.col("user_id") == user_id) & F.col("role").isin(*roles))
    return listing.join(own.select("org_id"), "org_id", "left_semi")


def list_my_invitations(state: AccessState, as_of) -> DataFrame:
    """Invitations that wait for a person, in active organizations; ``rank`` orders each person's, newest first."""
    opened = state.invitations.where(invitation_is_open(as_of))
    orgs = state.organizations.where(F.col("status") == "active").select("org_id", F.col("legal_name").alias("org_legal_name"))
    sender = state.users.select(
        F.col("user_id").alias("invited_by"), F.coalesce("display_name", "email").alias("invited_by_name")
    )
    listed = (
        opened.join(orgs, "org_id")
        .join(sender, "invited_by")
        .select("invited_user_id", "invitation_id", "org_legal_name", "role", "invited_by_name", "invited_at", "expires_at")
    )
    return ranked(listed, "invited_user_id", [F.col("invited_at").desc(), F.col("invitation_id")])


def other_admin_counts(state: AccessState) -> DataFrame:
    """For each current admin membership, how many *other* current admin memberships of enabled
    people its organization has. A count per organization minus the row itself replaces the
    comparison of every pair of admins."""
    admins = state.memberships.where((F.col("role") == "org_admin") & F.col("revoked_at").isNull())
    enabled = active_users(state.users).select("user_id", F.lit(1).alias("_enabled"))
    marked = admins.select("org_id", "user_id", "membership_id").join(enabled, "user_id", "left")
    own = F.coalesce("_enabled", F.lit(0))
    totals = marked.groupBy("org_id").agg(F.sum(own).alias("_all"))
    return marked.join(totals, "org_id").select(
        "org_id", "membership_id", (F.col("_all") - own).cast("long").alias("other_admins")
    )


def last_admins(state: AccessState) -> DataFrame:
    """``org_id, _admins, _only_admin`` of organizations with at most one current admin membership of an
    enabled person: how many (0 or 1), and that one's id. These are the organizations in which a current
    admin membership can have no other beside it, so memberships need not meet their counts one by one."""
    admins = state.memberships.where((F.col("role") == "org_admin") & F.col("revoked_at").isNull())
    enabled = active_users(state.users).select("user_id", F.lit(1).alias("_enabled"))
    marked = admins.select("org_id", "user_id", "membership_id").join(enabled, "user_id", "left")
    totals = marked.groupBy("org_id").agg(
        F.sum(F.coalesce("_enabled", F.lit(0))).alias("_admins"), F.min(F.when(F.col("_enabled") == 1, F.col("membership_id"))).alias("_only_admin"))
    return written(totals.where(F.col("_admins") <= 1), "last-admins")
