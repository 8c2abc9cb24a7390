"""Queries over people, organizations, memberships, invitations and grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docwarden.functions import validation as V
from docwarden.functions.temporal import at
from docwarden.operators import access as A, admission, audit, caps, commands as K, constraints, migrations as M, outcomes as O
from docwarden.plans.registry import query
from docwarden.sources.derived import AS_OF, BATCH_AS_OF, EARLY, GRANTS_AS_OF, derive, read, state, with_tables

# Invisible characters that names may not contain.
ZERO_WIDTH, LINE_SEPARATOR, OVERRIDE = "\u200b", "\u2028", "\u202e"

_NOW = f"TIMESTAMP '{AS_OF}'"
_EARLY = f"TIMESTAMP '{EARLY}'"
_GNOW = f"TIMESTAMP '{GRANTS_AS_OF}'"

_AUTH = """
    active AS (select m.* from memberships m join users u on u.user_id = m.user_id join organizations o on o.org_id = m.org_id
        where m.revoked_at is null and u.disabled_at is null and not u.is_platform_admin and o.status = 'active'),
    auth AS (select org_id, user_id, bool_or(role = 'org_admin') as is_admin, bool_or(role in ('org_admin', 'point_person')) as is_inviter
        from active group by org_id, user_id)"""
_OPEN = "accepted_at is null and declined_at is null and revoked_at is null"


def _base(*extra: str) -> str:
    return f"{with_tables('users', 'organizations', 'memberships', *extra)}, {_AUTH}"


def _refusal(*rules: tuple[str, str, str]) -> str:
    """First matching refusal as ``code`` and ``reason`` columns."""
    def case(n):
        whens = " ".join("when coalesce({}, false) then '{}'".format(r[0], r[n].replace("'", "''")) for r in rules)
        return f"case {whens} end"
    return f"{case(1)} as refusal_code, {case(2)} as refusal_reason"


_DECISION = ("command_id", "accepted", "refusal_code", "refusal_reason")


# --- predicates and sets ---------------------------------------------------------------


@query("p1_users", f"""
    {with_tables('users')} select user_id, disabled_at is null as active, disabled_at is null and is_platform_admin as platform_admin from users""")
def users(spark, sf):
    people = derive(spark, sf, "users")
    active = F.col("disabled_at").isNull()
    return people.select("user_id", active.alias("active"), (active & F.col("is_platform_admin")).alias("platform_admin"))


@query("p18_s7_principals", f"""
    {with_tables('users')} select user_id, cognito_sub, email, display_name, is_platform_admin from users where disabled_at is null""")
def principals(spark, sf):
    return A.principals(derive(spark, sf, "users"))


@query("f4_active_memberships", f"{_base()} select membership_id, org_id, user_id, role from active")
def active_memberships(spark, sf):
    return A.active_memberships(state(spark, sf)).select("membership_id", "org_id", "user_id", "role")


@query("p2_j1_members_among", f"""
    {_base('invitations')} select invitation_id from invitations i
    where exists (select 1 from active a where a.org_id = i.org_id and a.user_id = i.invited_by and a.role in ('org_admin', 'point_person'))""")
def members_among(spark, sf):
    s = state(spark, sf)
    pairs = s.invitations.select("invitation_id", "org_id", F.col("invited_by").alias("user_id"))
    return A.members_among(pairs, s, A.INVITERS).select("invitation_id")


@query("p2_f5_j2_active_support", f"""
    {with_tables('users', 'organizations', 'support_grants')}
    select distinct g.org_id, g.support_user_id from support_grants g join organizations o on o.org_id = g.org_id join users u on u.user_id = g.support_user_id
    where g.revoked_at is null and g.starts_at <= {_GNOW} and g.expires_at > {_GNOW} and o.status = 'active' and u.disabled_at is null and u.is_platform_admin""")
def active_support(spark, sf):
    return A.active_support(state(spark, sf), GRANTS_AS_OF)


@query("p3_can_invite", f"""
    {_base('invitations')} select invitation_id, coalesce(case when role = 'org_admin' then is_admin else is_inviter end, false) as can_invite
    from invitations i left join auth a on a.org_id = i.org_id and a.user_id = i.invited_by""")
def can_invite(spark, sf):
    s = state(spark, sf)
    asked = s.invitations.select("invitation_id", "org_id", "role", F.col("invited_by").alias("user_id"))
    return A.can_invite(asked, s).select("invitation_id", "can_invite")


@query("f3_open_invitations", f"{with_tables('invitations')} select invitation_id from invitations where {_OPEN} and expires_at > {_NOW}")
def open_invitations(spark, sf):
    return derive(spark, sf, "invitations").where(A.invitation_is_open(AS_OF)).select("invitation_id")


@query("f6_visible_organizations", f"""
    {_base()} select u.user_id, u.is_platform_admin, case when u.is_platform_admin then (select count(*) from organizations)
        else (select count(*) from auth a where a.user_id = u.user_id) end as visible
    from users u where disabled_at is null""")
def visible_organizations(spark, sf):
    return A.visible_organization_counts(state(spark, sf))


@query("p16_t2_member_organizations", f"""
    {_base()} select a.user_id, o.org_id, o.legal_name, o.display_name, o.status, o.created_at, row_number() over (partition by a.user_id order by o.legal_name, o.org_id) as rank from auth a join organizations o on o.org_id = a.org_id""")
def member_organizations(spark, sf):
    return A.list_member_organizations(state(spark, sf))


@query("p16_j3_members", f"""
    {with_tables('users', 'memberships')} select m.org_id, m.membership_id, m.user_id, m.role, m.granted_at, u.email, u.display_name, row_number() over (partition by m.org_id order by u.email, m.role, m.membership_id) as rank
    from memberships m join users u on u.user_id = m.user_id where m.revoked_at is null""")
def members(spark, sf):
    return A.list_members(state(spark, sf))


@query("p16_j4_support_grants", f"""
    {with_tables('users', 'support_grants')} select g.org_id, g.grant_id, g.support_user_id, g.reason, g.starts_at, g.expires_at, g.revoked_at, u.email, row_number() over (partition by g.org_id order by g.starts_at desc, g.grant_id) as rank
    from support_grants g join users u on u.user_id = g.support_user_id""")
def support_grants(spark, sf):
    return A.list_support_grants(state(spark, sf))


@query("p16_j5_org_invitations", f"""
    {_base('invitations')} select i.org_id, invitation_id, u.email, i.role, s.email as invited_by_email, invited_at, expires_at,
        not exists (select 1 from active a where a.org_id = i.org_id and a.user_id = i.invited_by
            and (a.role = 'org_admin' or (i.role <> 'org_admin' and a.role = 'point_person'))) as stale, row_number() over (partition by i.org_id order by invited_at desc, invitation_id) as rank
    from invitations i join users u on u.user_id = i.invited_user_id join users s on s.user_id = i.invited_by
    where {_OPEN} and expires_at > {_NOW}""")
def org_invitations(spark, sf):
    return A.list_open_invitations(state(spark, sf), AS_OF)


@query("p16_j6_my_invitations", f"""
    {with_tables('users', 'organizations', 'invitations')}
    select i.invited_user_id, invitation_id, o.legal_name as org_legal_name, i.role, coalesce(s.display_name, s.email) as invited_by_name, invited_at, expires_at, row_number() over (partition by i.invited_user_id order by invited_at desc, invitation_id) as rank
    from invitations i join organizations o on o.org_id = i.org_id join users s on s.user_id = i.invited_by
    where o.status = 'active' and {_OPEN} and expires_at > {_NOW}""")
def my_invitations(spark, sf):
    return A.list_my_invitations(state(spark, sf), AS_OF)


_OTHERS = """
    admins AS (select m.org_id, m.membership_id, case when u.user_id is not null then 1 else 0 end as on_duty
        from memberships m left join users u on u.user_id = m.user_id and u.disabled_at is null where m.role = 'org_admin' and m.revoked_at is null),
    others AS (select org_id, membership_id, sum(on_duty) over (partition by org_id) - on_duty as other_admins from admins)"""


@query("j7_other_admins", f"""
    {with_tables('users', 'memberships')}, {_OTHERS} select org_id, membership_id, cast(other_admins as bigint) as other_admins from others""")
def other_admins(spark, sf):
    return A.other_admin_counts(state(spark, sf))


# --- data quality ------------------------------------------------------------------------

_FIELDS = f"""
    select c_custkey,
        case c_custkey % 8 when 0 then ' ' || c_name || '@example.org' when 1 then 'user@@x.org' when 2 then 'A.B+c@Sub.Example.ORG ' when 3 then 'no-dot@host'
            when 4 then 'sp ace@example.org' when 5 then '' when 6 then null else 'ok@example.org' end as email,
        case c_custkey % 5 when 0 then null when 1 then c_name || '{ZERO_WIDTH}' when 2 then 'bell' || chr(7) when 3 then 'line{LINE_SEPARATOR}' else c_name end as name,
        case c_custkey % 4 when 0 then 'org_admin' when 1 then 'owner' when 2 then null else 'contributor' end as role,
        case c_custkey % 3 when 0 then '  ' when 1 then 'because of ' || c_name else repeat('x', 600) end as reason,
        case c_custkey % 3 when 0 then '0000000A-0000-4000-8000-000000000001' when 1 then 'zz000000-0000-4000-8000-000000000001' else '1' end as id
    from {{customer}}"""
_STRICT = "^[a-z0-9.!#$%&''*+/=?^_`{|}~-]+@[a-z0-9-]+([.][a-z0-9-]+)+$"


@query("f9_f11_field_validation", f"""
    with f as ({_FIELDS.replace('{customer}', 'customer')}), e as (select *, lower(trim(email)) as m from f)
    select c_custkey, coalesce(length(m) <= 254 and regexp_matches(m, '{_STRICT}'), false) as strict_email,
        coalesce(regexp_full_match(m, '[^@ ]+@[^@ ]+[.][^@ ]+'), false) as contact_email,
        c_custkey % 5 in (0, 3, 4) as invitee_name, c_custkey % 5 in (0, 1, 3, 4) as stored_name, c_custkey % 5 in (0, 4) as operator_name,
        coalesce(role in ('org_admin', 'contributor'), false) as known_role, c_custkey % 3 > 0 as grant_reason, c_custkey % 3 = 1 as job_reason,
        c_custkey % 3 = 0 as uuid from e""")
def field_validation(spark, sf):
    f = spark.sql(_FIELDS, customer=read(spark, sf, "customer"))
    c = F.col
    return f.select(
        "c_custkey", V.valid_email(c("email")).alias("strict_email"), V.valid_contact_email(c("email")).alias("contact_email"),
        V.valid_display_name(c("name")).alias("invitee_name"), V.valid_display_name(c("name"), V.CONTROL).alias("stored_name"),
        V.valid_display_name(c("name"), V.INVISIBLE).alias("operator_name"), V.valid_role(c("role")).alias("known_role"),
        V.valid_grant_reason(c("reason")).alias("grant_reason"), V.valid_job_reason(c("reason")).alias("job_reason"), V.valid_uuid(c("id")).alias("uuid"),
    )


def _counts_sql(table: str, source: str, rules: dict[str, str]) -> str:
    return " union all ".join(
        f"select '{table}' as table_name, '{name}' as constraint_name, count(*) filter (where not ({rule})) as violations from {source}"
        for name, rule in rules.items()
    )


_BOTH = "(revoked_at is null) = (revoked_by is null)"
_CHECKS_SQL = " union all ".join([
    _counts_sql("users", "users", {"email_normalized": "email = lower(trim(email))", "email_not_empty": "email <> ''"}),
    _counts_sql("organizations", "organizations", {"legal_name_not_blank": "trim(legal_name) <> ''", "status_known": "status in ('active', 'suspended', 'closed')"}),
    _counts_sql("org_memberships", "memberships", {
        "role_known": "role in ('org_admin', 'point_person', 'contributor', 'budget_owner', 'authorized_approver')",
        "not_self_granted": "granted_by <> user_id", "revocation_complete": _BOTH, "revoked_after_granted": "revoked_at >= granted_at"}),
    _counts_sql("support_access_grants", "support_grants", {
        "reason_not_blank": "trim(reason) <> ''", "not_self_consented": "consented_by <> support_user_id",
        "length_in_range": "expires_at > starts_at and expires_at <= starts_at + interval 14 day", "revocation_complete": _BOTH}),
    _counts_sql("org_invitations", "invitations", {
        "role_known": "role in ('org_admin', 'point_person', 'contributor', 'budget_owner', 'authorized_approver')",
        "not_self_invited": "invited_by <> invited_user_id", "length_in_range": "expires_at > invited_at and expires_at <= invited_at + interval 14 day",
        "one_terminal_state": "(accepted_at is not null)::int + (declined_at is not null)::int + (revoked_at is not null)::int <= 1",
        "revocation_complete": _BOTH}),
])


@query("f12_constraint_violations", f"{with_tables('users', 'organizations', 'memberships', 'support_grants', 'invitations')} {_CHECKS_SQL}")
def constraint_violations(spark, sf):
    s = state(spark, sf)
    tables = {"users": s.users, "organizations": s.organizations, "org_memberships": s.memberships,
              "support_access_grants": s.support_grants, "org_invitations": s.invitations}
    out = None
    for name, df in tables.items():
        part = constraints.violations(df, name)
        out = part if out is None else out.unionByName(part)
    return out


@query("w6_duplicate_active_roles", f"""
    {with_tables('memberships')} select org_id, user_id, role, count(*) as copies from memberships where revoked_at is null
    group by org_id, user_id, role having count(*) > 1""")
def duplicate_active_roles(spark, sf):
    return constraints.duplicate_keys(derive(spark, sf, "memberships"), ["org_id", "user_id", "role"], F.col("revoked_at").isNull())


@query("w6_duplicate_open_invitations", f"""
    {with_tables('invitations')} select org_id, invited_user_id, role, count(*) as copies from invitations where {_OPEN}
    group by org_id, invited_user_id, role having count(*) > 1""")
def duplicate_open_invitations(spark, sf):
    return constraints.duplicate_keys(derive(spark, sf, "invitations"), ["org_id", "invited_user_id", "role"], A.invitation_is_open())


@query("f12_orphaned_references", f"""
    {with_tables('users', 'support_grants')} select grant_id from support_grants g
    where not exists (select 1 from users u where u.user_id = g.support_user_id)""")
def orphaned_references(spark, sf):
    s = state(spark, sf)
    return constraints.orphans(s.support_grants, "support_user_id", s.users, "user_id").select("grant_id")


# The tables with gaps: by the number in its first column, each row loses one value or refers to nobody.
_INTEGRITY = {
    "users": ("users", "user_id"), "organizations": ("organizations", "org_id"), "org_memberships": ("memberships", "membership_id"),
    "support_access_grants": ("support_grants", "grant_id"), "org_invitations": ("invitations", "invitation_id"), "audit_log": ("audit_log", "audit_id"),
}


def _with_gaps(table: str, source: str) -> str:
    first = _INTEGRITY[table][1]
    number = f"cast(substr({first}, 25, 12) as bigint)" if table in ("users", "organizations") else f"cast(split_part({first}, '-', 2) as bigint)"
    refers, needs = list(constraints.REFERENCES.get(table, {})), [c for c in constraints.required_columns(table) if c not in ("detail", "at")]
    columns = dict.fromkeys([*needs, *refers])

    def column(name):
        gap = f"when _n % 17 = {needs.index(name)} then null" if name in needs else ""
        nobody = f"when _n % 19 = {refers.index(name)} then 'nobody'" if name in refers else ""
        return f"case {gap} {nobody} else {name} end as {name}" if gap or nobody else name

    return f"select {', '.join(map(column, columns))} from (select *, {number} as _n from {source})"


def _integrity_sql() -> str:
    counts = []
    for table in _INTEGRITY:
        for column, parent in constraints.REFERENCES.get(table, {}).items():
            key = constraints.KEYS[parent]
            counts.append(f"select '{table}' as table_name, '{column}_references_{parent}' as constraint_name, count(*) as violations from x_{table} c "
                          f"where {column} is not null and not exists (select 1 from x_{parent} p where p.{key} = c.{column})")
        counts += [f"select '{table}' as table_name, '{c}_not_null' as constraint_name, count(*) as violations from x_{table} where {c} is null" for c in constraints.required_columns(table) if c not in ("detail", "at")]
    return " union all ".join(counts)


@query("f12_all_references", f"""
    {with_tables(*(source for source, _ in _INTEGRITY.values()))},
    {", ".join(f"x_{t} AS ({_with_gaps(t, s)})" for t, (s, _) in _INTEGRITY.items())} {_integrity_sql()}""")
def all_references(spark, sf):
    """Every reference and every NOT NULL column at once, over tables with gaps."""
    return constraints.integrity({
        table: spark.sql(_with_gaps(table, "{rows}"), rows=derive(spark, sf, source)) for table, (source, _) in _INTEGRITY.items()
    })


# --- caps ----------------------------------------------------------------------------------


@query("a3_cap_usage", f"""
    {with_tables('invitations')}, r AS (select * from invitations where invited_at > {_NOW} - interval 24 hour and invited_at <= {_NOW})
    select 'org' as scope, org_id as scope_id, count(*) as recent, cast(20 as bigint) as cap, count(*) >= 20 as reached from r group by org_id
    union all select 'sender', invited_by, count(*), 10, count(*) >= 10 from r group by invited_by
    union all select 'global', 'all', count(*), 30, count(*) >= 30 from r having count(*) > 0""")
def cap_usage(spark, sf):
    return caps.usage(derive(spark, sf, "invitations"), AS_OF)


def _rolling_sql(key: str) -> str:
    return f"""
    SELECT {key}, ts, count(*) as at_time, any_value(n) - count(*) as before from (
        select {key}, ts, count(*) over (partition by {key} order by ts range between interval 86399999999 microseconds preceding and current row) as n
        from (select *, 'all' as everyone from events)) group by {key}, ts"""


@query("w2_a3_rolling_by_sender", _rolling_sql("user_id"))
def rolling_by_sender(spark, sf):
    return caps.rolling_counts(read(spark, sf, "events"), "user_id", "ts")


@query("w2_a3_rolling_overall", _rolling_sql("everyone"))
def rolling_overall(spark, sf):
    return caps.rolling_counts(read(spark, sf, "events").withColumn("everyone", F.lit("all")), "everyone", "ts")


@query("a3_cap_breaches", f"""
    select everyone, ts, at_time, before, least(at_time, greatest(0, before + at_time - 300)) as over
    from ({_rolling_sql('everyone')}) where before + at_time > 300""")
def cap_breaches(spark, sf):
    rows = read(spark, sf, "events").withColumn("everyone", F.lit("all"))
    return caps.cap_breaches(rows, "everyone", "ts", 300)


# --- organizations ---------------------------------------------------------------------------


@query("p4_u9_create_organizations", f"""
    {with_tables('users', 'requests')},
    c AS (select *, case line when 1 then ' ' else 'Org ' || command_id end as legal_name, case line when 2 then 'paused' when 3 then 'suspended' end as status from requests),
    j AS (select c.*, coalesce(u.disabled_at is null and u.is_platform_admin, false) as staff, coalesce(trim(system_job) <> '', false) as job
          from c left join users u on u.user_id = c.actor),
    d AS (select *, {_refusal(
        ("actor is null", "insufficient_privilege", K.NO_ACTOR),
        ("not job and not staff", "insufficient_privilege", "only a platform admin can create an organization"),
        ("trim(legal_name) = ''", "check_violation", "legal name must not be blank"),
        ("job and status is not null and status not in ('active', 'suspended', 'closed')", "check_violation", "unknown status"))} from j)
    select command_id, refusal_code is null as accepted, refusal_code, refusal_reason,
        substr(sha256('org' || chr(31) || command_id), 1, 32) as org_id, case when job then coalesce(status, 'active') else 'active' end as new_status from d""")
def create_organizations(spark, sf):
    line = F.col("line")
    c = derive(spark, sf, "requests").select(
        "command_id", "actor", "system_job",
        F.when(line == 1, " ").otherwise(F.concat(F.lit("Org "), "command_id")).alias("legal_name"), F.lit(None).cast("string").alias("display_name"),
        F.when(line == 2, "paused").when(line == 3, "suspended").alias("status"), F.lit(None).cast("string").alias("billing_account_id"),
    )
    return K.create_organizations(c, state(spark, sf), AS_OF).select(*_DECISION, "org_id", "new_status")


_ORG_CHANGES = """
    select r.command_id, r.actor, r.system_job, r.org_id,
        case when quantity = 1 then 'elsewhere' else r.org_id end as new_org_id,
        o.created_by as new_created_by,
        case when line = 1 then 'Renamed' else o.legal_name end as new_legal_name,
        case when line in (2, 3) then 'Shown' else o.display_name end as new_display_name,
        case when line = 4 then 'suspended' when line = 5 then 'active' when line = 6 and quantity > 40 then 'weird' else o.status end as new_status,
        case when line = 7 then 'bill-x' else o.billing_account_id end as new_billing_account_id
    from {requests} r left join {organizations} o on o.org_id = r.org_id"""


@query("p4_f7_update_organizations", f"""
    {_base('requests')}, c AS ({_ORG_CHANGES.replace('{requests}', 'requests').replace('{organizations}', 'organizations')}),
    j AS (select c.*, o.org_id is not null as found, o.legal_name, o.display_name, o.status, o.billing_account_id, o.created_by,
            coalesce(u.disabled_at is null and u.is_platform_admin, false) as staff, coalesce(a.is_admin, false) as boss, coalesce(trim(system_job) <> '', false) as job
        from c left join organizations o on o.org_id = c.org_id left join users u on u.user_id = c.actor
        left join auth a on a.org_id = c.org_id and a.user_id = c.actor),
    d AS (select command_id, {_refusal(
        ("not found", "not_found", "no such organization"),
        ("new_org_id <> org_id", "insufficient_privilege", "organization identity fields cannot change"),
        ("not job and new_legal_name <> legal_name", "insufficient_privilege", "legal name changes need the privileged path"),
        ("new_status is distinct from status and status = 'closed'", "check_violation", "a closed organization cannot be reopened"),
        ("not job and new_status is distinct from status and actor is null", "insufficient_privilege", K.NO_ACTOR),
        ("not job and new_status is distinct from status and not staff", "insufficient_privilege", "only a platform admin can change an organization's status"),
        ("not job and new_display_name is distinct from display_name and actor is null", "insufficient_privilege", K.NO_ACTOR),
        ("not job and new_display_name is distinct from display_name and not boss", "insufficient_privilege", "only an org admin can rename the organization"),
        ("not job and new_billing_account_id is distinct from billing_account_id", "insufficient_privilege", "billing can only be changed by the privileged path"),
        ("trim(new_legal_name) = ''", "check_violation", "legal name must not be blank"),
        ("new_status not in ('active', 'suspended', 'closed')", "check_violation", "unknown status"))} from j)
    select command_id, refusal_code is null as accepted, refusal_code, refusal_reason from d""")
def update_organizations(spark, sf):
    s = state(spark, sf)
    c = spark.sql(_ORG_CHANGES, requests=derive(spark, sf, "requests"), organizations=s.organizations)
    return K.update_organizations(c, s).select(*_DECISION)


# --- memberships -------------------------------------------------------------------------------

_ACCEPT_FACTS = f"""
    inv AS (select invitation_id, org_id as iorg, invited_user_id as iuser, role as irole, invited_by as iby from invitations where {_OPEN} and expires_at > {_NOW}),
    held AS (select distinct org_id, user_id, role from memberships where revoked_at is null),
    j AS (select c.*, coalesce(trim(system_job) <> '', false) as job, o.status as org_status,
            coalesce(u.disabled_at is null, false) and u.user_id is not null as me_active, coalesce(u.disabled_at is null and u.is_platform_admin, false) as me_staff,
            coalesce(i.iorg = c.org_id and i.iuser = c.user_id and i.irole = c.role and c.user_id = c.actor, false) as match, i.iby,
            coalesce(case when c.role = 'org_admin' then a.is_admin else a.is_inviter end, false) as by_can, h.org_id is not null as held
        from acceptances c left join organizations o on o.org_id = c.org_id left join users u on u.user_id = c.actor
        left join inv i on i.invitation_id = c.accepting_invitation left join auth a on a.org_id = c.org_id and a.user_id = i.iby
        left join held h on h.org_id = c.org_id and h.user_id = c.user_id and h.role = c.role),
    d AS (select *, case when match then iby else actor end as granter, {_refusal(
        ("actor is null", "insufficient_privilege", K.NO_ACTOR),
        ("revoked_at is not null", "check_violation", "a new membership cannot start revoked"),
        ("match and (org_status is distinct from 'active' or not me_active or me_staff or not by_can)", "insufficient_privilege", K.STALE_INVITATION),
        ("not match and not job", "insufficient_privilege", "memberships are created by accepting an invitation"),
        ("case when match then iby else actor end = user_id", "check_violation", "nobody grants themselves a membership"),
        ("held", "unique_violation", "that role is already held"))} from j)"""


@query("p5_insert_memberships", f"""
    {_base('invitations', 'acceptances')}, {_ACCEPT_FACTS}
    select command_id, refusal_code is null as accepted, refusal_code, refusal_reason, case when refusal_code is null then granter end as granted_by,
        case when refusal_code is null and match then accepting_invitation end as closes_invitation from d""")
def insert_memberships(spark, sf):
    done = K.insert_memberships(derive(spark, sf, "acceptances"), state(spark, sf), AS_OF)
    return done.select(*_DECISION, "granted_by", "closes_invitation")


@query("p6_close_accepted", f"""
    {_base('invitations', 'acceptances')}, {_ACCEPT_FACTS},
    joined AS (select distinct org_id, user_id, role, granter from d where refusal_code is null)
    select i.invitation_id, case when n.org_id is not null and {_OPEN} and expires_at > {_NOW} then {_NOW} else accepted_at end as accepted_at
    from invitations i left join joined n on n.org_id = i.org_id and n.user_id = i.invited_user_id and n.role = i.role and n.granter = i.invited_by""")
def close_accepted(spark, sf):
    s = state(spark, sf)
    new = K.insert_memberships(derive(spark, sf, "acceptances"), s, AS_OF).where("accepted")
    return K.close_accepted(s.invitations, new, AS_OF).select("invitation_id", "accepted_at")


_REVOKES = """
    select 'v-' || membership_id as command_id, membership_id,
        case when membership_id like '%-9' then 'elsewhere' else org_id end as org_id,
        case when membership_id like '%3' then null when membership_id like '%4' or membership_id like '%5' then user_id else granted_by end as actor,
        case when membership_id like '%8' then 'recovery' end as system_job
    from {memberships}"""


@query("p5_u8_revoke_memberships", f"""
    {_base()}, {_OTHERS}, c AS ({_REVOKES.replace('{memberships}', 'memberships')}),
    j AS (select c.*, m.membership_id is not null as found, m.user_id as member, m.role, m.revoked_at, u.user_id is not null and u.disabled_at is null as me_active,
            coalesce(a.is_admin, false) as boss, coalesce(trim(system_job) <> '', false) as job, x.other_admins
        from c left join memberships m on m.membership_id = c.membership_id and m.org_id = c.org_id left join users u on u.user_id = c.actor
        left join auth a on a.org_id = c.org_id and a.user_id = c.actor left join others x on x.membership_id = c.membership_id),
    d AS (select command_id, {_refusal(
        ("actor is null", "insufficient_privilege", K.NO_ACTOR),
        ("not found", "not_found", "No such membership in this organization."),
        ("revoked_at is not null", "check_violation", "membership already revoked; grant a new one instead"),
        ("not job and not (boss or (member = actor and me_active))", "insufficient_privilege", "not allowed to remove this membership"),
        ("not job and role = 'org_admin' and other_admins = 0", "check_violation", "an organization must keep at least one active admin"))} from j)
    select command_id, refusal_code is null as accepted, refusal_code, refusal_reason from d""")
def revoke_memberships(spark, sf):
    return _revocations(spark, sf).select(*_DECISION)


def _revocations(spark, sf) -> DataFrame:
    s = state(spark, sf)
    return K.revoke_memberships(spark.sql(_REVOKES, memberships=s.memberships), s)


@query("p19_refusal_status", f"""
    {_base()}, {_OTHERS}, c AS ({_REVOKES.replace('{memberships}', 'memberships')}),
    j AS (select c.*, m.membership_id is not null as found, m.user_id as member, m.role, m.revoked_at, u.user_id is not null and u.disabled_at is null as me_active,
            coalesce(a.is_admin, false) as boss, coalesce(trim(system_job) <> '', false) as job, x.other_admins
        from c left join memberships m on m.membership_id = c.membership_id and m.org_id = c.org_id left join users u on u.user_id = c.actor
        left join auth a on a.org_id = c.org_id and a.user_id = c.actor left join others x on x.membership_id = c.membership_id),
    s AS (select case when actor is null then 403 when not found then 404 when revoked_at is not null then 409
        when not job and not (boss or coalesce(member = actor and me_active, false)) then 403
        when not job and role = 'org_admin' and other_admins = 0 then 409 else 204 end as http_status from j)
    select cast(http_status as bigint) as http_status, count(*) as commands from s group by http_status""")
def refusal_status(spark, sf):
    done = _revocations(spark, sf).withColumn("http_status", O.refusal_status(F.col("refusal_code")))
    return done.groupBy("http_status").agg(F.count("*").alias("commands"))


# --- support access ------------------------------------------------------------------------------

_GRANT_COMMANDS = """
    select command_id, actor, org_id,
        case when quantity > 48 then actor else '0000000a-0000-4000-8000-' || lpad(cast(part - part % 25 as string), 12, '0') end as support_user_id,
        case when quantity = 2 then ' ' else 'ticket' end as reason,
        case when line = 1 then null else at end as starts_at,
        case when line % 2 = 0 then at + interval 10 day else greatest(at, TIMESTAMP_NTZ '1998-09-01 00:00:00') + interval 15 day end as expires_at
    from {requests}"""
_GRANT_COMMANDS_SQL = _GRANT_COMMANDS.replace("{requests}", "requests").replace("TIMESTAMP_NTZ", "TIMESTAMP").replace(" at ", ' "at" ').replace("(at,", '("at",')


@query("p7_grant_support", f"""
    {_base('requests')}, c AS ({_GRANT_COMMANDS_SQL}),
    j AS (select c.*, o.status, coalesce(a.is_admin, false) as boss, coalesce(u.disabled_at is null and u.is_platform_admin, false) as staff,
            greatest(coalesce(starts_at, {_GNOW}), {_GNOW}) as starts
        from c left join organizations o on o.org_id = c.org_id left join auth a on a.org_id = c.org_id and a.user_id = c.actor left join users u on u.user_id = c.support_user_id),
    d AS (select *, {_refusal(
        ("actor is null", "insufficient_privilege", K.NO_ACTOR),
        ("status is distinct from 'active'", "check_violation", K.ORG_INACTIVE),
        ("not boss", "insufficient_privilege", "only an org admin can grant support access"),
        ("support_user_id = actor", "insufficient_privilege", "you cannot grant support access to yourself"),
        ("not staff", "check_violation", "support access can only go to an active platform admin"),
        ("trim(reason) = ''", "check_violation", "a reason is required"),
        ("expires_at <= starts or expires_at > starts + interval 14 day", "check_violation", "support access lasts at most 14 days"))} from j)
    select command_id, refusal_code is null as accepted, refusal_code, refusal_reason, starts as starts_at_effective from d""")
def grant_support(spark, sf):
    c = spark.sql(_GRANT_COMMANDS, requests=derive(spark, sf, "requests"))
    return K.grant_support(c, state(spark, sf), GRANTS_AS_OF).select(*_DECISION, "starts_at_effective")


_SUPPORT_REVOKES = """
    select 'w-' || grant_id as command_id, grant_id, case when grant_id like '%-9' then 'elsewhere' else org_id end as org_id,
        case when grant_id like '%3' then null when grant_id like '%4' then support_user_id else consented_by end as actor,
        case when grant_id like '%8' then 'recovery' end as system_job
    from {support_grants}"""


@query("p7_u8_revoke_support", f"""
    {_base('support_grants')}, c AS ({_SUPPORT_REVOKES.replace('{support_grants}', 'support_grants')}),
    j AS (select c.*, g.grant_id is not null as found, g.support_user_id as staff, g.revoked_at, coalesce(a.is_admin, false) as boss, coalesce(trim(system_job) <> '', false) as job
        from c left join support_grants g on g.grant_id = c.grant_id and g.org_id = c.org_id left join auth a on a.org_id = c.org_id and a.user_id = c.actor),
    d AS (select command_id, {_refusal(
        ("actor is null", "insufficient_privilege", K.NO_ACTOR),
        ("not found", "not_found", "No such support grant in this organization."),
        ("revoked_at is not null", "check_violation", "support grant already revoked"),
        ("not (boss or coalesce(staff = actor, false) or job)", "insufficient_privilege", "not allowed to revoke this support grant"))} from j)
    select command_id, refusal_code is null as accepted, refusal_code, refusal_reason from d""")
def revoke_support(spark, sf):
    s = state(spark, sf)
    return K.revoke_support(spark.sql(_SUPPORT_REVOKES, support_grants=s.support_grants), s).select(*_DECISION)


# --- invitations ---------------------------------------------------------------------------------

_GATE_FACTS = f"""
    recent AS (select * from invitations where invited_at > {_EARLY} - interval 24 hour and invited_at <= {_EARLY}),
    by_org AS (select org_id, count(*) as n from recent group by org_id), by_sender AS (select invited_by, count(*) as n from recent group by invited_by)"""
_GATE_JOIN = """
    left join users u on u.user_id = c.actor left join auth a on a.org_id = c.org_id and a.user_id = c.actor
    left join by_org bo on bo.org_id = c.org_id left join by_sender bs on bs.invited_by = c.actor"""
_GATE_COLUMNS = """u.user_id is not null and u.disabled_at is null as me_active, coalesce(u.disabled_at is null and u.is_platform_admin, false) as me_staff,
    coalesce(case when c.role = 'org_admin' then a.is_admin else a.is_inviter end, false) as may, bo.n as org_n, bs.n as sender_n, (select count(*) from recent) as all_n"""
_ROLE_LIST = "('org_admin', 'point_person', 'contributor', 'budget_owner', 'authorized_approver')"
_GATE_RULES = (
    ("actor is null", "insufficient_privilege", K.NO_ACTOR),
    ("not me_active or me_staff", "insufficient_privilege", K.MAY_NOT_INVITE),
    (f"role is null or role not in {_ROLE_LIST}", "invalid_parameter_value", "unknown role"),
    ("not may", "insufficient_privilege", K.MAY_NOT_INVITE),
    ("org_n >= 20", "invitation_cap", "too many invitations today for this organization"),
    ("sender_n >= 10", "invitation_cap", "you have sent too many invitations today"),
    ("all_n >= 30", "invitation_cap", "invitations are limited right now; try again later"),
)


@query("p8_invitation_gate", f"""
    {_base('invitations', 'requests')}, {_GATE_FACTS}, j AS (select c.*, {_GATE_COLUMNS} from requests c {_GATE_JOIN}),
    d AS (select command_id, {_refusal(*_GATE_RULES)} from j)
    select command_id, refusal_code is null as accepted, refusal_code, refusal_reason from d""")
def invitation_gate(spark, sf):
    c = derive(spark, sf, "requests").select("command_id", "actor", "org_id", "role")
    return K.invitation_gate(c, state(spark, sf), EARLY).select(*_DECISION)


# A time at which no cap is reached; the batch below crosses them.
_BNOW = f"TIMESTAMP '{BATCH_AS_OF}'"


@query("p9_invite", f"""
    {_base('invitations', 'invites')}, {_GATE_FACTS.replace(_EARLY, _BNOW)},
    n AS (select *, lower(trim(email)) as mail, lower(account_id) as acct from invites),
    opened AS (select org_id, invited_user_id, role, arg_max(invitation_id, (invited_at, invitation_id)) as invitation_id,
        arg_max(expires_at, (invited_at, invitation_id)) as until from invitations where {_OPEN} group by org_id, invited_user_id, role),
    j AS (select c.*, t.user_id as target, me.email as my_email, k.cognito_sub is not null as taken, o.invitation_id as open_id, o.until, {_GATE_COLUMNS}
        from n c left join users t on t.email = c.mail left join users me on me.user_id = c.actor left join users k on k.cognito_sub = c.acct
        left join opened o on o.org_id = c.org_id and o.invited_user_id = t.user_id and o.role = c.role {_GATE_JOIN}),
    d AS (select *, {_refusal(
        *_GATE_RULES,
        ("length(mail) > 254 or not regexp_matches(mail, '" + _STRICT.replace("''", "''''") .replace("''''", "''") + "')", "invalid_parameter_value", "that is not a valid email address"),
        ("contains(display_name, chr(7))", "invalid_parameter_value", "that name is not acceptable"),
        ("mail = my_email", "insufficient_privilege", "you cannot invite yourself"),
        ("target is null and account_id is null", "account_needed", "account_needed"),
        ("target is null and acct = 'not-an-id'", "invalid_parameter_value", "invalid account id"),
        ("target is null and taken", "check_violation", "that account could not be set up"))} from j)
    select command_id, refusal_code is null as accepted, refusal_code, refusal_reason, mail as invited_email,
        case when refusal_code is null then case when open_id is null then 'created' when until > {_BNOW} then 'existing' else 'renewed' end end as result,
        case when refusal_code is null then coalesce(open_id, substr(sha256('invitation' || chr(31) || command_id), 1, 32)) end as invitation_id,
        case when refusal_code is null then target is null end as new_user from d""")
def invite(spark, sf):
    done = K.invite(derive(spark, sf, "invites"), state(spark, sf), BATCH_AS_OF)
    return done.select(*_DECISION, "invited_email", "result", "invitation_id", "new_user")


_BAD_MAIL = f"length(mail) > 254 or not regexp_matches(mail, '{_STRICT}')"


def _after(written: str) -> tuple[tuple[str, str, str], ...]:
    """The refusals of a command that are not its own alone, after the list of structs ``written``."""
    def count(condition):
        return f"len(list_filter({written}, lambda x: {condition}))"

    unknown = f"(target is null and {count('x.fresh and x.mail = f.mail')} = 0)"
    return (
        (f"coalesce(org_n, 0) + {count('x.org_id = f.org_id')} >= 20", "invitation_cap", "too many invitations today for this organization"),
        (f"coalesce(sender_n, 0) + {count('x.actor = f.actor')} >= 10", "invitation_cap", "you have sent too many invitations today"),
        (f"all_n + len({written}) >= 30", "invitation_cap", "invitations are limited right now; try again later"),
        (_BAD_MAIL, "invalid_parameter_value", "that is not a valid email address"),
        ("contains(display_name, chr(7))", "invalid_parameter_value", "that name is not acceptable"),
        ("mail = my_email", "insufficient_privilege", "you cannot invite yourself"),
        (f"{unknown} and account_id is null", "account_needed", "account_needed"),
        (f"{unknown} and acct = 'not-an-id'", "invalid_parameter_value", "invalid account id"),
        (f"{unknown} and (taken or {count('x.fresh and x.acct = f.acct')} > 0)", "check_violation", "that account could not be set up"),
    )


def _ours(written: str) -> str:
    """The invitation that an earlier command of the batch opened for the same organization, person and role."""
    return (f"list_filter({written}, lambda x: x.org_id = f.org_id and x.role = f.role and (x.user_id = f.target or x.fresh and x.mail = f.mail))[1].invitation_id")


_WRITES = " and ".join(f"not coalesce({rule[0]}, false)" for rule in _after("s.w"))
_PRIOR = "list_filter(l.w, lambda x: x.seq < f.seq)"


@query("p9_u7_invite_batch", f"""
    {with_tables('users', 'organizations', 'memberships', 'batch', 'batch_invitations', recursive=True)}, {_AUTH},
    {_GATE_FACTS.replace(_EARLY, _BNOW).replace('from invitations', 'from batch_invitations')},
    opened AS (select org_id, invited_user_id, role, arg_max(invitation_id, (invited_at, invitation_id)) as invitation_id,
        arg_max(expires_at, (invited_at, invitation_id)) as until from batch_invitations where {_OPEN} group by org_id, invited_user_id, role),
    n AS (select *, lower(trim(email)) as mail, lower(account_id) as acct from batch),
    j AS (select c.*, t.user_id as target, me.email as my_email, k.cognito_sub is not null as taken, o.invitation_id as open_id, o.until, {_GATE_COLUMNS}
        from n c left join users t on t.email = c.mail left join users me on me.user_id = c.actor left join users k on k.cognito_sub = c.acct
        left join opened o on o.org_id = c.org_id and o.invited_user_id = t.user_id and o.role = c.role {_GATE_JOIN}),
    f AS MATERIALIZED (select *, {_refusal(*_GATE_RULES[:4])}, substr(sha256('invitation' || chr(31) || command_id), 1, 32) as own_id from j),
    fit AS MATERIALIZED (select * from f where refusal_code is null),
    steps AS (
        select 0 as n, '' as last, cast([] as struct(seq varchar, org_id varchar, actor varchar, role varchar, mail varchar, acct varchar, user_id varchar, fresh boolean, invitation_id varchar)[]) as w
        union all
        select n + 1, min(f.seq), list_append(any_value(s.w), arg_min(struct_pack(seq := f.seq, org_id := f.org_id, actor := f.actor, role := f.role, mail := f.mail, acct := f.acct,
            user_id := f.target, fresh := f.target is null and len(list_filter(s.w, lambda x: x.fresh and x.mail = f.mail)) = 0, invitation_id := coalesce(f.open_id, f.own_id)), f.seq))
        from steps s, fit f where f.seq > s.last and {_WRITES} and {_ours('s.w')} is null and not coalesce(f.until > {_BNOW}, false) group by n),
    l AS (select arg_max(w, n) as w from steps),
    d AS (select f.* exclude (refusal_code, refusal_reason), coalesce(f.refusal_code, x.refusal_code) as refusal_code, coalesce(f.refusal_reason, x.refusal_reason) as refusal_reason, x.ours, x.known
        from f, lateral (select {_refusal(*_after(_PRIOR))}, {_ours(_PRIOR)} as ours,
            f.target is not null or len(list_filter({_PRIOR}, lambda x: x.fresh and x.mail = f.mail)) > 0 as known from l) x)
    select command_id, refusal_code is null as accepted, refusal_code, refusal_reason, mail as invited_email,
        case when refusal_code is null then case when ours is not null or until > {_BNOW} then 'existing' when open_id is null then 'created' else 'renewed' end end as result,
        case when refusal_code is null then coalesce(ours, open_id, own_id) end as invitation_id,
        case when refusal_code is null then not known end as new_user,
        case when refusal_code is null then case when ours is null and until > {_BNOW} then until else {_BNOW} + interval 14 day end end as expires_at from d""")
def invite_batch(spark, sf):
    """The batch in its order, each command after what the ones before it wrote."""
    s = state(spark, sf)
    s = A.AccessState(s.users, s.organizations, s.memberships, s.support_grants, derive(spark, sf, "batch_invitations"))
    done = admission.admit(derive(spark, sf, "batch"), s, BATCH_AS_OF)
    return done.select(*_DECISION, "invited_email", "result", "invitation_id", "new_user", "expires_at")


_ANSWERS = """
    select 'x-' || invitation_id as command_id, invitation_id, case when invitation_id like '%6' then null when invitation_id like '%5' then invited_by
        else invited_user_id end as actor from {invitations}"""
_ANSWERS_SQL = _ANSWERS.replace("{invitations}", "invitations")


def _one_answer(columns: str = "") -> str:
    return f"""select command_id, code is null as accepted, code as refusal_code,
        case code when 'no_such_invitation' then 'no such invitation' when 'insufficient_privilege' then '{K.NO_ACTOR}' end as refusal_reason{columns} from d"""


@query("p10_w5_accept_invitations", f"""
    {_base('invitations')}, c AS ({_ANSWERS_SQL}), held AS (select distinct org_id, user_id, role from memberships where revoked_at is null),
    j AS (select c.*, i.org_id, i.role, i.invited_by, i.invited_user_id = c.actor and {_OPEN.replace('revoked_at', 'i.revoked_at')} and expires_at > {_NOW} and o.status = 'active'
            and u.disabled_at is null and not u.is_platform_admin and coalesce(case when i.role = 'org_admin' then a.is_admin else a.is_inviter end, false)
            and h.org_id is null as fine
        from c join invitations i on i.invitation_id = c.invitation_id left join organizations o on o.org_id = i.org_id left join users u on u.user_id = c.actor
        left join auth a on a.org_id = i.org_id and a.user_id = i.invited_by left join held h on h.org_id = i.org_id and h.user_id = c.actor and h.role = i.role),
    d AS (select *, case when actor is null then 'insufficient_privilege' when not coalesce(fine, false) then 'no_such_invitation' end as code from j)
    {_one_answer(", case when code is null then role end as role, case when code is null then invited_by end as granted_by")}""")
def accept_invitations(spark, sf):
    s = state(spark, sf)
    done = K.accept_invitations(spark.sql(_ANSWERS, invitations=s.invitations), s, AS_OF)
    return done.select(*_DECISION, "role", "granted_by")


@query("p10_decline_invitations", f"""
    {with_tables('users', 'invitations')}, c AS ({_ANSWERS_SQL}),
    d AS (select c.command_id, case when c.actor is null then 'insufficient_privilege'
        when not coalesce(i.invited_user_id = c.actor and {_OPEN} and expires_at > {_NOW} and u.user_id is not null and u.disabled_at is null, false) then 'no_such_invitation' end as code
        from c join invitations i on i.invitation_id = c.invitation_id left join users u on u.user_id = c.actor) {_one_answer()}""")
def decline_invitations(spark, sf):
    s = state(spark, sf)
    return K.decline_invitations(spark.sql(_ANSWERS, invitations=s.invitations), s, AS_OF).select(*_DECISION)


_WITHDRAWALS = """
    select 'y-' || invitation_id as command_id, invitation_id, case when invitation_id like '%6' then null when invitation_id like '%5' then invited_user_id
        else invited_by end as actor from {invitations}"""


@query("p10_revoke_invitations", f"""
    {_base('invitations')}, c AS ({_WITHDRAWALS.replace('{invitations}', 'invitations')}),
    d AS (select c.command_id, case when c.actor is null then 'insufficient_privilege'
        when not ({_OPEN} and (coalesce(a.is_admin, false) or (i.invited_by = c.actor and coalesce(a.is_inviter, false)))) then 'no_such_invitation' end as code
        from c join invitations i on i.invitation_id = c.invitation_id left join auth a on a.org_id = i.org_id and a.user_id = c.actor) {_one_answer()}""")
def revoke_invitations(spark, sf):
    s = state(spark, sf)
    return K.revoke_invitations(spark.sql(_WITHDRAWALS, invitations=s.invitations), s).select(*_DECISION)


@query("p11_invitation_updates", f"""
    {with_tables('invitations')}, k AS (select *, cast(split_part(invitation_id, '-', 2) as bigint) % 6 as kind from invitations),
    d AS (select invitation_id, {_refusal(
        ("kind = 2 and role <> 'contributor'", "insufficient_privilege", "only the status of an invitation may change"),
        ("not (" + _OPEN + ")", "check_violation", "that invitation is closed"),
        (f"kind = 3 and invited_at <> {_NOW} and expires_at > {_NOW}", "check_violation", "only an expired open invitation can be renewed"),
        ("kind = 4", "insufficient_privilege", "only the status of an invitation may change"),
        ("kind = 5 and invited_by <> invited_user_id", "insufficient_privilege", "only the status of an invitation may change"))} from k)
    select invitation_id, refusal_code is null as accepted, refusal_code, refusal_reason from d""")
def invitation_updates(spark, sf):
    """Each invitation changed in one of five ways, or accepted."""
    inv = derive(spark, sf, "invitations")
    kind = F.split_part("invitation_id", F.lit("-"), F.lit(2)).cast("long") % 6
    now = at(AS_OF)
    changes = {
        "accepted_at": F.when(kind == 1, now).otherwise(F.col("accepted_at")),
        "role": F.when(kind == 2, "contributor").otherwise(F.col("role")),
        "invited_at": F.when(kind == 3, now).otherwise(F.col("invited_at")),
        "expires_at": F.when(kind == 4, F.col("expires_at") + F.expr("interval 1 day")).otherwise(F.col("expires_at")),
        "invited_by": F.when(kind == 5, F.col("invited_user_id")).otherwise(F.col("invited_by")),
    }
    new = F.struct(*[changes.get(c, F.col(c)).alias(c) for c in inv.columns])
    judged = K.check_invitation_updates(inv.select(F.struct(*inv.columns).alias("old"), new.alias("new")), AS_OF)
    return judged.select("old.invitation_id", "accepted", "refusal_code", "refusal_reason")


# --- operator commands -------------------------------------------------------------------------------

_NEW_USERS = f"""
    select c_custkey as command_id,
        case c_custkey % 6 when 0 then ' 0000000B-0000-4000-8000-' || lpad(cast(c_custkey as string), 12, '0') when 1 then 'nonsense'
            else '0000000e-0000-4000-8000-' || lpad(cast(c_custkey as string), 12, '0') end as cognito_sub,
        case when c_custkey % 6 in (0, 2) then replace(c_name, '#', '-') || '@Example.org ' when c_custkey % 6 = 3 then 'not mail'
            else 'fresh-' || c_custkey || '@example.org' end as email,
        case when c_custkey % 7 = 0 then 'x{ZERO_WIDTH}' else c_name end as display_name,
        c_custkey % 4 = 0 as platform_admin,
        case when c_custkey % 8 = 0 then 'customer-000000050@example.org' when c_custkey % 8 = 4 and c_custkey % 3 = 0 then 'nobody@example.org' end as operator_email,
        case when c_custkey % 9 = 0 then ' ' else 'set up' end as reason
    from {{customer}}"""


@query("p17_create_users", f"""
    {with_tables('users')}, c AS ({_NEW_USERS.replace('{customer}', 'customer')}),
    n AS (select *, lower(trim(cognito_sub)) as sub, lower(trim(email)) as mail from c),
    j AS (select n.*, e.user_id as e_user, s.user_id as s_user, coalesce(e.cognito_sub = n.sub and e.is_platform_admin = n.platform_admin, false) as same,
            op.user_id as op_user, (select count(*) from users where is_platform_admin and disabled_at is null) > 0 as any_admin
        from n left join users e on e.email = n.mail left join users s on s.cognito_sub = n.sub
        left join users op on op.email = lower(trim(n.operator_email)) and op.is_platform_admin and op.disabled_at is null),
    d AS (select *, {_refusal(
        ("not regexp_full_match(sub, '[0-9a-f]+-[0-9a-f]+-[0-9a-f]+-[0-9a-f]+-[0-9a-f]+')", "invalid_parameter_value", "--cognito-sub must be the user's UUID from the Cognito console"),
        ("mail = 'not mail'", "invalid_parameter_value", "not a plain email address"),
        ("contains(display_name, '" + ZERO_WIDTH + "')", "invalid_parameter_value", "--display-name is too long or has control characters"),
        ("not same and platform_admin and any_admin and operator_email is null", "insufficient_privilege", "a platform admin already exists, so creating another needs --as <an active platform admin>"),
        ("not same and platform_admin and operator_email is not null and op_user is null", "insufficient_privilege", "--as is not an active platform admin"),
        ("not same and trim(reason) = ''", "invalid_parameter_value", "--reason must be a short sentence"),
        ("not same and (e_user is not null or s_user is not null)", "unique_violation", "that email or Cognito sub already belongs to a different account; nothing changed"))} from j)
    select command_id, refusal_code is null as accepted, refusal_code, refusal_reason, case when refusal_code is null then case when same then 'exists' else 'created' end end as result from d""")
def create_users(spark, sf):
    c = spark.sql(_NEW_USERS, customer=read(spark, sf, "customer"))
    return K.create_users(c, state(spark, sf)).select(*_DECISION, "result")


_NEW_ORGS = f"""
    select p_partkey as command_id,
        case p_partkey % 5 when 0 then ' supplier#' || lpad(cast(p_partkey as string), 9, '0') when 1 then 'shared name' when 2 then ' ' when 3 then 'bad{OVERRIDE}'
            else p_name || ' ' || p_partkey end as legal_name,
        case when p_partkey % 3 = 0 then 'nobody@example.org' else 'Customer-000000050@example.org' end as operator_email,
        case when p_partkey % 7 = 0 then '' else 'contract' end as reason
    from {{part}}"""


@query("p17_create_orgs", f"""
    {with_tables('users', 'organizations')}, c AS (select *, lower(trim(legal_name)) as name from ({_NEW_ORGS.replace('{part}', 'part')})),
    taken AS (select lower(trim(legal_name)) as name, count(*) as n from organizations group by 1),
    j AS (select c.*, t.n, op.user_id as op_user from c left join taken t on t.name = c.name
        left join users op on op.email = lower(c.operator_email) and op.is_platform_admin and op.disabled_at is null),
    d AS (select *, {_refusal(
        ("name = '' or contains(name, '" + OVERRIDE + "')", "invalid_parameter_value", "--legal-name must be 1-300 characters without control characters"),
        ("op_user is null", "insufficient_privilege", "--as is not an active platform admin"),
        ("trim(reason) = ''", "invalid_parameter_value", "--reason must be a short sentence"),
        ("n > 1", "unique_violation", "several organizations already have that name; nothing changed"))} from j)
    select command_id, refusal_code is null as accepted, refusal_code, refusal_reason, case when refusal_code is null then case when n = 1 then 'exists' else 'created' end end as result from d""")
def create_orgs(spark, sf):
    c = spark.sql(_NEW_ORGS, part=read(spark, sf, "part"))
    return K.create_organizations_as_operator(c, state(spark, sf)).select(*_DECISION, "result")


_SEATS = """
    select command_id, case when quantity = 1 then 'gone' when quantity = 2 then '0000000c-0000-4000-8000-999999999999' else org_id end as org_id,
        case when quantity = 3 then 'who@example.org' else 'customer-' || lpad(cast(cust as string), 9, '0') || '@example.org' end as user_email,
        case when quantity = 4 then 'nobody@example.org' else 'customer-000000050@example.org' end as operator_email,
        case when quantity = 5 then ' ' else 'first admin' end as reason
    from {requests}"""


@query("p17_seat_org_admins", f"""
    {with_tables('users', 'organizations', 'memberships', 'requests')}, c AS ({_SEATS.replace('{requests}', 'requests')}),
    held AS (select distinct org_id, user_id from memberships where revoked_at is null and role = 'org_admin'),
    j AS (select c.*, o.status, p.user_id, p.disabled_at, p.is_platform_admin as staff, op.user_id as op_user, h.org_id is not null as held
        from c left join organizations o on o.org_id = c.org_id left join users p on p.email = c.user_email
        left join users op on op.email = c.operator_email and op.is_platform_admin and op.disabled_at is null
        left join held h on h.org_id = c.org_id and h.user_id = p.user_id),
    d AS (select *, {_refusal(
        ("org_id = 'gone'", "invalid_parameter_value", "--org must be the organization's id (a UUID)"),
        ("op_user is null", "insufficient_privilege", "--as is not an active platform admin"),
        ("trim(reason) = ''", "invalid_parameter_value", "--reason must be a short sentence"),
        ("status is null", "not_found", "no such organization"),
        ("status <> 'active'", "check_violation", K.ORG_INACTIVE),
        ("user_id is null or disabled_at is not null", "check_violation", "has no active account (run create-user first)"),
        ("staff", "insufficient_privilege", "is a platform admin; vendor staff are never members"))} from j)
    select command_id, refusal_code is null as accepted, refusal_code, refusal_reason, case when refusal_code is null then case when held then 'exists' else 'created' end end as result from d""")
def seat_org_admins(spark, sf):
    c = spark.sql(_SEATS, requests=derive(spark, sf, "requests"))
    return K.seat_org_admins(c, state(spark, sf)).select(*_DECISION, "result")


# --- audit ---------------------------------------------------------------------------------------------

_ENTRIES = """
    select command_id, actor, system_job, system_job is not null and line > 4 as privileged,
        case when quantity > 45 then 'Bad Action' when quantity > 40 then 'invitation.create' when quantity > 38 then 'org' else 'document.view' end as action,
        case when line = 1 then null else org_id end as org_id
    from {requests}"""


@query("p12_audit_writes", f"""
    {_base('requests', 'support_grants')}, c AS ({_ENTRIES.replace('{requests}', 'requests')}),
    support AS (select distinct g.org_id, g.support_user_id from support_grants g join organizations o on o.org_id = g.org_id join users u on u.user_id = g.support_user_id
        where g.revoked_at is null and g.starts_at <= {_GNOW} and g.expires_at > {_GNOW} and o.status = 'active' and u.disabled_at is null and u.is_platform_admin),
    j AS (select c.*, a.user_id is not null or s.org_id is not null as belongs, coalesce(trim(system_job) <> '', false) as job
        from c left join auth a on a.org_id = c.org_id and a.user_id = c.actor left join support s on s.org_id = c.org_id and s.support_user_id = c.actor),
    d AS (select *, {_refusal(
        ("not privileged and actor is null", "insufficient_privilege", K.NO_ACTOR),
        ("not privileged and not regexp_full_match(action, '[a-z_]+[.][a-z_]+')", "invalid_parameter_value", 'audit action must look like "area.event" in lowercase'),
        ("not privileged and split_part(action, '.', 1) in ('org', 'membership', 'support_access', 'user', 'invitation')", "insufficient_privilege", "audit action is reserved for the database"),
        ("not privileged and org_id is not null and not belongs", "insufficient_privilege", "cannot write to that organization's audit trail"),
        ("privileged and not job and actor is null", "insufficient_privilege", "privileged change without an actor or app.system_job reason"))} from j)
    select command_id, refusal_code is null as accepted, refusal_code, refusal_reason,
        case when refusal_code is null then case when not privileged then 'api' when job then 'system' else 'operator' end end as source from d""")
def audit_writes(spark, sf):
    c = spark.sql(_ENTRIES, requests=derive(spark, sf, "requests"))
    return K.check_audit_writes(c, state(spark, sf), GRANTS_AS_OF).select(*_DECISION, "source")


@query("p13_a4_changed_columns", f"""
    {with_tables('users')}, n AS (select *, cast(substr(user_id, 25) as bigint) as k from users),
    d AS (select user_id, k % 4 = 0 as name_changed, k % 6 = 0 and disabled_at is null or k % 6 = 1 and disabled_at is not null as disabled_changed, k % 10 = 0 as admin_changed from n)
    select user_id, concat_ws(' ', case when disabled_changed then 'disabled_at' end, case when name_changed then 'display_name' end, case when admin_changed then 'is_platform_admin' end) as changed from d""")
def changed_columns(spark, sf):
    people = derive(spark, sf, "users")
    k = F.substring("user_id", 25, 12).cast("long")
    new = F.struct(
        "cognito_sub", "email",
        F.when(k % 4 == 0, F.concat(F.coalesce("display_name", F.lit("")), F.lit("*"))).otherwise(F.col("display_name")).alias("display_name"),
        F.when(k % 10 == 0, ~F.col("is_platform_admin")).otherwise(F.col("is_platform_admin")).alias("is_platform_admin"),
        F.when((k % 6 == 0) & F.col("disabled_at").isNull(), at(AS_OF)).when(k % 6 == 1, F.lit(None)).otherwise(F.col("disabled_at")).alias("disabled_at"),
    )
    pairs = people.select("user_id", F.struct(*audit.USER_AUDITED).alias("old"), new.alias("new"))
    diff = audit.changed_columns("old", "new", audit.USER_AUDITED)
    return pairs.select("user_id", F.array_join(F.array_sort(F.map_keys(diff)), " ").alias("changed"))


@query("p14_audit_events", f"""
    {with_tables('users', 'organizations', 'memberships', 'support_grants', 'invitations')},
    e AS (
        select 'membership.grant' as action, granted_at as t, granted_by as actor, null as flag from memberships
        union all select 'membership.revoke', revoked_at, revoked_by, revoked_by = user_id from memberships where revoked_at is not null
        union all select 'invitation.create', invited_at, invited_by, null from invitations
        union all select 'invitation.accept', accepted_at, invited_user_id, null from invitations where accepted_at is not null
        union all select 'invitation.decline', declined_at, invited_user_id, null from invitations where declined_at is not null
        union all select 'invitation.revoke', revoked_at, revoked_by, revoked_by = invited_by from invitations where revoked_at is not null
        union all select 'support_access.grant', consented_at, consented_by, null from support_grants
        union all select 'support_access.revoke', revoked_at, revoked_by, null from support_grants where revoked_at is not null
        union all select 'org.create', created_at, created_by, null from organizations
        union all select 'user.create', created_at, null, null from users)
    select action, count(*) as events, count(actor) as by_people, count(distinct actor) as people, count(*) filter (where flag) as flagged, min(t) as first_at, max(t) as last_at
    from e group by action""")
def audit_events(spark, sf):
    s = state(spark, sf)
    parts = [audit.membership_events(s.memberships), audit.invitation_events(s.invitations), audit.support_events(s.support_grants),
             audit.organization_events(s.organizations), audit.user_events(s.users)]
    events = parts[0]
    for p in parts[1:]:
        events = events.unionByName(p)
    flag = F.coalesce(F.col("detail")["self_revoked"], F.col("detail")["by_sender"]) == "true"
    return events.groupBy("action").agg(
        F.count("*").alias("events"), F.count("actor_user_id").alias("by_people"), F.countDistinct("actor_user_id").alias("people"),
        F.count_if(flag).alias("flagged"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
    )


_ORG_CHANGED = " , ".join(
    f"""case when {c} is distinct from lag({c}) over w then '"{c}":[' || coalesce('"' || lag({c}) over w || '"', 'null') || ',' || coalesce('"' || {c} || '"', 'null') || ']' end"""
    for c in audit.ORG_AUDITED)


@query("p14_a4_organization_versions", f"""
    {with_tables('organization_versions')}
    select org_id, "at", actor as actor_user_id, case when version = 0 then 'org.create' else 'org.update' end as action,
        case when not privileged then 'database' when system_job is not null then 'system' else 'operator' end as source,
        case when privileged then system_job end as system_job,
        case when version = 0 then legal_name end as created_name,
        case when version > 0 then '{{' || concat_ws(',', {_ORG_CHANGED}) || '}}' end as changed
    from organization_versions window w as (partition by org_id order by "at", version)""")
def organization_versions(spark, sf):
    """One event per version, with old and new values."""
    pairs = audit.with_previous(derive(spark, sf, "organization_versions"), "org_id", audit.ORG_AUDITED)
    events = audit.version_events(pairs, "org", "organization", "org_id", audit.ORG_AUDITED, ("legal_name", "status"), F.col("org_id"))
    d = F.col("detail")
    return events.select("org_id", "at", "actor_user_id", "action", d["source"].alias("source"), d["system_job"].alias("system_job"),
                         d["legal_name"].alias("created_name"), d["changed"].alias("changed"))


@query("p14_invitation_versions", f"""
    {with_tables('invitation_versions')},
    v AS (select *, lag(invited_at) over (partition by invitation_id order by "at", version) as before from invitation_versions),
    e AS (select *, coalesce(before <> invited_at, false) as renewed, case when before is null or before <> invited_at then 'invitation.create'
        when accepted_at is not null then 'invitation.accept' when declined_at is not null then 'invitation.decline'
        when revoked_at is not null then 'invitation.revoke' end as action from v)
    select invitation_id, "at", action, 'database' as source, case when renewed then 'true' end as renewed,
        case when action = 'invitation.create' then invited_user_id end as target_user_id,
        case when action = 'invitation.revoke' then case when revoked_by = invited_by then 'true' else 'false' end end as by_sender
    from e where action is not null""")
def invitation_versions(spark, sf):
    """Creations, renewals and ends of invitations, with their details."""
    pairs = audit.with_previous(derive(spark, sf, "invitation_versions"), "invitation_id", audit.INVITATION_VERSION)
    d = F.col("detail")
    return audit.invitation_version_events(pairs).select(
        F.col("object_id").alias("invitation_id"), "at", "action", d["source"].alias("source"), d["renewed"].alias("renewed"),
        d["target_user_id"].alias("target_user_id"), d["by_sender"].alias("by_sender"))


@query("j11_w5_grants_from_invitations", f"""
    {with_tables('invitations')} select 'm-' || invitation_id as object_id, invited_user_id as actor_user_id,
        first_value(invitation_id) over (partition by org_id, invited_user_id, role, invited_by, accepted_at order by invited_at desc, invitation_id desc) as invitation_id
    from invitations where accepted_at is not null""")
def grants_from_invitations(spark, sf):
    """Memberships that came from accepted invitations name the invitation."""
    inv = derive(spark, sf, "invitations")
    joined = inv.where(F.col("accepted_at").isNotNull()).select(
        F.concat(F.lit("m-"), "invitation_id").alias("membership_id"), "org_id", F.col("invited_user_id").alias("user_id"), "role",
        F.col("invited_by").alias("granted_by"), F.col("accepted_at").alias("granted_at"),
        F.lit(None).cast("timestamp_ntz").alias("revoked_at"), F.lit(None).cast("string").alias("revoked_by"),
    )
    events = audit.membership_events(joined, inv)
    return events.select("object_id", "actor_user_id", F.col("detail")["invitation_id"].alias("invitation_id"))


# --- schema changes ----------------------------------------------------------------------------------------

_FILES = with_tables("migration_files", "migration_ledger")
_CHECKSUM = "sha256(replace(sql_text, chr(13) || chr(10), chr(10)))"


@query("p21_migration_status", f"""
    {_FILES} select coalesce(f.version, l.version) as version, case when l.version is null then 'pending' when f.version is null then 'unknown'
        when {_CHECKSUM} <> l.checksum then 'edited' else 'applied' end as status
    from migration_files f full join migration_ledger l on l.version = f.version""")
def migration_status(spark, sf):
    return M.migration_status(derive(spark, sf, "migration_files"), derive(spark, sf, "migration_ledger"))


@query("p21_pending_migrations", f"""
    {_FILES} select version, {_CHECKSUM} as checksum from migration_files where version not in (select version from migration_ledger)""")
def pending_migrations(spark, sf):
    todo = M.pending(derive(spark, sf, "migration_files"), derive(spark, sf, "migration_ledger"))
    return todo.select("version", M.checksum(F.col("sql_text")).alias("checksum"))


@query("p21_file_problems", """
    with f as (select case when page_id % 5 = 4 then lpad(cast(page_id as varchar), 3, '0') else lpad(cast(page_id - page_id % 5 % 2 as varchar), 4, '0') end || '_' || page_id as version from pages),
    n as (select version, split_part(version, '_', 1) as number from f),
    p as (select version, case when not regexp_full_match(number, '[0-9]{4}') then 'must start with a 4-digit number'
        when version > min(version) over (partition by number) then 'duplicate migration number' end as problem from n)
    select version, problem from p where problem is not null""")
def file_problems(spark, sf):
    page = F.col("page_id")
    number = F.when(page % 5 == 4, F.lpad(page.cast("string"), 3, "0")).otherwise(F.lpad((page - page % 5 % 2).cast("string"), 4, "0"))
    return M.file_problems(read(spark, sf, "pages").select(F.concat(number, F.lit("_"), page.cast("string")).alias("version")))
