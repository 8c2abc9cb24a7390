"""Tables of the data model, derived from the given tables.

The given tables hold orders, events and documents; people, organizations, memberships,
invitations, grants and upload attempts are read off them by the SQL below, which both Spark and
the checking database run. Every table grows with its source. Remainders assign attributes; they
never select rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docwarden.operators.access import AccessState

# Clocks of the point-in-time queries.
AS_OF = "2024-01-20 12:00:00"
EARLY = "2024-01-01 02:00:00"
GRANTS_AS_OF = "1998-09-01 00:00:00"
INGESTED_AT = "2024-02-01 00:00:00"
BATCH_AS_OF = "2024-02-10 00:00:00"


def _uuid(kind: str, key: str) -> str:
    return f"'0000000{kind}-0000-4000-8000-' || lpad(cast({key} as string), 12, '0')"


def _user(key: str) -> str:
    return _uuid("a", key)


def _org(key: str) -> str:
    return _uuid("c", key)


def _email(key: str) -> str:
    return f"'customer-' || lpad(cast({key} as string), 9, '0') || '@example.org'"


_ROLE_BY_LINE = """case l_linenumber when 1 then 'org_admin' when 2 then 'point_person' when 3 then 'contributor'
    when 4 then 'budget_owner' else 'authorized_approver' end"""
_LINE_KEY = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
# Sent long enough before the batch's clock to have run out, or not.
_BATCH_SENT = f"(case when l_partkey % 3 = 0 then TIMESTAMP_NTZ '{BATCH_AS_OF}' - interval 20 day else TIMESTAMP_NTZ '{BATCH_AS_OF}' - interval 2 day end)"
_INVITED_ORG = _org("cast(regexp_extract(props, '[0-9]+', 0) as bigint)")

SQL = {
    "users": f"""
        select {_user('c_custkey')} as user_id,
            {_uuid('b', 'c_custkey')} as cognito_sub,
            case when c_custkey % 97 = 5 then ' ' || c_name else replace(lower(c_name), '#', '-') end || '@example.org' as email,
            case when c_custkey % 3 = 0 then null else c_name end as display_name,
            c_custkey % 50 = 0 as is_platform_admin,
            case when c_acctbal < 0 then TIMESTAMP_NTZ '1997-01-01 00:00:00' end as disabled_at,
            TIMESTAMP_NTZ '1995-01-01 00:00:00' as created_at
        from {{customer}}""",
    "organizations": f"""
        select {_org('s_suppkey')} as org_id,
            case when s_suppkey % 25 = 3 then ' Shared Name' when s_suppkey % 25 = 4 then 'SHARED NAME' else s_name end as legal_name,
            case when s_suppkey % 2 = 0 then 'Office ' || s_suppkey end as display_name,
            case when s_acctbal < 0 then 'closed' when s_nationkey % 6 = 0 then 'suspended' else 'active' end as status,
            case when s_suppkey % 4 = 0 then 'bill-' || s_suppkey end as billing_account_id,
            {_user('s_nationkey')} as created_by,
            TIMESTAMP_NTZ '1994-06-01 00:00:00' as created_at
        from {{supplier}}""",
    "memberships": f"""
        select 'm-' || {_LINE_KEY} as membership_id,
            {_org('l_suppkey')} as org_id, {_user('o_custkey')} as user_id, {_ROLE_BY_LINE} as role,
            {_user('(o_custkey - o_custkey % 10)')} as granted_by,
            o_orderdate as granted_at,
            case when l_returnflag = 'R' then l_shipdate end as revoked_at,
            case when l_returnflag = 'R' and l_linenumber <> 7 then {_user('l_partkey')} end as revoked_by
        from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey""",
    "support_grants": f"""
        select 'g-' || {_LINE_KEY} as grant_id,
            {_org('l_suppkey')} as org_id, {_user('(l_partkey - l_partkey % 50)')} as support_user_id,
            {_user('l_partkey')} as consented_by,
            l_shipdate - interval 1 day as consented_at,
            case when l_linenumber = 7 then ' ' else 'ticket ' || l_orderkey end as reason,
            l_shipdate as starts_at,
            case when l_linenumber = 6 then l_shipdate + interval 30 day when l_linenumber % 2 = 0 then l_shipdate + interval 7 day
                else l_shipdate + interval 14 day end as expires_at,
            case when l_returnflag = 'R' then l_shipdate + interval 2 day end as revoked_at,
            case when l_returnflag = 'R' then {_user('l_partkey')} end as revoked_by
        from {{lineitem}}""",
    "invitations": f"""
        select 'i-' || event_id as invitation_id, {_INVITED_ORG} as org_id,
            {_user('cast(floor(value) as bigint)')} as invited_user_id,
            case event_type when 'purchase' then 'org_admin' when 'view' then 'point_person' when 'click' then 'contributor'
                when 'signup' then 'budget_owner' else 'authorized_approver' end as role,
            {_user('user_id')} as invited_by,
            ts as invited_at,
            case when event_id % 11 = 0 then ts + interval 20 day when event_id % 13 = 0 then ts + interval 7 day
                else ts + interval 14 day end as expires_at,
            case when event_id % 7 = 1 then ts + interval 1 day end as accepted_at,
            case when event_id % 7 = 2 or event_id % 77 = 1 then ts + interval 2 day end as declined_at,
            case when event_id % 7 = 3 then ts + interval 3 day end as revoked_at,
            case when event_id % 7 = 3 then {_user('(user_id + event_id % 2)')} end as revoked_by
        from {{events}}""",
    # Changes of organizations: two within an hour, two at one moment (the version orders them).
    "organization_versions": f"""
        select {_org('s_suppkey')} as org_id, v as version,
            case when v >= 1 and s_suppkey % 3 = 0 then s_name || ' Ltd' else s_name end as legal_name,
            case when v < 2 or s_suppkey % 2 = 0 then 'Office' end as display_name,
            case when v >= 3 and s_suppkey % 5 = 0 then 'closed' else 'active' end as status,
            case when s_suppkey % 4 = 0 then 'bill' end as billing_account_id,
            case v when 0 then TIMESTAMP_NTZ '1994-06-01 00:00:00' when 1 then TIMESTAMP_NTZ '1994-06-01 00:20:00'
                else TIMESTAMP_NTZ '1994-06-03 00:00:00' end as at,
            case when v < 3 then {_user('s_nationkey')} end as actor,
            v >= 2 as privileged, case when v = 3 then 'close-organizations' when v = 1 then 'not privileged' end as system_job
        from (select *, explode(sequence(0, 3)) as v from {{supplier}}) as s""",
    # Changes of invitations: some are renewed, then answered or not.
    "invitation_versions": f"""
        select 'i-' || event_id as invitation_id, {_org('(event_id % 50 + 1)')} as org_id, v as version, 'contributor' as role,
            {_user('user_id')} as invited_user_id, {_user('(event_id % 9)')} as invited_by,
            case when v >= 1 and event_id % 3 = 0 then ts + interval 1 day else ts end as invited_at,
            case when v = 2 and event_id % 4 = 0 then ts + interval 2 day end as accepted_at,
            case when v = 2 and event_id % 4 = 1 then ts + interval 2 day end as declined_at,
            case when v = 2 and event_id % 4 = 2 then ts + interval 2 day end as revoked_at,
            case when v = 2 and event_id % 4 = 2 then {_user('(event_id % 9 + event_id % 8 - 2)')} end as revoked_by,
            case v when 0 then ts when 1 then ts + interval 1 day else ts + interval 2 day end as at,
            {_user('(event_id % 9)')} as actor, false as privileged, cast(null as string) as system_job
        from (select *, explode(sequence(0, 2)) as v from {{events}}) as e""",
    "requests": f"""
        select 'r-' || {_LINE_KEY} as command_id,
            case when l_linenumber = 7 and l_returnflag = 'A' then null else {_user('o_custkey')} end as actor,
            {_org('l_suppkey')} as org_id, {_ROLE_BY_LINE} as role,
            case when l_discount = 0.05 then 'recovery' when l_discount = 0.06 then ' ' end as system_job,
            l_linenumber as line, l_quantity as quantity, l_shipdate as at, l_partkey as part, o_custkey as cust, l_suppkey as supp
        from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey""",
    "acceptances": f"""
        select 'a-' || event_id as command_id,
            case when event_id % 19 = 0 then null when event_id % 5 = 4 then {_user('user_id')}
                else {_user('cast(floor(value) as bigint)')} end as actor,
            case when event_id % 10 = 0 then 'recovery' end as system_job,
            case when event_id % 9 <> 0 then 'i-' || event_id end as accepting_invitation,
            {_INVITED_ORG} as org_id, {_user('cast(floor(value) as bigint)')} as user_id,
            case event_type when 'purchase' then 'org_admin' when 'view' then 'point_person' when 'click' then 'contributor'
                when 'signup' then 'budget_owner' else 'authorized_approver' end as role,
            case when event_id % 31 = 0 then ts end as revoked_at
        from {{events}}""",
    "invites": f"""
        select 'n-' || event_id as command_id, {_user('user_id')} as actor, {_INVITED_ORG} as org_id,
            case when event_id % 23 = 0 then 'bad address' when event_id % 10 = 0 then 'new-' || event_id || '@example.org'
                when event_id % 29 = 0 then 'customer-' || lpad(cast(user_id as string), 9, '0') || '@example.org'
                else ' Customer-' || lpad(cast(cast(floor(value) as bigint) as string), 9, '0') || '@EXAMPLE.org' end as email,
            case event_type when 'purchase' then 'org_admin' when 'view' then 'point_person' when 'click' then 'contributor'
                when 'signup' then 'owner' else 'authorized_approver' end as role,
            case when event_id % 6 = 0 then null when event_id % 14 = 1 then 'Bell' || chr(7) else 'Somebody' end as display_name,
            case when event_id % 20 = 0 then null when event_id % 30 = 10 then 'not-an-id' when event_id % 50 = 30 then {_uuid('b', 'user_id')}
                else upper({_uuid('e', 'event_id')}) end as account_id
        from {{events}}""",
    # One batch of invitations in order: organization by organization, person by person. An admin's line
    # becomes twenty commands, so that each cap is crossed; the others become one.
    "batch": f"""
        select seq_of || lpad(cast(kind as string), 2, '0') as seq, 'q-' || line_key || '-' || kind as command_id, actor, org_id,
            case when kind = 0 then 'bad address' when kind = 2 then {_email('cust')}
                when kind between 3 and 7 then 'new-' || line_key || '-' || case when kind = 7 then 6 else kind end || '@example.org'
                else {_email("part + case when kind in (8, 9) then 0 else kind end")} end as email,
            case when kind = 10 then 'owner' when kind in (7, 11, 12, 13, 14, 15, 16, 17, 18, 19) then 'budget_owner' else 'contributor' end as role,
            case when kind = 1 then 'Bell' || chr(7) else 'Somebody' end as display_name,
            case when kind = 4 then 'not-an-id' when kind = 5 then {_uuid('b', 'cust')}
                when kind = 6 then {_uuid('f', "line || lpad(cast(cust as string), 7, '0')")} end as account_id
        from (select {_LINE_KEY} as line_key, l_linenumber as line, l_partkey as part, o_custkey as cust, {_org('l_suppkey')} as org_id,
                case when l_linenumber = 7 and l_returnflag = 'A' then null else {_user('o_custkey')} end as actor,
                lpad(cast(l_suppkey as string), 9, '0') || '-' || lpad(cast(o_custkey as string), 9, '0') || '-' || {_LINE_KEY} || '-' as seq_of,
                explode(sequence(0, case when l_linenumber = 1 then 19 else 0 end)) as kind
            from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey)""",
    "batch_invitations": f"""
        select 'b-' || {_LINE_KEY} as invitation_id, {_org('l_suppkey')} as org_id, {_user('l_partkey')} as invited_user_id, 'contributor' as role,
            {_user('o_custkey')} as invited_by, {_BATCH_SENT} as invited_at, {_BATCH_SENT} + interval 14 day as expires_at,
            CAST(null AS TIMESTAMP_NTZ) as accepted_at, case when l_partkey % 3 = 2 then {_BATCH_SENT} + interval 1 hour end as declined_at,
            CAST(null AS TIMESTAMP_NTZ) as revoked_at, cast(null as string) as revoked_by
        from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey""",
    "audit_log": f"""
        select 'l-' || event_id as audit_id, {_user('user_id')} as actor_user_id, 'invitation.create' as action, 'invitation' as object_type,
            'i-' || event_id as object_id, {_INVITED_ORG} as org_id
        from {{events}}""",
    "attempts": """
        select sha2(text, 256) as file_hash, doc_id as attempt_id, 'doc-' || doc_id || '.txt' as filename, 'text/plain' as content_type,
            TIMESTAMP_NTZ '2024-01-01 00:00:00' + interval 1 minute * doc_id as at,
            case when doc_id % 4 = 0 then 'failed' when doc_id % 9 = 1 then 'processing' else 'completed' end as outcome,
            case when doc_id % 4 = 0 then 'RuntimeError: attempt ' || doc_id end as failure_reason,
            case when doc_id % 4 <> 0 and doc_id % 9 <> 1 then n_chars end as chunk_count,
            case when doc_id % 4 <> 0 and doc_id % 9 <> 1
                then TIMESTAMP_NTZ '2024-01-01 00:00:30' + interval 1 minute * doc_id end as finished_at
        from {documents}""",
    "store": """
        select d.doc_id as chunk_id, 'doc' as doc_type, d.text as chunk_text,
            case when l.toxic = 1 then null when l.quality = 0 then sha2(d.text || '!', 256) else sha2(d.text, 256) end as content_hash,
            d.source as section_label
        from {documents} d join {labels} l on d.doc_id = l.doc_id""",
    "incoming": """
        select doc_id as chunk_id, 'doc' as doc_type, text as chunk_text, sha2(text, 256) as content_hash, lang as section_label
        from {documents}""",
    "migration_files": """
        select lpad(cast(page_id as string), 4, '0') || '_page' as version, replace(html, '<p>', '<p>' || chr(13) || chr(10)) as sql_text
        from {pages}""",
    "migration_ledger": """
        select case when page_id % 11 = 3 then 'gone_' else '' end || lpad(cast(page_id as string), 4, '0') || '_page' as version,
            case when page_id % 7 = 0 then 'edited' else sha2(lf_html, 256) end as checksum
        from (select page_id, replace(html, '<p>', '<p>' || chr(10)) as lf_html from {pages} where url like '%?%')""",
}

_SOURCE = re.compile(r"\{(\w+)\}")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SQL[name]
    return spark.sql(text, **{t: read(spark, sf_dir, t) for t in sorted(set(_SOURCE.findall(text)))})


def state(spark: SparkSession, sf_dir: str) -> AccessState:
    def one(name):
        return derive(spark, sf_dir, name)
    return AccessState(one("users"), one("organizations"), one("memberships"), one("support_grants"), one("invitations"))


def oracle(name: str) -> str:
    """The same table for the checking database."""
    text = _SOURCE.sub(r"\1", SQL[name]).replace("TIMESTAMP_NTZ", "TIMESTAMP")
    text = re.sub(r"explode\(sequence\((.*)\)\) as", r"unnest(generate_series(\1)) as", text)
    return re.sub(r"sha2\(((?:[^()]|\([^()]*\))*), 256\)", r"sha256(\1)", text)


def with_tables(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause that defines derived tables under their own names."""
    keyword = "WITH RECURSIVE " if recursive else "WITH "
    return keyword + ",\n".join(f"{n} AS ({oracle(n)})" for n in names)
