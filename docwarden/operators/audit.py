"""Audit events derived from changes, and column diffs.

Every table is read once: a row gives an array of its events, which is inlined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Audited columns per table.
ORG_AUDITED = ("legal_name", "display_name", "status", "billing_account_id")
USER_AUDITED = ("cognito_sub", "email", "display_name", "is_platform_admin", "disabled_at")


def changed_columns(old: str, new: str, columns: tuple[str, ...]) -> Column:
    """``map<column, [old, new]>`` of the named columns that differ between two structs, compared
    so that NULL equals NULL."""
    pairs = F.create_map(*[
        part
        for c in columns
        for part in (F.lit(c), F.array(F.col(f"{old}.{c}").cast("string"), F.col(f"{new}.{c}").cast("string")))
    ])
    return F.map_filter(pairs, lambda _, v: ~F.get(v, 0).eqNullSafe(F.get(v, 1)))


def _detail(**values: Column) -> Column:
    """Details as text; keys without a value are left out."""
    entries = F.create_map(*[p for k, v in values.items() for p in (F.lit(k), v.cast("string"))])
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def stamped(detail: Column, job: Column | None = None, operator: Column | None = None) -> Column:
    """``detail`` without what only the trail itself may say, then with its source: a system job and its
    reason, else an operator, else the database."""
    clean = F.map_filter(detail, lambda k, _: ~k.isin("source", "system_job"))
    job = F.lit(None).cast("string") if job is None else job
    operator = F.lit(False) if operator is None else operator
    by_job = F.create_map(F.lit("source"), F.lit("system"), F.lit("system_job"), job)
    return F.when(job.isNotNull(), F.map_concat(clean, by_job)).otherwise(
        F.map_concat(clean, F.create_map(F.lit("source"), F.when(operator, "operator").otherwise("database"))))


def _event(when: Column, at: str, actor: Column, action: str, kind: str, object_id: str, org: Column, detail: Column, job: Column | None = None) -> Column:
    return F.when(when, F.struct(
        F.col(at).alias("at"), actor.alias("actor_user_id"), F.lit(action).alias("action"), F.lit(kind).alias("object_type"),
        F.col(object_id).alias("object_id"), org.alias("org_id"), stamped(detail, job).alias("detail"),
    ))


def _listed(rows: DataFrame, *events: Column) -> DataFrame:
    return rows.select(F.inline(F.filter(F.array(*events), lambda e: e.isNotNull())))


def membership_events(memberships: DataFrame, invitations: DataFrame | None = None) -> DataFrame:
    """Grants and revocations. A grant names the invitation it came from: the newest accepted at
    that moment for the same organization, person, role and sender."""
    rows = memberships
    if invitations is None:
        rows = rows.withColumn("_invitation", F.lit(None).cast("string"))
    else:
        keys = ["org_id", "user_id", "role", "granted_by", "granted_at"]
        accepted = invitations.where(F.col("accepted_at").isNotNull()).groupBy(
            "org_id", F.col("invited_user_id").alias("user_id"), "role",
            F.col("invited_by").alias("granted_by"), F.col("accepted_at").alias("granted_at"),
        ).agg(F.max_by("invitation_id", F.struct("invited_at", "invitation_id")).alias("_invitation"))
        rows = rows.join(accepted, keys, "left")
    common = dict(target_user_id=F.col("user_id"), role=F.col("role"))
    always, org = F.lit(True), F.col("org_id")
    from_invitation = F.col("_invitation").isNotNull()
    return _listed(
        rows,
        _event(always, "granted_at", F.when(from_invitation, F.col("user_id")).otherwise(F.col("granted_by")),
                "membership.grant", "membership", "membership_id", org, _detail(**common, invitation_id=F.col("_invitation"))),
        _event(F.col("revoked_at").isNotNull(), "revoked_at", F.col("revoked_by"), "membership.revoke", "membership",
               "membership_id", org, _detail(**common, self_revoked=F.col("revoked_by") == F.col("user_id"))),
    )


def invitation_events(invitations: DataFrame) -> DataFrame:
    role, org = F.col("role"), F.col("org_id")

    def ended(column, action, actor, detail):
        return _event(F.col(column).isNotNull(), column, actor, action, "invitation", "invitation_id", org, detail)

    return _listed(
        invitations,
        _event(F.lit(True), "invited_at", F.col("invited_by"), "invitation.create", "invitation", "invitation_id", org,
                _detail(target_user_id=F.col("invited_user_id"), role=role)),
        ended("accepted_at", "invitation.accept", F.col("invited_user_id"), _detail(role=role)),
        ended("declined_at", "invitation.decline", F.col("invited_user_id"), _detail(role=role)),
        ended("revoked_at", "invitation.revoke", F.col("revoked_by"),
              _detail(role=role, by_sender=F.col("revoked_by") == F.col("invited_by"))),
    )


def support_events(grants: DataFrame) -> DataFrame:
    org, staff = F.col("org_id"), F.col("support_user_id")
    return _listed(
        grants,
        _event(F.lit(True), "consented_at", F.col("consented_by"), "support_access.grant", "support_access_grant", "grant_id", org,
                _detail(support_user_id=staff, reason=F.col("reason"), starts_at=F.col("starts_at"), expires_at=F.col("expires_at"))),
        _event(F.col("revoked_at").isNotNull(), "revoked_at", F.col("revoked_by"), "support_access.revoke",
                "support_access_grant", "grant_id", org, _detail(support_user_id=staff)),
    )


def organization_events(organizations: DataFrame) -> DataFrame:
    return _listed(organizations, _event(
        F.lit(True), "created_at", F.col("created_by"), "org.create", "organization", "org_id", F.col("org_id"),
        _detail(legal_name=F.col("legal_name"), status=F.col("status"))))


def user_events(users: DataFrame, system_job: str = "create-user") -> DataFrame:
    """Users are created by a system job, whose reason is in ``system_job``."""
    nobody = F.lit(None).cast("string")
    return _listed(users, _event(
        F.lit(True), "created_at", nobody, "user.create", "user", "user_id", nobody,
        _detail(email=F.col("email"), is_platform_admin=F.col("is_platform_admin")), F.lit(system_job)))


def update_events(changes: DataFrame, action: str, kind: str, key: str, columns: tuple[str, ...], org: Column) -> DataFrame:
    """``changes(at, actor, old, new)``: one event per change with what changed, as JSON."""
    diff = F.to_json(changed_columns("old", "new", columns))
    return changes.select(
        "at", F.col("actor").alias("actor_user_id"), F.lit(action).alias("action"), F.lit(kind).alias("object_type"),
        F.col(f"new.{key}").alias("object_id"), org.alias("org_id"),
        F.create_map(F.lit("changed"), diff, F.lit("source"), F.lit("database")).alias("detail"),
    )


# --- row versions ------------------------------------------------------------------------------------------


def with_previous(versions: DataFrame, key: str, columns: tuple[str, ...], order: tuple[str, ...] = ("at", "version")) -> DataFrame:
    """Adds ``old``, the struct of ``columns`` of the version before, NULL for a key's first one, and
    ``new``, the same of the version itself. ``order[0]`` is a time; no two versions of a key tie in all
    of ``order``.

    Neighbours are found within an hour of a key, and across hours from the last version of each hour, an
    aggregate. So a key that holds most of the table is dealt by the hours it changed in."""
    own = F.struct(*columns)
    placed = versions.withColumns({"new": own, "_hour": F.date_trunc("hour", order[0])})
    last = placed.groupBy(key, "_hour").agg(F.max_by("new", F.struct(*order)).alias("_last"))
    carried = last.select(
        F.col(key).alias("_key"), F.col("_hour").alias("_of"), F.lag("_last").over(Window.partitionBy(key).orderBy("_hour")).alias("_before"))
    inside = F.lag("new").over(Window.partitionBy(key, "_hour").orderBy(*order))
    joined = placed.withColumn("_inside", inside).join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_hour") == F.col("_of")), "left")
    return joined.withColumn("old", F.coalesce("_inside", "_before")).drop("_hour", "_inside", "_key", "_of", "_before")


def version_events(pairs: DataFrame, area: str, kind: str, key: str, columns: tuple[str, ...], created: tuple[str, ...], org: Column) -> DataFrame:
    """One event per version of an organization or a user: ``<area>.create`` with the ``created`` columns,
    or ``<area>.update`` with what changed, as JSON. ``pairs`` come from ``with_previous`` and say who made
    the change: ``actor``, ``system_job`` (NULL if none) and ``privileged``."""
    first = F.col("old").isNull()
    changed = F.to_json(changed_columns("old", "new", columns))
    detail = F.when(first, _detail(**{c: F.col(f"new.{c}") for c in created})).otherwise(_detail(changed=changed))
    return _of_versions(pairs, F.when(first, f"{area}.create").otherwise(f"{area}.update"), kind, key, org, detail)


INVITATION_VERSION = ("role", "invited_user_id", "invited_by", "invited_at", "accepted_at", "declined_at", "revoked_at", "revoked_by")


def invitation_version_events(pairs: DataFrame) -> DataFrame:
    """Events of invitation versions: created, renewed (a later ``invited_at`` of the same row), accepted,
    declined or revoked, in this precedence. A version that is none of these gives no event."""
    new, old = F.col("new"), F.col("old")
    first, renewed = old.isNull(), new["invited_at"] != old["invited_at"]
    role, target = new["role"], new["invited_user_id"]
    action = (
        F.when(first | renewed, "invitation.create").when(new["accepted_at"].isNotNull(), "invitation.accept")
        .when(new["declined_at"].isNotNull(), "invitation.decline").when(new["revoked_at"].isNotNull(), "invitation.revoke")
    )
    detail = _detail(
        role=role, target_user_id=F.when(first | renewed, target), renewed=F.when(~first & renewed, F.lit(True)),
        by_sender=F.when(action == "invitation.revoke", new["revoked_by"] == new["invited_by"]),
    )
    return _of_versions(pairs.where(action.isNotNull()), action, "invitation", "invitation_id", F.col("org_id"), detail)


def _of_versions(pairs: DataFrame, action: Column, kind: str, key: str, org: Column, detail: Column) -> DataFrame:
    privileged = F.coalesce("privileged", F.lit(False))
    job = F.when(privileged & (F.trim("system_job") != ""), F.col("system_job"))
    return pairs.select(
        "at", F.col("actor").alias("actor_user_id"), action.alias("action"), F.lit(kind).alias("object_type"), F.col(key).alias("object_id"),
        org.alias("org_id"), stamped(detail, job, privileged).alias("detail"),
    )
