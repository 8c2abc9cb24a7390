"""Request-field checks as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docwarden.functions.text import strip

# Accepted forms and lengths.
ROLES = ("org_admin", "point_person", "contributor", "budget_owner", "authorized_approver")
STRICT_EMAIL = r"\A[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9-]+(\.[a-z0-9-]+)+\z"
LOOSE_EMAIL = r"\A(?U)[^@\s\x1c-\x1f]+@[^@\s\x1c-\x1f]+\.[^@\s\x1c-\x1f]+\z"
UUID = r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
AUDIT_ACTION = r"\A[a-z_]+\.[a-z_]+\z"
CONTROL = r"[\p{Cc}]"
CONTROL_OR_FORMAT = r"[\p{Cc}\p{Cf}]"
INVISIBLE = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]"
QUESTION_MAX = 2000
STRICT_EMAIL_MAX = 254
LOOSE_EMAIL_MAX = 320
DISPLAY_NAME_MAX = 200
LEGAL_NAME_MAX = 300
GRANT_REASON_MAX = 1000
JOB_REASON_MAX = 500


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def valid_question(question: Column) -> Column:
    return _true(F.length(question).between(1, QUESTION_MAX) & (strip(question) != ""))


def normalized_email(email: Column) -> Column:
    return F.lower(strip(email))


def valid_email(email: Column) -> Column:
    """The ASCII-only form, after trimming and lower-casing."""
    e = normalized_email(email)
    return _true((F.length(e) <= STRICT_EMAIL_MAX) & e.rlike(STRICT_EMAIL))


def valid_contact_email(email: Column) -> Column:
    """The looser form used where a support person is named."""
    e = normalized_email(email)
    return _true((F.length(e) <= LOOSE_EMAIL_MAX) & e.rlike(LOOSE_EMAIL))


def valid_role(role: Column) -> Column:
    return _true(role.isin(*ROLES))


def valid_display_name(name: Column, forbidden: str = CONTROL_OR_FORMAT) -> Column:
    """An absent name is fine."""
    return name.isNull() | _true((F.length(name) <= DISPLAY_NAME_MAX) & ~name.rlike(forbidden))


def valid_org_name(name: Column) -> Column:
    return _true(F.length(name).between(1, LEGAL_NAME_MAX) & ~name.contains("\x00") & (strip(name) != ""))


def valid_plain_name(name: Column) -> Column:
    """A legal name typed by an operator: no control or invisible characters."""
    n = strip(name)
    return _true(F.length(n).between(1, LEGAL_NAME_MAX) & ~n.rlike(INVISIBLE))


def valid_grant_reason(reason: Column) -> Column:
    return _true(F.length(reason).between(1, GRANT_REASON_MAX) & ~reason.contains("\x00") & (strip(reason) != ""))


def valid_job_reason(reason: Column) -> Column:
    r = strip(reason)
    return _true(F.length(r).between(1, JOB_REASON_MAX) & ~r.rlike(INVISIBLE))


def valid_uuid(value: Column) -> Column:
    return _true(F.lower(strip(value)).rlike(UUID))


def valid_audit_action(action: Column) -> Column:
    return _true(action.rlike(AUDIT_ACTION))
