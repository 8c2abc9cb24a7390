"""Explicit table schemas as DDL strings. Nothing is inferred; unknown values are NULL."""

CHUNKS = """
    chunk_id STRING NOT NULL, doc_type STRING NOT NULL, chunk_text STRING NOT NULL,
    content_hash STRING NOT NULL, section_label STRING, source_url STRING NOT NULL,
    published_date DATE, retrieval_timestamp TIMESTAMP NOT NULL,
    start_seconds DOUBLE, end_seconds DOUBLE,
    embedding ARRAY<FLOAT>, embedding_model STRING, embedded_at TIMESTAMP
"""
DOCUMENT_UPLOADS = """
    file_hash STRING NOT NULL, original_filename STRING NOT NULL, content_type STRING NOT NULL,
    status STRING NOT NULL, failure_reason STRING, chunk_count INT,
    uploaded_at TIMESTAMP NOT NULL, completed_at TIMESTAMP
"""
USERS = """
    user_id STRING NOT NULL, cognito_sub STRING NOT NULL, email STRING NOT NULL,
    display_name STRING, is_platform_admin BOOLEAN NOT NULL,
    disabled_at TIMESTAMP, created_at TIMESTAMP NOT NULL
"""
ORGANIZATIONS = """
    org_id STRING NOT NULL, legal_name STRING NOT NULL, display_name STRING,
    status STRING NOT NULL, billing_account_id STRING,
    created_by STRING NOT NULL, created_at TIMESTAMP NOT NULL
"""
ORG_MEMBERSHIPS = """
    membership_id STRING NOT NULL, org_id STRING NOT NULL, user_id STRING NOT NULL,
    role STRING NOT NULL, granted_by STRING NOT NULL, granted_at TIMESTAMP NOT NULL,
    revoked_at TIMESTAMP, revoked_by STRING
"""
SUPPORT_ACCESS_GRANTS = """
    grant_id STRING NOT NULL, org_id STRING NOT NULL, support_user_id STRING NOT NULL,
    consented_by STRING NOT NULL, consented_at TIMESTAMP NOT NULL, reason STRING NOT NULL,
    starts_at TIMESTAMP NOT NULL, expires_at TIMESTAMP NOT NULL,
    revoked_at TIMESTAMP, revoked_by STRING
"""
ORG_INVITATIONS = """
    invitation_id STRING NOT NULL, org_id STRING NOT NULL, invited_user_id STRING NOT NULL,
    role STRING NOT NULL, invited_by STRING NOT NULL, invited_at TIMESTAMP NOT NULL,
    expires_at TIMESTAMP NOT NULL, accepted_at TIMESTAMP, declined_at TIMESTAMP,
    revoked_at TIMESTAMP, revoked_by STRING
"""
AUDIT_LOG = """
    at TIMESTAMP NOT NULL, actor_user_id STRING, action STRING NOT NULL,
    object_type STRING NOT NULL, object_id STRING NOT NULL, org_id STRING,
    detail MAP<STRING, STRING> NOT NULL
"""
SCHEMA_MIGRATIONS = "version STRING NOT NULL, checksum STRING NOT NULL, applied_at TIMESTAMP NOT NULL"

# Columns a source lookup returns: the chunk without its vector.
SOURCE_COLUMNS = (
    "chunk_id", "doc_type", "chunk_text", "section_label", "source_url", "published_date",
    "retrieval_timestamp", "start_seconds", "end_seconds", "embedding_model", "embedded_at",
)
CITATION_COLUMNS = ("chunk_id", "doc_type", "section_label", "source_url", "published_date")
PRINCIPAL_COLUMNS = ("user_id", "cognito_sub", "email", "display_name", "is_platform_admin")
