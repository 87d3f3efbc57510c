"""Schemas of the tables, events and nested records."""

from pyspark.sql import types as T

_s, _i, _ts = T.StringType(), T.IntegerType(), T.TimestampType()


def _struct(*cols):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


TENANTS = _struct(("id", _s, False), ("name", _s, False), ("slug", _s, False), ("created_at", _ts, True))

PROJECTS = _struct(
    ("id", _s, False), ("tenant_id", _s, False), ("name", _s, False), ("slug", _s, False),
    ("qdrant_collection", _s, False), ("created_at", _ts, True),
)

DOCUMENTS = _struct(
    ("id", _s, False), ("tenant_id", _s, False), ("project_id", _s, False), ("name", _s, False),
    ("doc_type", _s, False), ("s3_path", _s, False), ("status", _s, False), ("created_at", _ts, True),
)

TEST_RUNS = _struct(
    ("id", _s, False), ("tenant_id", _s, False), ("project_id", _s, False), ("run_source", _s, False),
    ("url", _s, False), ("prompt", _s, False), ("status", _s, False), ("created_at", _ts, True),
    ("completed_at", _ts, True),
)

REPORTS = _struct(
    ("id", _s, False), ("tenant_id", _s, False), ("project_id", _s, False), ("run_id", _s, False),
    ("status", _s, False), ("severity", _s, True), ("report_url", _s, False), ("s3_path", _s, False),
    ("format", _s, False), ("critical_count", _i, True), ("warning_count", _i, True), ("created_at", _ts, True),
)

TABLES = {"tenants": TENANTS, "projects": PROJECTS, "documents": DOCUMENTS, "test_runs": TEST_RUNS, "reports": REPORTS}

# fixed value: the tenant every installation starts with
SEED_TENANT = ("11111111-1111-1111-1111-111111111111", "Demo Company", "demo-co", None)

# foreign keys: child table, child column, parent table, parent column
FOREIGN_KEYS = (
    ("projects", "tenant_id", "tenants", "id"),
    ("documents", "tenant_id", "tenants", "id"),
    ("documents", "project_id", "projects", "id"),
    ("test_runs", "tenant_id", "tenants", "id"),
    ("test_runs", "project_id", "projects", "id"),
    ("reports", "tenant_id", "tenants", "id"),
    ("reports", "project_id", "projects", "id"),
    ("reports", "run_id", "test_runs", "id"),
)

DOCUMENT_UPLOADED = _struct(
    ("eventType", _s, True), ("tenantId", _s, True), ("projectId", _s, True), ("documentId", _s, True),
    ("s3Path", _s, True), ("correlationId", _s, True), ("timestamp", _s, True),
)

KNOWLEDGE_INDEXED = _struct(
    ("eventType", _s, True), ("tenantId", _s, True), ("projectId", _s, True), ("documentId", _s, True),
    ("chunkCount", _i, True), ("correlationId", _s, True),
)

TEST_REQUESTED = _struct(
    ("eventType", _s, True), ("tenantId", _s, True), ("projectId", _s, True), ("runId", _s, True),
    ("url", _s, True), ("prompt", _s, True), ("runSource", _s, True), ("correlationId", _s, True),
    ("timestamp", _s, True),
)

REPORT_READY = _struct(
    ("eventType", _s, True), ("tenantId", _s, True), ("projectId", _s, True), ("runId", _s, True),
    ("reportUrl", _s, True), ("severity", _s, True), ("error", _s, True), ("error_type", _s, True),
    ("correlationId", _s, True), ("attempt", _i, True), ("attempts_total", _i, True),
)

POINTS = _struct(
    ("id", _s, False), ("collection", _s, False), ("vector", T.ArrayType(T.FloatType()), False),
    ("tenant_id", _s, True), ("project_id", _s, True), ("document_id", _s, True), ("chunk_index", _i, True),
    ("type", _s, True), ("text", _s, True), ("version", T.LongType(), True),
)
