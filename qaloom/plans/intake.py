"""Queries for intake checks, registration, keys and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaloom import schemas
from qaloom.operators import events, quality, runs
from qaloom.plans.execution import CLASSIFIED
from qaloom.plans.registry import query
from qaloom.schemas import FOREIGN_KEYS
from qaloom.plans.views import view, with_views

# requests with gaps: names of a part of the customers are null or empty
_REQUESTS = """
requests AS (SELECT project_id AS request_id, CASE WHEN project_id % 11 = 0 THEN NULL ELSE tenant_id END AS tenant_id,
  CASE WHEN project_id % 13 = 0 THEN '' ELSE name END AS name, CASE WHEN project_id % 17 = 0 THEN NULL ELSE slug END AS slug FROM fx_projects),
checked AS (SELECT *, concat_ws(',', CASE WHEN tenant_id IS NULL THEN 'tenant_id' END, CASE WHEN coalesce(name, '') = '' THEN 'name' END,
  CASE WHEN coalesce(slug, '') = '' THEN 'slug' END) AS missing FROM requests)"""


def requests(spark, d):
    pid = F.col("project_id")
    return view(spark, d, "fx_projects").select(
        pid.alias("request_id"), F.when(pid % 11 != 0, F.col("tenant_id")).alias("tenant_id"),
        F.when(pid % 13 == 0, "").otherwise(F.col("name")).alias("name"), F.when(pid % 17 != 0, F.col("slug")).alias("slug"))


@query("validate_required", with_views("SELECT request_id, missing FROM checked WHERE missing <> ''", _REQUESTS))
def validate_required(spark, d):
    return quality.validate_required(requests(spark, d), quality.REQUIRED["project"])[1].select("request_id", "missing")


@query("register_projects", with_views("""
SELECT id, tenant_id, name, slug, concat(tenant_id, '_', id) AS qdrant_collection
FROM (SELECT *, sha256(concat_ws('|', CAST(tenant_id AS VARCHAR), CAST(request_id AS VARCHAR))) AS id FROM checked WHERE missing = ''
  QUALIFY row_number() OVER (PARTITION BY tenant_id, slug ORDER BY request_id) = 1)""", _REQUESTS))
def register_projects(spark, d):
    rows = requests(spark, d).withColumn("created_at", F.lit(None).cast("timestamp"))
    return quality.register_projects(rows)[0].select("id", "tenant_id", "name", "slug", "qdrant_collection")


@query("project_rejects", with_views("""
SELECT request_id, CASE WHEN missing <> '' THEN concat('missing ', missing) ELSE 'duplicate tenant_id,slug' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, slug, missing ORDER BY request_id) AS n FROM checked) WHERE missing <> '' OR n > 1""", _REQUESTS))
def project_rejects(spark, d):
    return quality.register_projects(requests(spark, d).withColumn("created_at", F.lit(None).cast("timestamp")))[1]


@query("apply_defaults", with_views("""
SELECT document_id, CASE WHEN doc_type = '' THEN 'requirement' ELSE doc_type END AS doc_type FROM fx_uploads"""))
def apply_defaults(spark, d):
    return quality.apply_defaults(view(spark, d, "fx_uploads"), {"doc_type": "requirement"}).select("document_id", "doc_type")


@query("unique_slug", with_views("""
SELECT tenant_id, slug, project_id, 'duplicate tenant_id,slug' AS reason FROM fx_projects
QUALIFY row_number() OVER (PARTITION BY tenant_id, slug ORDER BY project_id) > 1"""))
def unique_slug(spark, d):
    rejects = quality.unique_first(view(spark, d, "fx_projects"), ["tenant_id", "slug"], "project_id", [])[1]
    return rejects.select("tenant_id", "slug", "project_id", "reason")


@query("fk_violations", with_views("""
SELECT run_id AS row_id, 'test_runs.project_id' AS reason FROM fx_runs WHERE project_id NOT IN (SELECT project_id FROM fx_projects WHERE name LIKE '%1')
UNION ALL SELECT project_id, 'projects.tenant_id' FROM fx_projects WHERE tenant_id NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)"""))
def fk_violations(spark, d):
    projects = view(spark, d, "fx_projects")
    runs = quality.fk_violations(
        view(spark, d, "fx_runs"), "project_id", "run_id", projects.filter("name LIKE '%1'"), "project_id", "test_runs.project_id")
    tenants = view(spark, d, "nation").filter("n_regionkey < 4")
    return runs.unionByName(quality.fk_violations(projects, "tenant_id", "project_id", tenants, "n_nationkey", "projects.tenant_id"))


_DB = {t: f"fx_db_{t}" for t in ("tenants", "projects", "documents", "test_runs", "reports")}


@query("fk_violations_all", with_views("\nUNION ALL ".join(
    f"SELECT '{child}.{column}' AS reason, CAST(id AS VARCHAR) AS row_id FROM {_DB[child]} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {_DB[parent]})"
    for child, column, parent, key in FOREIGN_KEYS)))
def fk_violations_all(spark, d):
    return quality.all_fk_violations({t: view(spark, d, name) for t, name in _DB.items()})


@query("tenant_slug_rejects", with_views("""
SELECT id, 'duplicate slug' AS reason FROM (SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_custkey % 977 ORDER BY c_custkey) AS n FROM customer) WHERE n > 1"""))
def tenant_slug_rejects(spark, d):
    tenants = view(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("t-"), F.col("c_custkey") % 977).alias("slug"))
    return quality.unique_first(tenants, ["slug"], "id", [])[1].select("id", "reason")


@query("list_projects", with_views("""
SELECT project_id, name, slug, collection FROM fx_projects WHERE tenant_id = 7"""))
def list_projects(spark, d):
    return quality.list_projects(view(spark, d, "fx_projects"), 7).select("project_id", "name", "slug", "collection")


# --- keys and files ----------------------------------------------------------------------------------------------


@query("key_parse", with_views("""
SELECT document_id, split_part(s3_path, '/', 1) AS tenant, split_part(s3_path, '/', 2) AS project, split_part(s3_path, '/', -1) AS filename FROM fx_uploads"""))
def key_parse(spark, d):
    return quality.key_parts(view(spark, d, "fx_uploads"), "s3_path").select("document_id", "tenant", "project", "filename")


@query("file_gate", with_views("""
SELECT document_id, concat('Unsupported file type for ''', split_part(s3_path, '/', 4), '''. Use a .txt file for now.') AS reason
FROM fx_uploads WHERE NOT lower(s3_path) LIKE '%.txt'"""))
def file_gate(spark, d):
    name = F.split_part("s3_path", F.lit("/"), F.lit(-1))
    return quality.file_gate(view(spark, d, "fx_uploads"), name)[1].select("document_id", "reason")


@query("extract_text", with_views("SELECT document_id, text FROM fx_uploads WHERE lower(s3_path) LIKE '%.txt'"))
def extract_text(spark, d):
    """Texts as bytes with an invalid byte between the two copies of their halves; decoding drops it again."""
    half = F.expr("length(text) div 2")
    raw = F.concat(
        F.encode(F.substr("text", F.lit(1), half), "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.substr("text", half + 1), "UTF-8"))
    files = view(spark, d, "fx_uploads").select("document_id", F.col("s3_path").alias("name"), raw.alias("content"))
    return quality.extract_text(files)[0].select("document_id", "text")


# every seventh upload has lost its blob; with the wrong file types these are the rejects
@query("uploads_without_blob", with_views("""
SELECT document_id, CASE WHEN NOT lower(s3_path) LIKE '%.txt' THEN concat('Unsupported file type for ''', name, '''. Use a .txt file for now.')
  ELSE concat('No content found for ''', name, '''.') END AS reason
FROM (SELECT *, split_part(s3_path, '/', 4) AS name FROM fx_uploads) u WHERE NOT lower(s3_path) LIKE '%.txt' OR document_id % 7 = 3"""))
def uploads_without_blob(spark, d):
    files = view(spark, d, "fx_uploads").select("document_id", F.split_part("s3_path", F.lit("/"), F.lit(-1)).alias("name"))
    blobs = view(spark, d, "documents").filter("doc_id % 7 <> 3").select(F.col("doc_id").alias("document_id"), F.encode("text", "UTF-8").alias("content"))
    return quality.extract_text(files.join(blobs, "document_id", "left"))[1].select("document_id", "reason")


@query("upload_register", with_views("""
SELECT id, tenant_id, project_id, name, doc_type, s3_path, 'uploaded' AS status,
  concat('{"eventType":"document.uploaded","tenantId":"', tenant_id, '","projectId":"', project_id, '","documentId":"', id,
    '","s3Path":"', s3_path, '","correlationId":"corr-', document_id, '","timestamp":"2024-01-02T03:04:05.678Z"}') AS value
FROM (SELECT *, sha256(CAST(document_id AS VARCHAR)) AS id, split_part(s3_path, '/', 4) AS name FROM (
  SELECT document_id, tenant_id, project_id, s3_path, CASE WHEN doc_type = '' THEN 'requirement' ELSE doc_type END AS doc_type FROM fx_uploads))"""))
def upload_register(spark, d):
    files = view(spark, d, "fx_uploads").select(
        F.col("document_id").alias("upload_id"), "tenant_id", "project_id",
        F.split_part("s3_path", F.lit("/"), F.lit(-1)).alias("file"), "doc_type",
        F.lit("2024-01-02 03:04:05.678").cast("timestamp_ntz").alias("created_at"),
        F.concat(F.lit("corr-"), F.col("document_id").cast("string")).alias("correlation_id"))
    documents, uploaded, _ = quality.register_uploads(files)
    return documents.drop("created_at").join(uploaded, "id")


def run_requests(spark, d):
    """Run requests: 'ui' runs leave their source empty, a part has no prompt."""
    return view(spark, d, "fx_runs").select(
        F.col("run_id").alias("request_id"), "tenant_id", "project_id",
        F.when(F.col("run_source") == "ui", "").otherwise(F.col("run_source")).alias("run_source"), "url",
        F.when(F.col("run_id") % 7 == 0, "").otherwise(F.col("prompt")).alias("prompt"),
        F.lit("2024-01-02 03:04:05.678").cast("timestamp_ntz").alias("created_at"),
        F.concat(F.lit("corr-"), F.col("run_id").cast("string")).alias("correlation_id"))


_RUN_REQUESTS = """
requests AS (SELECT *, sha256(CAST(run_id AS VARCHAR)) AS id, CASE WHEN run_id % 7 = 0 THEN '' ELSE prompt END AS given FROM fx_runs)"""


@query("run_register", with_views("""
SELECT id, tenant_id, project_id, run_source, url, prompt, 'queued' AS status FROM requests WHERE given <> ''""", _RUN_REQUESTS))
def run_register(spark, d):
    return quality.register_runs(run_requests(spark, d))[0].drop("created_at", "completed_at")


@query("run_rejects", with_views("SELECT run_id AS request_id, 'prompt' AS missing FROM requests WHERE given = ''", _RUN_REQUESTS))
def run_rejects(spark, d):
    return quality.register_runs(run_requests(spark, d))[2].select("request_id", "missing")


@query("event_test_requested", with_views("""
SELECT id, concat('{"eventType":"test.requested","tenantId":"', tenant_id, '","projectId":"', project_id, '","runId":"', id, '","url":"', url,
  '","prompt":"', prompt, '","runSource":"', run_source, '","correlationId":"corr-', run_id, '","timestamp":"2024-01-02T03:04:05.678Z"}') AS value
FROM requests WHERE given <> ''""", _RUN_REQUESTS))
def event_test_requested(spark, d):
    return quality.register_runs(run_requests(spark, d))[1]


@query("blob_manifest", with_views("""
SELECT concat(s3_path) AS key, split_part(s3_path, '/', 1) AS tenant, split_part(s3_path, '/', 2) AS project, CAST(NULL AS VARCHAR) AS run, 'document' AS kind, CAST(NULL AS INT) AS attempt FROM fx_uploads
UNION ALL SELECT concat_ws('/', tenant_id, project_id, run_id, 'report.html'), CAST(tenant_id AS VARCHAR), CAST(project_id AS VARCHAR), CAST(run_id AS VARCHAR), 'report', NULL FROM fx_runs
UNION ALL SELECT concat_ws('/', tenant_id, project_id, run_id, concat('dom_attempt_', attempt, '.html')), CAST(tenant_id AS VARCHAR), CAST(project_id AS VARCHAR), CAST(run_id AS VARCHAR), 'dom', attempt
  FROM fx_attempts JOIN fx_runs USING (run_id)"""))
def blob_manifest(spark, d):
    runs = view(spark, d, "fx_runs")
    base = [F.col(c).cast("string") for c in ("tenant_id", "project_id", "run_id")]
    dom = view(spark, d, "fx_attempts").join(runs, "run_id")
    keys = (
        view(spark, d, "fx_uploads").select(F.col("s3_path").alias("key"))
        .unionByName(runs.select(F.concat_ws("/", *base, F.lit("report.html")).alias("key")))
        .unionByName(dom.select(F.concat_ws("/", *base, F.concat(F.lit("dom_attempt_"), F.col("attempt"), F.lit(".html"))).alias("key")))
    )
    return quality.blob_manifest(keys)


@query("orphans", with_views("""
SELECT DISTINCT s3_path AS key, 'blob without row' AS side FROM fx_uploads WHERE s3_path NOT IN (SELECT s3_path FROM fx_uploads WHERE doc_type <> 'user_story')
UNION ALL SELECT DISTINCT s3_path, 'row without blob' FROM fx_uploads WHERE s3_path NOT IN (SELECT s3_path FROM fx_uploads WHERE doc_type <> '')"""))
def orphans(spark, d):
    u = view(spark, d, "fx_uploads")
    return quality.orphans(u.filter("doc_type <> ''"), u.filter("doc_type <> 'user_story'"), "s3_path")


@query("shadowed_uploads", with_views("SELECT s3_path AS key, count(*) AS uploads FROM fx_uploads GROUP BY s3_path HAVING count(*) > 1"))
def shadowed_uploads(spark, d):
    return quality.shadowed_uploads(view(spark, d, "fx_uploads"))


# --- event logs --------------------------------------------------------------------------------------------------


@query("event_windows", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def event_windows(spark, d):
    w = events.event_windows(view(spark, d, "events"), "ts", "1 day", ["event_type"])
    return w.select(F.col("window_start").alias("day"), "event_type", "n")


@query("dedup_events", """
SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def dedup_events(spark, d):
    return events.dedup_events(view(spark, d, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


_LOG = """
log AS (SELECT event_id, CASE event_type WHEN 'error' THEN substr(props, 1, length(props) - 1) WHEN 'click' THEN '{"tenantId":"t"}'
  ELSE concat('{"documentId":"d', event_id, '","tenantId":"t', user_id, '","s3Path":"p"}') END AS value FROM events)"""


def _lines(spark, d):
    e = view(spark, d, "events")
    doc = F.concat(F.lit('{"documentId":"d'), F.col("event_id"), F.lit('","tenantId":"t'), F.col("user_id"), F.lit('","s3Path":"p"}'))
    value = (
        F.when(F.col("event_type") == "error", F.substr("props", F.lit(1), F.length("props") - 1))
        .when(F.col("event_type") == "click", '{"tenantId":"t"}').otherwise(doc))
    return events.parse_events(e.select("event_id", value.alias("value")), schemas.DOCUMENT_UPLOADED, ["documentId", "s3Path"])


@query("parse_events", with_views("""
SELECT json_extract_string(value, '$.documentId') AS "documentId", json_extract_string(value, '$.tenantId') AS "tenantId"
FROM (SELECT value FROM log WHERE json_valid(value)) WHERE json_extract_string(value, '$.documentId') IS NOT NULL""", _LOG))
def parse_events(spark, d):
    return _lines(spark, d)[0].select("documentId", "tenantId")


@query("event_rejects", with_views("""
SELECT event_id, CASE WHEN json_valid(value) THEN 'missing documentId,s3Path' ELSE 'malformed' END AS reason FROM log
WHERE NOT json_valid(value) OR NOT contains(value, 'documentId')""", _LOG))
def event_rejects(spark, d):
    return _lines(spark, d)[1].select("event_id", "reason")


# uploads happen at the event's time; purchases are the documents that got indexed
@query("pending_index", """
SELECT event_id AS document_id FROM events WHERE event_type <> 'purchase' AND ts + INTERVAL 3 HOUR < TIMESTAMP '2024-01-30 00:00:00'""")
def pending_index(spark, d):
    e = view(spark, d, "events")
    uploads = e.select(F.col("event_id").alias("document_id"), F.col("ts").alias("uploaded_at"))
    done = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("document_id"))
    now = F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'")
    return events.unanswered(uploads, done, "document_id", "uploaded_at", now, F.expr("INTERVAL '3' HOUR")).select("document_id")


# run requests older than a day without a finished attempt
@query("unreported_runs", with_views("""
SELECT run_id FROM fx_runs WHERE created_at + INTERVAL 24 HOUR < TIMESTAMP '1998-01-01 00:00:00'
  AND run_id NOT IN (SELECT run_id FROM eff WHERE passed)""", CLASSIFIED))
def unreported_runs(spark, d):
    done = runs.effective_attempts(view(spark, d, "fx_attempts"), unique=True).filter("passed")
    now = F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    return events.unanswered(view(spark, d, "fx_runs"), done, "run_id", "created_at", now, F.expr("INTERVAL '24' HOUR")).select("run_id")


@query("document_status", """
SELECT doc_id AS document_id, CASE WHEN l.doc_id IS NULL THEN 'uploaded' ELSE 'indexed' END AS status
FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def document_status(spark, d):
    uploads = view(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    indexed = view(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.col("quality").alias("chunk_count"))
    return events.document_status(uploads, indexed).select("document_id", "status")
