"""Intake checks and registration: required fields, defaults, uniqueness, references, file types, orphans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from qaloom.functions.ids import stable_id
from qaloom.functions.text import basename, blank, collection_name, decode_lenient, key_path, or_default
from qaloom.operators.reports import to_event
from qaloom.operators.skew import lookup_join
from qaloom.schemas import FOREIGN_KEYS

# fixed values: required fields per request kind
REQUIRED = {
    "project": ("tenant_id", "name", "slug"),
    "upload": ("tenant_id", "project_id", "file"),
    "run": ("tenant_id", "project_id", "url", "prompt"),
}


def missing_fields(fields) -> Column:
    """Names of the fields that are null or empty."""
    return F.filter(F.array(*[F.when(blank(F.col(f)), f) for f in fields]), lambda x: x.isNotNull())


def validate_required(requests: DataFrame, fields) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects). Rejects carry `missing`, the comma-separated field names."""
    marked = requests.withColumn("missing", F.array_join(missing_fields(fields), ","))
    return marked.filter("missing = ''").drop("missing"), marked.filter("missing <> ''")


def apply_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Replace null and empty values."""
    return df.withColumns({c: or_default(F.col(c), v) for c, v in defaults.items()})


def list_projects(projects: DataFrame, tenant_id) -> DataFrame:
    """Projects of one tenant; with a table partitioned by tenant_id this reads one partition."""
    return projects.filter(F.col("tenant_id") == tenant_id)


def unique_first(df: DataFrame, key: list[str], row_id: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejects): the first row per key stays.

    Winners come from a partial-aggregated minimum; the split joins on the unique row id, so a key with many rows
    never gathers in one task.
    """
    first = F.min(F.struct(*order, row_id))[row_id] if order else F.min(row_id)  # a plain minimum stays in a hash aggregate
    winners = df.groupBy(*key).agg(first.alias(row_id)).select(row_id)
    kept = df.join(winners, row_id, "left_semi")
    rejects = df.join(winners, row_id, "left_anti")
    return kept, rejects.withColumn("reason", F.lit("duplicate " + ",".join(key)))


def fk_violations(child: DataFrame, column: str, row_id: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Rows of child whose reference has no parent: row_id, reason. A null reference is allowed here (the required
    check covers it). Children of one hot parent are spread over several tasks."""
    rows = child.select(F.col(row_id).alias("row_id"), F.col(column).alias("_k")).filter("_k is not null")
    keys = parent.select(F.col(parent_key).alias("_k")).distinct()
    return lookup_join(rows, keys, ["_k"], ["row_id"], "left_anti").select("row_id", F.lit(name).alias("reason"))


def all_fk_violations(tables: dict[str, DataFrame], references=FOREIGN_KEYS, row_id: str = "id") -> DataFrame:
    """Rows whose reference has no parent, for all references at once: reason (child.column), row_id as text.

    tables: the tables of `references` (child table, column, parent table, parent column) by name. Every key, as a child refers to it
    or a parent has it, becomes one row (parent, key) with a bit for the parent and one for each reference; these meet in one
    aggregation, partly done before the shuffle, so hot parents arrive as one row per task. The keys without a parent, which are few in
    a sound database, then pick out the rows that use them. Null references are allowed here.
    """
    parents = list(dict.fromkeys(r[2:] for r in references))
    of_parent = lambda r: F.lit(parents.index(r[2:]))
    used = [
        tables[r[0]].select(of_parent(r).alias("parent"), F.col(r[1]).cast("string").alias("key"), F.lit(2 << i).alias("bits"))
        for i, r in enumerate(references)
    ]
    held = [tables[t].select(F.lit(i).alias("parent"), F.col(c).cast("string").alias("key"), F.lit(1).alias("bits")) for i, (t, c) in enumerate(parents)]
    both = reduce(DataFrame.unionByName, used + held).filter("key is not null")
    missing = both.groupBy("parent", "key").agg(F.bit_or("bits").alias("bits")).filter(F.col("bits").bitwiseAND(1) == 0)
    rows = reduce(DataFrame.unionByName, [
        tables[r[0]].select(
            of_parent(r).alias("parent"), F.col(r[1]).cast("string").alias("key"), F.col(row_id).cast("string").alias("row_id"), F.lit(f"{r[0]}.{r[1]}").alias("reason"))
        for r in references
    ])
    # a key is missing once; a semi join would be pushed below the union, once for each reference
    return rows.join(missing.select("parent", "key"), ["parent", "key"]).select("reason", "row_id")


def file_gate(files: DataFrame, name: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects): only .txt files, whatever the case."""
    ok = F.endswith(F.lower(name), F.lit(".txt"))
    message = F.concat(F.lit("Unsupported file type for '"), name, F.lit("'. Use a .txt file for now."))
    return files.filter(ok), files.filter(~ok).withColumn("reason", message)


def extract_text(files: DataFrame, name: str = "name", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(good, rejects): accepted files with their text, invalid bytes dropped. A file whose content is missing is rejected, too."""
    accepted, rejects = file_gate(files, F.col(name))
    found = F.col(content).isNotNull()
    absent = accepted.filter(~found).withColumn("reason", F.concat(F.lit("No content found for '"), F.col(name), F.lit("'.")))
    good = accepted.filter(found).withColumn("text", decode_lenient(F.col(content))).drop(content)
    return good, rejects.unionByName(absent).drop(content)


def orphans(manifest: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: key, side. Both sides are reduced to distinct keys before the shuffle, one
    aggregation finds both kinds."""
    sides = manifest.select(F.col(key).alias("key"), F.lit(1).alias("m")).unionByName(
        rows.select(F.col(key).alias("key"), F.lit(2).alias("m"))
    )
    return (
        sides.groupBy("key").agg(F.bit_or("m").alias("m")).filter("m <> 3")
        .select("key", F.when(F.col("m") == 1, "blob without row").otherwise("row without blob").alias("side"))
    )


def shadowed_uploads(documents: DataFrame) -> DataFrame:
    """Blob keys written by more than one upload: the last blob wins, every row stays."""
    return documents.groupBy(F.col("s3_path").alias("key")).agg(F.count(F.lit(1)).alias("uploads")).filter("uploads > 1")


# --- registration ------------------------------------------------------------------------------------------------


def register_projects(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects, rejects) from requests: request_id, tenant_id, name, slug, created_at. A project without a row
    never gets a collection, because both come out of one table."""
    valid, missing = validate_required(requests, REQUIRED["project"])
    kept, dup = unique_first(valid, ["tenant_id", "slug"], "request_id", ["created_at"])
    pid = stable_id(F.col("tenant_id"), F.col("request_id"))
    projects = kept.select(
        pid.alias("id"), "tenant_id", "name", "slug",
        collection_name(F.col("tenant_id"), pid).alias("qdrant_collection"), "created_at",
    )
    rejects = missing.select("request_id", F.concat(F.lit("missing "), F.col("missing")).alias("reason")).unionByName(
        dup.select("request_id", "reason")
    )
    return projects, rejects


def register_uploads(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, events, rejects) from one table: upload_id, tenant_id, project_id, file (original name), doc_type,
    created_at, correlation_id. Row and event are columns of the same record, so they can't disagree."""
    valid, rejects = validate_required(files, REQUIRED["upload"])
    base = apply_defaults(valid, {"doc_type": "requirement"}).withColumns({
        "id": stable_id(F.col("upload_id")),
        "s3_path": key_path(F.col("tenant_id"), F.col("project_id"), "documents", F.col("file")),
    })
    documents = base.select(
        "id", "tenant_id", "project_id", F.col("file").alias("name"), "doc_type", "s3_path",
        F.lit("uploaded").alias("status"), "created_at",
    )
    value = to_event(
        ("eventType", F.lit("document.uploaded")), ("tenantId", F.col("tenant_id").cast("string")),
        ("projectId", F.col("project_id").cast("string")), ("documentId", F.col("id")), ("s3Path", F.col("s3_path")),
        ("correlationId", F.col("correlation_id")), ("timestamp", iso_time(F.col("created_at"))),
    )
    return documents, base.select("id", value.alias("value")), rejects


def register_runs(requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, events, rejects) from requests: request_id, tenant_id, project_id, url, prompt, run_source, created_at,
    correlation_id."""
    valid, rejects = validate_required(requests, REQUIRED["run"])
    base = apply_defaults(valid, {"run_source": "ui"}).withColumn("id", stable_id(F.col("request_id")))
    runs = base.select(
        "id", "tenant_id", "project_id", "run_source", "url", "prompt", F.lit("queued").alias("status"), "created_at",
        F.lit(None).cast("timestamp").alias("completed_at"),
    )
    value = to_event(
        ("eventType", F.lit("test.requested")), ("tenantId", F.col("tenant_id").cast("string")),
        ("projectId", F.col("project_id").cast("string")), ("runId", F.col("id")), ("url", F.col("url")),
        ("prompt", F.col("prompt")), ("runSource", F.col("run_source")), ("correlationId", F.col("correlation_id")),
        ("timestamp", iso_time(F.col("created_at"))),
    )
    return runs, base.select("id", value.alias("value")), rejects


def iso_time(ts: Column) -> Column:
    """ISO-8601 with milliseconds and Z; sessions run in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def key_parts(df: DataFrame, key: str) -> DataFrame:
    """Blob key to tenant, project and file name."""
    part = lambda i: F.split_part(F.col(key), F.lit("/"), F.lit(i))
    return df.withColumns({"tenant": part(1), "project": part(2), "filename": basename(F.col(key))})


def blob_manifest(files: DataFrame, key: str = "key") -> DataFrame:
    """Manifest row per blob: key, tenant, project, run, kind, attempt."""
    k = F.col(key)
    part = lambda i: F.split_part(k, F.lit("/"), F.lit(i))
    third, name = part(3), basename(k)
    kind = (
        F.when(third == "documents", "document").when(third == "baselines", "baseline")
        .when(name == "report.html", "report").when(F.startswith(name, F.lit("screenshot_attempt_")), "screenshot")
        .when(F.startswith(name, F.lit("dom_attempt_")), "dom").otherwise("other")
    )
    return files.select(k.alias("key"), part(1).alias("tenant"), part(2).alias("project"), third.alias("_third"), kind.alias("kind"),
                        F.regexp_extract(name, r"_attempt_([0-9]+)\.", 1).alias("_n")).select(
        "key", "tenant", "project",
        F.when(F.col("kind").isin("report", "screenshot", "dom"), F.col("_third")).alias("run"), "kind",
        F.nullif(F.col("_n"), F.lit("")).cast("int").alias("attempt"),
    )
