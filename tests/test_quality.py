from pyspark.sql import functions as F

from qaloom.operators import quality as q


def test_required_null_and_empty_reject_blank_passes(spark):
    df = spark.createDataFrame([(1, "t", "n", "s"), (2, None, "", "s"), (3, " ", "n", None)], "request_id int, tenant_id string, name string, slug string")
    good, bad = q.validate_required(df, q.REQUIRED["project"])
    assert [r.request_id for r in good.collect()] == [1]
    assert {r.request_id: r.missing for r in bad.collect()} == {2: "tenant_id,name", 3: "slug"}


def test_projects_first_insert_wins(spark):
    rows = [(1, "t", "A", "s", 2), (2, "t", "B", "s", 1), (3, "u", "C", "s", 3), (4, "t", "", "x", 0)]
    df = spark.createDataFrame(rows, "request_id int, tenant_id string, name string, slug string, at int").withColumn(
        "created_at", F.timestamp_seconds("at")).drop("at")
    projects, rejects = q.register_projects(df)
    got = projects.collect()
    assert {(r.tenant_id, r.name) for r in got} == {("t", "B"), ("u", "C")}
    assert all(r.qdrant_collection == f"{r.tenant_id}_{r.id}" for r in got)
    assert {r.request_id: r.reason for r in rejects.collect()} == {1: "duplicate tenant_id,slug", 4: "missing name"}


def test_uploads_row_and_event_agree(spark):
    import json

    df = spark.createDataFrame([("1", "t", "p", "a.txt", "", "c1"), ("2", "t", "p", None, "x", "c2")],
                               "upload_id string, tenant_id string, project_id string, file string, doc_type string, correlation_id string"
                               ).withColumn("created_at", F.expr("timestamp'2024-05-06 07:08:09.123'"))
    docs, ev, rejects = q.register_uploads(df)
    d, e = docs.first(), json.loads(ev.first().value)
    assert (d.doc_type, d.status, d.s3_path) == ("requirement", "uploaded", "t/p/documents/a.txt")
    assert e["documentId"] == d.id and e["s3Path"] == d.s3_path and e["timestamp"] == "2024-05-06T07:08:09.123Z"
    assert [r.missing for r in rejects.collect()] == ["file"]


def test_runs_defaults(spark):
    df = spark.createDataFrame([("1", "t", "p", "u", "x", "", "c"), ("2", "t", "p", "u", "", "ci", "c")],
                               "request_id string, tenant_id string, project_id string, url string, prompt string, run_source string, correlation_id string"
                               ).withColumn("created_at", F.expr("timestamp'2024-01-01'"))
    rows, ev, rejects = q.register_runs(df)
    assert [(r.run_source, r.status) for r in rows.collect()] == [("ui", "queued")] and ev.count() == 1
    assert [r.missing for r in rejects.collect()] == ["prompt"]


def test_file_gate_and_text(spark):
    df = spark.createDataFrame([("A.TXT", b"a\xffb"), ("b.pdf", b"x"), ("c.txt", "é".encode())], "name string, content binary")
    good, bad = q.extract_text(df)
    assert {r.name: r.text for r in good.collect()} == {"A.TXT": "ab", "c.txt": "é"}
    assert [r.reason for r in bad.collect()] == ["Unsupported file type for 'b.pdf'. Use a .txt file for now."]


def test_references_orphans_and_shadows(spark):
    child = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "id int, tenant_id string")
    parent = spark.createDataFrame([("a",)], "id string")
    assert [tuple(r) for r in q.fk_violations(child, "tenant_id", "id", parent, "id", "x.tenant_id").collect()] == [(2, "x.tenant_id")]
    blobs = spark.createDataFrame([("k1",), ("k2",)], "s3_path string")
    rows = spark.createDataFrame([("k2",), ("k3",), ("k3",)], "s3_path string")
    assert {tuple(r) for r in q.orphans(blobs, rows, "s3_path").collect()} == {("k1", "blob without row"), ("k3", "row without blob")}
    assert [tuple(r) for r in q.shadowed_uploads(rows).collect()] == [("k3", 2)]


def test_manifest(spark):
    keys = ["t/p/documents/f.txt", "t/p/r1/screenshot_attempt_2.png", "t/p/r1/dom_attempt_10.html", "t/p/baselines/h.com.png", "t/p/r1/report.html"]
    got = [tuple(r)[3:] for r in q.blob_manifest(spark.createDataFrame([(k,) for k in keys], "key string")).collect()]
    assert got == [(None, "document", None), ("r1", "screenshot", 2), ("r1", "dom", 10), (None, "baseline", None), ("r1", "report", None)]


def test_schemas_seed_and_references(spark):
    from qaloom import schemas

    assert {n: len(t.fields) for n, t in schemas.TABLES.items()} == {"tenants": 4, "projects": 6, "documents": 8, "test_runs": 9, "reports": 12}
    tables = {n: spark.createDataFrame([schemas.SEED_TENANT] if n == "tenants" else [], t) for n, t in schemas.TABLES.items()}
    assert tables["tenants"].first().name == "Demo Company"
    project = spark.createDataFrame([("p1", "other", "N", "s", "other_p1", None)], schemas.PROJECTS)
    tables["projects"] = project
    found = []
    for child, column, parent, key in schemas.FOREIGN_KEYS:
        rows = q.fk_violations(tables[child], column, "id", tables[parent], key, f"{child}.{column}")
        found += [tuple(r) for r in rows.collect()]
    assert found == [("p1", "projects.tenant_id")]
    assert q.list_projects(project, "other").count() == 1 and q.list_projects(project, "none").count() == 0


def test_all_references_in_one_pass(spark):
    t = spark.createDataFrame([("t1",), ("t2",)], "id string")
    p = spark.createDataFrame([("p1", "t1"), ("p2", "t9"), ("p3", None)], "id string, tenant_id string")
    docs = spark.createDataFrame([("d1", "t1", "p1"), ("d2", "t9", "p9"), ("d3", None, None)], "id string, tenant_id string, project_id string")
    runs = spark.createDataFrame([("r1", "t2", "p2"), ("r2", "t2", "t1")], "id string, tenant_id string, project_id string")
    reports = spark.createDataFrame([("x", "t1", "p1", "r9"), ("x", "t1", "p1", "r9"), ("y", "t1", "p1", "r1")], "id string, tenant_id string, project_id string, run_id string")
    out = q.all_fk_violations({"tenants": t, "projects": p, "documents": docs, "test_runs": runs, "reports": reports})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("Join") == 1  # one pass over all references, before and after one shuffle
    assert sorted(map(tuple, out.collect())) == [
        ("documents.project_id", "d2"), ("documents.tenant_id", "d2"), ("projects.tenant_id", "p2"), ("reports.run_id", "x"), ("reports.run_id", "x"), ("test_runs.project_id", "r2")]
