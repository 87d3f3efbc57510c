import json
import os

from pyspark.sql import functions as F

from qaloom import schemas
from qaloom.operators.events import dedup_stream, event_windows, parse_events
from qaloom.operators.vectors import hash_embedder
from qaloom.sources import readers, writers
from qaloom.streaming import documents, lineage, runs, sinks


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def upload(i, ts="2024-01-01T00:00:00.000Z", name="a.txt"):
    return {"eventType": "document.uploaded", "tenantId": "t", "projectId": "p", "documentId": f"d{i}", "s3Path": f"t/p/documents/{i}_{name}",
            "correlationId": f"c{i}", "timestamp": ts}


def test_documents_end_to_end_with_duplicates_bad_lines_and_restart(spark, tmp_path):
    blobs, events, root, ck = (str(tmp_path / x) for x in ("blobs", "events", "out", "ck"))
    for i, (name, body) in enumerate([("a.txt", b"one two\n\nthree \xff four"), ("a.txt", b"w " * 250), ("a.pdf", b"x"), ("a.txt", b"late")]):
        os.makedirs(f"{blobs}/t/p/documents", exist_ok=True)
        with open(f"{blobs}/t/p/documents/{i}_{name}", "wb") as f:
            f.write(body)
    put(events, "1.json", [upload(0), upload(0), "{broken", upload(1), upload(2, name="a.pdf"), {"tenantId": "t"}])
    table = readers.read_blobs(spark, blobs).select("key", "content")

    def run():
        lines = readers.stream_lines(spark, events)
        good, _ = parse_events(lines, schemas.DOCUMENT_UPLOADED, ["documentId", "s3Path"])
        drain(documents.start_indexing(documents.uploads_with_content(good, table), hash_embedder(8), root, ck, once=True))

    run()
    points = spark.read.parquet(f"{root}/points")
    assert {(r.document_id, r.chunk_index, r.text) for r in points.collect()} == {("d0", 0, "one two three  four"), ("d1", 0, ("w " * 250).strip())}
    indexed = [json.loads(r.value) for r in spark.read.parquet(f"{root}/knowledge_indexed").collect()]
    assert sorted((e["documentId"], e["chunkCount"], e["correlationId"]) for e in indexed) == [("d0", 1, "c0"), ("d1", 1, "c1")]
    assert [r.name for r in spark.read.parquet(f"{root}/rejects").collect()] == ["2_a.pdf"]
    # a restart goes on after the last event; the repeated delivery is still known
    put(events, "2.json", [upload(0), upload(3)])
    run()
    assert {r.document_id for r in spark.read.parquet(f"{root}/points").collect()} == {"d0", "d1", "d3"}
    assert spark.read.parquet(f"{root}/points").count() == 3


def test_a_later_upload_replaces_a_document_and_a_late_one_does_not(spark, tmp_path):
    blobs, events, root, ck = (str(tmp_path / x) for x in ("blobs", "events", "out", "ck"))
    bodies = {"0_a.txt": "w " * 150 + "\n\n" + "v " * 150, "1_a.txt": "keep", "0_b.txt": "short", "0_c.txt": "old " * 150 + "\n\n" + "x " * 190, "2_a.txt": "z"}
    os.makedirs(f"{blobs}/t/p/documents")
    for name, body in bodies.items():
        with open(f"{blobs}/t/p/documents/{name}", "w") as f:
            f.write(body)
    at = lambda day: f"2024-01-{day:02d}T00:00:00.000Z"

    def run():
        good, _ = parse_events(readers.stream_lines(spark, events), schemas.DOCUMENT_UPLOADED, ["documentId", "s3Path"])
        table = readers.read_blobs(spark, blobs).select("key", "content")
        drain(documents.start_indexing(documents.uploads_with_content(good, table, delay="60 days"), hash_embedder(8), root, ck, once=True))

    def points():
        return sorted((r.document_id, r.chunk_index, r.text.strip()[:5]) for r in spark.read.parquet(f"{root}/points").collect())

    put(events, "1.json", [upload(0, at(5)), upload(1, at(5)), upload(2, at(5))])
    run()
    assert points() == [("d0", 0, "w w w"), ("d0", 1, "v v v"), ("d1", 0, "keep"), ("d2", 0, "z")]
    untouched = {f: os.path.getmtime(os.path.join(p, f)) for p, _, fs in os.walk(f"{root}/points/collection=t_p") for f in fs if f.endswith("parquet")}
    put(events, "2.json", [upload(0, at(9), "b.txt")])  # the same document, one chunk now
    run()
    assert points() == [("d0", 0, "short"), ("d1", 0, "keep"), ("d2", 0, "z")]
    kept = [f for p, _, fs in os.walk(f"{root}/points/collection=t_p") for f in fs if untouched.get(f) == os.path.getmtime(os.path.join(p, f))]
    assert kept  # buckets without a new document were not written
    put(events, "3.json", [upload(0, at(2), "c.txt"), upload(0, at(9), "b.txt"), upload(3, at(2))])  # late, repeated, and without a blob
    run()
    assert points() == [("d0", 0, "short"), ("d1", 0, "keep"), ("d2", 0, "z")]
    assert [r.version for r in spark.read.parquet(f"{root}/points").filter("document_id = 'd0'").collect()] == [1704758400000000]


def test_a_merge_that_failed_half_way_is_finished(spark, tmp_path):
    path = str(tmp_path / "points")
    cols = "id string, collection string, document_id string, chunk_index int, version long, text string"
    rows = lambda *r: spark.createDataFrame([(f"{d}{i}", c, d, i, v, t) for c, d, i, v, t in r], cols)
    table = lambda: sorted((r.document_id, r.chunk_index, r.text) for r in spark.read.parquet(path).collect())
    writers.merge_points(spark, rows(("c", "d", 0, 1, "a"), ("c", "d", 1, 1, "b"), ("c", "e", 0, 1, "e")), path, 0, buckets=1)
    new = rows(("c", "d", 0, 2, "new"))
    writers.merge_points(spark, new, path, 1, buckets=1)
    assert table() == [("d", 0, "new"), ("e", 0, "e")]
    # the table was lost between the two steps: the copy beside it is put back, whatever the table holds
    writers._remove(spark, path)
    writers.merge_points(spark, new, path, 1, buckets=1)
    assert table() == [("d", 0, "new"), ("e", 0, "e")]
    writers.merge_points(spark, rows(("c", "d", 0, 1, "late"), ("c", "d", 3, 1, "late"), ("c", "f", 0, None, "f")), path, 2, buckets=1)
    assert table() == [("d", 0, "new"), ("e", 0, "e"), ("f", 0, "f")]
    assert os.listdir(f"{path}_merged") == ["batch=2"]


def test_nothing_is_lost(spark, tmp_path):
    """Uploads without a blob and bad lines both end in a table, with reasons."""
    blobs, events, root, ck = (str(tmp_path / x) for x in ("blobs", "events", "out", "ck"))
    put(f"{blobs}/t/p/documents", "0_a.txt", ["hello"])
    put(events, "1.json", [upload(0), upload(1), "{broken", {"tenantId": "t"}])
    table = readers.read_blobs(spark, blobs).select("key", "content")
    good, bad = parse_events(readers.stream_lines(spark, events), schemas.DOCUMENT_UPLOADED, ["documentId", "s3Path"])
    drain(documents.start_indexing(documents.uploads_with_content(good, table), hash_embedder(8), root, ck, once=True))
    drain(documents.start_rejected_lines(bad, f"{root}/bad", str(tmp_path / "ck2"), once=True))
    assert [(r.document_id, r.reason) for r in spark.read.parquet(f"{root}/rejects").collect()] == [("d1", "No content found for '1_a.txt'.")]
    assert {r.document_id for r in spark.read.parquet(f"{root}/points").collect()} == {"d0"}
    assert sorted(r.reason for r in spark.read.parquet(f"{root}/bad").collect()) == ["malformed", "missing documentId,s3Path"]


def test_blob_stream_joins_events(spark, tmp_path):
    blobs, events = str(tmp_path / "b"), str(tmp_path / "e")
    put(f"{blobs}/t/p/documents", "0_a.txt", ["hello"])
    now = spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")").first()[0]
    put(events, "1.json", [upload(0, now)])
    good, _ = parse_events(readers.stream_lines(spark, events), schemas.DOCUMENT_UPLOADED)
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema(spark.read.format("binaryFile").load(f"{blobs}/t/p/documents").schema).load(blobs)
    files = files.select(F.split_part("path", F.lit(blobs + "/"), F.lit(-1)).alias("key"), F.col("modificationTime").alias("modified"), "content")
    out = documents.uploads_with_content(good, files, dedup=False)
    drain(sinks.start(out, str(tmp_path / "o"), str(tmp_path / "ck"), once=True))
    assert [(r.document_id, r.name) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("d0", "0_a.txt")]


ATT = "run_id string, attempt int, passed boolean, pipeline_error string, ts timestamp"


def attempt(run, n, ok, err=None, minute=0):
    return {"run_id": run, "attempt": n, "passed": ok, "pipeline_error": err, "ts": f"2024-01-01T00:{minute:02d}:00Z"}


def test_run_ends_and_retries_in_any_order(spark, tmp_path):
    src = str(tmp_path / "a")
    # attempt 2 of 'a' arrives before attempt 1 and twice
    put(src, "1.json", [attempt("a", 2, True), attempt("b", 1, False), attempt("c", 1, False, "boom")])
    put(src, "2.json", [attempt("a", 1, False), attempt("a", 2, True), attempt("b", 2, False), attempt("b", 3, False)])
    read = lambda: spark.readStream.schema(ATT).json(src)
    for name, df in (("done", runs.finished_runs(read())), ("next", runs.retry_requests(read()))):
        drain(sinks.start(df, str(tmp_path / name), str(tmp_path / f"ck_{name}"), once=True))
    done = {(r.run_id, r.attempt) for r in spark.read.parquet(str(tmp_path / "done")).collect()}
    assert done == {("a", 2), ("b", 3), ("c", 1)}
    nxt = sorted((r.run_id, r.attempt) for r in spark.read.parquet(str(tmp_path / "next")).collect())
    assert nxt == [("a", 2), ("b", 2), ("b", 3)]


def test_a_run_without_a_next_attempt_stalls_across_a_restart(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("a", "o", "ck"))

    def run():
        read = spark.readStream.schema(ATT).option("maxFilesPerTrigger", 1).json(src)
        drain(sinks.start(runs.attempt_states(read, "30 minutes", "5 minutes"), out, ck, once=True))
        return sorted((r.run_id, r.attempt, r.since.strftime("%H:%M"), r.state) for r in spark.read.parquet(out).collect())

    late = lambda r: r | {"ts": r["ts"].replace("T00", "T01")}
    # 'b' ends at once, 'a' and 'c' fail, 'a' comes twice; the third attempt of 'd' is known before its first
    put(src, "1.json", [attempt("a", 1, False), attempt("a", 1, False), attempt("b", 1, True), attempt("c", 1, False, minute=2), attempt("d", 3, False, minute=4)])
    assert run() == [("b", 1, "00:00", "finished"), ("d", 3, "00:04", "finished")]
    # after a restart: 'c' goes on and ends; 'a' is silent
    put(src, "2.json", [attempt("c", 2, True, minute=20), attempt("d", 1, False, minute=1), attempt("e", 1, False, minute=50)])
    assert run() == [("a", 1, "00:00", "stalled"), ("b", 1, "00:00", "finished"), ("c", 2, "00:20", "finished"), ("d", 3, "00:04", "finished")]
    # 'a' goes on after all; 'e' stalls with the attempt it had
    put(src, "3.json", [late(attempt("a", 2, True, minute=10)), late(attempt("f", 1, False, "crash", minute=59))])
    got = run()
    assert ("a", 2, "01:10", "finished") in got and ("e", 1, "00:50", "stalled") in got and ("f", 1, "01:59", "finished") in got and len(got) == 7


def test_progress_equals_batch(spark, tmp_path):
    src = str(tmp_path / "p")
    put(src, "1.json", [attempt("a", 1, False), attempt("a", 2, True), attempt("b", 1, None, "x")])
    q = (runs.run_progress(spark.readStream.schema(ATT).json(src)).writeStream.format("memory").queryName("progress")
         .outputMode("complete").trigger(availableNow=True).start())
    drain(q)
    cols = ["run_id", "attempts", "passed", "last_error"]
    batch = runs.run_progress(spark.read.schema(ATT).json(src)).select(cols).collect()
    assert sorted(map(tuple, spark.table("progress").select(cols).collect())) == sorted(map(tuple, batch)) == [("a", 2, True, None), ("b", 1, False, "x")]


EV = "correlation_id string, ts timestamp"


def test_unanswered_uploads_come_out_after_the_watermark(spark, tmp_path):
    up, ix = str(tmp_path / "u"), str(tmp_path / "i")
    at = lambda k, m: {"correlation_id": k, "ts": f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00Z"}
    put(up, "1.json", [at("x", 0), at("y", 1), at("z", 2)])
    put(ix, "1.json", [at("x", 3), at("z", 30)])  # z is answered too late
    put(up, "2.json", [at("end", 300)])
    put(ix, "2.json", [at("other", 300)])
    read = lambda p: spark.readStream.schema(EV).option("maxFilesPerTrigger", 1).json(p)
    df = lineage.unanswered(read(up), read(ix), "5 minutes", "10 minutes")
    drain(sinks.start(df, str(tmp_path / "o"), str(tmp_path / "ck"), once=True))
    assert {r.correlation_id for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {"y", "z"}


def test_windows_on_a_stream_equal_batch(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    src.repartition(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "e"))
    counts = event_windows(stream, "ts", "1 day", ["event_type"], watermark="1 hour")
    drain(counts.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start())
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, event_windows(src, "ts", "1 day", ["event_type"]).collect()))


def test_stream_dedup(spark, tmp_path):
    src = str(tmp_path / "d")
    put(src, "1.json", [{"correlation_id": "a", "ts": "2024-01-01T00:00:00Z"}] * 3 + [{"correlation_id": "b", "ts": "2024-01-01T00:01:00Z"}])
    df = dedup_stream(spark.readStream.schema(EV).json(src), ["correlation_id"], "ts", "1 hour")
    drain(sinks.start(df, str(tmp_path / "o"), str(tmp_path / "ck"), once=True))
    assert sorted(r.correlation_id for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["a", "b"]


def test_tables_append_update_and_events(spark, tmp_path):
    from qaloom.operators.reports import apply_run_updates

    path = str(tmp_path / "runs")
    rows = spark.createDataFrame([(f"r{i}", f"t{i % 3}", "queued", None) for i in range(9)], "run_id string, tenant_id string, status string, completed_at string")
    writers.append_rows(rows, path, ["tenant_id"])
    untouched = {f: os.path.getmtime(f"{path}/tenant_id=t1/{f}") for f in os.listdir(f"{path}/tenant_id=t1")}
    table = readers.read_table(spark, path)
    upd = spark.createDataFrame([("r3", 1, "completed", "now")], "run_id string, attempt int, status string, completed_at string")
    touched = table.join(upd.select("run_id"), "run_id", "left_semi")
    writers.overwrite_touched(spark, apply_run_updates(table, upd), touched, path, "tenant_id")
    after = {r.run_id: r.status for r in spark.read.parquet(path).collect()}
    assert after == {f"r{i}": "completed" if i == 3 else "queued" for i in range(9)}
    assert {f: os.path.getmtime(f"{path}/tenant_id=t1/{f}") for f in os.listdir(f"{path}/tenant_id=t1")} == untouched
    writers.write_events(spark.createDataFrame([('{"a":1}',)], "value string"), str(tmp_path / "ev"))
    assert [r.value for r in spark.read.text(str(tmp_path / "ev")).collect()] == ['{"a":1}']


def test_requests_become_prompts(spark, tmp_path):
    from qaloom.operators import vectors
    from qaloom.streaming import requests

    chunks = spark.createDataFrame(
        [("t", "p", "d1", 0, "login page needs an email"), ("t", "p", "d2", 0, "cart shows totals"), ("t", "q", "d3", 0, "login of another project")],
        "tenant_id string, project_id string, document_id string, chunk_index int, text string")
    vectors.make_points(chunks, hash_embedder(32)).write.parquet(str(tmp_path / "points"))
    pages = spark.createDataFrame([("r1", "MAP", "T", (800, 600))], "run_id string, page_structure string, page_title string, viewport struct<width:int,height:int>")
    put(str(tmp_path / "in"), "1.json", [
        {"runId": "r1", "tenantId": "t", "projectId": "p", "url": "http://u", "prompt": "login page"},
        {"runId": "r2", "tenantId": "t", "projectId": "none", "url": "http://v", "prompt": "x"}, "{bad"])
    good, _ = parse_events(readers.stream_lines(spark, str(tmp_path / "in")), schemas.TEST_REQUESTED, ["runId", "url", "prompt"])
    drain(requests.start_prompts(
        good, lambda: spark.read.parquet(str(tmp_path / "points")), lambda: pages, hash_embedder(32), str(tmp_path / "out"), str(tmp_path / "ck"), once=True))
    got = {r.run_id: r.user_prompt for r in spark.read.parquet(str(tmp_path / "out" / "prompts")).collect()}
    assert "- login page needs an email\n- cart shows totals\n" in got["r1"] and "another project" not in got["r1"]
    assert "MAP" in got["r1"] and "Viewport: 800x600" in got["r1"]
    assert "(no project documents indexed)" in got["r2"] and "(could not fetch page structure)" in got["r2"]


def test_upsert_replaces_only_touched_collections(spark, tmp_path):
    path = str(tmp_path / "points")
    cols = "id string, collection string, version long, text string"
    writers.upsert_table(spark, spark.createDataFrame([("a", "7", 1, "x"), ("b", "8", 1, "y")], cols), path)
    kept = {f: os.path.getmtime(f"{path}/collection=8/{f}") for f in os.listdir(f"{path}/collection=8")}
    writers.upsert_table(spark, spark.createDataFrame([("a", "7", 2, "new"), ("c", "7", 1, "z")], cols), path)
    writers.upsert_table(spark, spark.createDataFrame([("a", "7", 1, "stale")], cols), path)
    rows = {(r.id, r.collection, r.text) for r in spark.read.schema(cols).parquet(path).collect()}
    assert rows == {("a", "7", "new"), ("b", "8", "y"), ("c", "7", "z")}
    assert {f: os.path.getmtime(f"{path}/collection=8/{f}") for f in os.listdir(f"{path}/collection=8")} == kept
