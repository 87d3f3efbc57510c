"""Queries of the document pipeline: uploads, text, chunks, vectors, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaloom.functions.ids import stable_id
from qaloom.functions.text import SPACE
from qaloom.operators import chunking, events, quality, vectors
from qaloom.operators.prompts import CONTEXT_K, CONTEXT_TYPES
from qaloom.operators.skew import widen
from qaloom.plans.registry import query, quoted
from qaloom.session import spread, written
from qaloom.plans.views import view, with_views

TRIM = quoted(SPACE)
SPACE_CLASS = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DIM = 64

# --- chunks ------------------------------------------------------------------------------------------------------


def chunk_ctes(table: str = "documents", key: str = "doc_id") -> str:
    return f"""
lines AS (SELECT {key} AS doc_id, unnest(string_split(text, chr(10))) AS p,
  generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {table}),
paras AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, trim(p, {TRIM}) AS p,
  CAST(len(string_split_regex(trim(p, {TRIM}), '{SPACE_CLASS}+')) AS BIGINT) AS wc
  FROM lines WHERE trim(p, {TRIM}) <> ''),
packed AS (
  SELECT doc_id, pos, wc AS cur, 0 AS cid FROM paras WHERE pos = 1
  UNION ALL
  SELECT n.doc_id, n.pos, CASE WHEN w.cur + n.wc > 200 THEN n.wc ELSE w.cur + n.wc END,
    CASE WHEN w.cur + n.wc > 200 THEN w.cid + 1 ELSE w.cid END
  FROM packed w JOIN paras n ON n.doc_id = w.doc_id AND n.pos = w.pos + 1),
cut AS (
  SELECT doc_id, CAST(cid AS INT) AS chunk_index, CAST(sum(wc) AS INT) AS n_words, string_agg(p, ' ' ORDER BY pos) AS text
  FROM packed JOIN paras USING (doc_id, pos) GROUP BY doc_id, cid
  UNION ALL
  SELECT {key}, 0, 0, '' FROM {table} WHERE {key} NOT IN (SELECT doc_id FROM paras))"""


@query("chunks", with_views("SELECT doc_id, chunk_index, n_words, text FROM cut", chunk_ctes(), recursive=True))
def chunks(spark, d):
    return chunking.chunk_documents(widen(view(spark, d, "documents"), "doc_id", spread(spark)), "doc_id", "text", sep="\n")


@query("chunk_counts", with_views(
    "SELECT doc_id, CAST(count(*) AS INT) AS chunks FROM cut GROUP BY doc_id", chunk_ctes(), recursive=True))
def chunk_counts(spark, d):
    return chunking.chunk_counts(widen(view(spark, d, "documents"), "doc_id", spread(spark)), "doc_id", "text", sep="\n")


WEIGHTS = f"""
SELECT doc_id, chunk_index, dim, round(CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id, chunk_index)) AS FLOAT) AS DOUBLE), 6) AS weight
FROM (SELECT doc_id, chunk_index, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % {DIM} AS INT) AS dim, CAST(count(*) AS DOUBLE) AS c
  FROM (SELECT doc_id, chunk_index, unnest(string_split_regex(trim(text, {TRIM}), '{SPACE_CLASS}+')) AS w FROM cut WHERE text <> '')
  GROUP BY ALL)"""


@query("hash_embed", with_views(WEIGHTS, chunk_ctes(), recursive=True))
def hash_embed(spark, d):
    e = vectors.embed(chunks(spark, d), vectors.hash_embedder(DIM))
    return vectors.sparse_weights(e, ["doc_id", "chunk_index"])


# --- the pipeline ------------------------------------------------------------------------------------------------


def accepted_uploads(spark, d):
    uploads = widen(view(spark, d, "fx_uploads"), "document_id", spread(spark))
    return quality.file_gate(uploads, F.split_part("s3_path", F.lit("/"), F.lit(-1)))[0]


def document_chunks(spark, d):
    return chunking.chunk_documents(
        accepted_uploads(spark, d), "document_id", "text", sep="\n", keep=["tenant_id", "project_id", "doc_type"])


def _points_sql(kind: str) -> str:
    return with_views(
        f"""SELECT sha256(concat_ws('|', CAST(c.doc_id AS VARCHAR), CAST(chunk_index AS VARCHAR))) AS id,
  concat(u.tenant_id, '_', u.project_id) AS collection, CAST(c.doc_id AS BIGINT) AS document_id, chunk_index, {kind} AS type, c.text
FROM cut c JOIN fx_uploads u ON u.document_id = c.doc_id""",
        chunk_ctes("(SELECT * FROM fx_uploads WHERE lower(s3_path) LIKE '%.txt')", "document_id"), recursive=True)


@query("document_points", _points_sql("'requirement'"))
def document_points(spark, d):
    return vectors.make_points(document_chunks(spark, d), vectors.hash_embedder(DIM)).select(
        "id", "collection", "document_id", "chunk_index", "type", "text")


@query("document_points_typed", _points_sql("CASE u.doc_type WHEN '' THEN 'requirement' ELSE u.doc_type END"))
def document_points_typed(spark, d):
    typed = quality.apply_defaults(document_chunks(spark, d), {"doc_type": "requirement"})
    return vectors.make_points(typed, vectors.hash_embedder(DIM), "doc_type").select(
        "id", "collection", "document_id", "chunk_index", "type", "text")


@query("knowledge_indexed", with_views(
    """SELECT c.doc_id AS document_id, concat('{"eventType":"knowledge.indexed","tenantId":"', u.tenant_id, '","projectId":"',
  u.project_id, '","documentId":"', CAST(c.doc_id AS VARCHAR), '","chunkCount":', CAST(count(*) AS VARCHAR),
  ',"correlationId":"corr-', CAST(c.doc_id AS VARCHAR), '"}') AS value
FROM cut c JOIN fx_uploads u ON u.document_id = c.doc_id GROUP BY c.doc_id, u.tenant_id, u.project_id""",
    chunk_ctes("(SELECT * FROM fx_uploads WHERE lower(s3_path) LIKE '%.txt')", "document_id"), recursive=True))
def knowledge_indexed(spark, d):
    counts = chunking.chunk_counts(
        accepted_uploads(spark, d), "document_id", "text", sep="\n", keep=["tenant_id", "project_id"])
    return events.indexed_events(
        counts.withColumn("correlation_id", F.concat(F.lit("corr-"), F.col("document_id").cast("string"))))


# --- point tables ------------------------------------------------------------------------------------------------

_VERSIONS = """(SELECT vec_id, collection, type, 1 AS version FROM fx_points
  UNION ALL SELECT vec_id, CASE WHEN label = 0 THEN 'moved' ELSE collection END, type, CASE WHEN label = 1 THEN 0 ELSE 2 END FROM fx_points)"""


@query("vector_upsert", with_views(f"""
SELECT vec_id, collection, type, CAST(version AS INT) AS version FROM {_VERSIONS}
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY version DESC) = 1"""))
def vector_upsert(spark, d):
    p = view(spark, d, "fx_points")
    old = p.select("vec_id", "collection", "type", F.lit(1).alias("version"))
    new = p.select(
        "vec_id", F.when(F.col("label") == 0, "moved").otherwise(F.col("collection")).alias("collection"), "type",
        F.when(F.col("label") == 1, 0).otherwise(2).alias("version"))
    return vectors.upsert_points(old, new, "vec_id")


# deliveries of the uploaded documents: 5 is what the table holds; every third document comes again later and shorter, every
# third comes late in a longer version, and every fifth is delivered twice
_TXT = "fx_uploads WHERE lower(s3_path) LIKE '%.txt'"
_AGAIN = f"""(SELECT document_id, CASE document_id % 3 WHEN 0 THEN left(text, length(text) // 3) ELSE text END AS text FROM {_TXT})"""


@query("points_merged", with_views("""
SELECT sha256(concat_ws('|', CAST(doc_id AS VARCHAR), CAST(chunk_index AS VARCHAR))) AS id, doc_id AS document_id, chunk_index, text,
  CAST(CASE doc_id % 3 WHEN 0 THEN 9 ELSE 5 END AS BIGINT) AS version FROM cut""", chunk_ctes(_AGAIN, "document_id"), recursive=True))
def points_merged(spark, d):
    docs = accepted_uploads(spark, d)

    def points(some, text, version):
        rows = some.withColumns({"text": text, "version": F.lit(version).cast("bigint")})
        cut = chunking.chunk_documents(rows, "document_id", "text", sep="\n", keep=["version"])
        return cut.select(stable_id(F.col("document_id"), F.col("chunk_index")).alias("id"), "document_id", "chunk_index", "text", "version")

    text = F.col("text")
    later = points(docs.filter("document_id % 3 = 0"), F.left(text, (F.length(text) / 3).cast("int")), 9)
    late = points(docs.filter("document_id % 3 = 1"), F.concat(text, F.lit("\nlate\n"), text), 2)
    twice = points(docs.filter("document_id % 5 = 0 AND document_id % 3 > 0"), text, 5)
    incoming = later.unionByName(late).unionByName(twice).unionByName(twice)
    return vectors.merge_documents(points(docs, text, 5), incoming)


@query("collection_counts", with_views("SELECT collection, count(*) AS n FROM fx_points GROUP BY collection"))
def collection_counts(spark, d):
    return vectors.collection_counts(view(spark, d, "fx_points"))


@query("vector_contract", with_views("""
SELECT vec_id, CASE WHEN label = 9 THEN 'dimension 63' ELSE 'zero norm' END AS reason FROM fx_points WHERE label IN (8, 9)"""))
def vector_contract(spark, d):
    v = F.col("vector")
    p = view(spark, d, "fx_points").withColumn(
        "vector",
        F.when(F.col("label") == 9, F.slice(v, 1, 63)).when(F.col("label") == 8, F.transform(v, lambda x: x * 0)).otherwise(v))
    return vectors.check_vectors(p, DIM)[1].select("vec_id", "reason")


# --- retrieval ---------------------------------------------------------------------------------------------------


def _knn_sql(k: int, types: bool) -> str:
    where = " AND p.type IN ('requirement', 'user_story', 'acceptance_criteria')" if types else ""
    return f"""
v AS (SELECT vec_id, collection, type, CAST(vector AS DOUBLE[]) AS x FROM fx_points),
u AS (SELECT vec_id, collection, type, x, sqrt(list_dot_product(x, x)) AS norm FROM v),
hits AS (SELECT q.vec_id AS query_id, p.vec_id, round(list_dot_product(q.x, p.x) / (q.norm * p.norm), 6) AS score
  FROM u q JOIN u p ON q.collection = p.collection AND q.vec_id <> p.vec_id{where}),
best AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
  FROM hits QUALIFY rank <= {k})"""


def _sides(spark, d):
    p = view(spark, d, "fx_points")
    points = p.select(F.col("vec_id").alias("point_id"), "collection", "vector", "type")
    return p.select(F.col("vec_id").alias("query_id"), "collection", "vector"), points


@query("knn_topk", with_views("SELECT query_id, rank, vec_id, score FROM best", _knn_sql(5, False)))
def knn_topk(spark, d):
    q, p = _sides(spark, d)
    return vectors.knn_topk(q, p, 5, exclude_self=True, prune=False).withColumnRenamed("point_id", "vec_id")


@query("knn_filtered", with_views("SELECT query_id, rank, vec_id, score FROM best", _knn_sql(CONTEXT_K, True)))
def knn_filtered(spark, d):
    q, p = _sides(spark, d)
    return vectors.knn_topk(q, p, CONTEXT_K, CONTEXT_TYPES, exclude_self=True, prune=False).withColumnRenamed("point_id", "vec_id")


# the same rows by cells and bounds
@query("knn_bounded", with_views("SELECT query_id, rank, vec_id, score FROM best", _knn_sql(5, False)))
def knn_bounded(spark, d):
    q, p = _sides(spark, d)
    rows, _ = vectors.knn_topk_bounded(q, p, 5, exclude_self=True, cell=512)
    return rows.withColumnRenamed("point_id", "vec_id")


CONTEXT_CTES = _knn_sql(CONTEXT_K, True) + f""",
context AS (SELECT q.vec_id AS query_id, CAST(count(b.vec_id) AS INT) AS n,
  coalesce(string_agg(concat('- ', d.text), chr(10) ORDER BY b.rank), '{vectors.NO_CONTEXT}') AS block
  FROM fx_points q LEFT JOIN best b ON b.query_id = q.vec_id LEFT JOIN documents d ON d.doc_id = b.vec_id GROUP BY q.vec_id)"""


@query("context_block", with_views("SELECT query_id, n, block FROM context", CONTEXT_CTES))
def context_block(spark, d):
    q, p = _sides(spark, d)
    hits = written(vectors.knn_topk(q, p, CONTEXT_K, CONTEXT_TYPES, exclude_self=True, prune=False), "hits")
    texts = view(spark, d, "documents").select(F.col("doc_id").alias("point_id"), "text")
    return vectors.context_block(hits, q, texts)


# --- documents to prompt context, end to end ---------------------------------------------------------------------


def _vectors_sql(name: str, source: str) -> str:
    return f"""
{name} AS (SELECT id, dim, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS w
  FROM (SELECT id, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % {DIM} AS INT) AS dim, CAST(count(*) AS DOUBLE) AS c
    FROM (SELECT id, unnest(string_split_regex(trim(text, {TRIM}), '{SPACE_CLASS}+')) AS w FROM {source} WHERE trim(text, {TRIM}) <> '') GROUP BY ALL)),
{name}_norm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM {name} GROUP BY id)"""


_RETRIEVAL = (
    chunk_ctes("(SELECT * FROM fx_uploads WHERE lower(s3_path) LIKE '%.txt')", "document_id")
    + """,
points AS MATERIALIZED (SELECT sha256(concat_ws('|', CAST(c.doc_id AS VARCHAR), CAST(chunk_index AS VARCHAR))) AS id,
  concat(u.tenant_id, '_', u.project_id) AS collection, c.text FROM cut c JOIN fx_uploads u ON u.document_id = c.doc_id),
questions AS (SELECT query_id AS id, collection, text FROM fx_questions),"""
    + _vectors_sql("pw", "points") + "," + _vectors_sql("qw", "questions")
    + f""",
dots AS (SELECT qw.id AS query_id, pw.id AS point_id, sum(qw.w * pw.w) AS dot FROM qw JOIN questions q ON q.id = qw.id
  JOIN points p ON p.collection = q.collection JOIN pw ON pw.id = p.id AND pw.dim = qw.dim GROUP BY ALL),
ranked AS (SELECT q.id AS query_id, p.id AS point_id, p.text, round(coalesce(d.dot / (qn.norm * pn.norm), 0), 6) AS score,
  row_number() OVER (PARTITION BY q.id ORDER BY round(coalesce(d.dot / (qn.norm * pn.norm), 0), 6) DESC, p.id) AS rank
  FROM questions q JOIN points p ON p.collection = q.collection LEFT JOIN dots d ON d.query_id = q.id AND d.point_id = p.id
  LEFT JOIN pw_norm pn ON pn.id = p.id LEFT JOIN qw_norm qn ON qn.id = q.id QUALIFY rank <= {CONTEXT_K})"""
)


def retrieval(spark, d):
    embedder = vectors.hash_embedder(DIM)
    # the search, its block counts and the texts of the hits all read the points
    points = written(vectors.make_points(document_chunks(spark, d), embedder).withColumnRenamed("id", "point_id"), "points")
    asked = vectors.embed(view(spark, d, "fx_questions"), embedder).select("query_id", "collection", "vector")
    return vectors.knn_topk(asked, points, CONTEXT_K, CONTEXT_TYPES), asked, points


@query("prompt_retrieval", with_views(
    "SELECT query_id, CAST(rank AS INT) AS rank, point_id, score FROM ranked", _RETRIEVAL, recursive=True))
def prompt_retrieval(spark, d):
    return retrieval(spark, d)[0]


@query("prompt_context", with_views(f"""
SELECT q.id AS query_id, CAST(count(r.point_id) AS INT) AS n,
  coalesce(string_agg(concat('- ', r.text), chr(10) ORDER BY r.rank) FILTER (r.point_id IS NOT NULL), '{vectors.NO_CONTEXT}') AS block
FROM questions q LEFT JOIN ranked r ON r.query_id = q.id GROUP BY q.id""", _RETRIEVAL, recursive=True))
def prompt_context(spark, d):
    hits, asked, points = retrieval(spark, d)
    return vectors.context_block(written(hits, "hits"), asked, points.select("point_id", "text"))
