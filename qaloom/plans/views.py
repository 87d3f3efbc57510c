"""Mapping views: the given tables seen as the engine's own tables.

One SQL text per view serves Spark (`view`) and the SQL check (`with_views`). Views may build on earlier views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from qaloom.operators.skew import deal_by_key
from qaloom.session import TABLES, table

VIEWS: dict[str, str] = {}

VIEWS["fx_projects"] = """
SELECT c_custkey AS project_id, c_nationkey AS tenant_id, c_name AS name,
  concat('p-', CAST(c_custkey % 40 AS STRING)) AS slug,
  concat(CAST(c_nationkey AS STRING), '_', CAST(c_custkey AS STRING)) AS collection
FROM customer"""

VIEWS["fx_runs"] = """
SELECT o.o_orderkey AS run_id, c.c_nationkey AS tenant_id, o.o_custkey AS project_id,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'ci' ELSE 'ui' END AS run_source,
  concat('https://h', CAST(o.o_orderkey % 50 AS STRING), '.example.com/p/', CAST(o.o_orderkey AS STRING)) AS url,
  concat('check order ', CAST(o.o_orderkey AS STRING)) AS prompt,
  CASE o.o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'analyzing' ELSE 'completed' END AS status,
  o.o_orderdate AS created_at
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey"""

VIEWS["fx_attempts"] = """
SELECT run_id, attempt, passed,
  CASE WHEN passed THEN NULL WHEN k = 0 THEN 'nav_timeout' WHEN k IN (1, 2) THEN 'TimeoutError'
    WHEN k = 3 THEN 'AssertionError' WHEN k = 4 THEN 'Error' ELSE 'crash' END AS exc_class,
  CASE WHEN passed THEN NULL
    WHEN k = 1 THEN concat('Timeout 30000ms exceeded. waiting for #e', CAST(partkey AS STRING), ' to be visible')
    WHEN k = 2 THEN 'Timeout 30000ms exceeded.' WHEN k = 3 THEN concat('expected ', CAST(partkey AS STRING))
    WHEN k = 4 THEN 'strict mode violation: 2 elements'
    ELSE concat('failure ', CAST(suppkey AS STRING)) END AS raw_error,
  CASE WHEN NOT passed AND k = 5 AND suppkey % 10 = 7 THEN concat('pipeline ', CAST(suppkey AS STRING)) END AS pipeline_error,
  l_tax AS tax, CAST('2024-01-01 00:00:00' AS TIMESTAMP_NTZ) + INTERVAL '1' HOUR * CAST((attempt - 1) * 96 + run_id % 24 AS INT) AS started_at
FROM (SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY linenumber, partkey, suppkey) AS INT) AS attempt,
    passed, k, partkey, suppkey, l_tax
  FROM (SELECT l_orderkey AS run_id, l_linenumber AS linenumber, l_partkey AS partkey, l_suppkey AS suppkey,
      l_returnflag <> 'R' AS passed, CAST(l_quantity AS INT) % 6 AS k, l_tax FROM lineitem) r) t"""

VIEWS["fx_strategies"] = """
SELECT user_id * 100 + CAST(day(ts) AS BIGINT) AS run_id, event_id AS rank, concat('by_', event_type) AS name,
  CASE WHEN event_type IN ('error', 'click') THEN 'raised' WHEN event_type = 'purchase' THEN 'ok' ELSE 'invisible' END AS outcome,
  concat('no element ', repeat(props, CAST(event_id % 30 AS INT))) AS error
FROM events"""

VIEWS["fx_console"] = """
SELECT user_id AS run_id, event_id, ts,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'log' END AS msg_type,
  concat(event_type, ':', props) AS msg
FROM events"""

VIEWS["fx_requests"] = """
SELECT user_id AS run_id, event_id, ts, concat('https://api.example.com/', event_type, '/', CAST(event_id AS STRING)) AS url,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN ''
    ELSE concat('net::ERR_', repeat(props, CAST(event_id % 40 AS INT))) END AS failure
FROM events WHERE event_type IN ('error', 'view')"""

VIEWS["fx_points"] = """
SELECT vec_id, concat('c', CAST(label % 3 AS STRING)) AS collection,
  CASE vec_id % 4 WHEN 0 THEN 'requirement' WHEN 1 THEN 'user_story' WHEN 2 THEN 'acceptance_criteria' ELSE 'note' END AS type,
  embedding AS vector, label
FROM embeddings"""

VIEWS["fx_uploads"] = """
SELECT doc_id AS document_id, source AS tenant_id, lang AS project_id,
  concat(source, '/', lang, '/documents/f', CAST(doc_id % 90 AS STRING), CASE WHEN doc_id % 10 = 7 THEN '.pdf' ELSE '.TXT' END) AS s3_path,
  CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 = 1 THEN 'user_story' ELSE 'requirement' END AS doc_type, text
FROM documents"""

VIEWS["fx_captures"] = """
SELECT page_id, split_part(split_part(url, '://', -1), '/', 1) AS host, url, html FROM pages"""

# the five tables of the database, with gaps that leave some references without a parent
VIEWS["fx_db_tenants"] = "SELECT n_nationkey AS id FROM nation WHERE n_regionkey < 4"
VIEWS["fx_db_projects"] = "SELECT project_id AS id, tenant_id FROM fx_projects WHERE project_id % 7 > 0"
VIEWS["fx_db_documents"] = """
SELECT doc_id AS id, CASE WHEN doc_id % 50 > 0 THEN doc_id % 30 END AS tenant_id, doc_id % 1700 AS project_id FROM documents"""
VIEWS["fx_db_test_runs"] = "SELECT run_id AS id, tenant_id, project_id FROM fx_runs WHERE run_id % 9 > 0"
VIEWS["fx_db_reports"] = """
SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 26 AS tenant_id, l_partkey % 1600 AS project_id, l_orderkey AS run_id FROM lineitem"""

# what the model answered to requests for an analysis of failures and for a review of differences; a later answer replaces an earlier one
VIEWS["fx_answers"] = """
SELECT 'analysis' AS kind, conv_id AS run_id, CAST(turn % 3 + 1 AS INT) AS attempt, turn AS answered_at,
  concat('because: ', coalesce(text, '')) AS answer FROM conversations WHERE role = 'assistant'
UNION ALL SELECT 'review', conv_id, CAST(turn % 3 + 1 AS INT), turn, concat('real_bug: ', coalesce(text, '')) FROM conversations WHERE role = 'assistant'"""

# what the browser saw of a run's host, some captures failed; a host is visited again and again
VIEWS["fx_visits"] = """
SELECT page_id, concat('h', CAST(page_id % 50 AS STRING), '.example.com') AS host, url, html,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP_NTZ) + INTERVAL '1' HOUR * CAST(page_id * 7 % 300 AS INT) AS captured_at,
  CASE WHEN page_id % 11 = 5 THEN 'net::ERR_TIMED_OUT' END AS error FROM pages"""

VIEWS["fx_completions"] = """
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN concat('```python', chr(10), text, chr(10), '```')
  WHEN 1 THEN concat('```', chr(10), text, '```') ELSE text END AS raw
FROM conversations WHERE role = 'assistant'"""

# every third page has lost the end tags of its links
VIEWS["fx_broken_pages"] = """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(html, '</a>', '') ELSE html END AS html FROM pages"""

# questions put to the documents: what users say, each in one project's collection
VIEWS["fx_questions"] = """
SELECT conv_id * 1000 + turn AS query_id, concat('src', CAST(conv_id % 20 AS STRING), '_',
  CASE conv_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END) AS collection, text
FROM conversations WHERE role = 'user'"""

# pages with forms, built from the rows of a table, so that their number grows with it
VIEWS["fx_form_pages"] = """
SELECT p_partkey AS page_id, concat(
  '<html><head><title> ', p_name, ' </title><script>var f="<form>";</script></head><body><form',
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(' id="f', CAST(p_partkey AS STRING), '" action=', chr(39), '/buy?x=1&amp;y=2', chr(39)) END, '>',
  repeat('<input name="q" placeholder="Type &quot;here&quot;">', p_size),
  '<button type="submit" id="go"> <b>Buy</b> ', p_brand, '</button></form>', repeat('<button>B</button>', p_size % 20),
  '<form><textarea aria-label=notes></textarea><select name="s"></select></form><!-- <h2>no</h2> --><h2 class="x  y">', p_type,
  '</h2><h3> <i>a</i><!-- c --> b</h3><a name="top">no</a><a href="">empty</a><A HREF=/p/', CAST(p_partkey AS STRING), '>P</A></body></html>'
  ) AS html
FROM part"""


# views that sort a table by a key: the key, so that the rows of a task stay bounded however large the table is
DEALT = {"fx_attempts": ("lineitem", "l_orderkey")}
ROWS_PER_TASK = 250_000


def refs(sql: str) -> list[str]:
    """Tables and views read by a statement (names directly after FROM or JOIN)."""
    return list(dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+(" + "|".join(TABLES) + r"|fx_\w+)\b", sql)))


def view(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view (or plain table) as a DataFrame; `given` has inputs of the view that are not to be read anew."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    given = given or {}
    inputs = {r: given[r] if r in given else view(spark, sf_dir, r) for r in refs(sql)}
    if name in DEALT:
        source, key = DEALT[name]
        inputs[source] = deal_by_key(inputs[source], key, ROWS_PER_TASK)
    text = re.sub(r"(FROM|JOIN)\s+(" + "|".join(inputs) + r")\b", r"\1 {\2}", sql)
    return spark.sql(text, **inputs)


def with_views(body: str, ctes: str = "", recursive: bool = False) -> str:
    """Prefix a statement with the views it needs. `ctes` are extra CTEs in front of the body."""
    needed: list[str] = []

    def visit(sql):
        for r in refs(sql):
            if r in VIEWS and r not in needed:
                visit(VIEWS[r])
                needed.append(r)

    visit(ctes)
    visit(body)
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in needed]
    if ctes:
        parts.append(ctes.strip())
    head = "WITH " + ("RECURSIVE " if recursive else "")
    sql = (head + ",\n".join(parts) + "\n" if parts else "") + body.strip()
    return sql.replace("TIMESTAMP_NTZ", "TIMESTAMP")  # the name of the type without a zone differs
