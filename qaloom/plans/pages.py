"""Queries over page captures: structure, snapshots, baselines, images."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaloom.operators import dom, visual
from qaloom.operators.skew import lookup_join, widen, widen_by_rows
from qaloom.plans.registry import CHECKS, query
from qaloom.session import spread
from qaloom.plans.views import view, with_views

# --- structure ---------------------------------------------------------------------------------------------------

_TEXT = r"""array_to_string(list_transform(string_split_regex({}, '<[^>]*>'), lambda x: regexp_replace(replace(replace(replace(replace(
  x, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '^\s+|\s+$', '', 'g')), '')"""
_OPEN = r"'(?s)^<[^>]*>|</[a-zA-Z0-9]+>$', '', 'g'"

# links, h1 and title by patterns of their own; these pages hold no other kind
PAGE = rf"""
clean AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)>|<!--.*?-->|<(meta|link)\b[^>]*>', '<!>', 'g') AS h FROM fx_captures),
links AS (SELECT page_id, i, regexp_extract(e, '(?is)href="([^"]*)"', 1) AS href, {_TEXT.format(f"regexp_replace(e, {_OPEN})")} AS text
  FROM (SELECT page_id, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(h, '(?is)<a\b[^>]*href=[^>]*>.*?</a>') AS l FROM clean))),
heads AS (SELECT page_id, i, lower(regexp_extract(e, '^<([a-zA-Z0-9]+)', 1)) AS tag, {_TEXT.format(f"regexp_replace(e, {_OPEN})")} AS text
  FROM (SELECT page_id, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(h, '(?is)<h[123]\b[^>]*>.*?</h[123]>') AS l FROM clean))),
titles AS (SELECT page_id, replace(replace(replace(replace(regexp_extract(h, '(?is)<title\b[^>]*>(.*?)</title>', 1),
  '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS title FROM clean),
map_lines AS (
  SELECT page_id, 'head' AS section, 1 AS ord, 'PAGE STRUCTURE MAP' AS line FROM clean UNION ALL
  SELECT page_id, 'head', 2, repeat('=', 60) FROM clean UNION ALL
  SELECT page_id, 'head', 3, concat('Title: ', title) FROM titles UNION ALL
  SELECT page_id, 'links', 1, concat(chr(10), 'LINKS (', count(*), ' found):') FROM links GROUP BY page_id UNION ALL
  SELECT page_id, 'links', i + 1, concat('  - ''', substr(text, 1, 50), ''' → ', href) FROM links WHERE i <= 10 UNION ALL
  SELECT page_id, 'links', 12, concat('  ... and ', count(*) - 10, ' more') FROM links GROUP BY page_id HAVING count(*) > 10 UNION ALL
  SELECT DISTINCT page_id, 'headings', 1, concat(chr(10), 'HEADINGS (page structure):') FROM heads UNION ALL
  SELECT page_id, 'headings', i + 1, concat('  <', tag, '> ', substr(text, 1, 60)) FROM heads WHERE i <= 10)"""


PAGES_PER_TASK = 2_000
# pages made from the rows of a table: its rows are dealt, so that the pages are made where they are read
MADE_OF = {"fx_form_pages": ("part", "p_partkey")}


def pages(spark, d, name="fx_captures"):
    source, key = MADE_OF.get(name, (name, "page_id"))
    rows, parts = view(spark, d, source), spread(spark)
    dealt = widen(rows, key, parts) if parts else widen_by_rows(rows, key, PAGES_PER_TASK)
    return dealt if source == name else view(spark, d, name, {source: dealt})


def parsed(spark, d, name="fx_captures"):
    return dom.parse_pages(pages(spark, d, name), cut=dom.ELEMENT_TEXT)


@query("dom_counts", with_views("""
SELECT page_id, CAST(0 AS INT) AS forms, CAST(0 AS INT) AS buttons, CAST(0 AS INT) AS inputs,
  CAST((SELECT count(*) FROM links l WHERE l.page_id = c.page_id) AS INT) AS links,
  CAST((SELECT count(*) FROM heads l WHERE l.page_id = c.page_id) AS INT) AS headings FROM clean c""", PAGE))
def dom_counts(spark, d):
    return dom.dom_counts(pages(spark, d), "page_id")


# an unclosed link stays a link, whatever comes after it
@query("dom_counts_broken", with_views("""
SELECT page_id, CAST(0 AS INT) AS forms, CAST(0 AS INT) AS buttons, CAST(0 AS INT) AS inputs,
  CAST((SELECT count(*) FROM links l WHERE l.page_id = c.page_id) AS INT) AS links,
  CAST((SELECT count(*) FROM heads l WHERE l.page_id = c.page_id) AS INT) AS headings FROM clean c""", PAGE))
def dom_counts_broken(spark, d):
    return dom.dom_counts(pages(spark, d, "fx_broken_pages"), "page_id")


@query("dom_sections", with_views("SELECT page_id, section, CAST(ord AS INT) AS ord, line FROM map_lines", PAGE))
def dom_sections(spark, d):
    return dom.dom_sections(parsed(spark, d), "page_id")


DOM_MAP = """
SELECT page_id, concat(string_agg(line, chr(10) ORDER BY CASE section WHEN 'head' THEN 0 WHEN 'links' THEN 1 ELSE 2 END, ord),
  chr(10), chr(10), repeat('=', 60)) AS dom_map FROM map_lines GROUP BY page_id"""


@query("dom_map", with_views(DOM_MAP, PAGE))
def dom_map(spark, d):
    return dom.dom_map(parsed(spark, d)).select("page_id", "dom_map")


@query("element_attrs", with_views("""
SELECT page_id, 'links' AS kind, CAST(i AS INT) AS ord, 'a' AS tag, substr(text, 1, 200) AS text,
  CASE WHEN href = '' THEN '' ELSE concat('href=', href) END AS attributes FROM links
UNION ALL SELECT page_id, 'headings', CAST(i AS INT), tag, substr(text, 1, 200), '' FROM heads""", PAGE))
def element_attrs(spark, d):
    e = dom.element_attrs(dom.extract_elements(parsed(spark, d), "page_id"))
    pairs = F.transform(F.map_entries("attributes"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return e.withColumn("attributes", F.array_join(pairs, ";"))


@query("dom_map_parser", CHECKS["dom_map"])
def dom_map_parser(spark, d):
    return dom.dom_map(parsed(spark, d)).select("page_id", "dom_map")


# the same map for pages with forms; the SQL derives the expected text from the columns the page was built from
_FORM_MAP = """
SELECT p_partkey AS page_id, array_to_string(list_concat(
  ['PAGE STRUCTURE MAP', repeat('=', 60), concat('Title:  ', p_name, ' '), concat(chr(10), 'FORMS (2 found):'),
   CASE WHEN p_partkey % 3 = 0 THEN '  Form 1: id=form-1, action=N/A' ELSE concat('  Form 1: id=f', p_partkey, ', action=/buy?x=1&y=2') END],
  list_transform(range(least(p_size, 10)), lambda i: '    - text ''q'' placeholder=''Type "here"'''),
  CASE WHEN p_size > 10 THEN [concat('    ... and ', p_size - 10, ' more')] ELSE [] END,
  [concat('    → Submit button: ''Buy', p_brand, ''' (id=go)'), '  Form 2: id=form-2, action=N/A', '    - text ''unnamed'' label=''notes''', '    - text ''s''',
   concat(chr(10), 'BUTTONS (', 1 + p_size % 20, ' found):'), concat('  - ''Buy', p_brand, ''' (id=go) [type=submit]')],
  list_transform(range(least(p_size % 20, 14)), lambda i: '  - ''B'''),
  CASE WHEN p_size % 20 > 14 THEN [concat('  ... and ', p_size % 20 - 14, ' more buttons')] ELSE [] END,
  [concat(chr(10), 'INPUT FIELDS (', p_size + 2, ' found, including form inputs):')],
  list_concat(list_transform(range(p_size), lambda i: '  - text: name=q, placeholder=''Type "here"'''), ['  - text: label=''notes''', '  - text: name=s'])[1:20],
  CASE WHEN p_size > 18 THEN [concat('  ... and ', p_size - 18, ' more')] ELSE [] END,
  [concat(chr(10), 'LINKS (2 found):'), '  - ''empty'' → ', concat('  - ''P'' → /p/', p_partkey),
   concat(chr(10), 'HEADINGS (page structure):'), concat('  <h2> ', p_type), '  <h3> ab', concat(chr(10), repeat('=', 60))]), chr(10)) AS dom_map
FROM part"""


@query("dom_map_forms", _FORM_MAP)
def dom_map_forms(spark, d):
    return dom.dom_map(parsed(spark, d, "fx_form_pages")).select("page_id", "dom_map")


@query("dom_counts_forms", """
SELECT p_partkey AS page_id, 2 AS forms, CAST(1 + p_size % 20 AS INT) AS buttons, CAST(p_size + 2 AS INT) AS inputs, 2 AS links, 2 AS headings FROM part""")
def dom_counts_forms(spark, d):
    return dom.dom_counts(pages(spark, d, "fx_form_pages"), "page_id")


_ERROR = "CASE WHEN length(html) % 5 = 0 THEN 'net::ERR_TIMED_OUT' END"


@query("page_structure", with_views(f"""
SELECT c.page_id, CASE WHEN {_ERROR} IS NOT NULL THEN concat('ERROR: Could not visit ', c.url, ': ', {_ERROR}) ELSE m.dom_map END AS page_structure,
  CASE WHEN {_ERROR} IS NOT NULL THEN 'Error' ELSE t.title END AS page_title,
  CASE WHEN {_ERROR} IS NOT NULL THEN 1920 ELSE 1280 END AS width
FROM fx_captures c JOIN titles t USING (page_id) JOIN (SELECT page_id, concat(string_agg(line, chr(10) ORDER BY CASE section WHEN 'head' THEN 0 WHEN 'links' THEN 1 ELSE 2 END, ord),
  chr(10), chr(10), repeat('=', 60)) AS dom_map FROM map_lines GROUP BY page_id) m USING (page_id)""", PAGE))
def page_structure(spark, d):
    log = pages(spark, d).withColumns({
        "error": F.expr(_ERROR), "page_title": F.lit(None).cast("string"),
        "viewport": F.struct(F.lit(1280).alias("width"), F.lit(720).alias("height")),
    })
    return dom.page_structure(log).select("page_id", "page_structure", "page_title", F.col("viewport.width").alias("width"))


@query("latest_snapshot", with_views("""
SELECT host, page_id, url FROM fx_captures QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id DESC) = 1"""))
def latest_snapshot(spark, d):
    return dom.latest_snapshot(view(spark, d, "fx_captures"), ["host"], "page_id", "page_id").select("host", "page_id", "url")


# --- baselines ---------------------------------------------------------------------------------------------------


@query("visual_candidates", with_views("""
SELECT run_id, attempt FROM fx_attempts WHERE coalesce(exc_class, '') NOT IN ('crash', 'nav_timeout')"""))
def visual_candidates(spark, d):
    cls = F.coalesce("exc_class", F.lit(""))
    rows = view(spark, d, "fx_attempts").withColumn(
        "screenshot_s3_path",
        F.when(cls == "crash", F.lit(None)).when(cls == "nav_timeout", "").otherwise(F.concat(F.lit("k/"), F.col("run_id").cast("string"))))
    return visual.visual_candidates(rows).select("run_id", "attempt")


def captures(spark, d):
    """Captures with the host as key; every second host by name length already has a baseline of its own."""
    return visual.with_host(view(spark, d, "fx_captures").drop("host", "html"))


_OLD = "length(host) % 2 = 0"


@query("baseline_first", with_views("SELECT host, min(page_id) AS page_id FROM fx_captures GROUP BY host"))
def baseline_first(spark, d):
    return visual.first_baselines(captures(spark, d), ["page_id"], ["host"]).select("host", "page_id")


@query("baseline_new", with_views(f"SELECT host, min(page_id) AS page_id FROM fx_captures WHERE NOT ({_OLD}) GROUP BY host"))
def baseline_new(spark, d):
    c = captures(spark, d)
    return visual.new_baselines(c, c.filter(_OLD).select("host").distinct(), ["page_id"], ["host"]).select("host", "page_id")


_BASE = f"b AS (SELECT host, min(page_id) AS baseline_id FROM fx_captures WHERE {_OLD} GROUP BY host)"


def _split(spark, d):
    c = captures(spark, d)
    base = c.filter(_OLD).groupBy("host").agg(F.min("page_id").alias("baseline_id"))
    return visual.split_baseline(c, base, ["page_id"], ["host"])


@query("baseline_join", with_views("""
SELECT page_id, c.host, baseline_id, concat('t/p/baselines/', c.host, '.png') AS baseline_key FROM fx_captures c JOIN b ON b.host = c.host""", _BASE))
def baseline_join(spark, d):
    return _split(spark, d)[0].select(
        "page_id", "host", "baseline_id", visual.baseline_key(F.lit("t"), F.lit("p"), F.col("host")).alias("baseline_key"))


@query("first_runs", with_views("SELECT page_id, host FROM fx_captures WHERE host NOT IN (SELECT host FROM b)", _BASE))
def first_runs(spark, d):
    return _split(spark, d)[1].select("page_id", "host")


# --- images: every embedding is an 8x8 picture, the smallest id of a label is its baseline ------------------------

_PIXELS = """
px AS (SELECT vec_id, label, generate_subscripts(vector, 1) - 1 AS i, floor((CAST(unnest(vector) AS DOUBLE) + 1) * 127.5) AS v FROM fx_points),
base AS (SELECT label, min(vec_id) AS ref FROM fx_points GROUP BY label),
pairs AS (SELECT p.vec_id AS image_id, p.i // 8 AS y, p.i % 8 AS x, p.v AS p, q.v AS q
  FROM px p JOIN base USING (label) JOIN px q ON q.vec_id = base.ref AND q.i = p.i WHERE p.vec_id <> base.ref),
across AS (SELECT image_id, y, x, sum(p) OVER w AS sp, sum(q) OVER w AS sq, sum(p * p) OVER w AS spp, sum(q * q) OVER w AS sqq, sum(p * q) OVER w AS spq
  FROM pairs WINDOW w AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
boxes AS (SELECT image_id, y, x, sum(sp) OVER w / 49e0 AS a, sum(sq) OVER w / 49e0 AS b, sum(spp) OVER w / 49e0 AS aa, sum(sqq) OVER w / 49e0 AS bb,
  sum(spq) OVER w / 49e0 AS ab FROM across WHERE x BETWEEN 3 AND 4 WINDOW w AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
scored AS (SELECT image_id, round(avg(((2 * a * b + 6.5025e0) * (2 * (49e0 / 48e0) * (ab - a * b) + 58.5225e0)) /
  ((a * a + b * b + 6.5025e0) * ((49e0 / 48e0) * (aa - a * a) + (49e0 / 48e0) * (bb - b * b) + 58.5225e0))), 6) AS ssim
  FROM boxes WHERE y BETWEEN 3 AND 4 GROUP BY image_id)"""


def _images(spark, d):
    px = F.transform("vector", lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("int"))
    return view(spark, d, "fx_points").select(F.col("vec_id").alias("image_id"), "label", px.alias("px"))


def _pairs(spark, d):
    images = _images(spark, d)
    ref = visual.first_baselines(images, ["image_id"], ["label"]).select(
        "label", F.col("image_id").alias("ref_id"), F.col("px").alias("ref_px"))
    return lookup_join(images, ref, ["label"], ["image_id"], "inner").filter("image_id <> ref_id")


@query("ssim", with_views("SELECT image_id, ssim FROM scored", _PIXELS))
def ssim(spark, d):
    img = lambda c: F.struct(F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("channels"), F.col(c).alias("px"))
    pairs = _pairs(spark, d).select("image_id", img("px").alias("cur"), img("ref_px").alias("ref"))
    return visual.ssim_images(pairs).select("image_id", F.round("score", 6).alias("ssim"))


@query("ssim_pixels", with_views("SELECT image_id, ssim FROM scored", _PIXELS))
def ssim_pixels(spark, d):
    rows = _pairs(spark, d).select("image_id", F.posexplode(F.arrays_zip(F.col("px").alias("p"), F.col("ref_px").alias("q"))).alias("i", "e"))
    pixels = rows.select("image_id", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).alias("x"), "e.*")
    return visual.ssim_pixels(pixels).select("image_id", F.round("score", 6).alias("ssim"))


@query("gray_resize", with_views("""
SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x,
  CAST(floor((114 * max(v) FILTER (c = 0) + 587 * max(v) FILTER (c = 1) + 299 * max(v) FILTER (c = 2) + 500) / 1000) AS INT) AS v
FROM (SELECT image_id, y, x, c, (2 * ((px[y0 * 8 + x0 + 1] * (8 - fx) + px[y0 * 8 + x1 + 1] * fx) * (10 - fy)
    + (px[y1 * 8 + x0 + 1] * (8 - fx) + px[y1 * 8 + x1 + 1] * fx) * fy) + 80) // 160 AS v
  FROM (SELECT *, sy // 10 AS y0, least(sy // 10 + 1, 7) AS y1, sx // 8 AS x0, least(sx // 8 + 1, 7) AS x1, sy % 10 AS fy, sx % 8 AS fx
    FROM (SELECT image_id, y, x, c, CASE c WHEN 0 THEN px WHEN 1 THEN list_reverse(px) ELSE list_concat(px[33:64], px[1:32]) END AS px,
        least(greatest((2 * y + 1) * 8 - 5, 0), 70) AS sy, least(greatest((2 * x + 1) * 8 - 4, 0), 56) AS sx
      FROM (SELECT vec_id AS image_id, list_transform(vector, lambda e: CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5e0) AS BIGINT)) AS px,
          unnest(range(60)) // 12 AS y, unnest(range(60)) // 3 % 4 AS x, unnest(range(60)) % 3 AS c FROM fx_points))))
GROUP BY image_id, y, x"""))
def gray_resize(spark, d):
    """An 8x8 colour picture from all 64 values: blue as they are, green backwards, red with the halves swapped; to gray 5x4."""
    named = F.arrays_zip(F.col("px").alias("b"), F.reverse("px").alias("g"), F.concat(F.slice("px", 33, 32), F.slice("px", 1, 32)).alias("r"))
    px = F.flatten(F.transform(named, lambda p: F.array(p["b"], p["g"], p["r"])))
    img = F.struct(F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(3).alias("channels"), px.alias("px"))
    return visual.gray_pixels(_images(spark, d).select("image_id", img.alias("img")), 5, 4)
