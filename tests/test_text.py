import html as pyhtml

import pytest
from pyspark.sql import functions as F

from qaloom.functions import markup, text


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("s", ["", "  ", " a  b\u00a0", "\x1fx\u2003y\u3000", "no", "\ta\r\n b\x85c "])
def test_strip_and_word_count_follow_python(spark, s):
    assert one(spark, text.strip(F.col("s")), s=s) == s.strip()
    assert one(spark, text.word_count(F.col("s")), s=s) == len(s.split())


@pytest.mark.parametrize("url", [
    "https://h.example.com/p/1", "http://h:8080/x?u=http", "h.com", "https://h.com?q=1", "a://b://c/d", "",
])
def test_host_key(spark, url):
    assert one(spark, text.host_key(F.col("s")), s=url) == url.split("://")[-1].split("/")[0]


@pytest.mark.parametrize("raw", [
    "```python\nx = 1\n```", "```\nx\n```  ", "x", "```python```", "  ```x", "a```", "``````", "```python\n\n```\n", "```python ```python x```",
])
def test_strip_fences(spark, raw):
    want = raw.strip().removeprefix("```python").removeprefix("```").removesuffix("```").strip()
    assert one(spark, text.strip_fences(F.col("s")), s=raw) == want


def test_preview(spark):
    raw = "a\n\n  \n" + "b" * 150 + "\nc\nd"
    assert one(spark, text.script_preview(F.col("s")), s=raw) == "  a\n  " + "b" * 100 + "\n  c"
    assert one(spark, text.line_count(F.col("s")), s=raw) == 6


@pytest.mark.parametrize("raw", [
    b"plain", b"a\xffb", b"\xef\xbf\xbd ok", b"\xef\xbf\xbd bad \xc3", b"\xe2\x82", b"", "é→".encode() + b"\x80" + "ü".encode(),
    b"\xf0\x9f\x98\x80\xf0\x9f",
])
def test_decode_drops_only_invalid_bytes(spark, raw):
    assert one(spark, text.decode_lenient(F.col("s")), s=raw) == raw.decode("utf-8", errors="ignore")


def test_render_writes_none_for_null(spark):
    assert one(spark, text.render("<{a}>{{}}{b}", a=F.col("s"), b=F.lit(None).cast("string")), s="x") == "<x>{}None"


@pytest.mark.parametrize("s", [
    "no refs", "a &amp; b", "&amp;lt;", "&quot;x&quot;", "&#65;&#x42;&#X43;", "&nbsp;|", "&unknown; &", "&&amp;", "&copy;&middot;&euro;", "&#0;", "a&b;c",
])
def test_unescape(spark, s):
    assert one(spark, markup.unescape(F.col("s")), s=s) == pyhtml.unescape(s)


def test_attributes(spark):
    tag = """<input id=a NAME='b c' data-id="z>y" disabled value="" type = "text" id="last" href=/x?a=1&amp;b=2>"""
    got = one(spark, F.transform(markup.attributes(F.col("s")), lambda x: F.concat(x["name"], F.lit("="), x["value"])), s=tag)
    assert got == ["id=a", "name=b c", "data-id=z>y", "disabled=", "value=", "type=text", "id=last", "href=/x?a=1&b=2"]
    assert one(spark, markup.attr(markup.attributes(F.col("s")), "id"), s=tag) == "last"
    assert one(spark, markup.attr(markup.attributes(F.col("s")), "class"), s=tag) is None
