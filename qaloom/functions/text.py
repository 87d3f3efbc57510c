"""Text rules as native column expressions. Whitespace means Unicode whitespace, as in Python's str.strip()."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

# fixed values: the characters Python treats as whitespace
SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
def strip(c: Column) -> Column:
    """Trim with an explicit character set: linear in the text, unlike an anchored regex on long blank runs."""
    return F.btrim(c, F.lit(SPACE))


def words(c: Column) -> Column:
    """Words between any whitespace. All of it becomes the plain space first: splitting on one character is far
    cheaper than on a character class."""
    plain = F.translate(c, SPACE, " " * len(SPACE))
    return F.array_remove(F.split(plain, " "), "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def blank(c: Column) -> Column:
    """Null and the empty string count as missing; blanks do not."""
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def or_default(c: Column, value) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(value))


def basename(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(-1))


def host_key(url: Column) -> Column:
    """Text after the last '://' and before the next '/': keeps the port, and the query when there is no path."""
    return F.split_part(F.split_part(url, F.lit("://"), F.lit(-1)), F.lit("/"), F.lit(1))


def collection_name(tenant: Column, project: Column) -> Column:
    return F.concat(tenant.cast("string"), F.lit("_"), project.cast("string"))


def key_path(*parts) -> Column:
    return F.concat_ws("/", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def strip_fences(c: Column) -> Column:
    s = strip(c)
    for pattern in ("^```python", "^```", "```\\z"):
        s = F.regexp_replace(s, pattern, "")
    return strip(s)


def line_count(c: Column) -> Column:
    return F.size(F.split(c, "\n"))


def script_preview(c: Column, lines: int = 5, width: int = 100) -> Column:
    head = F.slice(F.split(c, "\n"), 1, lines)
    shown = F.filter(head, lambda x: strip(x) != "")
    return F.array_join(F.transform(shown, lambda x: F.concat(F.lit("  "), F.substring(x, 1, width))), "\n")


def decode_lenient(content: Column) -> Column:
    """UTF-8 with invalid bytes dropped.

    Valid input passes unchanged. In invalid input a real U+FFFD (bytes EF BF BD, always a whole character) is
    kept by parking it on the noncharacter U+FFFF while the repair marks are removed.
    """
    raw = content.cast("string")
    parked = F.encode(
        F.replace(F.decode(content, "ISO-8859-1"), F.lit("\xef\xbf\xbd"), F.lit("\xef\xbf\xbf")), "ISO-8859-1"
    )
    repaired = F.replace(F.make_valid_utf8(parked.cast("string")), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(repaired, F.lit("\uffff"), F.lit("\ufffd")))


def or_none(c: Column) -> Column:
    """How a null reads inside a Python f-string."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def py_bool(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def render(template: str, **values: Column) -> Column:
    """Fill a `{name}` template from columns; nulls read 'None'."""
    parts = []
    for text, field, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field is not None:
            parts.append(or_none(values[field]))
    return F.concat(*parts)
