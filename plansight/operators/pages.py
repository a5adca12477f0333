"""Page metadata (S17): title, og:title, description, og:description and
the first five h1/h2 headings of raw HTML, all with regex column
expressions (no HTML parser, no per-row Python)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entity decoding table, in the order it is applied.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&nbsp;", " ")]

TITLE = r"(?i)<title[^>]*>([^<]{1,200})</title>"
OG_TITLE = [r"""(?i)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']{1,300})["']""",
            r"""(?i)<meta[^>]+content=["']([^"']{1,300})["'][^>]+property=["']og:title["']"""]
DESC = [r"""(?i)<meta[^>]+name=["']description["'][^>]+content=["']([^"']{1,500})["']""",
        r"""(?i)<meta[^>]+content=["']([^"']{1,500})["'][^>]+name=["']description["']"""]
OG_DESC = [r"""(?i)<meta[^>]+property=["']og:description["'][^>]+content=["']([^"']{1,500})["']""",
           r"""(?i)<meta[^>]+content=["']([^"']{1,500})["'][^>]+property=["']og:description["']"""]
HEADING = r"(?i)<h[12][^>]*>([\s\S]{1,200}?)</h[12]>"
WS = r"\s+"


def _squash(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), WS, " ")


def decode_entities(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), WS, " "), r"^\s+|\s+$", "")


def _tag(html: Column, patterns) -> Column:
    pats = [patterns] if isinstance(patterns, str) else patterns
    vals = [F.nullif(_squash(F.regexp_extract(html, p, 1)), F.lit("")) for p in pats]
    return F.coalesce(*vals, F.lit(""))


def page_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    h = F.col(html)
    title, og_title = _tag(h, TITLE), _tag(h, OG_TITLE)
    desc, og_desc = _tag(h, DESC), _tag(h, OG_DESC)
    heads = F.transform(F.regexp_extract_all(h, F.lit(HEADING), 1), lambda s: decode_entities(strip_tags(s)))
    heads = F.slice(F.filter(heads, lambda s: F.length(s) > 3), 1, 5)
    return pages.select(
        "*",
        F.when(title != "", decode_entities(title)).alias("title"),
        F.when((og_title != "") & (og_title != title), decode_entities(og_title)).alias("og_title"),
        F.when(desc != "", decode_entities(desc)).alias("description"),
        F.when((og_desc != "") & (og_desc != desc), decode_entities(og_desc)).alias("og_description"),
        F.when(F.size(heads) > 0, F.array_join(heads, " · ")).alias("headings"),
    ).drop(html)
