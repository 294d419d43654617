"""Links of raw pages with the headings beside them.

A page is read once: every link and every heading with its place, in characters. A link takes the first heading that lies
whole within ``reach`` characters before and after it, so that an article's card gives its title whichever comes first.
Each address counts once a page, where it first stands. Pages that are null, empty or cut off in a tag have what can be
read; a heading without an end is none; headings with tags inside are none either.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPANS = "array<struct<start:int,stop:int,value:string>>"


def spans_of(html: Column, pattern: str) -> Column:
    """(start, stop, value) of all matches of a pattern, by place; value is its first group."""
    compiled = re.compile(pattern)

    @F.pandas_udf(_SPANS)
    def found(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: [{"start": m.start(), "stop": m.end(), "value": m[1]} for m in compiled.finditer(p or "")])

    return found(html)


def page_links(pages: DataFrame, id_col: str, html_col: str, link: str = r'href="(https?://[^"]+)"', levels: str = "234", reach: int = 500, least: int = 16) -> DataFrame:
    """(id, char_at, link, title): each address of a page with a title of ``least`` characters or more beside it."""
    read = pages.select(id_col, spans_of(F.col(html_col), link).alias("_links"), spans_of(F.col(html_col), rf"<h[{levels}][^>]*>([^<]+)</h[{levels}]>").alias("_heads"))
    each = read.select(id_col, F.explode("_links").alias("l"), "_heads")
    inside = F.filter("_heads", lambda h: (h["start"] >= F.col("l.start") - reach) & (h["stop"] <= F.col("l.start") + reach))
    met = each.select(id_col, F.col("l.start").alias("char_at"), F.col("l.value").alias("link"), F.trim(F.try_element_at(inside, F.lit(1))["value"]).alias("title"))
    first = met.groupBy(id_col, "link").agg(F.min(F.struct("char_at", "title")).alias("f")).select(id_col, "f.char_at", "link", "f.title")
    return first.where(F.length("title") >= least)
