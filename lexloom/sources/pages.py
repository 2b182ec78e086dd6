"""Parsed pages: word lists of body, headings, title and links, from HTML or plain text, with built-in functions only.

The reading of HTML is defined here: comments, scripts and styles go; tags are blanks; five entities are decoded; words are
runs between ASCII white space; links are <a> elements with a quoted href. Body words are all of <body>, headings and
anchors included; without a <body> they are those of the whole text but the title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import words

HIDDEN = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
TAG = r"(?s)<[^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HEADING = r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"
BODY = r"(?is)<body[^>]*>(.*)"
LINK = r"(?is)<a\s[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _decoded(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def visible_words(html: Column) -> Column:
    return words(_decoded(F.regexp_replace(html, TAG, " ")))


def parse_html(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", resolve: bool = False) -> DataFrame:
    """doc_id, url, service, host, body, head, title, links of every page. Null HTML is empty; null urls are empty text.

    With resolve, links that begin with / get the page's scheme and host; otherwise they stay as written.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    html = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), HIDDEN, " ")
    body = F.regexp_extract(html, BODY, 1)
    rest = F.when(html.rlike(BODY), body).otherwise(F.regexp_replace(html, TITLE, " "))
    all_words = lambda pattern: F.flatten(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), visible_words))
    base = df.select(
        F.col(id_col).alias("doc_id"), url.alias("url"), F.regexp_extract(url, "^([^:]*)://", 1).alias("service"), F.regexp_extract(url, "^[^:]*://([^/?#]*)", 1).alias("host"),
        visible_words(rest).alias("body"), all_words(HEADING).alias("head"), visible_words(F.regexp_extract(html, TITLE, 1)).alias("title"),
        F.regexp_extract_all(html, F.lit(LINK), F.lit(1)).alias("hrefs"), F.regexp_extract_all(html, F.lit(LINK), F.lit(2)).alias("texts"),
    )
    whole = lambda u: F.when(F.lit(resolve) & u.startswith("/"), F.concat("service", F.lit("://"), "host", u)).otherwise(u)
    links = F.zip_with("hrefs", "texts", lambda u, t: F.struct(whole(u).alias("url"), visible_words(t).alias("anchor")))
    return base.select("doc_id", "url", "service", "host", "body", "head", "title", links.alias("links"))


def text_url(doc_id: Column) -> Column:
    return F.concat(F.lit("doc://"), doc_id.cast("string"))


def parse_text(df: DataFrame, *others: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plain texts as pages without title, headings or links, under the url doc://<id>; and other columns as they are."""
    none = F.array().cast("array<string>")
    return df.select(
        F.col(id_col).alias("doc_id"), text_url(F.col(id_col)).alias("url"), F.lit("doc").alias("service"), F.lit("").alias("host"),
        words(F.col(text_col)).alias("body"), none.alias("head"), none.alias("title"), F.array().cast("array<struct<url:string,anchor:array<string>>>").alias("links"), *others,
    )


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """url: one per line of text files, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''")
