"""Links in web pages and urls in text. Anchors need a parser, so they run in Python by Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.expressions import url_classify
from corpusloom.operators.joins import first_few


class _Anchors(HTMLParser):
    """Collects (tag, url, text) of anchors, frames and media sources."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[list[str]] = []
        self.open = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        url = dict(attrs).get("href" if tag == "a" else "src")
        if tag in ("a", "iframe", "source", "video") and url:
            self.found.append([tag, url.strip(), ""])
            self.open = tag == "a"

    def handle_endtag(self, tag: str) -> None:
        self.open = self.open and tag != "a"

    def handle_data(self, data: str) -> None:
        if self.open:
            self.found[-1][2] += data


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, base, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parser = _Anchors()
            parser.feed(html or "")
            rows += [(key, base, i, tag, url, " ".join(text.split())) for i, (tag, url, text) in enumerate(parser.found)]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "base", "position", "tag", "href", "link_text"])


def anchors(pages: DataFrame, key: str = "id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, base, position, tag, href, link_text, target) in page order; targets are absolute."""
    rows = pages.select(F.col(key).cast("long"), F.col(url), F.col(html)).mapInArrow(_parse, "id long, base string, position int, tag string, href string, link_text string")
    site = F.regexp_extract("base", r"^([a-z]+://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace("base", r"[?#].*$", ""), r"(?<![:/])/[^/]*$", "")
    href = F.col("href")
    target = F.when(href.rlike("^[a-z]+:"), href).when(href.startswith("//"), F.concat(F.regexp_extract("base", "^[a-z]+:", 0), href)).when(href.startswith("/"), F.concat(site, href)).when(href.startswith("#"), F.concat("base", href)).otherwise(F.concat(folder, F.lit("/"), href))
    return rows.withColumn("target", target)


def extract_links(pages: DataFrame, wanted: Column) -> DataFrame:
    """Distinct wanted targets of each page, at their first position."""
    return anchors(pages).filter("tag = 'a'").filter(wanted).groupBy("id", "target").agg(F.min("position").alias("position"), F.min_by("link_text", "position").alias("link_text"))


def sub_page_links(pages: DataFrame, like: str, unlike: str, most: int) -> DataFrame:
    """The first matching targets of each page, in page order."""
    links = extract_links(pages, F.col("target").rlike(like) & ~F.col("target").rlike(unlike))
    return links.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("position"))).filter(F.col("n") <= most).drop("n")


def mine_urls(rows: DataFrame, key: str, text: str, hints: Sequence[str] = ()) -> DataFrame:
    """Distinct urls in a text, trailing punctuation and fragments cut, with hints if given."""
    found = rows.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"https?://[^\s\"'<>)\]]+"), F.lit(0))).alias("url"))
    clean = F.regexp_replace(F.regexp_replace("url", r"#.*$", ""), r"[.,;:!?]+$", "")
    out = found.select(key, clean.alias("url")).distinct()
    return out if not hints else out.filter(F.lower("url").rlike("|".join(hints)))


def harvest_media(pages: DataFrame, hint: str, samples: int = 3) -> DataFrame:
    """Media urls of all pages by platform and id: pages, whether any link carries the hint, and the first ids of pages as samples."""
    links = anchors(pages).withColumn("c", url_classify("target")).filter("c is not null")
    links = links.select("c.platform", "c.kind", F.col("c.id").alias("media_id"), "id", F.lower("link_text").contains(hint).alias("hinted"))
    keys = ["platform", "kind", "media_id"]
    each = links.groupBy(*keys, "id").agg(F.bool_or("hinted").alias("hinted"))
    facts = each.groupBy(*keys).agg(F.count("*").alias("n_pages"), F.bool_or("hinted").alias("hinted"))
    return facts.join(first_few(each, keys, "id", samples, "samples"), keys)
