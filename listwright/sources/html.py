"""Pages: one small parser turns markup into an array of elements; all rules on top are Columns.

``elements`` is the only Python step (Arrow batches).  Malformed markup never fails: what cannot be read is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import first_group
from ..functions.text import rx

ELEMENT = "struct<idx:int,parent:int,tag:string,attrs:map<string,string>,text:string>"
#: Pages parsed before their elements are handed on.
STEP = 64
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Reader(HTMLParser):
    """Elements in document order with their parents and whole texts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.found.append([self.open[-1] if self.open else -1, tag, {k: v or "" for k, v in attrs}, []])
        if tag not in VOID:
            self.open.append(len(self.found) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.found[self.open[i]][1] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        if data.strip():
            skip = self.found[self.open[-1]][1] in ("script", "style") if self.open else False
            for i in self.open[-1:] if skip else self.open:
                self.found[i][3].append(data.strip())


def parse(markup: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(markup or "")
    return [{"idx": i, "parent": p, "tag": t, "attrs": a, "text": " ".join(x)} for i, (p, t, a, x) in enumerate(reader.found)]


def sliced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Elements of STEP pages at a time, so that a task never holds those of a whole batch."""
    for pages in batches:
        for at in range(0, len(pages), STEP):
            yield pages.iloc[at : at + STEP].map(parse)


def elements(markup: Column) -> Column:
    return F.pandas_udf(sliced, f"array<{ELEMENT}>")(markup)


def attr(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], F.lit(name))


def of_tag(els: Column, *tags: str) -> Column:
    return F.filter(els, lambda e: e["tag"].isin(*tags))


def of_class(els: Column, pattern: str) -> Column:
    """Elements with a class or id that the pattern matches."""
    return F.filter(els, lambda e: F.coalesce(F.concat_ws(" ", attr(e, "class"), attr(e, "id")), F.lit("")).rlike("(?i)" + pattern))


def first_text(els: Column) -> Column:
    return F.nullif(F.try_element_at(F.transform(els, lambda e: e["text"]), F.lit(1)), F.lit(""))


def first_hit(els: Column, *patterns: str) -> Column:
    """Texts of a fallback chain of class patterns: the first that has any."""
    return F.coalesce(*(first_text(of_class(els, p)) for p in patterns))


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once; inside a lambda an expression is computed again for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def distinct_by(items: Column, key: str) -> Column:
    """Items with the first occurrence of each key."""
    return bound(items, lambda own: bound(F.transform(own, lambda x: x[key]), lambda keys: F.filter(own, lambda x, i: F.array_position(keys, x[key]) == i + 1)))


def absolute(url: Column, base: str) -> Column:
    return F.when(url.rlike("^https?://"), url).when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(url, "^/+", "")))


def links(els: Column, base: str, id_pattern: str, wanted: str | None = None) -> Column:
    """List items of a page: external_id, url, title, price_text; ids from the address, repeats left out."""
    own = F.filter(of_tag(els, "a"), lambda e: F.coalesce(attr(e, "href"), F.lit("")).rlike(wanted or id_pattern))
    items = F.transform(own, lambda e: F.struct(first_group(attr(e, "href"), id_pattern).alias("external_id"), absolute(attr(e, "href"), base).alias("url"), F.coalesce(F.nullif(attr(e, "title"), F.lit("")), e["text"]).alias("title"), first_group(e["text"], r"([0-9][0-9\s  ]*)\s*Kč").alias("price_text")))
    return distinct_by(F.filter(items, lambda x: x["external_id"].isNotNull()), "external_id")


def same_host(items: Column, host: str) -> Column:
    return F.filter(items, lambda x: F.coalesce(F.try_parse_url(x["url"], F.lit("HOST")) == host, F.lit(False)))


def has_next(els: Column, total: Column, page: Column, size: int) -> Column:
    """A pager link, else more rows than shown so far."""
    pager = F.exists(of_tag(els, "a", "link"), lambda e: F.coalesce(F.concat_ws(" ", attr(e, "rel"), attr(e, "class"), attr(e, "aria-label")), F.lit("")).rlike("(?i)\\bnext\\b|další") | e["text"].rlike(rx("^\\s*(?:další|následující|next|»)")))
    return pager | F.coalesce(total > page * size, F.lit(False))


def next_url(els: Column, base: str) -> Column:
    own = F.filter(of_tag(els, "a", "link"), lambda e: F.coalesce(F.concat_ws(" ", attr(e, "rel"), attr(e, "class")), F.lit("")).rlike("(?i)\\bnext\\b"))
    return F.try_element_at(F.transform(own, lambda e: absolute(attr(e, "href"), base)), F.lit(1))


def is_empty_result(text: Column) -> Column:
    return text.rlike(rx(r"\b0\s+NEMOVITOST"))


def parameters(els: Column) -> Column:
    """map<label, value> of table rows and definition lists; the last of equal labels wins."""
    cells = lambda r: F.filter(els, lambda e: (e["parent"] == r["idx"]) & e["tag"].isin("td", "th"))
    rows = F.filter(F.transform(of_tag(els, "tr"), cells), lambda c: F.size(c) >= 2)
    pairs = F.transform(rows, lambda c: F.struct(c[0]["text"].alias("k"), c[1]["text"].alias("v")))
    terms = F.transform(of_tag(els, "dt"), lambda t: F.struct(t["text"].alias("k"), F.try_element_at(F.transform(F.filter(els, lambda e: (e["tag"] == "dd") & (e["parent"] == t["parent"]) & (e["idx"] > t["idx"])), lambda e: e["text"]), F.lit(1)).alias("v")))
    both = F.filter(F.transform(F.concat(pairs, terms), lambda p: F.struct(F.regexp_replace(p["k"], r"\s*:\s*$", "").alias("k"), p["v"].alias("v"))), lambda p: (p["k"] != "") & p["v"].isNotNull())
    back = F.reverse(both)
    return F.map_from_entries(F.reverse(distinct_by(back, "k")))


def label_rows(els: Column) -> Column:
    """Texts of table rows and list items."""
    return F.transform(of_tag(els, "tr", "li"), lambda e: e["text"])


def row_areas(rows: Column) -> tuple[Column, Column]:
    """(built-up, land): rows that mention a plot count as land; the last row wins."""
    number = lambda r: first_group(F.regexp_replace(r, r"[\s ](?=[0-9])", ""), r"([0-9]+)\s*m").try_cast("double")
    with_area = F.filter(rows, lambda r: number(r).isNotNull() & r.rlike(rx("ploch|výměr|pozem|m²|m2")))
    plot = lambda r: r.rlike(rx("pozem|parcel|zahrad"))
    last = lambda a: F.try_element_at(F.transform(a, number), F.lit(-1))
    return last(F.filter(with_area, lambda r: ~plot(r))), last(F.filter(with_area, plot))


def row_location(rows: Column, longest: bool = False) -> Column:
    """Value of the location row: the last one, or the longest."""
    own = F.filter(F.transform(rows, lambda r: F.trim(first_group(r, rx(r"(?:lokalita|adresa|obec|umístění)\s*:?\s*(.+)$")))), lambda x: x.isNotNull())
    by_size = F.array_max(F.transform(own, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    return by_size if longest else F.try_element_at(own, F.lit(-1))


def row_gps(text: Column) -> Column:
    """``48,85 N, 16,05 E`` with decimal commas."""
    number = lambda i: F.replace(F.nullif(F.regexp_extract(text, r"(\d{2}[.,]\d+)\D+(\d{2}[.,]\d+)", i), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(number(1).isNotNull(), F.struct(number(1).alias("lat"), number(2).alias("lon")))


def gps(markup: Column) -> Column:
    """Coordinates of an inline map script, else of data attributes."""
    pair = lambda p, i: F.nullif(F.regexp_extract(markup, p, i), F.lit("")).try_cast("double")
    script = r"(?i)(?:LatLng\(|lat[\"']?\s*[:=]\s*)\s*(-?\d+\.\d+)\s*,\s*(?:[\"']?l(?:ng|on)[\"']?\s*[:=]\s*)?(-?\d+\.\d+)"
    lat = F.coalesce(pair(script, 1), pair(r"(?i)data-(?:gps-)?lat(?:itude)?=[\"'](-?\d+\.\d+)", 1))
    lon = F.coalesce(pair(script, 2), pair(r"(?i)data-(?:gps-)?(?:lng|lon)(?:gitude)?=[\"'](-?\d+\.\d+)", 1))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def images(els: Column, base: str, most: int = 20) -> Column:
    """Addresses of pictures, size suffixes removed, in order without repeats."""
    src = F.filter(F.transform(of_tag(els, "img"), lambda e: F.coalesce(widest(attr(e, "srcset")), attr(e, "data-src"), attr(e, "src"))), lambda s: F.coalesce(s, F.lit("")) != "")
    return F.slice(F.array_distinct(F.transform(src, lambda s: unsized(absolute(s, base)))), 1, most)


def widest(srcset: Column) -> Column:
    """The candidate of a srcset with the largest width."""
    parts = F.transform(F.split(F.nullif(srcset, F.lit("")), r"\s*,\s+"), lambda p: F.struct(F.coalesce(first_group(p, r"\s([0-9]+)w").try_cast("int"), F.lit(0)).alias("w"), first_group(p, r"^\s*(\S+)").alias("url")))
    return F.array_max(parts)["url"]


def unsized(url: Column) -> Column:
    return F.regexp_replace(url, r"-[0-9]{2,4}x[0-9]{2,4}(\.[A-Za-z]+)$", "$1")


def full_size(thumbs: Column, most: int = 20) -> Column:
    """Thumbnail addresses ``…/1t/12/345.jpg`` to full size, by their index."""
    own = F.transform(thumbs, lambda u: F.struct(first_group(u, r"/([0-9]+)t?/").try_cast("int").alias("i"), F.regexp_replace(u, r"/([0-9]+)t/", "/$1/").alias("u")))
    return F.slice(F.array_distinct(F.transform(F.array_sort(own), lambda x: x["u"])), 1, most)


def repaired_thumb(url: Column) -> Column:
    """Thumbnails named ``name_W_H.ext`` live under ``thumbs_W_H/``."""
    return F.when(url.contains("thumbs_"), url).otherwise(F.regexp_replace(url, r"^(.*/)([^/]+)_([0-9]+)_([0-9]+)(\.[a-z]+)$", "$1thumbs_$3_$4/$2$5"))


def paragraphs(els: Column, shortest: int = 80, most: int = 6) -> Column:
    own = F.filter(F.transform(of_tag(els, "p"), lambda e: e["text"]), lambda t: F.length(t) > shortest)
    return F.array_join(F.slice(own, 1, most), "\n\n")


def description(els: Column) -> Column:
    """Class-named block, else the meta description, else a paragraph of 100 to 2000 characters that is not navigation."""
    block = first_text(F.filter(of_class(els, "popis|desc"), lambda e: F.length(e["text"]) > 50))
    meta = F.try_element_at(F.transform(F.filter(of_tag(els, "meta"), lambda e: (attr(e, "name") == "description") & (F.length(attr(e, "content")) > 20)), lambda e: attr(e, "content")), F.lit(1))
    para = first_text(F.filter(of_tag(els, "p"), lambda e: F.length(e["text"]).between(100, 2000) & ~e["text"].rlike(rx("cookie|menu|přihlásit"))))
    return F.coalesce(block, meta, para, F.lit(""))


def sold_texts(els: Column) -> Column:
    """Where a page says that a listing is gone: title, headings, status classes, data attributes."""
    heads = F.transform(of_tag(els, "title", "h1", "h2"), lambda e: e["text"])
    return F.concat(heads, F.transform(of_class(els, "status|label|badge"), lambda e: e["text"]), F.filter(F.transform(els, lambda e: attr(e, "data-status")), lambda s: s.isNotNull()))


def parsed(pages: DataFrame, markup: str = "html") -> DataFrame:
    return pages.withColumn("elements", elements(F.coalesce(markup, F.lit(""))))
