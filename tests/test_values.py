"""Values of queries that SQL cannot express, computed again in Python over all rows."""

import json
import re
import unicodedata
from html.parser import HTMLParser

from listwright.functions import text
from listwright.plans import catalog


def test_topic_scores(spark, sf):
    words = [w.lower() for w in text.CZECH_WORDS]

    def score(s):
        bare = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
        letters, low = [c for c in s if c.isalpha()], s.lower()
        flags = [sum(c.lower() in text.CZECH_LETTERS for c in letters) / max(1, len(letters)) > 0.03, sum(w in low for w in words) >= 4, not re.search(text.ENGLISH_SIGNAL, s, re.I)]
        return sum(bool(re.search(p, bare, re.I)) for _, p in text.TOPICS) + sum(flags)

    whole = {r.doc_id: r.text for r in catalog.view(spark, sf, "documents").filter("text IS NOT NULL").collect()}
    got = {r.doc_id: r.score for r in catalog.QUERIES["topic_scores"](spark, sf).collect()}
    assert {i: got[i] for i in whole} == {i: score(s) for i, s in whole.items()} and len(set(got.values())) > 1


def test_dataset_is_permuted(spark, sf):
    def rows(df):
        return [tuple(r) for r in df.collect()]

    got = catalog.QUERIES["dataset_shuffled"](spark, sf)
    own = rows(catalog.view(spark, sf, "documents").select(*got.columns))
    assert sorted(rows(got)) == sorted(own) and rows(got) != own


def test_export_json_holds_the_listing(spark, sf):
    listings = {r.id: r for r in catalog.view(spark, sf, "listings").collect()}
    photos = {}
    for r in catalog.view(spark, sf, "photos").collect():
        photos.setdefault(r.listing_id, []).append((r.order_index, r.id, r.original_url))
    for r in catalog.QUERIES["export_json"](spark, sf).collect():
        x, own = json.loads(r.json), listings[r.id]
        for key in ("id", "title", "property_type", "offer_type", "location_text", "municipality", "rooms", "condition", "url", "description"):
            assert x[key] == own[key]
        assert x["price"] == (None if own.price is None else float(own.price)) and x["area_land_m2"] == own.area_land
        assert x["photo_urls"] == [u for *_, u in sorted(photos.get(r.id, []))] and x["photos_count"] == len(x["photo_urls"])


class Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.hrefs = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.hrefs.append(dict(attrs).get("href") or "")


def test_links_come_from_the_pages(spark, sf):
    found = set()
    for r in catalog.view(spark, sf, "pages").collect():
        reader = Anchors()
        reader.feed(r.html or "")
        found |= {(r.page_id, h) for h in reader.hrefs}
    got = catalog.QUERIES["html_links"](spark, sf).collect()
    wanted = {(page, m[1]) for page, h in found if (m := re.search("^/([^/?#]+)$", h))}
    assert wanted and {(r.page_id, r.external_id) for r in got} == wanted and len(got) == len(wanted)
    assert all(r.url == f"http://example.com/{r.external_id}" for r in got)
