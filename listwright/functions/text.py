"""Text rules: extraction, classification, translation, clean-up, scoring."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model
from .numbers import first_group

# The ordered patterns of the enrichment, first match wins.
CONDITIONS = [
    ("Novostavba", "novostavb|ve výstavb|pod klíč|developerský projekt"),
    ("Po rekonstrukci", "po kompletní rekonstrukci|po celkové rekonstrukci|po rekonstrukci|kompletně zrekon"),
    ("Před rekonstrukcí", "před rekonstrukcí|k rekonstrukci|vyžaduje rekonstrukci|potřebuje rekonstrukci"),
    ("K demolici", "k demolici|velmi špatný stav|havarijní"),
    ("Dobrý stav", "zachovalý stav|dobrý stav|udržovaný stav|v dobrém stavu"),
]
CONSTRUCTIONS = [
    ("Cihla", "cihlová|cihlový|ciheln|cihla|z cihel"),
    ("Panel", "panel[oá]|panelový dům|panelová budova"),
    ("Dřevo", "dřevěn|dřevosta|srubov|rouben|ze dřeva"),
    ("Montovaná", "montovan|prefabrikát|skelet"),
    ("Zděná", r"\bzděn[aáéý]\b"),
]
#: The later backfill knows more wordings.
CONDITIONS_BACKFILL = [(name, p + ("|v zachovalém" if name == "Dobrý stav" else "")) for name, p in CONDITIONS]
CONSTRUCTIONS_BACKFILL = [(name, p + ("|zděná vila" if name == "Zděná" else "")) for name, p in CONSTRUCTIONS]
# Needle and label, in this order, for titles, URLs and breadcrumbs.
TYPE_NEEDLES = [("dum", "House"), ("dům", "House"), ("domy", "House"), ("byt", "Apartment"), ("pozem", "Land"), ("chat", "Cottage"), ("chalup", "Cottage"), ("komer", "Commercial"), ("garáž", "Garage"), ("garaz", "Garage"), ("průmysl", "Industrial")]
OFFER_NEEDLES = [("pronájem", "Rent"), ("pronajem", "Rent"), ("nájem", "Rent"), ("dražb", "Auction")]
# Words that mark a new building, and characters that file names must not hold.
NEW_BUILD = ["novostavb", "ve výstavb", "pod klíč", "developerský projekt", "dokončení 202"]
ILLEGAL_IN_NAMES = '/\\:*?"<>|'
# Letters with accents and their plain forms, the letters and words that mark Czech, phrases that mark English.
ACCENTED = "áčďéěíňóřšťúůýžäëöüôľĺŕÁČĎÉĚÍŇÓŘŠŤÚŮÝŽÄËÖÜÔĽĹŔ"
PLAIN = "acdeeinorstuuyzaeouollrACDEEINORSTUUYZAEOUOLLR"
CZECH_LETTERS = "áčďéěíňóřšťúůýž"
CZECH_WORDS = ["nemovitost", "inzerat", "prodej", "koupe", "cena", "plocha", "pozemek", "rekonstrukc", "stav", "lokac", "dispozic", "mistnost", "koupeln", "zahrad", "sklep", "garaz", "vytapeni", "doporucuj", "nemovitosti", "inzerátu", "prodeje", "koupě", "ceny", "plochy", "rekonstrukce", "koupelna", "zahrada", "garáž", "vytápění", "doporučuj"]
ENGLISH_SIGNAL = r"\b(the property|this house|would |however,|furthermore|in conclusion|overall,|I recommend)"
# Topics of the report's score and their patterns.
TOPICS = [
    ("Odlozene predani 2027", r"predani.*2027|2027.*predani|brezen.*2027|predani.{0,30}rok"),
    ("Stodola / hospodarska vada", r"stodol|hospodar"),
    ("Rozbor studnicni vody", r"laboratorni|rozbor.*vod|studnicni.*vod|voda.{0,30}analyz"),
    ("Smluvni pokuta za prodleni", r"smluvni.{0,5}pokut|pokuta.{0,30}prodleni"),
    ("Rohova parcela", r"rohov.{0,10}parcel|rohov.{0,10}pozemek"),
    ("Hodnota po rekonstrukci", r"hodnota.{0,20}po rekonstrukci|po rekonstrukci.{0,30}\d"),
    ("Yield / hruby vynos", r"yield|hrub.{0,10}vynos|hrub.{0,10}vyno|odhadovany najem|rocni najem"),
    ("Bodovaci tabulka / skore", r"\d\s*/\s*5\b|SKORE|HODNOCENI.*bod|celkov.{0,10}hodnoceni"),
    ("ROI / investicni navratnost", r"navratnost|ROI|return"),
    ("Otazky pred koupi / DD", r"otazky|co.{0,10}zeptat|Due Diligence|co poverit|doporucujeme"),
    ("Konkretni vady (bullets)", r"rizika|VADY|PROBLEMY"),
    ("Max nabidkova cena (Kc)", r"[3-4]\s*[0-9]{2,3}\s*[0-9]{3}|maximalni.*cena|nabidnout"),
    ("PENB chybejici", r"PENB.{0,30}chybi|chybi.{0,30}PENB|PENB.*kriti|energetick.{0,20}prukaz"),
    ("Povodnove riziko", r"povodnov|povoden|zaplaveni"),
    ("Srovnani Kc/m2 s trhem", r"trzni.{0,50}Kc|trzne.{0,50}Kc|prumer.{0,20}Kc/m|trzni.{0,30}obvyklou|trzne.{0,30}obvyklou"),
]


def rx(pattern: str) -> str:
    """Unicode-aware case folding and classes, as text rules are meant."""
    return "(?iuU)" + pattern


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Label of the first rule whose pattern occurs."""
    return F.coalesce(*(F.when(text.rlike(rx(p)), name) for name, p in rules))


def disposition(text: Column) -> Column:
    return F.upper(first_group(text, r"(?iu)([0-9]+\+(?:[0-9]+|kk))"))


def rooms(disp: Column) -> Column:
    return first_group(disp, "^([0-9]+)").try_cast("int")


def condition(text: Column, rules=CONDITIONS) -> Column:
    return first_match(text, rules)


def construction(text: Column, rules=CONSTRUCTIONS) -> Column:
    return first_match(text, rules)


def contains_first(text: Column, needles: list[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first needle in the lower-cased text."""
    found = F.coalesce(*(F.when(F.lower(text).contains(n), label) for n, label in needles))
    return found if default is None else F.coalesce(found, F.lit(default))


def infer_property_type(*fields: Column) -> Column:
    """Fields in order of trust: breadcrumb, title, URL."""
    return F.coalesce(*(contains_first(f, TYPE_NEEDLES) for f in fields), F.lit("Other"))


def infer_offer_type(*fields: Column) -> Column:
    return F.coalesce(*(contains_first(f, OFFER_NEEDLES) for f in fields), F.lit("Sale"))


def external_id(url: Column) -> Column:
    """UUID, else trailing digits, else leading digits of the last path part, else that part, else the URL."""
    last = first_group(url, r"/([^/?#]+)/?(?:[?#].*)?$")
    return F.coalesce(first_group(url, r"(?i)([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})"), first_group(last, r"-([0-9]+)(?:\.\w+)?$"), first_group(last, r"^([0-9]+)"), last, url)


def slug_title(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def location_with_district(loc: Column, district: str = "Znojmo", region_stem: str = "jihomoravsk") -> Column:
    tail = f"okres {district}"
    known = F.lower(loc).contains(district.lower()) | F.lower(loc).contains(region_stem)
    return F.when(F.coalesce(F.trim(loc), F.lit("")) == "", tail).when(known, loc).otherwise(F.concat(loc, F.lit(f", {tail}")))


def location_postal(text: Column) -> Column:
    """``PSČ town`` after its label, else anywhere; blanks squeezed, 100 characters."""
    # The label, and what ends the place after it.
    near = first_group(text, rx(r"Lokalita\s*:?\s*(?:Mapa\s*)?([0-9]{3}\s?[0-9]{2}\s+\w[\w\s\-,.]+?)(?:\s+Vidělo|\s+Cena\s*:|\n|$)"))
    far = first_group(text, r"([0-9]{3}\s?[0-9]{2}\s+\p{Lu}[\p{Ll}\s\-]+)")
    return F.left(F.trim(F.regexp_replace(F.coalesce(near, far, F.lit("")), r"(?U)\s+", " ")), F.lit(100))


def clean_description(text: Column, size: int = 5000) -> Column:
    """Lines of site controls and dates go, the rest is trimmed and joined."""
    # The texts of site controls.
    control = rx(r"^\s*(?:Smazat|Upravit|Topovat|Nahlásit|Oblíbené|P[řr]idat do|Spam|Tisk|Facebook|Sdílejte|Doporučit|Podobné)\s*/?\s*(?:Smazat|Upravit|Topovat)?\s*$")
    date = r"^[-\s]*\[?[0-9]{1,2}\.\s*[0-9]{1,2}\.\s*[0-9]{4}\]?\s*$"
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.left(F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(control) & ~x.rlike(date)), "\n"), F.lit(size))


def is_demand(title: Column) -> Column:
    """The advertiser seeks, does not offer."""
    # The first words of a demand.
    return title.rlike(rx(r"^\s*(?:hled[aá]m|hled[aá]me|koup[ií]m|koup[ií]me|popt[aá]v)"))


def is_sold(texts: Column) -> Column:
    """``texts``: title, headings, status classes of a page."""
    return F.exists(texts, lambda t: F.lower(t).rlike("prodáno|prodano|rezervov|sold|reserved"))


def city(location: Column) -> Column:
    """First comma part; the second when the first ends in a number."""
    parts = F.transform(F.split(location, ","), lambda x: F.trim(x))
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    return F.when(first.rlike(r"\s+[0-9]+\s*$") & (F.coalesce(second, F.lit("")) != ""), second).otherwise(first)


def geocode_attempts(location: Column, municipality: Column, district: Column) -> Column:
    """Texts to try in turn; short ones are left out."""
    tries = F.array_compact(F.array(location, F.when(municipality.isNotNull(), F.concat_ws(", ", municipality, district)), district))
    return F.array_distinct(F.filter(F.transform(tries, lambda t: F.trim(t)), lambda t: F.length(t) >= 3))


def lat_lon(text: Column) -> Column:
    """``lat,lon`` as a struct, null for anything else."""
    lat, lon = (F.trim(F.try_element_at(F.split(text, ","), F.lit(i))).try_cast("double") for i in (1, 2))
    ok = (F.size(F.split(text, ",")) == 2) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))


def address_query(location: Column, size: int) -> Column:
    """District and region parts go."""
    return F.left(F.trim(F.regexp_replace(location, rx(r",?\s*(okres|kraj|okr\.)\s+\S+"), "")), F.lit(size))


def prefer_municipality(municipality: Column, location: Column) -> Column:
    return F.when(F.trim(municipality) != "", F.trim(municipality)).otherwise(address_query(location, 80))


def cadastre_url(code: Column, base: str = "https://vdp.cuzk.cz/vdp/ruian/adresnimista/%d", fallback: str = "https://nahlizenidokn.cuzk.cz") -> Column:
    return F.when(code.isNotNull(), F.format_string(base, code)).otherwise(fallback)


def normalize_status(status: Column) -> Column:
    """Known texts in any case come back as given, the rest is New."""
    return F.when(F.lower(status).isin([s.lower() for s in model.STATUSES]), status).otherwise("New")


def translate_property(t: Column) -> Column:
    return model.lookup(model.PROPERTY_LABELS, t, F.coalesce(t, F.lit("-")))


def translate_offer(t: Column) -> Column:
    return model.lookup(model.OFFER_LABELS, t, F.coalesce(t, F.lit("-")))


def translate_status(s: Column) -> Column:
    return model.lookup(model.STATUS_LABELS, s, F.lit("Nové"))


def csv_field(v: Column) -> Column:
    return F.when(F.coalesce(v, F.lit("")) == "", "").when(v.rlike('[;\n"]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def is_new_build(cond: Column, description: Column) -> Column:
    hay = F.lower(F.concat(F.coalesce(cond, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    words = reduce(lambda a, b: a | b, (hay.contains(w) for w in NEW_BUILD))
    return words | F.coalesce(F.lower(cond).contains("nový") | F.lower(cond).contains("nová"), F.lit(False))


def sanitize_name(name: Column) -> Column:
    return F.left(F.trim(F.translate(name, ILLEGAL_IN_NAMES, "_" * len(ILLEGAL_IN_NAMES))), F.lit(100))


def category(raw: Column) -> Column:
    return model.lookup({c: c for c in model.PHOTO_CATEGORIES} | model.PHOTO_ALIASES, F.lower(F.trim(raw)), F.lit("other"))


ASCII = bytes(range(128))


@cache
def without_marks(c: str) -> str:
    """Decomposed (NFD), combining marks dropped."""
    return "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")


def plain(text: str | None) -> str | None:
    """The text without combining marks, character by character, or at once where decomposing could change the order."""
    if text is None or text.isascii():
        return text
    found = set(text.encode().translate(None, ASCII).decode())
    if any(unicodedata.combining(x) for c in found for x in without_marks(c)):
        return without_marks.__wrapped__(text)
    # What comes out of one character is never stripped again, so the order of replacements has no part in it.
    for c in found:
        if without_marks(c) != c:
            text = text.replace(c, without_marks(c))
    return text


def translate_accents(text: Column) -> Column:
    """The letters of a fixed table only; ``strip_accents`` takes every mark off."""
    return F.translate(text, ACCENTED, PLAIN)


def strip_accents(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(plain)

    return F.pandas_udf(run, "string")(text)


def czech_flags(text: Column) -> tuple[Column, Column, Column]:
    """Share of accented letters above 3 %, four domain words, no English phrases."""
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    own = F.length(F.regexp_replace(text, f"(?iu)[^{CZECH_LETTERS}]", ""))
    low = F.lower(text)
    words = reduce(lambda a, b: a + b, (low.contains(w).cast("int") for w in CZECH_WORDS))
    return own / F.greatest(letters, F.lit(1)) > 0.03, words >= 4, ~text.rlike("(?i)" + ENGLISH_SIGNAL)


def topic_score(text: Column) -> Column:
    bare = strip_accents(text)
    hits = [bare.rlike("(?i)" + p).cast("int") for _, p in TOPICS] + [c.cast("int") for c in czech_flags(text)]
    return reduce(lambda a, b: a + b, hits)


def verdict(text: Column) -> Column:
    """Fifteen lines from the first that names a verdict, else 600 characters."""
    lines = F.split(text, "\n")
    flags = F.transform(lines, lambda x: F.lower(x).contains("verdikt") | F.lower(x).contains("doporučen"))
    at = F.array_position(flags, True)
    return F.when(at == 0, excerpt(text, 600)).otherwise(F.regexp_replace(F.array_join(F.slice(lines, at.cast("int"), 15), "\n"), r"(?U)^\s+|\s+$", ""))


def verdict_section(text: Column) -> Column:
    """The section under a verdict heading, else under a conclusion heading; 1500 characters."""
    # Headings that open a verdict, and what ends its section.
    tail = r".*?(?=\n##|\n---|\z)"
    found = F.coalesce(*(first_group(text, "(?siu)(" + head + tail + ")") for head in (r"(?:##\s*)?(?:🏁|VERDIKT|DOPORUČENÍ)", r"(?:##\s+[0-9]+\.\s*)?(?:ZÁVĚR|CELKOVÉ|SHRNUTÍ)")), F.lit(""))
    found = F.trim(found)
    return F.when(F.length(found) > 1500, F.concat(F.left(found, F.lit(1500)), F.lit("\n…"))).otherwise(found)


def first_table(text: Column) -> Column:
    return F.regexp_extract(text, r"(\|[^\n]+\|\n\|[-| :]+\|\n(?:\|[^\n]+\|\n?)+)", 1)


def excerpt(text: Column, size: int = 300) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("…"))).otherwise(text)


def capped(text: Column, size: int) -> Column:
    """Cut at the last line end past half of ``size``, with a note of what is shown."""
    head = F.left(text, F.lit(size))
    line = F.length(head) - F.locate("\n", F.reverse(head))
    head = F.when((F.locate("\n", F.reverse(head)) > 0) & (line > size // 2), F.left(head, line)).otherwise(head)
    note = F.concat(F.lit("\n[…"), F.format_string("%d", F.floor(F.length(head) * 100 / F.length(text))), F.lit(" %]"))
    return F.when(F.length(text) > size, F.concat(head, note)).otherwise(text)


def sentences_once(text: Column, size: int) -> Column:
    """Sentences without repeats and fragments, up to a budget of characters."""
    parts = F.filter(F.transform(F.split(text, r"\."), lambda s: F.trim(s)), lambda s: s != "")
    start = F.struct(F.lit("").alias("out"), F.array().cast("array<string>").alias("seen"), F.lit(False).alias("full"))

    def step(acc, s):
        key = F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9 ]", ""))
        skip = acc["full"] | (F.length(key) < 10) | F.array_contains(acc["seen"], key)
        over = F.length(acc["out"]) + F.length(s) + 2 > size
        return F.when(skip, acc).when(over, F.struct(acc["out"].alias("out"), acc["seen"].alias("seen"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(acc["out"], s, F.lit(". ")).alias("out"), F.concat(acc["seen"], F.array(key)).alias("seen"), F.lit(False).alias("full")))

    out = F.trim(F.aggregate(parts, start, step)["out"])
    return F.when(out == "", F.left(text, F.lit(size))).otherwise(out)


def lexemes(text: Column) -> Column:
    """Distinct lower-cased words, no stemming, no stop words."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def extension_of(content_type: Column) -> Column:
    return model.lookup({"image/png": ".png", "image/webp": ".webp", "image/gif": ".gif", "image/jpeg": ".jpg"}, F.lower(F.regexp_replace(content_type, ";.*$", "")), F.lit(".jpg"))


def local_path(stored_url: Column, root: str = "/uploads") -> Column:
    return F.regexp_replace(stored_url, r"^(?:https?://[^/]+)?/?(?:uploads/)?", f"{root}/")


