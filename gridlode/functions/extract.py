"""Fields out of HTML, JSON, addresses, titles and URLs, as regular expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c

# Fixed values.
SPONSOR_MARKS = ("/sponsor/", "/ad/", "/advertisement/", "utm_source", "utm_medium", "utm_campaign", "partner", "affiliate")
STATES = (
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia", "Hawaii", "Idaho",
    "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi",
    "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio",
    "Oklahoma", "Oregon", "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia",
    "Washington", "West Virginia", "Wisconsin", "Wyoming",
)


def _found(text, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(_c(text), pattern, group)), F.lit(""))


def is_sponsor_link(url) -> Column:
    low, out = F.lower(_c(url)), F.lit(False)
    for mark in SPONSOR_MARKS:
        out = out | F.contains(low, F.lit(mark))
    return out


def parse_address(address) -> Column:
    """struct<city, state, postal_code>: 'City, ST 12345', else 'City, State 12345', else what stands alone."""
    # The forms of an address.
    zip_code = r"([0-9]{5}(?:-[0-9]{4})?)"
    short, named = rf"([^,]+),\s*([A-Z]{{2}})\s+{zip_code}", rf"([^,]+),\s*([A-Za-z\s]+)\s+{zip_code}"
    pick = lambda *fields: F.struct(*[v.alias(n) for v, n in zip(fields, ("city", "state", "postal_code"))])
    groups = lambda p: [_found(address, p, i) for i in (1, 2, 3)]
    alone = pick(F.lit(None).cast("string"), _found(address, r"\b([A-Z]{2})\b"), _found(address, rf"\b{zip_code}\b"))
    return F.when(_c(address).rlike(short), pick(*groups(short))).when(_c(address).rlike(named), pick(*groups(named))).otherwise(alone)


def coordinates(html) -> Column:
    """struct<lat, lon> from a map link, else data attributes, else script variables; null if none is in range."""
    # The forms in which pages give coordinates, in the order in which they are tried.
    number = r"([+-]?[0-9]+\.?[0-9]*)"
    maps = r"[@&](-?[0-9]+\.[0-9]+),(-?[0-9]+\.[0-9]+)"
    tries = [
        (_found(html, maps, 1), _found(html, maps, 2)),
        (_found(html, r"data-lat=[\"']" + number), _found(html, r"data-lng=[\"']" + number)),
        (_found(html, rf"(?i)(?:lat|latitude)[\"']?\s*[:=]\s*{number}"), _found(html, rf"(?i)(?:lng|lon|longitude)[\"']?\s*[:=]\s*{number}")),
        (_found(html, rf"(?i)<meta[^>]+latitude[\"'][^>]+content=[\"']{number}"), _found(html, rf"(?i)<meta[^>]+longitude[\"'][^>]+content=[\"']{number}")),
    ]
    out = []
    for lat, lon in tries:
        lat, lon = lat.try_cast("double"), lon.try_cast("double")
        out.append(F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon"))))
    return F.coalesce(*out)


def valid_page(html, least: int = 500, blocked: str = "(?i)access denied|captcha|verify you are human") -> Column:
    """Whether a fetched page is long enough and not a refusal."""
    return (F.length(_c(html)) >= least) & ~_c(html).rlike(blocked)


def anchors(html) -> Column:
    """array<struct<href, text>> of the anchors with plain text, in order."""
    pattern = r"<a\b[^>]*?href=[\"']([^\"']*)[\"'][^>]*>([^<]*)"
    pairs = F.arrays_zip(F.regexp_extract_all(_c(html), F.lit(pattern), 1).alias("href"), F.regexp_extract_all(_c(html), F.lit(pattern), 2).alias("text"))
    return F.transform(pairs, lambda p: F.struct(p["href"], F.trim(p["text"]).alias("text")))


def slug(href) -> Column:
    """The last path segment of a link."""
    return F.element_at(F.split(F.regexp_replace(_c(href), "/$", ""), "/"), -1)


def resolve_url(href, base) -> Column:
    """An absolute URL from a link and the URL of its page."""
    h, b = _c(href), _c(base)
    origin = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]+)", 1)
    scheme = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    return F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), h).when(h.startswith("//"), F.concat(scheme, h)).when(h.startswith("/"), F.concat(origin, h)).otherwise(F.concat(F.regexp_replace(b, r"[^/]*$", ""), h))


def state_links(html) -> Column:
    """Anchors to '/usa/<slug>/' with a name that isn't 'usa'."""
    keep = lambda a: a["href"].contains("/usa/") & (F.size(F.split(a["href"], "/")) > 2) & (a["text"] != "") & (F.lower(a["text"]) != "usa")
    return F.filter(anchors(html), keep)


def city_links(html, state) -> Column:
    """Anchors below the page of a state, without the state itself."""
    s = F.lower(_c(state))
    keep = lambda a: a["href"].contains(F.concat(F.lit("/usa/"), s, F.lit("/"))) & (F.size(F.split(a["href"], "/")) > 3) & (a["text"] != "") & (F.lower(a["text"]) != s)
    return F.filter(anchors(html), keep)


def facility_links(html, state, city) -> Column:
    """Anchors to facilities: below the city, else on older paths, else of cards. Listings, quotes and parents are left out."""
    place = lambda x: F.regexp_replace(F.lower(_c(x)), " ", "-")
    parent = F.concat(F.lit("/usa/"), place(state), F.lit("/"), place(city), F.lit("/"))
    generic = r"/(datacenters|facilities|datacenter|facility)/$"
    found = anchors(html)
    named = lambda a: (a["href"] != "") & (a["text"] != "") & ~a["href"].rlike(generic)
    first = F.filter(found, lambda a: named(a) & a["href"].contains(parent) & ~a["href"].endswith(parent) & ~a["href"].rlike("/quote/|/request-quote"))
    older = F.filter(found, lambda a: named(a) & a["href"].rlike("/(datacenters|facilities|datacenter|facility)/"))
    card = r"<a\b(?=[^>]*class=[\"'][^\"']*\bui\b[^\"']*\bcard\b)[^>]*?href=[\"']([^\"']*)[\"'][^>]*>(?:(?!</a>)[\s\S])*?class=[\"']header[\"'][^>]*>([^<]*)"
    cards = F.transform(
        F.arrays_zip(F.regexp_extract_all(_c(html), F.lit(card), 1).alias("href"), F.regexp_extract_all(_c(html), F.lit(card), 2).alias("text")),
        lambda p: F.struct(p["href"], F.trim(p["text"]).alias("text")),
    )
    cards = F.filter(cards, lambda a: (F.size(F.split(a["href"], "/")) >= 5) & ~a["href"].rlike("/(datacenters|facilities)/$"))
    each = F.when(F.size(first) > 0, first).when(F.size(older) > 0, older).otherwise(cards)
    # of links to one page the first counts
    return F.filter(each, lambda a, i: F.array_position(F.transform(each, lambda b: b["href"]), a["href"]) == i + 1)


def facility_cards(html) -> Column:
    """array<struct<name, operator, street, postal_city, href>> of list cards, by the order of their texts."""
    blocks = F.split(_c(html), r"<div[^>]*class=[\"'][^\"']*\bui\b[^\"']*\bcard\b[^\"']*[\"'][^>]*>")
    blocks = F.filter(blocks, lambda _, i: i > 0)

    def read(block):
        texts = F.filter(F.transform(F.split(F.regexp_replace(block, r"<[^>]*>", "\u0001"), "\u0001"), lambda t: F.trim(t)), lambda t: t != "")
        href = F.get(F.filter(F.regexp_extract_all(block, F.lit(r"href=[\"']([^\"']*/usa/[^\"']*)[\"']"), 1), lambda h: ~h.rlike("/quote/|/request-quote")), F.lit(0))
        name = F.nullif(F.trim(F.regexp_extract(block, r"class=[\"'][^\"']*header[^\"']*[\"'][^>]*>([^<]*)", 1)), F.lit(""))
        return F.struct(name.alias("name"), F.get(texts, 1).alias("operator"), F.get(texts, 2).alias("street"), F.get(texts, 3).alias("postal_city"), href.alias("href"), F.size(texts).alias("n"))

    keep = lambda c: c["name"].isNotNull() & ~F.lower(c["name"]).contains("advertisement") & (c["n"] >= 3)
    return F.filter(F.transform(blocks, read), keep)


def first_of_class(html, names: str) -> Column:
    return _found(html, rf"class=[\"'][^\"']*(?:{names})[^\"']*[\"'][^>]*>\s*([^<]+)")


def facility_details(html, url) -> Column:
    """struct of name, address, its parts and coordinates of a facility page; the name may come from the URL."""
    title = _found(F.regexp_replace(_c(html), r"\|.*?</title>", "</title>"), r"<title[^>]*>\s*([^<]+)")
    name = F.coalesce(_found(html, r"<h1[^>]*>\s*([^<]+)"), first_of_class(html, "facility-name"), first_of_class(html, "datacenter-name"), title, F.initcap(F.regexp_replace(slug(url), "-", " ")))
    address = F.coalesce(first_of_class(html, "facility-address"), first_of_class(html, "address"), first_of_class(html, "location"))
    return F.struct(name.alias("name"), address.alias("address_full"), parse_address(address).alias("parts"), coordinates(html).alias("at"))


def next_data(html, path: str) -> Column:
    """A value of the JSON that a page embeds for its scripts."""
    return F.get_json_object(F.regexp_extract(_c(html), r"(?s)<script id=\"__NEXT_DATA__\"[^>]*>(.*?)</script>", 1), path)


def script_field(html, name: str) -> Column:
    """A quoted or numeric field of script text, escaped or not, with entities decoded."""
    raw = _found(html, rf"\\?[\"']{name}\\?[\"']\s*:\s*\\?[\"']?([^\"',}}\\]+)")
    return decode_entities(raw)


def decode_entities(text) -> Column:
    out = _c(text)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def json_ld(html, path: str) -> Column:
    """A value of the first linked-data block of a page."""
    return F.get_json_object(F.regexp_extract(_c(html), r"(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1), path)


def strip_number(text) -> Column:
    return F.nullif(F.regexp_replace(_c(text), r"[^0-9.\-]", ""), F.lit("")).try_cast("double")


def title_of(html) -> Column:
    return decode_entities(_found(html, r"<title[^>]*>([^<]*)"))


def state_in(title) -> Column:
    """The state with the longest name of those that a title names, so that names win over their parts; of equal lengths the first in the alphabet."""
    out = None
    for name in sorted(STATES, key=lambda s: (-len(s), s)):
        hit = F.contains(F.lower(_c(title)), F.lit(name.lower()))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Unknown")


def listing_id_of(url) -> Column:
    return F.coalesce(_found(url, r"[?&]sg=([0-9]+)"), _found(url, r"/salegroup/([0-9]+)"))


def _first_word(text, words, default) -> Column:
    """The value of the first (word, value) whose word a lower-cased text has."""
    low, out = F.lower(_c(text)), None
    for word, value in words:
        out = F.when(F.contains(low, F.lit(word)), value) if out is None else out.when(F.contains(low, F.lit(word)), value)
    return out.otherwise(default)


# Regions and listing types by words of a title, in order.
REGION_WORDS = (
    ("wyoming", "Wyoming"), ("nevada", "Nevada"), ("new mexico", "New Mexico"), ("alaska", "Alaska"), ("utah", "Utah"), ("montana", "Montana"),
    ("colorado", "Colorado"), ("oklahoma", "Oklahoma"), ("idaho", "Idaho"), ("las vegas", "Nevada"),
)
TYPE_WORDS = (("geothermal", "Geothermal"), ("land sale", "Land Sale"))


def listing_class(title) -> Column:
    """struct<region, listing_type, agency> by the words of a title."""
    region = _first_word(title, REGION_WORDS, "Unknown")
    named = lambda text: F.replace(F.lit(text), F.lit("{}"), region)
    agency = _first_word(
        title,
        (
            ("blm", named("BLM {} State Office")),
            ("state oil & gas", named("{} State Lands")),
            ("state land", named("{} State Lands")),
            ("dnr", named("{} DNR")),
            ("clo", named("{} CLO")),
            ("city of las vegas", "City of Las Vegas"),
        ),
        "Unknown Agency",
    )
    return F.struct(region.alias("region"), _first_word(title, TYPE_WORDS, "Oil & Gas Lease").alias("listing_type"), agency.alias("agency"))


def best_gis_link(links) -> Column:
    """Of array<struct<href, text>>: the link that names both GIS and WGS84, else GIS, else a ZIP file; the first of equals."""
    low = lambda a: F.lower(F.concat_ws(" ", a["href"], a["text"]))
    rank = lambda a: F.when(low(a).contains("gis") & low(a).contains("wgs84"), 0).when(low(a).contains("gis"), 1).when(F.lower(a["href"]).endswith(".zip"), 2)
    ranked = F.filter(F.transform(_c(links), lambda a, i: F.struct(rank(a).alias("r"), i.alias("i"), a["href"].alias("href"))), lambda x: x["r"].isNotNull())
    return F.array_min(ranked)["href"]


def discovery_link(path) -> Column:
    """Whether a link is one path segment of at least two dashed parts without a query."""
    return _c(path).rlike(r"^/[^/?#]+/?$") & (F.size(F.split(F.regexp_replace(_c(path), "/", ""), "-")) >= 2)


def data_version(ts) -> Column:
    return F.date_format(_c(ts), "yyyyMMdd")
