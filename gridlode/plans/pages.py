"""Queries that build pages, links, properties and texts from the views and take their fields out again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean, extract
from ..operators import stats, upsert
from .catalog import query


def _text(*parts):
    """Texts and columns joined; columns by name in braces."""
    return F.concat(*[F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in parts])


# addresses, coordinates, details


@query("""select internal_id, case internal_id % 4 when 3 then null else 'Town ' || country end as city, case internal_id % 4 when 0 then 'TX' when 1 then 'New Mexico' else 'CA' end as state,
  case internal_id % 4 when 0 then '75' || lpad((internal_id % 1000)::varchar, 3, '0') when 1 then '87' || lpad((internal_id % 1000)::varchar, 3, '0') || '-1234' when 2 then '90001' end as postal_code from datacenters""")
def parsed_addresses(v):  # its four forms
    k, tail = F.col("internal_id") % 4, F.lpad((F.col("internal_id") % 1000).cast("string"), 3, "0")
    head = F.concat(F.lit("12 Main St, Town "), "country")
    address = F.when(k == 0, F.concat(head, F.lit(", TX 75"), tail)).when(k == 1, F.concat(head, F.lit(", New Mexico 87"), tail, F.lit("-1234"))).when(k == 2, F.concat(head, F.lit(", CA 90001"))).otherwise("789 Long Blvd, CA")
    return v.datacenters.select("internal_id", extract.parse_address(address).alias("p")).select("internal_id", "p.city", "p.state", "p.postal_code")


@query("""select internal_id, case when latitude is null or internal_id % 7 = 6 then null else latitude end as lat, case when latitude is null or internal_id % 7 = 6 then null else longitude end as lon from datacenters""")
def page_coordinates(v):  # map links, data attributes, script variables, meta; beyond the globe is none
    k, lat, lon = F.col("internal_id") % 7, F.coalesce(F.col("latitude").cast("string"), F.lit("n/a")), F.coalesce(F.col("longitude").cast("string"), F.lit("n/a"))
    html = (
        F.when(k < 2, F.concat(F.lit('<iframe src="https://maps/@'), lat, F.lit(","), lon, F.lit(',15z">')))
        .when(k < 3, F.concat(F.lit('<div data-lat="'), lat, F.lit('" data-lng="'), lon, F.lit('">')))
        .when(k < 5, F.concat(F.lit("<script>var lat = "), lat, F.lit("; var longitude = "), lon, F.lit(";</script>")))
        .when(k < 6, F.concat(F.lit('<meta property="place:location:latitude" content="'), lat, F.lit('"><meta property="place:location:longitude" content="'), lon, F.lit('">')))
        .otherwise('<div data-lat="91.5" data-lng="10.0">')
    )
    return v.datacenters.select("internal_id", extract.coordinates(html).alias("c")).select("internal_id", "c.lat", "c.lon")


@query("""select internal_id, case internal_id % 3 when 0 then name when 1 then 'Title ' || internal_id else 'Dc ' || internal_id end as name, case when internal_id % 3 = 2 then null else internal_id || ' Road, Town, TX 75001' end as address, case when internal_id % 3 = 2 then null else 'TX' end as state from datacenters""")
def facility_details(v):  # heading, title, then the URL
    k = F.col("internal_id") % 3
    place = _text('<div class="facility-address">', "{internal_id}", " Road, Town, TX 75001</div>")
    html = F.when(k == 0, F.concat(F.lit("<title>no | x</title><h1>"), "name", F.lit("</h1>"), place)).when(k == 1, F.concat(_text("<title>Title ", "{internal_id}", " | Site</title>"), place)).otherwise("<p>nothing</p>")
    d = extract.facility_details(html, _text("https://e.org/usa/texas/town/dc-", "{internal_id}", "/"))
    return v.datacenters.select("internal_id", d.alias("d")).select("internal_id", "d.name", F.col("d.address_full").alias("address"), F.col("d.parts.state").alias("state"))


@query("select internal_id, name || ' & Co' as name, power_capacity_mw as power, city, longitude as lon from datacenters")
def embedded_records(v):  # F40-F43: page data, script text, linked data
    data = F.to_json(F.struct(F.struct(F.concat("name", F.lit(" &amp; Co")).alias("name"), F.concat(F.col("power_capacity_mw").cast("string"), F.lit(" MW")).alias("power")).alias("props")))
    script = F.concat(F.lit('<script>self.push("{'), F.when(F.col("city").isNotNull(), F.concat(F.lit('\\"city\\":\\"'), "city", F.lit('\\",'))).otherwise(""), F.lit('\\"x\\":1}")</script>'))
    linked = F.to_json(F.struct(F.struct("longitude").alias("geo")))
    html = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script>"), script, F.lit('<script type="application/ld+json">'), linked, F.lit("</script>"))
    pages = v.datacenters.select("internal_id", html.alias("html"))
    power = extract.strip_number(extract.next_data("html", "$.props.power"))
    name = extract.decode_entities(extract.next_data("html", "$.props.name"))
    return pages.select("internal_id", name.alias("name"), power.alias("power"), extract.script_field("html", "city").alias("city"), extract.json_ld("html", "$.geo.longitude").cast("double").alias("lon"))


# cards and links


@query("select internal_id, 'Site ' || internal_id as name, coalesce(operator, 'Acme') as operator, internal_id || ' Road' as street, '/usa/texas/town/site-' || internal_id || '/' as href from datacenters where internal_id % 5 <> 0")
def city_cards(v):  # advertisements go
    k = F.col("internal_id") % 5 == 0
    card = F.concat(F.lit('<div class="ui card"><div class="header">'), F.when(k, "Advertisement").otherwise(_text("Site ", "{internal_id}")), F.lit("</div><p>"), F.coalesce("operator", F.lit("Acme")), F.lit("</p><p>"), _text("{internal_id}", " Road"), F.lit('</p><a href="/usa/texas/town/site-'), F.col("internal_id").cast("string"), F.lit('/"></a></div>'))
    pages = v.datacenters.select("internal_id", F.concat(F.lit("<html>"), card).alias("html"))
    return upsert.first_cards(pages, "internal_id").select("internal_id", "name", "operator", "street", "href")


@query("""select internal_id, unnest(case internal_id % 3 when 0 then ['/usa/texas/big-town/a-' || internal_id || '/', '/usa/texas/big-town/b/'] when 1 then ['/datacenters/x-' || internal_id] else ['/usa/texas/town/card-' || internal_id || '/'] end) as href from datacenters""")
def city_links(v):  # below the city, else on older paths, else of cards; once per link
    link = lambda *href: F.concat(F.lit('<a href="'), _text(*href), F.lit('">Some Site</a>'))
    first = F.concat(link("/usa/texas/big-town/a-", "{internal_id}", "/"), link("/usa/texas/big-town/"), link("/quote/usa/texas/big-town/z/"), link("/usa/texas/big-town/b/"), link("/usa/texas/big-town/b/"), link("/datacenters/y"))
    older = F.concat(link("/datacenters/x-", "{internal_id}"), link("/datacenters/"), link("/about/"))
    cards = F.concat(F.lit('<a class="ui card" href="'), _text("/usa/texas/town/card-", "{internal_id}", "/"), F.lit('"><div class="header">Card</div></a>'), link("/about/"))
    k = F.col("internal_id") % 3
    html = F.when(k == 0, first).when(k == 1, older).otherwise(cards)
    found = v.datacenters.select("internal_id", F.explode(extract.facility_links(html, F.lit("Texas"), F.lit("Big Town"))).alias("a"))
    return found.select("internal_id", "a.href")


@query("""select internal_id, internal_id % 4 = 0 as discovered, case internal_id % 3 when 0 then internal_id::varchar when 1 then (internal_id + 1)::varchar end as listing, case internal_id % 4 when 0 then 'c' when 1 then 'b' when 2 then 'a.zip' end as gis from datacenters""")
def link_rules(v):  # P25, F30, F44
    k = F.col("internal_id") % 4
    path = F.when(k == 0, _text("/dc-", "{internal_id}", "/")).when(k == 1, _text("/dc-", "{internal_id}", "/x")).when(k == 2, _text("/dc-", "{internal_id}", "?p=1")).otherwise(_text("/dc", "{internal_id}"))
    n = F.col("internal_id") % 3
    url = F.when(n == 0, _text("https://x?a=1&sg=", "{internal_id}")).when(n == 1, F.concat(F.lit("https://x/salegroup/"), (F.col("internal_id") + 1).cast("string"))).otherwise("https://x/none")
    link = lambda href, text, on: F.struct(F.when(on, href).otherwise("z").alias("href"), F.when(on, text).otherwise("none").alias("text"))
    links = F.array(link("a.zip", "maps", k < 3), link("b", "GIS data", k < 2), link("c", "gis WGS84", k < 1), link("d", "GIS", k < 1))
    return v.datacenters.select("internal_id", extract.discovery_link(path).alias("discovered"), extract.listing_id_of(url).alias("listing"), extract.best_gis_link(links).alias("gis"))


# properties, numbers, names


@query("""select parcel_id, case parcel_id % 3 when 0 then 'P' || parcel_id when 1 then 'T' || parcel_id else lpad((parcel_id + 1)::varchar, greatest(3, length((parcel_id + 1)::varchar))::int, '0') end as picked, case when parcel_id % 3 = 0 then 'PARCEL,county' else 'TRACT,county' end as other, array_to_string(list_filter(['active', 'large'], lambda f: case f when 'active' then is_active else acres > 25 end), ',') as flags from parcels""")
def parcel_props(v):  # F26, F27, F45
    k = F.col("parcel_id") % 3
    value = F.when(k == 0, _text("P", "{parcel_id}")).when(k == 1, _text("T", "{parcel_id}")).otherwise(" ")
    props = F.create_map(F.when(k == 0, "PARCEL").otherwise("TRACT"), value, F.lit("state"), F.col("state"), F.lit("county"), F.lit("c"))
    flags = F.create_map(F.lit("active"), F.col("is_active"), F.lit("large"), F.col("acres") > 25)
    # a number of more than three digits isn't cut
    picked = clean.pick_parcel_id(props, clean.PARCEL_ID_NAMES, F.col("parcel_id"))
    return v.parcels.select(
        "parcel_id",
        picked.alias("picked"),
        F.array_join(F.array_sort(F.map_keys(clean.other_props(props, ["listing_id", "parcel_id", "state", "acres", "description"]))), ",").alias("other"),
        F.array_join(F.array_sort(clean.active_flags(flags)), ",").alias("flags"),
    )


@query("""select gid, case gid % 5 when 0 then null when 1 then depth_m when 2 then null when 3 then depth_m + 0.5 else -depth_m end as number, case gid % 5 when 0 then -9999.0 when 3 then depth_m + 0.5 when 4 then -depth_m end as guarded, case gid % 5 when 0 then -9999.0 when 1 then depth_m when 3 then depth_m + 0.5 when 4 then -depth_m end as stripped from geo_points""")
def text_numbers(v):  # sentinels, units, words, plain numbers
    d, k = F.col("depth_m").cast("int").cast("string"), F.col("gid") % 5
    text = F.when(k == 0, "-9999").when(k == 1, F.concat(F.lit("$"), d, F.lit(" m"))).when(k == 2, "abc").when(k == 3, F.concat(F.lit(" "), d, F.lit(".5 "))).otherwise(F.concat(F.lit("-"), d, F.lit(".0")))
    return v.geo_points.select("gid", clean.parse_numeric(text).alias("number"), clean.guarded_number(text).alias("guarded"), extract.strip_number(text).alias("stripped"))


@query("""select c_custkey as id, 'my_' || lower(replace(c_mktsegment, ' ', '_')) || '_' || c_custkey as table_name, case when c_custkey < 1024 then printf('%.1f B', c_custkey::double) else printf('%.1f KB', round(c_custkey / 1024.0, 1)) end as size,
  case when c_custkey >= 3600 then (c_custkey // 3600) || 'h ' || (c_custkey % 3600 // 60) || 'm ' || (c_custkey % 60) || 's' when c_custkey >= 60 then (c_custkey // 60) || 'm ' || (c_custkey % 60) || 's' else c_custkey || 's' end as lasted, '20240229' as version from customer""")
def names_and_sizes(v):  # F32, F33, F46
    c = v.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    name = F.concat(F.lit("  My "), "segment", F.lit(" ("), F.col("id").cast("string"), F.lit(")! "))
    return c.select("id", clean.table_name(name).alias("table_name"), clean.file_size("id").alias("size"), clean.duration(F.col("id") * 1000 + 999).alias("lasted"), extract.data_version(F.lit("2024-02-29 10:00:00").cast("timestamp")).alias("version"))


@query("""select gid, case when kv is null then '#999999' when kv < 69 then '#4CAF50' when kv < 138 then '#FF9800' when kv < 230 then '#2196F3' when kv < 345 then '#9C27B0' when kv < 500 then '#F44336' else '#000000' end as colour,
  round(case when coalesce(kv, 0) < 69 then 0.75 when kv < 138 then 1.15 when kv < 230 then 1.5 when kv < 345 then 1.85 when kv < 500 then 2.25 else 2.75 end::double, 6) as width from geo_lines""")
def line_styles(v):  # F10, half way between the two zooms
    return v.geo_lines.select("gid", clean.line_colour("kv").alias("colour"), F.round(clean.line_width("kv", 5.5), 6).alias("width"))


@query("""select distinct case when industry_type_sectors like '%Power Plants%' then 'Power Plants' when industry_type_sectors like '%Petroleum%' or industry_type_sectors like '%Natural Gas%' then 'Petroleum/Natural Gas' when industry_type_sectors like '%Waste%' then 'Waste'
  when industry_type_sectors like '%Chemicals%' then 'Chemicals' when industry_type_sectors like '%Minerals%' then 'Minerals' when industry_type_sectors like '%Metals%' then 'Metals' else 'Other' end as category from emitters""")
def distinct_categories(v):  # U3
    return stats.distinct_categories(v.emitters)
