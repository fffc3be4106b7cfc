"""Cleaning, units, classes and validation as column expressions; header rules run on the driver on a few names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c, in_us, round_half_up

# Numbers that mean missing.
SENTINELS = (-9999.0, -99999.0, -999999.0)

# Header words of each field, in the order in which they are tried.
FIELD_WORDS = {
    "latitude": ("lat", "latitude", "y"),
    "longitude": ("lon", "lng", "longitude", "x"),
    "depth": ("depth", "depthm", "measureddepth"),
    "temperature": ("temperature", "temperaturef", "tempf", "temp", "temperaturec"),
    "geometry": ("geometry", "geom", "wkt"),
}


def detect_fields(headers: list[str]) -> dict[str, str]:
    """Field -> header: each header goes to the first open field one of whose words it contains."""
    out: dict[str, str] = {}
    for header in headers:
        plain = re.sub(r"[_\s-]", "", header.lower())
        for field, words in FIELD_WORDS.items():
            if field not in out and any(w in plain for w in words):
                out[field] = header
                break
    return out


def header_is_celsius(name: str) -> bool:
    low = name.lower()
    return "_c" in low or "celsius" in low or low.endswith("c")


def header_is_feet(name: str) -> bool:
    return any(w in name.lower() for w in ("_ft", "feet", "foot"))


def falsy_to_null(x) -> Column:
    """Null for null, '', 0 and NaN."""
    text = _c(x).cast("string")
    number = text.try_cast("double")
    return F.when(text.isNull() | (text == "") | (F.coalesce(number, F.lit(1.0)) == 0) | F.isnan(F.coalesce(number, F.lit(1.0))), None).otherwise(_c(x))


def or_default(x, default: str) -> Column:
    return F.coalesce(F.nullif(_c(x), F.lit("")), F.lit(default))


def clean_string(x) -> Column:
    return F.nullif(F.trim(_c(x)), F.lit(""))


def celsius_to_fahrenheit(c) -> Column:
    return _c(c) * 9 / 5 + 32


def fahrenheit_to_celsius(f) -> Column:
    """To one decimal, halves up."""
    return round_half_up((_c(f) - 32) * 5 / 9 * 10) / 10


def feet_to_metres(x) -> Column:
    return _c(x) * 0.3048


def depth_metres(x, feet: bool = False) -> Column:
    return F.abs(feet_to_metres(x) if feet else _c(x))


def leading_number(text) -> Column:
    """The number that a text begins with, else null."""
    return F.nullif(F.regexp_extract(_c(text), r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0), F.lit("")).try_cast("double")


def parse_numeric(x) -> Column:
    """The number in a text without its other characters; null for sentinels of missing data."""
    n = leading_number(F.regexp_replace(_c(x).cast("string"), r"[^-0-9.]", ""))
    return F.when(~n.isin(*SENTINELS), n)


def guarded_number(x) -> Column:
    """A cast that only plain decimal numbers pass."""
    return F.when(F.trim(_c(x)).rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.trim(_c(x)).try_cast("double"))


def parse_voltage(x, keep_sentinels: bool = False) -> Column:
    """Kilovolts in a text; of a range the largest. keep_sentinels: read '-9999' as a range that ends in 9999."""
    plain = F.regexp_replace(F.lower(_c(x).cast("string")), r"[^0-9\-.,]", "")
    kv = F.array_max(F.transform(F.split(plain, "-"), leading_number))
    return kv if keep_sentinels else F.when(~F.coalesce(_c(x).cast("string").try_cast("double").isin(*SENTINELS), F.lit(False)), kv)


def _steps(x: Column, steps, last: str) -> Column:
    """The label of the first limit that x is below."""
    out = None
    for limit, label in steps:
        out = F.when(x < limit, label) if out is None else out.when(x < limit, label)
    return out.otherwise(last)


# Classes and colours.
LINE_COLOURS = ((69, "#4CAF50"), (138, "#FF9800"), (230, "#2196F3"), (345, "#9C27B0"), (500, "#F44336"))
LINE_WIDTHS = {3: ((69, 0.5), (138, 0.8), (230, 1.0), (345, 1.2), (500, 1.5), (None, 2.0)), 8: ((69, 1.0), (138, 1.5), (230, 2.0), (345, 2.5), (500, 3.0), (None, 3.5))}
VOLTAGE_CLASSES = ((69, "Distribution"), (138, "Sub-transmission"), (230, "Regional Transmission"), (345, "High Voltage Transmission"), (500, "Extra High Voltage"))
EGS_CO2_F, EGS_WATER_F = 302.0, 392.0
SECTORS = (
    ("Power Plants", ("Power Plants",), "#F44336"),
    ("Petroleum/Natural Gas", ("Petroleum", "Natural Gas"), "#FF9800"),
    ("Waste", ("Waste",), "#795548"),
    ("Chemicals", ("Chemicals",), "#9C27B0"),
    ("Minerals", ("Minerals",), "#607D8B"),
    ("Metals", ("Metals",), "#455A64"),
)
SECTOR_SIZES = ((0, 5), (50_000, 7), (100_000, 9), (500_000, 12), (1_000_000, 15), (5_000_000, 20), (16_000_000, 28))
# The names under which parcels carry their id.
PARCEL_ID_NAMES = (
    "PARCEL_ID", "PARCEL", "ID", "TRACT_ID", "TRACT", "SECTION", "SEC", "TOWNSHIP", "RANGE", "LEGAL",
    "parcel_id", "parcel", "id", "tract_id", "tract",
)
BASEMENT_TYPES = {
    "BSMT1": "Felsic igneous/metamorphic", "BSMT2": "Intermediate igneous/metamorphic", "BSMT3": "Mafic igneous/metamorphic",
    "BSMT4": "Mixed/undifferentiated crystalline", "": "Unknown",
}
BEDROCK_TYPES = {
    "BEDRX3": "Consolidated sedimentary", "BEDRX4": "Crystalline (igneous/metamorphic)", "BEDRX5": "Mixed sedimentary/crystalline",
    "BEDRX6": "Volcanic", "": "Unknown",
}
US_NAMES = ("usa", "united states", "us", "united states of america", "u.s.", "u.s.a.")
MISSING_FIELDS = ("operator", "street_address", "city", "state", "latitude", "longitude", "square_footage", "facility_type", "power_capacity_mw", "miles_to_airport", "phone_number")


def voltage_class(kv) -> Column:
    k = _c(kv)
    return F.when(k.isNull() | (k == 0), "Unknown").otherwise(_steps(k, VOLTAGE_CLASSES, "Ultra High Voltage"))


def line_colour(kv) -> Column:
    """Grey without a voltage, else by the first limit that it is below, black beyond all."""
    return F.when(_c(kv).isNull(), "#999999").otherwise(_steps(_c(kv), LINE_COLOURS, "#000000"))


def line_width(kv, zoom: float) -> Column:
    """Width by voltage, linear between the widths at two zooms; without a voltage as the lowest class."""
    k = F.coalesce(_c(kv), F.lit(0.0))
    (z0, low), (z1, high) = LINE_WIDTHS.items()
    at = lambda steps: _steps(k, [(limit, F.lit(w)) for limit, w in steps[:-1]], F.lit(steps[-1][1]))
    share = min(1.0, max(0.0, (zoom - z0) / (z1 - z0)))
    return at(low) + (at(high) - at(low)) * share


def egs_zone(t) -> Column:
    """Which working fluids a temperature in Fahrenheit allows."""
    return F.when(_c(t).isNull(), None).otherwise(_steps(_c(t), ((EGS_CO2_F, "none"), (EGS_WATER_F, "co2")), "both"))


def temperature_band(t, limits=(180, 220, 260, 300)) -> Column:
    """The number of limits that a temperature reaches."""
    return sum((F.when(_c(t) >= v, 1).otherwise(0) for v in limits[1:]), F.when(_c(t) >= limits[0], 1).otherwise(0))


def geology_quality(depth, kind) -> Column:
    """F, M or U by basement depth in metres; mafic rock is always U."""
    return F.when(F.contains(F.lower(F.coalesce(_c(kind), F.lit(""))), F.lit("mafic")), "U").otherwise(_steps(_c(depth), ((3000, "F"), (6000, "M")), "U"))


def described(code, names: dict[str, str]) -> Column:
    """The description of a code, or the code."""
    pairs = [F.lit(v) for kv in names.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(code)), _c(code)) if pairs else _c(code)


def thickness(surface, bottom) -> Column:
    """Difference of two elevations, rounded half to even."""
    return F.bround(_c(surface) - _c(bottom), 0)


def sector_category(sector) -> Column:
    s, out = F.coalesce(_c(sector), F.lit("")), None
    for name, words, _ in SECTORS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(s, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Other")


def sector_colour(sector, emissions) -> Column:
    named = F.create_map(*[F.lit(v) for n, _, c in SECTORS for v in (n, c)])
    return F.when(F.coalesce(_c(emissions), F.lit(0)) == 0, "#888888").otherwise(F.coalesce(F.try_element_at(named, sector_category(sector)), F.lit("#9E9E9E")))


def interpolate(x, stops=SECTOR_SIZES) -> Column:
    """Piecewise linear between (input, output) stops, constant beyond them."""
    v = F.coalesce(_c(x).cast("double"), F.lit(0.0))
    out = F.when(v <= stops[0][0], F.lit(float(stops[0][1])))
    for (a, p), (b, q) in zip(stops, stops[1:]):
        out = out.when(v <= b, p + (v - a) / (b - a) * (q - p))
    return out.otherwise(F.lit(float(stops[-1][1])))


def is_us_country(country) -> Column:
    return F.lower(_c(country)).isin(*US_NAMES)


def missing_fields(fields=MISSING_FIELDS, columns: dict[str, str] | None = None) -> Column:
    """Names of the fields that are null or empty. columns: field -> column name where they differ."""
    col = lambda f: F.col((columns or {}).get(f, f)).cast("string")
    return F.array_compact(F.array(*[F.when(col(f).isNull() | (col(f) == ""), F.lit(f)) for f in fields]))


def id_of_url(url) -> Column:
    return F.substring(F.sha2(_c(url), 256), 1, 16)


def table_name(name) -> Column:
    """A safe lower-case identifier."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(name)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def file_size(n) -> Column:
    b = _c(n).cast("double")
    unit = F.when(b < 1024, F.lit(0)).when(b < 1024**2, 1).when(b < 1024**3, 2).otherwise(3)
    return F.concat(F.format_string("%.1f", b / F.pow(F.lit(1024.0), unit)), F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), unit + 1))


def duration(ms) -> Column:
    s = F.floor(_c(ms) / 1000)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s % 60)).when(m > 0, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def point_errors(lat="latitude", lon="longitude") -> Column:
    """What makes a reading invalid."""
    a, o = _c(lat), _c(lon)
    return F.array_compact(F.array(
        F.when(a.isNull() | F.isnan(a), "Invalid or missing latitude").when(~a.between(-90, 90), "Latitude out of range"),
        F.when(o.isNull() | F.isnan(o), "Invalid or missing longitude").when(~o.between(-180, 180), "Longitude out of range"),
    ))


def point_warnings(lat="latitude", lon="longitude", depth="depth_m", temp="temperature_f") -> Column:
    """What looks odd in a reading."""
    return F.array_compact(F.array(
        F.when(_c(depth) < 0, "Negative depth value").when(_c(depth) > 15000, "Very deep measurement"),
        F.when(~_c(temp).between(-100, 1000), "Temperature out of reasonable range"),
        F.when(~in_us(lat, lon), "Coordinates outside US bounds"),
    ))


def line_errors(kind, coordinates) -> Column:
    """What makes a line feature invalid; checked in turn."""
    return F.when(_c(kind).isNull(), "Missing geometry").when(~_c(kind).isin("LineString", "MultiLineString"), "Unsupported geometry type").when(_c(coordinates).isNull(), "Invalid geometry coordinates")


def pick_parcel_id(props, names, index) -> Column:
    """The first non-empty of the named properties of a map, else the number after index, zero-padded."""
    tries = [F.nullif(F.trim(F.try_element_at(_c(props), F.lit(n))), F.lit("")) for n in names]
    number = (_c(index) + 1).cast("string")
    return F.coalesce(*tries, F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0")))


def other_props(props, standard) -> Column:
    """A map without its standard keys."""
    return F.map_filter(_c(props), lambda k, _: ~k.isin(*standard))


def active_flags(flags) -> Column:
    """Names of the flags of a map<string, boolean> that are on."""
    return F.map_keys(F.map_filter(_c(flags), lambda _, v: v))
