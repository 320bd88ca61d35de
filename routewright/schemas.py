"""Table schemas as DDL text."""

from __future__ import annotations

TILE = (
    "title string, image_url string, thumbnail_url string, category string, page_url string, scraped_at string"
)

# Columns a fresh index run writes; the rest of a catalogue row belongs to later enrichment jobs.
CATALOGUE = (
    "id long, title string, category string, subcategory string, city string, country string, lat double, lon double,"
    "geocode_confidence double, geocode_source string, ocr_streets string, ocr_attempted_at string, image_url string,"
    "page_url string, distance_estimate_km double, scraped_at string, gpx_path string,"
    "reconstruction_confidence double, reconstruction_attempted_at string, reconstruction_failure string"
)

CATALOGUE_COLUMNS = [column.split()[0] for column in CATALOGUE.split(",")]

# Columns added to older catalogue tables, with the default old rows get.
ADDITIVE_COLUMNS = [
    ("geocode_source", "string", "title"),
    ("ocr_streets", "string", None),
    ("ocr_attempted_at", "string", None),
    ("gpx_path", "string", None),
    ("reconstruction_confidence", "double", None),
    ("reconstruction_attempted_at", "string", None),
    ("reconstruction_failure", "string", None),
]

PLACE_HIT = "struct<lat:double,lon:double,display_name:string,country:string,raw_query:string>"
PLACE_CACHE = f"hits map<string,{PLACE_HIT}>, negatives array<string>"

STREET_HIT = "struct<name:string,lat:double,lon:double,city:string,country:string>"
STREET_CACHE = f"hits map<string,array<{STREET_HIT}>>, negatives array<string>"

ROUTE_RESPONSE = (
    "code string, message string,"
    "routes array<struct<geometry:struct<coordinates:array<array<double>>>,distance:double,duration:double>>"
)

PLACE_RESPONSE = (
    "array<struct<lat:string,lon:string,display_name:string,"
    "address:struct<city:string,town:string,village:string,suburb:string,municipality:string,country:string>>>"
)

WAYS = "array<struct<type:string,tags:map<string,string>,center:struct<lat:double,lon:double>>>"
WAY_RESPONSE = f"remark string, elements {WAYS}"

GPX_ROUTE = "name string, rtept array<struct<_lat:double,_lon:double>>"
GPX_SEGMENT = "trkpt array<struct<_lat:double,_lon:double>>"
KML_LINE = "coordinates string"

REQUEST = (
    "request_id long, shape string, lat double, lon double, distance_km double, waypoints int, iterations int,"
    "search_radius_km double, candidates int, scales int"
)
