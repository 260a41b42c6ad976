"""Record shapes (PRJ-6, survey 1.4). Column names, and the order of kinds of dates."""

from __future__ import annotations

MEMBERSHIP = "page_id long, category string, hop int"
DATES = ("point_in_time", "start_time", "birth_date", "inception", "end_time", "death_date", "dissolved")
CITIES = (
    "geoname_id long, name string, latitude double, longitude double, country_code string, country_name string, admin1_code string, admin1_name string, "
    "population long, alternate_names array<string>"
)
CACHE = "geoname_id long, version string, payload string"
CARD = (
    "page_id bigint, title string, first_paragraph string, entity_class string, year bigint, country string, latitude double, longitude double, "
    "distance_km double, score double, source string, match_reason string"
)
LOCATION = "label string, latitude double, longitude double"
_as_type = lambda columns: "struct<" + columns.replace(", ", ",").replace(" ", ":") + ">"
RESPONSE = f"struct<query:{_as_type(LOCATION)},mapped:array<{_as_type(CARD)}>,connected:array<{_as_type(CARD)}>,counts:struct<mapped:bigint,connected:bigint>>"
