"""Publisher locations."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirewright.functions.text import clean, key, let, title_case

#: Codes of the United States and of Canada, and cities with a known state or country.
US_STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "IA", "ID", "IL", "IN", "KS", "KY", "LA", "MA",
    "MD", "ME", "MI", "MN", "MO", "MS", "MT", "NC", "ND", "NE", "NH", "NJ", "NM", "NV", "NY", "OH", "OK", "OR", "PA",
    "RI", "SC", "SD", "TN", "TX", "UT", "VA", "VT", "WA", "WI", "WV", "WY", "DC",
)
CANADIAN_PROVINCES = (
    "AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT", "ALBERTA", "BRITISH COLUMBIA",
    "MANITOBA", "NEW BRUNSWICK", "NEWFOUNDLAND AND LABRADOR", "NOVA SCOTIA", "NORTHWEST TERRITORIES", "NUNAVUT",
    "ONTARIO", "PRINCE EDWARD ISLAND", "QUEBEC", "SASKATCHEWAN", "YUKON",
)
#: How a city may be written, its name, and its state where the writing tells it.
CITIES = (("new york n y", "New York", "NY"), ("new york", "New York", None), ("washington d c", "Washington", "DC"), ("washington", "Washington", None))
CITY_HINTS = {written: city for written, city, _ in CITIES}
STATE_HINTS = {written: state for written, _, state in CITIES if state}
#: Cities whose country is known.
CANADIAN_CITIES = ("toronto", "montreal", "ottawa", "vancouver")
FOREIGN_CITIES = {
    "abingdon": "United Kingdom",
    "london": "United Kingdom",
    "new delhi": "India",
    "mumbai": "India",
    "hong kong": "Hong Kong",
}


def _lookup(table: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), c)


def publisher_location(city: Column, province: Column) -> Column:
    """Struct of city, province, region and location; an explicit province goes before a hint."""
    city_key = key(F.replace(clean(city), F.lit("."), F.lit(" ")))
    typed = F.struct(clean(city).alias("text"), city_key.alias("key"), F.upper(key(province)).alias("state"))

    def named(t: Column) -> Column:
        state = F.coalesce(F.nullif(t["state"], F.lit("")), _lookup(STATE_HINTS, t["key"]), F.lit(""))
        name = F.coalesce(_lookup(CITY_HINTS, t["key"]), title_case(t["text"]))
        return F.struct(name.alias("name"), state.alias("state"), t["key"].alias("key"), _lookup(FOREIGN_CITIES, t["key"]).alias("country"))

    def located(n: Column) -> Column:
        region = (
            F.when(n["state"].isin(*US_STATES), F.lit("United States"))
            .when(n["state"].isin(*CANADIAN_PROVINCES) | n["key"].isin(*CANADIAN_CITIES), F.lit("Canada"))
            .when(n["country"].isNotNull(), F.concat(F.lit("Non-US/Canada: "), n["country"]))
            .when(n["name"] != "", F.lit("Unknown/Needs Review"))
            .otherwise(F.lit("Missing publisher location"))
        )
        location = F.when(n["state"] != "", F.concat(n["name"], F.lit(", "), n["state"])).otherwise(n["name"])
        return F.struct(n["name"].alias("city"), n["state"].alias("province"), region.alias("region"), location.alias("location"))

    return let(let(typed, named), located)
