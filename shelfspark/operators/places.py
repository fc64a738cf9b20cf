"""Reverse geocoding: nearest populated places by a join over cells of latitude and longitude."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shelfspark.functions.media import distance_km
from shelfspark.session import stored

from .rank import ranked

#: Units of a degree in which places are given; kilometres of a degree of latitude, rounded down.
SCALE, KM = 10_000, 111.19
CITY_KM, COUNTRY_KM, WARD_KM = 25.0, 300.0, 10.0
COUNTRY_STEPS_KM = (CITY_KM, 75.0, COUNTRY_KM)


def valid_position(lat: Column, lon: Column) -> Column:
    """Within range and not the null island."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((F.abs(lat) < 1e-6) & (F.abs(lon) < 1e-6)), F.lit(False))


def _near(photos: DataFrame, places: DataFrame, radius: float) -> DataFrame:
    """Photos (photo_id, lat, lon) with each place within the radius and its distance.

    Bands of latitude as high as the radius are cut into cells as wide as it is where the band is nearest to a pole; band and cell are
    the join key, so a photo meets nine of them only.
    """
    high = int(radius / KM * SCALE) + 2
    around = lambda c: F.sequence(c - 1, c + 1)
    # the mean latitude of a photo and a place in the band is at most a band beyond its edge
    edge = F.least(F.lit(90.0), (F.greatest(F.abs("band"), F.abs(F.col("band") + 1)) + 1) * F.lit(high / SCALE))
    width = F.least(F.lit(7_200_000.0), F.ceil(F.lit(float(high)) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-6))) + 2).cast("long")
    p = photos.withColumn("band", F.explode(around(F.floor(F.col("lat") * SCALE / high))))
    p = p.withColumn("cell", F.explode(around(F.floor(F.col("lon") * SCALE / width))))
    q = places.withColumn("band", F.floor(F.col("lat_e4") / high)).withColumn("cell", F.floor(F.col("lon_e4") / width))
    km = distance_km(F.col("lat"), F.col("lon"), F.col("lat_e4") / F.lit(float(SCALE)), F.col("lon_e4") / F.lit(float(SCALE)))
    return p.join(q, ["band", "cell"]).withColumn("km", km).where(F.col("km") <= radius)


def _placed(photos: DataFrame) -> DataFrame:
    return photos.where(valid_position(F.col("lat"), F.col("lon"))).select(F.col("id").alias("photo_id"), "lat", "lon")


def cities_of(photos: DataFrame, cities: DataFrame) -> DataFrame:
    """For each photo with a place in reach: (photo_id, city_id, city, admin1, country).

    The city is the most populous within 25 km (ties: nearer, then lower latitude, then id); beyond that, up to 300 km, the
    nearest place tells the country only. An index of -1 is null. Only photos with nothing within a radius are looked up in the next.
    """
    rank = F.struct(-F.col("pop_k"), "km", "lat_e4", "id")
    facts = F.struct("id", "name", F.nullif("admin1", F.lit(-1)).alias("admin1"), "country")
    left, found = _placed(photos), []
    for radius in COUNTRY_STEPS_KM:
        best = _near(left, cities, radius).groupBy("photo_id").agg(
            F.min_by(F.when(F.col("km") <= CITY_KM, facts), F.when(F.col("km") <= CITY_KM, rank)).alias("c"),
            F.min_by("country", F.struct("km", "lat_e4", "id")).alias("far"),
        )
        found.append(stored(best))
        if radius < COUNTRY_KM:
            left = stored(left.join(found[-1], "photo_id", "left_anti"))
    best = reduce(DataFrame.unionByName, found)
    return best.select("photo_id", F.col("c.id").alias("city_id"), F.col("c.name").alias("city"), F.col("c.admin1").alias("admin1"), F.coalesce("c.country", "far").alias("country"))


def wards_of(photos: DataFrame, wards: DataFrame) -> DataFrame:
    """For each photo within 10 km of a ward, the nearest: (photo_id, ward, district)."""
    near = _near(_placed(photos), wards, WARD_KM).groupBy("photo_id").agg(F.min_by(F.struct("name", F.nullif("district", F.lit(-1)).alias("district")), F.struct("km", "lat_e4", "id")).alias("w"))
    return near.select("photo_id", F.col("w.name").alias("ward"), F.col("w.district").alias("district"))


def lookup(photos: DataFrame, cities: DataFrame, wards: DataFrame) -> DataFrame:
    """A row for each photo; null where nothing is near or the position is none."""
    d = photos.select(F.col("id").alias("photo_id"))
    return d.join(cities_of(photos, cities), "photo_id", "left").join(wards_of(photos, wards), "photo_id", "left")


def named(found: DataFrame, countries: DataFrame, admin1: DataFrame, districts: DataFrame) -> DataFrame:
    """``lookup`` with the names behind its indexes (index, name): country_name, province and district_name, null where there is none."""
    d = found
    for key, names, out in (("country", countries, "country_name"), ("admin1", admin1, "province"), ("district", districts, "district_name")):
        d = d.join(names.select(F.col("index").cast("int").alias(key), F.col("name").alias(out)), key, "left")
    return d


def read_places(spark, path: str) -> dict[str, DataFrame]:
    """The five sections of a place file as DataFrames; rows of too few fields are skipped.

    The file is parted at ``#SECTION`` lines; line numbers come from the one text file, whose size is that of a gazetteer.
    """
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "(?m)^#")).alias("k", "part"))
    text = text.select(F.regexp_extract("part", r"^([A-Z0-9]+)", 1).alias("section"), F.posexplode(F.split("part", r"\r?\n")).alias("pos", "line")).where("pos > 0 and line <> ''")
    f = F.split("line", "\t")

    def names(section: str) -> DataFrame:
        return text.where(F.col("section") == section).select((F.col("pos") - 1).alias("index"), "line").withColumnRenamed("line", "name")

    def points(section: str, rest: tuple[str, ...]) -> DataFrame:
        cols = ["lat_e4", "lon_e4", "name", *rest]
        d = text.where(F.col("section") == section).where(F.size(f) >= len(cols)).select("pos", *(f[i].alias(c) for i, c in enumerate(cols)))
        d = d.select(F.col("pos").cast("long").alias("id"), *(F.col(c) if c == "name" else F.col(c).try_cast("int").alias(c) for c in cols))
        return d.where("lat_e4 is not null and lon_e4 is not null")

    return {"countries": names("COUNTRIES"), "admin1": names("ADMIN1"), "districts": names("DISTRICTS"), "cities": points("CITIES", ("country", "admin1", "pop_k")), "fine": points("FINE", ("district",))}


def _composed(c: Column | str) -> Column:
    """Composed letters, white space collapsed; the rows are those of a gazetteer."""

    @F.pandas_udf(StringType())
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFC", x).split()))

    return run(c)


def build_places(countries: DataFrame, admin1: DataFrame, cities: DataFrame, fine: DataFrame, alternate: DataFrame, manual: DataFrame, langs: dict[str, str]) -> dict[str, DataFrame]:
    """The five tables of a place file from raw gazetteer tables.

    countries (code, name), admin1 (code, name, geo_id), cities (geo_id, name, lat, lon, country, admin1, population), fine (geo_id, level ADM2
    or ADM3, name, lat, lon, country, admin1, admin2), alternate (geo_id, country, lang, name, preferred), manual (code, name). A local name is the
    preferred one, else the first (by name) in the country's language of ``langs``; provinces take the manual name, else the local, else their own
    without an English suffix. Cities of unknown countries, without a name or a position are left out. Tables are in the order of latitude
    (then longitude and name), populations in thousands, positions in 1/10,000 degree; -1 is no province or district.
    """
    lang = F.create_map(*(F.lit(x) for kv in langs.items() for x in kv)) if langs else None
    alt = alternate.where(F.try_element_at(lang, F.col("country")) == F.col("lang")) if lang is not None else alternate.limit(0)
    alt = alt.where("trim(name) <> ''").groupBy("geo_id").agg(F.min(F.struct((~F.coalesce("preferred", F.lit(False))).alias("p"), "name")).alias("x")).select("geo_id", _composed("x.name").alias("local"))
    numbered = lambda d, *order: ranked(d, *order, name="index").withColumn("index", (F.col("index") - 1).cast("int"))
    c = stored(numbered(countries.where("code is not null").select("code", _composed("name").alias("name")), "code"))
    a = admin1.join(alt, "geo_id", "left").join(manual.select("code", F.col("name").alias("manual")), "code", "left")
    a = stored(numbered(a.select("code", F.coalesce("manual", "local", _bare_name(_composed("name"))).alias("name")), "code"))
    e4 = lambda x: F.round(F.col(x).try_cast("double") * SCALE).cast("int")
    ci = cities.join(alt, "geo_id", "left").join(c.select(F.col("code").alias("country"), F.col("index").alias("ci")), "country").join(a.select(F.col("code").alias("ac"), F.col("index").alias("ai")), F.concat_ws(".", "country", "admin1") == F.col("ac"), "left")
    ci = ci.select(e4("lat").alias("lat_e4"), e4("lon").alias("lon_e4"), F.coalesce("local", _composed("name")).alias("name"), F.col("ci").alias("country"), F.coalesce("ai", F.lit(-1)).alias("admin1"), F.floor(F.coalesce(F.col("population").try_cast("long"), F.lit(0)) / 1000).cast("int").alias("pop_k"))
    f = fine.where(F.col("country").isin(*langs) & (F.trim("name") != ""))
    d = stored(numbered(f.where("level = 'ADM2'").select("country", "admin1", "admin2", _composed("name").alias("name")), "country", "admin1", "admin2"))
    w = f.where("level = 'ADM3'").join(d.select("country", "admin1", "admin2", "index"), ["country", "admin1", "admin2"], "left")
    w = w.select(e4("lat").alias("lat_e4"), e4("lon").alias("lon_e4"), _composed("name").alias("name"), F.coalesce("index", F.lit(-1)).alias("district"))
    by_place = lambda x: ranked(x.where("lat_e4 is not null and lon_e4 is not null and name <> ''"), "lat_e4", "lon_e4", "name", name="id")
    return {"countries": c.select("index", "name"), "admin1": a.select("index", "name"), "districts": d.select("index", "name"), "cities": by_place(ci), "fine": by_place(w)}


def _bare_name(c: Column) -> Column:
    return F.regexp_replace(c, "(?<=\\S) (Province|Municipality|City|Prefecture|Region|County)$", "")


def local_name(manual: Column, local: Column, original: Column) -> Column:
    """The name to show: set by hand, else the local one, else the original without an English suffix; white space collapsed."""
    return F.trim(F.regexp_replace(F.coalesce(manual, local, _bare_name(original)), r"\s+", " "))
