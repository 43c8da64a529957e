"""Time zones of positions: polygons of a file, or a table of boxes; sea zones elsewhere.

``BOXES`` follow borders roughly; most of their faults lie between zones that
keep the same time.  Where borders matter, callers read the polygons of a
GeoJSON file (a feature for each zone, ``tzid`` its name) with ``polygons``
and look positions up in them with ``lookup``, as the loaders do when their
configuration names such a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Zone: boxes (south, north, west, east); the first box that holds a position counts.
BOXES = {
    "Pacific/Honolulu": [(18.5, 22.5, -161, -154.5)],
    "America/Anchorage": [(54.7, 72, -170, -141), (54.7, 60.2, -141, -130)],
    "America/Tijuana": [(32.3, 32.6, -117.2, -114.7), (28, 32.5, -116.9, -114.7)],
    "America/Vancouver": [(49, 60, -139.1, -120), (48.3, 49, -123.9, -123.2), (49, 52, -120, -116)],
    "America/Los_Angeles": [(32.5, 49, -124.8, -117.04), (35, 42, -117.04, -114.05), (32.5, 35, -117.04, -114.5), (45.5, 49, -117.04, -116.05)],
    "America/Boise": [(42, 45.5, -117.04, -111.05)],
    "America/Phoenix": [(31.3, 37, -114.82, -109.05)],
    "America/Hermosillo": [(26.4, 31.3, -112.8, -108.7)],
    "America/Mazatlan": [(22.8, 28, -115.1, -109.4), (22.4, 26.4, -109.4, -105)],
    "America/Edmonton": [(49, 60, -120, -110)],
    "America/Regina": [(49, 60, -110, -101.4)],
    "America/Winnipeg": [(49, 60, -101.4, -90)],
    "America/Denver": [(31.3, 49, -114.1, -102.05)],
    "America/Toronto": [(43.2, 56, -90, -79), (45.01, 56, -79, -69.2)],
    "America/Halifax": [(43.3, 48.1, -67.8, -59.6)],
    "America/St_Johns": [(46.5, 52, -59.5, -52.5)],
    "America/Mexico_City": [(17.9, 25.8, -106, -86.7), (15.9, 17.9, -106, -92.3)],
    "America/Chicago": [(25.8, 49.4, -102.05, -86.8)],
    "America/New_York": [(24.4, 47.5, -86.8, -66.9)],
    "America/Havana": [(19.8, 23.3, -85, -74.1)],
    "America/Jamaica": [(17.6, 18.6, -78.4, -76.1)],
    "America/Santo_Domingo": [(17.4, 20, -71.7, -68.2)],
    "America/Puerto_Rico": [(17.6, 18.6, -68, -65.1)],
    "America/Guatemala": [(13.2, 17.9, -92.3, -87.7)],
    "America/Tegucigalpa": [(11, 16.1, -87.7, -83)],
    "America/Costa_Rica": [(8.3, 11, -86, -82.8)],
    "America/Panama": [(7.1, 9.7, -83, -77.5)],
    "America/Caracas": [(7, 12.3, -72.3, -59.8), (0.6, 7, -67.3, -60)],
    "America/Guayaquil": [(-5, 1.2, -81.1, -77.5)],
    "America/Bogota": [(-4.3, 12.5, -79.1, -66.9)],
    "America/La_Paz": [(-22.9, -9.7, -69, -60)],
    "America/Lima": [(-18.4, -0.1, -81.4, -69)],
    "America/Santiago": [(-56, -17.5, -75.7, -70.2), (-33, -18, -70.2, -68.6)],
    "America/Asuncion": [(-27.4, -19.3, -62, -54.6)],
    "America/Montevideo": [(-35, -30.2, -58, -53.6)],
    "America/Argentina/Buenos_Aires": [(-55.1, -21.8, -73.6, -53.7)],
    "America/Manaus": [(-24, 5.3, -70, -56)],
    "America/Sao_Paulo": [(-33.8, 5.3, -56, -34.7)],
    "Atlantic/Reykjavik": [(63.2, 66.6, -24.6, -13.4)],
    "Atlantic/Azores": [(36.8, 39.8, -31.4, -24.9)],
    "Atlantic/Canary": [(27.5, 29.5, -18.3, -13.3)],
    "Europe/Lisbon": [(36.9, 41.9, -9.6, -7.1), (41.9, 42.1, -8.8, -8.2), (32.3, 33.2, -17.4, -16.2)],
    "Europe/Madrid": [(36, 42.5, -7.5, 3.4), (41.8, 43.9, -9.4, -1.8), (38.5, 40.2, 1.1, 4.4)],
    "Europe/Dublin": [(51.3, 54.2, -10.7, -5.9), (54.2, 55.4, -10.7, -8.2)],
    "Europe/Paris": [(42.3, 49.9, -4.9, 6), (49.9, 51.05, 1.42, 2.6), (48.2, 49.2, 6, 7.7), (41.3, 43.1, 8.5, 9.6)],
    "Europe/London": [(49.9, 60.9, -8.2, 1.8)],
    "Europe/Brussels": [(49.5, 51.45, 2.5, 6.1)],
    "Europe/Amsterdam": [(51.2, 53.6, 3.3, 7.1)],
    "Europe/Zurich": [(45.9, 47.6, 6, 9.6)],
    "Europe/Copenhagen": [(54.8, 57.8, 8, 12.7)],
    "Europe/Berlin": [(47.5, 54.9, 6, 12.2), (50.9, 54.9, 12.2, 14.6)],
    "Europe/Prague": [(48.8, 51, 12.2, 18.5)],
    "Europe/Vienna": [(46.5, 48.8, 9.6, 17)],
    "Europe/Rome": [(43.6, 47, 6.6, 13.6), (36.6, 43.6, 8, 18.6)],
    "Europe/Oslo": [(57.9, 64, 4.5, 11.6), (64, 71.3, 10, 16)],
    "Europe/Stockholm": [(55.3, 64, 11.6, 19.4), (64, 69.1, 16, 23.7)],
    "Europe/Helsinki": [(59.7, 65.8, 19.4, 30.2), (65.8, 70.1, 23.7, 29.6)],
    "Europe/Warsaw": [(49, 54.9, 14.1, 23.6)],
    "Europe/Tallinn": [(57.6, 59.7, 21.8, 28.1)],
    "Europe/Riga": [(55.7, 58.1, 20.9, 28.1)],
    "Europe/Vilnius": [(53.9, 56.4, 20.9, 26.3)],
    "Europe/Minsk": [(51.5, 56.1, 23.6, 31.5)],
    "Europe/Budapest": [(45.8, 48.6, 16.1, 22)],
    "Europe/Belgrade": [(40.9, 46.5, 13.4, 22.4)],
    "Europe/Athens": [(34.8, 41.7, 19.4, 26.6), (34.8, 37, 26.6, 28.3)],
    "Europe/Sofia": [(41.3, 43.9, 22.4, 28.7)],
    "Europe/Bucharest": [(43.6, 48.2, 20.3, 29.8)],
    "Europe/Istanbul": [(36, 42.1, 26, 44.5)],
    "Asia/Nicosia": [(34.5, 35.7, 32.2, 34.6)],
    "Europe/Kyiv": [(44.4, 52.3, 22.2, 39.2)],
    "Europe/Moscow": [(43, 70, 27.4, 47), (47, 70, 47, 51)],
    "Asia/Tbilisi": [(41.1, 43.5, 40, 46.4)],
    "Asia/Yerevan": [(38.9, 41.3, 43.5, 46)],
    "Asia/Baku": [(38.4, 41.9, 46, 50.4)],
    "Asia/Jerusalem": [(29.5, 33.1, 34.2, 35.5)],
    "Asia/Beirut": [(33.1, 34.7, 35.1, 36.4)],
    "Asia/Amman": [(29.2, 32.7, 35.5, 38.5)],
    "Asia/Damascus": [(32.5, 37.1, 35.7, 41.5)],
    "Asia/Baghdad": [(31, 37.1, 39, 45.8), (29.1, 31, 44, 48.2)],
    "Asia/Dubai": [(22.6, 26.4, 51.5, 56.4), (16.7, 24.9, 55.7, 59.9)],
    "Asia/Riyadh": [(12.6, 32.2, 35, 55.7)],
    "Asia/Tehran": [(25, 39.7, 44, 61)],
    "Asia/Kabul": [(31.5, 38, 60.8, 70.3)],
    "Asia/Karachi": [(23.7, 29.5, 61, 70.5), (29.5, 36.9, 61, 74.5)],
    "Asia/Kathmandu": [(27.4, 30.3, 81, 88.1), (26.4, 27.4, 85, 88.1)],
    "Asia/Dhaka": [(21, 26.2, 88.9, 91.2), (20.7, 24.9, 91.2, 92.4)],
    "Asia/Colombo": [(5.9, 9.9, 79.6, 82)],
    "Asia/Kolkata": [(8, 35.5, 68.1, 89), (21.9, 29.4, 89, 96)],
    "Asia/Tashkent": [(37.2, 45.5, 56, 71)],
    "Asia/Almaty": [(40.6, 53.5, 51, 82)],
    "Asia/Yekaterinburg": [(51, 70, 51, 71)],
    "Asia/Omsk": [(53.5, 58, 71, 75)],
    "Asia/Novosibirsk": [(53.2, 66, 75, 90)],
    "Asia/Krasnoyarsk": [(50, 74, 82, 100)],
    "Asia/Ulaanbaatar": [(42, 50.2, 89, 119)],
    "Asia/Irkutsk": [(50.2, 64, 100, 114)],
    "Asia/Yangon": [(10, 28, 92.4, 98)],
    "Asia/Ho_Chi_Minh": [(8.4, 11.5, 104.4, 109.5), (11.5, 21, 107.4, 109.5), (18, 22.8, 103, 107.4)],
    "Asia/Bangkok": [(6.4, 20.5, 97.3, 107.4)],
    "Asia/Singapore": [(1.15, 1.48, 103.6, 104.1)],
    "Asia/Kuala_Lumpur": [(1.2, 6.8, 100, 104.5), (0.9, 7.4, 109.5, 119.3)],
    "Asia/Jakarta": [(-8.9, 6, 95, 114.5)],
    "Asia/Makassar": [(-11, 4, 114.5, 125)],
    "Asia/Jayapura": [(-9.2, 1, 125, 141)],
    "Asia/Manila": [(4.6, 21.2, 116.9, 126.7)],
    "Asia/Taipei": [(21.8, 25.4, 119.9, 122.1)],
    "Asia/Hong_Kong": [(22.1, 22.55, 113.8, 114.5)],
    "Asia/Seoul": [(33, 38.6, 125, 129.7)],
    "Asia/Pyongyang": [(38.6, 42.4, 124.4, 130.7)],
    "Asia/Tokyo": [(30, 45.6, 129.7, 146), (24, 30, 122.9, 131.4)],
    "Asia/Vladivostok": [(42.4, 60, 131, 141)],
    "Asia/Yakutsk": [(50, 72, 114, 140)],
    "Asia/Shanghai": [(18.1, 53.6, 73.5, 135)],
    "Australia/Perth": [(-35.2, -13.5, 112.9, 129)],
    "Australia/Darwin": [(-26, -10.9, 129, 138)],
    "Australia/Adelaide": [(-38.1, -26, 129, 141)],
    "Australia/Brisbane": [(-28.2, -9.9, 138, 153.6)],
    "Australia/Hobart": [(-43.7, -39.5, 143.8, 148.5)],
    "Australia/Melbourne": [(-39.2, -36, 141, 150)],
    "Australia/Sydney": [(-37.6, -28.2, 141, 153.7)],
    "Pacific/Auckland": [(-47.4, -34.3, 166.3, 178.7)],
    "Africa/Casablanca": [(27.6, 36, -13.2, -2)],
    "Africa/Algiers": [(19, 37.2, -8.7, 8.3)],
    "Africa/Tunis": [(30.2, 37.4, 8.3, 11.6)],
    "Africa/Tripoli": [(20, 33.2, 9.4, 25)],
    "Africa/Cairo": [(22, 31.7, 25, 35)],
    "Africa/Abidjan": [(4.3, 25, -17.6, 1.2)],
    "Africa/Lagos": [(4.2, 13.9, 1.2, 14.7)],
    "Africa/Khartoum": [(8.7, 22, 21.8, 36.5)],
    "Africa/Addis_Ababa": [(3.5, 14.9, 33, 48)],
    "Africa/Nairobi": [(-4.8, 5, 33.9, 41.9)],
    "Africa/Dar_es_Salaam": [(-11.7, -1, 30.9, 40.5)],
    "Africa/Kinshasa": [(-18, 5, 11.6, 24)],
    "Africa/Windhoek": [(-29, -17, 11.7, 20)],
    "Africa/Johannesburg": [(-34.9, -22.2, 16.4, 31.3)],
    "Africa/Maputo": [(-29, 5, 20, 40.9)],
}
#: Degrees of a grid cell of ``lookup``.
CELL = 2.0
Boxes = dict[str, list[tuple[float, float, float, float]]]


def _sea(lon: Column) -> Column:
    hours = F.round(lon / 15).cast("int")
    return F.concat(F.lit("Etc/GMT"), F.when(hours == 0, F.lit("")).when(hours > 0, F.concat(F.lit("-"), hours.cast("string"))).otherwise(F.concat(F.lit("+"), (-hours).cast("string"))))


def zone(lat: Column, lon: Column, boxes: Boxes = BOXES) -> Column:
    """The zone's name; null without a position."""
    inside = [(F.lit(name), reduce(lambda a, b: a | b, [lat.between(s, n) & lon.between(w, e) for s, n, w, e in found])) for name, found in boxes.items()]
    first = F.coalesce(*[F.when(held, name) for name, held in inside], _sea(lon))
    return F.when(lat.isNotNull() & lon.isNotNull(), first)


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """(zone, rings) from GeoJSON files: a row for each polygon, whose first ring is its border and whose others are holes."""
    feature = "struct<properties:struct<tzid:string>,geometry:struct<type:string,coordinates:string>>"
    found = spark.read.schema(f"features array<{feature}>").json(path, multiLine=True)
    f = found.select(F.explode("features").alias("f")).select(F.col("f.properties.tzid").alias("zone"), "f.geometry.type", "f.geometry.coordinates")
    ring = "array<array<array<double>>>"
    many = F.when(F.col("type") == "MultiPolygon", F.from_json("coordinates", f"array<{ring}>")).otherwise(F.array(F.from_json("coordinates", ring)))
    return f.select("zone", F.explode(many).alias("rings"))


def lookup(points: DataFrame, key: str, lat: str, lon: str, shapes: DataFrame) -> DataFrame:
    """(key, zone) of points: the first zone by name whose polygon holds the point, else the sea zone.

    Polygons meet points in grid cells that their boxes touch, and bring to a
    cell only the edges at its latitudes; a point lies inside where a line to
    its east crosses an odd number of them.
    """

    def axis(k: int) -> Column:
        return F.transform(F.col("rings")[0], lambda p: p[k])

    def edges(r: Column) -> Column:
        return F.arrays_zip(r.alias("p"), F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)).alias("q"))

    def at_row(e: Column) -> Column:
        return (F.greatest(e.p[1], e.q[1]) >= F.col("cy") * CELL) & (F.least(e.p[1], e.q[1]) <= (F.col("cy") + 1) * CELL)

    def crossed(e: Column) -> Column:
        sides = (e.p[1] > F.col("__y")) != (e.q[1] > F.col("__y"))
        return sides & (F.col("__x") < e.p[0] + (e.q[0] - e.p[0]) * F.try_divide(F.col("__y") - e.p[1], e.q[1] - e.p[1]))

    box = shapes.select("zone", F.flatten(F.transform("rings", edges)).alias("edges"), *[F.floor(f(axis(k)) / CELL).alias(n) for n, f, k in (("w", F.array_min, 0), ("e", F.array_max, 0), ("s", F.array_min, 1), ("n", F.array_max, 1))])
    rows = box.select("zone", "edges", "w", "e", F.explode(F.sequence("s", "n")).alias("cy")).withColumn("edges", F.filter("edges", at_row))
    cells = rows.select("zone", "edges", "cy", F.explode(F.sequence("w", "e")).alias("cx"))
    pts = points.select(key, F.col(lat).alias("__y"), F.col(lon).alias("__x"))
    placed = pts.withColumn("cy", F.floor(F.col("__y") / CELL)).withColumn("cx", F.floor(F.col("__x") / CELL))
    odd = F.size(F.filter("edges", crossed)) % 2 == 1
    found = placed.join(cells, ["cy", "cx"]).where(odd).groupBy(key).agg(F.min("zone").alias("zone"))
    return pts.join(found, key, "left").select(key, F.when(F.col("__y").isNotNull() & F.col("__x").isNotNull(), F.coalesce("zone", _sea(F.col("__x")))).alias("zone"))
