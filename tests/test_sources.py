import gzip
from datetime import date, datetime, timedelta
from functools import partial

import builders as B
import pytest
from pyspark.sql import functions as F

from waymark import api
from waymark.functions import zones
from waymark.sources import tables, tracks
from waymark.sources.store import Store


def test_decoders():
    rows = tracks.parse("a.fit", B.fit())
    assert [r[4] for r in rows] == [100, 101, 102, 103, 104] and rows[0][0] == B.BEGIN and rows[1][5] is None and rows[2][5] == 202
    assert tracks.parse("a.fit.gz", gzip.compress(B.fit())) == rows
    pts = B.line(B.MILL, B.QUAY, 5)
    got = tracks.parse("r.gpx", B.gpx(pts, hr=[90] * 5, power=[150] * 5))
    assert got[0][:3] == (B.BEGIN, *B.MILL) and got[0][4:] == (90, 150) and got[-1][3] == pytest.approx(5.025, abs=0.02)
    assert [r[3] for r in tracks.parse("t.TCX", B.tcx(pts))] == pytest.approx([0, 0.1, 0.2, 0.3, 0.4])
    with pytest.raises(ValueError):
        tracks.parse("x.txt", b"")


def test_zones(spark):
    places = {
        "America/Los_Angeles": (37.7, -122.4), "America/New_York": (40.7, -74.0), "America/Vancouver": (49.28, -123.12), "America/Phoenix": (33.45, -112.07), "America/Denver": (39.74, -104.99), "America/Chicago": (41.88, -87.63),
        "America/Toronto": (43.65, -79.38), "America/Halifax": (44.65, -63.57), "America/Mexico_City": (19.43, -99.13), "America/Sao_Paulo": (-23.55, -46.63), "America/Argentina/Buenos_Aires": (-34.6, -58.38), "America/Santiago": (-33.45, -70.67),
        "America/Bogota": (4.71, -74.07), "America/Lima": (-12.05, -77.04), "Europe/Lisbon": (38.72, -9.14), "Europe/Madrid": (40.42, -3.7), "Europe/Rome": (41.9, 12.5), "Europe/Stockholm": (59.33, 18.07), "Europe/Berlin": (52.52, 13.4),
        "Europe/Paris": (48.86, 2.35), "Europe/London": (51.5, -0.13), "Europe/Dublin": (53.35, -6.26), "Europe/Helsinki": (60.17, 24.94), "Europe/Athens": (37.98, 23.73), "Europe/Kyiv": (50.45, 30.52), "Europe/Moscow": (55.75, 37.62),
        "Europe/Istanbul": (41.01, 28.98), "Asia/Kolkata": (28.61, 77.21), "Asia/Karachi": (24.86, 67.0), "Asia/Kathmandu": (27.72, 85.32), "Asia/Shanghai": (39.9, 116.4), "Asia/Tokyo": (35.68, 139.69), "Asia/Seoul": (37.57, 126.98),
        "Asia/Singapore": (1.3, 103.85), "Asia/Bangkok": (13.75, 100.5), "Asia/Dubai": (25.2, 55.27), "Asia/Tehran": (35.69, 51.39), "Australia/Sydney": (-33.87, 151.21), "Australia/Perth": (-31.95, 115.86), "Australia/Adelaide": (-34.93, 138.6),
        "Pacific/Auckland": (-36.85, 174.76), "Africa/Cairo": (30.04, 31.24), "Africa/Johannesburg": (-26.2, 28.05), "Africa/Lagos": (6.52, 3.38), "Africa/Nairobi": (-1.29, 36.82), "Etc/GMT+2": (0.0, -30.0),
    }
    df = spark.createDataFrame([(k, *v) for k, v in places.items()] + [(None, None, 1.0)], "name string, lat double, lon double")
    got = df.select("name", zones.zone(F.col("lat"), F.col("lon")).alias("zone")).collect()
    assert [r for r in got if r.name != r.zone] == []
    from zoneinfo import ZoneInfo

    assert all(ZoneInfo(z) for z in zones.BOXES)


def test_zone_polygons(spark, tmp_path):
    import json

    square = lambda x, y, n: [[x, y], [x + n, y], [x + n, y + n], [x, y + n], [x, y]]
    shapes = [("A/Ring", "Polygon", [square(0, 0, 10), square(4, 4, 2)]), ("B/Parts", "MultiPolygon", [[square(4, 4, 2)], [square(20, -5, 3)]])]
    (tmp_path / "z.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"tzid": z}, "geometry": {"type": t, "coordinates": c}} for z, t, c in shapes]}))
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, -4.0, 21.0), (4, 1.0, 30.0), (5, None, 1.0), (6, 9.9, 9.9)], "k int, lat double, lon double")
    got = {r.k: r.zone for r in zones.lookup(pts, "k", "lat", "lon", zones.polygons(spark, str(tmp_path))).collect()}
    assert got == {1: "A/Ring", 2: "B/Parts", 3: "B/Parts", 4: "Etc/GMT-2", 5: None, 6: "A/Ring"}


def zone_file(path, shapes):
    """A GeoJSON file of (zone, type, coordinates)."""
    import json

    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"tzid": z}, "geometry": {"type": t, "coordinates": c}} for z, t, c in shapes]}))
    return str(path)


def test_zone_polygons_against_brute_force(spark, tmp_path):
    import math
    import random

    rng = random.Random(5)
    star = lambda x, y, r: [[x + r * rng.uniform(0.3, 1) * math.cos(k * math.tau / 40), y + r * rng.uniform(0.3, 1) * math.sin(k * math.tau / 40)] for k in range(40)]
    shapes = {f"Z/{k}": [star(rng.uniform(-20, 20), rng.uniform(-20, 20), 12), star(0, 0, 2)] for k in range(6)}
    points = {k: (rng.uniform(-30, 30), rng.uniform(-30, 30)) for k in range(400)} | {400: (2.0, 4.0), 401: (-6.0, 0.0)}

    def inside(x, y, rings):
        return sum((p[1] > y) != (q[1] > y) and x < p[0] + (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) for r in rings for p, q in zip(r, r[1:] + r[:1], strict=True)) % 2

    # As in the operator, the border's box says which cells a polygon meets.
    box = lambda r: (min(p[0] for p in r) // 2, max(p[0] for p in r) // 2, min(p[1] for p in r) // 2, max(p[1] for p in r) // 2)
    near = lambda x, y, b: b[0] <= x // 2 <= b[1] and b[2] <= y // 2 <= b[3]
    want = {k: min((z for z, r in shapes.items() if near(x, y, box(r[0])) and inside(x, y, r)), default=None) for k, (x, y) in points.items()}
    path = zone_file(tmp_path / "stars.json", [(z, "Polygon", r) for z, r in shapes.items()])
    pts = spark.createDataFrame([(k, y, x) for k, (x, y) in points.items()], "k int, lat double, lon double")
    got = {r.k: r.zone if r.zone.startswith("Z/") else None for r in zones.lookup(pts, "k", "lat", "lon", zones.polygons(spark, path)).collect()}
    assert got == want and 20 < sum(z is not None for z in want.values()) < 400


@pytest.fixture(scope="module")
def export(tmp_path_factory):
    path = tmp_path_factory.mktemp("export")
    (path / "activities").mkdir()
    put = lambda n, d: (path / "activities" / n).write_bytes(d)
    put("a.gpx", B.gpx(B.line(B.MILL, B.QUAY), hr=[100 + k for k in range(30)], power=[200] * 30))
    put("b.gpx", B.gpx(B.line(B.MILL, B.QUAY, bulge=0.0003)))
    put("c.fit.gz", gzip.compress(B.fit()))
    back = B.line(B.QUAY, B.MILL, t0=B.BEGIN + timedelta(hours=10))
    put("two.gpx", B.gpx(B.line(B.MILL, B.QUAY) + back))
    rows = [
        ("Jan 5, 2026, 8:00:00 AM", "Morning Ride", "Ride", 10.0, "false", "activities/a.gpx"),
        ("Jan 6, 2026, 09:00:00 AM", "Morning Ride", "Ride", 10.0, "false", "activities/b.gpx"),
        ("Jan 7, 2026, 10:00:00 AM", "Indoor", "Ride", 10.0, "false", "activities/c.fit.gz"),
        ("Jan 8, 2026, 10:00:00 AM", "Logged", "Ride", 10.0, "true", ""),
        ("Jan 9, 2026, 10:00:00 AM", "Zwift", "Virtual Ride", 10.0, "", ""),
        ("Jan 10, 2026, 8:00:00 AM", "Round trip", "Ride", 20.0, "true", "activities/two.gpx"),
        ("Jan 10, 2026, 8:00:00 AM", "Run", "Run", 5.0, "false", ""),
    ]
    (path / "activities.csv").write_text(B.summary(rows))
    return str(path)


def test_summary_takes_first_of_repeated_columns(spark, export):
    got = tables.activities(spark, export).orderBy("row_id").collect()
    assert len(got) == 6 and got[0]["Distance"] == 10.0 and got[3]["Filename"] is None
    assert got[1]["date"] == datetime(2026, 1, 6, 9)


def test_activities(spark, export, tmp_path):
    plain = api.ActivitiesConfig(clustering=api.RouteClusterConfig(geocoding=None))
    acts, weekly = api.load_strava_activities(spark, export, "America/New_York", str(tmp_path / "cache"), plain)
    got = {r.description + str(r.row_id): r for r in acts.collect()}
    by = sorted(got.values(), key=lambda r: r.row_id)
    assert [r.trainer for r in by] == [False, False, True, False, True, False]
    assert by[0].date == datetime(2026, 1, 5, 0, 0) and by[2].date == datetime(2026, 1, 7, 5, 0)
    assert by[0].distance == pytest.approx(10 / 1.609344) and by[0].elapsed_time == timedelta(seconds=2400)
    assert by[0].max_heart_rate == 129 and by[0].estimated_ftp == pytest.approx(19.6, abs=0.1)  # gaps between the points are 0 W
    assert by[0].cluster_id == by[1].cluster_id == 0 and by[0].cluster_name == "Morning Ride"
    week = weekly.collect()
    assert [r.week for r in week] == [date(2026, 1, 11)] and week[0].distance == pytest.approx(70 / 1.609344)
    again, _ = api.load_strava_activities(spark, export, "America/New_York", str(tmp_path / "cache"), plain)
    assert again.collect() == acts.collect()
    long = api.load_power_curves(spark, export, "UTC")
    wide = api.wide_power_curves(long)
    rides = {r.row_id: r for r in wide.collect()}
    assert set(rides) == {r.row_id for r in long.collect()} and wide.columns[:3] == ["row_id", "local_date", "1s"] and wide.columns[-1] == "43200s"
    assert rides[0]["1s"] == 200.0 and rides[0]["43200s"] is None
    curves = long.where("row_id = 0 and window_s <= 10").collect()
    assert curves[0].watts == 200.0 and curves[-1].watts == pytest.approx(20.0)


NO_ADDRESSES = api.CommuteConfig(clustering=api.RouteClusterConfig(geocoding=None))


def test_commutes(spark, export):
    commutes, spans = api.load_commute_activities(spark, export, "America/New_York", config=NO_ADDRESSES)
    got = commutes.orderBy("row_id", "segment").collect()
    assert [(r.description, r.segment, r.direction) for r in got] == [("Logged", None, "Morning"), ("Round trip", 1, "Morning"), ("Round trip", 2, "Afternoon")]
    assert got[1].date == datetime(2025, 2, 3, 8, 30) and got[2].elapsed_time == timedelta(seconds=290)
    assert [r.n_commutes for r in spans.collect()] == [2]


def test_loaders_read_a_zone_file(spark, export, tmp_path):
    lon, lat = sorted((B.MILL[1], B.QUAY[1])), sorted((B.MILL[0], B.QUAY[0]))
    ring = [[lon[0] - 1, lat[0] - 1], [lon[1] + 1, lat[0] - 1], [lon[1] + 1, lat[1] + 1], [lon[0] - 1, lat[1] + 1]]
    path = zone_file(tmp_path / "zones.json", [("Asia/Kolkata", "Polygon", [ring])])
    acts, _ = api.load_strava_activities(spark, export, "America/New_York", None, api.ActivitiesConfig(clustering=None, zone_file=path))
    by = {r.row_id: r.date for r in acts.collect()}
    assert by[0] == datetime(2026, 1, 5, 13, 30) and by[2] == datetime(2026, 1, 7, 5, 0)
    cache = str(tmp_path / "cache")
    dates = lambda zone_file: {(r.description, r.segment): r.date for r in api.load_commute_activities(spark, export, "America/New_York", cache, api.CommuteConfig(clustering=None, zone_file=zone_file))[0].collect()}
    boxes, ours = dates(None), dates(path)
    assert {k: ours[k] - boxes[k] for k in boxes} == {("Logged", None): timedelta(0), ("Round trip", 1): timedelta(hours=13.5), ("Round trip", 2): timedelta(hours=13.5)}


def test_commute_metrics_are_cached(spark, export, tmp_path, monkeypatch):
    cache, bare = str(tmp_path / "cache"), partial(api.CommuteConfig, clustering=None)
    load = lambda config, folder=cache: sorted(map(repr, api.load_commute_activities(spark, export, "America/New_York", folder, config)[0].collect()))
    first = load(bare())
    assert first == load(bare(), None)
    measured, real = [], api.commute_metrics
    monkeypatch.setattr(api, "commute_metrics", lambda rows, config: measured.append(1) or real(rows, config))
    assert load(bare()) == first and not measured
    api.invalidate_commutes_cache(spark, [], cache)
    load(bare(span_penalty=5.0))
    assert not measured
    api.invalidate_commutes_cache(spark, ["activities/two.gpx"], cache)
    assert load(bare()) == first and len(measured) == 1
    load(bare(stopped_speed=2.0))
    assert len(measured) == 2
    api.invalidate_commutes_cache(spark, None, cache)
    assert load(bare()) == first and len(measured) == 3
    # The clusters of commutes whose metrics come from the cache.
    assert load(NO_ADDRESSES) == load(NO_ADDRESSES, None) and len(measured) == 4


def test_records_cache_decodes_cold_files_only(spark, export, tmp_path):
    import shutil

    copy, cache = tmp_path / "copy", str(tmp_path / "c")
    shutil.copytree(export, copy)
    load = lambda files: api.load_activity_records(spark, files, None, str(copy), cache)
    before = load(["activities/a.gpx"])
    first = before.count()
    (copy / "activities" / "a.gpx").write_bytes(b"broken")
    assert load(["activities/a.gpx"]).count() == first == 30
    # Another cold file leaves the rows of the first where they lie.
    parts = lambda: {p for p in (tmp_path / "c" / "records").rglob("*.parquet") if "a.gpx" in str(p)}
    held = parts()
    assert load(["activities/a.gpx", "activities/b.gpx"]).groupBy("filename").count().count() == 2 and parts() == held
    api.invalidate_records_cache(spark, ["activities/a.gpx"], None, cache)
    with pytest.raises(Exception):
        load(["activities/a.gpx"]).count()
    assert before.count() == 30  # a frame that was read before still works
    assert load(["activities/b.gpx"]).count() == 30
    api.vacuum_cache(spark, cache)
    assert load(["activities/b.gpx"]).count() == 30


def test_segments(spark, export, tmp_path):
    cache = str(tmp_path)
    two = ["activities/two.gpx", "activities/two.gpx", "activities/a.gpx"]
    with pytest.raises(ValueError):
        api.load_activity_records(spark, two, [1, 2, None], export)
    with pytest.raises(FileNotFoundError):
        api.load_activity_records(spark, two, [1, 2, None], export, cache)
    api.load_commute_activities(spark, export, "UTC", cache, api.CommuteConfig(clustering=None))
    got = api.load_activity_records(spark, two, [1, 2, float("nan")], export, cache).groupBy("filename", "segment").count().collect()
    assert {(r.filename[-7:], r.segment): r["count"] for r in got} == {("two.gpx", 1): 30, ("two.gpx", 2): 30, ("s/a.gpx", None): 30}
    spots = api.load_activity_coords(spark, two[:1], [2], export, cache).orderBy("seq").first()
    assert (spots.latitude, spots.longitude) == B.QUAY
    api.invalidate_records_cache(spark, two[:1], [2], cache)
    with pytest.raises(FileNotFoundError):
        api.load_activity_records(spark, two[:1], [2], export, cache)
    assert api.load_activity_records(spark, two[:1], [1], export, cache).count() == 30
    api.invalidate_commutes_cache(spark, ["activities/two.gpx"], cache)
    with pytest.raises(FileNotFoundError):
        api.load_activity_records(spark, two[:1], [1], export, cache)


def test_cluster_routes(spark, export, tmp_path):
    rows = [(k, f"activities/{f}", "Ride") for k, f in enumerate(["a.gpx", "b.gpx", "c.fit.gz"])] + [(3, None, "Ride")]
    rides = spark.createDataFrame(rows, "row_id int, filename string, description string")
    got = {r.row_id: r for r in api.cluster_routes(rides, None, export, str(tmp_path), api.RouteClusterConfig(geocoding=None)).collect()}
    assert [got[k].cluster_id for k in range(4)] == [0, 0, None, None] and got[3].start_lat is None
    got = {r.row_id: r for r in api.cluster_routes(rides, None, export, str(tmp_path), api.RouteClusterConfig(geocoding=fake())).collect()}
    assert got[0].start_address == "45.52 -122.68" and got[2].start_address is None


def test_diary_workbooks(spark, tmp_path):
    serial = lambda d: (d - datetime(1899, 12, 30)).days
    days = [B.BEGIN.replace(hour=0, minute=0) + timedelta(days=k) for k in range(30)]
    weights = [["Measurement", "Date", "Value", "Unit"], *(["Body Weight", serial(d), 180 - k / 7, "lbs"] for k, d in enumerate(days))]
    food = [["Date & Time", "Calories, cals"], *([serial(d) + 0.5, 2000] for d in days)]
    folder = tmp_path / "diary"
    folder.mkdir()
    (folder / "2025.xlsx").write_bytes(B.xlsx({"Measurements": weights[:16], "Food": food[:16], "Exercise": [["Date & Time", "Calories"], [serial(days[0]), 0]]}))
    (folder / "2026.xlsx").write_bytes(B.xlsx({"Measurements": [weights[0], *weights[16:]], "Food": [food[0], *food[16:]], "Empty": []}))
    weight, cal = api.load_mnd_data(spark, str(folder), lambda w, d: w * 0 + 2000, str(tmp_path / "cache"))
    assert weight.count() == 30 and weight.where("rate is not null").agg(F.avg("rate")).first()[0] == pytest.approx(-1)
    assert cal.count() == 30 and cal.where("food = 2000").count() == 30
    again, _ = api.load_mnd_data(spark, str(folder), lambda w, d: w * 0 + 2000, str(tmp_path / "cache"))
    assert again.count() == 30
    (folder / "x.xlsx").write_bytes(B.xlsx({"Measurements": [weights[0], ["Body Weight", 45000, 80, "kg"]]}))
    with pytest.raises(ValueError, match="kg"):
        api.load_mnd_data(spark, str(folder), lambda w, d: w)


@pytest.mark.parametrize("small", [True, False])
def test_legacy_workbooks(spark, tmp_path, small):
    serial = lambda k: 45000 + k
    book = {"Measurements": [["Measurement", "Date", "Value", "Unit"], *(["Body Weight", serial(k), 180 - k / 7, "lbs"] for k in range(12))], "Food": [["Date & Time", "Calories, cals", "Näme – ☕"], *([serial(k) + 0.5, 2000 + k, "ein längerer Text"] for k in range(12))], "Empty": []}
    a, b = tables.legacy_workbook(B.xls(book, small)), tables.workbook(B.xlsx(book))
    number = lambda v: float(v) if v.replace(".", "").isdigit() else v
    plain = lambda rows: [(s, n, {k: number(v) for k, v in c.items()}) for s, n, c in rows]
    assert plain(a) == plain(b) and len(a) == 24
    (tmp_path / "d.XLS").write_bytes(B.xls(book, small))
    weight, _ = api.load_mnd_data(spark, str(tmp_path), lambda w, d: w)
    assert weight.count() == 12 and weight.orderBy("day").first().actual == 180
    with pytest.raises(ValueError):
        tables.legacy_workbook(b"no workbook" * 100)


def test_packed_numbers():
    assert [tables._rk(v) for v in (2 | 7 << 2, 2 | (-7 << 2) & 0xFFFFFFFF, 3 | 1234 << 2, 0x3FF00000, 0x3FF00001)] == [7, -7, 12.34, 1.0, 0.01]


def fake(down=False):
    """A provider; its class is local, so that workers get it with the function."""

    class Fake:
        name = "fake"

        def reverse(self, lat, lon):
            if down:
                raise OSError("no service")
            return None if lat > 50 else f"{lat:.2f} {lon:.2f}"

        def geocode(self, address):
            return (10.0, 10.0) if address.startswith("known") else None

    return api.GeocodingConfig(provider=Fake())


def test_geocode_cache(spark, tmp_path):
    cfg, no, cache = fake(), fake(down=True), str(tmp_path)
    pos = lambda *p: spark.createDataFrame(list(p), "lat double, lon double")
    ask = lambda df, c=cfg: {(r.lat, r.lon): r.address for r in api.geocode_positions(df, cache, c).collect()}
    assert ask(pos((1.0, 2.0), (1.0, 2.0), (60.0, 0.0))) == {(1.0, 2.0): "1.00 2.00", (60.0, 0.0): None}
    assert ask(pos((1.0001, 2.0), (60.0, 0.0)), no) == {(1.0001, 2.0): "1.00 2.00", (60.0, 0.0): None}
    with pytest.raises(Exception, match="no service"):
        ask(pos((1.01, 2.0)), no)
    # A hit and a miss in one call; an answer read before the cache changes still works.
    before = api.geocode_positions(pos((1.0, 2.0), (3.0, 4.0)), cache, cfg)
    assert ask(pos((1.0, 2.0), (5.0, 6.0))) == {(1.0, 2.0): "1.00 2.00", (5.0, 6.0): "5.00 6.00"}
    assert {(r.lat, r.lon): r.address for r in before.collect()} == {(1.0, 2.0): "1.00 2.00", (3.0, 4.0): "3.00 4.00"}
    api.seed_geocode_cache(spark.createDataFrame([("known b",), ("unknown",), ("known a",)], "address string"), cache, cfg)
    assert ask(pos((10.0, 10.0)), no) == {(10.0, 10.0): "known a"}
    store = Store(spark, cache)
    store.write("clusters_activities", pos((0.0, 0.0)), "f")
    store.write("activities", pos((0.0, 0.0)), "f")
    api.invalidate_geocode_cache(spark, cache, "fake")
    assert store.fingerprint("clusters_activities") is None and store.fingerprint("activities") == "f"
    assert ask(pos((10.0, 10.0)), no) == {(10.0, 10.0): "known a"}
    with pytest.raises(Exception, match="no service"):
        ask(pos((1.0, 2.0)), no)
    assert {(r.lat, r.lon): r.address for r in api.geocode_positions(pos((7.0, 8.0)), None, cfg).collect()} == {(7.0, 8.0): "7.00 8.00"}


def test_geocoding_clients(monkeypatch):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at, q = urlparse(self.path), {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            if "key" in q:
                hit = {"formatted_address": "G " + q.get("latlng", ""), "geometry": {"location": {"lat": 1.5, "lng": 2.5}}}
                out = {"status": "REQUEST_DENIED"} if q["key"] == "bad" else {"status": "ZERO_RESULTS", "results": []} if q.get("address") == "none" else {"status": "OK", "results": [hit]}
            elif at.path == "/search":
                out = [] if q["q"] == "none" else [{"lat": "3.5", "lon": "4.5"}]
            else:
                out = {"error": "Unable to geocode"} if q["lat"] == "9.0" else {"display_name": f"N {q['lat']},{q['lon']}"}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        google, other = api.GeocodingProvider("google", 0.0, url, "k"), api.GeocodingProvider("nominatim", 0.0, url)
        assert google.reverse(1.0, 2.0) == "G 1.0,2.0" and google.geocode("x") == (1.5, 2.5) and google.geocode("none") is None
        assert other.reverse(1.0, 2.0) == "N 1.0,2.0" and other.reverse(9.0, 2.0) is None and other.geocode("x") == (3.5, 4.5) and other.geocode("none") is None
        with pytest.raises(OSError):
            api.GeocodingProvider("google", 0.0, url, "bad").reverse(1.0, 2.0)
    finally:
        server.shutdown()
    monkeypatch.setenv("SOME_KEY", "k")
    assert api.GeocodingProvider.from_env("SOME_KEY").name == "google" and "'k'" not in repr(api.GeocodingProvider.from_env("SOME_KEY"))
    assert api.GeocodingConfig(google_api_key_env="NO_SUCH_KEY").client().name == "nominatim"


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    values = lambda: {r.k: r.v for r in store.read("t").collect()}
    assert store.read("t") is None
    store.write("t", rows((1, "a"), (2, "b"), (None, "n")), "f1")
    store.upsert("t", rows((2, "B"), (None, "N")), ["k"])
    assert values() == {1: "a", 2: "B", None: "N"}
    store.update("t", rows((1, "A")), ["k"], ["v"])
    assert values()[1] == "A"
    with pytest.raises(RuntimeError):
        store.update("t", rows((9, "x")), ["k"], ["v"])
    store.delete("t", rows((1, None)).select("k"), ["k"])
    assert set(values()) == {2, None}
    made = []
    make = lambda: made.append(1) or rows((5, "e"))
    store.cached("c", "f", make), store.cached("c", "f", make)
    assert made == [1]
    old = store.read("t")
    store.write("t", rows((7, "g")))
    assert {r.k for r in old.collect()} == {2, None} and set(values()) == {7}
    # A crash before the new manifest has its name leaves the state before.
    publish = Store._publish
    Store._publish = lambda *_: (_ for _ in ()).throw(OSError("crash"))
    try:
        with pytest.raises(OSError):
            store.write("t", rows((8, "h")))
    finally:
        Store._publish = publish
    assert set(values()) == {7}
    # A writer that another overtakes starts again from the other's state.
    meet = []

    def overtaken(self, number, manifest):
        if not meet:
            meet.append(1)
            Store(spark, self.folder).upsert("t", rows((9, "i")), ["k"])
        return publish(self, number, manifest)

    Store._publish = overtaken
    try:
        store.upsert("t", rows((10, "j")), ["k"])
    finally:
        Store._publish = publish
    assert set(values()) == {7, 9, 10}
    store.vacuum()
    assert set(values()) == {7, 9, 10} and len(list((tmp_path / "s" / "t").iterdir())) == 1
    store.drop()
    assert store.manifest() == {}


def test_fits_are_cached_and_pruned(spark, tmp_path):
    df = lambda k: spark.createDataFrame([(1, float(t), float(k * t)) for t in range(10)], "k int, t double, x double")
    for k in (1, 2, 1, 3):
        api.piecewise_fit_cached(df(k), ["k"], "t", "x", str(tmp_path), max_segments=1, max_cached=2)
    assert len(Store(spark, f"{tmp_path}/fits").manifest()) == 2
