"""Sensor files (GPX, TCX, FIT, each also gzipped) as one table of records.

Files are read by Spark's ``binaryFile`` source and decoded on the executors,
a few files at a time, so any store that Spark reads will do and no batch
holds more than a hundred files.
"""

from __future__ import annotations

import gzip
import math
import struct
from datetime import datetime, timedelta, timezone
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.units import EARTH_MEAN_M

RECORD = "array<struct<ts:timestamp_ntz,latitude:double,longitude:double,distance:double,heart_rate:double,power:double>>"
COLUMNS = ["seq", "ts", "latitude", "longitude", "distance", "heart_rate", "power"]
#: FIT: message number of records, and the fields used: number -> (name, scale).
FIT_RECORD = 20
FIT_FIELDS = {253: ("time", 1.0), 0: ("latitude", 180 / 2**31), 1: ("longitude", 180 / 2**31), 3: ("heart_rate", 1.0), 5: ("distance", 1e-5), 7: ("power", 1.0)}
FIT_EPOCH = datetime(1989, 12, 31)
#: FIT base types by their low five bits: (format, value that means none).
FIT_TYPES = {0: ("B", 0xFF), 1: ("b", 0x7F), 2: ("B", 0xFF), 3: ("h", 0x7FFF), 4: ("H", 0xFFFF), 5: ("i", 0x7FFFFFFF), 6: ("I", 0xFFFFFFFF), 10: ("B", 0), 11: ("H", 0), 12: ("I", 0)}


def _time(text: str | None) -> datetime | None:
    if not text:
        return None
    at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def _number(text: str | None) -> float | None:
    return float(text) if text and text.strip() else None


def parse_xml(data: bytes) -> list[tuple]:
    """The track points of a GPX or TCX file; distances in km where the file has them."""
    rows = []
    for node in ElementTree.fromstring(data.lstrip()).iter():
        kind = node.tag.rpartition("}")[2].lower()
        if kind not in ("trkpt", "trackpoint"):
            continue
        text = {x.tag.rpartition("}")[2].lower(): x.text for x in node.iter()}
        hr = text.get("hr")
        if kind == "trackpoint":
            beat = next((x for x in node if x.tag.endswith("HeartRateBpm")), None)
            hr = next((x.text for x in beat if x.tag.endswith("Value")), None) if beat is not None else None
        metres = _number(text.get("distancemeters"))
        rows.append((_time(text.get("time")), _number(node.get("lat") or text.get("latitudedegrees")), _number(node.get("lon") or text.get("longitudedegrees")), None if metres is None else metres / 1000, _number(hr), _number(text.get("power") or text.get("watts"))))
    return rows


def parse_fit(data: bytes) -> list[tuple]:
    """The record messages of a FIT file, or of several in one."""
    rows, start = [], 0
    while start + 12 <= len(data):
        size, body = data[start], struct.unpack_from("<I", data, start + 4)[0]
        if data[start + 8 : start + 12] != b".FIT":
            raise ValueError("not a FIT file")
        at, end = start + size, min(len(data), start + size + body)
        kinds: dict[int, tuple] = {}
        clock = 0
        while at < end:
            head = data[at]
            at += 1
            if head & 0x40 and not head & 0x80:
                order = ">" if data[at + 1] else "<"
                number, n = struct.unpack_from(order + "HB", data, at + 2)
                fields = [tuple(data[at + 5 + 3 * k : at + 8 + 3 * k]) for k in range(n)]
                at += 5 + 3 * n
                extra = 0
                if head & 0x20:
                    more = data[at]
                    extra = sum(data[at + 2 + 3 * k] for k in range(more))
                    at += 1 + 3 * more
                kinds[head & 0x0F] = (order, number, fields, extra)
                continue
            order, number, fields, extra = kinds[head >> 5 & 0x03 if head & 0x80 else head & 0x0F]
            got: dict[str, float] = {}
            for field, width, base in fields:
                form, none = FIT_TYPES.get(base & 0x1F, ("", 0))
                if form and width == struct.calcsize(form) and (field in FIT_FIELDS):
                    value = struct.unpack_from(order + form, data, at)[0]
                    if value != none:
                        name, scale = FIT_FIELDS[field]
                        got[name] = value * scale
                at += width
            at += extra
            if head & 0x80:
                clock += (head & 0x1F) - clock & 0x1F
                got["time"] = clock
            elif "time" in got:
                clock = int(got["time"])
            if number == FIT_RECORD:
                rows.append((FIT_EPOCH + timedelta(seconds=got["time"]) if "time" in got else None, *(got.get(c) for c in ("latitude", "longitude", "distance", "heart_rate", "power"))))
        start = end + 2
    return rows


def with_distance(rows: list[tuple]) -> list[tuple]:
    """Adds the great-circle distance along the positions where a file has no distance of its own."""
    if any(r[3] is not None for r in rows):
        return rows
    out, total, last = [], 0.0, None
    for t, lat, lon, _, hr, power in rows:
        if lat is not None and lon is not None:
            if last:
                a, b = math.radians(last[0]), math.radians(lat)
                s = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon - last[1]) / 2) ** 2
                total += 2 * EARTH_MEAN_M * math.asin(min(1.0, math.sqrt(s))) / 1000
            last = (lat, lon)
        out.append((t, lat, lon, total if last else None, hr, power))
    return out


def parse(path: str, data: bytes, derive_distance: bool = True) -> list[tuple]:
    if path.lower().endswith(".gz"):
        data, path = gzip.decompress(data), path[:-3]
    kind = path.lower().rpartition(".")[2]
    if kind not in ("gpx", "tcx", "fit"):
        raise ValueError(f"unsupported activity file: {path}")
    rows = parse_fit(data) if kind == "fit" else parse_xml(data)
    return with_distance(rows) if derive_distance else rows


def relative(path: Column, root: str) -> Column:
    """The path below ``root``, which is how the activity table names files."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), r"^.*?" + _escaped(root) + r"/+", "")


def _escaped(root: str) -> str:
    import re

    return re.escape(re.sub(r"^\w+:/*", "", root).strip("/"))


def records(spark: SparkSession, root: str, derive_distance: bool = True, pattern: str = "*", wanted: DataFrame | None = None) -> DataFrame:
    """(filename, seq, ts, latitude, longitude, distance, heart_rate, power) of the files below ``root``, or of the ``filename`` of ``wanted`` among them."""
    # Said to be nondeterministic, so that no rule evaluates it twice or before files are chosen.
    decode = F.udf(lambda p, d: parse(p, bytes(d), derive_distance), RECORD, useArrow=False).asNondeterministic()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    files = files.where(F.lower("path").rlike(r"\.(gpx|tcx|fit)(\.gz)?$")).select(relative(F.col("path"), root).alias("filename"), "path", "content")
    if wanted is not None:
        files = files.join(wanted.select("filename"), "filename", "left_semi")
    files = files.select("filename", decode("path", "content").alias("r"))
    return files.select("filename", F.posexplode("r").alias("seq", "r")).select("filename", "seq", "r.*")


def coords(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, latitude, longitude) from the first to the last valid position."""
    from waymark.operators.activity import trim_valid

    return trim_valid(rows, keys, "seq", "seq").select(*keys, "seq", "latitude", "longitude")
