"""Small synthetic files."""

import io
import struct
import zipfile
from datetime import datetime, timedelta
from xml.sax.saxutils import escape

BEGIN = datetime(2025, 2, 3, 16, 30)
#: Two places in Portland, about five kilometres apart.
MILL, QUAY = (45.52, -122.68), (45.52, -122.6155)


def line(start, end, n=30, step=10, t0=BEGIN, bulge=0.0):
    return [(t0 + timedelta(seconds=step * k), start[0] + (end[0] - start[0]) * k / (n - 1) + bulge, start[1] + (end[1] - start[1]) * k / (n - 1)) for k in range(n)]


def gpx(points, hr=None, power=None):
    body = "".join(
        f'<trkpt lat="{lat:.6f}" lon="{lon:.6f}"><time>{t:%Y-%m-%dT%H:%M:%SZ}</time><extensions>' + (f"<power>{power[k]}</power>" if power else "")
        + "<x:TrackPointExtension>" + (f"<x:hr>{hr[k]}</x:hr>" if hr else "") + "</x:TrackPointExtension></extensions></trkpt>"
        for k, (t, lat, lon) in enumerate(points)
    )
    return f'<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1" xmlns:x="urn:x"><trk><trkseg>{body}</trkseg></trk></gpx>'.encode()


def tcx(points):
    body = "".join(f"<Trackpoint><Time>{t:%Y-%m-%dT%H:%M:%SZ}</Time><Position><LatitudeDegrees>{lat}</LatitudeDegrees><LongitudeDegrees>{lon}</LongitudeDegrees></Position><DistanceMeters>{100 * k}</DistanceMeters><HeartRateBpm><Value>{120 + k}</Value></HeartRateBpm></Trackpoint>" for k, (t, lat, lon) in enumerate(points))
    return f'<TrainingCenterDatabase xmlns="urn:t"><Activities><Activity><Lap><Track>{body}</Track></Lap></Activity></Activities></TrainingCenterDatabase>'.encode()


def fit(n=5, hr=100):
    start = int((BEGIN - datetime(1989, 12, 31)).total_seconds())
    body = struct.pack("<BBBHB", 0x40, 0, 0, 20, 3) + bytes([253, 4, 0x86, 3, 1, 0x02, 7, 2, 0x84])
    for k in range(n):
        body += struct.pack("<BIBH", 0, start + k, hr + k, 0xFFFF if k == 1 else 200 + k)
    return struct.pack("<BBHI4s", 12, 16, 100, len(body), b".FIT") + body + b"\0\0"


def xlsx(sheets):
    """sheets: name -> rows; the first row is the header, numbers stay numbers."""
    out = io.BytesIO()
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(s)}" sheetId="{k}" r:id="rId{k}"/>' for k, s in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            cell = lambda v: "" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
            place = lambda r, c, v: cell(v).replace("<c", f'<c r="{chr(65 + c)}{r}"', 1)
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{ns}"><sheetData>' + "".join(f'<row r="{r}">' + "".join(place(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1)) + "</sheetData></worksheet>")
    return out.getvalue()


def _biff(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def _sst(strings, split):
    """The table of strings, in a record of ``split`` bytes and one that continues it in the midst of a string."""
    body = struct.pack("<II", len(strings), len(strings))
    cuts = []
    for s in strings:
        wide = any(ord(c) > 255 for c in s)
        raw = s.encode("utf-16-le" if wide else "latin-1")
        body += struct.pack("<HB", len(s), wide) + raw
        cuts.append((len(body) - len(raw), wide, len(raw)))
    at, wide, size = next(((a, w, n) for a, w, n in cuts if n > 8 and a >= split), (None, 0, 0))
    if at is None:
        return _biff(0xFC, body)
    cut = at + 4
    return _biff(0xFC, body[:cut]) + _biff(0x3C, bytes([wide]) + body[cut:])


def xls(sheets, small=False):
    """A legacy workbook of the same cells; whole numbers are packed, others are doubles."""
    strings = sorted({str(v) for rows in sheets.values() for r in rows for v in r if v is not None and not isinstance(v, (int, float))})
    bof = lambda kind: _biff(0x809, struct.pack("<HHHHII", 0x600, kind, 0, 0, 0, 0))
    bodies = []
    for rows in sheets.values():
        out = bof(0x10)
        for r, row in enumerate(rows):
            for c, v in enumerate(row):
                if v is None:
                    continue
                if isinstance(v, float):
                    out += _biff(0x203, struct.pack("<HHHd", r, c, 0, v))
                elif isinstance(v, int):
                    out += _biff(0xBD, struct.pack("<HHHIH", r, c, 0, (v << 2) & 0xFFFFFFFF | 2, c)) if r % 2 else _biff(0x27E, struct.pack("<HHHI", r, c, 0, (v << 2) & 0xFFFFFFFF | 2))
                else:
                    out += _biff(0xFD, struct.pack("<HHHI", r, c, 0, strings.index(v)))
        bodies.append(out + _biff(0x0A, b""))
    table = _sst(strings, 10)
    named = lambda places: b"".join(_biff(0x85, struct.pack("<IHBB", p, 0, len(n), 0) + n.encode("latin-1")) for n, p in zip(sheets, places))
    base = len(bof(5) + named([0] * len(sheets)) + table + _biff(0x0A, b""))
    places = [base + sum(map(len, bodies[:k])) for k in range(len(bodies))]
    stream = bof(5) + named(places) + table + _biff(0x0A, b"") + b"".join(bodies)
    if not small:
        stream += b"\0" * max(0, 4096 - len(stream))
    return compound(stream)


def compound(stream, size=512):
    """An OLE file with one stream ``Workbook``; below 4096 bytes it lies in small sectors."""
    entry = lambda name, kind, start, n: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", start, n))
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    pad = lambda b, n: b + b"\0" * (-len(b) % n)
    short = len(stream) < 4096
    data = pad(pad(stream, 64), size)
    n = len(data) // size
    # Sectors: 0 the table, 1 the directory, 2 the small table, then the data.
    fat = [0xFFFFFFFD, end, end, *range(4, 3 + n), end]
    fat += [free] * (size // 4 - len(fat))
    if short:
        k = -(-len(stream) // 64)
        mini = [*range(1, k), end]
        mini += [free] * (size // 4 - len(mini))
    else:
        mini = [free] * (size // 4)
    directory = entry("Root Entry", 5, 3 if short else end, len(data) if short else 0) + entry("Workbook", 2, 0 if short else 3, len(stream))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, 1, 1, 0, 4096, 2, 1, end, 0)
    head += struct.pack("<109I", 0, *[free] * 108)
    return head + struct.pack("<128I", *fat) + directory.ljust(size, b"\0") + struct.pack("<128I", *mini) + data


HEADER = "Activity ID,Activity Date,Activity Name,Activity Type,Distance,Commute,Filename,Activity Gear,Elevation Gain,Elapsed Time,Moving Time,Distance"


def summary(rows):
    """rows: (date text, name, type, km, commute, filename)."""
    return "\n".join([HEADER, *(f'{k},"{d}",{n},{t},{km},{c},{f},Gravel,61,2400,2250,999' for k, (d, n, t, km, c, f) in enumerate(rows))]) + "\n"
