"""The activity summary (CSV) and diary workbooks (XLSX, XLS)."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.expressions import parse_activity_date
from waymark.scratch import stored

#: Columns of the summary that are used, and their types.
SUMMARY = {
    "Activity Date": "string", "Activity Type": "string", "Activity Name": "string", "Activity Gear": "string", "Commute": "boolean",
    "Distance": "double", "Elevation Gain": "double", "Elapsed Time": "double", "Moving Time": "double", "Filename": "string",
}
RIDES = ("Ride", "Virtual Ride")


def activities(spark: SparkSession, path: str) -> DataFrame:
    """Rides of ``activities.csv`` with row_id and the UTC date; of columns that share a name the first counts."""
    raw = spark.read.csv(path.rstrip("/") + "/activities.csv", header=True, multiLine=True, escape='"')
    found: dict[str, str] = {}
    for k, c in enumerate(raw.columns):
        # Spark appends the position to names that repeat.
        for name in (c, c.removesuffix(str(k))):
            if name in SUMMARY:
                found.setdefault(name, c)
    # A quoted comma aside, absent columns are null throughout.
    cols = [(F.col(f"`{found[n]}`") if n in found else F.lit(None)).try_cast(kind).alias(n) for n, kind in SUMMARY.items()]
    rows = raw.select(F.monotonically_increasing_id().alias("row_id"), *cols).where(F.col("Activity Type").isin(*RIDES))
    return rows.withColumn("date", parse_activity_date(F.col("Activity Date"))).withColumn("Filename", F.nullif("Filename", F.lit("")))


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook(data: bytes) -> list[tuple[str, int, dict[str, str]]]:
    """(sheet, row number, cells by header) of an XLSX file; empty sheets and cells are left out."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        xml = lambda name: ElementTree.fromstring(z.read(name))
        strings = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in xml("xl/sharedStrings.xml").iter(f"{_NS}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target", "") for r in xml("xl/_rels/workbook.xml.rels")}
        for sheet in xml("xl/workbook.xml").iter(f"{_NS}sheet"):
            target = targets[sheet.get(_REL)].lstrip("/")
            header: dict[int, str] = {}
            for k, row in enumerate(xml(target if target.startswith("xl/") else f"xl/{target}").iter(f"{_NS}row")):
                cells: dict[int, str] = {}
                for n, c in enumerate(row.iter(f"{_NS}c")):
                    ref = re.match(r"[A-Z]+", c.get("r", ""))
                    col = sum((ord(x) - 64) * 26**p for p, x in enumerate(reversed(ref[0]))) if ref else n + 1
                    kind, value = c.get("t"), c.find(f"{_NS}v")
                    if kind == "inlineStr":
                        cells[col] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif value is not None and value.text is not None and kind != "e":
                        cells[col] = strings[int(value.text)] if kind == "s" else value.text
                if k == 0:
                    header = cells
                elif cells:
                    out.append((sheet.get("name"), k, {header[c]: v for c, v in cells.items() if c in header}))
    return out


def compound_stream(data: bytes, *names: str) -> bytes:
    """The first named stream of an OLE compound file."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("not a compound file")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    first_dir, cutoff, first_small, more = (struct.unpack_from("<I", data, at)[0] for at in (48, 56, 60, 68))
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    numbers = lambda raw: struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])
    table = list(numbers(data[76:512]))
    while more < 0xFFFFFFFA:
        *found, more = numbers(sector(more))
        table += found
    after = [n for t in table if t < 0xFFFFFFFA for n in numbers(sector(t))]

    def chain(n: int, nexts: list[int], read) -> bytes:
        out, seen = [], set()
        while n < 0xFFFFFFFA and n not in seen:
            seen.add(n)
            out.append(read(n))
            n = nexts[n]
        return b"".join(out)

    entries = chain(first_dir, after, sector)
    found, root = {}, b""
    for at in range(0, len(entries), 128):
        e = entries[at : at + 128]
        name = e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le", "replace")
        start, length = struct.unpack_from("<II", e, 116)
        if e[66] == 5:
            root = chain(start, after, sector)
        elif e[66] == 2:
            found[name] = (start, length)
    for name in names:
        if name in found:
            start, length = found[name]
            if length >= cutoff:
                return chain(start, after, sector)[:length]
            nexts = [n for raw in [chain(first_small, after, sector)] for n in numbers(raw)]
            return chain(start, nexts, lambda n: root[n * small : (n + 1) * small])[:length]
    raise ValueError("the file has no workbook")


class _Chunks:
    """The bodies of a record and of those that continue it; characters start anew with a flag in each."""

    def __init__(self, bodies: list[bytes]):
        self.bodies, self.k, self.at = bodies, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.at >= len(self.bodies[self.k]):
                self.k, self.at = self.k + 1, 0
            part = self.bodies[self.k][self.at : self.at + n]
            out, self.at, n = out + part, self.at + len(part), n - len(part)
        return out

    def text(self, count: int, wide: bool) -> str:
        out = ""
        while count:
            if self.at >= len(self.bodies[self.k]):
                self.k, self.at = self.k + 1, 1
                wide = bool(self.bodies[self.k][0] & 1)
            width = 2 if wide else 1
            n = min(count, (len(self.bodies[self.k]) - self.at) // width)
            out += self.take(n * width).decode("utf-16-le" if wide else "latin-1")
            count -= n
        return out

    def string(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = self.text(count, bool(flags & 1))
        self.take(4 * runs + extra)
        return out


def _rk(value: int) -> float:
    """A packed number: 30 bits of a whole number or of a double, perhaps in hundredths."""
    number = float(value >> 2 if value < 0x80000000 else (value >> 2) - (1 << 30)) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


def legacy_workbook(data: bytes) -> list[tuple[str, int, dict[str, str]]]:
    """As ``workbook`` of a legacy XLS file (BIFF8)."""
    stream = compound_stream(data, "Workbook", "Book")
    records, at = [], 0
    starts: dict[int, int] = {}
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        starts[at] = len(records)
        records.append((kind, stream[at + 4 : at + 4 + size]))
        at += 4 + size
    if records and records[0][0] == 0x809 and struct.unpack_from("<H", records[0][1])[0] != 0x600:
        raise ValueError("workbooks before Excel 97 are not supported; save them as .xlsx")
    strings, places = [], []
    for k, (kind, body) in enumerate(records):
        if kind == 0x2F:
            raise ValueError("encrypted workbooks are not supported")
        if kind == 0x85 and body[5] == 0:
            chunk = _Chunks([body[8:]])
            places.append((chunk.text(body[6], bool(body[7] & 1)), struct.unpack_from("<I", body)[0]))
        elif kind == 0xFC:
            more = k + 1
            while more < len(records) and records[more][0] == 0x3C:
                more += 1
            chunk = _Chunks([b for _, b in records[k:more]])
            chunk.take(4)
            strings = [chunk.string() for _ in range(struct.unpack("<I", chunk.take(4))[0])]
        elif kind == 0x0A:
            break
    out = []
    for name, place in places:
        cells: dict[int, dict[int, str]] = {}
        put = lambda row, col, value: cells.setdefault(row, {}).update({col: value if isinstance(value, str) else repr(value)})
        formula = None
        for kind, body in records[starts[place] :]:
            if kind == 0x0A:
                break
            if kind == 0x207 and formula:
                put(*formula, _Chunks([body]).string())
            if kind not in (0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x06):
                continue
            row, col = struct.unpack_from("<HH", body)
            if kind == 0xFD:
                put(row, col, strings[struct.unpack_from("<I", body, 6)[0]])
            elif kind == 0x204:
                put(row, col, _Chunks([body[6:]]).string())
            elif kind == 0x203:
                put(row, col, struct.unpack_from("<d", body, 6)[0])
            elif kind == 0x27E:
                put(row, col, _rk(struct.unpack_from("<I", body, 6)[0]))
            elif kind == 0xBD:
                for n in range((len(body) - 6) // 6):
                    put(row, col + n, _rk(struct.unpack_from("<I", body, 6 + 6 * n)[0]))
            elif body[12:14] != b"\xff\xff":
                put(row, col, struct.unpack_from("<d", body, 6)[0])
            else:
                formula = (row, col) if body[6] == 0 else None
        rows = sorted(cells)
        header = cells[rows[0]] if rows else {}
        out += [(name, k, {header[c]: v for c, v in sorted(cells[r].items()) if c in header}) for k, r in enumerate(rows) if k]
    return out


def sheets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One table for each sheet name, over all workbooks below ``path`` in the order of their names and rows; cells are text.

    Every workbook is decoded once; only sheet and column names come to the driver.
    """
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.xlsx?$"))
    decode = lambda p, d: (workbook if p.lower().endswith("x") else legacy_workbook)(bytes(d))
    read = F.udf(decode, "array<struct<sheet:string,n:int,cells:map<string,string>>>", useArrow=False)
    rows = stored(files.select("path", F.explode(read("path", "content")).alias("r")).select("path", "r.*"), "sheets")
    heads = rows.select("sheet", F.explode(F.map_keys("cells")).alias("c")).groupBy("sheet").agg(F.array_sort(F.collect_set("c")).alias("cols")).collect()
    return {h.sheet: rows.where(F.col("sheet") == h.sheet).select("path", "n", *[F.col("cells")[c].alias(c) for c in h.cols]).orderBy("path", "n") for h in heads}


def sheet_time(c) -> F.Column:
    """A cell as a zone-free time: a serial day number, or ISO text."""
    serial = F.expr("timestamp_ntz'1899-12-30 00:00:00'") + F.make_dt_interval(secs=F.round(F.col(c).try_cast("double") * 86400, 3).cast("decimal(18,6)"))
    return F.when(F.col(c).try_cast("double").isNotNull(), serial).otherwise(F.col(c).try_cast("timestamp_ntz"))
