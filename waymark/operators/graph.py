"""Connected components and density clusters over tables of links."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import units
from waymark.functions.expressions import haversine_m
from waymark.scratch import release, stored

#: So many points of a cell, at most, meet as many of another in one task.
BLOCK = 2000


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Rows numbered from 0 in an order; ranges of it are numbered apart, so no task sees all rows."""
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    rows = stored(ranged, "ranges")
    # One row for each range.
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(before, F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return rows.join(starts, "__part").withColumn(out, F.col("__start") + place - 1).drop("__part", "__start")


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task, as one from each node to the least of those that they connect."""
    roots: dict = {}
    kind, shape = None, None

    def root(x):
        while roots[x] != x:
            roots[x] = x = roots[roots[x]]
        return x

    for batch in batches:
        kind, names = batch.column(0).type, batch.schema.names
        shape = [f.name for f in kind] if pa.types.is_struct(kind) else None
        ends = [c.to_pylist() if shape is None else [tuple(v.values()) for v in c.to_pylist()] for c in (batch.column("a"), batch.column("b"))]
        for a, b in zip(*ends, strict=True):
            x, y = (root(roots.setdefault(v, v)) for v in (a, b))
            if x != y:
                roots[max(x, y)] = min(x, y)
    if kind is not None:
        found = [(x, r) for x in roots if (r := root(x)) != x]
        back = lambda v: v if shape is None else dict(zip(shape, v, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([back(p[k]) for p in found], kind) for k in (0, 1)], names)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) of all nodes; comp is the least node that links lead to.

    First every task brings its links to a forest.  Then rounds of least label
    and label of the label; each is a written table, so lineage stays short,
    and only whether labels moved comes to the driver.
    """
    links = links.select("a", "b").where("a <> b")
    # Dealt evenly, however many links a node has; adaptive execution joins small partitions, so few links meet in one task and are solved there.
    forest = links.repartition(F.xxhash64("a", "b")).mapInArrow(_forest, links.schema)
    both = stored(forest.union(forest.select("b", "a")).distinct(), "links")
    labels = stored(nodes.select("node", F.col("node").alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hooked = labels.join(near, "node", "left").select("node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("hook"))
        jump = labels.select(F.col("node").alias("hook"), F.col("comp").alias("further"))
        new = stored(hooked.join(jump, "hook").select("node", F.least("hook", "further").alias("comp"), F.col("comp").alias("old")), "labels")
        release(labels)
        labels = new
        if not new.where("comp <> old").limit(1).count():
            release(both)
            return labels.select("node", "comp")


def _grid(within_m: float) -> tuple[float, Callable[[Column], Column]]:
    """Degrees of latitude of ``within_m``, and degrees of longitude at a row of such cells: the widest in the row."""
    size = within_m / units.EARTH_M_PER_DEG
    return size, lambda cy: F.lit(size) / F.greatest(F.cos(F.radians(F.least(F.lit(89.9), F.greatest(F.abs(cy * size), F.abs((cy + 1) * size))))), F.lit(1e-3))


def neighbours(points: DataFrame, key: str, lat: str, lon: str, within_m: float) -> DataFrame:
    """Pairs (a, b), each way and with itself, at most ``within_m`` apart, by an equi-join of grid cells."""
    size, wide = _grid(within_m)
    cell = points.select(F.col(key).alias("a"), F.col(lat).alias("lat_a"), F.col(lon).alias("lon_a"), F.floor(F.col(lat) / size).alias("cy"))
    rows = cell.select("*", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)).alias("ry"))
    rows = rows.withColumn("cx", F.floor(F.col("lon_a") / wide(F.col("ry"))))
    rows = rows.select("a", "lat_a", "lon_a", "ry", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("rx"))
    home = cell.select(F.col("a").alias("b"), F.col("lat_a").alias("lat_b"), F.col("lon_a").alias("lon_b"), F.col("cy").alias("ry"), F.floor(F.col("lon_a") / wide(F.col("cy"))).alias("rx"))
    near = haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"), units.EARTH_EQUATOR_M) <= within_m
    return rows.join(home, ["ry", "rx"]).where(near).select("a", "b")


def _touch(pdf: pd.DataFrame, within_m: float) -> bool:
    """Whether a point of one side lies within the distance of one of the other."""
    a, b = (np.radians(pdf.loc[pdf["side"] == k, ["lat", "lon"]].to_numpy()) for k in (0, 1))
    for k in range(0, len(a), 256):
        p = a[k : k + 256, None]
        s = np.sin((b[:, 0] - p[..., 0]) / 2) ** 2 + np.cos(p[..., 0]) * np.cos(b[:, 0]) * np.sin((b[:, 1] - p[..., 1]) / 2) ** 2
        if (2 * units.EARTH_EQUATOR_M * np.arcsin(np.sqrt(np.minimum(1.0, s))) <= within_m).any():
            return True
    return False


def chain_links(points: DataFrame, key: str, lat: str, lon: str, within_m: float) -> DataFrame:
    """Links (a, b) that connect what all pairs at most ``within_m`` apart connect, without making those pairs.

    Points of a cell whose diagonal is ``within_m`` are all near each other, so
    each links to the cell's least key.  Two cells are linked if any of their
    points are near: their outermost points are tried first, and only where
    these leave it open the points of both meet, in blocks of bounded size.
    """
    side = within_m / units.EARTH_M_PER_DEG * 0.7
    # The row's edge next to the equator sets the width of its cells, so none is wider than ``side``.
    low = lambda cy: F.when((cy >= 0), cy * side).otherwise(F.greatest(-(cy + 1) * side, F.lit(0.0)))
    high = lambda cy: F.least(F.lit(89.9), F.greatest(F.abs(cy * side), F.abs((cy + 1) * side)))
    wide = lambda cy: F.lit(side) / F.greatest(F.cos(F.radians(low(cy))), F.lit(1e-3))
    cy = F.floor(F.col(lat) / side)
    pts = points.select(F.col(key).alias("node"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), cy.alias("cy")).withColumn("cx", F.floor(F.col("lon") / wide(F.col("cy"))))
    pts = stored(pts, "chain-points")
    spot = F.struct("lat", "lon")
    ends = [f(spot, F.col(c)) for c in ("lat", "lon") for f in (F.min_by, F.max_by)]
    cells = stored(pts.groupBy("cy", "cx").agg(F.min("node").alias("cell"), F.count(F.lit(1)).alias("n"), F.array(*ends).alias("ends")), "chain-cells")
    inside = pts.join(cells.select("cy", "cx", "cell"), ["cy", "cx"]).select(F.col("node").alias("a"), F.col("cell").alias("b"))
    # Pairs of cells, each once: further cells of the row, and those within reach in the next two rows.
    rows = cells.select(F.col("cell").alias("a"), F.col("n").alias("n_a"), F.col("ends").alias("ends_a"), F.col("cy").alias("from_cy"), F.col("cx").alias("from_cx"), F.explode(F.sequence(F.col("cy"), F.col("cy") + 2)).alias("cy"))
    reach = F.lit(within_m / units.EARTH_M_PER_DEG * 1.001) / F.greatest(F.cos(F.radians(F.greatest(high(F.col("from_cy")), high(F.col("cy"))))), F.lit(1e-3))
    west, east = (F.floor((x * wide(F.col("from_cy")) + d * reach) / wide(F.col("cy"))) for x, d in ((F.col("from_cx"), -1), (F.col("from_cx") + 1, 1)))
    rows = rows.withColumn("west", F.when(F.col("cy") == F.col("from_cy"), F.col("from_cx") + 1).otherwise(west)).withColumn("east", east).where("west <= east")
    rows = rows.select("a", "n_a", "ends_a", "cy", F.explode(F.sequence("west", "east")).alias("cx"))
    pairs = rows.join(cells.select("cy", "cx", F.col("cell").alias("b"), F.col("n").alias("n_b"), F.col("ends").alias("ends_b")), ["cy", "cx"])
    near = lambda p, q: haversine_m(p["lat"], p["lon"], q["lat"], q["lon"], units.EARTH_EQUATOR_M) <= within_m
    pairs = pairs.withColumn("linked", F.exists("ends_a", lambda p: F.exists("ends_b", lambda q: near(p, q))))
    pairs = stored(pairs.select("a", "b", "n_a", "n_b", "ends_a", "ends_b", "linked"), "chain-pairs")
    linked = pairs.where("linked").select("a", "b")
    # The least latitude to the greatest are ends 0 to 1, the longitudes 2 to 3.
    gap = F.greatest(F.col("ends_b")[0]["lat"] - F.col("ends_a")[1]["lat"], F.col("ends_a")[0]["lat"] - F.col("ends_b")[1]["lat"])
    open_ = pairs.where(~F.col("linked") & (gap <= within_m / units.EARTH_M_PER_DEG * 1.001) & ((F.col("n_a") > 1) | (F.col("n_b") > 1)))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    open_ = open_.select("a", "b", blocks(F.col("n_a")).alias("k_a"), blocks(F.col("n_b")).alias("k_b"))
    home = pts.join(cells.select("cy", "cx", "cell"), ["cy", "cx"]).select("cell", "lat", "lon", F.xxhash64("node").alias("h"))
    own, other = F.pmod("h", "own").cast("int"), F.explode(F.sequence(F.lit(0), F.col("other") - 1))
    first = open_.select("a", "b", F.col("a").alias("cell"), F.col("k_a").alias("own"), F.col("k_b").alias("other")).join(home, "cell").select("a", "b", own.alias("i"), other.alias("j"), F.lit(0).alias("side"), "lat", "lon")
    second = open_.select("a", "b", F.col("b").alias("cell"), F.col("k_b").alias("own"), F.col("k_a").alias("other")).join(home, "cell").select("a", "b", own.alias("j"), other.alias("i"), F.lit(1).alias("side"), "lat", "lon")
    kind = points.schema[key].dataType.simpleString()

    def meet(cell: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = _touch(pdf, within_m)
        return pd.DataFrame({"a": [cell[0]] * found, "b": [cell[1]] * found})

    met = first.unionByName(second).groupBy("a", "b", "i", "j").applyInPandas(meet, f"a {kind}, b {kind}")
    return inside.unionByName(linked).unionByName(met)


def dbscan(nodes: DataFrame, links: DataFrame, min_samples: int) -> DataFrame:
    """(node, cluster) by density over symmetric links; -1 is noise, a border node takes its lowest cluster.

    Clusters are numbered by their least node.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    core = stored(nodes.join(both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n")), "node", "left").where(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("node"), "core")
    inner = both.join(core.withColumnRenamed("node", "a"), "a").join(core.withColumnRenamed("node", "b"), "b")
    comp = components(core, inner.select("a", "b"))
    ids = numbered(comp.select("comp").distinct(), [F.col("comp")], "cluster")
    placed = comp.join(ids, "comp").select("node", "cluster")
    border = both.join(placed.select(F.col("node").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("node")).agg(F.min("cluster").alias("near"))
    out = nodes.join(placed, "node", "left").join(border, "node", "left")
    return out.select("node", F.coalesce("cluster", "near", F.lit(-1)).cast("int").alias("cluster"))
