"""Geographic grids, range joins against them, and finite-difference stencils.

Fields are long tables (period_s, source, i_lat, i_lon, x_km, y_km, value) whose missing cells are absent or NULL.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import local_xy, with_geodesic
from ..session import bounded

FIELD = ("period_s", "source")


def inclusive_axis(low: float, high: float, step: float) -> int:
    """Number of points of a regular axis; the range must be a whole multiple of the step, with at least three points."""
    n = round((high - low) / step)
    if step <= 0 or n < 2 or abs(n * step - (high - low)) > 1e-8:
        raise ValueError("the range must be a whole multiple of the step and give three points or more")
    return n + 1


def grid_axes(spark: SparkSession, lon: tuple[float, float, float], lat: tuple[float, float, float]) -> DataFrame:
    """(i_lat, i_lon, lat, lon, x_km, y_km): an inclusive grid with x by latitude and y along its middle, from summed geodesic steps."""
    inclusive_axis(*lon), inclusive_axis(*lat)
    box = spark.range(1).select(F.lit(0).alias("key"), *[F.lit(float(v)).alias(n) for n, v in (("lon0", lon[0]), ("lon1", lon[1]), ("lat0", lat[0]), ("lat1", lat[1]))])
    return grids_of(box, float(lon[2]), float(lat[2]), ("key",)).drop("key")


def grids_of(boxes: DataFrame, lon_step: float, lat_step: float, keys: tuple[str, ...]) -> DataFrame:
    """(keys, i_lat, i_lon, lat, lon, x_km, y_km): the grid of every box (keys, lon0, lon1, lat0, lat1), whose sides are whole multiples of the steps.

    A step along a row has the same length everywhere, so x is a multiple of one geodesic; y sums the steps of the rows.
    """
    count = lambda a, b, step: F.round((F.col(b) - F.col(a)) / step).cast("int")
    rows = boxes.withColumn("i_lat", F.explode(F.sequence(F.lit(0), count("lat0", "lat1", lat_step))))
    rows = rows.withColumn("lat", F.col("lat0") + F.col("i_lat") * lat_step).withColumns({"below": F.col("lat") - lat_step, "next": F.col("lon0") + lon_step, "middle": (F.col("lon0") + F.col("lon1")) / 2})
    rows = with_geodesic(with_geodesic(rows, "lon0", "lat", "next", "lat", "dx"), "middle", "below", "middle", "lat", "dy")
    up = F.when(F.col("i_lat") == 0, 0.0).otherwise(F.col("dy.distance_km"))
    lines = rows.select(*keys, "i_lat", "lat", "lon0", count("lon0", "lon1", lon_step).alias("last"), F.col("dx.distance_km").alias("step_km"), F.sum(up).over(Window.partitionBy(*keys).orderBy("i_lat")).alias("y_km"))
    lines = lines.withColumn("i_lon", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return lines.select(*keys, "i_lat", "i_lon", "lat", (F.col("lon0") + F.col("i_lon") * lon_step).alias("lon"), (F.col("i_lon") * F.col("step_km")).alias("x_km"), "y_km")


#: Cells along a side of a block, whose 64 cells are the bits of one number.
BLOCK = 8


def at_least(words: list[Column], k: int) -> Column:
    """Bits that are set in at least k of the words."""
    if k <= 0:
        return F.lit(-1).cast("long")
    sets = [reduce(Column.bitwiseAND, some) for some in combinations(words, k)]
    return reduce(Column.bitwiseOR, sets) if sets else F.lit(0).cast("long")


def station_coverage(grid: DataFrame, receivers: DataFrame, centre: tuple[float, float], mode: str = "either", nearby_km: float = 150.0, quadrant_km: float = 250.0, min_quadrants: int = 3, keys: tuple[str, ...] = FIELD) -> DataFrame:
    """Grid cells of every key with ``covered``: a receiver within ``nearby_km`` and/or receivers of enough quadrants within ``quadrant_km``.

    A range join: places of receivers and cells fall into square tiles of the larger radius, each place is offered to
    its tile and the eight around, and tiles join by equality before distances are compared. That happens once for each
    distinct place. What a place reaches is kept as bitmaps of 8 x 8 cells: one for the cells nearby and one for each
    quadrant. The rows of a key take the bitmaps of their places and are put together by a bitwise or on the map side,
    so neither a row nor a key ever becomes as many rows as it has cells until the result is written out.
    """
    size = max(nearby_km, quadrant_km)
    place = lambda lon, lat: local_xy(F.col(lon), F.col(lat), F.lit(centre[0]), F.lit(centre[1]))
    gx, gy = place("lon", "lat")
    side = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    bit = (F.pmod("i_lat", F.lit(BLOCK)) * BLOCK + F.pmod("i_lon", F.lit(BLOCK))).cast("int")
    numbered = grid.select("i_lat", "i_lon", side("i_lat").alias("by"), side("i_lon").alias("bx"), bit.alias("bit"), gx.alias("gx"), gy.alias("gy"))
    cells = numbered.withColumns({"tx": F.floor(F.col("gx") / size), "ty": F.floor(F.col("gy") / size)})
    rx, ry = place("rcv_lon", "rcv_lat")
    near = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    rows = receivers.select(*keys, "rcv_lon", "rcv_lat")
    spread = rows.select("rcv_lon", "rcv_lat").distinct().select("rcv_lon", "rcv_lat", rx.alias("rx"), ry.alias("ry")).withColumn("n", F.explode(near))
    tiles = spread.select("rcv_lon", "rcv_lat", "rx", "ry", (F.floor(F.col("rx") / size) + F.col("n.dx")).alias("tx"), (F.floor(F.col("ry") / size) + F.col("n.dy")).alias("ty"))
    dx, dy = F.col("rx") - F.col("gx"), F.col("ry") - F.col("gy")
    hits = tiles.join(cells, ["tx", "ty"]).withColumns({"d": F.hypot(dx, dy), "one": F.expr("shiftleft(1L, bit)"), "q": (dx >= 0).cast("int") * 2 + (dy >= 0).cast("int")}).filter(F.col("d") <= size)
    marks = {"close": F.col("d") <= nearby_km} | {f"q{i}": (F.col("d") <= quadrant_km) & (F.col("q") == i) for i in range(4)}
    reach = hits.groupBy("rcv_lon", "rcv_lat", "by", "bx").agg(*[F.bit_or(F.when(c, F.col("one")).otherwise(F.lit(0).cast("long"))).alias(n) for n, c in marks.items()])
    found = rows.join(reach, ["rcv_lon", "rcv_lat"]).groupBy(*keys, "by", "bx").agg(*[F.bit_or(n).alias(n) for n in marks])
    quadrants = at_least([F.col(f"q{i}") for i in range(4)], min_quadrants)
    word = {"nearby": F.col("close"), "quadrants": quadrants, "either": F.col("close").bitwiseOR(quadrants)}[mode]
    none = -1 if mode != "nearby" and min_quadrants <= 0 else 0
    found = found.select(*keys, "by", "bx", word.alias("word"))
    blocks = numbered.groupBy("by", "bx").agg(F.collect_list(F.struct("i_lat", "i_lon", "bit")).alias("cells"))
    every = receivers.select(*keys).distinct().crossJoin(bounded(blocks)).join(found, [*keys, "by", "bx"], "left")
    bits = F.expr(f"transform(cells, c -> struct(c.i_lat AS i_lat, c.i_lon AS i_lon, (shiftright(coalesce(word, {none}L), c.bit) & 1L) = 1L AS covered))")
    return every.select(*keys, F.inline_outer(bits))


def cells_by_source(grid: DataFrame, sources: DataFrame) -> DataFrame:
    """Every cell for every source with distance and azimuth from the source. The grid is one bounded map, so it goes to the sources."""
    pairs = sources.crossJoin(bounded(grid.select("i_lat", "i_lon", "lat", "lon")))
    return with_geodesic(pairs, "src_lon", "src_lat", "lon", "lat").withColumns({"distance_km": F.col("g.distance_km"), "azimuth": F.col("g.azimuth")}).drop("g")


def gradient(field: DataFrame, axis: str, value: str = "value", out: str = "gradient", keys: tuple[str, ...] = FIELD) -> DataFrame:
    """``field`` with its second-order derivative along ``lon`` (over x_km) or ``lat`` (over y_km).

    Points may be unevenly spaced; the ends use the one-sided three-point formula. Rows of a line with fewer than
    three points have NULL, and so has a cell with a missing neighbour.
    """
    along, across, x = ("i_lon", "i_lat", "x_km") if axis == "lon" else ("i_lat", "i_lon", "y_km")
    line = Window.partitionBy(*keys, across)
    w = line.orderBy(along)

    def at(c: str, k: int) -> Column:
        """Value k places on, NULL unless that place is the neighbouring index."""
        f, i = (F.lead, k) if k > 0 else (F.lag, -k)
        return F.when(f(along, i).over(w) == F.col(along) + k, f(c, i).over(w))

    d = field.withColumns({f"__{n}": at(c, k) for n, c, k in (("y1", value, 1), ("y2", value, 2), ("z1", value, -1), ("z2", value, -2), ("x1", x, 1), ("x2", x, 2), ("w1", x, -1), ("w2", x, -2))} | {"__lo": F.min(along).over(line), "__hi": F.max(along).over(line)})
    y, p = F.col(value), F.col(x)

    def middle() -> Column:
        hl, hr = p - F.col("__w1"), F.col("__x1") - p
        return (hl * hl * F.col("__y1") + (hr * hr - hl * hl) * y - hr * hr * F.col("__z1")) / (hl * hr * (hl + hr))

    def end(y1: str, y2: str, x1: str, x2: str) -> Column:
        h1, h2 = F.col(x1) - p, F.col(x2) - F.col(x1)
        return -(2 * h1 + h2) / (h1 * (h1 + h2)) * y + (h1 + h2) / (h1 * h2) * F.col(y1) - h1 / (h2 * (h1 + h2)) * F.col(y2)

    found = F.when(F.col(along) == F.col("__lo"), end("__y1", "__y2", "__x1", "__x2")).when(F.col(along) == F.col("__hi"), end("__z1", "__z2", "__w1", "__w2")).otherwise(middle())
    return d.withColumn(out, found).drop(*[f"__{n}" for n in ("y1", "y2", "z1", "z2", "x1", "x2", "w1", "w2", "lo", "hi")])


def laplacian(field: DataFrame, value: str = "value", out: str = "laplacian", keys: tuple[str, ...] = FIELD) -> DataFrame:
    """``field`` with the sum of its second derivatives along both axes."""
    d = field
    for axis in ("lon", "lat"):
        d = gradient(gradient(d, axis, value, f"__g_{axis}", keys), axis, f"__g_{axis}", f"__h_{axis}", keys)
    return d.withColumn(out, F.col("__h_lon") + F.col("__h_lat")).drop("__g_lon", "__g_lat", "__h_lon", "__h_lat")


def adjacent_to_null(field: DataFrame, value: str = "value", keys: tuple[str, ...] = FIELD) -> DataFrame:
    """``field`` with ``adjacent``: a finite cell beside a missing one (NULL). Beyond the border nothing is missing; ``field`` has a row for every cell."""
    missing = F.col(value).isNull()
    d = field.withColumn("__m", missing.cast("int"))
    row, column = Window.partitionBy(*keys, "i_lat").orderBy("i_lon"), Window.partitionBy(*keys, "i_lon").orderBy("i_lat")
    beside = sum((f("__m", 1, 0).over(w) for w in (row, column) for f in (F.lag, F.lead)), F.lit(0))
    return d.withColumn("adjacent", ~missing & (beside > 0)).drop("__m")


def full_grid(field: DataFrame, n_lat: int, n_lon: int, dx: float = 10.0, dy: float = 10.0, keys: tuple[str, ...] = FIELD) -> DataFrame:
    """``field`` with a row for every cell of an n_lat x n_lon grid; absent ones are NULL."""
    axes = field.sparkSession.range(n_lat * n_lon).select((F.col("id") / n_lon).cast("int").alias("i_lat"), (F.col("id") % n_lon).cast("int").alias("i_lon"))
    every = field.select(*keys).distinct().crossJoin(bounded(axes))
    return every.join(field.drop("x_km", "y_km"), [*keys, "i_lat", "i_lon"], "left").withColumns({"x_km": F.col("i_lon") * dx, "y_km": F.col("i_lat") * dy})
