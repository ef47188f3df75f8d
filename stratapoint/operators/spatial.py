"""Joins of patches by their boxes, and chipping of points into compact patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapoint.functions.geometry import Ring, box_intersects, polygon_box

#: A box that covers more cells than this is matched by one coarse key instead of many fine ones.
MAX_CELLS = 64


def _cells(box: Column, cell: float, level: Column, levels: int) -> Column:
    """The grid cells of a level that a box meets; a level's cells are 4^level as wide, and the last level is one cell."""
    side = F.lit(float(cell)) * F.pow(F.lit(4.0), level)
    at = lambda f: F.floor(box[f] / side)
    xs, ys = F.sequence(at("xmin"), at("xmax")), F.sequence(at("ymin"), at("ymax"))
    grid = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))
    zero = F.lit(0).cast("long")
    return F.when(level < levels, grid).otherwise(F.array(F.struct(zero.alias("cx"), zero.alias("cy"))))


def _level(box: Column, cell: float, levels: int) -> Column:
    """The least level at which a box meets at most MAX_CELLS cells."""
    out = F.lit(levels)
    for level in reversed(range(levels)):
        side = cell * 4**level
        n = (F.floor(box["xmax"] / side) - F.floor(box["xmin"] / side) + 1.0) * (F.floor(box["ymax"] / side) - F.floor(box["ymin"] / side) + 1.0)
        out = F.when(n <= MAX_CELLS, F.lit(level)).otherwise(out)
    return out


def overlap_join(left: DataFrame, right: DataFrame, left_box: Column, right_box: Column, cell: float, levels: int = 8) -> DataFrame:
    """Pairs of rows whose boxes meet (touching counts), each pair once; a null box meets nothing.

    Each box lives on the level of a grid where it meets few cells, the last level being one cell for boxes beyond any
    grid. A pair meets in cells of the coarser of its two levels: boxes of one side on their own level are joined with the
    boxes of the other side listed there (turn 1), and the other way round those below it (turn 2). Boxes that are both
    only listed in a coarse cell never meet there, and no box is listed on a level on which the other side has none (at
    most ``levels`` + 1 rows, broadcast). So it is an equi-join that Spark shuffles by cell and splits where a cell is hot.
    The corner of the common box says which cell reports a pair.
    """
    own = []
    # The generator keeps the optimizer from repeating a costly box expression in every use below.
    for df, box, p in ((left, left_box, "l"), (right, right_box, "r")):
        boxes = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(f"__{p}"), F.explode(F.array(box)).alias(f"__{p}box")).where(F.col(f"__{p}box.xmin").isNotNull())
        own.append(boxes.withColumn("__own", _level(F.col(f"__{p}box"), cell, levels)))
    used = [F.broadcast(x.select(F.col("__own").alias("level")).distinct().withColumn("used", F.lit(True))) for x in own]
    sides = []
    for x, other, p in ((own[0], used[1], "l"), (own[1], used[0], "r")):
        native, above = F.lit(1 if p == "l" else 2), F.lit(2 if p == "l" else 1)
        listed = F.transform(F.sequence("__own", F.lit(levels)), lambda k: F.struct(k.alias("level"), above.alias("turn")))  # noqa: B023
        if p == "l":
            listed = F.slice(listed, F.lit(2), F.lit(levels + 1))
        at = F.concat(F.array(F.struct(F.col("__own").alias("level"), native.alias("turn"))), listed)
        x = x.withColumn("__at", F.explode(at)).select("*", "__at.level", "__at.turn").join(other, "level", "left")
        x = x.where((F.col("turn") == native) | F.col("used"))
        sides.append(x.select(f"__{p}", f"__{p}box", "level", "turn", F.explode(_cells(F.col(f"__{p}box"), cell, F.col("level"), levels)).alias("__cell")).select(f"__{p}", f"__{p}box", "level", "turn", "__cell.cx", "__cell.cy"))
    a, b = sides
    joined = a.join(b, ["level", "turn", "cx", "cy"]).where(box_intersects(F.col("__lbox"), F.col("__rbox")))
    side = F.lit(float(cell)) * F.pow(F.lit(4.0), F.col("level"))
    first = (F.floor(F.greatest(F.col("__lbox.xmin"), F.col("__rbox.xmin")) / side) == F.col("cx")) & (F.floor(F.greatest(F.col("__lbox.ymin"), F.col("__rbox.ymin")) / side) == F.col("cy"))
    return joined.where(first | (F.col("level") == levels)).select(F.col("__l").alias("left"), F.col("__r").alias("right"))


def in_box(df: DataFrame, box: Column, ring: Ring) -> DataFrame:
    """Rows whose box meets a polygon's box: conjuncts on plain leaves, which a Parquet scan prunes by."""
    xmin, xmax, ymin, ymax = polygon_box(ring)
    return df.where((box["xmin"] <= xmax) & (box["xmax"] >= xmin) & (box["ymin"] <= ymax) & (box["ymax"] >= ymin))


def grid_key(x: Column, y: Column, cell: float) -> Column:
    """A cell number that keeps neighbours near in sort order: the bits of the two cell indexes interleaved."""
    cx, cy = F.floor(x / cell).cast("long"), F.floor(y / cell).cast("long")
    key = F.lit(0).cast("long")
    for bit in range(31):
        key = key.bitwiseOR(F.shiftleft(F.shiftright(cx, bit).bitwiseAND(F.lit(1)), 2 * bit)).bitwiseOR(F.shiftleft(F.shiftright(cy, bit).bitwiseAND(F.lit(1)), 2 * bit + 1))
    return key


def chip(df: DataFrame, x: Column, y: Column, cell: float, order: list[Column], capacity: int = 400, names: tuple[str, str, str] = ("cell", "part", "nth")) -> DataFrame:
    """Give every point a chip, two columns (cell key and number), of at most capacity neighbouring points, and its place in it.

    Points are numbered within a fine cell; a cell with more than capacity points makes several chips, so no patch grows
    with the data. Grouping by both columns needs no other shuffle than the numbering, and the place is all that a patch
    build needs to order by. The cell should be so fine that the points of one cell fit in a task.
    """
    keyed = df.withColumn(names[0], grid_key(x, y, cell))
    number = F.row_number().over(Window.partitionBy(names[0]).orderBy(*order)) - 1
    return keyed.withColumn("__number", number).withColumns({names[1]: F.floor(F.col("__number") / capacity).cast("long"), names[2]: F.col("__number") % capacity}).drop("__number")
