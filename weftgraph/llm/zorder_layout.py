"""A clustered layout in many dimensions: rows in the order of interleaved coordinates, cells as intervals of positions.

A value's coordinate is floor(2**bits * s / n), where s of the n rows have a smaller value.  Counts by value are summed in two levels
(within ranges of values, then over a fixed number of ranges), and what comes back is the smallest value of each coordinate:
at most 2**bits a dimension, so rows get their coordinates by comparing, without a join.

z interleaves the coordinates' digits.  Rows are sorted by (z, key) over ranges; counts by (z, range) are summed in two levels as well, so
each cell is an interval of positions, hence of files.  All that files are asked for follows from the cells, of which there are at most
2**(bits * dimensions) whatever the corpus: a file inside one cell has that cell's bounds, and only the first and last files of
cells are shared with others.  ``files_matching`` is the size of the union of the file intervals of neighbouring cells, merged in order;
``files_touched`` adds up the files of equal bounds that a bounds join finds for a cell's query.  Rows then meet their cell by (z, range).

Nulls are smallest; strings compare by UTF-8 bytes; equal rows get consecutive positions; an empty table gives no rows;
other columns are ignored by ``place`` and kept by ``write_layout``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Ranges of values: fixed, so that sums over ranges have a bound.
_RANGES = 200


@dataclass(frozen=True)
class Dimension:
    """A column to order by, and how far a row's own query reaches along it."""

    name: str
    text: bool
    reach: int


@dataclass(frozen=True)
class Layout:
    dimensions: Sequence[Dimension]  #: as bounds are listed
    interleaved: Sequence[str]  #: from the highest digit on, each round
    bits: int = 4
    rows_per_file: int = 500

    def __post_init__(self):
        if sorted(self.interleaved) != sorted(d.name for d in self.dimensions):
            raise ValueError("every dimension is interleaved once")
        if all(d.reach for d in self.dimensions):
            raise ValueError("at least one dimension is asked for as it is: files meet queries by it")
        if self.bits * len(self.dimensions) > 20:
            raise ValueError("more than 2**20 cells")


def coordinate_starts(values: DataFrame, layout: Layout) -> dict[str, list[tuple[int, object]]]:
    """Of each dimension the (coordinate, smallest value that has it) that occur, ascending."""
    n = values.count()
    one = lambda k, d: F.struct(F.lit(k).alias("dim"), (F.col(d.name) if d.text else F.lit(None).cast("string")).alias("s"), (F.lit(None).cast("long") if d.text else F.col(d.name).cast("long")).alias("x"))
    key = ["dim", "s", "x"]
    counts = values.select(F.explode(F.array(*[one(k, d) for k, d in enumerate(layout.dimensions)])).alias("v")).select("v.*").groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.repartitionByRange(_RANGES, *key).sortWithinPartitions(*key).withColumn("range", F.spark_partition_id())
    ordered = shared.table(ordered, "value-counts")
    sums = ordered.groupBy("dim", "range").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("dim").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most _RANGES rows a dimension
    sums = sums.select("dim", "range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("dim", "range").orderBy("s", "x").rowsBetween(Window.unboundedPreceding, -1)
    smaller = ordered.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums.hint("merge"), ["dim", "range"])
    exact = F.expr(f"cast((base + inside) * {1 << layout.bits} div {max(n, 1)} as int)")
    starts = smaller.withColumn("c", exact).groupBy("dim", "c").agg(F.min(F.struct("s", "x")).alias("v"))
    out: dict[str, list[tuple[int, object]]] = {d.name: [] for d in layout.dimensions}
    for r in sorted(starts.collect(), key=lambda r: (r["dim"], r["c"])):  # at most 2**bits a dimension
        d = layout.dimensions[r["dim"]]
        out[d.name].append((r["c"], r["v"]["s"] if d.text else r["v"]["x"]))
    return out


def _coordinate(d: Dimension, starts: list[tuple[int, object]]) -> Column:
    """Nulls have the smallest coordinate; else the last one whose smallest value is not above the row's."""
    out = F.lit(starts[0][0] if starts else 0)
    for c, v in starts:
        if v is not None:
            out = F.when(F.col(d.name) >= F.lit(v), c).otherwise(out)
    return out.cast("int")


def interleave(layout: Layout, coordinate: dict[str, Column]) -> Column:
    z, place = F.lit(0).cast("long"), layout.bits * len(layout.interleaved)
    for bit in range(layout.bits - 1, -1, -1):
        for name in layout.interleaved:
            place -= 1
            z = z.bitwiseOR(F.shiftleft(F.shiftright(coordinate[name], bit).bitwiseAND(F.lit(1)).cast("long"), place))
    return z


def separate(layout: Layout, z: Column, name: str) -> Column:
    """The coordinate of a dimension, back from z."""
    k, width, out = list(layout.interleaved).index(name), len(layout.interleaved), F.lit(0).cast("long")
    for bit in range(layout.bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(z, bit * width + width - 1 - k).bitwiseAND(F.lit(1)), bit))
    return out.cast("int")


def _starts(counts: DataFrame, layout: Layout) -> DataFrame:
    """``counts`` of (z, range, n) with ``start``, the position at which each begins."""
    high = F.shiftright("z", max(0, layout.bits * len(layout.dimensions) - 8))
    counts = counts.withColumn("high", high)
    sums = counts.groupBy("high").agg(F.sum("n").alias("total"))  # at most 256 rows
    before = Window.orderBy("high").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("high", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("high").orderBy("z", "range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return counts.join(sums.hint("merge"), "high").select("z", "range", "n", (F.col("base") + F.col("inside")).alias("start"))


def _cells(starts: DataFrame, layout: Layout) -> DataFrame:
    """z, coordinates, first and last file of every cell that holds rows."""
    cells = starts.groupBy("z").agg(F.min("start").alias("start"), F.sum("n").alias("n"))
    file = lambda p: F.expr(f"cast(({p}) div {layout.rows_per_file} as bigint)")
    return cells.select("z", *[separate(layout, F.col("z"), d.name).alias(d.name) for d in layout.dimensions], file("start").alias("f0"), file("start + n - 1").alias("f1"))


def _neighbours(layout: Layout) -> Column:
    """The z of every cell that a cell's own query may hold."""
    side, out = (1 << layout.bits) - 1, F.array(F.struct(*[F.col(d.name).alias(d.name) for d in layout.dimensions]))

    def along(d: Dimension):
        steps = F.sequence(F.greatest(F.col(d.name) - d.reach, F.lit(0)), F.least(F.col(d.name) + d.reach, F.lit(side)))
        return lambda at: F.transform(steps, lambda x: F.struct(*[(x if e.name == d.name else at[e.name]).alias(e.name) for e in layout.dimensions]))

    for d in layout.dimensions:
        if d.reach:
            out = F.flatten(F.transform(out, along(d)))
    return F.transform(out, lambda at: interleave(layout, {d.name: at[d.name] for d in layout.dimensions}))


def _union_size(intervals: Column) -> Column:
    """Members of the union of sorted closed intervals."""
    begun = F.struct(F.lit(-1).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, i: F.struct(F.greatest(acc["to"], i["f1"]).alias("to"), (acc["n"] + F.greatest(i["f1"] - F.greatest(i["f0"] - 1, acc["to"]), F.lit(0))).alias("n"))
    return F.aggregate(intervals, begun, step, lambda acc: acc["n"])


def _matching(cells: DataFrame, layout: Layout) -> DataFrame:
    """(z, files_matching): neighbouring cells' file intervals, merged in order.  A cell has (2 reach + 1) neighbours along each dimension at most."""
    near = cells.select(F.col("z").alias("own"), F.explode(_neighbours(layout)).alias("z"))
    met = near.join(cells.select("z", "f0", "f1").hint("merge"), "z")
    return met.groupBy("own").agg(F.array_sort(F.collect_list(F.struct("f0", "f1"))).alias("i")).select(F.col("own").alias("z"), _union_size(F.col("i")).alias("files_matching"))


def _edge_files(cells: DataFrame, layout: Layout) -> DataFrame:
    """(file, bounds): of the files that are some cell's first or last, the smallest and largest coordinates of all their cells."""
    edges = cells.select(F.explode(F.array_distinct(F.array("f0", "f1"))).alias("file"), *[d.name for d in layout.dimensions])
    ends = [f(d.name).alias(f"{a}_{d.name}") for d in layout.dimensions for a, f in (("min", F.min), ("max", F.max))]
    return edges.groupBy("file").agg(*ends)


def _touched(cells: DataFrame, edges: DataFrame, layout: Layout) -> DataFrame:
    """(z, files_touched): files of equal bounds are one row with their number; they meet the cells' queries by the dimensions without reach, then by comparing bounds."""
    names = [f"{a}_{d.name}" for d in layout.dimensions for a in ("min", "max")]
    inner = cells.where(F.col("f1") - F.col("f0") >= 2).select(*[F.col(d.name).alias(f"{a}_{d.name}") for d in layout.dimensions for a in ("min", "max")], (F.col("f1") - F.col("f0") - 1).alias("files"))
    boxes = inner.unionByName(edges.select(*names, F.lit(1).cast("long").alias("files"))).groupBy(*names).agg(F.sum("files").alias("files"))
    exact, ranged = [d for d in layout.dimensions if not d.reach], [d for d in layout.dimensions if d.reach]
    for d in exact:
        boxes = boxes.withColumn(d.name, F.explode(F.sequence(f"min_{d.name}", f"max_{d.name}")))
    meets = F.lit(True)
    for d in ranged:
        meets = meets & (F.col(f"min_{d.name}") <= F.col(f"q_{d.name}") + d.reach) & (F.col(f"max_{d.name}") >= F.col(f"q_{d.name}") - d.reach)
    asked = cells.select("z", *[d.name for d in exact], *[F.col(d.name).alias(f"q_{d.name}") for d in ranged])
    met = asked.join(boxes.hint("merge"), [d.name for d in exact])
    return met.where(meets).groupBy("z").agg(F.sum("files").alias("files_touched"))


def place(values: DataFrame, layout: Layout, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``key``, z, position, file, file_bounds, files_touched and files_matching of each row of ``values`` (``key`` and the dimensions' columns)."""
    spark = values.sparkSession
    values = shared.table(values.select(*key, *[d.name for d in layout.dimensions]), "layout-values")
    starts = coordinate_starts(values, layout)
    z = interleave(layout, {d.name: _coordinate(d, starts[d.name]) for d in layout.dimensions})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The number of a row within its range is what the identifier holds under its 33 lowest bits.
    sorted_rows = values.select(*key, z.alias("z")).repartitionByRange(n, "z", *key).sortWithinPartitions("z", *key).withColumn("_id", F.monotonically_increasing_id())
    rows = shared.table(sorted_rows.select(*key, "z", F.shiftright("_id", 33).alias("range"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_k")), "layout-order")
    counts = rows.groupBy("z", "range").agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("_first"))
    begun = shared.table(_starts(counts.select("z", "range", "n"), layout), "cell-starts")
    cells = shared.table(_cells(begun, layout), "cells")
    edges = shared.table(_edge_files(cells, layout), "edge-files")
    ends = [f"{a}_{d.name}" for d in layout.dimensions for a in ("min", "max")]
    text = lambda cols: F.concat_ws(",", *[F.col(c).cast("string") for c in cols])
    bounds = edges.select("file", text(ends).alias("bounds"))
    own = cells.select("z", "f0", "f1", text([d.name for d in layout.dimensions for _ in (0, 1)]).alias("own"))
    own = own.join(bounds.select(F.col("file").alias("f0"), F.col("bounds").alias("b0")).hint("merge"), "f0").join(bounds.select(F.col("file").alias("f1"), F.col("bounds").alias("b1")).hint("merge"), "f1")
    cell = own.join(_matching(cells, layout).hint("merge"), "z").join(_touched(cells, edges, layout).hint("merge"), "z")
    runs = counts.select("z", "range", "_first").join(begun.select("z", "range", "start").hint("merge"), ["z", "range"]).join(cell.hint("merge"), "z")
    met = rows.join(runs.hint("merge"), ["z", "range"]).withColumn("position", F.col("start") + F.col("_k") - F.col("_first"))
    met = met.withColumn("file", F.expr(f"cast(position div {layout.rows_per_file} as bigint)"))
    file_bounds = F.when(F.col("file") == F.col("f0"), F.col("b0")).when(F.col("file") == F.col("f1"), F.col("b1")).otherwise(F.col("own"))
    return met.select(*key, "z", "position", "file", file_bounds.alias("file_bounds"), "files_touched", "files_matching")


def document_values(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, length (UTF-8 bytes of the text, -1 without) and date (crc32 of the decimal doc_id modulo 365; null without doc_id) of documents."""
    length = F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", length.alias("length"), (F.crc32(F.col("doc_id").cast("string")) % 365).alias("date"))


#: Sources and languages are asked for as they are, lengths and dates with two coordinates on either side.
DOCUMENTS = Layout(
    [Dimension("source", True, 0), Dimension("lang", True, 0), Dimension("length", False, 2), Dimension("date", False, 2)],
    ["length", "source", "date", "lang"],
)


def write_layout(docs: DataFrame, folder: str, layout: Layout = DOCUMENTS, values=document_values) -> DataFrame:
    """Writes all columns of ``docs``, whose doc_id must be unique, clustered: a folder file=<k> for each file, rows in the order of positions.  Returns file, its rows and file_bounds."""
    where = place(values(docs), layout).select("doc_id", F.col("position").alias("_position"), "file", "file_bounds")
    if {"file", "_position"} & set(docs.columns):
        raise ValueError("columns named file or _position must be renamed before")
    placed = docs.join(where.drop("file_bounds").hint("merge"), "doc_id")
    placed.repartitionByRange("file").sortWithinPartitions("file", "_position").write.partitionBy("file").parquet(folder)
    return where.groupBy("file", "file_bounds").agg(F.count(F.lit(1)).alias("n_rows"))


def read_files(spark: SparkSession, folder: str, manifest: DataFrame, box: dict[str, tuple[int, int]], layout: Layout = DOCUMENTS) -> DataFrame:
    """The rows of the files whose bounds meet ``box`` (closed coordinate ranges by dimension); other files are not opened."""
    ends = F.transform(F.split("file_bounds", ","), lambda x: x.cast("int"))
    meets = F.lit(True)
    for k, d in enumerate(layout.dimensions):
        if d.name in box:
            low, high = box[d.name]
            meets = meets & (F.element_at(ends, 2 * k + 1) <= high) & (F.element_at(ends, 2 * k + 2) >= low)
    return spark.read.parquet(folder).join(manifest.where(meets).select("file"), "file", "left_semi")
