"""Genomic intervals: half-open [start, end) on a chromosome.

Merging, nearest and counting are running aggregates along the chromosome. A chromosome
with most of the rows is cut into position slices, so none of them needs a chromosome in
one task or a pair per overlap.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.ordered import quantile_slices, running


def centers(df: DataFrame, start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """One-base interval in the middle."""
    middle = F.floor((F.col(start) + F.col(end)) / 2).cast("int")
    return df.withColumns({start: middle, end: middle + 1})


def expand(df: DataFrame, by: int, lengths: Mapping[str, int] | None = None, start: str = "start_pos",
           end: str = "end_pos") -> DataFrame:
    """Widen both ways, not below zero nor beyond the chromosome's length where it is known."""
    hi = F.col(end) + F.lit(by)
    if lengths:
        limit = F.create_map(*[x for c, n in lengths.items() for x in (F.lit(c), F.lit(int(n)))])
        hi = F.least(hi, limit[F.col("chrom")])
    return df.withColumns({start: F.greatest(F.col(start) - F.lit(by), F.lit(0)), end: hi})


def merge(df: DataFrame, slices: int | None = None) -> DataFrame:
    """Disjoint union of the intervals: overlapping and touching ones become one."""
    ends = df.groupBy("chrom", "start_pos").agg(F.max("end_pos").alias("end_pos"))
    ends, slice_col = quantile_slices(ends, "start_pos", slices, df)
    order = [F.col("start_pos")]
    seen = running(ends, ["chrom"], order, {"_reach": ("max", "end_pos")}, slice_col, before=True)
    fresh = F.col("_reach").isNull() | (F.col("start_pos") > F.col("_reach"))
    islands = running(seen.withColumn("_new", fresh.cast("int")), ["chrom"], order, {"_island": ("sum", "_new")}, slice_col)
    return islands.groupBy("chrom", "_island").agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("_island")


def nearest(queries: DataFrame, targets: DataFrame, label: str, slices: int | None = None) -> DataFrame:
    """Add the nearest target's label, start, end and distance in bases (0 when they overlap).

    Of targets starting at or before the query, the one reaching furthest is the candidate;
    of later ones, the first. The earlier candidate wins a tie. Targets may overlap.
    """
    cols = queries.columns
    body = F.struct(*cols)
    blank = F.lit(None).cast(queries.select(body.alias("q")).schema["q"].dataType.simpleString())
    kind = targets.schema[label].dataType.simpleString()
    end = F.col("end_pos").cast("long")
    begin = F.col("start_pos").cast("long")
    left_type = f"struct<end:bigint,neg:bigint,label:{kind}>"
    right_type = f"struct<neg:bigint,end:bigint,label:{kind}>"
    t = targets.select(
        "chrom", begin.alias("pos"), F.lit(0).alias("phase"), blank.alias("q"),
        F.struct(end.alias("end"), (-begin).alias("neg"), F.col(label).alias("label")).cast(left_type).alias("l"),
        F.struct((-begin).alias("neg"), end.alias("end"), F.col(label).alias("label")).cast(right_type).alias("r"))
    q = queries.select(
        "chrom", begin.alias("pos"), F.lit(1).alias("phase"), body.alias("q"),
        F.lit(None).cast(left_type).alias("l"), F.lit(None).cast(right_type).alias("r"))
    line, slice_col = quantile_slices(t.unionByName(q), "pos", slices, q)
    fwd = running(line, ["chrom"], [F.col("pos"), F.col("phase")], {"left": ("max", "l")}, slice_col)
    fwd = fwd.withColumns({"_pos": -F.col("pos"), "_phase": -F.col("phase")})
    if slice_col:
        fwd = fwd.withColumn(slice_col, -F.col(slice_col))
    both = running(fwd, ["chrom"], [F.col("_pos"), F.col("_phase")], {"right": ("max", "r")}, slice_col, before=True)
    rows = both.filter("phase = 1").select(F.col("q.*"), "left", "right")
    gap_l = F.greatest(F.col("start_pos") - F.col("left.end") + 1, F.lit(0))
    gap_l = F.when(F.col("left.end") > F.col("start_pos"), F.lit(0)).otherwise(gap_l)
    start_r = -F.col("right.neg")
    gap_r = F.when(start_r < F.col("end_pos"), F.lit(0)).otherwise(start_r - F.col("end_pos") + 1)
    rows = rows.withColumns({"_gl": gap_l, "_gr": gap_r})
    use_left = F.col("left").isNotNull() & (F.col("right").isNull() | (F.col("_gl") <= F.col("_gr")))
    pick = lambda a, b: F.when(use_left, a).when(F.col("right").isNotNull(), b)
    return rows.select(
        *cols,
        pick(F.col("left.label"), F.col("right.label")).alias(label),
        pick(-F.col("left.neg"), start_r).alias("near_start"),
        pick(F.col("left.end"), F.col("right.end")).alias("near_end"),
        pick(F.col("_gl"), F.col("_gr")).cast("long").alias("dist"),
    )


BIN_BITS = (14, 17, 20, 23, 26, 29, 32)  # widths of bins, each eight of the one before
CROWD = 100_000  # left rows of a bin that are joined in one piece


def _bins(df: DataFrame, bits: Sequence[int]) -> DataFrame:
    """Add the level and number of the smallest bin that holds the whole interval."""
    first = lambda b: F.shiftright(F.col("start_pos").cast("long"), b)
    last = lambda b: F.shiftright(F.col("end_pos").cast("long") - 1, b)
    level = F.lit(len(bits))
    for k in reversed(range(len(bits))):
        level = F.when(first(bits[k]) == last(bits[k]), k).otherwise(level)
    df = df.withColumn("_level", level)
    number = F.lit(0).cast("long")  # beyond the widest: one bin a chromosome
    for k, b in enumerate(bits):
        number = F.when(F.col("_level") == k, first(b)).otherwise(number)
    return df.withColumn("_bin", number)


def _above(df: DataFrame, bits: Sequence[int], own: bool) -> DataFrame:
    """A row for each bin around the own one, and for the own one when asked."""
    start = F.col("start_pos").cast("long")
    around = F.array(*[F.struct(F.lit(k).alias("_at"), F.shiftright(start, b).alias("_in")) for k, b in enumerate(bits)],
                     F.struct(F.lit(len(bits)).alias("_at"), F.lit(0).cast("long").alias("_in")))
    wider = F.filter(around, lambda x: (x["_at"] >= F.col("_level")) if own else (x["_at"] > F.col("_level")))
    return df.withColumn("_x", F.explode(wider)).withColumns({"_level": F.col("_x._at"), "_bin": F.col("_x._in")}).drop("_x")


def overlap_join(left: DataFrame, right: DataFrame, columns: Sequence[str], bits: Sequence[int] = BIN_BITS, crowd: int = CROWD) -> DataFrame:
    """Every overlapping pair: the left row and the named right columns.

    Bins come in several widths, and an interval lives in the smallest that holds it. Two
    intervals can only overlap where the bin of one is that of the other or lies around it,
    so each side is joined once as it lives with the other in its own and all wider bins: a
    row takes as many keys as there are widths, however long it is. A bin where more than
    ``crowd`` left rows meet is cut into pieces, and its right rows are repeated for each.
    """
    key = ["chrom", "_level", "_bin"]
    r = right.select("chrom", "start_pos", "end_pos", *columns)
    l_home, r_home = _bins(left, bits), _bins(r, bits)
    pairs = None
    for lb, rb in ((l_home, _above(r_home, bits, True)), (_above(l_home, bits, False), r_home)):
        crowded = lb.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / crowd).alias("_pieces")).filter("_pieces > 1")
        lb = lb.join(crowded, key, "left").withColumn("_piece", F.pmod(F.xxhash64(*left.columns), F.coalesce("_pieces", F.lit(1)))).drop("_pieces")
        rb = rb.join(crowded, key, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1)) - 1)))
        rb = rb.select(*key, "_piece", F.col("start_pos").alias("_rs"), F.col("end_pos").alias("_re"), *columns)
        part = lb.join(rb, [*key, "_piece"]).filter((F.col("start_pos") < F.col("_re")) & (F.col("_rs") < F.col("end_pos"))).select(*left.columns, *columns)
        pairs = part if pairs is None else pairs.unionByName(part)
    return pairs


def count_overlaps(queries: DataFrame, targets: DataFrame, name: str = "n", slices: int | None = None) -> DataFrame:
    """How many targets overlap each query interval, without forming the pairs.

    Targets starting before the query's end minus targets ending at or before its start.
    Repeated query rows come out once.
    """
    cols = queries.columns
    body = F.struct(*cols)
    blank = F.lit(None).cast(queries.select(body.alias("q")).schema["q"].dataType.simpleString())
    t = targets.groupBy("chrom", "start_pos", "end_pos").agg(F.count(F.lit(1)).alias("k")).select(
        "chrom", F.lit(1).alias("phase"), blank.alias("q"), F.inline(F.array(
            F.struct(F.col("start_pos").cast("long").alias("pos"), F.col("k").alias("starts"), F.lit(0).cast("long").alias("ends")),
            F.struct(F.col("end_pos").cast("long").alias("pos"), F.lit(0).cast("long").alias("starts"), F.col("k").alias("ends")))))
    q = queries.select("chrom", body.alias("q"), F.inline(F.array(
        F.struct(F.col("end_pos").cast("long").alias("pos"), F.lit(0).alias("phase")),
        F.struct(F.col("start_pos").cast("long").alias("pos"), F.lit(2).alias("phase"))))).withColumns(
        {"starts": F.lit(0).cast("long"), "ends": F.lit(0).cast("long")})
    line, slice_col = quantile_slices(t.unionByName(q), "pos", slices, q)
    sums = running(line, ["chrom"], [F.col("pos"), F.col("phase")],
                   {"s": ("sum", "starts"), "e": ("sum", "ends")}, slice_col).filter("phase <> 1")
    counts = sums.groupBy("q").agg(
        (F.max(F.when(F.col("phase") == 0, F.col("s"))) - F.max(F.when(F.col("phase") == 2, F.col("e")))).alias(name))
    return counts.select("q.*", name)
