"""Mixing sources to target weights by Pareto order sampling.

A document's expected number of copies is its source's target over its source's size (or follows a
per-document importance). Its whole part is taken for certain; for the rest, documents of a source are
ranked by random odds divided by inclusion odds, and the front of that order is taken up to the words
that the target still needs.

Defined results: null and blank texts have no words and add nothing; a null source is a source of its
own, last in order; rows of a source that agree in id and size stand at one place of the order, and where the cut falls
among them, as many as the need calls for are taken, in the order in which they are stored; an empty table gives an empty
mix; columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tuneloom.llm.common import stored, word_count

LEVELS = (1024, 1024)  # buckets of the Pareto order, counted before any row is ordered


def water_fill(parts: DataFrame, group: list[str], total: str, capacity: str, weight: str) -> DataFrame:
    """Adds ``filled``: ``total`` shared by ``weight`` in each group, cut at ``capacity``, the excess reshared.

    Parts reach their capacity in the order of capacity over weight, so one pass in that order finds
    the level at which the others stand.
    """
    order = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.col(capacity) / F.col(weight), weight)
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.col(total) - F.coalesce(F.sum(capacity).over(before), F.lit(0.0))
    level = left / (F.sum(weight).over(everything) - F.coalesce(F.sum(weight).over(before), F.lit(0.0)))
    parts = parts.withColumn("__level", level).withColumn("__full", F.col("__level") * F.col(weight) > F.col(capacity))
    open_level = F.max(F.when(~F.col("__full"), F.col("__level"))).over(everything)
    filled = F.when(F.col("__full"), F.col(capacity)).otherwise(F.least(F.col(capacity), open_level * F.col(weight)))
    return parts.withColumn("filled", filled.cast("double")).drop("__level", "__full")


def cycle_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``source, source_size`` plus ``target``: weights repeat along the sources' code point order, null last."""
    ranked = sizes.withColumn("__nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("__nth") % len(cycle) + 1).cast("int"))
    parts = (
        ranked.withColumn("__weight", weights)
        .withColumn("__room", most * F.col("source_size"))
        .withColumn("__total", F.sum(F.col("source_size").cast("double")).over(Window.partitionBy(F.lit(0))))
    )
    return water_fill(parts, [], "__total", "__room", "__weight").select("source", "source_size", F.col("filled").alias("target"))


def chance(seed: int, *columns: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the columns alone."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def _plan(docs: DataFrame, sizes: Column, source: str, doc_id: str, targets, most: float, importance: str | None, seed: int):
    """The narrow rows with their order, and per source and importance what decides over a row."""
    worth = F.col(importance).cast("double") if importance else F.lit(1.0)
    narrow = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), sizes.alias("size"), worth.alias("worth")), "mix-sizes")
    classes = narrow.groupBy("source", "worth").agg(F.sum("size").alias("class_size"))
    goal = targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")))
    parts = (
        classes.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")))
        .select("c.source", "worth", "class_size", "source_size", "target")
        .withColumn("__room", most * F.col("class_size"))
        .withColumn("__weight", F.col("worth") * F.col("class_size"))
    )
    # The copies of a class: what it is given over what it has.
    rates = water_fill(parts.filter("class_size > 0 and worth > 0"), ["source"], "target", "__room", "__weight")
    rates = rates.withColumn("copies", F.col("filled") / F.col("class_size"))
    rates = stored(rates.select("source", "worth", "class_size", "source_size", "target", F.floor("copies").alias("whole"),
                                (F.col("copies") - F.floor("copies")).alias("part")), "mix-rates")
    ordered = _ranked(narrow.filter("size > 0"), rates, seed).filter("part > 0")
    need = rates.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("class_size"))).alias("need"))
    return narrow, rates, stored(_cuts(ordered, need), "mix-cuts")


def _ranked(rows: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """Rows with their class's rates and ``q``, the Pareto order squeezed into (0, 1)."""
    joined = rows.alias("r").join(rates.alias("k"), F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r.worth") == F.col("k.worth")), "left")
    u = chance(seed, F.col("r.doc_id"), F.col("r.size"))
    ratio = (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))
    return joined.select("r.*", "source_size", "target", "whole", "part", F.when(F.col("part") > 0, ratio / (1 + ratio)).alias("q"))


def _cuts(ordered: DataFrame, need: DataFrame) -> DataFrame:
    """Per source the last row of the order that is taken: ``cut_q, cut_id, cut_size`` (null: none is).

    Words per bucket of the order find the bucket that holds the cut, then again inside that bucket;
    only the rows of the last bucket are put in order one by one.
    """
    rows, state = ordered.select("source", "q", "doc_id", "size"), need.withColumn("lo", F.lit(0.0)).withColumn("below", F.lit(0).cast("long"))
    width = 1.0
    for level, buckets in enumerate(LEVELS):
        width /= buckets
        bucket = F.least(F.floor((F.col("q") - F.col("lo")) / F.lit(width)), F.lit(buckets - 1))
        inside = rows if level == 0 else _within(rows, state, width * buckets)
        counted = (inside if level else inside.withColumn("lo", F.lit(0.0))).groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("words"))
        up_to = F.sum("words").over(Window.partitionBy("source").orderBy("b"))
        joined = counted.withColumn("up_to", up_to).alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
        # The first bucket that reaches the need; the last one where rounding leaves none.
        reached = F.col("below") + F.col("up_to") >= F.col("need")
        first = joined.groupBy("s.source").agg(
            F.first("need").alias("need"), F.first("lo").alias("lo"), F.first("below").alias("below"),
            F.min(F.when(reached, F.col("b"))).alias("hit"), F.max("b").alias("end"),
            F.sum(F.when(~reached, F.col("words"))).alias("under"), F.sum("words").alias("all_words"), F.max_by("words", "b").alias("end_words"),
        )
        under = F.when(F.col("hit").isNull(), F.col("all_words") - F.col("end_words")).otherwise(F.coalesce(F.col("under"), F.lit(0)))
        state = first.select("source", "need", (F.col("lo") + F.coalesce("hit", "end") * F.lit(width)).alias("lo"), (F.col("below") + under).alias("below"))
        state = stored(state, "mix-cut")
    last = _within(rows, state, width)
    ties = last.groupBy("source", "q", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows"), F.first("lo").alias("lo"), F.first("below").alias("below"), F.first("need").alias("need"))
    earlier = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("below") + F.coalesce(F.sum(F.col("rows") * F.col("size")).over(earlier), F.lit(0))
    # A row is taken if that brings the words nearer to the need than leaving it; of equal rows, as many as that holds for.
    room = F.floor((F.col("need") - ahead) / F.col("size") + 0.5)
    ties = ties.withColumn("taken", F.least(room, F.col("rows"))).filter("taken > 0")
    cuts = ties.groupBy("source").agg(F.max_by(F.struct("rows", "taken"), F.struct("q", "doc_id", "size")).alias("tied"), F.max(F.struct("q", "doc_id", "size")).alias("cut"))
    return state.alias("s").join(cuts.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left").select(
        F.col("s.source").alias("source"), F.col("s.lo").alias("cut_lo"), "cut", F.col("tied.rows").alias("tied_rows"), F.col("tied.taken").alias("tied_taken"))


def _first_ties(at_cut: DataFrame) -> DataFrame:
    """``at_cut``, rows that stand at their source's cut, with ``copies`` raised by one for the first ``tied_taken`` of each source.

    The rows are written first: numbers within a file and offsets of the files make their order, so that no task
    holds all equal rows and a repeated task numbers them alike.
    """
    held = stored(at_cut, "mix-ties").withColumn("__file", F.col("_metadata.file_name")).withColumn("__at", F.col("_metadata.row_index"))
    files = held.groupBy("source", "__file").count()
    before = F.sum("count").over(Window.partitionBy("source").orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select(F.col("source").alias("__source"), F.col("__file").alias("__name"), F.coalesce(before, F.lit(0)).alias("__before"))
    joined = held.join(files, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__file") == F.col("__name")))
    nth = F.col("__before") + F.row_number().over(Window.partitionBy("source", "__file").orderBy("__at"))
    return joined.withColumn("copies", F.col("copies") + (nth <= F.col("tied_taken")).cast("int")).select(at_cut.columns)


def _within(rows: DataFrame, state: DataFrame, width: float) -> DataFrame:
    """Rows of the bucket that starts at each source's ``lo``."""
    joined = rows.alias("r").join(state.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    return joined.filter((F.col("q") >= F.col("lo")) & (F.col("q") < F.col("lo") + F.lit(width))).select("r.*", "lo", "below", "need")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", targets=cycle_targets,
        most: float = 3.0, importance: str | None = None, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``; ``copies`` says how often the mix holds a row.

    ``targets`` turns ``source, source_size`` into targets in words, none above ``most`` times its source.
    ``importance`` names a column of relative inclusion chances inside a source, with few distinct values.
    ``keep`` limits the columns that are carried along.
    """
    sizes = word_count(F.col(text))
    _, rates, cuts = _plan(docs, sizes, source, doc_id, targets, most, importance, seed)
    worth = F.col(importance).cast("double") if importance else F.lit(1.0)
    row = F.struct(*[F.col(c) for c in (keep if keep is not None else docs.columns)])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), sizes.alias("size"), worth.alias("worth"), row.alias("row"))
    ranked = _ranked(rows, rates, seed).alias("r").join(cuts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")), "left")
    place = F.struct(F.col("q"), F.col("doc_id"), F.col("size"))
    parted = F.coalesce((F.col("tied_taken") < F.col("tied_rows")) & place.eqNullSafe(F.col("cut")), F.lit(False))
    picked = (F.col("q") < F.col("cut_lo")) | (F.coalesce(place <= F.col("cut"), F.lit(False)) & ~parted)
    copies = F.coalesce(F.col("whole"), F.lit(0)) + F.coalesce(picked, F.lit(False)).cast("int")
    copies = F.when(F.col("size") > 0, copies).otherwise(0).cast("int")
    chosen = ranked.select(F.col("r.source").alias("source"), F.col("r.row").alias("row"), F.col("r.size").alias("size"), F.coalesce("source_size", F.lit(0)).alias("source_size"),
                           F.coalesce("target", F.lit(0.0)).alias("target"), copies.alias("copies"), "tied_taken", parted.alias("parted"))
    # One row per source; only a source whose cut falls among equal rows has to number them.
    if not cuts.filter("tied_taken < tied_rows").isEmpty():
        chosen = chosen.filter("not parted").unionByName(_first_ties(chosen.filter("parted")))
    return chosen.select("row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
