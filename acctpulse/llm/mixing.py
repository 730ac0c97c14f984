"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time t from 0 to 1. Its
integral is the source's cumulative token demand. Documents of a source stand
in a fixed pseudo-random order, repeated as often as the target asks; the
demand inverted at a document's cumulative tokens is the time at which it is
due. Sorting by that time by range gives the training order.

Built-in expressions only. Running sums never put a source into one task: each
source is cut into 65,536 slices by the leading hexadecimal digits of its
documents' order key; a small table holds the slices' sums, and rows only meet
the rows of their own slice. Only the table with one row per source is ranked
in one task.

Defined results: a null text has size 0 and is never due; a null source is a
source of its own and comes last; rows that repeat a doc_id are separate
occurrences; an empty table gives no rows. Columns that start with ``mx_`` are
taken, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctpulse.llm.words import text_of, words_of
from acctpulse.session import materialize

#: Weights by the rank of the source, repeating, and how often a document may be repeated.
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Share of a source's schedule at the start; it changes linearly, its mean is 1. By the same rank as the weights: the
#: first fades out, the last fades in.
START = (1.5, 1.0, 0.5)
SLICE_DIGITS = 4


def size_of(text: str = "text") -> Column:
    """Words of a text."""
    return F.size(words_of(text_of(text))).cast("long")


def order_key(doc_id: str = "doc_id") -> Column:
    """Where a document stands in its source: pseudo-random, and the same in every run."""
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def source_key(source: str = "source") -> Column:
    """The source as a key that is never null and sorts by code point, the null source last."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("t"))


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source of (mx_source, mx_total): its target and the start of its schedule.

    Sources share all words by weight; none gets more than MAX_REPEATS times
    its size, and what it cannot take goes to the others by weight. Sources fill
    up in the order of size per weight, so the shares follow from running sums:
    with the k sources that fill first taken out, the rest divides what is left.
    One row per source is all that this task ever holds.
    """
    by_name = Window.orderBy("mx_source")
    ranked = sizes.withColumn("mx_rank", F.row_number().over(by_name) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.col("mx_rank") % len(WEIGHTS))
    start = F.get(F.array(*[F.lit(s) for s in START]), F.col("mx_rank") % len(START))
    rows = ranked.withColumns({"mx_weight": weight, "mx_start": start, "mx_cap": (F.col("mx_total") * MAX_REPEATS).cast("double")})
    fills = Window.orderBy(F.col("mx_cap") / F.col("mx_weight"), "mx_rank")
    before, after = fills.rowsBetween(Window.unboundedPreceding, -1), fills.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns(
        {
            "mx_all": F.sum("mx_total").over(everyone).cast("double"),
            "mx_full": F.coalesce(F.sum("mx_cap").over(before), F.lit(0.0)),
            "mx_rest": F.sum("mx_weight").over(after),
        }
    )
    share = (F.col("mx_all") - F.col("mx_full")) / F.col("mx_rest")
    # Words per weight once nobody else fills up: that of the first source, in this order, that its share does not fill.
    # From there on shares only fall.
    level = F.max(F.when(F.col("mx_cap") >= share * F.col("mx_weight"), share)).over(everyone)
    target = F.least(F.col("mx_cap"), level * F.col("mx_weight"))
    return rows.select("mx_source", "mx_total", "mx_start", F.coalesce(target, F.col("mx_cap")).alias("mx_target"))


def due(done: Column, target: Column, start: Column) -> Column:
    """The time at which a source's demand reaches ``done`` tokens.

    Demand is target * (a t + (1 - a) t^2) for a schedule a + 2 (1 - a) t; this
    is its inverse, in the form that also holds for a = 1.
    """
    u = F.try_divide(done, target)
    return (F.lit(2.0) * u) / (start + F.sqrt(start * start + F.lit(4.0) * (F.lit(1.0) - start) * u))


def mix(docs: DataFrame, size: str, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Every row with mx_total and mx_target of its source, mx_taken words and mx_times, the times at which it is due.

    ``size`` names the column with a document's words. An occurrence is taken if
    its middle lies before the target, so a source's words are off by half a
    document at most.
    """
    held = docs.withColumns(
        {"mx_key": order_key(doc_id), "mx_source": source_key(source), "mx_slice": F.substring(order_key(doc_id), 1, SLICE_DIGITS)}
    )
    sums = materialize(
        held.groupBy("mx_source", "mx_slice").agg(F.sum(size).cast("long").alias("mx_sum")), "slice_sums"
    )
    goals = targets(sums.groupBy("mx_source").agg(F.sum("mx_sum").alias("mx_total")))
    slices = Window.partitionBy("mx_source").orderBy("mx_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("mx_offset", F.coalesce(F.sum("mx_sum").over(slices), F.lit(0))).alias("s")
    goals = materialize(
        offsets.join(goals.alias("g"), F.col("s.mx_source") == F.col("g.mx_source")).select(
            F.col("s.mx_source").alias("mx_s"), F.col("s.mx_slice").alias("mx_c"), "mx_offset", "mx_total", "mx_start", "mx_target"
        ),
        "slice_targets",
    )
    inside = Window.partitionBy("mx_source", "mx_slice").orderBy("mx_key", doc_id, size).rowsBetween(Window.unboundedPreceding, -1)
    rows = held.withColumn("mx_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    rows = rows.join(goals, (F.col("mx_source") == F.col("mx_s")) & (F.col("mx_slice") == F.col("mx_c")))
    middle = lambda k: (
        (F.lit(k) * F.col("mx_total") + F.col("mx_offset") + F.col("mx_inside")).cast("double") + F.col(size) / F.lit(2.0)
    )
    times = F.array(*[due(middle(k), F.col("mx_target"), F.col("mx_start")) for k in range(MAX_REPEATS)])
    taken = F.filter(
        F.arrays_zip(F.array(*[middle(k) for k in range(MAX_REPEATS)]).alias("m"), times.alias("t")),
        lambda x: (x["m"] < F.col("mx_target")) & (F.col(size) > 0),
    )
    return (
        rows.withColumn("mx_times", F.transform(taken, lambda x: x["t"]))
        .withColumn("mx_taken", (F.col(size) * F.size("mx_times")).cast("long"))
        .drop("mx_key", "mx_slice", "mx_source", "mx_inside", "mx_s", "mx_c", "mx_offset", "mx_start")
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per occurrence, in the order of training: ``mx_at`` (0 to 1) and ``mx_epoch`` from 0, sorted by range."""
    each = mixed.select("*", F.posexplode("mx_times").alias("mx_epoch", "mx_at")).drop("mx_times")
    return each.orderBy("mx_at", "mx_epoch")
