"""Exact interpolated quantiles of large or skewed groups, by distributed selection.

``F.percentile`` merges a value-to-count map of the whole group in one task.
That is fine where distinct values are few, and not for amounts over a whole
population. Here every wanted rank is bracketed, and the bracket is narrowed until
it holds few rows:

1. A KLL sketch per group, merged in two levels, proposes a bracket for each rank.
2. One aggregate counts what lies below and inside each bracket. No row is
   multiplied; every task sends one row per group.
3. A rank that its bracket misses moves the missed edge back to the bracket before.
   A bracket that holds more than MOST rows is sketched again, inside only; the
   mass of an edge value is cut off, so that ties cannot stop it.
4. Rows inside a bracket, and only these, meet their group in one window.

So at most MOST rows per rank, and one for each edge's value, reach a window, whatever the size of a
group, and the number of passes grows with the logarithm of that size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctpulse.session import discard, materialize

Wanted = list[tuple[int, tuple[int, float]]]  # number, (column, probability)
#: Size parameter of the sketches; their rank error is about 2.3 / ACCURACY**0.9.
ACCURACY = 4096
#: Rows of a bracket that need no further pass.
MOST = 20000
#: Steps of the ranks that a sketch is asked for.
GRID = 1024
#: Tasks whose sketches meet in one task of the first level.
FAN_IN = 64


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probabilities: Sequence[float],
    accuracy: int = ACCURACY,
    most: int = MOST,
) -> DataFrame:
    """One row per (key, metric, p): keys..., metric, p, q.

    NULL values are ignored; a (key, metric) with no value has no row. ``q`` is
    interpolated linearly between the two nearest ranks. NULL keys are a group.

    The rows are written once, as they are read several times; so are the brackets, one row per key and rank.
    """
    names = [f"v{i}" for i in range(len(columns))]
    inner = [f"k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, inner)], *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)]
    )
    rows = materialize(rows, "quantile_rows")
    wanted = list(enumerate(product(range(len(names)), [float(p) for p in probabilities])))
    inside = _inside(rows, inner, names, wanted, _narrowed(rows, inner, names, wanted, accuracy, most))
    upto = Window.partitionBy(*inner, "j").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.col("below") + F.sum("n").over(upto) - 1
    ranked = inside.withColumn("last", last).withColumn("first", F.col("last") - F.col("n") + 1)
    at = lambda rank: F.max(F.when(rank.between(F.col("first"), F.col("last")), F.col("v")))
    lo, hi = F.floor("position"), F.ceil("position")
    ends = ranked.groupBy(*inner, "j", "position").agg(at(lo).alias("lo"), at(hi).alias("hi"))
    frac = F.col("position") - lo
    pairs = list(product(columns, probabilities))
    metric = F.element_at(F.array(*[F.lit(c) for c, _ in pairs]), F.col("j") + 1)
    p = F.element_at(F.array(*[F.lit(float(x)) for _, x in pairs]), F.col("j") + 1)
    q = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") * (1 - frac) + F.col("hi") * frac)
    return ends.select(*[F.col(n).alias(k) for k, n in zip(keys, inner)], metric.alias("metric"), p.alias("p"), q.alias("q"))


def _same(keys: Sequence[str]) -> Column:
    """Equal keys of the sides ``l`` and ``r``; NULL keys are a group of their own."""
    return reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])


def _known(rows: DataFrame, keys: Sequence[str], state: DataFrame) -> DataFrame:
    """Every row with the brackets of its group as an array ``s`` in the order of their numbers."""
    packed = state.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("j", *[c for c in state.columns if c not in (*keys, "j")]))).alias("s"))
    if not keys:
        return rows.select("*", packed.scalar().alias("s"))
    # Written, so that the planner knows its size: brackets of few groups are broadcast, those of many shuffled.
    packed = materialize(packed, "brackets_by_key")
    return rows.alias("l").join(packed.alias("r"), _same(keys)).select("l.*", "r.s")


def _sketched(df: DataFrame, keys: Sequence[str], plain: dict[str, Column], sketches: dict[str, Column], accuracy: int) -> DataFrame:
    """Aggregates per key, the sketches of each value merged in two levels. ``plain`` are sums, or else named min_, max_."""
    spread = (F.spark_partition_id() % FAN_IN).alias("salt")
    size = F.lit(accuracy)
    first = df.groupBy(*keys, spread).agg(
        *[a.alias(n) for n, a in plain.items()], *[F.kll_sketch_agg_double(v, size).alias(n) for n, v in sketches.items()]
    )
    merge = lambda n: F.min(n) if n.startswith("min_") else F.max(n) if n.startswith("max_") else F.coalesce(F.sum(n), F.lit(0))
    return first.groupBy(*keys).agg(*[merge(n).alias(n) for n in plain], *[F.kll_merge_agg_double(n, size).alias(n) for n in sketches])


def _long(wide: DataFrame, keys: Sequence[str], wanted: Wanted, fields: Callable[[int, int], dict[str, str]]) -> DataFrame:
    """One row per key and rank, from columns of one row per key."""
    rows = [F.struct(F.lit(j).alias("j"), F.lit(p).alias("p"), *[F.col(c).alias(n) for n, c in fields(j, i).items()]) for j, (i, p) in wanted]
    return wide.select(*keys, F.inline(F.array(*rows)))


def _covers(v: Column, low: Column, high: Column) -> Column:
    return v.isNotNull() & (low.isNull() | (v >= low)) & (high.isNull() | (v <= high))


def _edges(df: DataFrame, n: str, low_share: Column, high_share: Column) -> DataFrame:
    """``at_low`` and ``at_high``: values of the sketch at two shares, rounded outwards; NULL beyond its ends, or if it is empty."""
    shares = F.split(F.lit(",".join(str(i / GRID) for i in range(GRID + 1))), ",").cast("array<double>")
    df = df.withColumn("grid", F.when(F.col(n) > 0, F.kll_sketch_get_quantile_double("sketch", shares)))
    df = df.withColumns({"step_low": F.floor(low_share * GRID), "step_high": F.ceil(high_share * GRID)})
    at = lambda step: F.when((F.col(step) > 0) & (F.col(step) < GRID), F.get("grid", F.col(step).cast("int")))
    return df.withColumns({"at_low": at("step_low"), "at_high": at("step_high")}).drop("grid", "step_low", "step_high", "sketch")


STATE = "j p n low high below inside strict try_low try_high again".split()


def _narrowed(rows: DataFrame, keys: Sequence[str], names: Sequence[str], wanted: Wanted, accuracy: int, most: int) -> DataFrame:
    """One row per key and rank: the number of values, a bracket [low, high] (NULL: open) that holds the rank, the rows below
    it and inside it."""
    margin = min(3 * 2.3 / accuracy**0.9, 0.25)
    first = _sketched(rows, keys, {f"n_{i}": F.count(c) for i, c in enumerate(names)}, {f"k_{i}": F.col(c) for i, c in enumerate(names)}, accuracy)
    state = _edges(_long(first, keys, wanted, lambda j, i: {"n": f"n_{i}", "sketch": f"k_{i}"}), "n", F.col("p") - margin, F.col("p") + margin)
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    state = state.withColumns({"low": none, "high": none, "below": zero, "inside": F.col("n"), "strict": F.col("n"), "try_low": F.col("at_low"), "try_high": F.col("at_high")})
    state = materialize(state.withColumn("again", F.lit(True)).select(*keys, *STATE), "brackets")
    fine = False
    while True:
        known = _known(rows, keys, state)
        plain, sketches = {}, {}
        for j, (i, _) in wanted:
            v, low, high = F.col(names[i]), F.col("s")[j]["try_low"], F.col("s")[j]["try_high"]
            within = _covers(v, low, high)
            plain |= {f"under_{j}": F.count_if(v < low), f"held_{j}": F.count_if(within)}
            plain |= {f"atlow_{j}": F.count_if(v == low), f"athigh_{j}": F.count_if(v == high)}
            if fine:
                plain |= {f"min_{j}": F.min(F.when(within & (v > low), v)), f"max_{j}": F.max(F.when(within & (v < high), v))}
                # Settled brackets need no sketch.
                sketches[f"k_{j}"] = F.when(within & F.col("s")[j]["again"], v)
        if fine:
            counted = _sketched(known, keys, plain, sketches, accuracy)
        else:
            counted = known.groupBy(*keys).agg(*[a.alias(n) for n, a in plain.items()])
        kinds = ("under", "held", "atlow", "athigh", *(("min", "max") if fine else ()))
        counts = _long(counted, keys, wanted, lambda j, i: {k: f"{k}_{j}" for k in kinds} | ({"sketch": f"k_{j}"} if fine else {})).drop("p")
        counts = materialize(counts, "bracket_counts")
        both = state.alias("l").join(counts.alias("r"), _same([*keys, "j"])).select("l.*", *[f"r.{c}" for c in counts.columns if c not in (*keys, "j")])
        new = materialize(_step(both, margin, fine).select(*keys, *STATE), "brackets")
        discard(counts)
        discard(state)
        state = new
        # What is still too large is narrowed; the driver reads one number.
        if (state.where("again").agg(F.max("strict")).first()[0] or 0) <= most:
            return state
        fine = True


def _step(both: DataFrame, margin: float, fine: bool) -> DataFrame:
    """The brackets after their trial edges were counted, and the next trial edges."""
    c = F.col
    at = both.withColumn("position", (c("n") - 1) * c("p")).withColumns({"lo": F.floor("position"), "hi": F.ceil("position")})
    # An open trial edge is the edge it has.
    at = at.withColumns(
        {
            "under": F.when(c("try_low").isNull(), c("below")).otherwise(c("under")),
            "beyond": F.when(c("try_high").isNull(), c("below") + c("inside")).otherwise(c("under") + c("held")),
        }
    ).withColumn("beyond", F.when(c("try_high").isNull(), c("beyond")).otherwise(c("under") + c("held")))
    at = at.withColumns({"ok_low": c("under") <= c("lo"), "ok_high": c("beyond") > c("hi"), "end": c("below") + c("inside")})
    at = at.withColumn("hit", c("ok_low") & c("ok_high"))
    at = at.withColumns(
        {
            "low": F.when(c("ok_low"), F.coalesce("try_low", "low")).otherwise(c("low")),
            "below": F.when(c("ok_low"), c("under")).otherwise(c("below")),
            "high": F.when(c("ok_high"), F.coalesce("try_high", "high")).otherwise(c("high")),
            "end": F.when(c("ok_high"), c("beyond")).otherwise(c("end")),
        }
    )
    mass = lambda edge: F.when(c(edge) == c(f"try_{edge}"), c(f"at{edge}")).otherwise(F.lit(0))
    # Rows between the edges; however many rows have an edge's value, it is one value.
    at = at.withColumn("strict", c("end") - c("below") - mass("low") - mass("high"))
    if fine:
        # The mass of an edge is cut off where the ranks are beyond it; where they are in it, it is all that stays.
        has_low, has_high = c("try_low").isNotNull(), c("try_high").isNotNull()
        at = at.withColumns(
            {
                "only_low": c("hit") & has_low & (c("hi") < c("under") + c("atlow")),
                "only_high": c("hit") & has_high & (c("lo") >= c("beyond") - c("athigh")),
                "up": c("hit") & has_low & (c("lo") >= c("under") + c("atlow")) & c("min").isNotNull(),
                "down": c("hit") & has_high & (c("hi") < c("beyond") - c("athigh")) & c("max").isNotNull(),
            }
        )
        at = at.withColumns(
            {
                "low": F.when(c("only_low"), c("low")).when(c("only_high"), c("try_high")).when(c("up"), c("min")).otherwise(c("low")),
                "high": F.when(c("only_low"), c("try_low")).when(c("only_high"), c("high")).when(c("down"), c("max")).otherwise(c("high")),
                "below": F.when(c("only_low"), c("below")).when(c("only_high"), c("beyond") - c("athigh")).when(c("up"), c("under") + c("atlow")).otherwise(c("below")),
                "end": F.when(c("only_low"), c("under") + c("atlow")).when(c("only_high"), c("end")).when(c("down"), c("beyond") - c("athigh")).otherwise(c("end")),
            }
        )
        # The sketch tells where in the counted bracket the ranks are. Where it missed, what is left is sketched first.
        at = at.withColumn("size", F.when(c("again"), c("held")).otherwise(F.lit(0)))
        share = lambda rank: (c(rank) - c("under")) / F.greatest("held", F.lit(1))
        at = _edges(at, "size", share("lo") - margin, share("hi") + margin)
        at = at.withColumns(
            {
                "try_low": F.coalesce(F.when(c("hit"), F.greatest("at_low", "low")), c("low")),
                "try_high": F.coalesce(F.when(c("hit"), F.least("at_high", "high")), c("high")),
            }
        )
        more = ~c("hit") | ~c("try_low").eqNullSafe(c("low")) | ~c("try_high").eqNullSafe(c("high"))
    else:
        at = at.withColumns({"try_low": c("low"), "try_high": c("high")})
        more = F.lit(True)
    single = F.coalesce(c("low") == c("high"), F.lit(False))
    return at.withColumn("inside", c("end") - c("below")).withColumn("again", more & (c("n") > 0) & ~single)


def _inside(rows: DataFrame, keys: Sequence[str], names: Sequence[str], wanted: Wanted, state: DataFrame) -> DataFrame:
    """(keys, j, position, below, v, n): distinct values inside their brackets and how many rows have them."""
    known = _known(rows, keys, state.withColumn("position", (F.col("n") - 1) * F.col("p")).select(*keys, "j", "low", "high", "below", "position"))
    probes = []
    for j, (i, _) in wanted:
        v, s = F.col(names[i]), F.col("s")[j]
        found = F.struct(F.lit(j).alias("j"), s["position"].alias("position"), s["below"].alias("below"), v.alias("v"))
        probes.append(F.when(_covers(v, s["low"], s["high"]), found))
    hits = known.select(*keys, F.explode(F.filter(F.array(*probes), lambda x: x.isNotNull())).alias("h")).select(*keys, "h.*")
    return hits.groupBy(*keys, "j", "position", "below", "v").agg(F.count(F.lit(1)).alias("n"))
