"""Quality rules with thresholds that adapt to language and source.

Every document gets a few whole-number rates (symbols, marks, repeated lines,
word length). A mergeable quantile sketch of each rate is built
per language and source: a histogram whose buckets have a bounded relative
width, so that sketches of parts add up to the sketch of the whole, whatever
the order, and a rerun gives the same thresholds. Fences replace fixed cutoffs:
an upper quantile of the group plus a multiple of its distance from the median
(below the median likewise). A source whose own quantile lies in junk is bounded
by the fence of its language, at twice the distance. Joining the fences back
filters the documents.

Built-in expressions only. Counting inside a document never leaves its row, so
a hot source is spread over all tasks; sketches are pre-aggregated per task and
have at most some hundred buckets per group, however large the group.

Defined results: a null text is an empty one; texts with fewer than five words
have no five-word window; an empty table gives no rows; repeated rows are
judged one by one; null languages and sources are groups of their own. Other
columns pass through untouched (names that start with ``qr_`` are taken).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctpulse.llm.words import GAP, WORD, let, text_of, words_of
from acctpulse.session import materialize

SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[!?]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of the words

#: Rates: the quantile (per cent) that fences start from, how many of its distances from the median they lie beyond it, the
#: least distance, for groups where quantile and median coincide, and whether there is a fence below the median as well.
#: All are thousandths of a word or line, word length hundredths of a character.
RATES = {
    "symbol_rate": (75, 8, 100, False),
    "mark_rate": (75, 8, 200, False),
    "line_rate": (99, 2, 50, False),
    "word_length": (90, 8, 50, True),
}
#: A group's quantile counts if so many documents lie beyond it; else that of its language does, else that of all.
MIN_TAIL = 10
#: A source's fence lies at most so many distances of its language's fence beyond the language's quantile.
BOUND = 2
#: Sketch buckets keep so many leading bits, so values are off by 1/2**(BITS-1) at most.
BITS = 9


def _repeated_words(words: Column) -> Column:
    """Words inside a five-word window that occurs twice or more in the array, the first one included.

    Hashes of the windows only tell texts without any repeated window, which is
    most of them; the others sort the windows themselves.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - WINDOW)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def slow() -> Column:
        window = F.transform(
            starts, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, F.lit(WINDOW))).alias("w"), i.alias("i"))
        )

        def repeated(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["w"] == F.get(s, b)["w"], F.lit(False))
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
            return F.sort_array(F.transform(at, lambda j: F.get(s, j)["i"]))

        def covered(p: Column) -> Column:
            width = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(width, F.lit(0), lambda a, x: a + x)

        return let(let(F.sort_array(window), repeated), covered)

    return F.when(n < WINDOW, 0).otherwise(
        F.when(let(hashed, lambda h: F.size(F.array_distinct(h)) == F.size(h)), 0).otherwise(slow())
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with counts and rates in one struct column ``qr_m``."""
    t = text_of(text)

    def lines(s: Column) -> Column:
        full = F.filter(F.split(s, "\n"), lambda x: x.rlike(WORD))
        return let(full, lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup")))

    def words(s: Column) -> Column:
        return let(
            words_of(s),
            lambda w: F.struct(
                F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeated_words(w).alias("repeated")
            ),
        )

    counted = docs.withColumns(
        {
            "qr_w": words(t),
            "qr_l": lines(t),
            "qr_s": F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, "")),
            "qr_x": F.length(t) - F.length(F.regexp_replace(t, MARKS, "")),
        }
    )
    n, n_lines = F.greatest(F.col("qr_w.n"), F.lit(1)), F.greatest(F.col("qr_l.n"), F.lit(1))
    per = lambda count, of, times: F.floor(F.lit(times).cast("long") * count / of).cast("long")
    return counted.withColumn(
        "qr_m",
        F.struct(
            F.col("qr_w.n").cast("long").alias("n_words"),
            F.col("qr_w.chars").cast("long").alias("word_chars"),
            F.col("qr_s").cast("long").alias("n_symbols"),
            F.col("qr_l.dup").cast("long").alias("n_dup_lines"),
            F.col("qr_w.repeated").cast("long").alias("n_repeat_words"),
            (
                (F.col("qr_w.n") < MIN_WORDS) | (F.col("qr_w.repeated") * 100 > F.col("qr_w.n") * MAX_REPEATED)
            ).alias("base_failed"),
            per(F.col("qr_s"), n, 1000).alias("symbol_rate"),
            per(F.col("qr_x"), n, 1000).alias("mark_rate"),
            per(F.col("qr_l.dup"), n_lines, 1000).alias("line_rate"),
            per(F.col("qr_w.chars"), n, 100).alias("word_length"),
        ),
    ).drop("qr_w", "qr_l", "qr_s", "qr_x")


def bucket(value: Column) -> Column:
    """The lower bound of a value's sketch bucket: its leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Mergeable sketches: (qr_lang, qr_source, rate, at, n), one row per bucket. Rows that fail the base rules stay out."""
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bucket(F.col(f"qr_m.{r}")).alias("at")) for r in RATES]))
    return (
        measured.where(~F.col("qr_m.base_failed"))
        .select(F.col(lang).alias("qr_lang"), F.col(source).alias("qr_source"), rates.alias("r"))
        .groupBy("qr_lang", "qr_source", "r.rate", "r.at")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _quantiles(sketches: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row per key with its number of documents and a struct of quantiles per rate, from merged sketches."""
    w = Window.partitionBy(*keys, "rate")
    merged = sketches.groupBy(*keys, "rate", "at").agg(F.sum("n").alias("n"))
    ranked = merged.withColumns(
        {"total": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))}
    )

    def at(rate: str, per_cent: int) -> Column:
        """The smallest bucket that at least so many per cent of the documents do not exceed."""
        reached = (F.col("rate") == rate) & (F.col("upto") * 100 >= F.col("total") * per_cent)
        return F.min(F.when(reached, F.col("at")))

    found = []
    for rate, (p, *_) in RATES.items():
        three = {"lo": 100 - p, "mid": 50, "hi": p}
        found.append(F.struct(*[at(rate, q).alias(n) for n, q in three.items()]).alias(rate))
    return ranked.groupBy(*keys).agg(F.max("total").alias(f"{name}_n"), F.struct(*found).alias(name))


def thresholds(sketches: DataFrame) -> DataFrame:
    """(qr_lang, qr_source, qr_f): the fences that hold for each group, its own or those of merged sketches."""
    own = _quantiles(sketches, ["qr_lang", "qr_source"], "own").alias("o")
    lang = _quantiles(sketches, ["qr_lang"], "lang").alias("l")
    everyone = _quantiles(sketches.withColumn("qr_all", F.lit(1)), ["qr_all"], "every").select("every")
    rows = own.join(lang, F.col("o.qr_lang").eqNullSafe(F.col("l.qr_lang"))).select("o.*", "lang_n", "lang")
    rows = rows.withColumn("every", everyone.scalar())
    ends = []
    for rate, (p, reach, least, both) in RATES.items():

        def fence(of: str, sign: int, times: int = 1, rate=rate, reach=reach, least=least) -> Column:
            start, mid = F.col(f"{of}.{rate}.{'hi' if sign > 0 else 'lo'}"), F.col(f"{of}.{rate}.mid")
            away = F.greatest(F.lit(least).cast("long"), F.abs(start - mid) * reach)
            return start + away * (sign * times)

        known = lambda of, p=p: F.col(f"{of}_n") * (100 - p) >= MIN_TAIL * 100
        for end, sign, inner in (("max", 1, F.least), ("min", -1, F.greatest))[: 1 + both]:
            mine = F.when(known("own"), inner(fence("own", sign), fence("lang", sign, BOUND)))
            mine = mine.when(known("lang"), fence("lang", sign)).otherwise(fence("every", sign))
            ends.append(mine.alias(f"{rate}_{end}"))
    return rows.select("qr_lang", "qr_source", F.struct(*ends).alias("qr_f"))


def verdict() -> Column:
    """Base rules passed and every rate inside its fences."""
    ok = ~F.col("qr_m.base_failed")
    for rate, (*_, both) in RATES.items():
        ok = ok & (F.col(f"qr_m.{rate}") <= F.col(f"qr_f.{rate}_max"))
        if both:
            ok = ok & (F.col(f"qr_m.{rate}") >= F.col(f"qr_f.{rate}_min"))
    return F.coalesce(ok, F.lit(False))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every row (all, if not given), with its counts in ``qr_m`` and the verdict in ``qr_kept``.

    The measured rows are written once, since sketches and verdicts both read
    them. So are the thresholds, a few numbers per group: the planner then knows
    their size and broadcasts them only where they are small.
    """
    keep = docs.columns if keep is None else keep
    held = list(dict.fromkeys([*keep, lang, source]))
    measured = materialize(measure(docs, text).select(*held, "qr_m"), "measured")
    fences = materialize(thresholds(sketch(measured, lang, source)), "fences")
    joined = measured.alias("d").join(
        fences.alias("f"),
        F.col(f"d.{lang}").eqNullSafe(F.col("f.qr_lang")) & F.col(f"d.{source}").eqNullSafe(F.col("f.qr_source")),
        "left",
    )
    return joined.select(*[F.col(f"d.`{c}`") for c in keep], "qr_m", verdict().alias("qr_kept"))


__all__ = ["GAP", "bucket", "judge", "measure", "sketch", "thresholds", "verdict"]
