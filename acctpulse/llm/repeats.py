"""Removal of repeated byte strings by rolling-hash parsing.

Every string of LENGTH bytes is assigned to its trigger: the position of the
smallest rolling hash of TRIGGER bytes inside it, the leftmost of equals. Equal
strings have the same trigger at the same offset, so only strings of equal
triggers need comparing, and a trigger that occurs once proves all its strings
unique. The strings of one trigger occurrence are neighbours; their union is a
phrase, some 250 bytes long.

1. Triggers are counted over the corpus; only repeated ones go on.
2. Phrases of repeated triggers form the dictionary. A phrase that occurs twice
   or more is repeated as a whole: all its strings are. That settles copies and
   repetitive text without looking inside.
3. Phrases that occur once but share their trigger with others are open. The
   dictionary's open triggers are dealt to tasks, and each task builds the suffix
   array of its phrases by prefix doubling, as deep as LENGTH bytes. Strings of
   equal rank are neighbours in corpus order and are repeated.

Work is keyed by trigger and pre-aggregated. Triggers with more than HOT distinct
phrases are resolved string by string in a grouped count of string hashes (64
bits, mixed with trigger and offset) instead of inside a task. Repeated triggers are sent to the tasks behind a check of their number;
beyond it they join by shuffle.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing;
rows with equal texts lose all of it from LENGTH bytes on; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctpulse.llm.batches import joined, pieces, powers, scramble
from acctpulse.session import materialize

LENGTH, TRIGGER = 200, 48
#: Repeated triggers sent to every task at most (8 bytes each), and distinct phrases of a trigger that one task compares.
MOST_SENT = 4_000_000
HOT = 20_000
#: Phrases per task when they are compared.
PER_TASK = 20_000
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the bytes' terms, and the powers that shift a sum to position 0."""
    n = len(data)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), dtype=np.uint64)))
    back = np.full(n + 1, _INVERSE, np.uint64)
    back[0] = 1
    return sums, np.multiply.accumulate(back)


def phrases(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Per trigger occurrence: its text's number, hash, offset in the text, first and last start of its strings, two phrase hashes."""
    data, at = joined(texts)
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums, back = _sums(data)
    grams = scramble((sums[TRIGGER:] - sums[:-TRIGGER]) * back[: n - TRIGGER + 1])
    low = np.uint64((1 << max(n.bit_length(), 1)) - 1)
    best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, size = LENGTH - TRIGGER + 1, 1
    while size * 2 <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    start = np.arange(len(best))
    owner = np.searchsorted(at, start, side="right") - 1
    fits = start + LENGTH <= at[owner + 1] - 1
    start, owner, trigger = start[fits], owner[fits], (best[fits] & low).astype(np.int64)
    if not len(start):
        return phrases([])
    first = np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1])))
    lo = start[first]
    hi = start[np.concatenate((first[1:], [True]))]
    t, of = trigger[first], owner[first]
    end = hi + LENGTH
    whole = (sums[end] - sums[lo]) * back[lo]
    base = at[of]
    # A second hash from two parts of the phrase, cut at the trigger.
    parts = scramble((sums[end] - sums[t]) * back[t]) ^ scramble(scramble((sums[t] - sums[lo]) * back[lo]) + (t - lo).astype(np.uint64))
    return of, grams[t], t - base, lo - base, hi - base, scramble(whole + (end - lo).astype(np.uint64)), parts


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _trigger_counts(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [t or "" for t in b.column(0).to_pylist()]
            for lo, hi in pieces(held):
                keys, n = np.unique(phrases(held[lo:hi])[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(n.astype(np.int64))], names=["trigger", "n"])

    return texts.select("rp_text").mapInArrow(run, "trigger long, n long").groupBy("trigger").agg(F.sum("n").alias("n"))


def _occurrences(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """(trigger, p1, p2, key, id, at, lo, hi) of every phrase of a repeated trigger."""
    few = repeated.count() <= MOST_SENT
    known = np.sort(repeated.toArrow().column(0).to_numpy()) if few else None
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for b in batches:
            held = [t or "" for t in b.column(2).to_pylist()]
            for a, z in pieces(held):
                of, trigger, at, lo, hi, p1, p2 = phrases(held[a:z])
                keep = np.ones(len(of), bool)
                if wanted is not None:
                    mine = trigger.view(np.int64)
                    place = np.minimum(np.searchsorted(wanted, mine), max(len(wanted) - 1, 0))
                    keep = wanted[place] == mine if len(wanted) else ~keep
                rows = pa.array(of[keep] + a)
                small = [pa.array(x[keep].astype(np.int32)) for x in (at, lo, hi)]
                yield pa.RecordBatch.from_arrays(
                    [_signed(trigger[keep]), _signed(p1[keep]), _signed(p2[keep]), b.column(0).take(rows), b.column(1).take(rows), *small],
                    names=["trigger", "p1", "p2", "key", "id", "at", "lo", "hi"],
                )

    ddl = "trigger long, p1 long, p2 long, key string, id string, at int, lo int, hi int"
    found = texts.select("key", "id", "rp_text").mapInArrow(run, ddl)
    return found if few else found.join(repeated, "trigger", "left_semi")


def _cut(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The bytes of phrases (trigger, g, mine, key, id, at, lo, hi), from one row of each text."""
    lists = places.groupBy("key", "id").agg(F.collect_list(F.struct("trigger", "g", "mine", "at", "lo", "hi")).alias("ps"))
    held = texts.alias("t").join(lists.alias("l"), (F.col("t.key") == F.col("l.key")) & F.col("t.id").eqNullSafe(F.col("l.id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = (text or "").encode("utf-8", "surrogatepass")
                rows = [(p["trigger"], p["g"], p["mine"], key, p["at"], p["lo"], p["hi"], data[p["lo"] : p["hi"] + LENGTH]) for p in ps.as_py()]
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                names = ["trigger", "g", "mine", "key", "at", "lo", "hi", "data"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    ddl = "trigger long, g long, mine boolean, key string, at int, lo int, hi int, data binary"
    return held.select("t.key", "t.rp_text", "l.ps").mapInArrow(run, ddl)


def _strings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all strings of the phrases, with the phrase's number and the string's start in its text."""
    blobs = batch.column("data").to_pylist()
    trigger, at, lo = (batch.column(c).to_numpy() for c in ("trigger", "at", "lo"))
    data = np.frombuffer(b"".join(blobs), np.uint8)
    size = np.array([len(x) for x in blobs])
    sums, back = _sums(data)
    count = size - LENGTH + 1
    row = np.repeat(np.arange(len(size)), count)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(np.cumsum(size) - size, count) + inside
    offset = (at - lo)[row] - inside  # of the trigger in the string
    h = scramble((sums[begin + LENGTH] - sums[begin]) * back[begin])
    h = scramble(h + scramble(trigger.view(np.uint64)[row] + offset.astype(np.uint64)))
    return h, row, lo[row] + inside


def string_ranks(data: np.ndarray) -> np.ndarray:
    """Rank of the LENGTH bytes from each position on, in byte order: a suffix array that goes no deeper than LENGTH.

    Ranks of twice the width follow from two ranks; the last step lets the two overlap.
    """
    width = 8
    rank = np.zeros(len(data) - width + 1, np.uint64)
    for k in range(width):
        rank = (rank << np.uint64(8)) | data[k : len(data) - width + 1 + k]
    rank = np.unique(rank, return_inverse=True)[1]
    while width < LENGTH:
        step = min(width, LENGTH - width)
        rank = np.unique((rank[:-step] << 32) | rank[step:], return_inverse=True)[1]
        width += step
    return rank


def _repeats_inside(table: pa.Table) -> pa.RecordBatch:
    """Spans of strings of the phrases marked ``mine`` that stand elsewhere in the table's phrases too."""
    blobs = table.column("data").to_pylist()
    size = np.array([len(x) for x in blobs])
    rank = string_ranks(np.frombuffer(b"".join(blobs), np.uint8))
    count = size - LENGTH + 1  # strings that stay inside the phrase
    row = np.repeat(np.arange(len(size)), count)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    rank = rank[np.repeat(np.cumsum(size) - size, count) + inside]
    mine = table.column("mine").to_numpy()[row] & (np.bincount(rank)[rank] > 1)
    start = table.column("lo").to_numpy()[row] + inside
    return _runs(table.column("key").to_pylist(), row[mine], start[mine])


def _runs(key: list, row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Spans covered by strings at ``start`` of the phrases ``row``, consecutive starts joined."""
    first = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))) if len(row) else np.zeros(0, bool)
    last = np.concatenate((first[1:], [True])) if len(row) else first
    spans = [pa.array(start[first].astype(np.int64)), pa.array(start[last].astype(np.int64) + LENGTH)]
    return pa.RecordBatch.from_arrays([pa.array([key[i] for i in row[first]], pa.string()), *spans], names=["key", "a", "b"])


def _compare(cut: DataFrame) -> DataFrame:
    """(key, a, b): spans of strings of phrases marked ``mine`` that another phrase of the trigger has too."""
    spark = cut.sparkSession

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield _repeats_inside(pa.Table.from_batches(held))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                h, row, start = _strings(part)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [_signed(h), part.column("mine").take(rows), part.column("key").take(rows), pa.array(start.astype(np.int64))],
                    names=["h", "mine", "key", "a"],
                )

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cut.count() // PER_TASK)
    usual = cut.where(F.col("g") <= HOT).repartition(tasks, "trigger").mapInArrow(inside, "key string, a long, b long")
    strings = cut.where(F.col("g") > HOT).mapInArrow(each, "h long, mine boolean, key string, a long")
    often = strings.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    hot = strings.where("mine").join(often, "h", "left_semi").select("key", "a", (F.col("a") + LENGTH).alias("b"))
    return usual.unionByName(hot)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(key, a, b): spans of repeated strings in each text; ``texts`` has key, id (a row of it) and rp_text."""
    repeated = materialize(_trigger_counts(texts).where("n > 1").select("trigger"), "triggers")
    found = materialize(_occurrences(texts, repeated), "phrases")
    entry = found.groupBy("trigger", "p1", "p2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "id", "at", "lo", "hi")).alias("one"))
    entry = materialize(entry, "dictionary")
    groups = entry.groupBy("trigger").agg(F.count(F.lit(1)).alias("g"), F.min("n").alias("least")).where("g > 1 AND least = 1")
    open_ = entry.join(groups.select("trigger", "g"), "trigger").select("trigger", "g", (F.col("n") == 1).alias("mine"), "one.*")
    partly = _compare(materialize(_cut(texts, open_), "open_phrases"))
    whole = found.join(entry.where("n > 1").select("trigger", "p1", "p2"), ["trigger", "p1", "p2"], "left_semi")
    whole = whole.select("key", F.col("lo").cast("long").alias("a"), (F.col("hi") + LENGTH).cast("long").alias("b"))
    return whole.unionByName(partly).distinct()


def remove(docs: DataFrame, keep: list[str] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The columns ``keep`` (all, if not given) of every row with rp_bytes, rp_removed, rp_spans, rp_kept (the bytes left)."""
    keep = docs.columns if keep is None else keep
    key = F.md5(F.coalesce(F.col(text), F.lit("")))
    texts = docs.select(key.alias("key"), F.col(doc_id).cast("string").alias("id"), F.col(text).alias("rp_text"))
    spans = repeated_spans(texts).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("rp_cut"))
    spans = materialize(spans.withColumnRenamed("key", "rp_key"), "spans")
    rows = docs.select(*keep, key.alias("rp_key"), F.col(text).alias("rp_text")).join(spans, "rp_key", "left")
    kept = rows.select(*keep).schema.fields
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for t, cut in zip(b.column(n).to_pylist(), b.column(n + 1)):
                data = (t or "").encode("utf-8", "surrogatepass")
                left, end, runs = [], 0, 0
                for s in cut.as_py() or []:
                    if s["a"] > end or not runs:
                        left.append(data[end : s["a"]])
                        runs += 1
                    end = max(end, s["b"])
                left.append(data[end:])
                rest = b"".join(left)
                for column, x in zip(out, (len(data), len(data) - len(rest), runs, rest)):
                    column.append(x)
            new = [pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *new], names=[*keep, "rp_bytes", "rp_removed", "rp_spans", "rp_kept"])

    return rows.select(*keep, "rp_text", "rp_cut").mapInArrow(run, f"{ddl}, rp_bytes long, rp_removed long, rp_spans long, rp_kept binary")
