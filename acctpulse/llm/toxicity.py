"""Toxicity by class-conditional Kneser-Ney models.

Word pairs are counted per class over all labelled documents outside the held-out
folds. A class's probability of a word after another interpolates its discounted
pair counts with its discounted continuation counts (after how many different
words a word stands in the class), and those with a distribution that both
classes share: after how many different words it stands in either. Discounts are
the modified Kneser-Ney estimates from the counts of counts, always below the
count, so rare pairs keep weight and what is taken backs off to the shared counts.
A document's evidence is the difference of its log-likelihoods per word: over the
whole text, and by words alone of its most toxic passage and its most telling
words. A logistic on these, fitted on a fold that is in no count, makes it a score.

Counting is a shuffle of pre-aggregated pairs; all words and pairs count, whatever
their number. The most frequent ones, up to SENT_WORDS and SENT_PAIRS, travel to
the tasks. Where there are more, texts list the words and pairs they miss; those
meet the rest of the tables by a shuffle and return to their texts, and the scores are
the same as if all had travelled.

Defined results: texts without a word have evidence 0; null is empty; without
two classes every score is the share of toxic labels (0.5 without any label); words
and pairs of equal counts travel all or none; among equally telling words the first counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acctpulse.llm.batches import hashed_words, map_kept, map_texts, pieces, quote, scramble
from acctpulse.llm.labels import fold, join_labels, sample
from acctpulse.llm.words import text_of
from acctpulse.session import discard, materialize

#: Words and pairs that travel to the tasks at most. In a task each takes 8 bytes and 2 or 4 for the row of its numbers
#: (equal rows are held once); on the way they are packed.
SENT_WORDS, SENT_PAIRS = 1 << 21, 1 << 24
#: Pairs (or four times as many as words) that the driver holds unpacked at a time, about.
SLICE = 1 << 20
#: The fold that calibrates the score, and the rows used for it at most.
CALIBRATION, MOST_ROWS = 1, 20_000
#: Words of the passage with the most evidence; numbers of most telling words.
PASSAGE = 5
TOPS = (1, 3, 6)
FACTS = 3 + len(TOPS)
#: Pairs that a task holds before it passes them on.
HELD = 1_000_000
#: Characters that are judged at once.
BATCH = 1_000_000
#: Stands before a text's first word; not 0, which would give its pairs the keys of words.
START = np.int64(0x5851F42D4C957F2D)
#: What is known of a word; of a pair, the first two: how often it occurs by class.
SUMS = ("k0", "k1", "ahead", "t0", "t1", "d0", "d1")


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of the words before them (START at the start of a text), and the texts' offsets."""
    words, at = hashed_words(texts)
    w = words.view(np.int64)
    before = np.append(START, w[:-1]) if len(w) else w
    before[at[:-1][at[:-1] < len(w)]] = START
    return w, before, at


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A pair's key: one word's hash turned by a bit, and the other's over it."""
    u = v.view(np.uint64)
    return ((u << np.uint64(1)) | (u >> np.uint64(63))).view(np.int64) ^ w


def _key_of(v: Column, w: Column) -> Column:
    """The same of columns."""
    return F.shiftleft(v, 1).bitwiseOR(F.shiftrightunsigned(v, 63)).bitwiseXOR(w)


def count_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(w, v, n0, n1): how often each word w stands after v in rows with lb_y 0 and 1.

    Pairs are dealt by w (and two bits of v, so that a frequent word is not one task's) and in its order: repeated
    words pack well, and a word's pairs meet in few tasks when they are summed up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts: Sequence[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            keys, where, of = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
            sums = [np.bincount(of, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in (2, 3)]
            return keys, np.concatenate([p[1] for p in parts])[where], *sums

        def passed(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            pair, w, n0, n1 = columns
            order = np.argsort(w)
            turned = (pair ^ w).view(np.uint64)
            v = ((turned >> np.uint64(1)) | (turned << np.uint64(63))).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(c[order]) for c in (w, v, n0, n1)], names=["w", "v", "n0", "n1"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in pieces(texts):
                w, v, at = _tokens(texts[lo:hi])
                if not len(w):
                    continue
                y = np.repeat(toxic[lo:hi], np.diff(at))
                held = [merged([*held, merged([(_pair(v, w), w, 1 - y, y)])])]
                if len(held[0][0]) > HELD:
                    yield passed(held.pop())
        for rest in held:
            yield passed(rest)

    each = docs.select(F.col(quote(text)), F.col("lb_y")).mapInArrow(run, "w long, v long, n0 long, n1 long")
    dealt = each.withColumn("part", F.col("v").bitwiseAND(3)).repartition("w", "part")
    return dealt.groupBy("w", "part", "v").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).drop("part")


def estimated(times: Sequence[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more, from how many have a count of 1, 2, 3 and 4; always between 0 and the count."""
    n1, n2, n3, n4 = (max(float(x), 0.5) for x in times)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw))


def _discounts(rows: DataFrame, columns: tuple[str, str]) -> tuple[list[list[int]], list[tuple[float, float, float]]]:
    """By class, how many rows have a count of 1 to 4 and the discounts that follow."""
    ones = [F.sum((F.col(c) == i).cast("long")).alias(f"{c}_{i}") for c in columns for i in range(1, 5)]
    found = rows.agg(*ones).first()
    times = [[found[f"{c}_{i}"] or 0 for i in range(1, 5)] for c in columns]
    return times, [estimated(t) for t in times]


def word_sums(pairs: DataFrame, taken: Sequence[tuple[float, ...]]) -> DataFrame:
    """Per word (key) the SUMS.

    k0, k1, ahead: different words before it by class and in either; t0, t1 and d0, d1: occurrences with a word after
    it and what the discounts take of them, by class.
    """
    zero, nothing = F.lit(0).cast("long"), F.lit(0.0)
    gone = [F.get(F.array(F.lit(0.0), *[F.lit(d) for d in taken[c]]), F.least(F.col(f"n{c}"), F.lit(3)).cast("int")) for c in (0, 1)]
    stands = [(F.col(f"n{c}") > 0).cast("long") for c in (0, 1)]

    def row(key: Column, *sums: Column) -> Column:
        return F.struct(key.alias("key"), *[s.alias(n) for s, n in zip(sums, SUMS)])

    roles = F.array(
        row(F.col("w"), *stands, F.lit(1).cast("long"), zero, zero, nothing, nothing),
        row(F.col("v"), zero, zero, zero, F.col("n0"), F.col("n1"), *gone),
    )
    return pairs.select(F.inline(roles)).groupBy("key").agg(*[F.sum(c).alias(c) for c in SUMS])


def _least_sent(rows: DataFrame, n: Column, most: int) -> tuple[int, int]:
    """The least count so that no more than ``most`` rows have as many, and how many have."""
    by_count = rows.groupBy(F.least(n, F.lit(1_000_000)).alias("n")).count().orderBy(F.desc("n")).collect()
    least, total = 1_000_001, 0
    for r in by_count:
        if total + r["count"] > most:
            break
        least, total = r["n"], total + r["count"]
    return least, total


def _arrays(rows: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and the other columns, one row per key."""
    table = rows.select("key", *columns).toArrow()
    key, *rest = (table.column(c).to_numpy() for c in ("key", *columns))
    del table
    order = np.argsort(key)
    return key[order], np.stack([c[order] for c in rest], 1)


def _slices(table: DataFrame, columns: Sequence[str], rows: int, most: int) -> list[tuple]:
    """All rows, packed in ranges of keys of about ``most`` rows: the driver holds one unpacked."""
    ends = [int(x) for x in np.linspace(-(2**63), 2**63, rows // most + 2)]
    return [_packed(*_arrays(table.where(F.col("key").between(lo, hi - 1)), columns)) for lo, hi in zip(ends, ends[1:])]


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted in sorted keys, -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Rows:
    """Rows of numbers; equal ones, as most words and pairs have, are held once."""

    table: np.ndarray
    codes: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.codes), self.table.shape[1]

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.table[self.codes[at]]

    def __array__(self, dtype: np.dtype | None = None, copy: bool | None = None) -> np.ndarray:
        return self.table[self.codes].astype(dtype or self.table.dtype, copy=False)


def _coded(values: np.ndarray) -> Rows:
    """The distinct rows, and the place of each row among them."""
    code = np.zeros(len(values), np.int64)
    for column in values.T:
        different, own = np.unique(column, return_inverse=True)
        _, first, code = np.unique(code * max(len(different), 1) + own, return_index=True, return_inverse=True)
    return Rows(values[first], code.astype(np.uint16 if len(first) < 1 << 16 else np.uint32))


def _packed(keys: np.ndarray, values: np.ndarray | Rows) -> tuple:
    """Sorted keys by their differences, byte by byte, and values as distinct rows, so that what travels takes a third.
    At the end the numbers of keys and of distinct rows."""
    steps = np.diff(keys.view(np.uint64), prepend=np.uint64(0))
    squeeze = zstandard.ZstdCompressor(level=1).compress
    rows = values if isinstance(values, Rows) else _coded(values)
    parts = steps.view(np.uint8).reshape(-1, 8).T, rows.codes, rows.table.T
    return *(squeeze(p.tobytes()) for p in parts), rows.codes.dtype.str, rows.table.dtype.str, rows.shape[1], len(keys), len(rows.table)


def _unpacked(steps: bytes, codes: bytes, table: bytes, code: str, kind: str, width: int, n: int, different: int) -> tuple[np.ndarray, Rows]:
    expand = zstandard.ZstdDecompressor().decompress
    each = np.frombuffer(expand(steps), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
    rows = np.frombuffer(expand(table), np.dtype(kind)).reshape(width, different).T.copy()
    return np.cumsum(each, out=each).view(np.int64), Rows(rows, np.frombuffer(expand(codes), np.dtype(code)))


def _stacked(slices: list[tuple]) -> tuple[np.ndarray, Rows]:
    """Keys and rows of packed slices, which are taken from the list one after the other: one is held twice, not all."""
    sizes, different = ([packed[i] for packed in slices] for i in (-2, -1))
    keys, codes = np.empty(sum(sizes), np.int64), np.empty(sum(sizes), np.uint16 if sum(different) < 1 << 16 else np.uint32)
    tables = []
    at = before = 0
    slices.reverse()
    for size, some in zip(sizes, different):
        keys[at : at + size], rows = _unpacked(*slices.pop())
        np.add(rows.codes, before, out=codes[at : at + size], dtype=codes.dtype, casting="unsafe")
        tables.append(rows.table)
        at, before = at + size, before + some
    return keys, Rows(np.concatenate(tables), codes)


@dataclass
class Model:
    total: np.ndarray  # continuation counts by class, over all words
    left: np.ndarray  # share of them that the discounts take, by class
    contexts: float  # of the shared distribution: contexts and words, and one unknown
    word_taken: np.ndarray  # (2, 4) discounts of a continuation count, by class
    pair_taken: np.ndarray  # (2, 4) of a pair's count
    words: np.ndarray  # sorted hashes
    sums: np.ndarray | Rows  # (words, SUMS)
    slices: list[tuple]  # pairs by ascending keys, packed; sorted keys and (pairs, 2) counts where the model arrives

    def __getstate__(self) -> dict:
        state = dict(self.__dict__, words=_packed(self.words, self.sums))
        return {k: v for k, v in state.items() if k not in ("sums", "pairs", "counts", "sent")}

    def travel(self, spark: SparkSession) -> Broadcast:
        """What :func:`_arrived` makes a model of, sent once for all jobs; the driver lets go of its words and pairs."""
        if "sent" not in self.__dict__:
            self.sent = spark.sparkContext.broadcast(self.__getstate__())
            self.words, self.sums, self.slices = self.words[:0].copy(), Rows(np.zeros((0, len(SUMS))), np.zeros(0, np.uint16)), []
        return self.sent

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.words, self.sums = _unpacked(*state["words"])
        self.pairs, self.counts = _stacked(self.slices)

    def missing(self, texts: list[str]) -> list[np.ndarray]:
        """Per text, the different words and pairs that are not among those sent."""
        w, v, at = _tokens(texts)
        pair = _pair(v, w)
        lost_v, lost_w, lost_p = _find(self.words, v) < 0, _find(self.words, w) < 0, _find(self.pairs, pair) < 0
        # Words before are words of the text as well, but for the start of a text.
        return [np.unique(np.concatenate([v[a : a + 1][lost_v[a : a + 1]], w[a:b][lost_w[a:b]], pair[a:b][lost_p[a:b]]])) for a, b in zip(at[:-1], at[1:])]

    def evidence(self, w: np.ndarray, v: np.ndarray, more: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each word, toxic minus ordinary: after the one before, and by itself. ``more``: sorted keys
        and SUMS of words and pairs that were not sent."""

        def known(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            wanted, of = np.unique(wanted, return_inverse=True)
            at = _find(keys, wanted)
            out = np.zeros((len(wanted), values.shape[1]))
            out[at >= 0] = values[at[at >= 0]]
            if more is not None:
                there = _find(more[0], wanted)
                use = (at < 0) & (there >= 0)
                out[use] = more[1][there[use], : values.shape[1]]
            return out[of]

        own, before, both = known(self.words, self.sums, w), known(self.words, self.sums, v), known(self.pairs, self.counts, _pair(v, w))
        shared = (own[:, 2] + 1) / self.contexts
        p, alone = [], []
        for c in (0, 1):
            k, n, after = own[:, c], both[:, c], before[:, 3 + c]
            single = (k - self.word_taken[c][np.minimum(k, 3).astype(int)]) / self.total[c] + self.left[c] * shared
            back = np.where(after > 0, before[:, 5 + c] / np.maximum(after, 1), 1.0)
            p.append((n - self.pair_taken[c][np.minimum(n, 3).astype(int)]) / np.maximum(after, 1) + back * single)
            alone.append(single)
        return np.log(p[1] / p[0]), np.log(alone[1] / alone[0])


def _arrived(sent: Broadcast) -> Model:
    """The model in a task. A worker unpacks it once, for its later tasks too, and lets go of what travelled."""
    state = sent.value
    if "model" not in state:
        model = object.__new__(Model)
        model.__setstate__(dict(state))
        state.clear()
        state["model"] = model
    return state["model"]


@dataclass
class Tables:
    """What is known of words and pairs that were not sent: (key, SUMS), null where a pair has none."""

    rest: DataFrame | None


def build(pairs: DataFrame) -> tuple[Model | None, Tables]:
    """The model from (written) pairs, and what it does not hold itself; None without words of both classes."""
    _, taken = _discounts(pairs, ("n0", "n1"))
    words = materialize(word_sums(pairs, taken), "word_sums")
    times, word_taken = _discounts(words, ("k0", "k1"))
    sums = [F.sum(c).alias(c) for c in ("k0", "k1", "ahead")]
    some = [F.sum((F.col(c) > 0).cast("long")).alias(f"some_{c}") for c in ("k0", "k1")]
    all_ = words.agg(*sums, *some, F.count(F.lit(1)).alias("types")).first()
    if not all_["k0"] or not all_["k1"]:
        return None, Tables(None)
    total = np.array([all_["k0"], all_["k1"]], float)
    left = []
    for c in (0, 1):
        n1, n2 = times[c][:2]
        d1, d2, d3 = word_taken[c]
        left.append((d1 * n1 + d2 * n2 + d3 * (all_[f"some_k{c}"] - n1 - n2)) / total[c])
    n_word, n_pair = F.col("ahead") + F.col("t0") + F.col("t1"), F.col("n0") + F.col("n1")
    (least_word, sent_words), (least_pair, sent_pairs) = _least_sent(words, n_word, SENT_WORDS), _least_sent(pairs, n_pair, SENT_PAIRS)
    most = pairs.agg(F.max(F.greatest("n0", "n1"))).first()[0]
    narrow = "int" if most < 1 << 31 else "long"
    keyed = pairs.select(_key_of(F.col("v"), F.col("w")).alias("key"), F.col("n0").cast(narrow).alias("n0"), F.col("n1").cast(narrow).alias("n1"))
    held, sums = _stacked(_slices(words.where(n_word >= least_word), SUMS, sent_words, SLICE // 4))
    slices = _slices(keyed.where(n_pair >= least_pair), ("n0", "n1"), sent_pairs, SLICE)
    steps = lambda ds: np.array([[0.0, *d] for d in ds])
    contexts = float(all_["ahead"] + all_["types"] + 1)
    model = Model(total, np.array(left), contexts, steps(word_taken), steps(taken), held, sums, slices)
    all_sent = len(held) == all_["types"] and sent_pairs == pairs.count()
    if all_sent:
        discard(words)
        return model, Tables(None)
    rare_words = words.where(n_word < least_word).select("key", *[F.col(c).cast("double").alias(c) for c in SUMS])
    rare_pairs = keyed.where(n_pair < least_pair).select("key", *[F.col(c).cast("double").alias(k) for c, k in zip(("n0", "n1"), SUMS)])
    return model, Tables(rare_words.unionByName(rare_pairs, allowMissingColumns=True))


def _facts(model: Model, texts: list[str], more: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Per text: evidence per word of the whole text, of its best PASSAGE words in a row and of its most telling different
    words (TOPS of them), and the log of its words. What is picked for telling most is judged by words themselves, since
    among many pairs seen once some always tell much."""
    w, v, at = _tokens(texts)
    n = np.diff(at)
    whole, e = model.evidence(w, v, more)
    total = np.concatenate(([0.0], np.cumsum(whole)))
    run = np.concatenate(([0.0], np.cumsum(e)))
    lo, hi = at[:-1], at[1:]
    mean = (total[hi] - total[lo]) / np.maximum(n, 1)
    best = (run[hi] - run[lo]) / np.maximum(n, 1)
    long = np.flatnonzero(n >= PASSAGE)
    if len(long):
        inside = np.append(run[PASSAGE:] - run[:-PASSAGE], -np.inf)
        edges = np.stack([lo[long], hi[long] - PASSAGE + 1], 1).ravel()
        best[long] = np.maximum.reduceat(inside, edges)[::2] / PASSAGE
    of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((-e, of))
    key = scramble(scramble(of.astype(np.uint64) + np.uint64(1)) + w.astype(np.uint64))[order]
    order = order[np.sort(np.unique(key, return_index=True)[1])]  # each word of a text once, where it tells most
    own = of[order]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    tops = []
    for k in TOPS:
        some = rank < k
        tops.append(np.bincount(own[some], e[order][some], len(n)) / np.maximum(np.bincount(own[some], minlength=len(n)), 1))
    return np.stack([mean, best, *tops, np.log1p(n)], 1)


def _facts_of(model: Model, texts: list[str]) -> np.ndarray:
    return np.concatenate([_facts(model, texts[lo:hi]) for lo, hi in pieces(texts, BATCH)])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients, the last one constant, by Newton steps with a small ridge."""
    a = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(a.shape[1])
    ridge = np.diag([1e-2] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


@dataclass
class Scorer:
    model: Model | None
    tables: Tables
    weights: np.ndarray


def measure(docs: DataFrame, model: Model | None, tables: Tables, keep: Sequence[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with the facts of its text, tx_0, tx_1, ..."""
    ddl = ", ".join(f"tx_{i} double" for i in range(FACTS))
    if model is None:
        return map_texts(docs, keep, ddl, lambda: lambda ts: list(np.zeros((FACTS, len(ts)))), text)
    sent = model.travel(docs.sparkSession)
    if tables.rest is None:
        return map_texts(docs, keep, ddl, lambda: lambda ts: list(_facts_of(_arrived(sent), ts).T), text)

    def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            new = [i for i, k in enumerate(names) if k not in seen and not seen.add(k)]  # copies once a task
            for lo, hi in pieces([texts[i] for i in new]):
                each = _arrived(sent).missing([texts[i] for i in new[lo:hi]])
                of = pa.array([names[i] for i in new[lo:hi]], pa.binary()).take(pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each])))
                yield pa.RecordBatch.from_arrays([of, pa.array(np.concatenate(each))], names=["text_key", "key"])

    of_text = F.unhex(F.md5(text_of(quote(text))))
    wanted = docs.select(of_text.alias("text_key"), text_of(quote(text)).alias("t")).mapInArrow(lost, "text_key binary, key long").distinct()
    found = wanted.join(tables.rest, "key").select("text_key", F.struct("key", F.array(*[F.coalesce(c, F.lit(0.0)) for c in SUMS]).alias("s")).alias("r"))
    lists = materialize(found.groupBy("text_key").agg(F.collect_list("r").alias("rs")), "rare")
    names = [f"k{i}" for i in range(len(keep))]
    wide = docs.select(*[docs[quote(c)].alias(k) for c, k in zip(keep, names)], text_of(quote(text)).alias("t"), of_text.alias("text_key"))
    wide = wide.join(lists, "text_key", "left")
    inputs = [wide["t"], wide["rs.key"], F.flatten(wide["rs.s"])]

    def run(batches: Iterator[tuple[list[pa.Array], list[pa.Array]]]) -> Iterator[list[pa.Array]]:
        for kept, (column, keys, sums) in batches:
            texts = column.to_pylist()
            for lo, hi in pieces(texts):
                k = keys.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                x = sums.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(SUMS))
                k, first = np.unique(k, return_index=True)
                yield [c.slice(lo, hi - lo) for c in kept] + [pa.array(f) for f in _facts(_arrived(sent), texts[lo:hi], (k, x[first])).T]

    return map_kept(wide, names, inputs, ddl, run).toDF(*keep, *[f"tx_{i}" for i in range(FACTS)])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id") -> Scorer:
    """Count, build the model and calibrate it."""
    known = join_labels(docs.select(doc_id, text), labels, label, doc_id)
    pairs = materialize(count_pairs(known.where(fold(doc_id) != CALIBRATION), text), "pairs")
    model, tables = build(pairs)
    if tables.rest is None:
        discard(pairs)
    if model is None:
        share = labels.where(fold(doc_id) != 0).agg(F.avg((F.col(label) > 0).cast("double"))).first()[0]
        share = min(max(0.5 if share is None else share, 1e-3), 1 - 1e-3)
        return Scorer(None, tables, np.array([*[0.0] * FACTS, np.log(share / (1 - share))]))
    tuning = materialize(measure(known.where(fold(doc_id) == CALIBRATION), model, tables, [doc_id, "lb_y"], text), "tuning")
    facts = sample(tuning, MOST_ROWS, doc_id).toArrow()  # sampled once the rows are narrow
    y = facts.column("lb_y").to_numpy().astype(float)
    x = np.stack([facts.column(f"tx_{i}").to_numpy() for i in range(FACTS)], 1)
    if y.min(initial=1) == y.max(initial=0):  # nothing to calibrate on: evidence per word as it is
        return Scorer(model, tables, np.array([1.0, *[0.0] * FACTS]))
    return Scorer(model, tables, _logistic(x, y))


def score(docs: DataFrame, scorer: Scorer, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (all, if not given) of every row with ``tx_score``, which replaces a column of that name."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "tx_score"]
    names = [f"c{i}" for i in range(len(keep))]
    neutral = docs.select(*[docs[quote(c)].alias(n) for c, n in zip(keep, names)], docs[quote(text)].alias("text"))
    facts = measure(neutral, scorer.model, scorer.tables, names)
    z = F.lit(float(scorer.weights[-1]))
    for i, b in enumerate(scorer.weights[:-1]):
        z = z + F.col(f"tx_{i}") * F.lit(float(b))
    z = F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))
    return facts.select(*names, (1 / (1 + F.exp(-z))).alias("tx_score")).toDF(*keep, "tx_score")
