"""Alignment of the tokens of two tokenizers, and how their ids are linked over a corpus.

A is a byte-level BPE and reads a space and the text, B a piece model that puts
that space itself. Where both spell the same bytes, the offsets at which tokens of
both end cut them into groups; the tokens of a group are linked, each of A with each of B.

Most groups are one token of each side with the same bytes. An identity map,
from each A id to the B id of the same bytes, names such a pair by its A id
alone: documents that hold it are counted in one vector of vocabulary length
per task. Only other pairs enter a shuffle, counted per batch of documents
before, so that a pair that every document holds is one row per batch.

Two passes. The first encodes, aligns and writes, per document, its links as
numbers of occurrences by A id (identity) and by place in the batch's list of
other pairs, and per batch that list with the documents that hold each pair. The
lists are summed over the corpus by pair; the totals go back to the batches, where
the second pass adds them up per document. A batch is a million characters
or one longer text; its list is bounded by it. What the driver reads is bounded
by the vocabulary: the vector, and the highest count of each A id.

Defined results: texts that are null, empty, or that a side does not spell
byte by byte (its normalisation changes them) have no tokens and no groups;
repeated rows are documents of their own; ties for an id's highest count all
count; an empty table gives no rows; an input column named as a returned one
is replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctpulse.llm.batches import map_kept, pieces, quote
from acctpulse.llm.byte_bpe import Merges, encoder, of_vocabulary, spell, spelling
from acctpulse.llm.token_counts import read_vocabulary
from acctpulse.session import materialize

#: Characters of a batch.
BATCH = 1_000_000
Spelling = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Pair:
    """Both tokenizers: A's merges, B's model file as bytes, the bytes of their ids, and the identity map (-1: none)."""

    merges: Merges
    model: bytes
    a: Spelling
    b: Spelling
    same: np.ndarray


def read_pair(path_a: str, path_b: str) -> Pair:
    """Read A (byte-level BPE, ``.json``) and B (``.model``)."""
    import sentencepiece

    merges = of_vocabulary(read_vocabulary(path_a))
    with open(path_b, "rb") as f:
        model = f.read()
    b = sentencepiece.SentencePieceProcessor(model_proto=model)
    spelled = {}
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        spelled[i] = bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
    # Of ids that spell the same, a piece goes before a byte.
    ids = {spelled[i]: i for i in sorted(spelled, key=lambda i: (not b.is_byte(i), -i))}
    same = np.full(max(merges.spelled) + 1, -1, np.int64)
    for i, s in merges.spelled.items():
        same[i] = ids.get(s, -1)
    return Pair(merges, model, spelling(merges), spelling(Merges([], {}, {}, spelled)), same)


@dataclass
class Aligned:
    """Tokens of a batch: ids, their groups, offsets per text, and the group at which each text starts (one more at the end)."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray
    groups: np.ndarray
    ends: np.ndarray


def aligner(pair: Pair) -> Callable[[Sequence[str]], Aligned]:
    """A function that encodes texts by both tokenizers and aligns them."""
    import sentencepiece

    left = encoder(pair.merges)
    right = sentencepiece.SentencePieceProcessor(model_proto=pair.model)

    def align(texts: Sequence[str]) -> Aligned:
        a, at_a = left([" " + t if t else "" for t in texts])
        lists = right.encode([t or "" for t in texts], num_threads=1) if texts else []
        at_b = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        b = np.fromiter(chain.from_iterable(lists), np.int64, at_b[-1])
        a = a.astype(np.int64)
        (data_a, off_a), (data_b, off_b) = spell(pair.a, a), spell(pair.b, b)
        good = np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            if t:
                want = b" " + t.encode("utf-8", "surrogatepass")
                good[i] = (
                    data_a[off_a[at_a[i]] : off_a[at_a[i + 1]]].tobytes() == want
                    and data_b[off_b[at_b[i]] : off_b[at_b[i + 1]]].tobytes() == want
                )
        if not good.all():
            keep_a, keep_b = np.repeat(good, np.diff(at_a)), np.repeat(good, np.diff(at_b))
            a, b = a[keep_a], b[keep_b]
            at_a = np.concatenate(([0], np.cumsum(np.diff(at_a) * good)))
            at_b = np.concatenate(([0], np.cumsum(np.diff(at_b) * good)))
            off_a, off_b = (np.concatenate(([0], np.cumsum(s[2][x]))) for s, x in ((pair.a, a), (pair.b, b)))
        ends_a, ends_b = off_a[1:], off_b[1:]
        marks = np.zeros(int(off_a[-1]) + 1, bool)
        marks[ends_b] = True
        cut_a = marks[ends_a]
        marks[:] = False
        marks[ends_a] = True
        cut_b = marks[ends_b]
        upto = np.concatenate(([0], np.cumsum(cut_a)))
        group_b = np.cumsum(cut_b) - cut_b
        return Aligned(a, b, upto[:-1], group_b, at_a, at_b, upto[at_a], ends_a[cut_a])

    return align


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, one after another."""
    upto = np.cumsum(counts)
    return np.repeat(starts - (upto - counts), counts) + np.arange(upto[-1] if len(upto) else 0)


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``n`` of each."""
    keys, at = np.unique(key, return_inverse=True)
    return keys, np.bincount(at, n, len(keys)).astype(np.int64)


@dataclass
class Links:
    """Links of a batch: identity pairs (text, A id, occurrences) and others (text, place in ``codes``, occurrences)."""

    text_same: np.ndarray
    same: np.ndarray
    n_same: np.ndarray
    codes: np.ndarray
    text: np.ndarray
    place: np.ndarray
    n: np.ndarray


def links_of(x: Aligned, same: np.ndarray) -> Links:
    """All links by text, in the order of text and pair; a code is an A id * 2**32 + a B id."""
    groups = int(x.groups[-1])
    n_texts = len(x.groups) - 1
    owner = np.repeat(np.arange(n_texts), np.diff(x.groups))
    n_a, n_b = np.bincount(x.group_a, minlength=groups), np.bincount(x.group_b, minlength=groups)
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    # One token to one of the same bytes, named by its A id.
    single = np.flatnonzero((n_a == 1) & (n_b == 1))
    one = single[same[x.a[first_a[single]]] == x.b[first_b[single]]]
    exact = np.zeros(groups, bool)
    exact[one] = True
    # Different ids of each other group, then each A id with each B id of the group.
    wide = np.int64(2**32)
    odd_a, odd_b = ~exact[x.group_a], ~exact[x.group_b]
    key_a, count_a = _sums(x.group_a[odd_a] * wide + x.a[odd_a], np.ones(int(odd_a.sum())))
    key_b, count_b = _sums(x.group_b[odd_b] * wide + x.b[odd_b], np.ones(int(odd_b.sum())))
    group_of_a = key_a // wide
    size_b = np.bincount(key_b // wide, minlength=groups)
    start_b = np.cumsum(size_b) - size_b
    repeat = size_b[group_of_a]
    other = _runs(start_b[group_of_a], repeat)
    ids_a = np.repeat(key_a % wide, repeat)
    ids_b = key_b[other] % wide
    times = np.repeat(count_a, repeat) * count_b[other]
    text = np.repeat(owner[group_of_a], repeat) if len(group_of_a) else np.zeros(0, np.int64)
    alike = same[ids_a] == ids_b
    # A pair counts once per text, wherever its links are.
    key, n_same = _sums(
        np.concatenate((owner[one], text[alike])) * wide + np.concatenate((x.a[first_a[one]], ids_a[alike])),
        np.concatenate((np.ones(len(one), np.int64), times[alike])),
    )
    codes, place = np.unique(ids_a[~alike] * wide + ids_b[~alike], return_inverse=True)
    spread = max(len(codes), 1)
    held, n = _sums(text[~alike] * spread + place, times[~alike])
    return Links(key // wide, key % wide, n_same, codes, held // spread, held % spread, n)


def written(x: Aligned) -> list[bytes]:
    """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
    groups = int(x.groups[-1])
    n_a, n_b = np.bincount(x.group_a, minlength=groups), np.bincount(x.group_b, minlength=groups)
    place_a = np.arange(len(x.a)) + np.concatenate(([0], np.cumsum(n_b)))[x.group_a]
    place_b = np.arange(len(x.b)) + np.cumsum(n_a)[x.group_b]
    ids = np.empty(len(x.a) + len(x.b), np.int64)
    ids[place_a], ids[place_b] = x.a, x.b
    sign = np.full(len(ids), ord(","), np.uint8)
    sign[place_a[np.cumsum(n_a) - 1]] = ord("|")
    sign[place_b[np.cumsum(n_b) - 1]] = ord(";")
    # The decimal form of every id up to the largest, zeros in front left out, and room for the sign.
    top = int(ids.max()) if len(ids) else 0
    width = len(str(top))
    scale = 10 ** np.arange(width - 1, -1, -1)
    value = np.arange(top + 1)[:, None]
    shown = np.where((value >= scale) | (scale == 1), 48 + value // scale % 10, 0)
    form = np.concatenate((shown, np.zeros_like(value)), 1).astype(np.uint8)
    wide = form[ids]
    wide[:, width] = sign
    out = wide[wide > 0]
    upto = np.concatenate(([0], np.cumsum((form > 0).sum(1)[ids] + 1)))[x.at_a + x.at_b]
    # The last sign of a text is left out.
    return [out[lo : hi - 1].tobytes() if hi > lo else b"" for lo, hi in zip(upto[:-1], upto[1:])]


def _lists(n_texts: int, of: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Values as one list per text; ``of`` has the text of each, in order."""
    at = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n_texts))))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


Arrays = list[pa.Array]


def _batches(batches: Iterator[tuple[Arrays, Arrays]]) -> Iterator[tuple[Arrays, list[str]]]:
    """Kept columns and texts of batches of bounded size."""
    for kept, (column,) in batches:
        texts = [t or "" for t in column.to_pylist()]
        for lo, hi in pieces(texts, BATCH):
            yield [c.slice(lo, hi - lo) for c in kept], texts[lo:hi]


def align(docs: DataFrame, pair: Pair, keep: Sequence[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (all, if not given) of every row with ``ca_a`` and ``ca_b``, the ids by A and B, and the
    group of each token (``ca_group_a``, ``ca_group_b``, from 0)."""

    def run(batches: Iterator[tuple[Arrays, Arrays]]) -> Iterator[Arrays]:
        work = aligner(pair)
        for kept, texts in _batches(batches):
            x = work(texts)
            own_a, own_b = (g - np.repeat(x.groups[:-1], np.diff(at)) for g, at in ((x.group_a, x.at_a), (x.group_b, x.at_b)))
            lists = ((x.a, x.at_a), (x.b, x.at_b), (own_a, x.at_a), (own_b, x.at_b))
            yield [*kept, *(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int32())) for v, at in lists)]

    fields = "ca_a array<int>, ca_b array<int>, ca_group_a array<int>, ca_group_b array<int>"
    return map_kept(docs, docs.columns if keep is None else keep, [docs[quote(text)]], fields, run)


_COUNTS = "ca_a ca_b ca_groups ca_links ca_best ca_sum ca_written".split()
_FIRST = (
    "ca_row boolean, ca_batch string, ca_a long, ca_b long, ca_groups long, ca_links long, ca_written string, "
    "ca_same array<int>, ca_n_same array<bigint>, ca_place array<int>, ca_n array<bigint>, ca_codes array<bigint>, ca_docs array<bigint>"
)


def _first_pass(docs: DataFrame, pair: Pair, keep: Sequence[str], text: str) -> DataFrame:
    """Rows of documents; the first of a batch has the batch's other pairs. One more row per task has the vector."""
    kinds = [pa.bool_(), pa.string(), *[pa.int64()] * 4, pa.string()]
    kinds += [pa.list_(t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
    titles = [f.split()[0] for f in _FIRST.split(", ")]

    def run(batches: Iterator[tuple[Arrays, Arrays]]) -> Iterator[Arrays]:
        work = aligner(pair)
        vector = np.zeros(len(pair.same), np.int64)
        types = None
        for kept, texts in _batches(batches):
            types = [c.type for c in kept]
            x, n = work(texts), len(texts)
            found = links_of(x, pair.same)
            vector += np.bincount(found.same, minlength=len(vector))
            groups = int(x.groups[-1])
            product = np.bincount(x.group_a, minlength=groups) * np.bincount(x.group_b, minlength=groups)
            n_links = np.diff(np.concatenate(([0], np.cumsum(product)))[x.groups])
            held = np.bincount(found.place, minlength=len(found.codes))
            of_batch = [pa.array([v, *[None] * (n - 1)], pa.list_(pa.int64())) for v in (found.codes, held)]
            yield [
                *kept, pa.array([True] * n), pa.array([uuid.uuid4().hex] * n),
                *[pa.array(v, pa.int64()) for v in (np.diff(x.at_a), np.diff(x.at_b), np.diff(x.groups), n_links)],
                pa.array([hashlib.sha256(w).hexdigest() if w else "" for w in written(x)], pa.string()),
                _lists(n, found.text_same, found.same, pa.int32()), _lists(n, found.text_same, found.n_same, pa.int64()),
                _lists(n, found.text, found.place, pa.int32()), _lists(n, found.text, found.n, pa.int64()), *of_batch,
            ]
        seen = np.flatnonzero(vector)
        if types is not None and len(seen):
            last = {"ca_row": False, "ca_same": seen, "ca_docs": vector[seen]}
            yield [*(pa.nulls(1, t) for t in types), *(pa.array([last.get(t)], k) for t, k in zip(titles, kinds))]

    return map_kept(docs, keep, [docs[quote(text)]], _FIRST, run)


def link_counts(docs: DataFrame, pair: Pair, keep: Sequence[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (all, if not given) of every row with

    ``ca_a``, ``ca_b``, ``ca_groups``, ``ca_links``: tokens of A and B, groups and links of its text;
    ``ca_best``: links whose count is the highest of their A id, where a pair's count is the number of rows of ``docs`` that hold it;
    ``ca_sum``: the counts of all links added up; ``ca_written``: SHA-256 of the groups as text, empty without tokens.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in _COUNTS]
    inner = [f"k{i}" for i in range(len(names))]
    # Kept columns pass under neutral names.
    neutral = docs.select(*[docs[quote(c)].alias(k) for c, k in zip(names, inner)], docs[quote(text)].alias("text"))
    first = materialize(_first_pass(neutral, pair, inner, "text"), "aligned")
    vocabulary = len(pair.same)
    # Both results have at most a row per A id.
    sums = first.where("NOT ca_row").select(F.inline(F.arrays_zip("ca_same", "ca_docs"))).groupBy("ca_same").agg(F.sum("ca_docs").alias("n"))
    vector = _by_id(sums, vocabulary)
    listed = first.where("ca_codes IS NOT NULL").select("ca_batch", F.posexplode(F.arrays_zip("ca_codes", "ca_docs")).alias("at", "p"))
    listed = listed.select("ca_batch", "at", F.col("p.ca_codes").alias("code"), F.col("p.ca_docs").alias("docs"))
    totals = materialize(listed.groupBy("code").agg(F.sum("docs").alias("total")), "pair_totals")
    highest = _by_id(totals.groupBy(F.shiftright("code", 32).cast("int").alias("a")).agg(F.max("total").alias("n")), vocabulary)
    best = np.maximum(vector, highest)
    back = listed.select("ca_batch", "at", "code").join(totals, "code").select(
        F.col("ca_batch").alias("batch"), "at", "total", F.shiftright("code", 32).cast("int").alias("a")
    )
    rows = first.where("ca_row").drop("ca_row", "ca_codes", "ca_docs")
    kinds = neutral.select(*inner).schema.fields + [first.schema[c] for c in _COUNTS if c in first.columns]
    kinds[-1:-1] = [T.StructField(c, T.LongType()) for c in _COUNTS[4:6]]

    def add_up(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        at = pairs.column("at").to_numpy()
        total, top = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        total[at] = pairs.column("total").to_numpy()
        top[at] = pairs.column("total").to_numpy() == best[pairs.column("a").to_numpy()]
        n_best = np.zeros(docs.num_rows, np.int64)
        n_sum = np.zeros(docs.num_rows, np.int64)
        for ids, times, counts, tops in (("ca_same", "ca_n_same", vector, vector == best), ("ca_place", "ca_n", total, top)):
            held = docs.column(ids).combine_chunks()
            owner = np.repeat(np.arange(docs.num_rows), held.value_lengths().to_numpy())
            which = held.flatten().to_numpy()
            n = docs.column(times).combine_chunks().flatten().to_numpy()
            np.add.at(n_sum, owner, n * counts[which])
            np.add.at(n_best, owner, n * tops[which])
        out = docs.select([*inner, *_COUNTS[:4]])
        out = out.append_column("ca_best", pa.array(n_best)).append_column("ca_sum", pa.array(n_sum))
        return out.append_column("ca_written", docs.column("ca_written"))

    return rows.groupBy("ca_batch").cogroup(back.groupBy("batch")).applyInArrow(add_up, T.StructType(kinds)).toDF(*names, *_COUNTS)


def _by_id(counts: DataFrame, vocabulary: int) -> np.ndarray:
    """(id, n) rows, at most one per id of the vocabulary, as a vector."""
    out = np.zeros(vocabulary, np.int64)
    for i, n in counts.toLocalIterator():
        out[i] = n
    return out
