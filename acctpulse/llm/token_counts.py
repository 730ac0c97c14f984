"""Token counts by byte-pair merges on ragged arrays.

Texts are cut into pre-tokens by array operations on code points. The distinct
pre-tokens of a batch are held as one flat array of symbols; in each round
every sequence merges its lowest-ranked pair wherever it occurs, all sequences
at once, until none has a pair left. The symbols that survive are the tokens.

The vocabulary is read once on the driver (a file of fixed size) and travels
with the tasks as arrays. Rows never move; memory is bounded by the batch
(two million characters, or one longer text).

Defined results: a null or empty text has 0 bytes and 0 tokens; the strings of
special tokens inside a text count as one token each, as the library does by
default; repeated rows are counted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from acctpulse.llm.batches import hash_runs, map_texts

#: The contractions of the pre-tokenizer's pattern, and what it counts as white space.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE, UNSEEN = range(5)
NEVER = np.int32(2**31 - 1)


@dataclass
class Vocabulary:
    """A byte-level merge table: ``pairs`` (left * 2**32 + right, sorted) with their ``ranks`` and merged symbols."""

    first: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    special: list[str] = field(default_factory=list)


def read_vocabulary(path: str) -> Vocabulary:
    """Read a ``.json`` file of byte-level BPE with the usual pre-tokenizer; refuses any other kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
        raise ValueError("only byte-level BPE without a prefix space is supported")
    if spec["normalizer"] or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError("normalizers, dropout and whole-word lookup are not supported")
    added = spec["added_tokens"]
    if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
        raise ValueError("special tokens that take neighbours in are not supported")
    ids = model["vocab"]
    # Bytes that print stand for themselves, the others for the characters from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    keys = np.array([(ids[a] << 32) | ids[b] for a, b in merges], np.int64)
    order = np.argsort(keys)
    return Vocabulary(
        first=np.array([ids[letter[b]] for b in range(256)], np.int32),
        pairs=keys[order],
        ranks=order.astype(np.int32),
        merged=np.array([ids[a + b] for a, b in merges], np.int32)[order],
        special=sorted((a["content"] for a in added), key=len, reverse=True),
    )


def _classes(points: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The class of each code point; ``known`` holds those met before."""
    kinds = known[points]
    if (kinds == UNSEEN).any():
        for p in np.unique(points[kinds == UNSEEN]):
            major = unicodedata.category(chr(p))[0]
            known[p] = {"L": LETTER, "N": NUMBER}.get(major, OTHER)
        kinds = known[points]
    return kinds


def pre_tokens(points: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Indices at which pre-tokens start, for code points of texts that start at ``begins``.

    Runs of letters, numbers or other signs, with one space before; a run of
    white space leaves its last character to what follows.
    """
    n = len(points)
    opens = np.zeros(n + 1, bool)
    opens[begins] = True
    opens[n] = True
    edge = np.empty(n, bool)
    edge[0] = True
    edge[1:] = kinds[1:] != kinds[:-1]
    edge |= opens[:n]
    space = kinds == SPACE
    # White space right before something else in the same text.
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~opens[1:n])
    edge[last] = True
    edge[last[points[last] == 32] + 1] = False
    # An apostrophe on its own, with no space before, takes a contraction's letters.
    quote = np.flatnonzero((points[:-1] == 39) & (kinds[1:] == LETTER) & ~opens[1:n])
    quote = quote[edge[quote] & ~((quote > 0) & (points[quote - 1] == 32) & ~opens[quote])]
    for letters in CONTRACTIONS:
        at = quote[quote + len(letters) < n]
        fits = np.ones(len(at), bool)
        for k, c in enumerate(letters, 1):
            fits &= (points[at + k] == ord(c)) & ~opens[at + k]
        at = at[fits]
        edge[at + 1] = False
        after = at + len(letters) + 1
        edge[after[after < n]] = True
        quote = np.setdiff1d(quote, at, assume_unique=True)
    return np.flatnonzero(edge)


def _ranks(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each pair (NEVER, if it has none) and its place in the table."""
    key = (left.astype(np.int64) << 32) | right
    at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
    return np.where(v.pairs[at] == key, v.ranks[at], NEVER), at


def surviving(v: Vocabulary, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of symbols left of each sequence (which start at ``starts``, none empty) after all merges."""
    count = np.diff(np.append(starts, len(symbols)))
    live = np.arange(len(starts))
    owner = np.repeat(live, count)
    ends = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    rank, place = _ranks(v, symbols, np.append(symbols[1:], 0))
    rank[ends] = NEVER
    while len(symbols):
        lengths = np.diff(np.append(starts, len(symbols)))
        best = np.minimum.reduceat(rank, starts)
        done = best == NEVER
        if done.any():
            count[live[done]] = lengths[done]
            stay = np.repeat(~done, lengths)
            symbols, rank, place, ends = symbols[stay], rank[stay], place[stay], ends[stay]
            live, lengths, best = live[~done], lengths[~done], best[~done]
            if not len(live):
                break
        hit = rank == np.repeat(best, lengths)
        # Where a symbol pairs with its equals, every other of the overlapping pairs merges, from the left.
        index = np.flatnonzero(hit)
        follows = np.append(False, np.diff(index) == 1)
        if follows.any():
            first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(index))))
            index = index[(np.arange(len(index)) - first) % 2 == 0]
        symbols[index] = v.merged[place[index]]
        ends[index] = ends[index + 1]
        gone = np.zeros(len(symbols), bool)
        gone[index + 1] = True
        new = index - np.arange(len(index))  # where the merged symbols are after the others have gone
        symbols, rank, place, ends = symbols[~gone], rank[~gone], place[~gone], ends[~gone]
        lengths = lengths - np.add.reduceat(gone, np.cumsum(lengths) - lengths)
        starts = np.cumsum(lengths) - lengths
        fresh = np.unique(np.concatenate((new, new[new > 0] - 1)))
        rank[fresh], place[fresh] = _ranks(v, symbols[fresh], symbols[np.minimum(fresh + 1, len(symbols) - 1)])
        rank[fresh[ends[fresh]]] = NEVER
    return count


def counter(v: Vocabulary) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to their bytes and tokens."""
    known = np.full(0x110000, UNSEEN, np.uint8)
    known[SPACES] = SPACE
    marks = re.compile("|".join(map(re.escape, v.special))) if v.special else None

    def count(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n_bytes = np.zeros(len(texts), np.int64)
        tokens = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, t in enumerate(texts):
            if marks and any(s in t for s in v.special):
                tokens[i] = len(marks.findall(t))
                n_bytes[i] = sum(len(s.encode()) for s in marks.findall(t))
                split = marks.split(t)
            else:
                split = [t]
            parts += [p for p in split if p]
            owner += [i] * sum(map(bool, split))
        if not parts:
            return n_bytes, tokens
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.cumsum([0, *map(len, parts)])[:-1]
        data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        offset = np.concatenate(([0], np.cumsum(width)))
        cuts = pre_tokens(points, _classes(points, known), begins)
        starts = offset[cuts]
        ends = np.append(starts[1:], len(data))
        part = np.searchsorted(begins, cuts, side="right") - 1
        owners = np.array(owner)[part]
        n_bytes += np.bincount(owners, ends - starts, len(texts)).astype(np.int64)
        # Merge each distinct pre-token once. Those that only share a hash with another are merged on their own.
        _, sample, same = np.unique(hash_runs(data, starts, ends), return_index=True, return_inverse=True)
        lengths = ends - starts
        like = sample[same]
        odd = lengths != lengths[like]
        inside = np.repeat(np.where(odd, 0, starts[like]) - starts, lengths) + np.arange(len(data))
        unlike = np.add.reduceat(data[inside] != data, starts) > 0
        alone = np.flatnonzero(odd | unlike)
        chosen = np.concatenate((sample, alone))
        same[alone] = len(sample) + np.arange(len(alone))
        size = lengths[chosen]
        at = np.cumsum(size) - size
        symbols = v.first[data[np.repeat(starts[chosen] - at, size) + np.arange(size.sum())]]
        left = surviving(v, symbols, at)
        tokens += np.bincount(owners, left[same], len(texts)).astype(np.int64)
        return n_bytes, tokens

    return count


def count_tokens(docs: DataFrame, vocabulary_path: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (all, if not given) of every row with ``tc_bytes`` and ``tc_tokens`` of its text."""
    vocabulary = read_vocabulary(vocabulary_path)
    return map_texts(docs, docs.columns if keep is None else keep, "tc_bytes long, tc_tokens long", lambda: counter(vocabulary), text)
