"""Byte-level BPE encoding and decoding with a rank queue.

Pre-tokens are linked lists of symbols. Every neighbouring pair that merges
waits in the bucket of its rank; a bitmap of two levels marks the buckets that
are not empty, and the lowest set bit names the rank that is next. A bucket
gives its positions from the left. Merging two symbols unlinks the right one
and queues the new pairs with both neighbours; entries whose pair has changed
meanwhile are stale and skipped when they come up. A pre-token of n bytes costs
about n steps, so one of a million bytes is no special case.

Texts are cut into pre-tokens by array operations. Each task keeps the tokens
of the pre-tokens it has met (at most REMEMBERED, then it starts anew), since
words repeat. The vocabulary is read once on the driver (a file of fixed size)
and travels with the tasks. Rows never move; memory is bounded by a batch (BATCH characters, or one longer text).
The pre-tokens of a batch that are new share one queue: see merge_many.

Defined results: a null or empty text has no tokens and decodes to no bytes;
special strings in a text are ordinary text; repeated rows are encoded one by
one; of pairs of equal rank the leftmost merges first; an unknown id fails; an
empty table gives no rows; an input column named as a returned one is replaced.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from acctpulse.llm.batches import hash_runs, map_kept, map_texts, pieces, quote
from acctpulse.llm.token_counts import SPACE, SPACES, UNSEEN, Vocabulary, _classes, pre_tokens

#: Pre-tokens whose tokens a task remembers.
REMEMBERED = 200_000
#: Characters that are encoded at once.
BATCH = 1_000_000
#: Bits of one word of the bitmap; its square bounds the number of ranks.
WORD = 512
BITS = [1 << i for i in range(WORD)]
#: Positions of a rank below which they are merged one by one.
SMALL = 12
NEVER = 2**62
#: Ids that one step of decoding handles; a longer list is a step of its own.
STEP = 500_000


@dataclass
class Merges:
    """What encoding and decoding need of a vocabulary.

    ``first`` has the id of each byte, ``ranks`` the rank of each pair (left *
    2**32 + right), ``merged`` the id that a rank makes, ``spelled`` the bytes of
    each id. ``whole`` has the pre-tokens that are looked up before any merge.
    """

    first: list[int]
    ranks: dict[int, int]
    merged: dict[int, int]
    spelled: dict[int, bytes]
    whole: dict[bytes, int] = field(default_factory=dict)


def read_ranks(path: str) -> Merges:
    """Read a file of base64 tokens with their ranks. Any two tokens merge whose bytes together are a token."""
    with open(path, "rb") as f:
        ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    ranks = {}
    for token, rank in ids.items():
        for cut in range(1, len(token)):
            left, right = ids.get(token[:cut]), ids.get(token[cut:])
            if left is not None and right is not None:
                ranks[left << 32 | right] = rank
    if max(ids.values()) >= WORD * WORD:
        raise ValueError("more ranks than the bitmap holds")
    return Merges([ids[bytes([b])] for b in range(256)], ranks, {r: r for r in ids.values()}, {r: t for t, r in ids.items()}, ids)


def of_vocabulary(v: Vocabulary) -> Merges:
    """The same of a vocabulary that lists its merges and looks no whole pre-token up."""
    first = v.first.tolist()
    ranks = dict(zip(v.pairs.tolist(), v.ranks.tolist()))
    spelled = {i: bytes([b]) for b, i in enumerate(first)}
    merged = dict(zip(v.ranks.tolist(), v.merged.tolist()))
    for pair, rank in sorted(ranks.items(), key=lambda x: x[1]):
        spelled[merged[rank]] = spelled[pair >> 32] + spelled[pair & 0xFFFFFFFF]
    if len(ranks) and max(merged) >= WORD * WORD:
        raise ValueError("more ranks than the bitmap holds")
    return Merges(first, ranks, merged, spelled)


def merge_all(m: Merges, piece: bytes) -> list[int]:
    """Ids of a pre-token."""
    known = m.whole.get(piece)
    if known is not None:
        return [known]
    ranks, merged, bits = m.ranks.get, m.merged, BITS
    ids = [m.first[b] for b in piece]
    n = len(ids)
    # Rank of the pair that begins at each symbol, None where it has none or the symbol is gone.
    own = [ranks(a << 32 | b) for a, b in zip(ids, ids[1:])]
    own.append(None)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting: dict = {}  # by rank: a position, or a heap of several
    words: dict[int, int] = {}
    top = 0
    for i, rank in enumerate(own):
        if rank is not None:
            if rank in waiting:
                bucket = waiting[rank]
                if type(bucket) is int:
                    waiting[rank] = [bucket, i]
                else:
                    bucket.append(i)  # ascending positions are a heap as they are
            else:
                waiting[rank] = i
                w = rank // WORD
                if w in words:
                    words[w] |= bits[rank % WORD]
                else:
                    words[w] = bits[rank % WORD]
                    top |= bits[w]
    while top:
        w = (top & -top).bit_length() - 1
        word = words[w]
        rank = w * WORD + (word & -word).bit_length() - 1
        i = waiting[rank]
        if type(i) is not int:
            bucket = i
            i = heappop(bucket)
            if len(bucket) == 1:
                waiting[rank] = bucket[0]
        else:
            del waiting[rank]
            word &= word - 1
            if word:
                words[w] = word
            else:
                del words[w]
                top &= top - 1
        if own[i] != rank:
            continue  # stale
        j = after[i]
        ids[i] = new = merged[rank]
        ids[j] = -1
        own[j] = own[i] = None
        k = after[i] = after[j]
        fresh = []
        h = before[i]
        if h >= 0:
            rank = own[h] = ranks(ids[h] << 32 | new)
            if rank is not None:
                fresh.append((rank, h))
        if k < n:
            before[k] = i
            rank = own[i] = ranks(new << 32 | ids[k])
            if rank is not None:
                fresh.append((rank, i))
        for rank, at in fresh:
            if rank in waiting:
                bucket = waiting[rank]
                if type(bucket) is int:
                    waiting[rank] = [bucket, at] if bucket < at else [at, bucket]
                else:
                    heappush(bucket, at)
            else:
                waiting[rank] = at
                w = rank // WORD
                if w in words:
                    words[w] |= bits[rank % WORD]
                else:
                    words[w] = bits[rank % WORD]
                    top |= bits[w]
    return [x for x in ids if x >= 0]


def sorted_pairs(m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The pairs in order, and their ranks; at the end one beyond all pairs, without a rank."""
    keys = np.fromiter(m.ranks, np.int64, len(m.ranks))
    order = np.argsort(keys)
    ranks = np.fromiter(m.ranks.values(), np.int64, len(m.ranks))[order]
    return np.append(keys[order], 2**63 - 1), np.append(ranks, NEVER)


def merge_many(m: Merges, fresh: Sequence[bytes], pairs: tuple[np.ndarray, np.ndarray]) -> list[list[int]]:
    """Ids of many pre-tokens, in one linked list with one rank queue.

    A bucket holds the positions of its rank in all pre-tokens; a large one is
    merged by array operations, a small one position by position. Pre-tokens do
    not touch each other, so this is what each would do on its own, unless a
    merge makes a pair of a lower rank, which would have gone before the rest of the
    bucket: such a pre-token is merged again on its own.
    """
    size = np.array([len(p) for p in fresh])
    text = np.frombuffer(b"".join(fresh), np.uint8)
    n = len(text)
    ends = np.cumsum(size)
    starts = ends - size
    # One more symbol stands for what is before and after a pre-token.
    ids = np.append(np.array(m.first, np.int64)[text], -1)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends - 1] = before[starts] = after[n] = before[n] = n
    keys, ranked = pairs

    def rank_of(q: np.ndarray) -> np.ndarray:
        key = ids[q] << 32 | ids[after[q]]  # -1, so no pair, where nothing follows
        at = keys.searchsorted(key)
        return np.where(keys[at] == key, ranked[at], NEVER)

    own = np.append(rank_of(np.arange(n)), NEVER)
    by_rank = np.argsort(own[:n], kind="stable")
    by_rank = by_rank[: int((own[:n] < NEVER).sum())]
    found, at = np.unique(own[by_rank], return_index=True)
    waiting = {r: p.tolist() for r, p in zip(found.tolist(), np.split(by_rank, at[1:]))} if len(found) else {}
    words: dict[int, int] = {}
    for rank in waiting:
        words[rank // WORD] = words.get(rank // WORD, 0) | BITS[rank % WORD]
    top = sum(BITS[w] for w in words)
    again: list[int] = []
    ids_, after_, before_, own_ = (memoryview(v) for v in (ids, after, before, own))
    get, merged, bits = m.ranks.get, m.merged, BITS
    while top:
        w = (top & -top).bit_length() - 1
        word = words[w]
        rank = w * WORD + (word & -word).bit_length() - 1
        bucket = waiting.pop(rank)
        word &= word - 1
        words[w] = word
        if not word:
            top &= top - 1
        new, queued = merged[rank], []
        if len(bucket) < SMALL:
            bucket.sort()
            for i in bucket:
                if own_[i] != rank:
                    continue  # stale
                j = after_[i]
                k = after_[j]
                ids_[i], ids_[j], own_[j], own_[i] = new, -1, NEVER, NEVER
                after_[i] = k
                h = before_[i]
                if h != n:
                    r = own_[h] = get(ids_[h] << 32 | new, NEVER)
                    if r != NEVER:
                        queued.append((r, h))
                if k != n:
                    before_[k] = i
                    r = own_[i] = get(new << 32 | ids_[k], NEVER)
                    if r != NEVER:
                        queued.append((r, i))
        else:
            p = np.sort(np.array(bucket))
            p = p[own[p] == rank]
            # Where pairs overlap, every other one merges, from the left.
            j = after[p]
            follows = p[1:] == j[:-1]
            if follows.any():
                follows = np.append(False, follows)
                first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(p))))
                p = p[(np.arange(len(p)) - first) % 2 == 0]
                j = after[p]
            k = after[j]
            ids[p], ids[j], own[j] = new, -1, NEVER
            after[p] = k
            before[k] = p
            h = before[p]
            own[p] = -1  # symbols that merge next to each other are not looked at twice
            q = np.concatenate((p, h[(h != n) & (own[h] >= 0)]))
            r = own[q] = rank_of(q)
            some = r < NEVER
            queued = zip(r[some].tolist(), q[some].tolist())
        for r, i in queued:
            if r in waiting:
                waiting[r].append(i)
            else:
                waiting[r] = [i]
                w = r // WORD
                words[w] = words.get(w, 0) | bits[r % WORD]
                top |= bits[w]
            if r < rank:
                again.append(i)
    left = np.flatnonzero(ids[:n] >= 0)
    cut = np.searchsorted(left, ends).tolist()
    flat = ids[left].tolist()
    out = [flat[a:b] for a, b in zip([0, *cut], cut)]
    for i in np.unique(np.searchsorted(ends, again, side="right")).tolist() if again else ():
        out[i] = merge_all(m, fresh[i])
    return out


def encoder(m: Merges) -> Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to the ids of all, and the offset of each text's first (one more at the end)."""
    classes = np.full(0x110000, UNSEEN, np.uint8)
    classes[SPACES] = SPACE
    pairs = sorted_pairs(m)
    known: dict[bytes, bytes] = {}  # ids as 32-bit numbers

    def encode(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        some = [i for i, t in enumerate(texts) if t]
        if not some:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.cumsum([0, *(len(texts[i]) for i in some)])[:-1]
        raw = whole.encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw, np.uint8)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        cuts = pre_tokens(points, _classes(points, classes), begins)
        starts = np.concatenate(([0], np.cumsum(width)))[cuts]
        ends = np.append(starts[1:], len(data))
        lengths = ends - starts
        # Equal pre-tokens are merged once; those that only share a hash with another are on their own.
        _, sample, same = np.unique(hash_runs(data, starts, ends), return_index=True, return_inverse=True)
        like = sample[same]
        odd = lengths != lengths[like]
        inside = np.repeat((np.where(odd, 0, starts[like]) - starts).astype(np.int32), lengths) + np.arange(len(data), dtype=np.int32)
        alone = np.flatnonzero(odd | (np.add.reduceat(data[inside] != data, starts) > 0))
        same[alone] = len(sample) + np.arange(len(alone))
        chosen = [raw[starts[at] : ends[at]] for at in np.concatenate((sample, alone)).tolist()]
        if len(known) >= REMEMBERED:
            known.clear()
        fresh = [p for p in dict.fromkeys(chosen) if p not in known]
        for p in fresh:
            if p in m.whole:
                known[p] = array("i", [m.whole[p]]).tobytes()
        fresh = [p for p in fresh if p not in known]
        if fresh:
            known.update((p, array("i", x).tobytes()) for p, x in zip(fresh, merge_many(m, fresh, pairs)))
        found = [known[p] for p in chosen]
        size = np.array([len(x) for x in found]) // 4
        table, at = np.frombuffer(b"".join(found), np.int32), np.cumsum(size) - size
        count = size[same]
        upto = np.cumsum(count)
        ids = table[np.repeat(at[same] - (upto - count), count) + np.arange(upto[-1])]
        owner = np.array(some)[np.searchsorted(begins, cuts, side="right") - 1]
        per = np.bincount(owner, count, len(texts)).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(per)))

    return encode


def spelling(m: Merges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all ids one after another, and by id the offset and the length (-1: no such id)."""
    n = max(m.spelled) + 1
    size = np.full(n, -1, np.int64)
    for i, b in m.spelled.items():
        size[i] = len(b)
    at = np.concatenate(([0], np.cumsum(np.maximum(size, 0))))[:-1]
    blob = b"".join(m.spelled[i] for i in range(n) if i in m.spelled)
    return np.frombuffer(blob, np.uint8), at, size


def spell(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ids one after another, and the offset at which each starts (one more at the end)."""
    blob, at, size = table
    if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or size[ids].min() < 0):
        raise ValueError("an id that the vocabulary does not have")
    length = size[ids]
    offset = np.concatenate(([0], np.cumsum(length)))
    return blob[np.repeat(at[ids] - offset[:-1], length) + np.arange(offset[-1])], offset


def encode(docs: DataFrame, merges: Merges, keep: Sequence[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (all, if not given) of every row with ``bb_ids``, the ids of its text."""

    def make():
        work = encoder(merges)

        def rows(texts: list[str]) -> list[pa.Array]:
            parts = [work(texts[lo:hi]) for lo, hi in pieces(texts, BATCH)]
            ids = np.concatenate([np.zeros(0, np.int32), *(i for i, _ in parts)])
            at = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(a) for _, a in parts)]))))
            return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]

        return rows

    return map_texts(docs, docs.columns if keep is None else keep, "bb_ids array<int>", make, text)


def decode(rows: DataFrame, merges: Merges, ids: str = "bb_ids") -> DataFrame:
    """Every row with ``bb_bytes``, the bytes that its ids spell (null: none)."""
    table = spelling(merges)

    def run(batches: Iterator[tuple[list[pa.Array], list[pa.Array]]]) -> Iterator[list[pa.Array]]:
        for kept, (lists,) in batches:
            n = len(lists)
            upto = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            lo = 0
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + STEP, side="right")) - 1)
                data, at = spell(table, flat[upto[lo] : upto[hi]])
                ends = at[upto[lo : hi + 1] - upto[lo]].astype(np.int32)
                spelled = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(data)])
                yield [*(c.slice(lo, hi - lo) for c in kept), spelled]
                lo = hi

    return map_kept(rows, rows.columns, [rows[quote(ids)]], "bb_bytes binary", run)
