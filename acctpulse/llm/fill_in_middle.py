"""Fill-in-the-middle transformation of whole texts.

A unit is white space with the word after it; white space at the end is a unit
of its own. A text is held as blocks of BLOCK code points; a Fenwick tree over
them stores how many units end in each block and how many code points it has.
Descending the tree by halving steps finds the block in which the k-th unit
ends; the place itself is then found inside this one block.

Where a text is cut, and in which order its parts are put, follows from a hash
of the seed and the document's id, so that reruns agree and rows may be dealt
to tasks in any way. Rows never move; memory is bounded by one text.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is
<S>suffix<P>prefix<M>middle, ``plain`` the text itself.

Defined results: a null or empty text is plain, empty and has no units; a text
that holds a marker stays plain, since it could not be restored; rows of one id
are cut by the same draws; a null id draws as an empty one; an empty table gives
no rows; an input column named as a returned one is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctpulse.llm.batches import map_kept, quote

#: Code points of a block.
BLOCK = 4096
#: Code points of output that one batch holds; a longer text ends its batch.
STEP = 2_000_000
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: White space between words.
SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)
FIELDS = "fm_units long, fm_form string, fm_prefix long, fm_middle long, fm_out string"


class Fenwick:
    """Prefix sums of several counts per block."""

    def __init__(self, counts: np.ndarray):
        """``counts`` has a row per block and a column per kind of count."""
        self.n = len(counts)
        self.tree = np.zeros((self.n + 1, counts.shape[1]), np.int64)
        upto = np.concatenate((np.zeros((1, counts.shape[1]), np.int64), np.cumsum(counts, 0)))
        node = np.arange(1, self.n + 1)
        # A node covers as many blocks as the lowest set bit of its number says.
        self.tree[1:] = upto[node] - upto[node - (node & -node)]

    def before(self, k: int) -> tuple[int, np.ndarray]:
        """The last block at whose start fewer than ``k`` of the first kind were counted, and all counts before it."""
        at, sums = 0, np.zeros(self.tree.shape[1], np.int64)
        step = 1 << self.n.bit_length()
        while step:
            to = at + step
            if to <= self.n and sums[0] + self.tree[to, 0] < k:
                at, sums = to, sums + self.tree[to]
            step >>= 1
        return at, sums


class Units:
    """The units of a text, by their ends."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        word = ~np.isin(points, SPACES)
        self.last = np.empty(len(points), bool)  # code points at which a unit ends
        self.last[:-1] = word[:-1] & ~word[1:]
        self.last[-1:] = True
        blocks = np.arange(0, len(points), BLOCK)
        units = np.add.reduceat(self.last.astype(np.int64), blocks) if len(blocks) else np.zeros(0, np.int64)
        sizes = np.minimum(BLOCK, len(points) - blocks)
        self.tree = Fenwick(np.stack((units, sizes), 1))
        self.count = int(units.sum())

    def end(self, k: int) -> int:
        """Code points up to the end of the k-th unit; 0 for none."""
        if not k:
            return 0
        block, (units, size) = self.tree.before(k)
        inside = self.last[block * BLOCK : (block + 1) * BLOCK]
        return int(size + np.flatnonzero(inside)[k - units - 1]) + 1


def draws(seed: int, doc_id: object) -> list[int]:
    """Four numbers below 2**32 that follow from the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearrange(text: str, h: Sequence[int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), and the output."""
    units = Units(text)
    n = units.count
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (units.end(k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(
    docs: DataFrame, keep: Sequence[str] | None = None, text: str = "text", doc_id: str = "doc_id", seed: int = 42, rate: int = 50, spm: int = 80
) -> DataFrame:
    """The columns ``keep`` (all, if not given) of every row with ``fm_units``, ``fm_form``, ``fm_prefix``, ``fm_middle`` and ``fm_out``.

    ``rate`` percent of the texts are rearranged, ``spm`` percent of these with the suffix first.
    """
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[tuple[list[pa.Array], list[pa.Array]]]) -> Iterator[list[pa.Array]]:
        for kept, (ids, texts) in batches:
            lo = size = 0
            rows: list[tuple] = []
            for i, (d, t) in enumerate(zip(ids, texts)):
                rows.append(rearrange(t.as_py() or "", draws(seed, d.as_py()), rate, spm))
                size += len(rows[-1][4])
                if size > STEP or i == len(ids) - 1:
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                    yield [*(c.slice(lo, len(rows)) for c in kept), *columns]
                    lo, size, rows = i + 1, 0, []

    inputs = [docs[quote(doc_id)].cast("string"), docs[quote(text)]]
    return map_kept(docs, docs.columns if keep is None else keep, inputs, FIELDS, run)


def restored(out: Column | str = "fm_out", form: Column | str = "fm_form") -> Column:
    """The text that an output of the given form was made of.

    A marker occurs once in an output that is not plain, also across the borders of the parts, since none begins as another ends.
    """
    out = F.col(out) if isinstance(out, str) else out
    form = F.col(form) if isinstance(form, str) else form
    between = lambda a, b: F.substring_index(F.substring_index(out, a, -1), b, 1)
    middle = F.substring_index(out, MIDDLE, -1)
    return (
        F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
        .otherwise(out)
    )
