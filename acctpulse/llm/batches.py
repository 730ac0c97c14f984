"""Texts of a DataFrame as batches of bounded size inside tasks, and their words as flat arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

#: Characters of the texts that one call handles; a longer text is a call of its own.
PIECE = 2_000_000


def pieces(texts: Sequence[str], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with at most so many characters, whole texts only."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def quote(name: str) -> str:
    """A column name that may hold dots or backticks, for use in expressions and schemas."""
    return "`" + name.replace("`", "``") + "`"


def map_kept(
    docs: DataFrame,
    keep: Sequence[str],
    inputs: Sequence[Column],
    fields: str,
    run: Callable[[Iterator[tuple[list[pa.Array], list[pa.Array]]]], Iterator[list[pa.Array]]],
) -> DataFrame:
    """Arrow batches of the columns ``keep`` and of ``inputs`` become those of ``keep`` and of the new ``fields`` (DDL).

    ``run`` gets pairs (kept columns, inputs) of one batch each. A kept column of the name of a new field is replaced
    by it; kept columns may have any name, since they pass under neutral ones.
    """
    new = docs.sparkSession.createDataFrame([], fields).schema
    names = [n for n in keep if n not in new.names]
    inner = [f"k{i}" for i in range(len(names))]
    kept = [docs[quote(n)].alias(k) for n, k in zip(names, inner)]
    schema = T.StructType([*docs.select(*kept).schema.fields, *new.fields])
    titles = [*inner, *new.names]

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = ((b.columns[: len(inner)], b.columns[len(inner) :]) for b in batches if b.num_rows)
        for columns in run(split):
            yield pa.RecordBatch.from_arrays(columns, names=titles)

    wide = docs.select(*kept, *[c.alias(f"x{i}") for i, c in enumerate(inputs)])
    return wide.mapInArrow(outer, schema).toDF(*names, *new.names)


def map_texts(
    docs: DataFrame,
    keep: Sequence[str],
    fields: str,
    make: Callable[[], Callable[[list[str]], Sequence]],
    text: str = "text",
) -> DataFrame:
    """The columns ``keep`` of every row with the new ``fields`` (DDL) computed from its text.

    ``make`` is called once per task and returns a function from a list of texts
    (null: empty) to one array or list per field. Rows are neither moved nor
    reordered. A kept column of the name of a new field is replaced by it.
    """
    arrow = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
        "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32()),
        "array<int>": pa.list_(pa.int32()),
    }
    kinds = [arrow[f.dataType.simpleString()] for f in docs.sparkSession.createDataFrame([], fields).schema.fields]

    def run(batches: Iterator[tuple[list[pa.Array], list[pa.Array]]]) -> Iterator[list[pa.Array]]:
        work = make()
        for kept, (column,) in batches:
            texts = [t or "" for t in column.to_pylist()]
            for lo, hi in pieces(texts):
                found = work(texts[lo:hi])
                columns = [c.slice(lo, hi - lo) for c in kept]
                yield columns + [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(found, kinds)]

    return map_kept(docs, keep, [docs[quote(text)]], fields, run)


def joined(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, a newline after each, and the offset at which each starts (one more at the end)."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(coded) + 1, np.int64)
    np.cumsum([len(c) + 1 for c in coded], out=at[1:])
    return np.frombuffer(b"\n".join([*coded, b""]), np.uint8), at


_ODD = np.uint64(0x9E3779B97F4A7C15)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """0th to (n-1)th power of a fixed odd number modulo 2**64."""
    p = np.full(max(n, 1), _ODD, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes [start, end); runs are sorted, not empty and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    inside = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    place = inside - np.repeat(starts, lengths)
    terms = (data[inside].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
    return scramble(sums + lengths.astype(np.uint64) * _ODD)


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def hashed_words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of all texts, and the offset of each text's first (one more at the end).

    A word is a run of ASCII letters and digits and of characters beyond ASCII.
    """
    data, at = joined([t.lower() for t in texts])
    word = _WORD_BYTE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    return hash_runs(data, starts, ends), np.searchsorted(starts, at)
