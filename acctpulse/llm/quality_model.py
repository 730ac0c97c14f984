"""A quality classifier: a generalised additive model with pairwise interactions.

Each document becomes a row of numbers about its form (shares of signs, repeated
words, lines and phrases, word lengths). Shallow trees, boosted in turn on one
feature after the other, add up to one lookup table per feature; then trees on
the strongest pairs of features add up to two-dimensional tables. A score is the
sum of table entries at a document's bins, through a logistic.

Documents are read once: features are written as a narrow table, which training
and scoring read. The model is fitted on the driver on at most MOST_ROWS
labelled rows (some megabytes); its tables are a few kilobytes. Scoring is a map.

Defined results: null and empty texts are scored by the bins of their zeros;
without two classes to learn from, every score is the share of label 1 (0.5
without any label); repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from acctpulse.llm.batches import hash_runs, hashed_words, joined, map_texts, scramble
from acctpulse.llm.labels import join_labels, sample

#: Labelled rows that the model is fitted on, at most.
MOST_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 8
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.1
#: Added to the curvature of a leaf.
SHRINK = 2.0

_SIGNS = {
    "upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "odd": b"#*$%&|<>", "pipes": b"|", "marks": b"!?",
    "stops": b".", "commas": b",;:", "quotes": b"\"'`", "brackets": b"()[]{}", "links": b"/@=_", "beyond": range(128, 256),
    "blanks": b" \t", "breaks": b"\n",
}


def features(texts: list[str]) -> np.ndarray:
    """One row per text; all are zero for an empty one."""
    data, at = joined(texts)
    n = len(texts)
    size = np.diff(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    chars = np.maximum(size, 1)
    out = []
    table = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256)
    table[:, 10] -= 1  # the newline between texts
    for signs in _SIGNS.values():
        out.append(table[:, list(signs)].sum(1) / chars)
    p = table / chars[:, None]
    out.append(-(p * np.log2(np.where(p > 0, p, 1))).sum(1))
    words, first = hashed_words(texts)
    count = np.diff(first)
    some = np.maximum(count, 1)
    of = np.repeat(np.arange(n), count)
    out += [np.log1p(size), np.log1p(count), size / some]
    salt = scramble(of.astype(np.uint64) + np.uint64(1))

    def share_repeated(width: int) -> np.ndarray:
        """Of windows of so many words, the share that are not the first of their kind."""
        m = len(words) - width + 1
        if m <= 0:
            return np.zeros(n)
        whole = of[:m] == of[width - 1 :]
        key = salt[:m].copy()
        for k in range(width):
            key = scramble(key + words[k : k + m])
        own = of[:m][whole]
        new = own[np.unique(key[whole], return_index=True)[1]]
        total = np.bincount(own, minlength=n)
        return (total - np.bincount(new, minlength=n)) / np.maximum(total, 1)

    out += [share_repeated(k) for k in (1, 2, 5)]
    twin = np.bincount(of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])], minlength=n) if len(words) > 1 else np.zeros(n)
    out.append(twin / some)
    # Lines that are not empty.
    stop = np.flatnonzero(data == 10)
    start = np.append(0, stop[:-1] + 1) if len(stop) else stop
    full = stop > start
    start, stop = start[full], stop[full]
    line_of = owner[start] if len(start) else np.zeros(0, int)
    lines = np.bincount(line_of, minlength=n)
    key = hash_runs(data, start, stop) + (scramble(line_of.astype(np.uint64) + np.uint64(1)) if len(start) else np.zeros(0, np.uint64))
    new = np.bincount(line_of[np.unique(key, return_index=True)[1]], minlength=n) if len(start) else np.zeros(n)
    out += [np.log1p(lines), size / np.maximum(lines, 1), (lines - new) / np.maximum(lines, 1)]
    x = np.stack(out, 1)
    x[size == 0] = 0
    return x.astype(np.float32)


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: table entries added up, feature by feature."""
        f = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            f += t[np.searchsorted(e, x[:, j], side="right")]
        for a, b, ea, eb, t in self.pairs:
            f += t[np.searchsorted(ea, x[:, a], side="right"), np.searchsorted(eb, x[:, b], side="right")]
        return 1 / (1 + np.exp(-f))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges at quantiles, halfway between neighbouring values."""
    u = np.unique(values)
    if len(u) > bins:
        u = np.unique(np.quantile(values, np.linspace(0, 1, bins)))
    return ((u[1:].astype(float) + u[:-1]) / 2).astype(np.float32)


def _best_cut(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """Gain and place of the best cut of bins [lo, hi)."""
    if hi - lo < 2:
        return 0.0, lo
    gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
    gs, hs = g[lo:hi].sum(), h[lo:hi].sum()
    gain = gl**2 / (hl + SHRINK) + (gs - gl) ** 2 / (hs - hl + SHRINK) - gs**2 / (hs + SHRINK)
    k = int(np.argmax(gain))
    return float(gain[k]), lo + k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of at most four leaves over ordered bins, as one value per bin."""
    _, mid = _best_cut(g, h, 0, len(g))
    ends = sorted({0, _best_cut(g, h, 0, mid)[1], mid, _best_cut(g, h, mid, len(g))[1], len(g)})
    value = np.zeros(len(g))
    for lo, hi in zip(ends, ends[1:]):
        value[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + SHRINK)
    return value


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cross of one cut in each direction of a two-dimensional histogram: gain and values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, value = 0.0, np.zeros(g.shape)
    if min(g.shape) < 2:
        return best, value
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    right, below, whole = cg[:-1, -1:], cg[-1:, :-1], cg[-1, -1]
    rh, bh, wh = ch[:-1, -1:], ch[-1:, :-1], ch[-1, -1]
    parts = [(a, b), (right - a, rh - b), (below - a, bh - b), (whole - right - below + a, wh - rh - bh + b)]
    gain = sum(x**2 / (y + SHRINK) for x, y in parts) - whole**2 / (wh + SHRINK)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    leaf = [x[i, j] / (y[i, j] + SHRINK) for x, y in parts]
    value[: i + 1, : j + 1], value[: i + 1, j + 1 :], value[i + 1 :, : j + 1], value[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j]), value


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables on features ``x`` and 0/1 labels ``y``."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(float(np.log(share / (1 - share))), [], [], [])
    base = float(np.log(share / (1 - share)))
    edges = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    f = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, (b, t) in enumerate(zip(bins, tables)):
            if len(t) < 2:
                continue
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)))
            t += step
            f += step[b]
    coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def histogram(a: int, b: int, w: np.ndarray) -> np.ndarray:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(cells[a] * shape[1] + cells[b], w, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = [(_quarters(histogram(a, b, g), histogram(a, b, h))[0], a, b) for a in range(len(bins)) for b in range(a)]
    chosen = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    pair_tables = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for a, b in chosen:
            g, h = slopes()
            step = RATE * _quarters(histogram(a, b, g), histogram(a, b, h))[1]
            pair_tables[a, b] += step
            f += step[cells[a], cells[b]]
    return Model(base, edges, tables, [(a, b, coarse[a], coarse[b], t) for (a, b), t in pair_tables.items()])


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the features of every row in ``qm_x``."""

    def make():
        def rows(texts: list[str]) -> list[pa.Array]:
            x = features(texts)
            flat = pa.array(x.ravel(), pa.float32())
            return [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), flat)]

        return rows

    return map_texts(docs, keep, "qm_x array<float>", make, text)


def train(measured: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", most: int = MOST_ROWS) -> Model:
    """A model from at most ``most`` labelled rows outside the held-out fold."""
    rows = sample(join_labels(measured.select(doc_id, "qm_x"), labels, label, doc_id), most, doc_id).select("qm_x", "lb_y").toArrow()
    y = rows.column("lb_y").to_numpy().astype(float)
    if not len(y):
        return fit(np.zeros((0, 0), np.float32), y)
    return fit(np.array(rows.column("qm_x").to_pylist(), np.float32), y)


def score(measured: DataFrame, model: Model) -> DataFrame:
    """The rows with ``qm_score`` in place of ``qm_x``."""
    names = [c for c in measured.columns if c != "qm_x"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measured.select(*names).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(len(names)).flatten().to_numpy()
                found = pa.array(model.score(flat.reshape(batch.num_rows, -1)), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], found], names=[*names, "qm_score"])

    return measured.select(*names, "qm_x").mapInArrow(run, f"{ddl}, qm_score double")
