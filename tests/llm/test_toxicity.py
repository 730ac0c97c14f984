"""The language models against sums over dictionaries, and words and pairs that are not sent against those that are."""

import math
import pickle
import random
import re
from collections import Counter

import numpy as np
import pytest

from acctpulse.llm import toxicity as T


def texts_of(seed, many):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["nasty", "awful", "\u00e9t\u00e9"]
    out = []
    for i in range(many):
        y = int(rng.random() < 0.3)
        text = " ".join(rng.choices(words, [*[1 / (k + 1) for k in range(60)], 0.4 * y, 0.4 * y, 0.1], k=rng.randint(0, 25)))
        out.append((i, text.capitalize() + rng.choice([".", "", " !"]), y))
    return out


def words_of(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())


def brute(rows):
    """Evidence of a word after another and by itself, from counts in dictionaries."""
    n = [Counter(), Counter()]
    for _, text, y in rows:
        ws = words_of(text)
        n[y].update(zip([None, *ws], ws))
    after = [Counter() for _ in n]
    contexts = [Counter() for _ in n]
    for c in (0, 1):
        for (v, w), k in n[c].items():
            after[c][v] += k
            contexts[c][w] += 1
    ahead = Counter(w for _, w in set(n[0]) | set(n[1]))
    heads = set(ahead) | {v for v, _ in set(n[0]) | set(n[1])}

    def discounts(counts):
        have = Counter(counts)
        n1, n2, n3, n4 = (have[i] or 0.5 for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        return [0.0, *(min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw))]

    pair_d = [discounts(x.values()) for x in n]
    word_d = [discounts(x.values()) for x in contexts]

    def p(c, v, w):
        all_ = sum(contexts[c].values())
        gone = lambda x: word_d[c][min(x, 3)]
        shared = (ahead[w] + 1) / (sum(ahead.values()) + len(heads) + 1)
        single = (contexts[c][w] - gone(contexts[c][w])) / all_ + sum(map(gone, contexts[c].values())) / all_ * shared
        if not after[c][v]:
            return single, single
        back = sum(pair_d[c][min(k, 3)] for (a, _), k in n[c].items() if a == v) / after[c][v]
        k = n[c][v, w]
        return (k - pair_d[c][min(k, 3)]) / after[c][v] + back * single, single

    return lambda v, w: [math.log(a / b) for a, b in zip(p(1, v, w), p(0, v, w))]


@pytest.mark.parametrize("sent", [None, 0, 40])
def test_evidence_equals_dictionaries(spark, monkeypatch, sent):
    if sent is not None:
        monkeypatch.setattr(T, "SENT_WORDS", sent)
        monkeypatch.setattr(T, "SENT_PAIRS", sent)
    monkeypatch.setattr(T, "SLICE", 100)
    rows = texts_of(1, 120)
    pairs = T.count_pairs(spark.createDataFrame(rows, "doc_id long, text string, lb_y int"))
    model, tables = T.build(T.materialize(pairs, "pairs"))
    assert (tables.rest is None) == (sent is None) and len(model.words) <= (1 << 20 if sent is None else sent)
    tests = [(i, t) for i, t, _ in texts_of(2, 40)] + [(100, "never seen words"), (101, ""), (102, None), (103, "W1 w2"), (104, "W1 w2")]
    got = T.measure(spark.createDataFrame(tests, "doc_id long, text string"), model, tables, ["doc_id"]).collect()
    assert len(got) == len(tests)
    e = brute(rows)
    for r in got:
        ws = words_of(dict(tests)[r.doc_id] or "")
        pairs_, each = zip(*[e(v, w) for v, w in zip([None, *ws], ws)]) if ws else ((), ())
        mean = sum(pairs_) / max(len(ws), 1)
        best = max([sum(each[i : i + 5]) / 5 for i in range(len(ws) - 4)], default=sum(each) / max(len(ws), 1))
        top = max(each, default=0.0)
        assert np.allclose([r.tx_0, r.tx_1, r.tx_2, r.tx_5], [mean, best, top, math.log1p(len(ws))], atol=1e-9)


def test_scores_do_not_depend_on_what_is_sent(spark, data, monkeypatch):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    whole = {r.doc_id: r.tx_score for r in T.score(docs, T.train(docs, labels), ["doc_id"]).collect()}
    monkeypatch.setattr(T, "SENT_WORDS", 100)
    monkeypatch.setattr(T, "SENT_PAIRS", 1000)
    scorer = T.train(docs, labels)
    assert scorer.tables.rest is not None
    split = T.score(docs, scorer)
    assert split.columns == [*docs.columns, "tx_score"]
    rows = split.collect()
    assert len(rows) == docs.count() and all(abs(whole[r.doc_id] - r.tx_score) < 1e-9 for r in rows)


def test_discounts_stay_below_the_count():
    for times in ([0, 0, 0, 0], [10, 0, 0, 0], [5, 50, 500, 5000], [1000, 300, 100, 50]):
        assert all(0 < d < i + 1 for i, d in enumerate(T.estimated(times)))


def test_models_travel_whole():
    rng = np.random.default_rng(1)
    for many in (0, 1, 1000):
        keys = lambda: np.unique(rng.integers(-(2**63), 2**63 - 1, many))
        w, p = keys(), keys()
        sums, counts = rng.random((len(w), 7)), rng.integers(0, 9, (len(p), 2)).astype(np.int32)
        cut = len(p) // 3
        slices = [T._packed(p[:cut], counts[:cut]), T._packed(p[cut:], counts[cut:])]
        model = pickle.loads(pickle.dumps(T.Model(*[np.zeros(2)] * 2, 5.0, *[np.zeros((2, 4))] * 2, w, sums, slices)))
        for ours, theirs in ((model.words, w), (model.sums, sums), (model.pairs, p), (model.counts, counts)):
            assert np.array_equal(ours, theirs)


def test_equal_numbers_take_no_room_in_a_task():
    """A million words and pairs of few different numbers: keys and short codes, not 64 and 16 bytes each."""
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, 300_000))
    sums, counts = rng.integers(0, 3, (len(keys), 7)) / 4, rng.integers(0, 300, (len(keys), 2)).astype(np.int32)
    slices = [T._packed(keys[:100_000], counts[:100_000]), T._packed(keys[100_000:], counts[100_000:])]
    model = pickle.loads(pickle.dumps(T.Model(*[np.zeros(2)] * 2, 5.0, *[np.zeros((2, 4))] * 2, keys, sums, slices)))
    assert np.array_equal(model.sums, sums) and np.array_equal(model.counts, counts) and np.array_equal(model.pairs, keys)
    size = lambda rows: rows.codes.nbytes + rows.table.nbytes
    assert size(model.sums) <= 3 * len(keys) and size(model.counts) <= 10 * len(keys) and not model.slices


def test_pairs_of_a_word_meet_in_few_tasks(spark):
    """Copies of a text in many tasks: each word's pairs are in at most four partitions, so that sums move little."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 40}" for k in range(30)), i % 2) for i in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = T.count_pairs(spark.createDataFrame(rows, "doc_id long, text string, lb_y int").repartition(6))
        parts = pairs.selectExpr("w", "spark_partition_id() AS p").groupBy("w").agg({"p": "approx_count_distinct"}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 40 and max(r[1] for r in parts) <= 4
