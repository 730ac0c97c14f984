import random

import numpy as np

from acctpulse.llm import near_duplicates as N


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_against_the_plain_table():
    rng = random.Random(4)
    for _ in range(400):
        a = [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        b = list(a) if rng.random() < 0.7 else [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 6)):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randint(0, len(b)), rng.randint(0, 5))
        most = rng.randint(0, 12)
        assert N.distance(a, b, most) == min(edit(a, b), most + 1)


def test_similarity_is_the_share_of_words_that_stay():
    a = np.arange(100, dtype=np.uint64)
    b = np.concatenate((a[:40], a[60:]))
    assert N.similar(a, b) == 0.8
    assert N.similar(a, np.concatenate((a[:40], a[61:]))) is None
    assert N.similar(a, a[::-1].copy()) is None


def corpus():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 400))]
        texts.append(base)
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    moved = texts[0][len(texts[0]) // 2 :] + texts[0][: len(texts[0]) // 2]  # the same words in another order
    return [" ".join(t) for t in [*texts, moved]]


def test_classes_against_brute_force(spark, rows):
    texts = corpus()
    label = list(range(len(texts)))
    words = [t.split() for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            longer = max(len(words[i]), len(words[j]))
            if len(set(words[i]) & set(words[j])) * 2 > longer and edit(words[i], words[j]) <= 0.2 * longer:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    found = N.classes(rows("doc_id long, text string", *enumerate(texts))).collect()
    got = {r.doc_id: r.class_id for r in found}
    assert got == {i: min(j for j in range(len(texts)) if label[j] == x) for i, x in enumerate(label)}
    sizes = {r.doc_id: r.class_size for r in found}
    assert all(sizes[i] == list(got.values()).count(got[i]) for i in got)
    assert all((r.n_links > 0) == (len({texts[j] for j in got if got[j] == r.class_id}) > 1) for r in found)


def scattered(words, rng, share, vocabulary):
    copy = list(words)
    for at in rng.sample(range(len(copy)), int(share * len(copy) + 1e-9)):
        copy[at] = rng.choice(vocabulary)
    return copy


def test_a_thousand_copies_of_one_original(spark, rows):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(50000)]
    base = [rng.choice(vocabulary) for _ in range(100)]
    # Copies are near the original, not near each other.
    texts = [base, *(scattered(base, rng, 0.15, vocabulary) for _ in range(1000))]
    found = N.classes(rows("doc_id long, text string", *enumerate(" ".join(t) for t in texts))).collect()
    assert {(r.class_id, r.class_size) for r in found} == {(0, 1001)}


def test_pairs_at_the_threshold_share_a_bucket():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(50000)]
    for n, trials, least in ((5, 100, 1.0), (8, 100, 1.0), (14, 60, 1.0), (30, 200, 0.97), (100, 200, 0.98), (300, 100, 0.98)):
        met = 0
        for _ in range(trials):
            a = [rng.choice(vocabulary) for _ in range(n)]
            x, y = N.buckets_of([" ".join(a), " ".join(scattered(a, rng, 0.2, vocabulary))])[0]
            met += bool(set(x.tolist()) & set(y.tolist()))
        assert met >= least * trials, n


def test_a_group_of_near_copies_is_not_compared_in_all_pairs(spark, rows, monkeypatch):
    """About half of the pairs of a group are similar: one leader does not reach all, a few do (5,103 comparisons when 64 led at once)."""
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(50000)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    texts = [" ".join(scattered(base, rng, 6 / 60 if i % 2 else 8 / 60, vocabulary)) for i in range(500)]
    compared = []
    verify = N._verify
    monkeypatch.setattr(N, "_verify", lambda pairs, *rest: compared.append(pairs.count()) or verify(pairs, *rest))
    found = N.classes(rows("doc_id long, text string", *enumerate(texts))).collect()
    assert {(r.class_id, r.class_size) for r in found} == {(0, 500)}
    assert sum(compared) < 10 * len(texts), compared


def test_long_texts_with_a_common_passage_are_told_apart_by_their_maps(spark, rows, monkeypatch):
    """Texts of 850 words that share 600 of them in order share buckets; all 780 pairs were aligned when maps had 512 bits."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(50000)]
    passage = [rng.choice(vocabulary) for _ in range(600)]
    texts = [" ".join([rng.choice(vocabulary) for _ in range(250)] + passage) for _ in range(40)]
    compared = []
    verify = N._verify
    monkeypatch.setattr(N, "_verify", lambda pairs, *rest: compared.append(pairs.count()) or verify(pairs, *rest))
    found = N.classes(rows("doc_id long, text string", *enumerate(texts))).collect()
    assert {(r.class_id, r.class_size) for r in found} == {(i, 1) for i in range(40)}
    assert sum(compared) < 40, compared


def test_only_texts_that_share_a_bucket_are_dealt_out(spark, rows):
    texts = rows("key string, id string, nd_text string", *((f"k{i}", f"={i}", f"text {i}") for i in range(2000)))
    wanted = texts.where("pmod(hash(key), 40) = 0").select("key", "id")
    maybe, _ = N._may_hold(texts, wanted)
    there = {r.key for r in maybe.collect()}
    some = {r.key for r in wanted.collect()}
    assert some <= there
    assert len(there) < len(some) + 0.25 * 2000
