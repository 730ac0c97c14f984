import random
from collections import Counter

from pyspark.sql import functions as F

from acctpulse.llm import decontamination


def test_windows_beyond_the_radius_are_found(rows):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**9)}"
    items = [[word() for _ in range(100)] for _ in range(60)]
    # Cut at the end: 86 of 96 shingles stay, a similarity of 86 / 106.
    docs = [[*item[:90], *(word() for _ in range(10))] for item in items]
    text = lambda many: [(i, " ".join(x)) for i, x in enumerate(many)]
    found = decontamination.leaks(rows("doc_id long, text string", *text(docs)), rows("item_id long, text string", *text(items))).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(60)}
    assert all(abs(r.similarity - 86 / 106) < 1e-12 and r.n_windows == 1 for r in found)


def test_documents_shorter_than_the_item_are_found(rows):
    rng = random.Random(4)
    items = [[f"w{rng.randrange(10**9)}" for _ in range(10)] for _ in range(200)]
    # Nine of ten words: five of six shingles.
    text = lambda many: [(i, " ".join(x)) for i, x in enumerate(many)]
    docs, bench = rows("doc_id long, text string", *text([x[:9] for x in items])), rows("item_id long, text string", *text(items))
    found = decontamination.leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i in range(200)]
    assert all(abs(r.similarity - 5 / 6) < 1e-12 for r in found)


def test_shingles_are_labelled_as_a_multiset(spark):
    rng = random.Random(5)
    texts = [["a"] * 9, ["a", "b"] * 8, ["a"] * 4, [], [rng.choice("ab") for _ in range(60)], ["x"] * 30_000]
    made = spark.createDataFrame([(t,) for t in texts], "w array<string>").select(decontamination.weighted_shingles(F.col("w"))).collect()
    for words, (labelled,) in zip(texts, made):
        seen, expected = Counter(), []
        for i in range(len(words) - 4):
            gram = " ".join(words[i : i + 5])
            expected.append(f"{gram}#{seen[gram]}")
            seen[gram] += 1
        assert sorted(labelled) == sorted(expected)


def test_windows_at_every_start_are_looked_at(rows):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**9)}"
    item = [word() for _ in range(100)]
    # Three words changed at either end and six put in between: the best window starts where no shingle has its place.
    doc = [*(word() for _ in range(10)), *item[3:50], *(word() for _ in range(6)), *item[50:97], *(word() for _ in range(10))]
    grams = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    alike = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    scores = [alike(doc[s : s + 100], item) for s in range(len(doc) - 99)]
    aligned = {10 - 3, 10 - 3 + 6}
    assert max(scores) >= decontamination.SIMILARITY > max(scores[s] for s in aligned)
    (found,) = decontamination.leaks(rows("doc_id long, text string", (1, " ".join(doc))), rows("item_id long, text string", (2, " ".join(item)))).collect()
    good = [s for s, x in enumerate(scores) if x >= decontamination.SIMILARITY]
    assert (found.similarity, found.start, found.n_windows, found.n_similar) == (max(scores), scores.index(max(scores)), 0, len(good))
