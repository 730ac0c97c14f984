import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from acctpulse.llm import repeats

L = repeats.LENGTH


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + L] for d in data for i in range(len(d) - L + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - L + 1):
            if seen[d[i : i + L]] > 1:
                gone[i : i + L] = b"\x01" * L
        left = bytes(x for x, g in zip(d, gone) if not g)
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def ours(frame):
    return sorted((r.rp_bytes, r.rp_removed, r.rp_spans, hashlib.sha256(bytes(r.rp_kept)).hexdigest()) for r in repeats.remove(frame, ["doc_id"]).collect())


def planted():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    long = lambda n: " ".join(word() for _ in range(n))
    passage = long(90)
    texts = [long(rng.randint(1, 200)) for _ in range(12)]
    texts += [long(30) + passage[rng.randint(0, 60) : rng.randint(200, 420)] + long(20) for _ in range(25)]
    texts += [texts[0], texts[0], None, "", "x" * 199, "y" * 200, "z" * 205, "ab" * 300, passage, passage[:230], passage[5:204], "q" + passage[10:210] + "q"]
    own = long(60)
    return texts + [own + "--" + own]


def test_against_brute_force(spark, monkeypatch):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType())])
    texts = planted()
    frame = spark.createDataFrame([(i % 30 if i % 7 else None, t, "k") for i, t in enumerate(texts)], schema)
    expected = brute(texts)
    assert ours(frame) == expected
    monkeypatch.setattr(repeats, "HOT", 2)
    monkeypatch.setattr(repeats, "MOST_SENT", 0)
    assert ours(frame) == expected
    assert repeats.remove(frame.limit(0)).count() == 0


def test_ranks_are_the_order_of_strings():
    rng = random.Random(3)
    unit = bytes(rng.choice(b"ab\xff\x00") for _ in range(300))
    data = unit + bytes(rng.choice(b"ab") for _ in range(40)) + unit + b"a" * 500
    strings = [data[i : i + L] for i in range(len(data) - L + 1)]
    place = {s: k for k, s in enumerate(sorted(set(strings)))}
    assert repeats.string_ranks(np.frombuffer(data, np.uint8)).tolist() == [place[s] for s in strings]
