import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from acctpulse.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(text, doc_id):
    """The transformation by a list of units."""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(1)
    some = ["", " ", "\n\t ", "word", " word", "word ", "a b", "x<P>y z", "<S", "<M > é🙂 \U0001f600", "<P<S<M P> S> M>", "\x0b\x0ca\x1cb\xa0c"]
    some += ["".join(rng.choice("ab é🙂<>PSM \n\t") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    some += [" ".join("w" * rng.randint(1, 9) for _ in range(n)) for n in (700, 1400, 9000, 40_000)]
    return some + ["x" * (3 * fim.BLOCK), " " * (2 * fim.BLOCK + 1) + "x", "x " * fim.BLOCK, "é" * (fim.BLOCK - 1) + " z", "x" * fim.BLOCK + " y"]


def test_ends_of_units():
    for t in texts():
        units = fim.Units(t)
        found = [m.end() for m in UNIT.finditer(t)]
        assert units.count == len(found)
        steps = range(len(found) + 1) if len(found) < 2000 else [0, 1, 2, 999, len(found) // 2, len(found) - 1, len(found)]
        assert [units.end(k) for k in steps] == [([0] + found)[k] for k in steps]


def test_fenwick_against_running_sums():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 7, 8, 9, 100):
        counts = fim.np.array([[rng.choice([0, 0, 1, 5]), rng.randint(1, 9)] for _ in range(n)], int).reshape(-1, 2)
        tree = fim.Fenwick(counts)
        for k in range(1, int(counts[:, 0].sum()) + 1):
            at = next(i for i in range(n) if counts[: i + 1, 0].sum() >= k)
            got, sums = tree.before(k)
            assert got == at and sums.tolist() == counts[:at].sum(0).tolist()


def test_against_a_list_of_units(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id at all"), (5, None), (5, "again a"), (5, "again a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = fim.transform(docs).withColumn("back", fim.restored()).collect()
    assert len(out) == len(rows) and {r.fm_form for r in out} == {"plain", "spm", "psm"}
    for r in out:
        assert (r.fm_units, r.fm_form, r.fm_prefix, r.fm_middle, r.fm_out) == plain(r.text or "", r.doc_id)
        assert r.back == (r.text or "")


def test_rates(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some words to move about").alias("text"))
    forms = lambda **k: {r.fm_form for r in fim.transform(docs, **k).collect()}
    assert forms(rate=0) == {"plain"} and forms(rate=100, spm=100) == {"spm"} and forms(rate=100, spm=0) == {"psm"}


@pytest.mark.parametrize("keep", [None, ["text"]])
def test_clashing_columns_and_empty_tables(spark, keep):
    docs = spark.createDataFrame([(1, "a b c", "x", 2, "y")], "doc_id long, text string, `_in_0` string, fm_out int, `a.b` string")
    out = fim.transform(docs, keep)
    assert out.columns == (["doc_id", "text", "_in_0", "a.b"] if keep is None else keep) + [f.split()[0] for f in fim.FIELDS.split(", ")]
    assert out.first().fm_out == plain("a b c", 1)[4]
    assert fim.transform(docs.limit(0), keep).count() == 0
