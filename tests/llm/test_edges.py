"""Every operator and stage on nulls, empty and long texts, repeated rows, other columns of any name, and empty tables."""

import random

import public_tokenizers
import pytest

import corpus_pipeline
from acctpulse.llm import alignment, byte_bpe, decontamination, fill_in_middle, licenses, mixing, near_duplicates, quality_model, quality_rules, repeats, secret_scan, token_counts, toxicity

CLASHING = "key id words bucket lead label size start n item_id similarity w score quality toxic lb_y epoch key_1 batch value text_key".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioubcdfgln") for _ in range(rng.randint(2, 9))) for _ in range(n))


ITEM = prose(1, 20)


@pytest.fixture(scope="module")
def docs(spark):
    long = prose(2, 30_000)
    texts = [
        (1, prose(3, 60), "en", "web"),
        (1, prose(3, 60), "en", "web"),
        (2, None, "en", "web"),
        (3, "", None, None),
        (4, " \n\t ", "en", None),
        (None, prose(4, 40), None, "web"),
        (None, None, None, None),
        (5, long, "en", "web"),
        (6, long + " x", "en", "books"),
        (7, "word", "en", "books"),
        (8, prose(5, 30) + " " + ITEM + " " + prose(6, 30), "en", "web"),
        (8, prose(7, 30), "en", "web"),
        (9, "same " * 400, "en", "web"),
        (10, "token=abcd1234efgh " + prose(8, 40) + " \U0001f600 éè", "fr", "web"),
        (11, "a\x00b � " + prose(9, 20), "fr", "web"),
    ]
    return spark.createDataFrame([(*t, None if t[1] is None else len(t[1]), *CLASHING) for t in texts], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, None), (5, 1, 1), (6, 0, 1), (6, 1, 0), (7, None, 0), (None, 1, 1), (8, 1, 0), (9, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "two words"), (None, prose(10, 9)), (1, ITEM)], "item_id long, text string")


OPERATORS = {
    "repeats": lambda d, labels, items: repeats.remove(d),
    "licenses": lambda d, labels, items: licenses.scan_rows(d),
    "secrets": lambda d, labels, items: secret_scan.scan_rows(d),
    "redact": lambda d, labels, items: secret_scan.redact_rows(d),
    "near": lambda d, labels, items: near_duplicates.classes(d),
    "quality model": lambda d, labels, items: quality_model.score(
        quality_model.measure(d, d.columns), quality_model.train(quality_model.measure(d, ["doc_id"]), labels)
    ),
    "mixing": lambda d, labels, items: mixing.mix(d.withColumn("mx_size", mixing.size_of()), "mx_size"),
    "toxicity": lambda d, labels, items: toxicity.score(d, toxicity.train(d, labels)),
    "rules": lambda d, labels, items: quality_rules.judge(d),
    "encode": lambda d, labels, items: byte_bpe.encode(d, byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))),
    "align": lambda d, labels, items: alignment.link_counts(
        d, alignment.read_pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    ),
    "middle": lambda d, labels, items: fill_in_middle.transform(d),
    "tokens": lambda d, labels, items: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_result_per_row(docs, labels, items, name):
    out = OPERATORS[name](docs, labels, items)
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    if name != "near":
        assert set(docs.columns) <= set(out.columns)
    empty = OPERATORS[name](docs.limit(0), labels.limit(0), items.limit(0))
    assert empty.collect() == [] and empty.columns == out.columns


@pytest.mark.parametrize(("name", "column", "label"), [("quality model", "qm_score", "quality"), ("toxicity", "tx_score", "toxic")])
def test_scores_without_two_classes(docs, labels, items, name, column, label):
    scores = lambda known: {round(r[0], 6) for r in OPERATORS[name](docs, known, items).select(column).collect()}
    assert scores(labels.limit(0)) == {0.5}
    assert all(x > 0.9 for x in scores(labels.where(f"{label} = 1")))
    assert all(x < 0.1 for x in scores(labels.where(f"{label} = 0")))


def test_leaks(docs, items):
    found = decontamination.leaks(docs, items)
    assert [(r.doc_id, r.item_id, r.similarity) for r in found.collect()] == [(8, 1, 1.0)]
    assert decontamination.clean(docs, items).count() == docs.count() - 1
    assert decontamination.leaks(docs.limit(0), items).count() == decontamination.leaks(docs, items.limit(0)).count() == 0
    assert decontamination.clean(docs, items.limit(0)).count() == docs.count()


def test_one_of_each_class_stays(docs):
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:8]) for r in kept.collect())
    # The repeated row and one of the long texts go; null and empty texts are one class; white space has its own text.
    assert len(got) == docs.count() - 1 - 1 - 2


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0].replace(" ", "-"))
def test_stages(spark, data, docs, stage):
    name, run = stage
    out = run(spark, docs, data)
    assert out.columns[: len(docs.columns)] == docs.columns
    if name != "mixing":
        assert out.columns == docs.columns
    assert out.count() > 0
    assert run(spark, docs.limit(0), data).collect() == []
