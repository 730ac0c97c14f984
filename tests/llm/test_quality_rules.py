"""Fences follow the habits of a source, and a contaminated source is held by its language."""

from acctpulse.llm import quality_rules


def fences(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = quality_rules.measure(docs)
    return {r.qr_source: r.qr_f for r in quality_rules.thresholds(quality_rules.sketch(measured)).collect()}


def prose(k, marks=0, symbols=0, letter="w"):
    words = [f"{letter * (3 + (k * 7 + i) % 5)}{k:04d}x{i:02d}" for i in range(20)]
    return " ".join(words) + "!" * marks + "#" * symbols


def test_sources_with_different_habits_have_different_fences(spark):
    calm = [(k, prose(k), "en", "calm") for k in range(200)]
    loud = [(1000 + k, prose(k, marks=2 + k % 8), "en", "loud") for k in range(200)]
    f = fences(spark, calm + loud)
    assert f["calm"].mark_rate_max == 200 < f["loud"].mark_rate_max
    judged = quality_rules.judge(
        spark.createDataFrame(calm + loud + [(1, prose(1, marks=9), "en", "calm")], "doc_id long, text string, lang string, source string")
    )
    lost = {(r.doc_id, r.source) for r in judged.where("not qr_kept").collect()}
    assert lost == {(1, "calm")}


def test_a_source_of_junk_is_bounded_by_its_language(spark):
    clean = [(k, prose(k), "en", "good") for k in range(400)]
    junk = [(1000 + k, prose(k, symbols=k % 50), "en", "bad") for k in range(60)]
    f = fences(spark, clean + junk)
    assert f["good"].symbol_rate_max == 100 and f["bad"].symbol_rate_max == 200


def test_small_groups_use_their_language_and_small_languages_all(spark):
    rows = [(k, prose(k, letter="l"), "en", "big") for k in range(300)] + [(900, prose(1), "en", "tiny"), (901, prose(2), None, None)]
    f = fences(spark, rows)
    assert f["tiny"] == f[None] or f["tiny"].word_length_max == f["big"].word_length_max
    assert f["tiny"].symbol_rate_max == f["big"].symbol_rate_max == f[None].symbol_rate_max
