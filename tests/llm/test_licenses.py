from pyspark.sql import types as T

from acctpulse.llm import licenses as L

PLAIN = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}


def names(text):
    return L.Scanner(L.TEMPLATES)([text])[1][0]


def test_notices_are_told_apart():
    for name, line in PLAIN.items():
        assert names(line) == name
        assert names(f"Some words first.\nmore\n{line}\nand after") == name
        assert names("filler words " * 400 + line + " more filler" * 400) == name
    assert names("This work is licensed under the GNU General Public License, version 2.") == "GPL-2.0"
    assert names("This work is licensed under the GNU Lesser General Public License, version 3.") == "LGPL-3.0"
    assert names("Licensed under CC BY-SA 4.0.") == "CC-BY-SA-4.0"
    assert names("Licensed under CC BY 4.0") == "CC-BY-4.0"


def test_wording_may_differ_but_not_what_tells():
    out = L.Scanner(L.TEMPLATES)(["This work is licensed under the terms of the GNU General Public License, version 3."])
    assert out[1] == ["GPL-3.0"] and "terms of" in out[3][0]
    assert names("Licensed under the Apache License, Version 1.1.") == ""
    assert names("My driving license was redistributed.") == ""
    assert names("") == ""


def test_rows_against_exact_lines(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.li_names for r in L.scan_rows(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == ",".join(sorted(n for n, line in PLAIN.items() if line in r.text))


def test_defined_results(spark):
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("licenses", T.IntegerType())])
    rows = spark.createDataFrame([(None, 1), ("", 2), (PLAIN["MIT"], None), (PLAIN["MIT"], None)], schema)
    assert sorted((r.li_names, r.li_blocks) for r in L.scan_rows(rows).collect()) == [("", 0), ("", 0), ("MIT", 1), ("MIT", 1)]
    assert L.scan_rows(rows.limit(0)).count() == 0
