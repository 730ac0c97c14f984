import base64
import bz2
import gzip
import hashlib
import random
import re
import zlib
from urllib.parse import quote

import zstandard
from pyspark.sql import types as T

from acctpulse.llm import secret_scan as S

KEY = "AKIA" + "Z9" * 8


def brute(text):
    """Base spans by walking each pattern from the left."""
    kinds = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    }
    out = []
    for i, (kind, (pattern, ok)) in enumerate(kinds.items()):
        at = 0
        while m := pattern.search(text, at):
            at = m.end()
            if ok(m):
                out.append((m.start(), i, (kind, *m.span())))
    return [s for _, _, s in sorted(out)]


def test_base_spans_against_brute_force():
    rng = random.Random(5)
    bits = ["token", "TOKEN", "ſecret", "api_key", "apiKEY", "password", "=", " : ", '"', "'", "a" * 9, "0f" * 16, "0f" * 15, KEY, "AKIA1", " ", "é", "\n", "x.y/z-1"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert S.find(text) == brute(text)


def test_layers_map_back():
    wrap64 = lambda b: base64.b64encode(b).decode()
    secret = f"user password = {KEY.lower()}! and {KEY} too".encode()
    for packed in (gzip.compress(secret), zlib.compress(secret), bz2.compress(secret), zstandard.compress(secret)):
        run = wrap64(packed)
        text = f"see {run} here"
        spans = S.scan(text)[1]
        assert ("access", 4, 4 + len(run)) in spans and ("assign", 4, 4 + len(run)) in spans
    twice = wrap64(wrap64(secret).encode())
    assert any(k == "access" for k, _, _ in S.scan(twice)[1])
    url = quote(quote(f"key={KEY}&", safe=""), safe="").replace("A", "%2541")
    base, spans, _ = S.scan("go " + url)
    assert not base and [k for k, _, _ in spans] == ["access"]
    a, b = spans[0][1:]
    assert ("go " + url)[a:b].startswith("%2541K") and b <= 3 + len(url)
    escaped = "".join(f"\\u{ord(c):04x}" for c in KEY)
    assert S.scan("x" + escaped + "y")[1] == [("access", 1, 1 + len(escaped))]
    across = "password%3D hunter2hunter2"
    assert S.scan(across)[1] == [("assign", 0, len(across))]
    assert S.redact(f"a {KEY} b token: {'q' * 12}.") == "a [SECRET] b [SECRET]"


def found(text):
    return {k for k, _, _ in S.scan(text)[1]}


def test_fixpoint_over_bytes():
    b64 = lambda b: base64.b64encode(b).decode()
    rng = random.Random(3)
    secret = f"the key {KEY} and more".encode()
    noise = rng.randbytes(400)
    packed = gzip.compress(secret)
    for data in (
        gzip.compress(gzip.compress(secret)),
        bz2.compress(zstandard.compress(zlib.compress(secret))),
        gzip.compress(b"nothing here") + packed,
        packed + b"tail" + gzip.compress(noise),
        zstandard.compress(noise) + zstandard.compress(secret),
        gzip.compress(secret[:12]) + gzip.compress(secret[12:]),
        secret.decode().encode("utf-16"),
        secret.decode().encode("utf-16-be"),
        noise + secret + noise,
        noise + packed,
    ):
        run = b64(data)
        assert "access" in found(f"see {run} there"), data[:20]
        for before in ("x", "a/", "abc/", "ab_-"):
            assert "access" in found(f"see {before}{run}"), (before, data[:20])


def test_runs_over_lines():
    secret = f"intro words and then password = {'h' * 20} end, the key {KEY}".encode()
    for width in (64, 76):
        for data in (secret * 3, gzip.compress(random.Random(1).randbytes(300) + secret)):
            run = base64.b64encode(data).decode()
            for glue in ("\n", "\r\n", "\n  "):
                text = "-----\n" + glue.join(run[i : i + width] for i in range(0, len(run), width)) + "\nplain words follow"
                base, spans, refused = S.scan(text)
                assert not base and not refused and {k for k, _, _ in spans} >= {"access", "assign"}
                assert all(6 <= a < b <= len(text) - 19 for _, a, b in spans)


def test_spans_of_a_misaligned_run_cover_its_secret():
    plain = b"some leading text "
    run = base64.b64encode(plain + KEY.encode() + b" trailing").decode()
    (_, a, b), = [s for s in S.scan("zz/" + run)[1] if s[0] == "access"]
    assert a == 3 + len(plain) * 4 // 3 and b == 3 + -(-(len(plain) + len(KEY)) * 4 // 3)


def test_ends_and_bombs(monkeypatch):
    assert S.scan("")[1] == [] and S.scan("%25" * 50)[1] == []
    long = "%" + "25" * 12 + "41"
    assert S.scan(long)[1] == []
    monkeypatch.setattr(S, "MAX_LAYER", 1000)
    bomb = base64.b64encode(zlib.compress(b"0" * 100000)).decode()
    assert S.scan(bomb)[2] == 1


def test_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r for r in S.scan_rows(docs).collect()}
    for r in docs.collect():
        spans = brute(r.text)
        g = got[r.doc_id]
        assert [g.sc_assign, g.sc_access, g.sc_hex] == [sum(k == x for k, _, _ in spans) for x in S.KINDS]
        assert g.sc_base == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("doc_id", T.LongType())])
    rows = spark.createDataFrame([(None, "x", None), ("", None, 1), (KEY, "x", 1), (KEY, "x", 1)], schema)
    assert sorted(r.sc_spans for r in S.scan_rows(rows).collect()) == ["", "", "access:0:20", "access:0:20"]
    assert sorted(str(r.text) for r in S.redact_rows(rows).collect()) == ["", "None", "[SECRET]", "[SECRET]"][:0] + sorted(["", "None", "[SECRET]", "[SECRET]"])
    assert S.scan_rows(rows.limit(0)).count() == 0
