import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from acctpulse.llm import alignment
from acctpulse.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return alignment.read_pair(A, B)


@pytest.fixture(scope="module")
def brute():
    """Everything by dictionaries, one text after another, with the libraries' own tokens."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    spell_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def ends(ids, spell):
        out, at = [], 0
        for i in ids:
            at += len(spell(i))
            out.append(at)
        return out

    def run(texts):
        rows, held = [], Counter()
        for t in texts:
            groups = []
            if t:
                x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
                want = (" " + t).encode()
                if b"".join(map(spell_a, x)) == want == b"".join(map(spell_b, y)):
                    ends_a, ends_b = ends(x, spell_a), ends(y, spell_b)
                    last = 0
                    for cut in sorted(set(ends_a) & set(ends_b)):
                        groups.append(([i for i, e in zip(x, ends_a) if last < e <= cut], [i for i, e in zip(y, ends_b) if last < e <= cut]))
                        last = cut
            links = Counter((i, j) for g, h in groups for i in g for j in h)
            held.update(links.keys())
            rows.append((groups, links))
        best = Counter()
        for (i, _), n in held.items():
            best[i] = max(best[i], n)
        out = []
        for groups, links in rows:
            text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
            out.append((
                sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(links.values()),
                sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            ))
        return out

    return run


FIELDS = "ca_a ca_b ca_groups ca_links ca_best ca_sum ca_written".split()


def odd_texts():
    rng = random.Random(1)
    some = [None, "", " ", "a", "it's we're\n\n", "tab\tword  two", "日本語 テスト 🙂🙂", "a▁b", "<s> </s> <|endoftext|> <0x41>", "\x00 a", "ééé ñ", "aaaaaaaaaaaaaaaaaaaaaaa", "12345678"]
    return some + ["".join(rng.choice("abcdest 'lmrv  \n\t.,!1234é漢🙂▁") for _ in range(rng.randint(0, 80))) for _ in range(120)]


@pytest.mark.parametrize("partitions", [1, 5])
def test_link_counts_against_brute_force(spark, pair, brute, partitions):
    texts = odd_texts() + ["the same words", "the same words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in alignment.link_counts(docs, pair, ["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_results_do_not_depend_on_batches(spark, pair, monkeypatch):
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, alignment.link_counts(docs, pair, ["doc_id"]).collect()))
    monkeypatch.setattr(alignment, "BATCH", 50)
    assert sorted(map(tuple, alignment.link_counts(docs, pair, ["doc_id"]).collect())) == want


def test_query_against_brute_force(spark, data, brute):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op12_alignment"](spark, data).collect()}
    names = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert [tuple(rows[d][n] for n in names) for d in texts] == brute(list(texts.values()))


def test_alignment_itself(spark, pair):
    docs = spark.createDataFrame([(1, "hello wonderful"), (2, None), (3, "a▁b")], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.align(docs, pair).collect()}
    assert rows[2].ca_a == rows[3].ca_a == rows[3].ca_group_b == []
    r = rows[1]
    assert len(r.ca_a) == len(r.ca_group_a) and max(r.ca_group_a) == max(r.ca_group_b) and r.ca_group_a == sorted(r.ca_group_a)


def test_identity_map(pair):
    for i in (0, 100, 262, 1000, 50000):
        if pair.same[i] >= 0:
            assert pair.merges.spelled[i] == alignment.spell(pair.b, pair.same[i : i + 1])[0].tobytes()


def test_clashing_columns_and_empty_tables(spark, pair):
    docs = spark.createDataFrame([(1, "a b", "x", 2, "y")], "doc_id long, text string, ca_batch string, ca_best int, `a.b` string")
    out = alignment.link_counts(docs, pair)
    assert out.columns == ["doc_id", "text", "ca_batch", "a.b", *FIELDS] and out.first().ca_a == 2
    assert alignment.link_counts(docs.limit(0), pair).count() == alignment.align(docs.limit(0), pair).count() == 0
    assert alignment.link_counts(docs.selectExpr("doc_id", "CAST(NULL AS STRING) AS text"), pair).first().ca_links == 0
