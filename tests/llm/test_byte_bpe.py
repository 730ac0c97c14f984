import base64
import random

import public_tokenizers
import pytest
import tiktoken

from acctpulse.llm import byte_bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def merges():
    return byte_bpe.read_ranks(PATH)


def both(merges, library, texts):
    ids, at = byte_bpe.encoder(merges)(texts)
    got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    wrong = [(t, g) for t, g in zip(texts, got) if g != library.encode_ordinary(t)]
    assert not wrong, wrong[:3]
    data, off = byte_bpe.spell(byte_bpe.spelling(merges), ids)
    assert [data[off[a] : off[b]].tobytes().decode() for a, b in zip(at[:-1], at[1:])] == texts


def test_hand_picked_texts(merges, library):
    both(merges, library, [
        "", " ", "a", "", "it's we're I'll 'sabc ''s .'s x 's\t's'd'm", "a  b   c\n\n d \n", "end  ", "tab\t\tword", "12345 a1b2 ½ Ⅷ",
        "naïve Éçole ñ über ß", "日本語 テスト 한국어 🙂🙂🙂", "a" * 31, "!!!!!!!! ---- ====", "<|endoftext|>", "\x00 a\x00", "　x\x85y\x1cz", "can't'VE",
    ])


def test_random_texts(merges, library):
    rng = random.Random(3)
    signs = "abcdest 'lmrv  \n\t.,!1234é漢🙂ſ́​"
    both(merges, library, ["".join(rng.choice(signs) for _ in range(rng.randint(0, 200))) for _ in range(400)])


def test_very_long_pre_tokens(merges, library):
    rng = random.Random(4)
    both(merges, library, ["".join(rng.choice("etaoin") for _ in range(100_000)), "ab" * 50_000, "a" * 99_999, " " * 5000 + "a"])


def naive(m, piece):
    """Leftmost pair of the lowest rank, one merge at a time."""
    ids = [m.first[b] for b in piece]
    while True:
        ranks = [m.ranks.get(a << 32 | b, 1 << 60) for a, b in zip(ids, ids[1:])]
        if not ranks or min(ranks) == 1 << 60:
            return ids
        i = ranks.index(min(ranks))
        ids[i : i + 2] = [m.merged[ranks[i]]]


def test_overlapping_pairs_of_one_rank():
    """Vocabularies in which the same bytes come about in several ways, so that a bucket's pairs overlap."""
    rng = random.Random(5)
    for _ in range(200):
        tokens = [bytes([b]) for b in range(256)]
        for _ in range(12):
            new = b"".join(rng.choices([t for t in tokens if set(t) <= set(b"ab")], k=2))
            if new not in tokens:
                tokens.append(new)
        ids = {t: i for i, t in enumerate(tokens)}
        ranks = {ids[t[:k]] << 32 | ids[t[k:]]: i for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}
        m = byte_bpe.Merges(list(range(256)), ranks, {i: i for i in ids.values()}, {i: t for t, i in ids.items()})
        pieces = [bytes(rng.choices(b"ab", k=rng.randint(1, 40))) for _ in range(10)]
        want = [naive(m, p) for p in pieces]
        assert [byte_bpe.merge_all(m, p) for p in pieces] == want
        # Large buckets are merged by arrays, also where a merge makes a pair of a lower rank.
        assert byte_bpe.merge_many(m, pieces * 5, byte_bpe.sorted_pairs(m)) == want * 5


def test_stale_entries_of_other_ranks(merges):
    rng = random.Random(6)
    table = byte_bpe.of_vocabulary(token_counts.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    for m in (byte_bpe.Merges(merges.first, merges.ranks, merges.merged, merges.spelled), table):
        for _ in range(300):
            piece = "".join(rng.choice("theraino é") for _ in range(rng.randint(1, 30))).encode()
            assert byte_bpe.merge_all(m, piece) == naive(m, piece)


def test_frame(spark, data, merges, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    out = byte_bpe.decode(byte_bpe.encode(docs, merges, ["doc_id"]), merges).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.bb_ids == library.encode_ordinary(rows[r.doc_id]) and bytes(r.bb_bytes).decode() == rows[r.doc_id]


def test_nulls_clashing_columns_and_unknown_ids(spark, merges):
    docs = spark.createDataFrame([(1, None, "x"), (None, "two words", None), (1, "", "y"), (1, None, "x")], "doc_id long, text string, `a.b` string")
    docs = docs.selectExpr("*", "doc_id AS bb_ids", "text AS bb_bytes", "text AS _text_in")
    out = byte_bpe.decode(byte_bpe.encode(docs, merges), merges)
    assert out.columns == ["doc_id", "text", "a.b", "_text_in", "bb_ids", "bb_bytes"]
    got = sorted((len(r.bb_ids), bytes(r.bb_bytes), r["a.b"] or "") for r in out.collect())
    assert got == [(0, b"", "x"), (0, b"", "x"), (0, b"", "y"), (2, b"two words", "")]
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), merges), merges).count() == 0
    with pytest.raises(Exception, match="an id that the vocabulary does not have"):
        byte_bpe.decode(spark.createDataFrame([([10**6],)], "bb_ids array<int>"), merges).collect()
    assert bytes(byte_bpe.decode(spark.createDataFrame([(None,)], "bb_ids array<int>"), merges).first().bb_bytes) == b""
