import hashlib
import random

import pytest
import tiktoken
from helpers import AWKWARD, docs, read
from signals.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    ranks, pattern = bpe.default_vocabulary()
    return ranks, pattern, tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def check(df, ranks, pattern, lib):
    out = bpe.decode(bpe.encode(df, ranks, pattern), ranks).collect()
    for r in out:
        text = r["text"] or ""
        assert r["token_ids"] == lib.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
    return out


def test_equals_the_library_and_decodes(spark, vocabulary):
    rnd = random.Random(3)
    parts = ["th", "é", "\n", " ", "漢", "0", "12", "'s", "🙂", "\t", "\x00", "zz", "ing", "\x85", "'", "  "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    check(docs(spark, AWKWARD + texts).repartition(3), *vocabulary)
    check(read(spark, "documents"), *vocabulary)


def test_query_digests(spark, vocabulary):
    lib = vocabulary[2]
    got = {r["doc_id"]: r for r in bpe.query(spark, docs(spark, AWKWARD)).collect()}
    for i, t in enumerate(AWKWARD):
        ids = lib.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_walk_equals_merging_by_rank(vocabulary):
    ranks, pattern, _ = vocabulary
    enc = bpe.Encoder(ranks, bpe.last_merges(ranks), pattern)
    rnd = random.Random(5)
    for _ in range(3000):
        data = bytes(rnd.choice(b"abeinorst th") if rnd.random() < 0.9 else rnd.randrange(256) for _ in range(rnd.randint(1, 24)))
        if data not in ranks:
            assert enc.piece(data.decode("latin-1")) == [ranks[p] for p in bpe.merge_by_rank(data, ranks)]


def test_memos_are_bounded(vocabulary, monkeypatch):
    ranks, pattern, lib = vocabulary
    monkeypatch.setattr(bpe, "PIECE_MEMO", 5)
    monkeypatch.setattr(bpe, "PAIR_MEMO", 5)
    enc = bpe.Encoder(ranks, bpe.last_merges(ranks), pattern)
    text = " ".join(f"wrdx{i}qz" for i in range(200))
    import array
    assert list(array.array("i", enc.text(text))) == lib.encode_ordinary(text)
    assert len(enc) <= 5 and len(enc.older) <= 5 and len(enc.pairs) <= 5 and len(enc.choice) <= 5


def test_clashing_columns_empty_table_and_bad_ids(spark, vocabulary):
    ranks, pattern, lib = vocabulary
    df = spark.createDataFrame([(1, "ab cd", "old", "older")], "doc_id long, text string, TOKEN_IDS string, decoded string")
    r = bpe.decode(bpe.encode(df, ranks, pattern), ranks).first()
    assert r["token_ids"] == lib.encode_ordinary("ab cd") and bytes(r["decoded"]) == b"ab cd"
    assert bpe.query(spark, docs(spark, [])).count() == 0
    bad = spark.createDataFrame([([99999999],)], "token_ids array<int>")
    with pytest.raises(Exception):
        bpe.decode(bad, ranks).collect()
    assert bytes(bpe.decode(spark.createDataFrame([(None,)], "token_ids array<int>"), ranks).first()["decoded"]) == b""


def test_tokens_of_any_length_and_dead_ends():
    long, rnd = b"a" * 300, random.Random(8)
    ranks = {bytes([b]): b for b in range(256)}
    for size in (2, 4, 8, 16, 32, 64, 128, 256, 12, 44, 300):
        ranks[b"a" * size] = len(ranks)
    while len(ranks) < 400:  # a vocabulary made by merges: neighbours in a random text become a token
        parts = bpe.merge_by_rank(bytes(rnd.choice(b"abcd") for _ in range(12)), ranks)
        i = rnd.randrange(max(1, len(parts) - 1))
        token = b"".join(parts[i:i + 2])
        if token not in ranks and len(bpe.merge_by_rank(token, ranks)) == 2:
            ranks[token] = len(ranks)
    enc = bpe.Encoder(ranks, bpe.last_merges(ranks), r"(?s).+")
    for data in [long, long + b"b", long * 3, *(bytes(rnd.choice(b"abcde") for _ in range(rnd.randint(1, 30))) for _ in range(2000))]:
        assert enc.piece(data.decode("latin-1")) == [ranks[p] for p in bpe.merge_by_rank(data, ranks)]


def test_one_pass_digests_equal_encode_and_decode(spark, vocabulary):
    ranks, pattern, _ = vocabulary
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(AWKWARD)], "doc_id long, text string, __text long").repartition(2)
    two = bpe.digests(bpe.decode(bpe.encode(df, ranks, pattern), ranks))
    one = bpe.digested(df, ranks, pattern).select(two.columns)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    trips = bpe.round_trips(df, ranks, pattern)
    assert trips.columns == ["doc_id", "text", "__text", "token_ids", "round_trip"] and all(r["round_trip"] for r in trips.collect())
