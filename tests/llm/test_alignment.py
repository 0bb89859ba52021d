import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
import tokenizers
from helpers import AWKWARD, docs, read
from pyspark.sql import functions as F
from signals.llm import alignment

MORE = ["a▁b", "<|endoftext|> and </s>", "  two  spaces ", "\x00� é ﬁ", "'s don't I'll", "x" * 999 + " " + "y" * 999, "\U0001f642" * 50]


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(texts, libraries):
    """Token by token: groups between common ends, links, and corpus counts."""
    a, b = libraries
    chars = alignment.byte_alphabet()
    rows, count = [], Counter()
    for t in texts:
        groups, links = [], []
        if t:
            ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                i = j = x = y = 0
                ga, gb = [], []
                while i < len(ids_a) or j < len(ids_b):
                    if x <= y and i < len(ids_a):
                        x += len(bytes_a[i])
                        ga.append(ids_a[i])
                        i += 1
                    else:
                        y += len(bytes_b[j])
                        gb.append(ids_b[j])
                        j += 1
                    if x == y:
                        groups.append((ga, gb))
                        links.append((ga[-1], gb[-1]))
                        ga, gb = [], []
        rows.append((groups, links))
        count.update(links)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for groups, links in rows:
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                    sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    return out


def same(spark, df, texts, libraries):
    got = sorted(tuple(r) for r in alignment.query(spark, df).collect())
    assert got == sorted((i, *r) for i, r in enumerate(brute(texts, libraries)))


def test_awkward_texts_in_many_chunks(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(alignment, "SLICE_CHARS", 300)
    monkeypatch.setattr(alignment, "PART_CHARS", 40)
    monkeypatch.setattr(alignment, "PART_MEMO", 30)
    rnd = random.Random(12)
    parts = ["th", "é", "\n", " ", "漢", "0", "12", "'s", "\U0001f642", "\t", "zz", "ing ", "\x85", "'", "  ", "the "]
    texts = AWKWARD + MORE + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 80))) for _ in range(150)]
    same(spark, docs(spark, texts).repartition(3), texts, libraries)


def test_whole_table(spark, libraries):
    df = read(spark, "documents")
    rows = sorted(df.select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in alignment.query(spark, df).collect())
    assert got == [(r["doc_id"], *x) for r, x in zip(rows, brute([r["text"] for r in rows], libraries))]


def test_repeats_nulls_clashes_and_empty_table(spark, libraries):
    assert alignment.query(spark, docs(spark, [])).count() == 0
    assert alignment.query(spark, docs(spark, [None, ""])).select("n_a", "groups_sha256").distinct().collect() == [(0, "")]
    df = docs(spark, ["one two", "one two", "one"], ids=[5, 5, None]).withColumns({c: F.lit("x") for c in ("id", "chunk", "a", "b", "times", "whole", "n_a")})
    got = sorted(((r["doc_id"] or 0, r["n_groups"], r["n_best"], r["count_sum"]) for r in alignment.query(spark, df).collect()))
    assert got == [(0, 1, 1, 3), (5, 2, 2, 5), (5, 2, 2, 5)]


def test_pointers_reach_the_terminal_token():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        ends = [np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n)), n)) for _ in range(2)]
        label_a, label_b = alignment.labels(*ends)
        common = np.intersect1d(*ends)
        for end, label in zip(ends, (label_a, label_b)):  # a token's group ends at the next common end
            assert (ends[1][label] == common[np.searchsorted(common, end)]).all()
    chain = np.arange(3, 60_000, 4), np.append(np.arange(5, 59_990, 4), 59_999)
    assert len(np.unique(alignment.labels(*chain)[0])) == 1


def test_parts_are_encoded_like_whole_texts(libraries):
    both = alignment.Vocabularies(*alignment.default_vocabularies())
    assert both.cuttable
    texts = [f"a{c}b a{c} b a {c}b {c} a{c}{c} {c}{c}b" for c in map(chr, [*range(0x3100), *range(0xFE00, 0x10000), *range(0x1F600, 0x1F650)])
             if not 0xD800 <= ord(c) < 0xE000 and c != alignment.SPACE]  # B reads that one as a space: such texts have no tokens
    (ids_a, n_a), (ids_b, n_b) = both.encode(texts)
    for ids, n, want in ((ids_a, n_a, [e.ids for e in libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]),
                         (ids_b, n_b, libraries[1].encode(texts))):
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def peak_mb(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_large_batch_is_text_by_slices(monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_CHARS", 1 << 16)
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000)), pa.array([f"{i:04d}" * 1000 for i in range(8000)])], ["id", "text"])
    n, mb = peak_mb(lambda: sum(len(ids) for ids, texts in alignment.slices(batch)))
    assert n == 8000 and mb < 8  # 32 MB of text
    got = [x for ids, texts in alignment.slices(batch) for x in zip(ids, texts)]
    assert got == [(i, f"{i:04d}" * 1000) for i in range(8000)]


def test_links_of_a_chunk_are_looked_up_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(alignment, "LOOKUP_LINKS", 1 << 14)
    rng, texts, each = np.random.default_rng(5), 1000, 1000
    per_text = np.full(texts, each)
    per_text[[0, 500]] = 0, 3 * each
    a, b, times = (rng.integers(0, most, per_text.sum()) for most in (40, 30, 5))
    none = np.zeros(texts, np.int64)
    left = pa.table([pa.array(range(texts)), none, none, none, none, pa.array([""] * texts), *(alignment.lists(per_text, x) for x in (a, b, times))],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"])
    pairs = [(x, y) for x in range(40) for y in range(30)]
    count = rng.integers(1, 9, len(pairs))
    best = {y: max(c for (_, z), c in zip(pairs, count) if z == y) for y in range(30)}
    right = pa.table({"a": pa.array([x for x, _ in pairs], pa.int32()), "b": pa.array([y for _, y in pairs], pa.int32()), "count": count,
                      "best": [int(best[y]) for _, y in pairs]})
    out, mb = peak_mb(lambda: alignment.looked_up(left, right))
    assert mb < 8  # a million links
    c, at = count[a * 30 + b], np.repeat(np.arange(texts), per_text)
    assert out["count_sum"].to_pylist() == np.bincount(at, times * c, texts).astype(int).tolist()
    assert out["n_best"].to_pylist() == np.bincount(at, times * (c == np.array([best[y] for y in range(30)])[b]), texts).astype(int).tolist()
