"""Cross-tokenizer alignment by pointer jumping, and how steadily tokens of two vocabularies end together.

1. Tokens. Every text, with a space before it, is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B). A token is the range
   of bytes that it stands for. Texts for which the bytes of A or B are not those of the text have no tokens.
2. Groups. Two tokens overlap if they share a byte. Every token points to its farthest-right overlapping token: a token of A to the
   token of B that holds its last byte, a token of B to the token of A that holds its last byte, or, where both end there, to itself. Doubling
   all successors at once (s ← s[s]) until nothing changes leads every token to the terminal token of its component, which is
   the component's label. A slice of many texts is one array; components never cross a text's end. The number of rounds is
   logarithmic in the longest chain.
3. Links. The A and the B token that end a group are linked. A task counts its links by pair of ids for each *chunk*, some
   ``CHUNK_BYTES`` of text; chunk counts are added up to corpus counts, each B id gets its highest count, and both go back to the chunks that hold
   the pair, where a text's links look up their counts.

Texts are encoded in parts, cut before a single space between other characters: A's split pattern begins a piece there, and no piece of
B holds a space after another character (checked when it is loaded; without that, texts stay whole). A worker process remembers parts up to a bound.

Scale: texts are encoded once; the encoded links are a table in the shared folder. What is shuffled is one row for each chunk and
pair, so a pair that holds a large part of all links costs one row a chunk, and the texts' links once, as arrays of ids. Nothing is
broadcast but the two vocabulary files, and nothing goes to the driver. A task holds a slice of texts and a chunk's counts, which are bounded by the
text that is counted together and by the pairs of ids there are.

Defined results: a null or empty text, or one whose bytes A or B does not give back, has no tokens: zeros and an empty ``groups_sha256``;
every row is aligned by its own text, and rows that repeat a doc_id or text count as often as they occur; a null doc_id is
carried along; ties for an id's highest count are all best; an empty table gives no rows. Columns of the input other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, worker_cache, written

ship(__name__)

SLICE_CHARS = 1 << 19  # of text whose tokens are arrays at one time
PART_CHARS = 1 << 16  # of text that the libraries encode at one time
PART_MEMO, MEMO_CHARS = 200_000, 64  # remembered parts per worker process and generation, and their longest
CHUNK_BYTES = 24 << 20  # of text whose pairs are counted together
READ_ROWS = 256  # of a batch that are Python strings at one time, besides those of a slice
LOOKUP_LINKS = 1 << 18  # about so many of a chunk's counted links are looked up at one time
BLOCK_BYTES = 16 << 20  # of the stored links that a writer or reader holds at one time
CUT = re.compile(r"(?<=\S)(?= \S)")
A, B, SPACE = 0, 1, "▁"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable Latin-1, else the next free one from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def joined(table: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """What the ids stand for, one after another, and where each begins and ends."""
    found = table.take(pa.array(ids))
    if not len(found):
        return memoryview(b""), np.zeros(1, np.int64)
    _, ends, data = found.buffers()
    ends = np.frombuffer(ends, np.int64)[found.offset:found.offset + len(found) + 1]
    return memoryview(data or b"").cast("B"), ends


class Vocabularies:
    """Both tokenizers, what their ids stand for, and the decimal ids with each separator."""

    def __init__(self, byte_level: str, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import sentencepiece
        import tokenizers
        self.a = tokenizers.Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.bytes = [pa.array(x, pa.large_binary()) for x in (self._bytes_of_a(), self._bytes_of_b())]
        self.sizes = [np.diff(np.frombuffer(x.buffers()[1], np.int64)[:len(x) + 1]) for x in self.bytes]
        most = max(map(len, self.bytes))
        self.spelled = pa.array([b"%d%c" % (i, s) for i in range(most) for s in b",|;"], pa.large_binary())
        names = (self.b.id_to_piece(i) for i in range(self.b.vocab_size()))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cuttable = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in names)

    def _bytes_of_a(self):
        alphabet, names = byte_alphabet(), {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        for i in range(max(names, default=-1) + 1):
            t = names.get(i, "")
            yield bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()

    def _bytes_of_b(self):
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            yield bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def parts(self, text: str) -> list[str]:
        """The text with a space before it, cut where neither vocabulary's tokens can cross."""
        return CUT.split(" " + text) if self.cuttable else [" " + text]

    def learn(self, parts: list[str]):
        """Encode parts that are not remembered: packed as the number of A's ids, these, and B's ids."""
        begin, chars = 0, 0
        for end, part in enumerate(parts, 1):
            chars += len(part)
            if chars >= PART_CHARS or end == len(parts):
                some = parts[begin:end]
                ids_a = self.a.encode_batch(some, add_special_tokens=False)
                for part, a, b in zip(some, ids_a, self.b.encode([p[1:] for p in some], num_threads=1)):
                    self.known[part] = array("i", [len(a.ids), *a.ids, *b]).tobytes()
                begin, chars = end, 0

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B: all ids, and how many each text has."""
        cut = [self.parts(t) for t in texts]
        flat = [p for c in cut for p in c]
        if len(self.known) >= PART_MEMO:
            self.known, self.older = {}, self.known
        new = set(flat).difference(self.known)
        again = {p: self.older[p] for p in new if p in self.older}
        self.known.update(again)
        self.learn([p for p in new if p not in again])
        packed = [self.known[p] for p in flat]
        for p in new:
            if len(p) > MEMO_CHARS:
                del self.known[p]
        every = np.frombuffer(b"".join(packed), np.int32)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
        head = np.cumsum(size) - size
        whole = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        out, n_a = [], every[head].astype(np.int64)
        for first, n in ((head + 1, n_a), (head + 1 + n_a, size - 1 - n_a)):
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((every[at].astype(np.int64), np.bincount(whole, n, len(texts)).astype(np.int64)))
        return out


def labels(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens of A and B, given by their ends on one line of bytes: the terminal B token of each one's component."""
    to_b = np.searchsorted(end_b, end_a)  # the token of the other side that holds the last byte
    to_a = np.searchsorted(end_a, end_b)
    successor = np.concatenate([len(end_a) + to_b, np.where(end_a[to_a] == end_b, len(end_a) + np.arange(len(end_b)), to_a)])
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            break
        successor = further
    return successor[:len(end_a)] - len(end_a), successor[len(end_a):] - len(end_a)


class Aligned:
    """The alignment of a slice of texts: per text numbers of tokens and groups, the digest of its groups, and its links."""

    def __init__(self, vocabularies: Vocabularies, texts: list[str]):
        (ids_a, n_a), (ids_b, n_b) = vocabularies.encode(texts)
        expected = [b" " + t.encode() for t in texts]
        same = np.ones(len(texts), bool)
        for side, (ids, n) in enumerate(((ids_a, n_a), (ids_b, n_b))):
            data, ends = joined(vocabularies.bytes[side], ids)
            cut = ends[np.concatenate([[0], np.cumsum(n)])]
            same &= [bool(t) and data[x:y] == e for t, x, y, e in zip(texts, cut[:-1], cut[1:], expected)]
        ids_a, ids_b = ids_a[np.repeat(same, n_a)], ids_b[np.repeat(same, n_b)]
        self.n_a, self.n_b = n_a * same, n_b * same
        end_a, end_b = np.cumsum(vocabularies.sizes[A][ids_a]), np.cumsum(vocabularies.sizes[B][ids_b])
        label_a, label_b = labels(end_a, end_b) if len(end_a) else (end_a, end_b)
        last_b = np.flatnonzero(label_b == np.arange(len(label_b)))  # the terminal tokens: one for each group
        last_a = np.searchsorted(end_a, end_b[last_b])
        text_of_b = np.repeat(np.arange(len(texts)), self.n_b)
        self.n_groups = np.bincount(text_of_b[last_b], minlength=len(texts)).astype(np.int64)
        self.link_text, self.link_a, self.link_b = text_of_b[last_b], ids_a[last_a], ids_b[last_b]
        # where each token stands in the written groups: A's tokens of a group, then B's
        group_a, group_b = np.searchsorted(last_b, label_a), np.searchsorted(last_b, label_b)
        before_b = np.concatenate([[0], last_b + 1])
        spelled = np.empty(len(ids_a) + len(ids_b), np.int64)
        mark_a, mark_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 2
        if len(ids_a):
            spelled[np.arange(len(ids_a)) + before_b[group_a]] = ids_a * 3 + mark_a
            spelled[np.arange(len(ids_b)) + last_a[group_b] + 1] = ids_b * 3 + mark_b
        data, ends = joined(vocabularies.spelled, spelled)
        cut = ends[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        self.digests = [hashlib.sha256(data[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(cut[:-1], cut[1:])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Links by text and pair of ids: how many each text has, the ids of A and B, and their number of occurrences."""
        key, times = np.unique(self.link_text.astype(np.int64) << 48 | self.link_a << 24 | self.link_b, return_counts=True)
        per_text = np.bincount(key >> 48, minlength=len(self.n_a))
        return per_text, (key >> 24) & 0xFFFFFF, key & 0xFFFFFF, times


ROW = ("id long, chunk long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
       "a array<int>, b array<int>, times array<int>, whole boolean")
NAMES = [x.split()[0] for x in ROW.split(", ")]


def lists(per_row: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32()), pa.array(values, pa.int32()))


def slices(batch: pa.RecordBatch):
    """Rows of a batch of about SLICE_CHARS characters: ids and texts."""
    ids, texts, chars = [], [], 0
    for at in range(0, batch.num_rows, READ_ROWS):
        some = batch.slice(at, READ_ROWS)
        for i, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
            ids.append(i)
            texts.append(t or "")
            chars += len(texts[-1])
            if chars >= SLICE_CHARS or len(ids) >= 1 << 14:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


class Chunk:
    """Counts of pairs over the slices of one chunk."""

    def __init__(self, number: int):
        self.number, self.bytes, self.key, self.times = number, 0, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray, times: np.ndarray, size: int):
        self.key, at = np.unique(np.concatenate([self.key, a << 24 | b]), return_inverse=True)
        self.times = np.bincount(at, np.concatenate([self.times, times]), len(self.key)).astype(np.int64)
        self.bytes += size

    def row(self) -> pa.RecordBatch:
        n = np.array([len(self.key)])
        none, zero = pa.nulls(1, pa.int64()), pa.array([0], pa.int64())
        return pa.RecordBatch.from_arrays(
            [none, pa.array([self.number], pa.int64()), zero, zero, zero, zero, pa.array([""]), lists(n, self.key >> 24),
             lists(n, self.key & 0xFFFFFF), lists(n, self.times), pa.array([True])], NAMES)


def aligned(docs: DataFrame, byte_level: str, pieces: bytes, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each text, and one (``whole``) for each chunk with its counts: see ROW.

    ``byte_level``: a JSON vocabulary; ``pieces``: a piece model; both go to every task, so they are the bound of what is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((byte_level, pieces))
    mark = hashlib.sha256(byte_level.encode() + pieces).hexdigest()

    def run(batches):
        kept = worker_cache()
        if kept.get("alignment", (None,))[0] != mark:
            kept["alignment"] = mark, Vocabularies(*shared.value)
        vocabularies = kept["alignment"][1]
        first = TaskContext.get().partitionId() << 32
        chunk = Chunk(first)
        for batch in batches:
            for ids, texts in slices(batch):
                got = Aligned(vocabularies, texts)
                per_text, a, b, times = got.pairs()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(np.full(len(ids), chunk.number)), *map(pa.array, (got.n_a, got.n_b, got.n_groups, got.n_groups)),
                     pa.array(got.digests, pa.string()), lists(per_text, a), lists(per_text, b), lists(per_text, times),
                     pa.array(np.zeros(len(ids), bool))], NAMES)
                chunk.add(a, b, times, sum(map(len, texts)))
                if chunk.bytes >= CHUNK_BYTES:
                    yield chunk.row()
                    chunk = Chunk(chunk.number + 1)
        yield chunk.row()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ROW)


def looked_up(texts: pa.Table, counts: pa.Table) -> pa.Table:
    """A chunk's texts with n_best and count_sum, from the corpus counts of the chunk's pairs."""
    counts = counts.sort_by([("a", "ascending"), ("b", "ascending")])
    key, count, best = (counts.column(n).to_numpy() for n in ("a", "count", "best"))
    key = key.astype(np.int64) << 24 | counts.column("b").to_numpy()
    n_best, count_sum = np.zeros(texts.num_rows, np.int64), np.zeros(texts.num_rows, np.int64)
    sizes = pc.list_value_length(texts.column("a")).to_numpy()
    part = np.cumsum(sizes) // LOOKUP_LINKS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), texts.num_rows]
    for begin, end in zip(cuts[:-1], cuts[1:]):
        a, b, times = (texts.column(n).slice(begin, end - begin).combine_chunks().flatten().to_numpy().astype(np.int64) for n in ("a", "b", "times"))
        text = np.repeat(np.arange(begin, end), sizes[begin:end])
        at = np.searchsorted(key, a << 24 | b)
        if len(at):
            np.add.at(n_best, text, times * (count[at] == best[at]))
            np.add.at(count_sum, text, times * count[at])
    out = texts.select(["id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))
    return out.append_column("groups_sha256", texts.column("groups_sha256"))


def align(docs: DataFrame, byte_level: str, pieces: bytes, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = written(aligned(docs, byte_level, pieces, text_col, id_col), "align-rows", BLOCK_BYTES)
    counted = rows.where("whole").select(F.col("chunk").alias("held"), F.inline(F.arrays_zip("a", "b", "times")))
    corpus = written(counted.groupBy("a", "b").agg(F.sum(F.col("times").cast("long")).alias("count")), "align-counts")
    highest = corpus.groupBy("b").agg(F.max("count").alias("best"))
    known = counted.select("held", "a", "b").join(corpus.join(highest, "b"), ["a", "b"])
    texts = rows.where(~F.col("whole")).drop("whole")
    return (texts.groupBy("chunk").cogroup(known.groupBy("held"))
            .applyInArrow(looked_up, "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
            .withColumnRenamed("id", id_col))


def default_vocabularies() -> tuple[str, bytes]:
    """The installed public vocabularies ``byte_bpe_50k`` and ``piece_bpe_32k``."""
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        byte_level = json.dumps(json.load(f), ensure_ascii=False)
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return byte_level, f.read()


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return align(docs, *default_vocabularies())
