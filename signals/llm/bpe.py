"""Byte-level BPE encoding and decoding without replaying merges over a text.

Encoding. A text is cut by the vocabulary's split pattern. A piece that is a token is that token. Any other piece is
mapped byte by byte to Latin-1, so that an Aho-Corasick automaton over the tokens finds the longest match at a byte. A
walk takes the longest token at its position that is compatible with the token before it, going from the longest match to its shorter
prefixes and asking each only when it is reached; where none is, it marks the position as dead, steps back over the last token and tries that token's next
shorter match. Two tokens are compatible if merging their joined bytes by rank gives back exactly these two; a sequence whose
neighbours are all compatible is the one that the merges produce, so the result equals merging by rank. Every position
is declared dead at most once and the compatibility of a pair is remembered, so the walk is linear in the piece.
Compatibility is decided by undoing the two tokens' merges, latest first, along their border (the splits are worked out
once, on the driver, from the ranks).

This holds for a vocabulary made by merges, in which a token's last merge joins two tokens of lower rank; tokens may have any length.

Decoding joins the tokens' bytes; it is one vectorised gather for a whole batch.

Memory of a worker process, which keeps it for later tasks: the vocabulary, a bounded memo of pairs, a bounded memo of pieces; of a task, one slice of rows.

Defined results: a null or empty text encodes to no ids; null ids decode to empty bytes; an id outside of the vocabulary
is an error. Repeated rows are encoded each on its own. A column with the output's name is replaced, all other columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import math
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, worker_cache

ship(__name__)

PAIR_MEMO = 1 << 16  # remembered token pairs per worker process
PIECE_MEMO = 100_000  # remembered pieces per worker process and generation
MEMO_CHARS = 64  # longer pieces are not remembered
SLICE_ROWS = 256  # rows encoded before their ids are handed on


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes → rank from a rank file (base64 token, space, rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in f if line.strip())}


def merge_by_rank(data: bytes, ranks: dict[bytes, int], below: float = math.inf) -> list[bytes]:
    """The plain definition of BPE: merge the adjacent pair of lowest rank, leftmost first, until none of a rank
    under ``below`` is left."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and r < below and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def last_merges(ranks: dict[bytes, int]) -> dict[bytes, tuple[bytes, bytes]]:
    """For every token of two bytes or more, the two parts that its last merge joins.

    A token that the merges never reach is left out.
    """
    out = {}
    for tok, rank in ranks.items():
        if len(tok) > 1:
            parts = merge_by_rank(tok, ranks, below=rank)
            if len(parts) == 2:
                out[tok] = (parts[0], parts[1])
    return out


class Encoder(dict):
    """Encodes the pieces of texts; a mapping piece → packed ids that fills itself.

    A worker process keeps it from task to task. When ``PIECE_MEMO`` pieces are known they become the older generation,
    which is asked once more before it goes. Tokens are Latin-1 text here, one character for each byte; inside a walk
    a token is its id.
    """

    def __init__(self, ranks: dict[bytes, int], merges: dict[bytes, tuple[bytes, bytes]], pattern: str):
        import ahocorasick
        import regex
        super().__init__()
        self.ranks = ids = {t.decode("latin-1"): r for t, r in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.parts = {ranks[t]: (ranks[x], ranks[y]) for t, (x, y) in merges.items()}
        self.automaton = ahocorasick.Automaton()
        reached = sorted((t for t in ids if len(t) == 1 or ids[t] in self.parts), key=len)
        self.longest = len(reached[-1]) if reached else 0
        self.size = {ids[t]: len(t) for t in reached}
        known = set(reached)
        self.match: dict[str, int] = {}  # every beginning of a token → the longest token that it begins with, or -1
        self.shorter: dict[int, int] = {}  # a token's longest proper prefix among the tokens, or -1
        for tok in reached:
            self.automaton.add_word(tok, ids[tok])
            best = -1
            for i in range(1, len(tok)):
                if tok[:i] in known:
                    best = ids[tok[:i]]
                self.match[tok[:i]] = best
            self.shorter[ids[tok]] = best
            self.match[tok] = ids[tok]
        self.joined = {}  # two adjacent tokens whose bytes together are a token → its rank
        for tok, rank in ids.items():
            for i in range(1, len(tok)):
                left, right = ids.get(tok[:i]), ids.get(tok[i:])
                if left is not None and right is not None:
                    self.joined[left << 32 | right] = rank
        self.pairs: dict[int, bool] = {}
        self.choice: dict[int, int] = {}  # (last token, longest match) → its longest compatible prefix, or -1
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = array("i", self.piece(piece.encode("utf-8").decode("latin-1"))).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= PIECE_MEMO:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes ends in exactly these two tokens.

        Undo the merges of both, latest first, and look at the two parts that meet at the border: if they would
        have merged before the merge that was just undone, the border would not have stayed.
        """
        memo, key = self.pairs, left << 32 | right
        if key in memo:
            return memo[key]
        joined, parts = self.joined, self.parts
        bound = math.inf  # merges of a lower rank come before
        while True:
            across = joined.get(left << 32 | right)
            ok = across is None or across >= bound
            can_l, can_r = left in parts, right in parts
            if not ok or not (can_l or can_r):
                break
            if can_l and (not can_r or left > right):
                bound, left = left, parts[left][1]
            else:  # of two equal merges the left one goes first, so the border's would precede this one
                bound, right = right + 1, parts[right][0]
        if len(memo) >= PAIR_MEMO:
            memo.clear()
        memo[key] = ok
        return ok

    def first(self, last: int, deepest: int) -> int:
        """The longest prefix of ``deepest`` that is a token compatible with ``last`` (-1: the start), or -1."""
        tok = deepest
        while last >= 0 and tok >= 0 and not self.compatible(last, tok):
            tok = self.shorter[tok]
        if len(self.choice) >= PAIR_MEMO:
            self.choice.clear()
        self.choice[last << 32 | deepest] = tok
        return tok

    def piece(self, data: str) -> list[int]:
        if data in self.ranks:
            return [self.ranks[data]]
        choice, size, match, longest, depth = self.choice, self.size, self.match, self.longest, self.automaton.longest_prefix
        n, pos, last = len(data), 0, -1
        dead: set[int] = set()
        way: list[int] = []
        while pos < n:
            rest = data[pos:pos + longest]
            deepest = match.get(rest[:depth(rest)], -1)
            key = last << 32 | deepest
            tok = choice[key] if key in choice else self.first(last, deepest)
            while tok < 0 or dead and pos + size[tok] in dead:
                if tok >= 0:
                    tok = self.shorter[tok]
                else:  # step back over the last token and go on with its next shorter match
                    if not way:
                        raise ValueError("the vocabulary lacks a byte of the text")
                    dead.add(pos)
                    tok = way.pop()
                    pos -= size[tok]
                    last = way[-1] if way else -1
                    tok = self.shorter[tok]
                while tok >= 0 and last >= 0 and not self.compatible(last, tok):
                    tok = self.shorter[tok]
            way.append(tok)
            last = tok
            pos += size[tok]
        return way

    def text(self, text: str | None) -> bytes:
        """The ids of a text, packed as 32-bit integers."""
        return b"".join(map(self.__getitem__, self.split(text))) if text else b""

    def lists(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text."""
        packed = [self.text(t) for t in texts]
        ends = pa.array([0, *accumulate(len(x) // 4 for x in packed)], pa.int32())
        ids = pa.Array.from_buffers(pa.int32(), ends[-1].as_py(), [None, pa.py_buffer(b"".join(packed))])
        return pa.ListArray.from_arrays(ends, ids)


class Gather:
    """Joins what each id stands for, for a whole column of lists in one vectorised gather."""

    def __init__(self, meaning: dict[int, bytes]):
        table = [None] * (max(meaning, default=-1) + 1)
        for i, b in meaning.items():
            table[i] = b
        self.table = pa.array(table, pa.large_binary())

    def __call__(self, lists: pa.ListArray) -> pa.BinaryArray:
        n = pc.fill_null(pc.list_value_length(lists), 0)
        found = self.table.take(pc.list_flatten(lists))
        if found.null_count:
            raise ValueError("an id is not in the vocabulary")
        _, ends, joined = found.buffers()  # the gathered bytes lie one after another
        ends = np.frombuffer(ends, np.int64)[found.offset:found.offset + len(found) + 1]
        cuts = ends[np.concatenate([[0], np.cumsum(n.to_numpy(zero_copy_only=False))])]
        return pa.Array.from_buffers(pa.binary(), len(n), [
            None, pa.py_buffer((cuts - cuts[0]).astype(np.int32)), joined.slice(int(cuts[0])) if joined else pa.py_buffer(b"")])


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


class Codec:
    """One vocabulary in a worker process: an encoder, the decoder, and what a digest of the ids joins."""

    def __init__(self, ranks: dict[bytes, int], merges: dict[bytes, tuple[bytes, bytes]], pattern: str):
        self.encoder = Encoder(ranks, merges, pattern)
        self.decoded = Gather({r: t for t, r in ranks.items()})
        self.spelled = Gather({r: b"%d " % r for r in ranks.values()})

    def digests(self, ids: pa.ListArray) -> list[pa.Array]:
        """n_tokens, ids_sha256 and decoded_sha256 of each list."""
        return [pc.list_value_length(ids).cast(pa.int64()),
                pa.array([sha256(x[:-1]) for x in self.spelled(ids).to_pylist()], pa.string()),
                pa.array([sha256(x) for x in self.decoded(ids).to_pylist()], pa.string())]


def codec(spark: SparkSession, ranks: dict[bytes, int], pattern: str):
    """A function for tasks that gives their process's ``Codec``: it outlives the task, and one is kept at a time.

    ``ranks`` is the vocabulary (its size is the bound of what is sent to every task).
    """
    shared = spark.sparkContext.broadcast((ranks, last_merges(ranks)))
    mark = sha256(repr((sorted(ranks.items()), pattern)).encode())

    def get() -> Codec:
        kept = worker_cache()
        if mark != kept.get("bpe", (None,))[0]:
            kept["bpe"] = mark, Codec(*shared.value, pattern)
        return kept["bpe"][1]

    return get


def mapped(df: DataFrame, made, fields: list[T.StructField], source: Column) -> DataFrame:
    """``df`` with columns made of ``source``, slice by slice in tasks; a column with the name of a new one is replaced.

    ``made`` gives, in a task, the function from a slice of ``source`` to the arrays of ``fields``.
    """
    new = [f.name for f in fields]
    keep = [f for f in df.schema.fields if f.name.lower() not in {n.lower() for n in new}]
    names = [*(f.name for f in keep), *new]

    def run(batches):
        columns = made()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *columns(b.column(0))], names)

    fresh = "_" * (1 + max((len(f.name) for f in keep), default=0))  # a name that no column has
    return df.select(source.alias(fresh), *(df[f.name] for f in keep)).mapInArrow(run, T.StructType([*keep, *fields]))


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text",
           ids_col: str = "token_ids") -> DataFrame:
    """Add ``ids_col`` (array<int>): the token ids of ``text_col``."""
    get = codec(df.sparkSession, ranks, pattern)

    def made():
        encoder = get().encoder
        return lambda texts: [encoder.lists(texts.to_pylist())]

    return mapped(df, made, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], df[text_col].cast("string"))


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """Add ``bytes_col`` (binary): the bytes of ``ids_col``."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def made():
        decoded = Gather({r: t for t, r in shared.value.items()})
        return lambda ids: [decoded(ids)]

    return mapped(df, made, [T.StructField(bytes_col, T.BinaryType())], df[ids_col].cast("array<int>"))


def round_trips(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "token_ids",
                same_col: str = "round_trip") -> DataFrame:
    """Add ``ids_col`` and, decoded in the same task, whether the ids give back the text's bytes (null: none)."""
    get = codec(df.sparkSession, ranks, pattern)

    def made():
        one = get()

        def columns(texts):
            ids = one.encoder.lists(texts.to_pylist())
            return [ids, pc.equal(one.decoded(ids), pc.fill_null(texts, "").cast(pa.binary()))]

        return columns

    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(same_col, T.BooleanType())]
    return mapped(df, made, fields, df[text_col].cast("string"))


def digested(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256: ``digests`` of ``encode`` and ``decode``, without handing ids on."""
    get = codec(df.sparkSession, ranks, pattern)

    def made():
        one = get()
        return lambda texts: one.digests(one.encoder.lists(texts.to_pylist()))

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    return mapped(df, made, fields, df[text_col].cast("string"))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from the outputs of ``encode`` and ``decode``."""
    return df.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def default_vocabulary() -> tuple[dict[bytes, int], str]:
    """Ranks and split pattern of the installed public vocabulary ``byte_bpe_50k``."""
    import public_tokenizers
    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return digested(docs.select("doc_id", "text"), *default_vocabulary()).drop("text")
