"""Near-duplicate documents by b-bit MinHash, with links confirmed on full shingle sets.

1. Sketches. Words are runs of characters other than space and \\x09-\\x0D, A-Z lower-cased; a document's set is its distinct
   5-word shingles (the whole sequence as one below five words) as 64-bit hashes. Of ``BANDS`` × ``ROWS`` minima, the
   bands become 64-bit keys and the lowest ``BITS`` bits of every minimum are kept, packed into bit planes.
2. Classes. Documents with equal sets (a 128-bit digest) are one class, stood for by its smallest doc_id; only classes go on.
3. Candidates. Classes that share a band key with others are tied to the smallest class of that key; connected
   components of these ties are the candidate groups. Nothing lists the pairs of a bucket.
4. Links. A group's members meet with their texts, in tiles: members are dealt into blocks of at most
   ``BLOCK_ROWS`` rows and about ``BLOCK_BYTES`` bytes, and each pair of blocks is one task's work, so a group of any size is split. In a tile
   the similarity of all pairs of different local components is estimated from the bit planes by counting equal lanes, corrected
   for chance collisions (2^-BITS); pairs estimated at more than 5 standard deviations below the limit are
   confirmed on the full sets, a row's likeliest first, unless they have been joined meanwhile. A tile hands on a spanning forest of its links.
5. Components of the links, and back from classes to documents.

Bands of 5 minima, 40 of them, miss a pair at similarity 0.75 with probability 2e-5, at 0.8 with 1e-7; the estimate's filter with
3e-7. All confirmed links are exact: 100 · |A ∩ B| ≥ 75 · |A ∪ B|.

Skew: equal copies collapse in a partial aggregate; a hot band key costs one row per class and band; a hot group is
tiled. Tables between the steps lie in the shared folder, so a lost executor repeats only its own tasks.

Defined results: a null or empty text, or one without words, has 0 shingles, is linked with nothing and kept; every row
is judged by its own text, rows that repeat a doc_id and its text alike, and different texts of a class's smallest doc_id
count as one document; a null doc_id takes part in nothing: its component is null and it is not kept; an empty table gives no
rows. Columns of the input other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, written
from .components import connected_components

ship(__name__)

SHINGLE = 5
LIMIT = 75  # percent
BANDS, ROWS, BITS = 40, 5, 4
MINIMA = BANDS * ROWS
WORDS = -(-MINIMA // 64)  # 64-bit words of one bit plane
BLOCK_ROWS, BLOCK_BYTES = 2048, 16 << 20
SHINGLE_BYTES = 16  # of text and hash, about, that a shingle takes in a task
WORD_MEMO = 1 << 18

_rng = np.random.default_rng(5)
MASKS = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
FACTORS = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
MIXERS = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all (the finaliser of a public hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """word → 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.encode("utf-8").lower().split() if text else []  # of bytes: ASCII white space and case only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    x = h[:n] * MIXERS[0]
    for i in range(1, SHINGLE):
        x = mixed(x) + h[i:i + n] * MIXERS[i]
    return np.unique(mixed(x))


def minima(shingles: np.ndarray) -> np.ndarray:
    """MINIMA smallest values of the set under as many cheap permutations of 32-bit hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(out, ((x[at:at + 256, None] ^ MASKS) * FACTORS).min(0), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, of the band's number and its minima."""
    x = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + m.reshape(BANDS, ROWS)[:, i].astype(np.uint64))
    return x.view(np.int64)


def planes(m: np.ndarray) -> bytes:
    """The lowest BITS bits of all minima, one plane after another."""
    bits = np.zeros((BITS, WORDS * 64), np.uint8)
    for b in range(BITS):
        bits[b, :MINIMA] = (m >> np.uint32(b)) & np.uint32(1)
    return np.packbits(bits, axis=1).tobytes()


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of one signature to many (rows of BITS × WORDS words), corrected for lanes equal by chance."""
    differ = one ^ many
    for b in range(1, BITS):
        differ[:, 0] |= differ[:, b]
    equal = 1.0 - np.bitwise_count(differ[:, 0]).sum(1) / MINIMA
    chance = 2.0 ** -BITS
    return (equal - chance) / (1.0 - chance)


def least_estimate() -> float:
    """Five standard deviations of the estimate below the limit."""
    j, c = LIMIT / 100, 2.0 ** -BITS
    p = j + (1 - j) * c
    return j - 5 * (p * (1 - p) / MINIMA) ** 0.5 / (1 - c)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exactly: 100 · |A ∩ B| ≥ LIMIT · |A ∪ B|."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < LIMIT * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= LIMIT * (len(a) + len(b) - both)


def sketches(texts: DataFrame) -> DataFrame:
    """(id, text_hash, n_shingles, digest, planes, bands) of every row; the last three are null without words."""
    def run(batches: Iterator[pa.RecordBatch]):
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                size, digest, plane, bands = [], [], [], []
                for text in part.column(2).to_pylist():
                    s = shingle_set(text, hashes)
                    size.append(len(s))
                    if len(s):
                        m = minima(s)
                        digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                        plane.append(planes(m))
                        bands.append(band_keys(m))
                    else:
                        digest.append(None)
                        plane.append(None)
                        bands.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.binary()),
                     pa.array(plane, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["id", "text_hash", "n_shingles", "digest", "planes", "bands"])

    return texts.mapInArrow(
        run, "id long, text_hash long, n_shingles long, digest binary, planes binary, bands array<long>")


def forest(tile: pa.Table, within: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links in a tile: of one block, or between the two blocks of a pair."""
    ids = tile.column("id").to_numpy()
    texts = tile.column("text").to_pylist()
    second = tile.column("second").to_numpy(zero_copy_only=False).astype(bool)
    sig = np.frombuffer(b"".join(tile.column("planes").to_pylist()), np.uint64).reshape(len(ids), BITS, WORDS)
    hashes, sets = WordHashes(), {}
    root = np.arange(len(ids))  # the local component of each row, always up to date

    def shingles(i):
        if i not in sets:
            sets[i] = shingle_set(texts[i], hashes)
        return sets[i]

    low, found = least_estimate(), []
    for i in range(len(ids) - 1) if within else np.flatnonzero(~second):
        others = np.arange(i + 1, len(ids)) if within else np.flatnonzero(second)
        others = others[root[others] != root[i]]
        e = estimates(sig[i], sig[others])
        near = np.flatnonzero(e >= low)
        for j in others[near[np.argsort(-e[near], kind="stable")]]:
            if root[i] != root[j] and linked(shingles(i), shingles(j)):
                found.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
    return found


def texts_of(members: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per (id, text_hash) of ``members``, however many rows of ``texts`` repeat it."""
    return texts.join(members.select("id", "text_hash"), ["id", "text_hash"], "left_semi").dropDuplicates(["id", "text_hash"])


def links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Spanning links (u, v) of candidate groups.

    ``members``: id, text_hash, n_shingles, planes, group of the classes in groups of two or more; ``texts``: id, text_hash, text.
    """
    per_block = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n_shingles") * SHINGLE_BYTES / BLOCK_BYTES))
    sizes = members.groupBy("group").agg(per_block.cast("int").alias("blocks"))
    dealt = (members.join(sizes, "group").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
             .join(texts_of(members, texts), ["id", "text_hash"]))
    tiles = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "group", F.least("b", "o").alias("first"), F.greatest("b", "o").alias("last"),
        (F.col("b") > F.col("o")).alias("second"), "id", "text", "planes")

    def run(tile: pa.Table) -> pa.Table:
        pairs = forest(tile, tile.column("first")[0] == tile.column("last")[0])
        return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})

    return tiles.groupBy("group", "first", "last").applyInArrow(run, "u long, v long")


def _texts(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, text_hash, text) of every row."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _judged(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, text_hash, n_shingles, component_id) of every row."""
    texts = _texts(docs, text_col, id_col)
    sk = written(sketches(texts), "minhash-sketches")
    known = sk.where(F.col("id").isNotNull() & F.col("digest").isNotNull())
    classes = written(known.groupBy("digest").agg(F.min(F.struct("id", "text_hash")).alias("rep"))
                      .select("digest", "rep.*"), "minhash-classes")
    reps = written(known.join(classes, ["digest", "id", "text_hash"], "left_semi").dropDuplicates(["digest"]), "minhash-reps")

    keys = reps.select("id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    ties = keys.join(shared, "key").select(F.col("id").alias("u"), F.col("low").alias("v"))
    candidate = connected_components(ties).withColumnRenamed("component", "group")

    members = reps.select("id", "text_hash", "n_shingles", "planes").join(candidate, "id")
    component = connected_components(links(members, texts)).withColumnRenamed("id", "class")
    by_class = (classes.select("digest", F.col("id").alias("class")).join(component, "class", "left")
                .select("digest", F.coalesce("component", "class").alias("component_id")))
    alone = F.when(F.col("digest").isNull(), F.col("id"))
    return (sk.select("id", "text_hash", "n_shingles", "digest").join(by_class, "digest", "left")
            .select("id", "text_hash", "n_shingles",
                    F.when(F.col("id").isNotNull(), F.coalesce("component_id", alone)).alias("component_id")))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id and kept (its component's smallest id is its own)."""
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return _judged(docs, text_col, id_col).select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; rows with a null id, which are linked with nothing, stay."""
    gone = (_judged(docs, text_col, id_col).where(F.col("id") != F.col("component_id"))
            .select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")))
    match = ((docs[id_col].cast("long") == gone["__id"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["__hash"]))
    return docs.join(gone, match, "left_anti")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
