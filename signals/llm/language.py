"""Language identification in two levels: the language family first, then one-versus-one linear support vector machines in it.

A text's features are the relative frequencies of its letter 1-, 2- and 3-grams, hashed: letters are lower-cased, every run of other
characters is one gap, and grams may include one gap at their ends. All classifiers are linear, so a text's
margins are the mean of one row of weights per gram: a gather and a sum.

Level 1 separates each two families, level 2 each two languages of a family, by machines with squared hinge loss. A level's
winner has the most votes, then the larger sum of margins, then the smaller name. Score: the mean, over the machines that
the winner takes part in, of the logistic function of its margin, times the same of its family; 0 if the text does not fit the winner.

Fit: a text fits a language if enough of its letter 3-grams are usual there, which are those in at least ``USUAL`` of the language's
training texts. To that share, ``PRIOR_GRAMS`` grams of the language's median share are added, so a few letters decide nothing. The
least share comes from the language's own distinct training texts alone, for any number of languages: they are halved, each is held against
the other half's usual grams, as it is and with its letters shuffled; the limit is half way between the two medians, but not
above the ``LOW_SHARE`` quantile of the texts as they are. A language with one distinct text has no limit.

Fit: all languages are learned. Of each, equally many documents as far as there are, chosen by the hash of the id: ``TRAIN_DOCS`` over the
number of languages, but at most ``MAX_PER_LANGUAGE`` (300; so 1,200 documents with four languages) and at least ``MIN_PER_LANGUAGE``
(20, from 200 languages on). Whole texts teach, those of at most ``TRAIN_CHARS`` characters; of a language that has longer ones only, its
shortest. On the driver, in memory bounded by these and the number of languages.
Scoring is one pass over all whole texts without a shuffle; the weights are broadcast (``DIMS`` × number of machines).

Families are a table of common language codes; a language that it lacks is a family of its own, but if it lacks more than ``GROUP``, these are dealt
into families of at most ``GROUP`` by name, so the machines do not grow with the square of all languages' number.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for all texts if there is nothing to learn from; with
one language only, that language with score 1, or 0 for texts that do not fit it; null ids and null languages teach nothing, an id that rows repeat by its smallest text; repeated rows are judged each on its own; an empty table gives no
rows. Columns of the input named lang_pred or score are replaced, all others pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, ship

ship(__name__)

UNKNOWN = "und"
TRAIN_DOCS, TRAIN_CHARS, MAX_PER_LANGUAGE, MIN_PER_LANGUAGE = 4000, 20_000, 300, 20
GROUP, MACHINES_AT_ONCE = 16, 256
DIMS = 1 << 13
STEPS, RIDGE, SCALE = 300, 1e-4, 30.0
SLICE_ROWS = 256
USUAL, PRIOR_GRAMS, LOW_SHARE = 0.02, 20, 0.01
TRIPLE_BITS = 18  # of the hash that the set of a language's usual 3-grams is kept by
LEAST_FITTING = 1 / 16  # a winner has at least half the votes, each with a chance of at least a half, at both levels

# fixed values: families of common language codes
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "turkic": ("az", "kk", "ky", "tr", "tk", "uz"),
    "semitic": ("am", "ar", "he", "mt"),
    "austronesian": ("id", "jv", "ms", "su", "tl"),
}
FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs}


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hashed grams of all texts, one after another, the number of grams of each (0: no letter) and each text's 3-grams,
    hashed apart from them."""
    parts, sizes, triples = [], np.zeros(len(texts), np.int64), [np.empty(0, np.uint32)] * len(texts)
    for i, text in enumerate(texts):
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        is_letter = letter[codes]
        if not is_letter.any():
            continue
        c = np.where(is_letter, codes, 0)
        c = c[is_letter | np.append(True, is_letter[:-1])]  # of a run of other characters, the first
        c = np.concatenate([[0], c, [0]]).astype(np.uint32)
        x = c * np.uint32(0x9E3779B1)
        pair = (x[:-1] ^ (c[1:] * np.uint32(0x85EBCA6B) + np.uint32(7))) * np.uint32(0xC2B2AE35)
        triple = (pair[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F) + np.uint32(11))) * np.uint32(0x165667B1)
        triple = triple[c[1:-1] > 0]
        single = x[c > 0]
        g = np.concatenate([single, pair[(c[:-1] > 0) | (c[1:] > 0)], triple]) >> np.uint32(32 - 13)
        triples[i] = triple >> np.uint32(32 - TRIPLE_BITS)
        parts.append(g)
        sizes[i] = len(g)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), sizes, triples


@dataclass
class Fit:
    """What a text must hold to be in a language."""
    usual: np.ndarray  # bits, by the hash of a 3-gram
    typical: float  # median share of usual 3-grams
    least: float

    def count(self, triples: np.ndarray) -> int:
        return int(((self.usual[triples >> 3] >> (triples & 7).astype(np.uint8)) & 1).sum())

    def share(self, triples: np.ndarray) -> float:
        """Share of usual 3-grams, with the prior's."""
        return (self.count(triples) + PRIOR_GRAMS * self.typical) / (len(triples) + PRIOR_GRAMS)


def usual_triples(triples: list[np.ndarray]) -> np.ndarray:
    count = np.zeros(1 << TRIPLE_BITS, np.int32)
    for t in triples:
        count[np.unique(t)] += 1
    return np.packbits(count >= max(1, math.ceil(USUAL * len(triples))), bitorder="little")


def shuffled(texts: list[str], letter: np.ndarray) -> list[str]:
    """The texts with their letters dealt anew over the letters' places."""
    rng, out = np.random.default_rng(0), []
    for text in texts:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).copy()
        at = np.flatnonzero(letter[codes])
        codes[at] = codes[rng.permutation(at)]
        out.append(codes.tobytes().decode("utf-32-le", "replace"))
    return out


def fit_shares(texts: list[str], letter: np.ndarray) -> Fit:
    texts = list(dict.fromkeys(texts))
    own = [t for t in grams(texts, letter)[2] if len(t)]
    junk = [t for t in grams(shuffled(texts, letter), letter)[2] if len(t)]
    if len(own) < 2:
        return Fit(usual_triples(own), 1.0, 0.0)
    other = [Fit(usual_triples(own[k::2]), 0.0, 0.0) for k in (1, 0)]
    typical = float(np.median([other[i % 2].count(t) / len(t) for i, t in enumerate(own)]))
    for half in other:
        half.typical = typical
    as_is, mixed = (np.array([other[i % 2].share(t) for i, t in enumerate(rows)]) for rows in (own, junk))
    least = min((np.median(as_is) + np.median(mixed)) / 2, np.quantile(as_is, LOW_SHARE))
    return Fit(usual_triples(own), typical, float(least))


@dataclass
class Model:
    languages: list[str]
    family_of: list[str]
    #: machines: (level, name of the side with positive margins, of the other); level "" separates families
    machines: list[tuple[str, str, str]]
    weights: np.ndarray  # (DIMS, machines)
    bias: np.ndarray
    fits: list[Fit]  # one for each language


def fit_machines(x: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear SVMs with squared hinge loss, one per column of ``targets`` (1, -1, 0: not in this machine), by
    accelerated gradient steps."""
    n, d = x.shape
    xb = np.concatenate([x, np.ones((n, 1), np.float32)], 1)
    v = np.ones(d + 1, np.float32)
    for _ in range(20):  # largest eigenvalue, for the step length
        v = xb.T @ (xb @ v)
        v /= np.linalg.norm(v)
    top = float(np.linalg.norm(xb @ v) ** 2)
    count = np.maximum(1, (targets != 0).sum(0)).astype(np.float32)
    rate = 1.0 / (2.0 * top / count + RIDGE)
    some = [slice(at, at + MACHINES_AT_ONCE) for at in range(0, targets.shape[1], MACHINES_AT_ONCE)]
    w = np.concatenate([fit_steps(xb, targets[:, k], count[k], rate[k]) for k in some], 1)
    return w[:-1], w[-1]


def fit_steps(xb: np.ndarray, targets: np.ndarray, count: np.ndarray, rate: np.ndarray) -> np.ndarray:
    w = np.zeros((xb.shape[1], targets.shape[1]), np.float32)
    ahead, t = w, 1.0
    for _ in range(STEPS):
        slack = np.maximum(0.0, 1.0 - targets * (xb @ ahead)) * np.abs(targets)
        grad = -2.0 * (xb.T @ (slack * targets)) / count + RIDGE * ahead
        new = ahead - rate * grad
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def fit(docs: DataFrame, folds: int = 4, held_out: int = 2, text_col: str = "text", id_col: str = "doc_id",
        lang_col: str = "lang") -> Model | None:
    """Learn from the rows with an id, a text and a language whose fold is not ``held_out``; None without any."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"),
                       F.col(lang_col).cast("string").alias("__lang"))
    rows = rows.where(F.col("__id").isNotNull() & F.col("__lang").isNotNull() & (fold("__id", folds) != held_out)
                      & F.col("__text").rlike(r"\p{L}"))
    rows = rows.withColumn("__chars", F.length("__text"))
    short = F.count_distinct(F.when(F.col("__chars") <= TRAIN_CHARS, F.col("__id")))
    counts = rows.groupBy("__lang").agg(F.greatest(short, F.lit(1)).alias("n"), F.min("__chars").alias("least")).collect()
    if not counts:
        return None
    quota = min(MAX_PER_LANGUAGE, max(MIN_PER_LANGUAGE, TRAIN_DOCS // len(counts)))
    chance = F.pmod(F.xxhash64("__id", F.lit("lang")), F.lit(1 << 20)) / (1 << 20)
    wanted = max(1.2 * quota, quota + 40)  # so that chance does not leave a language out
    limits = docs.sparkSession.createDataFrame([(r["__lang"], wanted / r["n"] if r["least"] <= TRAIN_CHARS else 2.0, max(TRAIN_CHARS, r["least"]))
                                                for r in counts], "__lang string, __limit double, __most long")
    sample = (rows.withColumn("__chance", chance).join(F.broadcast(limits), "__lang")  # one row a language
              .where("__chance < __limit AND __chars <= __most").select("__id", "__lang", "__text")
              .groupBy("__id", "__lang").agg(F.min("__text").alias("__text")))
    by_lang: dict[str, list[str]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["__id"], r["__text"])):
        by_lang.setdefault(r["__lang"], []).append(r["__text"])
    return fit_texts({k: v[:quota] for k, v in by_lang.items()})


def families_of(languages: list[str]) -> list[str]:
    other = sorted(lang for lang in languages if lang not in FAMILY)
    if len(other) <= GROUP:
        return [FAMILY.get(lang, lang) for lang in languages]
    dealt = {lang: f"other {k // GROUP}" for k, lang in enumerate(other)}
    return [FAMILY.get(lang) or dealt[lang] for lang in languages]


def fit_texts(by_lang: dict[str, list[str]]) -> Model | None:
    letter = letter_table()
    languages = sorted(by_lang)
    x, y = [], []
    for k, lang in enumerate(languages):
        g, sizes, _ = grams(by_lang[lang], letter)
        end = 0
        for n in sizes.tolist():
            if n:
                x.append((SCALE * np.bincount(g[end:end + n], minlength=DIMS) / n).astype(np.float32))
                y.append(k)
            end += n
    if not x:
        return None
    x, y = np.stack(x), np.array(y)
    families = families_of(languages)
    fits = [fit_shares(by_lang[lang], letter) for lang in languages]
    own = np.array(families)[y]
    names = sorted(set(families))
    levels = [("", names, own)]
    levels += [(f, [lang for lang, name in zip(languages, families) if name == f], np.array(languages)[y]) for f in names]
    machines, weights, bias = [], [np.zeros((DIMS, 0), np.float32)], [np.zeros(0, np.float32)]
    for level, sides, side in levels:
        games = [(a, b) for i, a in enumerate(sides) for b in sides[i + 1:]]
        if games:
            inside = np.isin(side, sides)
            side = side[inside]
            w, b = fit_machines(x if inside.all() else x[inside],
                                np.stack([(side == p) * np.float32(1) - (side == q) * np.float32(1) for p, q in games], 1))
            machines += [(level, p, q) for p, q in games]
            weights.append(w)
            bias.append(b)
    return Model(languages, families, machines, np.concatenate(weights, 1), np.concatenate(bias), fits)


def tournament(names: list[str], games: list[tuple[int, str, str]], margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's winner among the sorted ``names`` and its mean chance against the others."""
    place = {n: i for i, n in enumerate(names)}
    votes, total, chance = (np.zeros((len(margin), len(names))) for _ in range(3))
    for k, a, b in games:
        m = margin[:, k]
        votes[:, place[a]] += m >= 0
        votes[:, place[b]] += m < 0
        total[:, place[a]] += m
        total[:, place[b]] -= m
        p = 1 / (1 + np.exp(-np.clip(2 * m, -60, 60)))
        chance[:, place[a]] += p
        chance[:, place[b]] += 1 - p
    best = np.lexsort((-np.arange(len(names))[None, :].repeat(len(margin), 0), total, votes), axis=1)[:, -1]
    won = chance[np.arange(len(margin)), best] / max(1, len(names) - 1) if len(names) > 1 else np.ones(len(margin))
    return best, won


def predict(model: Model, texts: list[str | None], letter: np.ndarray) -> tuple[list[str], np.ndarray]:
    g, sizes, triples = grams(texts, letter)
    some = np.flatnonzero(sizes)
    pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if not len(some):
        return pred.tolist(), score
    if len(model.machines):
        at = (np.cumsum(sizes) - sizes)[some]
        margin = np.stack([np.add.reduceat(model.weights[:, k][g].astype(np.float64), at) for k in range(len(model.machines))], 1)
        margin = SCALE * margin / sizes[some][:, None] + model.bias
    else:
        margin = np.zeros((len(some), 0))
    names = sorted(set(model.family_of))
    family, sure = tournament(names, [(k, a, b) for k, (f, a, b) in enumerate(model.machines) if f == ""], margin)
    for i, f in enumerate(names):
        rows = np.flatnonzero(family == i)
        inside = [lang for lang, name in zip(model.languages, model.family_of) if name == f]
        best, won = tournament(inside, [(k, a, b) for k, (g_, a, b) in enumerate(model.machines) if g_ == f], margin[rows])
        pred[some[rows]] = np.array(inside, object)[best]
        score[some[rows]] = sure[rows] * won
    fit_of = dict(zip(model.languages, model.fits))
    for i in some:
        own = fit_of[pred[i]]
        if own.share(triples[i]) < own.least:
            score[i] = 0.0
    return pred.tolist(), score


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All rows with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    keep = docs.columns
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        letter = letter_table()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                pred, score = predict(shared.value, b.column(b.num_columns - 1).to_pylist(), letter)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(pred, pa.string()),
                                                  pa.array(score)], schema.fieldNames())

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    model = fit(docs)
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
