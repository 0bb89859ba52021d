"""Toxic spans by a linear-chain conditional random field (CRF) over words, and document scores from its marginals.

Tokens are runs of letters. Each has the features: the lower-cased word, its prefixes of 3 to 7 letters, its suffixes of 3 and 4,
and its case. The two-state chain (clean, toxic) has one weight per feature, a start weight and a transition table.

Labelled tokens. Labels mark documents, so the labels of the tokens are made first: in the training sample (one document of
every group of near copies) a feature marks toxicity if its document frequency in toxic documents is
significantly higher (log-likelihood ratio ≥ ``LEAST_LLR``) and its odds at least ``LEAST_ODDS`` times as high;
a token of a toxic document with such a word or prefix is labelled toxic, all others are clean.

Marginals. With two states the forward and the backward message are one log-odds number per token. Both are solved for all tokens of a batch at
once by repeating the chain's step where the neighbour's number has changed; the step contracts, so after a few rounds
nothing changes any more, and after as many rounds as the longest text has tokens the result is the recursion's own.

Document score: a logistic regression of the marginals' maximum, of the log of their sum and of their mean, its
cases weighted back to the label's frequency. Spans: [start, stop) character offsets of runs of tokens with
a marginal of 0.5 or more.

Scale: the fit sees at most ``TRAIN_DOCS`` labelled documents per class, those with the smallest hashes among the labels, leaving out texts
over ``TRAIN_CHARS`` characters; it runs on the driver in memory bounded by these two. Scoring is one pass over all whole texts with
no shuffle; the model, as large as the sample's vocabulary at most, is broadcast.

Defined results: null and empty texts, and texts without letters, have no tokens and get the score of no evidence; without labelled rows of both
classes every score is the frequency of toxic labels (0 without any); rows with a null doc_id or label teach nothing; a document
labelled twice is toxic if one label says so; repeated rows are scored each on its own; an empty table gives no rows. Columns of the input named score,
predicted or spans are replaced, all others pass through.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, ship

ship(__name__)

TRAIN_DOCS, TRAIN_CHARS = 1200, 20_000
LEAST_LLR, LEAST_ODDS = 8.0, 8.0
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7), (3, 4)
WIDTH = 2 + len(PREFIXES) + len(SUFFIXES)
STEPS, RATE, RIDGE = 60, 0.15, 1e-3
LEAST_WEIGHT = 0.005  # smaller weights are left out of the model
WORD_MEMO = 1 << 18
SLICE_ROWS = 256
TOKEN = re.compile(r"[^\W\d_]+")


def names(word: str) -> list[str]:
    """Names of a word's features; a prefix or suffix as long as the word is the word's own feature."""
    low = word.lower()
    return ["w:" + low, "c:" + case_of(word), *("p:" + low[:k] for k in PREFIXES if k < len(low)),
            *("s:" + low[-k:] for k in SUFFIXES if k < len(low))]


def case_of(word: str) -> str:
    return "upper" if len(word) > 1 and word.isupper() else "title" if word[0].isupper() else "lower"


@dataclass
class Crf:
    weights: dict[str, float] = field(default_factory=dict)  # by the feature's name; others have none
    start: float = 0.0
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # from state, to state
    doc: np.ndarray = field(default_factory=lambda: np.zeros(4))  # logistic weights, the intercept last


class Emissions(dict):
    """word → log odds of its features, remembered up to a bound."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        def kind(k):
            return {name[2:]: w for name, w in weights.items() if name[0] == k}
        self.word, self.case, self.prefix, self.suffix = kind("w"), kind("c"), kind("p"), kind("s")

    def __missing__(self, word: str) -> float:
        if len(self) >= WORD_MEMO:
            self.clear()
        low = word.lower()
        n, get = len(low), self.prefix.get
        e = self.word.get(low, 0.0) + self.case.get(case_of(word), 0.0)
        for k in PREFIXES:
            if k >= n:
                break
            e += get(low[:k], 0.0)
        for k in SUFFIXES:
            if k < n:
                e += self.suffix.get(low[-k:], 0.0)
        self[word] = e
        return e


def chained(base: np.ndarray, first: np.ndarray, m: np.ndarray, init: float, exact: float) -> np.ndarray:
    """Solve x[t] = base[t] + g(x[t-1]), and x = base + init at the ``first`` tokens of texts, where
    g(x) = log((m00 e^x + m01) / (m10 e^x + m11)) of the logs ``m``; changes up to ``exact`` are not passed on."""
    def g(x):
        return np.logaddexp(x + m[0, 0], m[0, 1]) - np.logaddexp(x + m[1, 0], m[1, 1])

    n = len(base)
    x = base.copy()
    x[first] += init
    inner = np.ones(n + 1, bool)
    inner[first] = inner[n] = False
    at = np.flatnonzero(inner[:n])
    while len(at):
        new = base[at] + g(x[at - 1])
        changed = np.abs(new - x[at]) > exact
        x[at] = new
        at = at[changed] + 1
        at = at[inner[at]]
    return x


def messages(crf: Crf, e: np.ndarray, starts: np.ndarray, exact: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Forward log odds (with the token's own evidence) and backward log odds of every token."""
    if not len(e):
        return e, e
    t = crf.steps
    forward = chained(e, starts, np.array([[t[1, 1], t[0, 1]], [t[1, 0], t[0, 0]]]), crf.start, exact)
    # backward, on the reversed chain: y[t] = e[t] + log odds of what follows
    last = len(e) - np.append(starts[1:], len(e))
    y = chained(e[::-1].copy(), np.sort(last), np.array([[t[1, 1], t[1, 0]], [t[0, 1], t[0, 0]]]), 0.0, exact)[::-1]
    return forward, y - e


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def evidence(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text: the largest marginal, log(1 + their sum), their mean, 1."""
    out = np.zeros((len(sizes), 4))
    out[:, 3] = 1.0
    some = np.flatnonzero(sizes)
    if len(some):
        at = (np.cumsum(sizes) - sizes)[some]
        total = np.add.reduceat(p, at)
        out[some, 0] = np.maximum.reduceat(p, at)
        out[some, 1] = np.log1p(total)
        out[some, 2] = total / sizes[some]
    return out


def marginals(crf: Crf, emissions: Emissions, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all tokens of the texts, and the number of tokens of each text."""
    words, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = TOKEN.findall(text) if text else []
        sizes[i] = len(found)
        words += found
    e = np.fromiter(map(emissions.__getitem__, words), np.float64, len(words))
    forward, backward = messages(crf, e, (np.cumsum(sizes) - sizes)[sizes > 0])
    return sigmoid(forward + backward), sizes


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """[start, stop) of the runs of tokens with a marginal of 0.5 or more."""
    out = []
    open_run = False
    for m, hot in zip(TOKEN.finditer(text), p >= 0.5):
        if hot and open_run:
            out[-1]["stop"] = m.end()
        elif hot:
            out.append({"start": m.start(), "stop": m.end()})
        open_run = bool(hot)
    return out


# --- fitting, on the driver, from a bounded sample


def distinct_texts(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """One text of every group of near copies: texts that share one of the four smallest hashes of their 5-word windows."""
    seen, out = set(), []
    for text, label in rows:
        words = text.lower().split()
        windows = {zlib.crc32(" ".join(words[i:i + 5]).encode()) for i in range(max(1, len(words) - 4))}
        low = sorted(windows)[:4]
        if not any(x in seen for x in low):
            out.append((text, label))
        seen.update(low)
    return out


def markers(features: np.ndarray, can_mark: np.ndarray, docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Which features mark toxic documents; ``docs`` holds the distinct words of each."""
    seen = np.zeros((2, len(can_mark)))
    for words, label in zip(docs, labels.astype(int)):
        seen[label, np.unique(features[words])] += 1
    clean, toxic = seen
    n0, n1 = len(labels) - labels.sum(), labels.sum()
    base, share = n1 / (n0 + n1), toxic / np.maximum(1, toxic + clean)
    odds = ((toxic + 0.5) / (n1 + 1)) / ((clean + 0.5) / (n0 + 1))
    llr = toxic * np.log(np.maximum(share, 1e-12) / base) + clean * np.log(np.maximum(1 - share, 1e-12) / (1 - base))
    return can_mark & (share > base) & (llr >= LEAST_LLR) & (odds >= LEAST_ODDS)


def fit_crf(texts: list[str], labels: np.ndarray) -> Crf:
    """Maximum likelihood with a ridge by Adam, on token labels made from the documents' labels."""
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in TOKEN.findall(t)], np.int32) for t in texts]
    ids = np.concatenate([*docs, np.empty(0, np.int32)])
    sizes = np.array([len(d) for d in docs], np.int64)
    known: dict[str, int] = {}
    features = np.full((len(index), WIDTH), -1, np.int32)
    for i, w in enumerate(index):
        own = [known.setdefault(n, len(known)) for n in names(w)]
        features[i, :len(own)] = own
    nothing = len(known)  # the feature of weight 0
    features[features < 0] = nothing
    can_mark = np.array([n[0] in "wp" for n in known] + [False])
    marked = markers(features, can_mark, [np.unique(d) for d in docs], labels)[features].any(1)
    gold = marked[ids] & np.repeat(labels.astype(bool), sizes)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    crf = Crf()
    if not len(ids):
        return crf
    inner = np.ones(len(ids), bool)
    inner[starts] = False
    second = np.flatnonzero(inner)
    params = np.zeros(nothing + 1 + 1 + 4)
    rare = max(1, int(gold.sum())) / len(gold)
    params[-5] = math.log(rare)
    params[-4:] = np.log([1 - rare, rare, 0.9, 0.1])
    seen_steps = np.bincount(2 * gold[second - 1].astype(int) + gold[second], minlength=4)
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        crf.start, crf.steps = params[-5], params[-4:].reshape(2, 2)
        e = params[:nothing + 1][features].sum(1)[ids]
        forward, backward = messages(crf, e, starts, 1e-3)
        p = sigmoid(forward + backward)
        word = np.bincount(ids, weights=gold - p, minlength=len(index))
        grad = np.zeros_like(params)
        grad[:nothing + 1] = np.bincount(features.ravel(), weights=np.repeat(word, WIDTH), minlength=nothing + 1)
        grad[-5] = (gold[starts] - p[starts]).sum()
        a, b = forward[second - 1], e[second] + backward[second]
        joint = np.stack([np.full(len(a), crf.steps[0, 0]), crf.steps[0, 1] + b, crf.steps[1, 0] + a,
                          crf.steps[1, 1] + a + b])
        joint = np.exp(joint - joint.max(0))
        grad[-4:] = seen_steps - (joint / joint.sum(0)).sum(1)
        grad = grad / len(starts) - RIDGE * params
        grad[nothing] = 0.0
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        params = params + RATE * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
    crf.weights = {n: float(params[i]) for n, i in known.items() if abs(params[i]) >= LEAST_WEIGHT}
    crf.start, crf.steps = float(params[-5]), params[-4:].reshape(2, 2)
    return crf


def fit_score(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (y - p)) - 1e-2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    return w


def fit(docs: DataFrame, labels: DataFrame, held_out_folds: int = 5, text_col: str = "text", id_col: str = "doc_id",
        label_col: str = "toxic") -> Crf:
    """Fit on the labelled rows whose fold (crc32 of the id modulo ``held_out_folds``) is not 0."""
    usable = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col, held_out_folds) != 0))
              .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__toxic")))
    counts = {int(r["__toxic"]): r["n"] for r in usable.groupBy("__toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    sample = None
    for label in (0, 1):
        part = usable.where(F.col("__toxic") == label).orderBy(F.xxhash64("__id"), "__id").limit(TRAIN_DOCS)
        sample = part if sample is None else sample.unionByName(part)
    rows = (docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
            .where(F.length("__text") <= TRAIN_CHARS)
            .join(F.broadcast(sample), "__id")  # ≤ 2 · TRAIN_DOCS ids were sampled
            .groupBy("__id", "__toxic").agg(F.min("__text").alias("__text")).collect())  # one text of each, however many rows repeat it
    rows = distinct_texts([(r["__text"], int(r["__toxic"])) for r in sorted(rows, key=lambda r: (r["__id"], r["__text"]))])
    y = np.array([r[1] for r in rows], np.float64)
    if not 0 < y.sum() < len(y):
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Crf(doc=np.array([0.0, 0.0, 0.0, math.log(share / (1 - share)) if 0 < share < 1 else 700.0 * (2 * share - 1)]))
    texts = [r[0] for r in rows]
    crf = fit_crf(texts, y)
    p, sizes = marginals(crf, Emissions(crf.weights), texts)
    weight = np.where(y == 1, n1 / y.sum(), n0 / (len(y) - y.sum()))
    crf.doc = fit_score(evidence(p, sizes), y, weight * len(y) / weight.sum())
    return crf


def tag(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """All rows with score (0 to 1), predicted (1 from 0.5 on) and spans (array of start, stop)."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", span)]
    docs = docs.drop(*(f.name for f in added))
    schema = T.StructType([*docs.schema.fields, *added])
    keep = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        crf = shared.value
        emissions = Emissions(crf.weights)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                texts = b.column(b.num_columns - 1).to_pylist()
                p, sizes = marginals(crf, emissions, texts)
                score = sigmoid(evidence(p, sizes) @ crf.doc)
                spans, end = [], 0
                for text, n in zip(texts, sizes.tolist()):
                    own = p[end:end + n]
                    end += n
                    spans.append(spans_of(text, own) if n and own.max() >= 0.5 else [])
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i) for i in range(len(keep))), pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
                     pa.array(spans, span_type)], schema.fieldNames())

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    return tag(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted",
        F.size("spans").alias("n_spans"), F.col("spans"))
