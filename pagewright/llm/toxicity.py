"""Toxic spans by a linear-chain conditional random field over words.

Labels are of documents. Token labels are derived from them: markers (words, or beginnings of words
of MARKER code points) that occur almost only in toxic documents are chosen, first those that
can't be chance, then, if few documents are explained by those, greedily what explains most others; words with a marker are
labelled 1, and only inside toxic documents. The field has features of a word (itself, its beginnings and
endings) and of pairs of neighbouring labels; it is fitted by gradient steps on its exact
likelihood, with the marginals of tokens and of pairs of neighbours from forward-backward. Forward-backward marginals of whole texts give the offending words; a
document's score is a logistic function of its largest marginal and their sum.

The fit uses at most SAMPLE toxic and 2 * SAMPLE other documents, and of those longer than FIT_CHARS characters a stretch of that
length that begins at a place drawn by their key (documented bounds); scoring
reads every text whole. Words are runs of other than ASCII punctuation and white space, A-Z lower-cased.
A null or empty text has the score of a text without toxic words. Without labels of both kinds every score is 0.
Rows are scored one by one, so repeated or null keys are kept; rows of labels with a null key or label are
not used. Columns but key and text are not looked at.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C
from .decontam import _clean

SAMPLE, FIT_CHARS = 900, 12_000
MARKER = range(3, 9)
SPACE_BITS = 18
STEPS, RATE, SHRINK = 40, 0.5, 1.0
LIMIT = 0.3
KEPT = 500_000
#: Pieces of text that are stepped through together.
TOGETHER = 8


def beginnings(word: str) -> list[str]:
    return [word[:n] + "*" for n in MARKER if n < len(word)]


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in range(2, 8) if n < len(word)), *("$" + word[-n:] for n in range(2, 5) if n < len(word)), "1"]


def slots(word: str) -> list[int]:
    return [xxhash.xxh32_intdigest(f) & ((1 << SPACE_BITS) - 1) for f in features(word)]


def markers(toxic: list[list[str]], other: list[list[str]], least: int = 3) -> set[str]:
    """Words and beginnings that mark toxic documents, given as lists of words.

    Support is the number of documents, or of different pairs of neighbours if that is less, so copies add none. Chosen
    is what is too frequent in toxic documents, and too rare in others, to be chance among all candidates;
    then, if that leaves most documents unexplained, greedily what explains most of the rest.
    """
    where, around = defaultdict(set), defaultdict(set)
    for i, doc in enumerate(toxic):
        for k, w in enumerate(doc):
            pair = hash((doc[k - 1] if k else "", doc[k + 1] if k + 1 < len(doc) else ""))
            for f in (w, *beginnings(w)):
                where[f].add(i)
                around[f].add(pair)
    where = {f: at for f, at in where.items() if len(at) >= least and len(around[f]) >= least}
    seen = defaultdict(int)
    for doc in other:
        for f in {f for w in set(doc) for f in (w, *beginnings(w))} & where.keys():
            seen[f] += 1
    support = {f: min(len(at), len(around[f])) for f, at in where.items()}
    where = {f: at for f, at in where.items() if seen[f] <= 0.3 * (support[f] - 1.5 * support[f] ** 0.5)}
    here, there = sum(map(len, toxic)), sum(map(len, other))
    chance = np.log((here + there) / max(here, 1))
    chosen = {f for f in where if support[f] * chance >= np.log(len(where) + 1) + 5 and there}
    known = set().union(*(where[f] for f in chosen)) if chosen else set()
    if 2 * len(known) >= len(toxic):
        return chosen
    where = {g: at - known for g, at in where.items() if len(at - known) >= least and seen[g] <= 0.02 * support[g]}
    while where:
        f = max(where, key=lambda f: (len(where[f]), len(f), f))
        chosen.add(f)
        gone = where.pop(f)
        where = {g: at - gone for g, at in where.items() if len(at - gone) >= least}
    return chosen


def passes(e: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages of label 1 over 0 at each token of some chains, and exp(e); e: score of label 1 over 0; pairs: weights of (before, after).

    Chains are laid side by side, the longest first, and stepped through together. Messages stay within the gains times the largest
    quotient of two transitions.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    at, n = first[:-1][order], n[order]
    gain = np.exp(np.clip(e, -40, 40))
    (t00, t01), (t10, t11) = np.exp(pairs)
    ahead, behind = np.empty(len(e)), np.ones(len(e))
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(longest), "left")  # chains with more than t tokens
    r = None
    for t in range(longest):
        i = at[: active[t]] + t
        if t:
            r = r[: len(i)]
            r = gain[i] * (r * t11 + t01) / (r * t10 + t00)
        else:
            r = gain[i]
        ahead[i] = r
    for t in range(longest - 2, -1, -1):
        i = at[: active[t + 1]] + t
        x = gain[i + 1] * behind[i + 1]
        behind[i] = (x * t11 + t10) / (x * t01 + t00)
    return ahead, behind, gain


def marginals(e: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """P(label 1) of each token of some chains."""
    ahead, behind, _ = passes(e, first, pairs)
    x = ahead * behind
    return x / (1 + x)


def slopes(e: np.ndarray, first: np.ndarray, pairs: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the negative log-likelihood of labels by each e, and by each weight in pairs.

    Expected counts of a pair of labels come from the joint marginals of neighbours.
    """
    ahead, behind, gain = passes(e, first, pairs)
    x = ahead * behind
    inner = np.ones(len(e), bool)
    inner[first[:-1][first[:-1] < len(e)]] = False  # tokens with one before them in their chain
    b = np.flatnonzero(inner)
    left, right = np.stack([np.ones(len(b)), ahead[b - 1]]), np.stack([np.ones(len(b)), gain[b] * behind[b]])
    joint = left[:, None] * np.exp(pairs)[:, :, None] * right[None]
    expected = (joint / joint.sum((0, 1))).sum(2)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[b - 1].astype(int), label[b].astype(int)), 1)
    return x / (1 + x) - label, expected - seen


class Model:
    """Weights of features and of pairs of labels, and of the document's logistic function."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray, document: np.ndarray):
        self.weights, self.pairs, self.document = weights.astype(np.float32), pairs, document
        self._known: dict[int, float] = {}

    def emissions(self, p: C.Piece) -> np.ndarray:
        if not len(p.word_hash):
            return np.empty(0)
        u, one, back = np.unique(p.word_hash, return_index=True, return_inverse=True)
        known = self._known
        if len(known) > KEPT:
            known.clear()
        body = p.buf.tobytes()
        out = np.empty(len(u))
        for k, (h, i) in enumerate(zip(u.tolist(), one.tolist())):
            s = known.get(h)
            if s is None:
                word = body[p.starts[i] : p.ends[i]].decode("utf-8", "replace")
                s = known[h] = float(self.weights[slots(word)].sum())
            out[k] = s
        return out[back]

    def words(self, pieces: list[C.Piece]) -> list[np.ndarray]:
        """The marginals of the words of some pieces, whose texts are stepped through together."""
        e = np.concatenate([np.empty(0), *map(self.emissions, pieces)])
        begin = np.cumsum([0, *(p.word_of[-1] for p in pieces)])
        first = np.concatenate([*(p.word_of[:-1] + at for p, at in zip(pieces, begin)), begin[-1:]])
        return np.split(marginals(e, first, self.pairs), begin[1:-1])

    def scores(self, p: C.Piece, m: np.ndarray) -> np.ndarray:
        z = summaries(m, p.word_of) @ self.document
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def summaries(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each document: 1, the logit of its largest marginal, and the logarithm of 1 plus their sum over a tenth."""
    most = np.zeros(len(first) - 1)
    filled = np.flatnonzero(np.diff(first) > 0)
    if len(filled):
        most[filled] = np.maximum.reduceat(m, first[:-1][filled])
    sums = np.zeros(len(m) + 1)
    np.cumsum(np.where(m > 0.1, m, 0), out=sums[1:])
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(most)), np.log(most / (1 - most)), np.log1p(sums[first[1:]] - sums[first[:-1]])], 1)


def fit(texts: list[str], toxic: list[int], rate: float = 0.1) -> Model:
    """The field and the document's function, from labelled documents; rate: part of all that is toxic."""
    pieces = list(C.pieces(_clean(pa.array(texts, pa.string())), lower=True))
    words: dict[str, int] = {}
    one: dict[str, str] = {}  # equal words are one object
    token, lengths, docs = [], [], []
    for p in pieces:
        body = p.buf.tobytes()
        w = [one.setdefault(x, x) for x in (body[a:z].decode("utf-8", "replace") for a, z in zip(p.starts, p.ends))]
        token += [words.setdefault(x, len(words)) for x in w]
        lengths += np.diff(p.word_of).tolist()
        docs += [w[p.word_of[i] : p.word_of[i + 1]] for i in range(p.n)]
    y, token = np.array(toxic), np.array(token, np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    rank = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0))
    own = rank % 5 > 0  # the field is fitted on these, the document's function on the others
    if min(np.bincount(y[~own], minlength=2)) < 5:
        own[:] = True
    held = ~own if not own.all() else own
    chosen = markers([d for d, t, u in zip(docs, toxic, own) if t and u], [d for d, t, u in zip(docs, toxic, own) if not t and u])
    del docs, pieces, one
    marked = np.array([w in chosen or any(f in chosen for f in beginnings(w)) for w in words], bool)
    label = (marked[token] & (np.repeat(y, lengths) == 1)).astype(float)
    flat = [slots(w) for w in words]
    column = np.concatenate([np.array(f, np.int64) for f in flat]) if flat else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
    weights, pairs = np.zeros(1 << SPACE_BITS), np.array([[1.0, -1.0], [0.0, 0.0]])
    weights[xxhash.xxh32_intdigest("1") & ((1 << SPACE_BITS) - 1)] = -3.0
    use = np.repeat(own, lengths)
    chains = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64)[own])]).astype(np.int64)
    fitted, known = token[use], label[use]
    size = max(len(fitted), 1)
    seen = np.bincount(column, np.bincount(token, minlength=len(flat))[row], len(weights))
    speed, second = np.zeros_like(weights), np.full_like(pairs, 1e-8)
    for _ in range(STEPS):
        e = np.bincount(row, weights[column], len(flat))[fitted]
        each, both = slopes(e, chains, pairs, known)
        slope = np.bincount(column, np.bincount(fitted, each, len(flat))[row], len(weights)) + SHRINK * weights
        speed += slope**2
        weights -= RATE * slope / np.sqrt(speed + 1e-3) * (seen > 0)
        slope = both / size
        second += slope**2
        pairs -= 0.1 * slope / np.sqrt(second)
    e = np.bincount(row, weights[column], len(flat))[token]
    x, y = summaries(marginals(e, first, pairs), first)[held], y[held]
    share = np.where(y == 1, rate / max(y.mean(), 1e-9), (1 - rate) / max(1 - y.mean(), 1e-9))
    document = np.array([-1.0, 0.5, 0.5])
    for _ in range(2000):
        z = 1 / (1 + np.exp(-np.clip(x @ document, -30, 30)))
        document -= 0.05 * ((x * ((z - y) * share)[:, None]).mean(0) + 1e-3 * document)
    return Model(weights, pairs, document)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """A model from rows that `labels` covers; None unless both labels occur."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("_label"))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    ids = [known.where(F.col("_label") == v).orderBy(F.xxhash64(key)).limit(3 * sample * (2 - v)) for v in (0, 1)]  # a bounded number of keys
    ids = docs.sparkSession.createDataFrame(ids[0].unionByName(ids[1]).collect(), ids[0].schema)
    begin = F.pmod(F.xxhash64(key), F.greatest(F.char_length(text) - FIT_CHARS + 1, F.lit(1))).cast("int") + 1
    short = docs.where(F.col(text).isNotNull()).select(F.col(key), F.substring(F.col(text), begin, F.lit(FIT_CHARS)).alias("_text"))
    place = F.row_number().over(W.partitionBy("_label").orderBy(F.xxhash64(key), "_text"))
    found = short.join(F.broadcast(ids), key).withColumn("_place", place).where(F.col("_place") <= sample * (2 - F.col("_label"))).orderBy("_label", "_place").select("_text", "_label").collect()
    texts, toxic = [r[0] for r in found], [int(r[1]) for r in found]
    if len(set(toxic)) < 2:
        return None
    return fit(texts, toxic, min(0.5, max(0.01, counts[1] / sum(counts.values()))))


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """key, score, predicted, and spans (start, end: code points; p) of offending words of every row."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    def marked(column):
        """The pieces of a column with the marginals of their words."""
        pieces = C.pieces(_clean(column), lower=True)
        while some := list(itertools.islice(pieces, TOGETHER)):
            yield from zip(some, model.words(some) if model is not None else some)

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        for b in batches:
            for p, m in marked(b.column(1)):
                if model is None:
                    value, spans = np.zeros(p.n), [[]] * p.n
                else:
                    value, spans = model.scores(p, m), [[] for _ in range(p.n)]
                    hot = np.flatnonzero(m > 0.5)
                    if len(hot):
                        points = np.concatenate([[0], np.cumsum((p.buf & 0xC0) != 0x80)])
                        for w, i in zip(hot.tolist(), (np.searchsorted(p.word_of, hot, "right") - 1).tolist()):
                            base = points[p.off[i]]
                            spans[i].append({"start": int(points[p.starts[w]] - base), "end": int(points[p.ends[w]] - base), "p": float(m[w])})
                yield pa.RecordBatch.from_arrays([b.column(0).slice(p.first, p.n), pa.array(value, pa.float64()), pa.array((value >= limit).astype(np.int32), pa.int32()), pa.array(spans, span)], names=[key, "score", "predicted", "spans"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, score double, predicted int, spans array<struct<start:int,end:int,p:double>>")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs, labels.where(~held))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted", "spans")
