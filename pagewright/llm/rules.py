"""Quality rules, and an isolation forest over their statistics.

Rule statistics of a whole text come from one vectorised pass. The forest isolates rows
by random splits of the statistics' ratios; a short mean path marks an anomaly. It is fitted on
at most SAMPLE rows labelled good (a documented bound); the threshold comes from
the scores of all labelled rows: the lowest at which at most MAX_LOSS of the rows labelled
good fall above it. Without labelled rows nothing is anomalous.

A null or empty text has no words, so it fails the base rules. Null or repeated doc_ids
are scored row by row; columns beyond the key and the text are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 8
SAMPLE = 2048
MAX_LOSS = 0.004
TREES, LEAF_ROWS = 128, 256
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
#: The symbols that the rules count.
SYMBOLS = b"#*$%&|<>"
_SYMBOL, _UPPER, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER[65:91] = True
_MARK[list(b"!?|#$%&*<>{}[]=+_\\^~@")] = True


def _by_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    return C.per_text(mask, off)


def statistics(p: C.Piece) -> dict[str, np.ndarray]:
    """COUNTS of every text of a piece."""
    text = p.text_of_word()
    inside = ~C._SPACE[p.buf]
    out = {
        "n_words": np.diff(p.word_of),
        "word_chars": _by_text(inside & ((p.buf & 0xC0) != 0x80), p.off),
        "n_symbols": _by_text(_SYMBOL[p.buf], p.off),
        "n_upper": _by_text(_UPPER[p.buf], p.off),
        "n_marks": _by_text(_MARK[p.buf], p.off),
    }
    # words in repeated windows
    repeated = np.zeros(len(text) + 1, np.int64)
    h = C.grams(p.word_hash, WINDOW)
    if len(h):
        whole = np.flatnonzero(text[: len(h)] == text[WINDOW - 1 :])
        key = C.mix(h[whole] + text[whole].astype(C.U) * C._STEP[1])
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        at = whole[n[back] > 1]
        np.add.at(repeated, at, 1)
        np.add.at(repeated, np.minimum(at + WINDOW, len(text)), -1)
    out["n_repeat_words"] = C.per_text(np.cumsum(repeated[:-1]) > 0, p.word_of)
    # lines with a word that are equal to an earlier line
    brk = p.buf == 10
    first = np.zeros(len(p.buf) + 1, bool)
    first[1:] = brk
    first[p.off[:-1]] = True
    begins = np.flatnonzero(first[: len(p.buf)])
    ends = np.append(begins[1:], len(p.buf)) if len(begins) else begins
    ends = ends - ((ends > 0) & (ends <= len(p.buf)) & (ends > begins) & brk[np.maximum(ends - 1, 0)]) if len(begins) else ends
    c = np.zeros(len(p.buf) + 1, np.int64)
    np.cumsum(inside, out=c[1:])
    worded = c[ends] > c[begins] if len(begins) else np.zeros(0, bool)
    line_text = np.searchsorted(p.off, begins, "right") - 1
    out["n_lines"] = np.bincount(line_text[worded], minlength=p.n)[: p.n]
    key = C.mix(p.spans(begins[worded], ends[worded]) + line_text[worded].astype(C.U) * C._STEP[2]) if worded.any() else np.empty(0, C.U)
    _, one = np.unique(key, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_text[worded][one], minlength=p.n)[: p.n]
    return out


def rule_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and COUNTS of every row; one pass, no shuffle."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        for b in batches:
            parts = [statistics(p) for p in C.pieces(b.column(1))]
            if parts:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.concatenate([x[c] for x in parts]), pa.int64()) for c in COUNTS)], names=[key, *COUNTS])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def ratios(x: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest splits on: logarithms of ratios, so that large values don't stretch the range of splits."""
    n, chars = np.maximum(x["n_words"], 1), np.maximum(x["word_chars"], 1)
    return np.log1p(100 * np.stack([x["n_symbols"] / n, x["n_marks"] / n, x["n_dup_lines"] / np.maximum(x["n_lines"], 1), x["n_repeat_words"] / n, x["n_upper"] / chars], axis=1))


class Forest:
    """Isolation trees as flat arrays; every tree has seen at most LEAF_ROWS rows."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, size: int = LEAF_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = min(size, len(rows))
        self.depth = max(1, math.ceil(math.log2(max(size, 2))))
        self.norm = self._unsplit(size)
        nodes = [self._grow(rows[rng.choice(len(rows), size, replace=False)], rng) for _ in range(trees)]
        wide = max(map(len, nodes))
        grid = np.zeros((trees, wide, 4))
        for i, t in enumerate(nodes):
            grid[i, : len(t)] = t
        self.feature, self.child = grid[..., 0].astype(np.int16), grid[..., 2].astype(np.int32)
        self.at, self.path = grid[..., 1], grid[..., 3]

    @staticmethod
    def _unsplit(n: int) -> float:
        """Mean path length of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows, rng):
        nodes = [[0, 0.0, 0, 0.0]]
        work = [(0, rows, 0)]
        while work:
            at, x, depth = work.pop()
            low, high = (x.min(0), x.max(0)) if len(x) else (np.zeros(1), np.zeros(1))
            open_ = np.flatnonzero(high > low)
            if depth >= self.depth or len(x) < 2:
                nodes[at] = [-1, 0.0, at, depth + self._unsplit(len(x))]
                continue
            if len(open_):
                f = int(rng.choice(open_))
                cut = rng.uniform(low[f], high[f])
            else:  # rows that are all alike: a cut above them parts off what no row has shown
                f = int(rng.integers(len(high)))
                cut = high[f] + rng.uniform(0, 1)
            left = len(nodes)
            nodes += [[0, 0.0, 0, 0.0], [0, 0.0, 0, 0.0]]
            nodes[at] = [f, cut, left, 0.0]
            mask = x[:, f] < cut
            work += [(left, x[mask], depth + 1), (left + 1, x[~mask], depth + 1)]
        return np.array(nodes)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly of each row, from 0 to 1."""
        total = np.zeros(len(rows))
        i = np.arange(len(rows))
        for t in range(len(self.at)):
            node = np.zeros(len(rows), np.int32)
            for _ in range(self.depth + 1):
                f = self.feature[t, node]
                inner = f >= 0
                node = np.where(inner, self.child[t, node] + (rows[i, np.maximum(f, 0)] >= self.at[t, node]), node)
            total += self.path[t, node]
        return 2.0 ** (-total / len(self.at) / max(self.norm, 1e-9))


BINS = 2000


def rule_verdicts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, max_loss: float = MAX_LOSS) -> DataFrame:
    """key, the five counts, base_failed, anomaly_score and kept of every row.

    Statistics are computed once and checkpointed; only they, not the texts, meet the labels.
    """
    stats = C.cut(rule_statistics(docs, key, text))
    known = stats.join(labels.select(F.col(key), F.col(label).alias("_label")).where(F.col("_label").isin(0, 1)).groupBy(key).agg(F.max("_label").alias("_label")), key)
    good = known.where((F.col("_label") == 1) & (F.col("n_words") > 0)).orderBy(F.xxhash64(key), key).limit(sample).select(*COUNTS).collect()
    kinds = dict(stats.dtypes)
    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", anomaly_score double"
    if len(good) < 2:
        scored, threshold = stats.withColumn("anomaly_score", F.lit(0.0)), 1.0
    else:
        forest = Forest(ratios({c: np.array([r[c] for r in good], float) for c in COUNTS}))

        def run(batches):
            for b in batches:
                x = ratios({c: b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in COUNTS})
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.score(x), pa.float64())], names=[*b.schema.names, "anomaly_score"])

        scored = stats.mapInArrow(run, schema)
        at = C.cut(known.mapInArrow(run, schema.replace(", anomaly_score", ", _label int, anomaly_score")).groupBy(F.floor(F.col("anomaly_score") * BINS).cast("int").alias("bin")).agg(F.count_if(F.col("_label") == 1).alias("good")))
        counts = {r.bin: r.good for r in at.collect()}  # one row for each of BINS bins at most
        allowed, threshold = max_loss * sum(counts.values()), 1.0
        for b in sorted(counts, reverse=True):
            allowed -= counts[b]
            if allowed < 0:
                break
            threshold = b / BINS
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("anomaly_score") < threshold)).alias("kept"), "anomaly_score",
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_verdicts(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))
