"""Quality by an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Texts are dealt to blocks of bounded size, compressed in bundles. A block gives the distinct
n-grams (ORDER characters, each text led by ORDER - 1 marks) of its texts and their counts in
trusted ones, so what is moved grows with the texts but not with their repetitions.
Counts are summed over blocks; continuation counts, discounts and context sums of
every order are group-bys over them; probabilities of all n-grams that occur come from joins with the
tables of each order, sharded by n-gram. Each block then gets the n-grams it asked for
and sums their logarithms over each text.

Trusted are the rows that `labels` calls good; one fifth of them (by a hash of the key) isn't
trained on, and its perplexities give each language's threshold, the QUANTILE of them.
A language with fewer than FEW such rows takes the highest of that, of the QUANTILE of all its trusted rows and of the
quantile over all languages, so it is never held below what its own trusted rows show; without any trusted rows its
threshold is infinite.

A null or empty text has no perplexity and is not kept. A null key is never trusted; rows with
equal keys share their label. A null language counts as ''. Columns but key, text and lang are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ORDER, QUANTILE, FEW = 4, 0.995, 20
BLOCK_MB = 48.0
#: Languages up to which their thresholds are broadcast; more are joined by language.
FEW_LANGUAGES = 10_000
#: Characters that are turned into arrays at once; a longer single text goes alone.
CHUNK = 1 << 18
#: Rows and bytes of text that a task puts into bundles together; distinct n-grams of chunks that are merged at once; n-grams that are turned to text at once.
BUNDLE_ROWS, BUNDLE, MERGE, SLICE = 10_000, 24 << 20, 1 << 17, 1 << 16
START = "\x02"


def _place(key: str, text: str, blocks: int):
    return F.pmod(F.coalesce(F.xxhash64(F.col(key)), F.lit(0)) if text is None else F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)), F.lit(blocks)).cast("int")


def bundles(docs: DataFrame, key: str, text: str, lang: str, blocks: int) -> DataFrame:
    """block, keys, langs and the compressed texts of some rows; several bundles for a block."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    rows = docs.select(_place(key, text, blocks).alias("block"), F.col(key), F.coalesce(F.col(lang), F.lit("")), F.coalesce(F.col(text), F.lit("")))

    def run(batches):
        pack = zstandard.ZstdCompressor(level=9)
        held: dict[int, tuple[list, list, list]] = {}  # keys, langs and texts of each block
        rows = size = 0

        def bundled(key_type: pa.DataType) -> pa.RecordBatch:
            out = [[], [], [], [], []]
            for block in sorted(held):
                keys, langs, data = held.pop(block)
                out[0].append(block)
                out[1].append(keys)
                out[2].append(langs)
                out[3].append([len(d) for d in data])
                out[4].append(pack.compress(b"".join(data)))
            C.release()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.list_(key_type)), pa.array(out[2], pa.list_(pa.string())), pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.binary())], names=["block", "keys", "langs", "sizes", "texts"])

        for b in batches:
            for block, *row, t in zip(*(c.to_pylist() for c in b.columns)):
                data = t.encode("utf-8", "surrogatepass")
                for column, x in zip(held.setdefault(block, ([], [], [])), (*row, data)):
                    column.append(x)
                rows, size = rows + 1, size + len(data)
                if rows >= BUNDLE_ROWS or size >= BUNDLE:
                    yield bundled(b.column(1).type)
                    rows = size = 0
        if held:
            yield bundled(b.column(1).type)

    return rows.mapInArrow(run, f"block int, keys array<{kind}>, langs array<string>, sizes array<int>, texts binary")


def _chunks(t: pa.Table):
    """(keys, langs, code points led by marks, first position of each text and the end) of about CHUNK characters."""
    unpack = zstandard.ZstdDecompressor()
    for bundle in range(t.num_rows):
        keys, langs, sizes = (t.column(c)[bundle].as_py() for c in ("keys", "langs", "sizes"))
        data, at, i = unpack.decompress(t.column("texts")[bundle].as_buffer()), 0, 0
        while i < len(keys):
            j, size = i, 0
            while j < len(keys) and (j == i or size + sizes[j] <= CHUNK):
                size += sizes[j]
                j += 1
            parts, first = [], [0]
            for k in range(i, j):
                s = np.frombuffer(data[at : at + sizes[k]].decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
                at += sizes[k]
                parts += [np.full(ORDER - 1, ord(START), np.uint32), s]
                first.append(first[-1] + ORDER - 1 + len(s))
            yield keys[i:j], langs[i:j], np.concatenate(parts), np.array(first)
            i = j


def _keys(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The position at which each n-gram begins, and its hash."""
    n = len(points) - ORDER + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, C.U)
    h = np.zeros(n, C.U)
    for j in range(ORDER):
        h += points[j : j + n].astype(C.U) * C._STEP[j]
    inside = np.ones(n, bool)
    for j in range(1, ORDER):
        at = first[1:-1] - j
        inside[at[at >= 0]] = False
    at = np.flatnonzero(inside)
    return at, C.mix(h[at])


def _counted(t: pa.Table, trusted: pa.Table) -> pa.Table:
    """block, key, gram and count (in trusted texts) of the distinct n-grams of a block."""
    C.release()
    good = set(trusted.column("key").to_pylist()) - {None}
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merge():
        key, count, text = (np.concatenate([s[i] for s in seen]) for i in range(3))
        u, one, back = np.unique(key, return_index=True, return_inverse=True)
        seen[:] = [(u, np.bincount(back, count, len(u)).astype(np.int64), text[one])]

    for keys, _, points, first in _chunks(t):
        at, h = _keys(points, first)
        use = np.array([k in good for k in keys], bool)
        counted = np.repeat(use, np.maximum(np.diff(first) - ORDER + 1, 0))
        u, one, n = np.unique(h, return_index=True, return_counts=True)
        if counted.any() and not counted.all():
            n = np.bincount(np.searchsorted(u, h[counted]), minlength=len(u))
        elif not counted.any():
            n = np.zeros(len(u), np.int64)
        grams = np.stack([points[at[one] + j] for j in range(ORDER)], 1) if len(u) else np.empty((0, ORDER), np.uint32)
        seen.append((u, n, grams))
        if sum(len(s[0]) for s in seen[1:]) >= max(MERGE, len(seen[0][0]) // 2):
            merge()
    if not seen:
        return pa.table({"block": pa.array([], pa.int32()), "key": pa.array([], pa.int64()), "gram": pa.array([], pa.string()), "count": pa.array([], pa.int64())})
    merge()
    key, count, grams = seen[0]
    flat = np.ascontiguousarray(grams.astype("<u4"))
    text = flat.tobytes().decode("utf-32-le", "surrogatepass")
    text = pa.chunked_array([pa.array([text[i : i + ORDER] for i in range(at, min(at + ORDER * SLICE, len(text)), ORDER)], pa.string()) for at in range(0, len(text), ORDER * SLICE)], pa.string())
    block = t.column("block")[0].as_py() if t.num_rows else 0
    return pa.table({"block": pa.array(np.full(len(key), block), pa.int32()), "key": pa.array(key.view(np.int64), pa.int64()), "gram": text, "count": pa.array(count, pa.int64())})


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from how many n-grams have count 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    d = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))


def probabilities(asked: DataFrame, grams: DataFrame) -> DataFrame:
    """asked (gram) with p, the interpolated probability of its last character after the others; grams (gram, count): the model.

    Orders go from one character up. An order's table holds its n-grams with their counts (from
    the second highest on: of distinct left neighbours) and, by context, the sum of counts and
    the mass that discounts leave for the next lower order.
    """
    tables = {ORDER: grams.select("gram", "count")}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("count"))
    kinds = tables[1].count()
    out = asked.withColumn("p", F.lit(1.0 / (kinds + 1)))
    for k in range(1, ORDER + 1):
        t = tables[k]
        n = t.agg(*[F.count_if(F.col("count") == i) for i in (1, 2, 3, 4)]).first()
        d = discounts(*n)
        cut = F.when(F.col("count") == 1, d[0]).when(F.col("count") == 2, d[1]).otherwise(d[2])
        t = t.withColumn("_d", cut)
        context = t.groupBy(F.substring("gram", 1, k - 1).alias("_h")).agg(F.sum("count").alias("_t"), F.sum("_d").alias("_left"))
        at = ORDER - k + 1
        out = out.join(t.select(F.col("gram").alias("_g"), (F.col("count") - F.col("_d")).alias("_c")), F.substring("gram", at, k) == F.col("_g"), "left").drop("_g")
        out = out.join(context, F.substring("gram", at, k - 1) == F.col("_h"), "left").drop("_h")
        p = F.when(F.col("_t").isNull(), F.col("p")).otherwise(F.coalesce(F.col("_c"), F.lit(0.0)) / F.col("_t") + F.col("_left") / F.col("_t") * F.col("p"))
        out = out.withColumn("p", p).drop("_c", "_t", "_left")
    return out


def perplexities(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, lang, n_chars and perplexity (null without characters) of every row; trusted: the keys to train on."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    blocks = C.blocks_for(docs, text, BLOCK_MB)
    bundled = C.written(bundles(docs, key, text, lang, blocks), "bundles")
    named = trusted.select(_place(key, None, blocks).alias("block"), F.col(key).alias("key")).where("key IS NOT NULL")
    asked = C.written(bundled.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(_counted, "block int, key long, gram string, count long"), "grams")
    sums = C.cut(asked.groupBy("key", "gram").agg(F.sum("count").alias("count")))
    known = C.written(probabilities(sums.select("key", "gram"), sums.where("count > 0")).select("key", F.log("p").cast("float").alias("logp")), "logp")
    answers = asked.select("block", "key").join(known, "key").select("block", "key", "logp")

    def score(t: pa.Table, a: pa.Table) -> pa.Table:
        C.release()
        h = a.column("key").to_numpy().view(C.U)
        order = np.argsort(h)
        h, logp = h[order], a.column("logp").to_numpy()[order].astype(np.float64)
        out = [[], [], [], []]
        for keys, langs, points, first in _chunks(t):
            n = np.maximum(np.diff(first) - ORDER + 1, 0)
            sums = np.zeros(int(n.sum()) + 1)
            _, g = _keys(points, first)
            np.cumsum(logp[np.searchsorted(h, g)] if len(g) else [], out=sums[1:])
            end = np.cumsum(n)
            total = sums[end] - sums[end - n]
            out[0] += keys
            out[1] += langs
            out[2] += n.tolist()
            out[3] += [float(np.exp(-s / m)) if m else None for s, m in zip(total, n)]
        return pa.table({key: pa.array(out[0], t.schema.field("keys").type.value_type), "lang": pa.array(out[1], pa.string()), "n_chars": pa.array(out[2], pa.int64()), "perplexity": pa.array(out[3], pa.float64())})

    return bundled.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"{key} {kind}, lang string, n_chars long, perplexity double")


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality", quantile: float = QUANTILE) -> DataFrame:
    """key, lang, n_chars, perplexity, threshold and kept of every row."""
    good = labels.where((F.col(label) == 1) & F.col(key).isNotNull()).select(key).distinct()
    held = F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 0
    with C.small_batches(docs.sparkSession):
        scored = C.written(perplexities(docs, good.where(~held), key, text, lang), "perplexity")
    sample = scored.join(good.withColumn("_held", held), key).where("perplexity IS NOT NULL")
    at = lambda x: F.percentile_approx(x, quantile, 10000)
    by = sample.groupBy(F.col("lang").alias("_lang")).agg(at(F.when(F.col("_held"), F.col("perplexity"))).alias("_own"), F.count_if("_held").alias("_n"), at("perplexity").alias("_all"))
    by = C.cut(by)
    if by.count() <= FEW_LANGUAGES:
        by = F.broadcast(by)
    every = sample.where("_held").agg(at("perplexity")).first()[0]
    few = F.greatest("_own", "_all", F.lit(float("inf") if every is None else float(every)))
    threshold = F.when(F.col("_lang").isNull(), F.lit(float("inf"))).when(F.col("_n") >= FEW, F.col("_own")).otherwise(few)
    out = scored.join(by, F.col("lang") == F.col("_lang"), "left").withColumn("threshold", threshold)
    return out.select(key, "lang", "n_chars", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without those that are judged and not kept; rows without key stay."""
    bad = judged(docs, labels, key, text, lang).where(~F.col("kept") & F.col(key).isNotNull()).select(key).distinct()
    return docs.join(C.written(bad, "rejected"), key, "left_anti").select(*docs.columns)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))
