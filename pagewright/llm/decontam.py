"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose 7 of up to 12 word positions; a hash of the chosen words is equal even if
ignored ones were replaced. Every stretch that the verification accepts holds all chosen words of some mask
somewhere, so none is missed. Items and documents are hashed under every mask. A bitmap of
fixed size over the items' hashes, which is shipped to every task, lets pass few other hashes; what
passes is joined with the items' hashes, and each (document, item, offset) that they meet at is
verified word by word: the longest stretch in which at least SHARE percent of the words
are equal, beginning and ending with an equal word. A document is contaminated by an item
if that stretch has MIN_WORDS words, or for a shorter item if it covers the item. Items of fewer
words than MIN_WORDS have masks of their own length, which leave out what may be replaced.

Words are runs of other than ASCII punctuation and white space in the lower-cased text. Null or
empty texts and items have no words and meet nothing. Rows without doc_id aren't reported;
rows with equal doc_id are reported once for all; for rows with equal item_id likewise.
Columns but keys and texts are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Every row of 12 or more words with at least SHARE percent equal holds the ones of one of these, whatever words differ.
MASKS = ("110101111", "111100010011", "11101100101", "100001110111", "1111100101", "110101000111", "111011011")
#: Masks of items of fewer words: for each choice of words that may differ (the ends must not) one that leaves them out.
SHORT = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("10111", "11011", "11101"),
    6: ("101111", "110111", "111011", "111101"),
    7: ("1011111", "1101111", "1110111", "1111011", "1111101"),
    8: ("10101111", "11011011", "11110101"),
    9: ("101111011", "110111101", "111001111", "111010111"),
    10: ("1000111111", "1010101111", "1011010111", "1011111001", "1100111101", "1101010111", "1101101011", "1110011011", "1110100111", "1111001101", "1111110001"),
    11: ("10011011101", "10101010111", "10110011011", "10111000111", "11001101011", "11010110011", "11100110101", "11110101001"),
}
MIN_WORDS, SHARE = 12, 80
#: Bits of the bitmap: 2 MB whatever the benchmark's size; a large benchmark only lets more pass.
BITS = 24
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


def _clean(text: pa.Array) -> pa.Array:
    """The texts with every ASCII byte but letters and digits as a blank."""
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    if text.null_count:
        text = text.fill_null("")
    if not len(text):
        return text
    _, offsets, data = text.buffers()
    body = _TABLE[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.empty(0, np.uint8)
    return pa.StringArray.from_buffers(len(text), offsets, pa.py_buffer(body), None, 0, text.offset)


def seeds(p: C.Piece, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a mask lies within one text, and the hashes of the words it chooses there."""
    span, n = len(mask), len(p.word_hash)
    if n < span:
        return np.empty(0, np.int64), np.empty(0, C.U)
    text = p.text_of_word()
    at = np.flatnonzero(text[: n - span + 1] == text[span - 1 :])
    h = np.full(n - span + 1, C._STEP[(sum(1 << i for i, c in enumerate(mask) if c == "1") + span) % 64] + C.U(sum(1 << i for i, c in enumerate(mask) if c == "1")), C.U)
    for i, c in enumerate(mask):
        if c == "1":
            h += p.word_hash[i : i + n - span + 1] * C._STEP[i]
    return at, C.mix(h[at])


def stretch(equal: np.ndarray, share: int = SHARE) -> tuple[int, int]:
    """(start, end) of the longest stretch with at least share percent equal that begins and ends with an equal one."""
    score = np.concatenate([[0], np.cumsum(np.where(equal, 100 - share, -share))])
    ends = np.where(equal, score[1:], -(len(equal) + 1) * 100)
    high = np.maximum.accumulate(ends[::-1])[::-1]
    n, best, at, j = len(equal), 0, (0, 0), 0
    for i in np.flatnonzero(equal).tolist():
        j = max(j, i)
        while j < n and high[j] >= score[i]:
            j += 1
        if j - i > best:
            best, at = j - i, (i, j)
    return at


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item_key, n_words and n_equal of the longest overlap, and where it starts in both (word offsets)."""
    kind, item_kind = docs.select(key).schema[0].dataType.simpleString(), items.select(item_key).schema[0].dataType.simpleString()
    named = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item"), F.lower(F.col(item_text)).alias("t"))

    def lengths(batches):
        for b in batches:
            for p in C.pieces(_clean(b.column(0)), hashes=False):
                n = np.unique(np.diff(p.word_of))
                yield pa.RecordBatch.from_arrays([pa.array(n[(n > 0) & (n < MIN_WORDS)], pa.int32())], names=["n"])

    shorter = sorted(r.n for r in named.select("t").mapInArrow(lengths, "n int").distinct().collect())  # fewer than MIN_WORDS rows
    masks = [(m, 0) for m in MASKS] + [(m, n) for n in shorter for m in SHORT[n]]  # 0: of items of MIN_WORDS and more
    asked = sorted({m for m, _ in masks})

    def of_items(batches):
        for b in batches:
            for p in C.pieces(_clean(b.column(1))):
                size = np.diff(p.word_of)
                for m, n in masks:
                    at, h = seeds(p, m)
                    owner = np.searchsorted(p.word_of, at, "right") - 1
                    ok = size[owner] == n if n else size[owner] >= MIN_WORDS
                    at, h, owner = at[ok], h[ok], owner[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64), pa.int64()), b.column(0).take(pa.array(owner + p.first)), pa.array(at - p.word_of[owner], pa.int32())], names=["seed", "item", "item_at"])

    planted = C.written(named.mapInArrow(of_items, f"seed long, item {item_kind}, item_at int"), "seeds")
    both = F.expr(f"array(shiftrightunsigned(seed, {64 - BITS}), (seed & {(1 << BITS) - 1}) + {1 << BITS})")
    bits = planted.select(F.explode(both).alias("bit")).groupBy(F.expr("cast(bit >> 6 AS int)").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("bits")).toArrow()
    cells = np.zeros(2 << (BITS - 6), np.int64)  # at most as many rows came
    cells[bits.column("cell").to_numpy()] = bits.column("bits").to_numpy()
    bitmap = cells.view(C.U)

    def passes(h):
        a, b = h >> C.U(64 - BITS), (h & C.U((1 << BITS) - 1)) + C.U(1 << BITS)
        one = bitmap[(a >> C.U(6)).astype(np.int64)] >> (a & C.U(63))
        return np.flatnonzero(one & (bitmap[(b >> C.U(6)).astype(np.int64)] >> (b & C.U(63))) & C.U(1))

    def of_docs(batches):
        for b in batches:
            for p in C.pieces(_clean(b.column(1))):
                found = []
                for m in asked:
                    at, h = seeds(p, m)
                    ok = passes(h)
                    found.append((at[ok], h[ok]))
                at, h = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                owner = np.searchsorted(p.word_of, at, "right") - 1
                order = np.argsort(owner, kind="stable")
                at, h, owner = at[order], h[order], owner[order]
                who, cut = np.unique(owner, return_index=True)
                ends = np.append(cut[1:], len(owner))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(who + p.first)),
                        pa.array([p.word_hash[p.word_of[i] : p.word_of[i + 1]].tobytes() for i in who], pa.binary()),
                        pa.array([h[x:y].view(np.int64) for x, y in zip(cut, ends)], pa.list_(pa.int64())),
                        pa.array([(at[x:y] - p.word_of[i]).astype(np.int32) for i, x, y in zip(who, cut, ends)], pa.list_(pa.int32())),
                    ],
                    names=["id", "words", "seeds", "places"],
                )

    source = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.lower(F.col(text)).alias("t"))
    hits = C.written(source.mapInArrow(of_docs, f"id {kind}, words binary, seeds array<long>, places array<int>"), "hits")
    each = hits.select("id", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("id", F.col("h.seeds").alias("seed"), F.col("h.places").alias("at"))
    met = each.join(planted, "seed").select("id", "item", (F.col("at") - F.col("item_at")).alias("offset")).distinct()

    def item_words(batches):
        for b in batches:
            for p in C.pieces(_clean(b.column(1))):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(p.first, p.n), pa.array([p.word_hash[p.word_of[i] : p.word_of[i + 1]].tobytes() for i in range(p.n)], pa.binary())], names=["item", "item_words"])

    spoken = named.mapInArrow(item_words, f"item {item_kind}, item_words binary").groupBy("item").agg(F.collect_set("item_words").alias("item_words"))
    grouped = met.groupBy("id", "item").agg(F.sort_array(F.collect_set("offset")).alias("offsets")).join(spoken, "item").groupBy("id").agg(F.collect_list(F.struct("item", "offsets", "item_words")).alias("met"))
    ready = grouped.join(hits.select("id", "words"), "id")

    def verify(batches):
        for b in batches:
            rows = []
            for i, (data, met) in enumerate(zip(b.column(2).to_pylist(), b.column(1).to_pylist())):
                doc = np.frombuffer(data, C.U)
                for m in met:
                    best = None
                    for words in m["item_words"]:
                        item = np.frombuffer(words, C.U)
                        for o in m["offsets"]:
                            lo, hi = max(0, -o), min(len(item), len(doc) - o)
                            if hi <= lo:
                                continue
                            equal = doc[lo + o : hi + o] == item[lo:hi]
                            a, z = stretch(equal)
                            if z - a >= min(MIN_WORDS, len(item)):
                                best = max(best or (0,), (z - a, int(equal[a:z].sum()), -(lo + o + a), -(lo + a)))
                    if best:
                        rows.append((i, m["item"], best[0], best[1], -best[2], -best[3]))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([r[1] for r in rows], b.column(1).type.value_type.field("item").type), *(pa.array([r[k] for r in rows], pa.int32()) for k in (2, 3, 4, 5))], names=[key, item_key, "n_words", "n_equal", "doc_start", "item_start"])

    out = ready.mapInArrow(verify, f"{key} {kind}, {item_key} {item_kind}, n_words int, n_equal int, doc_start int, item_start int")
    return out.groupBy(key, item_key).agg(F.max(F.struct("n_words", "n_equal", "doc_start", "item_start")).alias("best")).select(key, item_key, "best.*")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that an item contaminates; rows without key stay."""
    bad = contaminated(docs, items, key, text).select(key).distinct()
    return docs.join(C.written(bad, "contaminated"), key, "left_anti").select(*docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))
