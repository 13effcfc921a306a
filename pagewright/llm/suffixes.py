"""Repeated passages by sparse suffix arrays.

A suffix is retained where its position is the minimiser (least hash of SEED words) of some
window of positions. Window and right context are chosen so that any passage of `length`
words holds a retained suffix with RIGHT more words inside the passage, and both occurrences
retain the same one. Suffixes are ordered by a hash of their right context, which stands for its words; a
batch settles first what several of its documents share and passes on one of them, so that no suffix is a hot key.
The rest is dealt to ranges of that order, sorted there, and each suffix is compared with its neighbours: equal
ones of two documents are matches. Then matches are extended: every stretch of `length`
words that reaches from a matched suffix to the left or right is compared by hash, and stretches that agree with the same
document and follow each other are joined. So the words are found that lie in a stretch of `length` words
which an earlier document (smaller doc_id) holds too; the first one keeps them.

Words are compared as they stand. Null and empty texts, and those shorter than `length`,
have no passage. Rows without doc_id are left alone; rows with the same doc_id count as one
document and don't repeat each other. Columns but key and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

LENGTH, SEED = 50, 5
#: Rows whose words are cut out at once.
ROWS = 1000


def retained(p: C.Piece, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the retained suffixes of a piece, and the hashes of their right contexts."""
    right = length // 2
    window, seed = length - right + 1, min(SEED, right)
    n = len(p.word_hash)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, C.U)
    text = p.text_of_word()
    start = np.flatnonzero(text[: n - length + 1] == text[length - 1 :])  # stretches within one text
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, C.U)
    h = C.grams(p.word_hash, seed)
    least = np.lib.stride_tricks.sliding_window_view(h, window).argmin(1)
    at = np.unique(start + least[start])
    return at, C.grams(p.word_hash, right)[at]


def neighbours(batches):
    """id and at of suffixes (suffix, id, at, matched; sorted) next to which an equal one of another document, or a matched one, lies.

    Rows of a run of equal suffixes are held back over batches while they are of one document.
    """
    tail, settled = None, None  # the unmatched run at the end so far; or its suffix, if it matches already
    for b in batches:
        if tail is not None:
            b = pa.Table.from_batches([tail, b]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        h = b.column(0).to_numpy()
        first = np.append(True, h[1:] != h[:-1])
        run = np.cumsum(first) - 1
        _, id_ = np.unique(b.column(1).to_numpy(zero_copy_only=False), return_inverse=True)
        other = (id_ != id_[first][run]) | b.column(3).to_numpy(zero_copy_only=False)
        several = np.zeros(run[-1] + 1, bool)
        several[run[other]] = True
        several[0] |= h[0] == settled
        tail, settled = (None, h[-1]) if several[-1] else (b.filter(pa.array(run == run[-1])), None)
        yield b.select(["id", "at"]).filter(pa.array(several[run]))


def repeated_spans(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, first (the document that keeps the words), start and end (word offsets) of repeated passages."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    named = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t"))

    def suffixes(batches):
        for b in batches:
            found = []
            for p in C.pieces(b.column(1)):
                at, h = retained(p, length)
                owner = np.searchsorted(p.word_of, at, "right") - 1
                found.append((h, owner + p.first, at - p.word_of[owner]))
            if not found:
                continue
            h, row, at = (np.concatenate(x) for x in zip(*found))
            _, id_ = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            order = np.lexsort((at, row, id_[row], h))
            h, row, at = h[order], row[order], at[order]
            first = np.append(True, h[1:] != h[:-1])[: len(h)]
            run = np.cumsum(first) - 1
            low = id_[row[first]]
            several = np.zeros(len(low), bool)
            several[run[id_[row] != low[run]]] = True
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64), pa.int64()), b.column(0).take(pa.array(row)), pa.array(at, pa.int32()), pa.array(several[run], pa.bool_()), pa.array(first | ~several[run], pa.bool_())], names=["suffix", "id", "at", "matched", "sent"])

    kept = C.written(named.mapInArrow(suffixes, f"suffix long, id {kind}, at int, matched boolean, sent boolean"), "suffixes")
    # one of those that a batch has matched goes on for the others of its suffix, in whatever batch
    ordered = kept.where("sent").select("suffix", "id", "at", "matched").repartition(F.expr("shiftright(suffix, 44)")).sortWithinPartitions("suffix", "id", "at")
    found = ordered.mapInArrow(neighbours, f"id {kind}, at int")
    matched = C.written(kept.where("matched").select("id", "at").unionByName(found).groupBy("id").agg(F.collect_set("at").alias("at")), "matches")

    def stretches(batches):
        for b in batches:
            marks, row = b.column(2), 0
            for p in C.pieces(b.column(1)):
                h = C.grams(p.word_hash, length)
                near = []
                for i in range(p.n):
                    a = np.array(marks[row].as_py(), np.int64)
                    row += 1
                    lo, hi = p.word_of[i], p.word_of[i + 1] - length + 1
                    if hi <= lo:
                        continue
                    cover = np.zeros(hi - lo + 1, np.int64)  # starts from which a stretch reaches over a mark
                    np.add.at(cover, np.clip(a - (length - length // 2), 0, hi - lo), 1)
                    np.add.at(cover, np.clip(a + 1, 0, hi - lo), -1)
                    near.append(lo + np.flatnonzero(np.cumsum(cover[:-1]) > 0))
                at = np.concatenate(near) if near else np.empty(0, np.int64)
                owner = np.searchsorted(p.word_of, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64) if len(at) else [], pa.int64()), b.column(0).take(pa.array(owner + p.first)), pa.array(at - p.word_of[owner], pa.int32())], names=["stretch", "id", "at"])

    held = named.join(matched, "id").select("id", "t", "at").mapInArrow(stretches, f"stretch long, id {kind}, at int")
    held = C.written(held, "stretches")
    first = held.groupBy("stretch").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("stretch", "first")
    again = held.join(first, "stretch").where("id <> first").groupBy("id", "first").agg(F.sort_array(F.collect_set("at")).alias("at"))

    def extend(batches):
        for b in batches:
            out = {"id": [], "start": [], "end": []}
            for i, at in enumerate(b.column(2).to_pylist()):
                a = np.array(at)
                cuts = np.flatnonzero(np.diff(a) > length) + 1
                for part in np.split(a, cuts):
                    out["id"].append(i)
                    out["start"].append(int(part[0]))
                    out["end"].append(int(part[-1]) + length)
            row = pa.array(out["id"], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(out["start"], pa.int32()), pa.array(out["end"], pa.int32())], names=[key, "first", "start", "end"])

    return again.mapInArrow(extend, f"{key} {kind}, first {kind}, start int, end int")


def without_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the words of their spans cut out of the text; a row of which no word is left goes.

    A column n_chars, if there is one, is set anew.
    """
    at, names = docs.columns.index(text), docs.columns
    cuts = spans.groupBy(key).agg(F.collect_list(F.struct("start", "end")))
    joined = docs.join(cuts.toDF(key, "".join(names) + "_"), key, "left").select(*names, "".join(names) + "_")

    def run(batches):
        for b in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            texts, gone = b.column(at).to_pylist(), []
            for i, cut in enumerate(b.column(len(names)).to_pylist()):
                if not cut:
                    continue
                data = texts[i].encode("utf-8")
                p = next(C.pieces(pa.array([texts[i]]), hashes=False))
                drop = np.zeros(len(p.starts) + 1, np.int64)
                for c in cut:
                    drop[c["start"]] += 1
                    drop[c["end"]] -= 1
                keep = np.cumsum(drop[:-1]) == 0
                if not keep.any():
                    gone.append(i)
                    continue
                ends = np.append(p.starts[1:], len(data))  # a word goes with the white space after it
                edges = np.flatnonzero(np.diff(np.concatenate([[0], keep, [0]])))
                parts = [data[p.starts[a] : ends[z - 1]] for a, z in zip(edges[::2], edges[1::2])]
                texts[i] = b"".join(parts).decode("utf-8").strip() if not keep[-1] else b"".join(parts).decode("utf-8")
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            out = pa.RecordBatch.from_arrays(columns, names=names)
            if gone:
                stay = np.ones(len(texts), bool)
                stay[gone] = False
                out = out.filter(pa.array(stay))
            yield out

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    out = joined.mapInArrow(run, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length(text).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*names)


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    return without_spans(docs, repeated_spans(docs, length, key, text), key, text)


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = repeated_spans(C.read(spark, sf_dir, "documents"))
    return s.select("doc_id", F.col("first").alias("first_doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).cast("long").alias("n_words"))


OP5_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS x FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, unnest(range(0, len(x) - {LENGTH} + 1)) AS i, unnest(list_transform(range(1, len(x) - {LENGTH} + 2), lambda j: md5(array_to_string(x[j:j + {LENGTH - 1}], ' ')))) AS h FROM w WHERE len(x) >= {LENGTH}),
f AS (SELECT h, min(doc_id) AS first_doc_id FROM s GROUP BY h HAVING min(doc_id) < max(doc_id)),
a AS (SELECT DISTINCT doc_id, first_doc_id, i FROM s JOIN f USING (h) WHERE doc_id <> first_doc_id),
g AS (SELECT *, sum(CASE WHEN i - coalesce(p, -1000000) > {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, first_doc_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id, first_doc_id ORDER BY i) AS p FROM a))
SELECT doc_id, first_doc_id, CAST(min(i) AS INTEGER) AS start_word, CAST(max(i) + {LENGTH} AS INTEGER) AS end_word, CAST(max(i) + {LENGTH} - min(i) AS BIGINT) AS n_words FROM g GROUP BY doc_id, first_doc_id, run
"""
