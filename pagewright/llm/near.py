"""Near-duplicate groups by an exact Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct k-word shingles. Documents with equal
sets form one class; the join is over classes, so copies never meet each other. Steps:

1. Texts are shingled once; sets are written to the shared folder and read from there.
2. Shingles of a class are ordered, rarest first, by a count sketch of fixed size. Two classes
   that link share at least l of the first n - ceil(t n) + l of each, for every l. Each class
   has an l of its own: a longer prefix costs postings, a shorter one candidates, and what
   both cost is estimated from the sketch. A pair has to share as many tokens of both
   prefixes as the smaller of its two l says, and so many that with all that can follow the last one
   the two sets would still link.
3. Tokens of a prefix that no other prefix holds, and classes with fewer than l others, are left out.
   The postings of the rest are joined by token. Every token's list first meets only its
   pivot, the class of the list whose prefix has most shared tokens; pairs that reach their l are verified
   over the whole sets, and classes that link with a pivot take its label. Then the classes of a list that have different
   labels are compared by their prefixes, in groups and tiles of bounded size, and pairs that reach their l are
   verified. So members of a cluster meet its pivot, and no pair of different labels is left out.
4. Labels that a link joins form components.

All tables of the join grow with the documents, so it asks for merge joins: its plan is the same at every size.

Every pair at or over the threshold is found or joined through others: the filters are exact bounds. A null or empty
text has an empty set and is linked with nothing. Repeated doc_ids share the fate of the row they
repeat if the texts agree, else each row is its own node with the same id. A null doc_id has
a component only if its class holds a doc_id. Columns but the key and the text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .graph import components

#: Tokens that a task takes together when it counts repeats.
UNIT = 250_000
#: Rows of a group of lists; rows of a tile of a longer list; pairs of rows that are compared at once.
ROWS, TILE, PAIRS = 20_000, 2048, 10_000
#: Tokens of a prefix that a row of a list brings with it, and how many of them come before its own.
AROUND, BEFORE = 12, 3
#: Values of l that are tried.
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16)
#: What a candidate costs, in postings: its pair is moved twice, then a signature, and for some a whole set.
VERIFY = 16.0
SKETCH_BITS = 18
BITMAP_BITS = 24
#: Classes that a task remembers, so that it gives the set of a class once among so many.
SEEN = 10_000


def sets(p: C.Piece, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts, sorted within each; the first token of each text, and the end; a hash of each set, 0 if empty."""
    text = p.text_of_word()
    n = np.diff(p.word_of)
    g = C.grams(p.word_hash, k)
    whole = np.flatnonzero(text[: len(g)] == text[k - 1 :]) if len(g) else np.empty(0, np.int64)
    token, owner = g[whole], text[whole]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        at = p.word_of[short]
        h = n[short].astype(C.U) * C._STEP[40]
        for j in range(k - 1):
            more = n[short] > j
            h[more] += p.word_hash[at[more] + j] * C._STEP[20 + j]
        token, owner = np.concatenate([token, C.mix(h)]), np.concatenate([owner, short])
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    first = np.searchsorted(owner, np.arange(p.n + 1))
    sums = np.zeros(len(token) + 1, C.U)
    np.cumsum(C.mix(token ^ C._STEP[50]), out=sums[1:])
    sig = C.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(C.U) * C._STEP[51]) | C.U(1)
    sig[first[1:] == first[:-1]] = 0
    return token, first, sig


def _pack(token: np.ndarray) -> bytes:
    return np.ascontiguousarray(token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(data) -> np.ndarray:
    body = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(body), 8), np.uint8)
    out[:, :6] = body
    return out.view("<u8").ravel()


def _body(column) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a binary column, as they lie."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    return np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1], memoryview(data if data is not None else b"")


def shingled(docs: DataFrame, k: int, key: str, text: str, lower: bool) -> DataFrame:
    """id, n, cls (null for an empty set), tok and row of every row; tok (sorted tokens of 6 bytes) where a task meets a class that it does not remember; row: a number."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        seen: set[int] = {0}
        for b in batches:
            if len(seen) > SEEN:
                seen = {0}
            for p in C.pieces(b.column(1), lower):
                token, first, sig = sets(p, k)
                body = _pack(token >> C.U(16))
                toks = []
                for s, lo, hi in zip(sig.tolist(), first[:-1].tolist(), first[1:].tolist()):
                    toks.append(None if s in seen else body[6 * lo : 6 * hi])
                    seen.add(s)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(p.first, p.n), pa.array(np.diff(first), pa.int32()), pa.array(sig.view(np.int64), pa.int64(), mask=sig == 0), pa.array(toks, pa.binary())], names=["id", "n", "cls", "tok"])
            C.release()

    return docs.select(key, text).mapInArrow(run, f"id {kind}, n int, cls long, tok binary").withColumn("row", F.monotonically_increasing_id())


def _sketch(held: DataFrame) -> tuple[np.ndarray, float]:
    """Counts of tokens that repeat within a task's units, by their first SKETCH_BITS bits: an array of fixed size; and how many partners a token has in the whole, if units repeat it as they repeat tokens on average."""

    def run(batches):
        out = np.zeros((1 << SKETCH_BITS) + 3, np.int64)

        def count(data):
            token, n = np.unique(_unpack(data), return_counts=True)
            out[-3:] += n.sum(), (n - 1).sum(), 1
            np.add.at(out, (token[n > 1] >> C.U(48 - SKETCH_BITS)).astype(np.int64), n[n > 1])

        for b in batches:
            off, data = _body(b.column(0))
            for at in range(off[0], off[-1], 6 * UNIT):
                count(data[at : min(at + 6 * UNIT, off[-1])])
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out[at], pa.int64())], names=["cell", "count"])

    t = held.where("tok IS NOT NULL").select("tok").mapInArrow(run, "cell int, count long").groupBy("cell").agg(F.sum("count").alias("count")).toArrow()
    out = np.zeros((1 << SKETCH_BITS) + 3, np.int64)
    out[t.column("cell").to_numpy()] = t.column("count").to_numpy()
    total, repeats, units = out[-3:].tolist()
    return out[:-3], repeats / max(total, 1) * units


def prefixes(n: np.ndarray, token: np.ndarray, percent: int, sketch: np.ndarray, most: int, rate: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """l of each set, and the tokens of its prefix for l matches, the set each belongs to and its place there; n: sizes of the sets, whose tokens follow each other."""
    first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    seen = sketch[(token >> C.U(48 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((token, seen, row))
    token = token[order]
    met = np.concatenate([[0], np.cumsum(seen[order])]).astype(float)
    overlap = -(-percent * n // 100)  # at least what a linking set shares
    best, l = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for x in (m for m in MATCHES if m <= most):
        size = n - overlap + x
        partners = met[np.minimum(first[:-1] + size, first[1:])] - met[first[:-1]] + rate * size
        cost = np.where(x <= overlap, size + VERIFY * partners / x**2, np.inf)
        l = np.where(cost < best, x, l)
        best = np.minimum(best, cost)
    place = np.arange(len(token)) - first[row]
    inside = place < (n - overlap + l)[row]
    return l, token[inside], row[inside], place[inside]


def prefixed(held: DataFrame, percent: int, sketch: np.ndarray, rate: float, most: int) -> DataFrame:
    """cls, n, l, prefix (place and token of those in the class's prefix that another class's prefix holds too, in order) and weight (how many those are, in thousandths of the prefix).

    A class with fewer than l such tokens is left out: what it holds alone is more than a link allows.
    Every token of every prefix is moved, so with it go only its row's number, which differs little from the one before and packs
    well, and no class. Rows that share a token are few; they get their class, one row of each class stays, and its tokens are held against the others' once more.
    """

    def run(batches):
        for b in batches:
            C.release()
            at_row, n = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            off, data = _body(b.column(2))
            ends = np.cumsum(n)
            at = 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + UNIT, "right")))
                l, token, row, place = prefixes(n[at:to], _unpack(data[off[at] : off[to]]), percent, sketch, most, rate)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64), pa.int64()), pa.array(at_row[at:to][row], pa.int64()), pa.array(l[row], pa.int32()), pa.array(place, pa.int32())], names=["token", "row", "l", "place"])
                at = to

    def shared(rows: DataFrame) -> DataFrame:
        """The rows whose token another row holds too."""
        met = rows.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
        return rows.join(met.hint("merge"), "token")

    filled = held.where("tok IS NOT NULL")
    every = filled.select("row", "n", "tok").mapInArrow(run, "token long, row long, l int, place int")
    one = filled.groupBy("cls").agg(F.min("row").alias("row"), F.first("n").alias("n"))  # n is the same in all rows of a class
    known = C.written(shared(every).join(one.hint("merge"), "row").drop("row"), "shared")
    size = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + F.col("l")
    out = shared(known).groupBy("cls", "n", "l").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("prefix"))
    return C.written(out.where(F.size("prefix") >= F.col("l")).withColumn("weight", (1000 * F.size("prefix") / size).cast("int")), "prefixes")


def postings(p: DataFrame) -> DataFrame:
    """A row for each token of the prefixes: token, place, and k, its number in the prefix."""
    names = [c for c in p.columns if c != "prefix"]
    return p.select(*names, F.posexplode("prefix").alias("k", "at")).select(*names, "k", "at.token", "at.place")


def to_pivots(p: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of each token's pivot a with the others of its list."""
    each = postings(p).drop("k")
    pivot = each.groupBy("token").agg(F.max(F.struct("weight", "cls", "n", "l", "place")).alias("pivot"))
    pairs = each.join(pivot.hint("merge"), "token").where("cls <> pivot.cls").where(_sizes("n", "pivot.n", percent))
    met = pairs.groupBy(F.col("pivot.cls").alias("a"), F.col("cls").alias("b")).agg(
        F.count("*").alias("met"), F.max(F.struct("pivot.n", "pivot.l", "pivot.place")).alias("x"), F.max(F.struct("n", "l", "place")).alias("y")
    )  # n and l are the same in all rows of a pair
    after = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) - 1
    reach = (100 + percent) * (F.col("met") + after) >= percent * (F.col("x.n") + F.col("y.n"))
    return met.where((F.col("met") >= F.least("x.l", "y.l")) & reach).select("a", "b")


def agreeing(x: np.ndarray, y: np.ndarray, rows: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Which pairs (x, y) of rows of one token share enough tokens near it, and none before it.

    rows: n, l, place and rest of each, and its near tokens (first, size; id, at: a number for each token, and its place).
    Enough: as many as the smaller l, if both prefixes end there, and so many that with all that can follow the last one
    the sets would link.
    """
    first, size, n = rows["first"], rows["size"], rows["n"]

    def spread(at):
        pair = np.repeat(np.arange(len(at)), size[at])
        begin = np.cumsum(size[at]) - size[at]
        where = np.arange(len(pair)) - begin[pair] + first[at][pair]
        return pair, where, pair * (rows["id"].max() + 1) + rows["id"][where]

    (pair, in_x, key_x), (_, in_y, key_y) = spread(x), spread(y)
    _, i, j = np.intersect1d(key_x, key_y, assume_unique=True, return_indices=True)  # the token itself is in both
    pair, at_x, at_y = pair[i], rows["at"][in_x[i]], rows["at"][in_y[j]]
    begin = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    met = np.diff(np.append(begin, len(pair)))
    end_x, end_y = np.maximum.reduceat(at_x, begin), np.maximum.reduceat(at_y, begin)
    reach = met + np.minimum(n[x] - end_x, n[y] - end_y) - 1
    need = np.where(rows["rest"][x] + rows["rest"][y] > 0, 1, np.minimum(rows["l"][x], rows["l"][y]))
    return (np.minimum.reduceat(at_x, begin) == rows["place"][x]) & (met >= need) & ((100 + percent) * reach >= percent * (n[x] + n[y]))


def _pairs_of_group(percent: int):
    """Candidates (a, b, u, v) of some lists, as to_others groups them."""

    def run(t: pa.Table) -> pa.Table:
        C.release()
        t = t.sort_by([("token", "ascending"), ("pair", "ascending")]).combine_chunks()
        cls, label, side = (t.column(c).to_numpy() for c in ("cls", "label", "side"))
        lists = np.stack([t.column("token").to_numpy(), t.column("pair").to_numpy()])
        key = np.cumsum(np.append(0, (lists[:, 1:] != lists[:, :-1]).any(0)))  # a number for each list, or pair of its tiles
        rows = {c: t.column(c).to_numpy().astype(np.int64) for c in ("n", "l", "place", "rest")}
        off, data = _body(t.column("tokens"))
        rows["size"] = np.diff(off).astype(np.int64) // 6
        rows["first"] = np.cumsum(rows["size"]) - rows["size"]
        tokens = np.frombuffer(data, np.uint8)[off[0] : off[-1]].reshape(-1, 6)
        rows["id"] = np.unique(np.ascontiguousarray(tokens).view("V6").ravel(), return_inverse=True)[1]
        off, data = _body(t.column("places"))
        rows["at"] = np.frombuffer(data[off[0] : off[-1]], ">u4").astype(np.int64)
        n, place = rows["n"], rows["place"]
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for lag in range(1, len(key)):  # rows of a token are neighbours: pairs that lie `lag` apart
            x = np.flatnonzero(key[lag:] == key[:-lag])
            if not len(x):
                break
            y = x + lag
            after = np.minimum(n[x] - place[x], n[y] - place[y])
            ok = (label[x] != label[y]) & ((side[x] != side[y]) | (side[x] < 0)) & ((100 + percent) * after >= percent * (n[x] + n[y]))
            x, y = x[ok], y[ok]
            for lo in range(0, len(x), PAIRS):
                i, j = x[lo : lo + PAIRS], y[lo : lo + PAIRS]
                good = agreeing(i, j, rows, percent)
                out.append((i[good], j[good]))
        x, y = (np.concatenate([o[k] for o in out]) for k in (0, 1))
        x, y = np.where(cls[x] < cls[y], x, y), np.where(cls[x] < cls[y], y, x)
        return pa.table({"a": cls[x], "b": cls[y], "u": label[x], "v": label[y]})

    return run


def to_others(p: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) with different labels and their labels (u, v): all that the pivots' labels don't join.

    Two prefixes are compared in the list of the first token that they share, to which each row brings the prefix near it.
    Lists of up to TILE rows are compared in groups of about ROWS rows, longer ones tile by tile; pairs that don't agree are not put out.
    """
    named = C.written(p.drop("weight").join(labels.hint("merge"), "cls", "left").withColumn("label", F.coalesce("label", "cls")), "labelled")
    each = postings(named).select("token", "cls", "label", "n", "place", "k")
    lists = each.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("smallest"), F.count("*").alias("m")).where("low < high").select("token", "m", "smallest")
    first = (100 + percent) * (F.col("n") - F.col("place")) >= percent * (F.col("n") + F.col("smallest"))  # else no pair can begin to agree here
    rows = C.cut(each.drop("label").join(lists.hint("merge"), "token").where(first).groupBy("cls").agg(F.collect_list(F.struct("k", "m")).alias("all")))
    groups = max(1, (rows.agg(F.sum(F.size("all"))).first()[0] or 0) // ROWS)
    begin = F.greatest(F.col("k") - BEFORE, F.lit(0))
    near = F.slice("prefix", begin + 1, F.lit(AROUND))
    own = F.get("prefix", F.col("k"))
    packed = lambda numbers, size: F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 2 * size, "0")), ""))
    rows = rows.join(named.hint("merge"), "cls").select("cls", "n", "l", "label", "prefix", F.inline("all")).withColumns({"token": own["token"], "place": own["place"], "tokens": packed(near["token"], 6), "places": packed(near["place"], 4), "rest": F.greatest(F.size("prefix") - begin - AROUND, F.lit(0))})
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    placed = rows.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    group = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("token"), F.lit(groups))).otherwise(F.xxhash64("token", F.least("tile", "other"), F.greatest("tile", "other")))
    pair = F.least("tile", "other") * F.col("tiles") + F.greatest("tile", "other")
    side = F.when(F.col("tile") == F.col("other"), -1).otherwise((F.col("tile") > F.col("other")).cast("int"))
    placed = placed.select(group.alias("group"), pair.cast("long").alias("pair"), "token", "cls", "n", "l", "label", "place", "tokens", "places", "rest", side.alias("side"))
    return placed.groupBy("group").applyInArrow(_pairs_of_group(percent), "a long, b long, u long, v long").distinct()


def _sizes(x: str, y: str, percent: int):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def signature(token: np.ndarray) -> bytes:
    """Which of at least 2 buckets a token, a power of two of them, hold a token of a set."""
    size = 1 << max(6, int(2 * len(token) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(token & C.U(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def at_most(x: bytes, y: bytes, n: int, m: int) -> int:
    """A bound of what two sets of n and m tokens share: every bucket that one fills and the other doesn't is a token that they don't share."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(v.reshape(-1, size)) for v in (a, b))  # buckets of the larger one folded to those of the smaller
    return min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))


def _passing(rows: DataFrame, held: DataFrame, kind: str) -> DataFrame:
    """row and kind (tok, or the set's n and signature) of the rows of held that are among rows (row), and of few others.

    A bitmap of fixed size keeps most sets from being moved; more rows only let more pass.
    """
    bit = F.expr(f"shiftrightunsigned(xxhash64(row), {64 - BITMAP_BITS})")
    found = rows.select(bit.alias("bit")).groupBy(F.expr("cast(bit >> 6 AS int)").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("bits")).toArrow()
    cells = np.zeros(1 << (BITMAP_BITS - 6), np.int64)  # at most as many rows came
    cells[found.column("cell").to_numpy()] = found.column("bits").to_numpy()
    bitmap = cells.view(C.U)

    def run(batches):
        for b in batches:
            at = b.column(0).to_numpy()
            b = b.select(["row", "tok"]).filter(pa.array((bitmap[at >> 6] >> (at & 63).astype(C.U) & C.U(1)) > 0))
            if kind == "tok":
                yield b
            else:
                sets = [_unpack(t.as_buffer()) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, sets), pa.int32()), pa.array(map(signature, sets), pa.binary())], names=["row", "size", "signature"])

    schema = "row long, tok binary" if kind == "tok" else "row long, size int, signature binary"
    return held.where("tok IS NOT NULL").select(bit.alias("bit"), "row", "tok").mapInArrow(run, schema)


def _with_both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (row_a, row_b) with the columns of both sets, ending in _a and _b."""
    for c in "ab":
        pairs = pairs.join(sets.select(*[F.col(x).alias(f"{x}_{c}") for x in sets.columns]).hint("merge"), f"row_{c}")
    return pairs


def verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The rows of pairs (a, b and more; checkpointed) whose whole sets link; held: the sets, as shingled gives them.

    Of every class one row's set is read. First signatures of less than a tenth of a set's size are moved to the pairs; those that bound the overlap
    below what a link needs end there. The whole sets are moved to the pairs that are left, each once.
    """
    classes = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    chosen = C.cut(held.where("tok IS NOT NULL").groupBy("cls").agg(F.min("row").alias("row")).join(classes, "cls"))
    placed = pairs
    for c in "ab":
        placed = placed.join(chosen.select(F.col("cls").alias(c), F.col("row").alias(f"row_{c}")).hint("merge"), c)
    names = pairs.columns
    placed = placed.select(*names, "row_a", "row_b")
    links = lambda common, n, m: 100 * common >= percent * (n + m - common)

    def filtered(joined: DataFrame, keep: list[str], test) -> DataFrame:
        """The columns keep of the rows whose other columns pass a test."""
        rest = [c for c in joined.columns if c not in keep]

        def run(batches):
            for b in batches:
                C.release()
                ok = [test(*x) for x in zip(*(b.column(len(keep) + k) for k in range(len(rest))))]
                yield pa.RecordBatch.from_arrays(b.columns[: len(keep)], names=keep).filter(pa.array(ok, pa.bool_()))

        return joined.select(*keep, *rest).mapInArrow(run, joined.select(*keep).schema)

    def may_link(size_a, sig_a, size_b, sig_b):
        n, m = size_a.as_py(), size_b.as_py()
        return links(at_most(sig_a.as_buffer(), sig_b.as_buffer(), n, m), n, m)

    def link(tok_a, tok_b):
        x, y = sorted((_unpack(tok_a.as_buffer()), _unpack(tok_b.as_buffer())), key=len)
        at = np.searchsorted(y, x)
        return links(int((y[np.minimum(at, len(y) - 1)] == x).sum()), len(x), len(y))

    near = C.cut(filtered(_with_both(placed, _passing(chosen, held, "signature")), placed.columns, may_link))
    rows = near.select(F.col("row_a").alias("row")).unionByName(near.select(F.col("row_b").alias("row"))).distinct()
    return filtered(_with_both(near, _passing(rows, held, "tok")).drop("row_a", "row_b"), names, link)


def _grouped(docs: DataFrame, k: int, percent: int, key: str, text: str, lower: bool, most: int) -> DataFrame:
    """What near_groups returns; the tasks in Python have ended by then."""
    held = C.written(shingled(docs, k, key, text, lower), "sets")
    rows = held.select("id", "n", "cls")
    p = prefixed(held, percent, *_sketch(held), most)
    star = C.cut(verified(C.cut(to_pivots(p, percent)), held, percent))
    pivots = star.select("a").distinct()
    labels = star.groupBy(F.col("b").alias("cls")).agg(F.min("a").alias("label")).join(pivots, F.col("cls") == F.col("a"), "left_anti").unionByName(pivots.select(F.col("a").alias("cls"), F.col("a").alias("label")))
    labels = C.cut(labels)
    more = verified(C.cut(to_others(p, labels, percent)), held, percent).select("u", "v")
    across = star.join(labels, F.col("b") == F.col("cls")).where("a <> label").select(F.col("a").alias("u"), F.col("label").alias("v"))
    joined = components(more.unionByName(across))
    roots = labels.join(joined, F.col("label") == F.col("node"), "left").select("cls", F.coalesce("root", "label").alias("root"))
    alone = joined.join(labels, F.col("node") == F.col("cls"), "left_anti").select(F.col("node").alias("cls"), "root")
    member = roots.unionByName(alone).withColumnRenamed("cls", "node")
    first = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("first"))
    grouped = first.join(member, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("root"), "first")
    least = grouped.groupBy("root").agg(F.min("first").alias("component"))
    ids = grouped.join(least, "root").select(F.col("cls").alias("class"), "component")
    out = rows.join(ids, F.col("cls") == F.col("class"), "left")
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", lower: bool = True, most: int = MATCHES[-1]) -> DataFrame:
    """key, n_shingles and component_id (least key that links lead to) of every row.

    Two sets link when 100 * size of intersection >= percent * size of union. most: the largest l.
    """
    with C.small_batches(docs.sparkSession):
        return _grouped(docs, k, percent, key, text, lower, most)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the members of a group other than the one with the least key; rows without key stay."""
    out = near_groups(docs, k, percent, key, text).where(F.col(key) != F.col("component_id")).select(key).distinct()
    return docs.join(out, key, "left_anti").select(*docs.columns)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(C.read(spark, sf_dir, "documents"), k=4, percent=85)


def near_sql(k: int, percent: int, table: str = "documents") -> str:
    """CTEs that end in near (doc_id, n_shingles, component_id)."""
    return f"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS x FROM {table}),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(x) = 0 THEN [] WHEN len(x) < {k} THEN [array_to_string(x, ' ')] ELSE list_transform(range(1, len(x) - {k - 2}), lambda i: array_to_string(x[i:i + {k - 1}], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * hits >= {percent} * (x.n + y.n - hits)),
r(doc_id, node) AS (SELECT DISTINCT doc_id, doc_id FROM {table} UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.node = l.a),
near AS (SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM {table} d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id)"""


OP1_SQL = f"WITH RECURSIVE {near_sql(4, 85)}\nSELECT doc_id, n_shingles, component_id FROM near"
