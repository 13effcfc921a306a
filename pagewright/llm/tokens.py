"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

For a piece of text that the vocabulary's split pattern leaves whole, the last token of
each prefix is determined by the last token of a shorter prefix: token t may follow
token s exactly if encoding s + t gives [s, t]. So one pass over the bytes gives the
exact count of every prefix, and a table of counts at every code point answers
truncation and budget questions without encoding again.

A null text counts as empty; an empty text has 0 tokens; repeated rows are counted one
by one; other columns are kept as they are. A special string inside a text counts as one
token, as the library has it by default.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common as C

#: Fixed value: the split pattern of byte-level BPE vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 512
#: Pieces whose counts a worker keeps.
KEPT = 600_000


def _letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file, and back."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts of every prefix of a text, for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _letters()
        to_bytes = lambda s: bytes(back[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.vocabulary = {to_bytes(s) for s in spec["model"]["vocab"] if s not in self.special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(to_bytes(a), to_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.vocabulary))
        self.split = regex.compile(SPLIT)
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._whole: dict[bytes, bool] = {}
        self._follows: dict[tuple[bytes, bytes], bool] = {}
        self._counts: dict[str, int] = {}

    def _merge(self, data: bytes) -> list[bytes]:
        """The tokens of a short byte string, by merging the pair of least rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _is_token(self, t: bytes) -> bool:
        ok = self._whole.get(t)
        if ok is None:
            ok = self._whole[t] = len(self._merge(t)) == 1
        return ok

    def _may_follow(self, s: bytes, t: bytes) -> bool:
        ok = self._follows.get((s, t))
        if ok is None:
            if len(self._follows) > 2 * KEPT:
                self._follows.clear()
            ok = self._follows[(s, t)] = self._merge(s + t) == [s, t]
        return ok

    def of_piece(self, data: bytes) -> list[int]:
        """Counts of the prefixes of 0, 1, ... bytes of a piece that is not split."""
        vocabulary, follows = self.vocabulary, self._follows
        last: list[bytes] = [b""]
        counts = [0]
        for i in range(1, len(data) + 1):
            for j in range(max(0, i - self.longest), i):
                t = data[j:i]
                if t not in vocabulary or not self._is_token(t):
                    continue
                if j:
                    ok = follows.get((last[j], t))
                    if ok is None:
                        ok = self._may_follow(last[j], t)
                    if not ok:
                        continue
                last.append(t)
                counts.append(counts[j] + 1)
                break
        return counts

    def _parts(self, text: str):
        """Runs without a special string, with None where one stood between them."""
        if self.at_special is None:
            yield text
            return
        at = 0
        for m in self.at_special.finditer(text):
            yield text[at : m.start()]
            yield None
            at = m.end()
        yield text[at:]

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entry of its prefix table."""
        kept, total = self._counts, 0
        if self.special and not any(s in text for s in self.special):
            parts = (text,)
        else:
            parts = self._parts(text)
        for part in parts:
            if part is None:
                total += 1
                continue
            for piece in self.split.findall(part):
                n = kept.get(piece)
                if n is None:
                    if len(kept) >= KEPT:
                        kept.clear()
                    n = self.of_piece(piece.encode("utf-8", "surrogatepass"))[-1]
                    if len(piece) < 64:
                        kept[piece] = n
                total += n
        return total

    def _run(self, part: str) -> list[int]:
        """Counts at the end of each code point of a run without special strings.

        A prefix that ends inside a piece splits like the text up to there, but for two
        cases: white space at the end is one piece however it is split later, and the
        beginning of a contraction is split as what it is alone.
        """
        out: list[int] = []
        before = 0  # tokens before the piece
        blank = 0  # where the run of white space that ends here began, and the tokens before it
        blank_before = 0
        for m in self.split.finditer(part):
            piece = m.group()
            if piece.isspace() or piece[0] == " ":
                if not out or not part[m.start() - 1].isspace():
                    blank, blank_before = m.start(), before
            ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in piece])
            counts = self.of_piece(piece.encode("utf-8", "surrogatepass"))
            odd = piece[0] == "'" and len(piece) > 2 and piece[1:].isalpha()
            for k, e in enumerate(ends.tolist()):
                at = m.start() + k
                if part[at].isspace():
                    run = part[blank : at + 1]
                    out.append(blank_before + self._alone(run))
                elif odd and k + 1 < len(piece):
                    out.append(before + self._alone(piece[: k + 1]))
                else:
                    out.append(before + counts[e])
            before += counts[-1]
        return out

    def _alone(self, text: str) -> int:
        return sum(self.of_piece(p.encode("utf-8", "surrogatepass"))[-1] for p in self.split.findall(text))

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of the prefix of 0, 1, ... code points of a text.

        Inside a special string the prefix is ordinary text, so those few entries are
        encoded on their own.
        """
        out, before, at = [0], 0, 0
        begun = 0  # where the run of ordinary text that ends here began
        for part in self._parts(text):
            if part is None:
                s = next(s for s in sorted(self.special, key=len, reverse=True) if text.startswith(s, at))
                base = out[begun]
                out += [base + self._alone(text[begun : at + k]) for k in range(1, len(s))]
                at += len(s)
                before += 1
                out.append(before)
                begun = at
            else:
                run = self._run(part)
                out += [before + n for n in run]
                before = out[-1]
                at += len(part)
        return np.array(out, np.int32)

    def longest_prefix(self, table: np.ndarray, budget: int) -> int:
        """Code points of the longest prefix with at most budget tokens, from the table alone."""
        return int(np.flatnonzero(table <= budget)[-1]) if budget >= 0 else 0


@lru_cache(4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of every row; one pass, no shuffle.

    path: vocabulary file, the same on every machine; by default that of the installed package.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        c = counter(path or default_path())
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [c.count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")


def with_prefix_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and prefix_counts, an array with the count at every prefix of 0, 1, ... code points."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        c = counter(path or default_path())
        for b in batches:
            tables = [c.prefixes(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tables, pa.list_(pa.int32()))], names=[key, "prefix_counts"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, prefix_counts array<int>")


def fit_budget(prefixes: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """key and n_chars, the longest prefix within the budget; only the stored tables are read."""
    from pyspark.sql import functions as F

    fits = F.expr(f"filter(sequence(0, size(prefix_counts) - 1), i -> prefix_counts[i] <= {int(budget)})")
    return prefixes.select(key, F.coalesce(F.array_max(fits), F.lit(0)).alias("n_chars"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(C.read(spark, sf_dir, "documents"))
