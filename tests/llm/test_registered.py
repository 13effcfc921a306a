"""The registered queries over the smallest tables, against what their contracts say of each row."""

import re
import zlib

import pytest

from pagewright.llm import common as C
from pagewright.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in C.read(spark, SF, "documents").collect()}


def rows(spark, name, *columns):
    out = queries.QUERIES[name](spark, SF)
    assert set(columns) <= set(out.columns)
    return out.select(*columns).collect()


def test_op3(spark):
    urls = {r.page_id: r.url for r in C.read(spark, SF, "pages").collect()}
    got = rows(spark, "op3_main_text", "page_id", "url", "text", "n_chars")
    assert {r.page_id: r.url for r in got} == urls and len(got) == len(urls)
    assert all(r.n_chars == len(r.text) and not re.search(r"[ \t\r\n]{2,}", r.text.replace("\n\n", "|")) and r.text == r.text.strip() for r in got)
    assert sum(r.n_chars > 0 for r in got) == len(got)


def test_op4(spark, documents):
    got = rows(spark, "op4_toxicity", "doc_id", "held_out", "score", "predicted")
    assert sorted(r.doc_id for r in got) == sorted(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_op6(spark, documents):
    got = {r.doc_id: r for r in rows(spark, "op6_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")}
    assert got.keys() == documents.keys()
    for k, text in documents.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows: dict[tuple, list[int]] = {}
        for i in range(len(words) - 7):
            windows.setdefault(tuple(words[i : i + 8]), []).append(i)
        again = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(words) < 20 or 100 * len(again) > 30 * len(words)) and not (r.base_failed and r.kept)


def test_op7(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = rows(spark, "op7_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = {k: (len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for k, t in documents.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == want and len(got) == len(want)


def test_op8_and_op9(spark, documents):
    found = rows(spark, "op8_decontamination", "doc_id", "item_id", "n_words", "n_equal")
    assert len({(r.doc_id, r.item_id) for r in found}) == len(found) and all(r.doc_id in documents and 100 * r.n_equal >= 80 * r.n_words for r in found)
    got = rows(spark, "op9_quality_classifier", "doc_id", "perplexity", "threshold", "kept")
    assert sorted(r.doc_id for r in got) == sorted(documents)
    assert all(r.kept == (r.perplexity is not None and r.perplexity <= r.threshold) for r in got)
