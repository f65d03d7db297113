import functools
import unicodedata
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kohesion.llm import tokens
from kohesion.llm._store import new_path
from kohesion.llm.queries import END_ID, op10_token_files, vocabulary

ODD = [
    "J̌ x", "ΑΣ Σ.", "a\x1cb c\x85d\xa0e", "<|ENDOFTEXT|> <|endoftext|>x<|startoftext|>.", "don't. DON'T, it's", "é É.", "K K ſ.", "１２3.,x", "..., ,.a", "", " \n", "ﬁ. ﬁ",
    "İstanbul. İ", "नमस्ते. हि", "汉字, 汉.", "a.b,c.", "x y　z", "word.word. word.", "Ünï. cOmb́. X̱.", "́ a", "tab\tline\r\nend",
]


@functools.cache
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def brute(text):
    return plain().encode(text, add_special_tokens=False).ids


def test_encoder_matches_the_tokenizer():
    own = tokens.Encoder(vocabulary())
    got = own.encode_many(ODD) + own.encode_many(ODD[::-1])[::-1]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [brute(t) for t in ODD] * 2


def test_every_letter_before_a_mark():
    """Some letters have marks in normal form, which join with what follows."""
    letters = [c for c in map(chr, range(0x110000)) if unicodedata.category(c).startswith("L")]
    texts = [f"{c}. a{c}, {c.upper()}{c}.x" for c in letters]
    want = plain().encode_batch_fast(texts, add_special_tokens=False)
    got = tokens.Encoder(vocabulary()).encode_many(texts)
    assert len(letters) > 130_000
    assert [c for c, g, w in zip(letters, got, want, strict=True) if np.frombuffer(g, "<u4").tolist() != w.ids] == []


@functools.cache
def kept():
    return tokens.Encoder(vocabulary())


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" .,'<|>\x1c\x85\xa0\u3000aIKeéßſİıΣςσ\u0301\u0307\u09df\u0921\u093c\ufb1f\u200b12")), st.characters(exclude_categories=["Cs"]))), max_size=6))
def test_any_text(texts):
    own = kept()
    assert [np.frombuffer(g, "<u4").tolist() for g in own.encode_many(texts)] == [w.ids for w in own.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_everyday_words_with_marks():
    texts = ["\u0130. x", "\u09b9\u09df, \u09df.", "\u092a\u0939\u095c, \ufb1f."]
    assert [np.frombuffer(g, "<u4").tolist() for g in tokens.Encoder(vocabulary()).encode_many(texts)] == [brute(t) for t in texts]


def test_encoder_memory_is_bounded_by_bytes():
    own = tokens.Encoder(vocabulary(), remembered=50_000)
    for i in range(40):
        own.encode_many([" ".join(f"word{i}x{j} {'u' * 200}{j}" for j in range(100))])
        held = own.forms.nbytes + own.ids.nbytes
        # What one group of texts adds comes on top.
        assert held < 50_000 + 60_000


def test_encoder_forgets_but_stays_right():
    own = tokens.Encoder(vocabulary(), remembered=300)
    for t in ["some words and more words. Words, here", *ODD, "some words again."] * 2:
        assert np.frombuffer(own.encode_many([t])[0], "<u4").tolist() == brute(t)


def test_index_matches_brute_force(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    start, want = 0, {}
    for i, t in rows:
        ids = [*brute(t), END_ID]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op10_token_files(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("encoding", tokens.ENCODINGS)
def test_files(spark, docs, encoding, clashing):
    path = new_path(spark, "token-test")
    tokens.write_tokens(docs([(i, f"text number {i} of many. {'word ' * 300}") for i in range(200, 0, -1)], clashing), path, vocabulary(), END_ID, encoding, row_group_bytes=64 << 10, page_bytes=4 << 10)
    from pathlib import Path

    seen, ids = [], []
    for f in sorted(Path(path.removeprefix("file://")).glob("*.parquet")):
        file = pq.ParquetFile(f)
        table = file.read()
        ids += table["doc_id"].to_pylist()
        for g in range(file.metadata.num_row_groups):
            column = file.metadata.row_group(g).column(2)
            seen.append("".join(column.encodings))
            assert column.has_column_index and column.has_offset_index
    assert ids == sorted(ids) and len(ids) == 200
    assert all(("DICTIONARY" in s) == (encoding == "dictionary") for s in seen)
    some = tokens.read_tokens(spark, path, ("doc_id", "n_tokens"), 10, 12)
    assert sorted(r["doc_id"] for r in some.collect()) == [10, 11, 12]
    plan = some._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0] and "PushedFilters" in plan


def test_edge_rows(spark, docs, clashing):
    rows = [(5, "b"), (5, "b"), (2, None), (None, "a"), (9, ""), (7, "long " * 100_000)]
    got = sorted((r["start"], -1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in tokens.token_round_trip(docs(rows, clashing), vocabulary(), END_ID).collect())
    assert [g[1] for g in got] == [-1, 2, 5, 5, 7, 9]
    assert [g[2] for g in got] == [2, 1, 2, 2, 100_001, 1]
    assert [g[0] for g in got] == [0, 2, 3, 5, 7, 100_008]
    assert tokens.token_round_trip(docs([]), vocabulary(), END_ID).count() == 0
    with pytest.raises(ValueError):
        tokens.write_tokens(docs([]), "x", "y", 2, "gzip")
