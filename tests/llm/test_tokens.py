import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import dac, packing, tokens

from .helpers import DOCS, awkward, documents

WEIRD = [
    "", "a", " a", "a ", "a\n\nb", "a\n\n", " \n a\tb  c\r\n", "it's they'll I'D 'S x'sy", "<|endoftext|> hi <|startoftext|>",
    "Ünï ½ ² ́x é   z q", "日本語 テスト", "a\x01b \x1c c\x85d", "İstanbul ΣΑΣ ς", "$$$ ### 12345 a1b2", "\U0001F600 smile", "\n\n\n", "x \n", "y" * 500 + " z",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name):
    own, draw = tokens.Encoder(tokens.vocabulary(name)), random.Random(1)
    made = ["".join(draw.choice(" \n\ta'sAé1½.,́日\x1c \x01") for _ in range(draw.randint(0, 25))) for _ in range(500)]
    for text in WEIRD + made:
        want = own.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.ids(text), "<u4").tolist() == want, repr(text)


@pytest.mark.parametrize("name, ids", [("byte_bpe_50k.json", [64, 50256, 65]), ("word_bpe_49k.json", [320, 49407, 321])])
def test_special_tokens_inside_texts_are_those_of_a_fresh_library(name, ids):
    from tokenizers import Tokenizer

    own, fresh, draw = tokens.Encoder(tokens.vocabulary(name)), Tokenizer.from_file(tokens.vocabulary(name)), random.Random(2)
    assert np.frombuffer(own.ids("a<|endoftext|>b"), "<u4").tolist() == ids
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", "<", " ", "  ", "\n", "a", "É", "e\u0301", "'s", "\x01", "日", "y" * 300]
    for text in WEIRD + ["".join(draw.choices(parts, k=draw.randint(1, 12))) for _ in range(1000)]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_full_cache_changes_nothing():
    own = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"), 2)
    for text in WEIRD * 2:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == own.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_letters_and_closing_punctuation_need_no_search_and_one_cache(name):
    own, draw = tokens.Encoder(tokens.vocabulary(name)), random.Random(3)
    for _ in range(3000):
        chunk = draw.choice(["", " "] if own.spaced else [""]) + "".join(draw.choices("abéüœ_'s.,!?-7½ªº", k=draw.randint(0, 6)))
        assert list(own.parts(chunk)) == own.pattern.findall(chunk), repr(chunk)
    own.pattern = None  # searched by the encoder for every new word before
    text = "Plain words, éclair words!!! and Plain; (no"
    assert np.frombuffer(own.ids(text[:-5]), "<u4").tolist() == own.library.encode(text[:-5], add_special_tokens=False).ids
    held = len(own.cache.young)
    own.ids("Plain words")  # the piece of "words," is the word
    assert len(own.cache.young) == held


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), max_size=6))
def test_codes_give_back_every_id(docs):
    ids = np.array([i for d in docs for i in d], dtype="<u4")
    reader = dac.Reader(dac.encode(ids, [len(d) for d in docs]))
    assert [reader.document(k).tolist() for k in range(len(docs))] == docs
    for i in range(0, len(ids), 97):
        assert reader.token(i) == ids[i]
    for a in range(0, len(ids), 131):
        assert reader.tokens(a, min(len(ids), a + 517)).tolist() == ids[a : a + 517].tolist()


def test_a_document_is_read_without_unpacking_the_last_level(monkeypatch):
    ids, calls, unpack = np.arange(0, 60000, 7, dtype="<u4"), [], np.unpackbits
    reader = dac.Reader(dac.encode(ids, [4000, 0, len(ids) - 4000]))
    monkeypatch.setattr(dac.np, "unpackbits", lambda *a, **k: calls.append(1) or unpack(*a, **k))
    assert len(reader.levels) == 2 and reader.document(2).tolist() == ids[4000:].tolist() and reader.document(1).tolist() == []
    assert len(calls) == 1  # the last level has no bits set; ranks are counted, not unpacked


def test_written_documents_read_back(spark):
    path, docs = tokens.vocabulary("byte_bpe_50k.json"), awkward(spark)
    own = tokens.Encoder(path)
    blocks = dac.write_blocks(docs.withColumnRenamed("n_chars", "payload"), path, block_tokens=40)
    got = sorted((tuple(r) for r in dac.read_documents(blocks).collect()), key=lambda r: r[1])
    ids = [(r.doc_id, own.ids(r.text or "") + b"\0\0\0\0") for r in docs.collect()]
    assert [r[0] for r in got] == sorted((i for i, _ in ids), key=lambda i: (i is not None, i))
    assert sorted((i, len(b) // 4, zlib.crc32(b)) for i, b in ids if i is not None) == sorted((r[0], r[2], r[3]) for r in got if r[0] is not None)
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()


def test_no_documents_no_blocks(spark):
    empty = spark.createDataFrame([], DOCS)
    assert dac.read_documents(dac.write_blocks(empty, tokens.vocabulary("byte_bpe_50k.json"))).count() == 0
    assert packing.pack_documents(empty, tokens.vocabulary("word_bpe_49k.json"), 64).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), max_size=30))
def test_plan_places_every_piece_once(histogram):
    placed = {}
    for content, count in packing.plan(histogram, 100):
        assert sum(content) <= 100 and count > 0
        for length in content:
            placed[length] = placed.get(length, 0) + count
    assert placed == histogram


def test_the_program_beats_best_fit_where_it_should():
    histogram = {n: 40 for n in range(520, 900, 3)}
    count = lambda bins: sum(n for _, n in bins)
    assert count(packing.plan(histogram, 2048)) < count(packing.best_fit(histogram, [], 2048))


def test_packed_documents(spark):
    path, docs = tokens.vocabulary("word_bpe_49k.json"), awkward(spark)
    docs = docs.withColumnRenamed("source", "length").withColumnRenamed("n_chars", "rank")
    got, capacity, own = packing.pack_documents(docs, path, 64).collect(), 64, tokens.Encoder(path)
    whole = sorted((r.doc_id is not None, r.doc_id or 0, own.ids(r.text or "") + b"\0\0\0\0") for r in docs.collect())
    assert sum(r["length"] for r in got) == sum(len(b) // 4 for *_, b in whole)
    by_doc = {}
    for r in sorted(got, key=lambda r: (repr(r["doc_id"]), r["piece"])):
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] <= 4 * capacity
        if r["doc_id"] in (6, 7):
            by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], b"") + bytes(r["ids"])
    assert by_doc == {i: b for _, i, b in whole if i in (6, 7)}
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_documents_that_fill_sequences_exactly(spark):
    path = tokens.vocabulary("word_bpe_49k.json")
    docs = documents(spark, [(i, "a " * 7, None, None, None) for i in range(9)])
    got = packing.pack_documents(docs, path, 8).collect()
    assert {r["length"] for r in got} == {8} and len({r["sequence_id"] for r in got}) == 9
