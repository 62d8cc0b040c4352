import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from folioscope.llm import align
from folioscope.llm.tokens import byte_letters, vocabulary

from .helpers import awkward, doc, documents, rows_of

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """text -> (A ids, B ids, groups, links) by the libraries alone, on the whole text."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {letter: byte for byte, letter in byte_letters().items()}

    def run(text):
        if not text:
            return None
        ea, eb = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ta = [bytes(back[x] for x in a.id_to_token(i)) for i in ea]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in eb]
        if not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            return None
        ends_a, ends_b = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
        links = [(ea[ends_a.index(e)], eb[ends_b.index(e)]) for e in sorted(set(ends_a) & set(ends_b))]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            m, n = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(map(str, ea[i:m])) + "|" + ",".join(map(str, eb[j:n])))
            i, j = m, n
        return ea, eb, groups, links

    return run


def brute_force(plain, rows):
    found = [plain(r.text) for r in rows]
    counts = Counter(link for f in found if f for link in f[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for r, f in zip(rows, found, strict=True):
        if not f:
            out.append((r.doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        ea, eb, groups, links = f
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((r.doc_id, len(ea), len(eb), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


ODD = ["<|endoftext|>", "<s>", "▁", "  ", "\n", "\n\n", " \n", "\t", "\r\n", " ", "　", "é", "é", "日本", "😀", "don't", "I'LL", "123", "4.5", "...", "_", "the", "The", "token", "<0x41>", "\x00", "\x01", " ", "a", "​", "ﬁ"]


def test_random_texts_by_the_libraries_alone(spark, plain):
    draw = random.Random(5)
    rows = [doc(i, (" " if draw.random() < 0.5 else "").join(draw.choice(ODD) for _ in range(draw.randrange(1, 25)))) for i in range(1500)]
    docs = documents(spark, rows)
    got = rows_of(align.align(docs, A, B))
    assert got == brute_force(plain, docs.collect())
    assert any(r[1] for r in got) and any(not r[1] for r in got)


def test_given_texts_and_awkward_rows(spark, sf, plain):
    given = spark.read.parquet(f"{sf}/documents.parquet").limit(150).select("doc_id", "text", "lang", "source", "n_chars")
    docs = given.union(awkward(spark)).selectExpr("*", "1 AS block", "2 AS bucket", "'x' AS pair", "3 AS n_a").cache()
    assert rows_of(align.align(docs, A, B)) == brute_force(plain, docs.collect())


def test_many_blocks_give_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(align.align(docs.repartition(13), A, B)) == rows_of(align.align(docs.coalesce(1), A, B))


def test_planes_give_back_counts_by_plain_arithmetic():
    draw = np.random.default_rng(1)
    for n, m in ((1, 1), (40, 7), (3000, 50)):
        table = draw.integers(0, 9, (m, n)) * (draw.random((m, n)) < draw.random((m, 1)) ** 3)
        table[:, 0] += 1
        at, docs = np.nonzero(table)
        planes = align.Planes(align.pack(n, np.arange(m) * 7, at, docs, table[at, docs]))
        assert planes.links().tolist() == table.sum(axis=1).tolist()
        assert planes.documents().tolist() == (table > 0).sum(axis=1).tolist()
        values = draw.integers(0, 1 << 40, m)
        assert planes.add_up(values).tolist() == (table * values[:, None]).sum(axis=0).tolist()


def test_pair_counts_of_documents_and_links(spark):
    docs = documents(spark, [doc(1, "the the"), doc(2, "the"), doc(3, "a")])
    rows = {(r.a_id, r.b_id): (r.n_docs, r.n_links, r.best) for r in align.pair_counts(align.index(docs, A, B)).collect()}
    assert sorted(rows.values()) == [(1, 1, True), (2, 3, True)]


def test_empty_table(spark):
    assert align.align(documents(spark, []), A, B).count() == 0
