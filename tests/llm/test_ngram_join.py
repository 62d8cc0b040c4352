import random

import numpy as np
import pytest

from folioscope.llm import ngram_join as m

from .helpers import awkward, doc, documents, rows_of
from .test_simhash import WORD


def plain_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute_force(rows):
    sets, up = [plain_set(r.text) for r in rows], list(range(len(rows)))
    links = [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 85 * (len(a) + len(sets[j]) - common):
                up[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            least[root(k)] = min(least.get(root(k), r.doc_id), r.doc_id)
    return sorted(((r.doc_id, len(s), least.get(root(k)), n) for k, (r, s, n) in enumerate(zip(rows, sets, links, strict=True))), key=repr)


def near_copies(seed, n, length, changes, vocabulary=4000):
    """Families of texts that differ in some words, with a passage that many share."""
    draw, out = random.Random(seed), []
    passage = [f"p{k}" for k in range(30)]
    for _ in range(n):
        if out and draw.random() < 0.75:
            words = list(out[draw.randrange(len(out))])
            for _ in range(draw.randint(0, changes)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(vocabulary)}"
        else:
            words = [f"w{draw.randrange(vocabulary)}" for _ in range(draw.randint(*length))]
            if draw.random() < 0.5:
                words[5:5] = passage
        out.append(words)
    return [doc(k, " ".join(w)) for k, w in enumerate(out)]


def test_awkward_rows_and_clashing_columns(spark):
    docs = awkward(spark)
    clash = docs.selectExpr("*", "1 AS id", "2 AS n", "3 AS k1", "'x' AS set", "4 AS component_id", "5 AS root")
    assert rows_of(m.join(clash)) == brute_force(docs.collect())


@pytest.mark.parametrize(("limit", "frequent", "block"), [(48, 48, 256), (2, 3, 8), (1, 2, 3)])
def test_families_by_brute_force_at_every_limit(spark, limit, frequent, block):
    docs = documents(spark, near_copies(2, 250, (3, 90), 3) + [doc(1000 + k, " ".join(f"s{k % 5}{i}" for i in range(k % 7))) for k in range(60)])
    assert rows_of(m.join(docs, limit, frequent, block)) == brute_force(docs.collect())


def test_given_documents_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(m.join(docs)) == brute_force(docs.collect())


def test_sketches_never_rule_out_a_link():
    draw, out = random.Random(4), 0
    for _ in range(400):
        n = draw.randint(1, 300)
        base = np.array([draw.getrandbits(64) for _ in range(n)], "u8")
        other = np.concatenate([base[draw.randint(0, n // 5) :], np.array([draw.getrandbits(64) for _ in range(draw.randint(0, n // 4))], "u8")])
        may = m.may_link(m.sketch(base), m.sketch(other), len(base) + len(other))
        common = len(np.intersect1d(base, other))
        assert may or not m.linked(common, len(base), len(other))
        out += not may
    assert out > 50


def words_of(n, seed):
    draw = random.Random(seed)
    return [f"t{draw.randrange(10 ** 9)}" for _ in range(n)]


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_linked_sets_share_a_signature_at_any_levels(share):
    draw, met = random.Random(9), 0
    for k in range(400):
        n = draw.randint(1, 400)
        base = np.unique(np.array([draw.getrandbits(64) for _ in range(n)], "u8"))
        cut = draw.randint(0, m.may_miss(len(base)))
        other = np.unique(np.concatenate([np.array(draw.sample(base.tolist(), len(base) - cut), "u8"), np.array([draw.getrandbits(64) for _ in range(draw.randint(0, cut + 1))], "u8")]))
        common = len(np.intersect1d(base, other))
        if not m.linked(common, len(base), len(other)):
            continue
        both = np.union1d(base, other)
        heavy = np.array(draw.sample(both.tolist(), int(share * len(both))), "u8")
        levels = m.Levels(heavy, np.array([draw.choice([50, 5000]) for _ in heavy], "i8"))
        assert len(np.intersect1d(m.signatures(base, levels), m.signatures(other, levels))), k
        met += 1
    assert met > 100


def test_tokens_are_those_of_the_words_whatever_stands_beside():
    texts = ["A b  c\td e", "a B c d E f", "", " ", "x", "Äb c", "äb c", "a b c"]
    sets = m.sets_of([t.encode() for t in texts])
    assert [len(s) for s in sets] == [2, 3, 0, 0, 1, 1, 1, 1]
    assert set(sets[0].tolist()) <= set(sets[1].tolist())
    assert sets[5] != sets[6]
    long_text = " ".join(words_of(300_000, 1))
    assert np.array_equal(m.sets_of([long_text.encode()])[0], m.sets_of([b"q", long_text.encode(), b"r"])[1])


def test_empty_table(spark):
    assert m.join(documents(spark, [])).count() == 0
