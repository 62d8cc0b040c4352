import random
import re

import numpy as np
import xxhash

from folioscope.llm import simhash

from .helpers import DOCS, awkward, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[root(i)] = root(j)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [least.get(root(k)) for k in range(len(fps))]


def test_fingerprints_and_components_by_brute_force(spark):
    docs = awkward(spark)
    rows = docs.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = sorted(((r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, plain_components([r.doc_id for r in rows], fps), strict=True)), key=repr)
    clash = docs.withColumnRenamed("lang", "fp").withColumnRenamed("source", "component_id").withColumnRenamed("n_chars", "key")
    assert rows_of(simhash.near_duplicates(clash)) == want


def near_values(seed, n):
    draw, out = random.Random(seed), []
    for _ in range(n):
        base = out[draw.randrange(len(out))] if out and draw.random() < 0.8 else draw.getrandbits(64)
        for _ in range(draw.randint(0, 6)):
            base ^= 1 << draw.randrange(64)
        out.append(base)
    return out


def test_links_lose_no_pair_also_where_buckets_are_dealt_again(spark):
    fps = near_values(3, 400)
    signed = np.array(fps, dtype="<u8").view("<i8").tolist()
    marked = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    want = plain_components(list(range(len(fps))), fps)
    for limit in (1 << 14, 3):
        classes = {r["fp"]: r["component_id"] for r in simhash.classes(marked, limit).collect()}
        assert [classes[s] for s in signed] == want


def test_a_dense_ball_is_one_component_without_all_pairs(spark):
    fps = [0] + [1 << a | 1 << b for a in range(64) for b in range(a)]
    signed = np.array(fps, dtype="<u8").view("<i8").tolist()
    marked = spark.createDataFrame([(i + 5, s) for i, s in enumerate(signed)], "doc_id long, fp long")
    assert {r["component_id"] for r in simhash.classes(marked).collect()} == {5}
    assert len(simhash.forest(np.array(fps, dtype="<u8").view("<i8"))) == len(fps) - 1


def test_one_document_of_each_group_stays_with_all_columns(spark):
    docs = awkward(spark).withColumnRenamed("lang", "spot").withColumnRenamed("source", "doc")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 6, 7, 8, 9]
    assert sum(r.doc_id is None for r in kept.collect()) == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
