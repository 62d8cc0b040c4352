import hashlib
import zlib

import numpy as np
import pytest

from folioscope.llm import merkle

from .helpers import awkward, doc, documents, rows_of


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes, fan=16):
    """Root, and per node the (left, right) siblings on its way up."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i // fan * fan
            paths[k].append(("".join(level[first:i]), "".join(level[i + 1 : first + fan])))
        level = [H("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
        at = [i // fan for i in at]
    return level[0], paths


def plain_manifest(rows):
    lower = str.maketrans(merkle.UPPER, merkle.UPPER.lower())
    by_source, out = {}, []
    for r in rows:
        head = "".join(field(v) for v in (r.doc_id, r.source, r.lang, r.n_chars))
        leaf = H(head + field(r.text))
        chosen = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        now = H(head + field(r.text.translate(lower))) if chosen and r.text is not None else leaf
        by_source.setdefault(r.source, []).append(((r.doc_id is not None, r.doc_id or 0, leaf), r.doc_id, leaf, now))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by_source[s], key=lambda x: x[0])]) for s in names}
    root, tops = plain_tree([trees[s][0] for s in names])
    for s, top in zip(names, tops, strict=True):
        for (_, doc_id, leaf, now), path in zip(sorted(by_source[s], key=lambda x: x[0]), trees[s][1], strict=True):
            folded = now
            for left, right in path + top:
                folded = H(left + folded + right)
            out.append((doc_id, leaf, trees[s][0], root, H("".join(a + b for a, b in path + top)), folded, folded == root))
    return sorted(out, key=repr)


def test_addresses_are_a_layout_of_aligned_subtrees():
    for height in range(1, 5):
        places = [merkle.address(height, d, np.arange(16**d)) for d in range(height)]
        assert sorted(np.concatenate(places)) == list(range(merkle.slots(height)))
    assert merkle.address(4, 0, 0) == 0 and merkle.address(4, 1, 3) == 4  # the upper half: a root and its sixteen
    assert [int(merkle.address(4, 2, 5)), int(merkle.address(4, 3, 5 * 16))] == [17 + 5 * 17, 17 + 5 * 17 + 1]  # then whole subtrees


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 257, 4096])
def test_blocks_give_back_runs_and_chains(n):
    leaves = [hashlib.sha256(bytes([k % 251, k // 251])).digest() for k in range(n)]
    levels = merkle.reductions(n, 3)
    nodes = merkle.lay_out(leaves, levels)
    root, paths = plain_tree([x.hex() for x in leaves])
    assert nodes[0].tobytes().hex() == root
    above, at = [("x", "y")], 0
    for run, inner, path in merkle.Block(nodes.tobytes(), n, levels).chains(above):
        for j in range(len(run)):
            own = [("".join(run[:j]), "".join(run[j + 1 :]))] if inner else []
            assert own + path == paths[at] + above
            at += 1
    assert at == n


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_by_brute_force_at_every_block_size(spark, levels):
    rows = [doc(k, f"Text {k * 7 % 11} Äß", "en", None if k % 3 == 0 else f"s{k % 4}") for k in range(400)] + [doc(10_000 + k, "T", None, f"only{k}") for k in range(40)]
    docs = documents(spark, rows)
    got = rows_of(merkle.manifest(docs, levels))
    assert got == plain_manifest(docs.collect())
    assert {r[-1] for r in got} == {True, False}


def test_awkward_rows_and_clashing_columns(spark):
    docs = awkward(spark)
    clash = docs.selectExpr("*", "1 AS tree", "2 AS pos", "'x' AS root", "3 AS block", "4 AS total")
    got = rows_of(merkle.manifest(clash))
    assert got == plain_manifest(docs.collect())
    assert len(got) == docs.count()


def test_a_single_row_proves_itself(spark):
    (row,) = merkle.manifest(documents(spark, [doc(1, "a")])).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == H("")


def test_empty_table(spark):
    assert merkle.manifest(documents(spark, [])).count() == 0
