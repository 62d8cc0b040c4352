"""Operators against brute force on small tables."""

from collections import defaultdict
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import directives as dr
from folioscope.operators import archive as ar
from folioscope.operators import chunking as ch
from folioscope.operators import cluster as cl
from folioscope.operators import excerpt as x
from folioscope.operators import graph as g
from folioscope.operators import incremental as inc
from folioscope.operators import limiter as lim
from folioscope.operators import rules as ru
from folioscope.operators import textindex as ti
from folioscope.operators import vectors as vx
from folioscope.session import cut, new_folder
from folioscope.sources import corpus as c
from folioscope.sources import files as fs
from folioscope.streaming import jobs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- retrieval --------------------------------------------------------------

def test_bm25_plans_agree(spark, sf):
    q, i = c.sentences(spark, sf), cut(ti.tokenise(c.lines(spark, sf)))
    a, b = ti.bm25_topn(q, i, 20), ti.bm25_topn(q, i, 20, block=7)
    cols = ["query_id", "chunk_id", "kw_rank", F.round("kw_score", 6)]
    assert rows(a.select(*cols)) == rows(b.select(*cols)) != []


def test_knn_plans_agree_with_brute_force(spark, sf):
    v, q = c.vectors(spark, sf), c.requests(spark, sf)
    a = vx.knn_topn(q, v, 7).select("query_id", "chunk_id", "vec_rank")
    assert rows(a) == rows(vx.knn_topn(q, v, 7, block=7).select("query_id", "chunk_id", "vec_rank"))
    vs = {r["chunk_id"]: np.array(r["embedding"], dtype=float) for r in v.collect()}
    first = q.filter("embedding is not null").first()
    e = np.array(first["embedding"], dtype=float)
    best = sorted((round(1 - float(e @ w) / np.linalg.norm(e) / np.linalg.norm(w), 9), k) for k, w in vs.items())[:7]
    got = sorted((r["vec_rank"], r["chunk_id"]) for r in a.filter(F.col("query_id") == first["query_id"]).collect())
    assert [k for _, k in got] == [k for _, k in best]


def test_top_n_is_cut_before_the_final_sort(spark, sf):
    plan = vx.knn_topn(c.requests(spark, sf), c.vectors(spark, sf), 7)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_search_broadcasts_nothing_by_hint(spark, sf):
    from folioscope.plans.search import hybrid_search
    from folioscope.sources import notes as src

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        hits, _ = hybrid_search(c.requests(spark, sf), c.corpus(spark, sf), src.NOW, block=7)
        assert "Broadcast" not in hits._jdf.queryExecution().executedPlan().toString()
        few = rows(hits.select("query_id", "rank", "chunk_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert few == rows(hybrid_search(c.requests(spark, sf), c.corpus(spark, sf), src.NOW)[0].select("query_id", "rank", "chunk_id")) != []


def test_stemming_on_both_sides(spark):
    docs = spark.createDataFrame([(1, "running runs"), (2, "walk"), (3, "a relational hope"), (4, None)], "chunk_id long, text string")
    index = ti.tokenise(docs, stemming=True)
    assert rows(index.filter("chunk_id < 4").select("chunk_id", F.array_join("tokens", " "))) == [(1, "run run"), (2, "walk"), (3, "a relat hope")]
    asked = spark.createDataFrame([(7, "running"), (8, "Walks hopeful"), (9, "nothing")], "query_id long, query string")
    found = ti.bm25_topn(asked, index, 5, stemming=True)
    assert rows(found.select("query_id", "chunk_id")) == [(7, 1), (8, 2), (8, 3)]


def test_porter_examples():
    from folioscope.functions.porter import stem

    pairs = "caresses caress ponies poni agreed agre plastered plaster sing sing conflated conflat hopping hop falling fall filing file happy happi sky sky"
    pairs += " relational relat vietnamization vietnam sensibiliti sensibl triplicate triplic goodness good replacement replac adoption adopt cease ceas controll control roll roll"
    words = pairs.split()
    assert [stem(w) for w in words[::2]] == words[1::2]


# ---- graph ------------------------------------------------------------------

def belief(i, state="promoted", persona="cto", **kw):
    base = dict(belief_id=i, rel_path=f"{i}.md", persona=persona, state=state, subject=f"s-{i}", claim="c", confidence="", impact="",
                created="2026-07-01", promoted_at="", verify_by="", countersigned_by="")
    return {**base, **kw}


def gate_of(spark, beliefs, evidence, docs, supersessions=()):
    b = spark.createDataFrame(beliefs, ", ".join(f"{k} string" for k in beliefs[0]))
    e = spark.createDataFrame([(i, r, "external" if "://" in r else "link", ok, "" if "://" in r else r) for i, r, ok in evidence],
                              "belief_id string, ref string, kind string, verified boolean, slug string")
    d = spark.createDataFrame(list(docs.items()), "slug string, author string")
    s = spark.createDataFrame(list(supersessions), "src_path string, tgt_slug string")
    checks = g.gate(b, e, cut(g.resolve_evidence(e, d, b)), s, "2026-07-27")
    out = defaultdict(dict)
    for row in checks.collect():
        out[row["belief_id"]][row["code"]] = (row["passed"], row["detail"])
    return out


def test_five_restatements_are_one_root(spark):
    bs = [belief("top", confidence="high")] + [belief(f"r{i}") for i in range(5)]
    ev = [("top", f"r{i}", True) for i in range(5)] + [(f"r{i}", "note", True) for i in range(5)]
    got = gate_of(spark, bs, ev, {"note": ""})
    assert got["top"]["G4"] == (False, "1 distinct root(s), needs 2")
    assert got["r0"]["G4"][0] is True


def test_self_citation_and_diamond_count_as_cycles(spark):
    bs = [belief(i) for i in ("self", "a", "b", "c", "d", "ok")]
    ev = [("self", "self", True), ("a", "b", True), ("a", "c", True), ("b", "d", True), ("c", "d", True), ("d", "note", True), ("ok", "d", True)]
    got = gate_of(spark, bs, ev, {"note": ""})
    assert got["self"]["G2"][0] is False and got["self"]["G3"][0] is False
    assert got["a"]["G2"] == (False, "self-citation cycle via d")
    assert got["ok"]["G2"][0] is True and got["ok"]["G3"] == (True, "nearest observation 2 hop(s) away")


def test_gate_defects(spark):
    bs = [belief("x", verify_by="2026-07-26"), belief("y", impact="action", countersigned_by="cto"), belief("z", subject="s-x", claim="")]
    ev = [("x", "nowhere", True), ("x", "https://e.test", False), ("y", "note", True), ("y", "https://e.test", True), ("z", "draft", True)]
    got = gate_of(spark, bs + [belief("draft", state="draft")], ev, {"note": "cto"}, [("z.md", "x")])
    assert got["x"]["G1"] == (False, "unresolved: nowhere; external not attested: https://e.test")
    assert got["x"]["G7"][0] is False and got["x"]["G5"][0] is False
    assert got["y"]["G7a"] == (False, "countersigned by its own author") and got["y"]["G4"][0] is True
    assert got["z"]["G2"][0] is False and got["z"]["G5"][0] is True and got["z"]["G6"] == (False, "missing: claim")


def distances(steps, starts):
    after, out = defaultdict(set), []
    for a, b in steps:
        after[a].add(b)
    for start in starts:
        seen, level, n = {start: 0}, [start], 0
        while level:
            n += 1
            level = [y for y in {y for x in level for y in after[x]} if y not in seen]
            seen.update(dict.fromkeys(level, n))
        out += [(start, node, dist) for node, dist in seen.items()]
    return sorted(out)


@pytest.mark.parametrize("seed, nodes, steps", [(1, 40, 60), (2, 30, 150), (3, 60, 50), (4, 5, 0)])
def test_distances_do_not_depend_on_the_hops_of_a_round(spark, seed, nodes, steps):
    rng = np.random.default_rng(seed)
    pairs = [(f"b{a}", f"b{b}") for a, b in rng.integers(0, nodes, (steps, 2))]
    starts = [f"b{n}" for n in range(0, nodes, 1 + seed % 2)]
    e = spark.createDataFrame([(a, b, "belief") for a, b in pairs] + [("b0", "note", "observation")], "belief_id string, slug string, target string")
    st = spark.createDataFrame([(x,) for x in starts * 2], "belief_id string")
    for hops in (1, 2, 8):
        assert rows(g.reach(e, st, hops)) == distances(pairs, starts)


def test_a_chain_of_a_hundred_hops_with_a_way_back(spark):
    pairs = [(f"b{n}", f"b{n + 1}") for n in range(100)] + [("b100", "b40"), ("b3", "b20")]
    e = spark.createDataFrame([(a, b, "belief") for a, b in pairs], "belief_id string, slug string, target string")
    st = spark.createDataFrame([("b0",), ("b50",)], "belief_id string")
    assert rows(g.reach(e, st)) == distances(pairs, ["b0", "b50"])


# ---- chunking ---------------------------------------------------------------

def test_split_tables_keep_their_header():
    table = ["| a | b |", "|---|---|"] + [f"| {i} | word word word |" for i in range(120)]
    chunks = ch.cut_document("# T\n\n" + "\n".join(table), size=128, overlap=16)
    assert len(chunks) > 3
    assert all("| a | b |\n|---|---|" in text for text, _, _ in chunks)
    seen = [ln for text, _, _ in chunks for ln in text.split("\n") if ln.startswith("| ") and ln != "| a | b |"]
    assert seen == table[2:]
    assert [p for _, _, p in chunks][:2] == ["", "T"]


def test_whole_lines_and_ancestry():
    body = "# Top\nintro\n## One\n" + "\n".join(f"line {i} has some words" for i in range(60)) + "\n## Two\nend"
    chunks = ch.cut_document(body, size=64, overlap=8)
    lines = set(body.split("\n"))
    assert all(ln in lines for text, _, _ in chunks for ln in text.split("\n"))
    assert chunks[-1][2] == "Top" and lines <= {ln for text, _, _ in chunks for ln in text.split("\n")} | {""}
    wide = ch.cut_document(" ".join(["w"] * 1000), size=100, overlap=20)
    assert sum(n for _, n, _ in wide) > 1000 and all(n <= 100 for _, n, _ in wide)


# ---- excerpts ---------------------------------------------------------------

def test_best_window_against_every_window(spark):
    rng, rows_in, want = np.random.default_rng(1), [], {}
    terms = ["alpha", "gamma"]
    for k in range(50):
        lines = [" ".join(rng.choice(["alpha", "beta", "filler", "gamma"], rng.integers(0, 9))) for _ in range(30)]
        rows_in.append((k, "\n".join(lines), terms))
        scores, best = [len(set(ln.split()) & set(terms)) for ln in lines], None
        for a in range(30):
            fits = [b for b in range(a + 1, 31) if sum(map(len, lines[a:b])) + b - a - 1 <= 60]
            b = max(fits, default=a)
            s = sum(scores[a:b]) if fits else scores[a]
            if best is None or s > best[0]:
                best = (s, a, b)
        want[k] = best
    df = spark.createDataFrame(rows_in, "k int, text string, terms array<string>")
    assert {r["k"]: (r["gain"], r["i"], r["stop"]) for r in x.best_windows(df, ["k"], "text", "terms", 64).collect()} == want


def test_excerpts_are_bounded_and_keep_every_occurrence(spark):
    line = "x " * 500 + "the needle here " + "y " * 500
    many = "needle " + "z " * 300 + "needle " * 70 + "end " * 300
    df = spark.createDataFrame([(1, "\n" * 16350 + "needle"), (2, line), (3, "short"), (4, ""), (5, "a\n" * 500 + line), (6, many)], "k int, text string")
    got = {r["k"]: r["e"] for r in x.excerpts(df, ["k"], "text", F.array(F.lit("needle")), 700, "e").collect()}
    assert all(len(e) <= 704 for e in got.values()) and got[3] == "short" and got[4] == "" and got[1] == "needle"
    assert "needle" in got[2] and "needle" in got[5] and got[2][0] == got[2][-1] == "…" and got[6].count("needle") == 70
    cut = x.cut_lines(df.filter("k = 2").withColumn("terms", F.array(F.lit("needle"))), ["k"], "text", budget=80).first()["cut"]
    assert "needle" in cut and len(cut) <= 80 and cut[0] == cut[-1] == "…"


def test_overlapping_terms_count_every_place(spark):
    df = spark.createDataFrame([(1, "anananan xx an", ["anan", "an"])], "k int, line string, terms array<string>")
    assert sorted(r["at"] for r in x.occurrences(df, ["k"], "line", "terms").collect()) == [0, 0, 2, 2, 4, 4, 6, 12]


# ---- groups -----------------------------------------------------------------

def leader_brute(vectors, t, size):
    clusters = []
    for k, vec in sorted(vectors.items()):
        vec = vec / np.linalg.norm(vec)
        for cset in clusters:
            if len(cset[1]) < size and round(float(vec @ cset[0]) / np.linalg.norm(cset[0]), 9) >= t:
                cset[0] = cset[0] + vec
                cset[1].append(k)
                break
        else:
            clusters.append([vec, [k]])
    return sorted((m[0], k) for _, m in clusters if len(m) > 1 for k in m)


def test_groups_and_leader_clusters(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    vec = {i: base[i % 12] + rng.normal(size=16) * 0.25 for i in range(90)}
    vec.update({100 + i: vec[5] for i in range(30)})
    df = spark.createDataFrame([(k, [float(z) for z in w]) for k, w in vec.items()], "chunk_id long, embedding array<double>")
    assert rows(cl.leader_clusters(cl.leader_blocks(df))) == leader_brute(vec, 0.92, 20)
    unit = {k: w / np.linalg.norm(w) for k, w in vec.items()}
    parent = {k: k for k in vec}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for p, q in itertools.combinations(sorted(vec), 2):
        if round(float(unit[p] @ unit[q]), 9) >= 0.92:
            a, b = sorted((root(p), root(q)))
            parent[b] = a
    want = defaultdict(list)
    for k in sorted(vec):
        want[root(k)].append(k)
    expect = sorted((r, i // 20, k) for r, ks in want.items() if len(ks) > 1 for i, k in enumerate(ks))
    assert rows(cl.groups(df)) == expect


def clustered(seed, n, centres, dim=12, noise=0.08):
    """Vectors around far centres, exact copies among them, in ids that tell nothing."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, dim))
    vec = {int(k): base[k % centres] + rng.normal(size=dim) * noise * (k % 3) for k in rng.permutation(n * 3)[:n]}
    some = sorted(vec)[:: max(1, n // 40)]
    vec.update({100_000 + k: vec[k] for k in some})
    return vec


@pytest.mark.parametrize("seed, centres, noise, threshold", [(1, 9, 0.08, 0.92), (2, 3, 0.3, 0.92), (3, 40, 0.2, 0.8), (4, 1, 0.5, 0.99)])
def test_cells_lose_no_pair_and_meet_once(spark, seed, centres, noise, threshold):
    vec = clustered(seed, 240, centres, noise=noise)
    ids = sorted(vec)
    unit = {k: vec[k] / np.linalg.norm(vec[k]) for k in ids}
    near = defaultdict(dict)
    for p, q in itertools.combinations(ids, 2):
        c = round(float(unit[p] @ unit[q]), 9)
        if c >= threshold:
            near[p][q] = near[q][p] = c
    odd = [(-1, [0.0] * 12), (-2, None), (-3, [float("nan")] * 12)]
    df = spark.createDataFrame([(k, [float(z) for z in vec[k]]) for k in ids] + odd, "chunk_id long, embedding array<double>")
    want = [(k, len(v), min(v), round(max(v.values()), 6)) for k, v in sorted(near.items())]
    for options in ({}, {"block": 16}, {"block": 50, "pivots": 11}):
        got = cl.partners(df, threshold, **options).select("chunk_id", "n_partners", "first_partner", "best_cos")
        assert [(*r[:3], round(r[3], 6)) for r in rows(got)] == want
    files = {k: f"f{k % 4}" if k < 100_000 else "copies" for k in ids}
    joined = df.join(spark.createDataFrame(list(files.items()), "chunk_id long, rel_path string"), "chunk_id")
    merge = []
    for k in ids:
        others = {q: c for q, c in near[k].items() if files[q] != files[k]}
        if others:
            top = max(others.values())
            merge.append((k, min(q for q, c in others.items() if c == top), round(top, 6), len(others)))
    for options in ({}, {"block": 16, "pivots": 7}):
        got = cl.merge_candidates(joined, threshold, **options).select("chunk_id", "merge_with", "cosine", "n_partners")
        assert [(*r[:2], round(r[2], 6), r[3]) for r in rows(got)] == merge


def test_far_cells_never_meet(spark):
    vec = clustered(1, 600, 12, noise=0.05)
    df = spark.createDataFrame([(k, [float(z) for z in v]) for k, v in vec.items()], "chunk_id long, embedding array<double>")
    m = cl.meetings(df, 0.92, block=50, pivots=12).first()
    assert m.n_pairs == len(vec) * (len(vec) - 1) / 2 and m.skipped > 0.8 and m.skipped == 1 - m.n_met / m.n_pairs
    assert cl.meetings(df, 0.92, block=50, pivots=1).first().skipped == 0
    assert tuple(cl.meetings(df.limit(0)).first()) == (0.0, 0.0, 0.0)
    assert cl.partners(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(rows(cl.components(e)))
    assert {got[i] for i in range(41)} == {0} and got[101] == got[100] == 100


# ---- limiter ----------------------------------------------------------------

def passes(events, limit, seconds):
    passed, out = defaultdict(list), []
    for i, k, at in sorted(events, key=lambda z: (z[1], z[2], z[0])):
        passed[k] = [p for p in passed[k] if at - p <= seconds * 1_000_000]
        out.append((i, len(passed[k]) < limit))
        if out[-1][1]:
            passed[k].append(at)
    return sorted(out)


@pytest.mark.parametrize("seed, limit", [(5, 3), (6, 1), (7, 6), (8, 0)])
def test_limiter_by_brute_force(spark, seed, limit):
    rng = np.random.default_rng(seed)
    # whole seconds, so that requests meet on one time and on the window's edge; both sides of a bucket's end
    ev = [(i, int(k), int(at) * 1_000_000) for i, (k, at) in enumerate(zip(rng.choice([1, 1, 1, 2, 3], 900), rng.integers(-4_000, 5_000, 900)))]
    df = spark.createDataFrame(ev, "event_id long, key long, at long")
    got = rows(lim.limit_requests(df, limit, 60))
    assert got == passes(ev, limit, 60)
    counted = {i: sum(k2 == k and at - 60_000_000 <= at2 <= at for _, k2, at2 in ev) for i, k, at in ev}
    assert dict(rows(lim.request_window(df, 60).select("event_id", "recent"))) == counted


def test_limiter_deals_a_key_without_a_pause_to_several_tasks(spark):
    """One key, a request every ten seconds for hours, and a burst now and then: no pause is as long as the window."""
    at = [10 * n for n in range(6_000)] + [10_000 * b + n for b in range(1, 6) for n in range(0, 200, 2)]
    ev = [(i, 1, t * 1_000_000) for i, t in enumerate(at)]
    df = spark.createDataFrame(ev, "event_id long, key long, at long")
    assert lim.quiet_runs(df, 60).select("run").distinct().count() == 1
    d = lim.overloaded_stretches(df, 10, 60)
    assert d.filter("run is not null").select("run").distinct().count() == 5
    assert d.filter("run is null").count() > 5_000 and d.count() == len(ev)
    tasks = d.filter("run is not null").repartition(4, "key", "run").select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks > 1
    assert rows(lim.limit_requests(df, 10, 60)) == passes(ev, 10, 60)


# ---- guidance, import, archive ---------------------------------------------

def test_labelled_rules_meet_the_bar(spark):
    rules = [
        ("deploy", "Never deploy on a Friday. Always announce the deployment window first."),
        ("secrets", "Do not paste credentials into tickets; use the vault instead."),
        ("backup", "Before dropping a table, verify the nightly backup completed."),
        ("review", "Always request two reviewers before merging migrations."),
    ]
    cases = [("deploying the gateway this Friday", "deploy"), ("paste the credential into ticket 7", "secrets"), ("drop the staging table, no backup", "backup"),
             ("merge the migration with one reviewer", "review"), ("rename a local variable", ""), ("update the holiday calendar", ""), ("write release poems", "")]
    hits = [(i, act, f"{n}.md", "feedback", text, j) for i, (act, _) in enumerate(cases) for j, (n, text) in enumerate(rules)]
    hits += [(i, act, "other.md", "project", "Never " + act, 9) for i, (act, _) in enumerate(cases)]
    df = spark.createDataFrame(hits, "action_id int, action string, rel_path string, doc_type string, text string, pos int")
    warned = {(r["action_id"], r["rel_path"]) for r in ru.check_actions(df).collect()}
    assert all(path != "other.md" for _, path in warned)
    found = [any(w == (i, f"{n}.md") for w in warned) for i, (_, n) in enumerate(cases) if n]
    assert sum(found) / len(found) >= 0.75
    assert not [w for w in warned if not cases[w[0]][1]]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def rule_rows(spark):
    text = "Never ship the red bolt without a receipt.\nStored.\nAlways verify-early the invoices: shipping!"
    hits = [(1, "shipping the unverified invoice", "a.md", "feedback", text, 1), (1, "shipping the unverified invoice", "b.md", "feedback", "Never ship bolts twice.", 2),
            (1, "shipping the unverified invoice", "c.md", "project", None, 3), (2, None, "a.md", "feedback", text, 1), (None, "ship", "a.md", "feedback", text, 1)]
    return spark.createDataFrame(hits, "action_id int, action string, rel_path string, doc_type string, text string, pos int").repartition(3)


def test_rules_of_an_action_meet_in_one_shuffle(spark):
    df = rule_rows(spark)
    assert shuffles(ru.check_actions(df)) == 2 and shuffles(ru.rule_idf(df)) == 2  # one is the table's own
    texts = {x: set(dr.word_reader()((x or "").lower())) for x in (r["text"] for r in df.collect())}
    got = {}
    for action, token, idf, default in ru.rule_idf(df).collect():
        got.setdefault(action, {})[token] = idf, default
    assert set(got) == {1, 2}
    own = [r["text"] for r in df.collect() if r["action_id"] == 1]
    for token, (idf, default) in got[1].items():
        assert abs(idf - (math.log(4 / (sum(token in texts[x] for x in own) + 1)) + 1)) < 1e-12
        assert default == max(v for v, _ in got[1].values())
    assert set(got[1]) == set().union(*(texts[x] for x in own))
    warned = ru.check_actions(df).orderBy("rank").collect()
    assert [(r["rel_path"], r["rank"]) for r in warned if r["action_id"] == 1][:1] == [("a.md", 1)]
    assert {r["action_id"] for r in warned} == {1} and {r["rel_path"] for r in warned} <= {"a.md", "b.md"}


def test_rule_tokens_of_odd_words(spark):
    text = "--Order-12. Re-checking the x-ray..b bolts; ORDERS' (tables) a.b c-d-e éclairs"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(dr.rule_tokens("t")).collect()
    assert [r[0] for r in got] == [dr.word_reader()(text.lower()), None, []]
    assert got[0][0] == ["order-12", "order", "re-check", "check", "x-ray..b", "ray", "bolt", "tabl", "a.b", "c-d-e", "clair"]


def test_short_texts_meet_no_join(spark):
    d = spark.createDataFrame([(1, "short\n"), (2, "x " * 500 + "needle"), (3, None)], "id int, t string")
    made = x.excerpts(d, ["id"], "t", F.array(F.lit("needle")), 100)
    got = {r.id: r.excerpt for r in made.collect()}
    assert got[1] == "short" and got[3] is None and "needle" in got[2] and len(got[2]) <= 100
    assert "Union" in made._jdf.queryExecution().optimizedPlan().toString()


def docs_df(spark, rows_):
    return spark.createDataFrame([(p, f"/r/{p}", h, "t", "", "", "", "", False, "{}") for p, h in rows_],
                                 "rel_path string, abs_path string, doc_hash string, title string, doc_type string, disclosure string, evidence string, claim_date string, is_priority boolean, metadata string")


def test_missing_root_orphans_nothing(spark):
    stored, offered = docs_df(spark, [("a.md", "1"), ("b.md", "1")]), docs_df(spark, [("a.md", "2")])
    none = stored.select("abs_path").filter("false")
    assert rows(inc.survey(stored, offered, none)) == [("a.md", "CHANGED"), ("b.md", "ORPHANED")]
    gone = inc.survey(stored, offered, none, ("/r",))
    assert rows(gone) == [("a.md", "CHANGED"), ("b.md", "UNCHECKED")]
    assert inc.survey_summary(inc.survey(stored, stored, none), 0).first()["is_current"] is True
    assert inc.survey_summary(inc.survey(stored, stored, none), 1).first()["is_current"] is False


def test_prune_refuses_a_large_share(spark):
    docs = docs_df(spark, [("a.md", "1"), ("b.md", "1"), ("c/.bak", "1")])
    with pytest.raises(RuntimeError):
        inc.prune_missing(docs, docs.filter("rel_path <> 'a.md'").select("abs_path"))
    kept = docs.select("abs_path")
    assert rows(inc.prune_missing(docs, kept)) == [("c/.bak",)]
    assert rows(inc.prune_missing(docs, kept, missing_roots=("/r",))) == []


def test_fingerprint_is_compared_exactly(spark):
    d = spark.range(1).select(inc.chunker_drift(F.lit("2:512"), F.lit("20:512")).alias("a"), inc.chunker_drift(F.lit("2"), F.lit("2")).alias("b"))
    assert tuple(d.first()) == ("20:512 != 2:512", "match")


def test_tampered_and_shredded_records(spark):
    p = spark.createDataFrame([("t1", "one"), ("t2", "two"), ("t3", "three")], "txid string, payload string")
    keys = cut(ar.new_keys(p))
    sealed = cut(ar.encrypt(p, keys)).withColumn("sealed", F.when(F.col("txid") == "t2", F.concat("sealed", F.lit(b"x"))).otherwise(F.col("sealed")))
    got = ar.retrieve(sealed, keys.filter("txid <> 't3'"))
    assert rows(got.select("txid", "status")) == [("t1", "ok"), ("t2", "tampered"), ("t3", "no key")]
    assert got.filter("txid = 't1'").first()["payload"] == "one"


def test_encoder_names_and_widths(spark):
    with pytest.raises(ValueError):
        vx.encoder("nope", 8)
    chunks = spark.createDataFrame([(1, "a b")], "chunk_id long, text string")
    with pytest.raises(Exception, match="not 9 wide"):
        vx.embed(chunks, vx.encoder("hash", 8), 9).collect()
    held = {"dim": 8, "model": "hash", "provider": "built-in"}
    assert vx.embed(chunks, vx.encoder("hash", 8), 8, {"model": "hash"}, held).count() == 1
    with pytest.raises(ValueError, match="another model"):
        vx.embed(chunks, vx.encoder("hash", 8), 8, {"model": "other"}, held)
    with pytest.raises(ValueError, match="another dim"):
        vx.embed(chunks, vx.encoder("hash", 16), 16, {"model": "hash"}, held)


def test_scan_and_unreadable_metadata(spark, tmp_path):
    (tmp_path / "c" / "d").mkdir(parents=True)
    (tmp_path / "c" / "a.md").write_text("---\nname: n\nmetadata: {type: belief, date: 2026-01-02}\nsupersedes: '[[old]]'\n---\n# T\nx [[l]]\n")
    (tmp_path / "c" / "d" / "bad.md").write_text("---\nname: [x\n---\nbody\n")
    (tmp_path / "c" / "d" / "a.bak.md").write_text("x")
    (tmp_path / "c" / "note.txt").write_text("x")
    files = fs.scan_files(spark, [str(tmp_path / "c"), str(tmp_path / "missing")])
    assert rows(files.select("rel_path")) == [("a.md",), ("d/bad.md",)]
    got = {r["rel_path"]: r for r in fs.parse_documents(files).collect()}
    good, bad = got["a.md"], got["d/bad.md"]
    assert (good["title"], good["doc_type"], good["claim_date"], good["supersedes"], good["wikilinks"]) == ("n", "belief", "2026-01-02", ["old"], ["l"])
    assert bad["metadata_ok"] is False and "name: [x" in bad["body"]
