import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import chat, hnsw, urls

RULES = [urls.Rule.site(v, t) for v, t in [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]]
URLS = [
    "http://example.net/en/1", "https://WWW.Example.NET/de/1?x=/en/", "http://net/", "http://net", "http://notnet/", "http://evil.com/a.net/x", "http://a.example.com/de/",
    "http://xexample.com/de/", "http://example.com/de", "http://b.org/fr/é#top", "HTTP://B.ORG/FR/", "no scheme.net/", "://x.net/", "http://", None, "", "http://example.net/en/" + "y" * 3000,
    "http://ÄÖ.net/\U0001F600", "a\nb://c.net/z\ny", "ftp://u:p@h.net:80/q://r",
]


def plain_url(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(r.name), r) for r in RULES if (host == r.name.partition("/")[0] or host.endswith("." + r.name.partition("/")[0])) and path.startswith("/" + r.name.partition("/")[2])]
    best = max(fits, key=lambda x: x[0])[1] if fits else None
    return host, path, best and best.name, best.verdict if best else "allow"


def test_url_verdicts_by_brute_force(spark):
    pages = spark.createDataFrame([(i % 18, u, "h", "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, judged string")
    got = sorted(map(repr, (tuple(r) for r in urls.judge(pages.select("page_id", "url"), RULES).collect())))
    assert got == sorted(repr((i % 18, u, *plain_url(u))) for i, u in enumerate(URLS))
    assert urls.judge(pages, RULES).columns == ["page_id", "url", "html", "judged", "host", "path", "rule", "verdict"]
    assert urls.judge(pages.limit(0), RULES).count() == 0 and urls.judge(pages, []).filter("rule is not null").count() == 0


def test_automaton_by_regular_expressions(monkeypatch):
    monkeypatch.setattr(urls, "BLOCK_BYTES", 50)
    draw = random.Random(2)
    for _ in range(40):
        globs = ["".join(draw.choice("ab/.?*%") for _ in range(draw.randint(0, 30))) for _ in range(draw.randint(0, 12))]
        rules = [urls.Rule("block", f"{k:03}", g) for k, g in enumerate(globs)]
        texts = ["".join(draw.choice("ab/.") for _ in range(draw.randint(0, 12))) for _ in range(30)]
        forms = [re.compile("".join({"*": ".*", "%": "[^/]*", "?": "."}.get(c, re.escape(c)) for c in g), re.DOTALL) for g in globs]
        want = [next((k for k, f in enumerate(forms) if f.fullmatch(t)), -1) for t in texts]
        assert urls.Automaton(rules).run([t.encode() for t in texts]).tolist() == want


TURNS = "conv_id long, turn long, role string, text string, extra string"


def plain_chat(turns):
    by, out = {}, []
    for conv, turn, role, text, _ in turns:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, rows in by.items():
        rows.sort()
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in rows).encode()).hexdigest()
        said = "".join(t for *_, r, t in rows if r == "assistant")
        out.append((conv, len(rows), sha, len(said), hashlib.sha256(said.encode()).hexdigest(), False))
    return sorted(out, key=repr)


HARD = ["\\### Assistant: </turn> ok", "", None, "### ", "#### ### x", "</turn", "<\\/turn>", "\\", "a\\", "</turn>\n### user: hi</turn>\n", "\ue000", "é\U0001F600\n", ": ", "<", "\\\\### "]


@pytest.mark.parametrize("block", [64, 2])
def test_conversations_read_back(spark, block):
    draw, rows = random.Random(6), []
    for conv in [*range(30), None]:
        for turn in range(draw.randint(1, 9)):
            rows.append((conv, draw.choice([turn, turn, None, 1]), draw.choice(["user", "assistant", "assistant", "system", None, "a: b", "### x\\"]), draw.choice(HARD), "x"))
    rows += rows[:5]
    turns = spark.createDataFrame(rows, TURNS).withColumnRenamed("extra", "formatted")
    template = chat.MarkedTurns()
    got = chat.digests(chat.format_conversations(turns, template, block), template).drop("formatted_chars")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_chat(rows)


def test_no_conversations(spark):
    template = chat.MarkedTurns()
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], TURNS), template), template).count() == 0


def test_templates_that_rewrite_history_are_found():
    def forgetful(turns, first=0):
        """Keeps what the assistant thinks only in the last turn."""
        return "".join(f"[{r}] {t if k == len(turns) - 1 else t.split('THINK')[0]}\n" for k, (r, t) in enumerate(turns))

    text, spans, rewrites = chat.render(forgetful, [("user", "hi"), ("assistant", "fine THINK deep"), ("user", "so")], 0)
    assert rewrites and [s["located"] for s in spans] == [True, False, True]
    text, spans, rewrites = chat.render(chat.MarkedTurns(), [("user", "hi"), ("assistant", "fine")], 0)
    assert not rewrites and [text[s["text_start"] : s["text_end"]] for s in spans] == ["hi", "fine"]
    assert "".join(text[s["start"] : s["end"]] for s in spans) == text


def long_template(name):
    """Made in a function, so that workers get it by value."""

    def thoughtless(turns, first=0):
        """Keeps what the assistant thinks only in its last turn."""
        last = max((k for k, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
        return "<s>" + "".join(f"[{r}] {t if k == last else t.split('THINK')[0]}\n" for k, (r, t) in enumerate(turns))

    def recent(turns, first=0):
        """Drops old turns."""
        return "".join(f"[{r}] {t}\n" for r, t in turns[-3:])

    def headed(turns, first=0):
        return f"{len(turns) // 4}\n" + "".join(f"[{r}] {t}\n" for r, t in turns)

    def appending(turns, first=0):
        return "<s>" + "".join(f"[{first + k} {r}] {t}\n" for k, (r, t) in enumerate(turns))

    return {"thoughtless": thoughtless, "recent": recent, "headed": headed, "appending": appending}[name]


@pytest.mark.parametrize("name, rewrites", [("thoughtless", True), ("recent", True), ("headed", True), ("appending", False)])
def test_long_conversations_are_rendered_whole(spark, name, rewrites):
    template = long_template(name)
    said = [("assistant" if k % 2 else "user", f"turn {k:03}" + " THINK deep" * (k % 4 == 1)) for k in range(150)]
    turns = spark.createDataFrame([(1, k, r, t, "x") for k, (r, t) in enumerate(said)] + [(2, 0, "user", "hi", "x")], TURNS)
    for block in (4, 64):
        got = chat.format_conversations(turns, template, block).filter("conv_id = 1").orderBy("block").collect()
        text, spans, _ = chat.render(template, said, 0)
        assert "".join(r["formatted"] for r in got) == text == template(said)
        assert {r["rewrites"] for r in got} == {rewrites}
        found = [(s["located"], r["formatted"][s["text_start"] : s["text_end"]]) for r in got for s in r["spans"]]
        assert [f for f, _ in found] == [s["located"] for s in spans] and len(found) == len(said)
        assert all(part == t for (f, part), (_, t) in zip(found, said) if f)
        assert all(f for f, _ in found) != rewrites
        assert [r["first_turn"] for r in got] == ([0] if rewrites else list(range(0, 150, block)))


EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def plain_nearest(rows, k=5):
    by = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by[i] = min(by.get(i, tuple(v)), tuple(v))
    out = []
    for q, v in by.items():
        if q % 50 == 0:
            a = np.array(v, dtype=np.float32).astype(float)
            scored = []
            for i, w in by.items():
                if i != q and len(w) == len(v):
                    b = np.array(w, dtype=np.float32).astype(float)
                    scored.append((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 9), i))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(1500, 16))
    points[700:1100] = points[5]
    points[1100:1300] = points[6] + 0.02 * rng.normal(size=(200, 16))
    rows = [(i, p.astype(np.float32).tolist(), 0) for i, p in enumerate(points)]
    rows += [(2000, None, 0), (2050, [0.0] * 16, 0), (2100, [float("nan")] * 16, 0), (2150, [None] + [1.0] * 15, 0), (2200, [], 0), (None, [1.0] * 16, 0)]
    rows += [(2250, [1.0, 2.0], 0), (2251, [2.0, 4.0], 0), (2252, [-1.0, 0.5], 0), (0, rows[0][1], 0), (50, rows[50][1], 1)]
    want = plain_nearest(rows)
    frame = spark.createDataFrame(rows, EMBEDDINGS).withColumnRenamed("label", "shard")
    for shard_rows in (4096, 300):
        got = [(r[0], r[1], r[2], round(r[3], 9)) for r in hnsw.nearest(frame, F.col("vec_id") % 50 == 0, 5, shard_rows=shard_rows).collect()]
        assert {(q, r) for q, r, *_ in got} == {(q, r) for q, r, *_ in want}
        pairs = {(q, i) for q, _, i, _ in want}
        assert len(pairs & {(q, i) for q, _, i, _ in got}) >= 0.95 * len(pairs)
        assert all([s for q2, _, _, s in sorted(got) if q2 == q] == sorted((s for q2, _, _, s in got if q2 == q), reverse=True) for q, *_ in got)


def test_no_vectors(spark):
    assert hnsw.nearest(spark.createDataFrame([], EMBEDDINGS), F.col("vec_id") % 50 == 0).count() == 0
