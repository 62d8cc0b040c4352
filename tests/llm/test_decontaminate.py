import random
import re

from folioscope.llm import decontaminate as dec

from .helpers import DOCS, awkward, doc, documents, rows_of

BENCH = "item_id long, text string"


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(tokens, width):
    return {" ".join(tokens[i : i + width]) for i in range(len(tokens) - width + 1)}


def plain(docs, items):
    out = {}
    for doc_id, text in docs:
        for item_id, item in items:
            width = min(5, len(words(item)))
            if width:
                own = shingles(words(item), width)
                n = len(own & shingles(words(text), width))
                if 100 * n >= 80 * len(own):
                    out[doc_id, item_id] = max(out.get((doc_id, item_id), (0.0,)), (n / len(own), len(own), n))
    return sorted(((d, i, n, s, c) for (d, i), (c, n, s) in out.items()), key=repr)


def test_pairs_by_brute_force(spark):
    draw, vocabulary = random.Random(4), [f"w{i}" for i in range(40)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([1, 2, 4, 5, 6, 9, 14, 30, 61])))) for i in range(40)]
    docs = []
    for d in range(120):
        text = draw.choices(vocabulary, k=draw.randint(0, 80))
        if d % 2:
            passage = draw.choice(items)[1].split()
            for _ in range(draw.choice([0, 0, 1, 2])):
                passage[draw.randrange(len(passage))] = "changed"
            text[len(text) // 2 : len(text) // 2] = passage
        docs.append((d, ", ".join(text).title() if d % 3 else " ".join(text)))
    docs += [(7, docs[9][1]), (7, docs[9][1])]
    got = dec.contained(documents(spark, [doc(*d) for d in docs]), spark.createDataFrame(items, BENCH))
    want = plain(docs, items)
    assert want and rows_of(got) == want


def test_sketches_guarantee_a_hit():
    for n in range(1, 300):
        upper = 2 ** n.bit_length() - 1
        k = min(n, upper - (upper * dec.THRESHOLD + 99) // 100 + 1)
        lost = n - (n * dec.THRESHOLD + 99) // 100
        assert k > lost


def test_awkward_rows_and_shuffled_sides(spark, monkeypatch):
    docs, items = awkward(spark), [(1, "quick brown fox jumps over the lazy"), (1, None), (2, ""), (None, "nobody owns this text"), (3, "???"), (4, "word end")]
    bench = spark.createDataFrame([(*i, "x") for i in items], BENCH + ", source string").withColumnRenamed("source", "doc_id")
    clash = docs.withColumnRenamed("source", "body").withColumnRenamed("lang", "words")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], items)
    assert len(want) == 4
    for limit in (dec.BROADCAST_ROWS, 0):
        monkeypatch.setattr(dec, "BROADCAST_ROWS", limit)
        assert rows_of(dec.contained(clash, bench)) == want
        kept = dec.drop_contaminated(clash, bench)
        assert kept.columns == clash.columns
        assert sorted(map(repr, kept.collect())) == sorted(map(repr, [r for r in clash.collect() if r.doc_id not in (1, 2, 6) and "nobody" not in (r.text or "")]))


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], BENCH)
    assert dec.contained(docs, bench).count() == 0
    assert dec.contained(awkward(spark), bench).count() == 0
    assert dec.drop_contaminated(awkward(spark), bench).count() == awkward(spark).count()
    assert dec.contained(docs, spark.createDataFrame([(1, "some words of an item")], BENCH)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = awkward(spark)
    plan = dec.search(docs, spark.createDataFrame([((1, 2), "a b c d e f g")], "item struct<item_id:long,body:long>, text string"), 5)
    assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()
