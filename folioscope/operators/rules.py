"""Saved guidance relevant to a proposed action, and where a new note belongs."""

import math
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import directives as g
from ..functions.serving import sanitize_field
from ..params import DEFAULTS


def core_rules(text: str, actions: DataFrame) -> DataFrame:
    """Always-on guidance as one pseudo-document of every action."""
    return actions.select(
        "action_id", "action", F.lit("core (always-on doctrine)").alias("rel_path"), F.lit("feedback").alias("doc_type"),
        F.lit(text).alias("text"), F.lit(1 << 20).alias("pos"),
    ).filter(F.trim("text") != "")


def _by_action(hits: DataFrame, **columns) -> DataFrame:
    """The hits with an action and its number of hits `n`, the rows of one action side by side. It is the window of `n`
    that brings them together, so `n` has to stay; hits that come grouped by action are not shuffled again."""
    n = F.count(F.lit(1)).over(Window.partitionBy("action_id"))
    d = hits.filter("action_id is not null").select("action_id", *[c.alias(k) for k, c in columns.items()], n.alias("n"))
    return d.sortWithinPartitions("action_id")


def _groups(batches, names):
    """Lists of the values of `names`, one list of rows per action, from rows sorted by action."""
    key, held = None, []
    for batch in batches:
        values = [batch.column(c).to_pylist() for c in ("action_id", *names)]
        for at, *row in zip(*values):
            if at != key:
                if held:
                    yield key, held
                key, held = at, []
            held.append(row)
    if held:
        yield key, held


def _frequencies(texts, read, known):
    """In how many of an action's texts each token occurs. `known` holds the tokens of the action's distinct texts."""
    df = {}
    for text in texts:
        if text is not None:
            tokens = known.get(text)
            if tokens is None:
                tokens = known[text] = read(text)
            for x in tokens:
                df[x] = df.get(x, 0) + 1
    return df


def _row(**columns):
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


def _batched(rows, schema, size=4096):
    out = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def rule_idf(hits: DataFrame) -> DataFrame:
    """(action_id, token, idf, default_idf) over the documents supplied for each action."""
    d = _by_action(hits, low=F.lower("text"))
    kind = d.schema["action_id"].dataType
    out = _row(action_id=kind, n=T.LongType(), tokens=T.ArrayType(T.StringType()), df=T.ArrayType(T.LongType()))
    schema = to_arrow_schema(out)

    def counted(batches):
        read = g.word_reader()
        for action, rows in _groups(batches, ("low",)):
            df = _frequencies([r[0] for r in rows], read, {})
            if df:
                yield action, len(rows), list(df), list(df.values())

    def idf(df):
        return F.ln((F.col("n") + 1) / (df + 1)) + 1.0

    d = d.mapInArrow(lambda batches: _batched(counted(batches), schema), out)
    d = d.select("action_id", "n", idf(F.array_min("df")).alias("default_idf"), F.explode(F.arrays_zip("tokens", "df")).alias("t"))
    return d.select("action_id", F.col("t.tokens").alias("token"), idf(F.col("t.df")).alias("idf"), "default_idf")


def _related_places(y, tokens, whole):
    """Places in `tokens` of those related to `y`; `whole` is the tokens between blanks."""
    if len(y) < 5:
        return tuple(i for i, x in enumerate(tokens) if x == y)
    inside = y in whole
    return tuple(i for i, x in enumerate(tokens) if len(x) >= 5 and (x in y or (inside and y in x)))


def _rounded(x):
    """Nine places, halves up: as Spark rounds."""
    return float(Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP))


def _warnings(rows, read, floor, cap):
    """The best `cap` directive lines of one action's rows (low, action, rel_path, pos, numbers, lines, lows)."""
    texts, tokens, actions, found, sums = {}, {}, {}, [], {}
    df = _frequencies([r[0] for r in rows], read, texts)
    if not df:
        return
    idf = {x: math.log((len(rows) + 1) / (n + 1)) + 1.0 for x, n in df.items()}
    default = max(idf.values())
    for _, action, rel_path, pos, numbers, lines, lows in rows:
        if action is None or rel_path is None or pos is None or not lines:
            continue
        if action not in actions:
            a = read(action)
            actions[action] = a, " ".join(a), sum(idf.get(x, default) for x in a), {}
        a, whole, w_a, places = actions[action]
        for number, line, low in zip(numbers, lines, lows):
            r = tokens.get(low)
            if r is None:
                r = tokens[low] = read(low)
            at = set()
            for y in r:
                if y not in places:
                    places[y] = _related_places(y, a, whole)
                at.update(places[y])
            if at:
                matched = [a[i] for i in sorted(at)]
                key = rel_path, pos, number
                s = sums.setdefault(key, [0.0, 0.0, 0.0])
                s[0] += w_a
                s[1] += sum(idf.get(x, default) for x in r)
                s[2] += sum(idf.get(x, default) for x in matched)
                found.append((key, line, matched))
    best, seen = [], set()
    for key, line, matched in sorted(found, key=lambda f: f[0][1:]):
        w_a, w_r, w_matched = sums[key]
        score = w_matched / min(w_a, w_r)
        if score >= floor - 1e-6 and (key[0], line[:60]) not in seen:
            rounded = _rounded(score)
            if rounded >= floor:
                seen.add((key[0], line[:60]))
                best.append((-rounded, key[1], key[2], key[0], line, matched, score))
    best.sort(key=lambda b: b[:3])
    for k, (_, _, _, rel_path, line, matched, score) in enumerate(best[:cap]):
        yield k + 1, rel_path, line, ", ".join(sorted(matched)), score


def check_actions(hits: DataFrame, p=DEFAULTS) -> DataFrame:
    """(action_id, rank, rel_path, line, matched, score): at most `rule_cap` directive lines per action.

    hits: action_id, action, rel_path, doc_type, text, pos. Only feedback documents may act as rules. The rows of an action
    meet once, sorted by action; a task holds one action's rows, and no token becomes a row."""
    cleaned = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("no"), F.btrim(x, F.lit(" \t\r")).alias("line")))
    lines = F.when(F.col("doc_type") == "feedback", F.filter(cleaned, lambda x: g.is_directive(x["line"])))
    d = _by_action(hits, low=F.lower("text"), action=F.lower("action"), rel_path=F.col("rel_path"), pos=F.col("pos").cast("long"), lines=lines)
    d = d.select("action_id", "n", "low", "action", "rel_path", "pos", F.col("lines.no").alias("numbers"), F.col("lines.line").alias("lines"),
                 F.transform("lines.line", lambda x: F.lower(x)).alias("lows"))
    text = T.StringType()
    out = _row(action_id=d.schema["action_id"].dataType, rank=T.IntegerType(), rel_path=text, line=text, matched=text, score=T.DoubleType())
    schema = to_arrow_schema(out)
    floor, cap = p.rule_floor, p.rule_cap

    def run(batches):
        read = g.word_reader()
        groups = _groups(batches, ("low", "action", "rel_path", "pos", "numbers", "lines", "lows"))
        yield from _batched(((action, *w) for action, rows in groups for w in _warnings(rows, read, floor, cap)), schema)

    return d.mapInArrow(run, out).select(
        "action_id", "rank", sanitize_field("rel_path", 160).alias("rel_path"), sanitize_field("line", 160).alias("line"),
        "matched", "score",
    )


def related_vocabulary(actions: DataFrame, rules: DataFrame) -> DataFrame:
    """(a, r): distinct action tokens and rule tokens that count as evidence for one another.

    Two different related tokens share the shorter one's first five characters somewhere in the longer one, so an
    equi-join on five-character pieces finds every pair without comparing all of them."""
    va, vr = actions.select(F.col("token").alias("a")).distinct(), rules.select(F.col("token").alias("r")).distinct()

    def pieces(c):
        return F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 4), lambda i: F.substring(F.col(c), i, F.lit(5)))))

    long_a, long_r = va.filter(F.length("a") >= 5), vr.filter(F.length("r") >= 5)
    a_in_r = long_a.withColumn("gram", F.left("a", F.lit(5))).join(long_r.withColumn("gram", pieces("r")), "gram").filter(F.contains("r", F.col("a")))
    r_in_a = long_r.withColumn("gram", F.left("r", F.lit(5))).join(long_a.withColumn("gram", pieces("a")), "gram").filter(F.contains("a", F.col("r")))
    same = va.join(vr, F.col("a") == F.col("r"))
    return same.unionByName(a_in_r.select("a", "r")).unionByName(r_in_a.select("a", "r")).distinct()


def detector_rates(labelled: DataFrame, warnings: DataFrame) -> DataFrame:
    """Per label the share of cases that fired. labelled: action_id, label."""
    fired = warnings.select("action_id").distinct().withColumn("hit", F.lit(1))
    return labelled.join(fired, "action_id", "left").groupBy("label").agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("rate")
    )


def worth_saving(texts: DataFrame) -> DataFrame:
    return texts.filter(g.retention("text")["commit"])


def suggest(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """create or amend, per text worth saving. texts: query_id, text; hits: query_id, rank, rel_path, title."""
    d = texts.withColumn("r", g.retention("text")).filter("r.commit").select(
        "query_id", F.col("r.confidence").alias("confidence"), F.col("r.type").alias("type"),
        g.suggested_slug("text", F.col("r.type")).alias("slug"),
    )
    near = hits.select("query_id", "rank", "rel_path", g.long_words(F.concat_ws(" ", "rel_path", "title")).alias("hay"))
    shared = d.join(near, "query_id").filter(F.size(F.array_intersect(g.long_words("slug"), F.col("hay"))) >= 2)
    first = shared.groupBy("query_id").agg(F.min_by("rel_path", "rank").alias("amend"))
    return d.join(first, "query_id", "left").select(
        "query_id", "confidence", "type", "slug",
        F.when(F.col("amend").isNotNull(), F.lit("amend")).otherwise(F.lit("create")).alias("action"),
        F.coalesce("amend", F.concat("type", F.lit("-"), "slug", F.lit(".md"))).alias("target"),
    )
