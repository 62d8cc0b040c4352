"""Does a record answer the question: normalisation, terms, typed candidates, verdict."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from .text import blank, col, fold_ascii, let, nfkd_ascii, no_strings, pin, strip

# Word lists and patterns of the admission rules.
STOP_WORDS = (
    "the a an is was were are did does do of in on at to for with and or by from as it its this that what which "
    "who when where how many much about roughly per after before"
).split()
GREETINGS = (
    "hi", "hello", "hey", "yo", "sup", "thanks", "thank you", "ty", "ok", "okay", "cool", "nice", "lol", "yes",
    "no", "yep", "nope", "got it", "great", "perfect",
)
GATE_STOP_WORDS = (
    "the a an of and or to in on for with is are was were be do does did how what why when who which that this it's "
    "its you i we they me my our your"
).split()
QUANTITY_QUESTION = r"(?i)\A(about |roughly )?how (many|much|large|long|fast|complete|old|big)\b"
DATE_QUESTION = r"(?i)\Awhen\b|what date|which (day|month|year)|\bdue\b"
QUESTION_OPENER = (
    r"(?i)\A(what|when|where|which|who|whose|why|how|did|does|do|is|are|was|were|can|could|should|would|will|has|have|had)\b"
)
TEMPORAL = (
    r"(?iU)\b(latest|recent(ly)?|current(ly)?|now|today|newest|most recent|status|state of|up[- ]?to[- ]?date|"
    r"this (week|month)|what changed|updated?)\b"
)
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
NUMBER = r"(?U)[~$€£]?\d[\d,./x-]*\d%?|\b\d+%?(?![\w-])"
DATE = rf"(?iU)\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b(?:{MONTHS})\b[ \d,]*"
IDENTIFIER = (
    r"(?U)\b[\w-]*\d[\w./-]*\b|\b[A-Z][\w]*(?:[ -][A-Z][\w]*)+\b|\b\w+_\w+[\w_]*\b|\b\w+\([^)]{0,40}\)"
    r"|\b[a-z]+-[a-z]+(?:-[a-z]+)*\b"
)
PROPER_NOUN = r"(?U)(?<!^)(?<![.?!] )\b[A-Z][\w-]*"
SENTENCE_END = r"(?U)(?=\s)(?<=[.;!?])\s+"
CLEAN_NUMBER = r"\A~?[$€£]?\d[\d,./x-]{0,18}%?\z"
CLEAN_DATE = rf"(?i)\A\d{{4}}-\d{{2}}-\d{{2}}\z|\A\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\z|\A({MONTHS})\s+\d{{1,2}}(,?\s*\d{{4}})?\z"
INNER_DATE = rf"(?i)({MONTHS})\s+\d{{1,2}}(,?\s*\d{{4}})?"
ADMISSIBLE, NEAR, IRRELEVANT = "ADMISSIBLE", "INADMISSIBLE_NEAR", "IRRELEVANT"

_MARK = "\x01"  # keeps sentence borders through one folding call


def normalise_ascii(c):
    """Normal form of text already folded to ASCII."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9$%/.#-]+", " "))


def normalise(c):
    return normalise_ascii(fold_ascii(c))


def terms_of(norm):
    kept = F.filter(F.split(norm, " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))

    def with_parts(w):
        parts = F.filter(F.split(w, "-"), lambda p: (F.length(p) >= 3) & ~p.isin(*STOP_WORDS))
        return F.when(F.contains(w, F.lit("-")), F.concat(F.array(w), parts)).otherwise(F.array(w))

    return F.flatten(F.transform(kept, with_parts))


def terms(c):
    return terms_of(normalise(c))


def is_specific(term):
    return term.rlike(r"\d") | F.contains(term, F.lit("-")) | F.contains(term, F.lit("/")) | (F.length(term) >= 8)


def question_kind(question):
    q = strip(question)
    return (
        F.when(q.rlike(QUANTITY_QUESTION), F.lit("quantity"))
        .when(q.rlike(DATE_QUESTION), F.lit("date"))
        .otherwise(F.lit("identity"))
    )


def is_question(query):
    q = strip(blank(query))
    return F.endswith(q, F.lit("?")) | q.rlike(QUESTION_OPENER)


def is_temporal(query):
    return col(query).rlike(TEMPORAL)


def _all(c, pattern):
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def candidates(sentence, kind):
    dates = F.transform(_all(sentence, DATE), lambda x: strip(x))
    return (
        F.when(kind == "quantity", _all(sentence, NUMBER))
        .when(kind == "date", F.concat(dates, _all(sentence, NUMBER)))
        .otherwise(_all(sentence, IDENTIFIER))
    )


def clean_candidates(found, kind, sanitize):
    """Values safe to show outside a fence, in order, without repeats."""

    def shape(c):
        inner = F.regexp_extract(c, INNER_DATE, 0)
        loose = (kind == "date") & ~c.rlike(CLEAN_NUMBER) & ~c.rlike(CLEAN_DATE) & (inner != "")
        return F.when(loose, inner).otherwise(c)

    shaped = F.transform(F.transform(found, lambda c: sanitize(c)), shape)
    ok = F.filter(shaped, lambda c: c.rlike(CLEAN_NUMBER) | ((kind == "date") & c.rlike(CLEAN_DATE)))
    return F.array_distinct(ok)


def fts_tokens(query):
    return F.filter(_all(col(query), "[A-Za-z0-9_]+"), lambda t: F.length(t) > 1)


def match_phrases(query):
    """Every phrase a query scores: each token, and the whole sequence when it has 2 to 6 tokens."""
    toks = fts_tokens(query)
    single = F.transform(toks, lambda t: F.array(t))
    whole = F.when(F.size(toks).between(2, 6), F.array(toks)).otherwise(F.array().cast("array<array<string>>"))
    return F.concat(whole, single)


def retrieval_gate(query, min_chars=3, min_content_words=1):
    """STRUCT<proceed, reason>: is there anything to look up?"""
    q = strip(blank(query))
    low = F.btrim(F.lower(q), F.lit(" .!?"))
    content = F.filter(_all(low, "[a-z0-9]{3,}"), lambda w: ~w.isin(*GATE_STOP_WORDS))

    def verdict(ok, why):
        return F.struct(F.lit(ok).alias("proceed"), F.lit(why).alias("reason"))

    return (
        F.when(F.length(q) < min_chars, verdict(False, "empty/near-empty query"))
        .when(low.isin(*GREETINGS), verdict(False, "greeting/acknowledgement"))
        .when(F.size(content) < min_content_words, verdict(False, "no content terms"))
        .otherwise(verdict(True, ""))
    )


def _count(arr, pred):
    return F.size(F.filter(arr, pred))


# The matching of terms, on text folded to ASCII: characters that `normalise_ascii` keeps, and the mark between sentences.
_KEPT = {chr(c): " " for c in range(128)} | {c: c for c in "abcdefghijklmnopqrstuvwxyz0123456789$%/.#-" + _MARK}
_SPACED = str.maketrans(_KEPT)
_STOP = frozenset(STOP_WORDS)
_MATCHED = "struct<n_spec:int,cov:double,over:double,anchor:boolean,useful:array<int>>"


def _norms(text):
    """Normal forms of the sentences of a text, which a mark ends."""
    folded = text if text.isascii() else nfkd_ascii(text)
    return [" ".join(z.split()) for z in folded.lower().translate(_SPACED).split(_MARK)]


def _question(text, named):
    """(proper nouns, distinctive terms, other terms) of a question, each as (term, padded, without hyphens, root)."""
    words = [w for z in _norms(text.replace(_MARK, " ")) for w in z.split(" ") if w and w not in _STOP]
    terms = [t for w in words for t in [w, *(p for p in w.split("-") if "-" in w and len(p) >= 3 and p not in _STOP)]]
    proper = dict.fromkeys(p for p in _norms(named) if p and p not in _STOP)
    spec = [t in proper or re.search(r"[0-9/-]", t) is not None or len(t) >= 8 for t in terms]

    def forms(t):
        return t, f" {t} ", t.replace("-", " "), re.sub(r"(ing|back|ed|es|s)\Z", "", t)

    return [forms(t) for t in proper], [forms(t) for t, s in zip(terms, spec) if s], [forms(t) for t, s in zip(terms, spec) if not s]


def _useful(norms, padded, spec, gen):
    """Numbers of the sentences in whose window of three the question's terms meet. A window's terms are its words and the
    parts of its hyphenated words, so a term that the record does not hold is in no window."""
    least, distinctive = max(2, len(gen) // 2), bool(spec)
    spec, gen = ([t for t in some if t[0] in padded] for some in (spec, gen))
    out = []
    if (spec and len(spec) + len(gen) >= 2) if distinctive else len(gen) >= least:
        for i in range(len(norms)):
            words = f" {' '.join(norms[max(i - 1, 0):i + 2]).strip(' ')} "
            parts = words.replace("-", " ")

            def here(t):
                return t[1] in words or (len(t[0]) >= 3 and "-" not in t[0] and t[1] in parts)

            n_spec = sum(here(t) or (len(t[0]) >= 6 and t[0] in words) for t in spec)
            if n_spec or not distinctive:
                n_gen = sum(map(here, gen))
                if n_spec + n_gen >= 2 if distinctive else n_gen >= least:
                    out.append(i)
    return out


def _matched(question, joined, named):
    """Arrow columns of questions, records with marks between sentences, and proper nouns with marks between -> how the
    terms of a question are met. A question is read once for the rows of a batch that ask it."""
    read, rows = {}, []
    for q, text, names in zip(question.to_pylist(), joined.to_pylist(), named.to_pylist()):
        if q is None:
            rows.append((None, 1.0, 0.0, None, None if text is None else []))
            continue
        if q not in read:
            read[q] = _question(q, names)
        proper, spec, gen = read[q]
        if text is None:
            rows.append((len(spec), 0.0 if spec else 1.0, 0.0, None if proper else True, None))
            continue
        norms = _norms(text)
        rec = " ".join(z for z in norms if z)
        padded, flat = f" {rec} ", rec.replace("-", " ")

        def hit(t):
            """A word of the record, or from six characters on a part of it, without hyphens, or its root from five on."""
            return (t[1] in padded and " " not in t[0]) or (len(t[0]) >= 6 and t[2] in flat) or (len(t[3]) >= 5 and t[3] in flat)

        cov = sum(map(hit, spec)) / len(spec) if spec else 1.0
        over = sum(map(hit, gen)) / len(gen) if gen else 0.0
        rows.append((len(spec), cov, over, not proper or any(map(hit, proper)), _useful(norms, padded, spec, gen)))
    kinds = {"n_spec": pa.int32(), "cov": pa.float64(), "over": pa.float64(), "anchor": pa.bool_(), "useful": pa.list_(pa.int32())}
    columns = zip(*rows) if rows else [[]] * 5
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))


def judge(pairs, question="question", record="record", near=0.28, specific=0.5):
    """Adds `verdict` STRUCT<verdict, kind, specific_coverage, generic_overlap, bound, reason> to (question, record) rows."""
    keep = [c for c in pairs.columns if c != "verdict"]
    split = let(F.split(col(record), SENTENCE_END), lambda s: F.struct(
        s.alias("sents"), F.array_join(s, _MARK).alias("joined"), F.array_join(_all(col(question), PROPER_NOUN), _MARK).alias("named")))

    @F.arrow_udf(_MATCHED)
    def matched(question: pa.Array, joined: pa.Array, named: pa.Array) -> pa.Array:
        return _matched(question, joined, named)

    d = pin(pairs, _r=split).withColumn("_m", matched(col(question), F.col("_r.joined"), F.col("_r.named")))

    def bound(kind):
        found = F.transform(F.col("_m.useful"), lambda i: candidates(F.get(F.col("_r.sents"), i), kind))
        return F.flatten(F.filter(found, lambda x: x.isNotNull()))

    def outcome(kind, found):
        def verdict(name, bound, reason):
            return F.struct(
                F.lit(name).alias("verdict"), kind.alias("kind"), F.col("_m.cov").alias("specific_coverage"),
                F.col("_m.over").alias("generic_overlap"), bound.alias("bound"), F.lit(reason).alias("reason"),
            )

        covered, near_enough = F.col("_m.cov") >= specific, F.greatest("_m.over", "_m.cov") >= near
        return (
            F.when((F.size(found) > 0) & F.col("_m.anchor") & (covered | (F.col("_m.n_spec") == 0)),
                   verdict(ADMISSIBLE, found, "typed candidate bound to query specifics"))
            .when(near_enough & covered, verdict(NEAR, found, "no typed candidate bound to query specifics"))
            .when(near_enough, verdict(NEAR, found, "domain overlap without the query's distinctive specifics"))
            .otherwise(verdict(IRRELEVANT, no_strings(), "low overlap"))
        )

    out = let(question_kind(question), lambda kind: let(bound(kind), lambda found: outcome(kind, found)))
    return pin(d.drop("verdict"), verdict=out).select(*keep, "verdict")
