"""Text of saved guidance: directive lines, tokens, retention score."""

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col, strip

# Markers, word lists and suffixes of the guidance rules.
PROHIBITIVE = (
    "don't", "dont", "do not", "never", "avoid", "stop ", "no longer", "must not", "cannot", "rather than",
    "instead of",
)
PRESCRIPTIVE = (
    "always", "before ", "must ", "first ", "ensure", "verify", "prefer", "say instead", "retired", "use ", "only ",
    "then ",
)
SUFFIXES = (
    "ations", "ation", "ities", "ility", "ingly", "ables", "able", "ible", "ings", "ing", "ers", "er", "ed", "es",
    "s", "ly",
)
# Words that say nothing about a rule, as two lists.
LONG_IGNORED = tuple(
    "about above after again against also been before being below between both could does doing down during each every "
    "from have having here itself just just like more most much must once only other over same should some such than "
    "that them then there these they this those through under until very what when where which while with would your "
    "yours user when with this they that this used into upon also other than rule when never always cannot stop avoid "
    "this with they have when where".split()
)
SHORT_IGNORED = tuple(
    "the and but for are was has had can may will did you our its out not from into one any all use way get let put via "
    "per own new old off yet its it's than then them".split()
)
IGNORED = LONG_IGNORED + SHORT_IGNORED
MIN_LINE = 12
# name, pattern, weight, type it sets
SAVE_INTENT = r"\b(remember|save this|don't forget|note this|tag this|memorize)\b"
DECISION = (
    r"\b(decid(?:e|es|ed|ing)|decision|chose|chosen|choosing|settl(?:e|es|ed|ing) on|go(?:ing)? with|went with|"
    r"lock(?:ed|ing)?|approv(?:e|es|ed)|finaliz(?:e|es|ed)|agreed)\b"
)
COMMITMENT = (
    r"(architectural default|the (?:new )?default|now the default|is now the\b|going forward|from now on|"
    r"moving forward|canonical|source of truth|standard (?:practice|approach)|the (?:standard|convention) is)"
)
NEAR_DATE = r"\b(2026|2027)-\d{2}-\d{2}\b"
FEEDBACK = r"\b(don't|stop|prefer|always|never|going forward|from now on)\b"
PROFILE = r"\b(i am|i'm a|my role|my background|i prefer|i'm working on)\b"
REFERENCE = r"(?i)\b(at|in|see) (https?://|gs://|/mnt/|c:\\)"
SURPRISE = r"\b(surprising|non-obvious|gotcha|caveat|workaround|did not expect)\b"


_MARKED = "|".join(PROHIBITIVE + PRESCRIPTIVE)


def is_directive(line):
    return (F.length(strip(line)) >= MIN_LINE) & F.lower(strip(line)).rlike(_MARKED)


_WORD = re.compile(r"[a-z0-9][a-z0-9\-.]{2,}")
_ENDING = re.compile(r"\A(.{4,}?)(?:" + "|".join(SUFFIXES) + r")\Z")
_IGNORED = frozenset(IGNORED)
KNOWN_WORDS = 200_000


def _stems(word):
    """The tokens one written word stands for: itself and its parts, each without the longest listed suffix that leaves
    at least four characters."""
    word = word.strip("-.")
    kept = (w for w in (word, *re.split("[-.]", word)) if len(w) >= 3 and w not in _IGNORED)
    return tuple(dict.fromkeys(w for w in (_ENDING.sub(r"\1", w) for w in kept) if w not in _IGNORED))


def word_reader():
    """A function from lower-cased text to its distinct tokens in order. It remembers up to KNOWN_WORDS words."""
    known = {}

    def read(text):
        out = {}
        for w in _WORD.findall(text):
            stems = known.get(w)
            if stems is None:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                stems = known[w] = _stems(w)
            for x in stems:
                out[x] = None
        return list(out)

    return read


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens_of(text: pd.Series) -> pd.Series:
    read = word_reader()
    return text.map(lambda x: None if x is None else read(x))


def rule_tokens(text):
    return _tokens_of(F.lower(col(text)))


def retention(text):
    """STRUCT<confidence, commit, type>: additive signals, capped at 1; the last matching signal names the type."""
    t = F.lower(col(text))
    save, decided, committed = t.rlike(SAVE_INTENT), t.rlike(DECISION), t.rlike(COMMITMENT)
    feedback, profile, reference, surprise = t.rlike(FEEDBACK), t.rlike(PROFILE), t.rlike(REFERENCE), t.rlike(SURPRISE)
    bound = decided | committed

    def w(cond, v):
        return F.when(cond, F.lit(v)).otherwise(F.lit(0.0))

    score = (
        w(save, 0.85) + w(bound, 0.5) + w(decided & committed, 0.2) + w(bound & t.rlike(NEAR_DATE), 0.2)
        + w(feedback, 0.4) + w(profile, 0.35) + w(reference, 0.2) + w(surprise, 0.3)
    )
    confidence = F.least(score, F.lit(1.0))
    kind = (
        F.when(reference, F.lit("reference")).when(profile, F.lit("user")).when(feedback, F.lit("feedback"))
        .otherwise(F.lit("project"))
    )
    return F.struct(
        confidence.alias("confidence"), (F.round(confidence, 9) >= 0.5).alias("commit"), kind.alias("type")
    )


def suggested_slug(text, kind):
    first = F.left(F.element_at(F.split(strip(text), "\n"), 1), F.lit(80))
    words = F.slice(F.regexp_extract_all(F.lower(first), F.lit("[A-Za-z0-9]+"), F.lit(0)), 1, 6)
    return F.when(F.size(words) > 0, F.concat(kind, F.lit("_"), F.array_join(words, "-"))).otherwise(
        F.concat(kind, F.lit("_entry"))
    )


def long_words(text):
    return F.array_distinct(F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z0-9]{4,}"), F.lit(0)))
