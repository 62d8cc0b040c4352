"""Two-axis evidence grade: declared credibility digit, derived source letter."""

from pyspark.sql import functions as F

from .text import EVIDENCE_CLASSES, blank, col, strip

# Fixed values of the grading scale.
CREDIBILITY = {"observed": "1", "sourced": "2", "synthesized": "3"}
UNGRADED_DIGIT = "6"
SELF, ORGANISATION, EXTERNAL, UNJUDGEABLE = "A", "B", "C", "F"


def credibility(evidence):
    out = F.when(F.lit(False), F.lit(""))
    for name, digit in CREDIBILITY.items():
        out = out.when(col(evidence) == name, F.lit(digit))
    return out.otherwise(F.lit(UNGRADED_DIGIT))


def _scheme_and_org(identity):
    s = strip(blank(identity))
    has_scheme = F.contains(s, F.lit("://"))
    scheme = F.when(has_scheme, F.substring_index(s, "://", 1)).otherwise(F.lit(""))
    rest = F.when(has_scheme, F.regexp_replace(s, r"(?s)\A.*?://", "")).otherwise(s)
    org = F.coalesce(F.try_element_at(F.filter(F.split(rest, "/"), lambda x: x != ""), F.lit(1)), F.lit(""))
    return scheme, org


def source_letter(author, reader, verified):
    author_scheme, author_org = _scheme_and_org(author)
    reader_scheme, reader_org = _scheme_and_org(reader)
    return (
        F.when(~F.coalesce(col(verified), F.lit(False)) | (blank(author) == "") | (blank(reader) == ""),
               F.lit(UNJUDGEABLE))
        .when(col(author) == col(reader), F.lit(SELF))
        .when((author_org != "") & (author_scheme == reader_scheme) & (author_org == reader_org),
              F.lit(ORGANISATION))
        .otherwise(F.lit(EXTERNAL))
    )


def grade_pair(evidence, letter=None):
    return F.concat(F.lit(UNJUDGEABLE) if letter is None else col(letter), credibility(evidence))


def is_graded(evidence):
    return blank(evidence).isin(*EVIDENCE_CLASSES)
