"""When a claim was last stood behind, and whether it asserts something still open."""

from pyspark.sql import functions as F

from .text import LINE_BREAKS, blank, col, is_abstraction, is_archive_path, let, no_strings, strip

# The authoring conventions these columns read.
ISO = r"\d{4}-\d{2}-\d{2}"
OPEN_STATES = (
    r"DELINQUENT|UNPAID|OVERDUE|PAST\s+DUE|PENDING|AWAITING|BLOCKED|ON\s+HOLD|"
    r"UNRESOLVED|UNVERIFIED|UNCONFIRMED|NOT\s+FILED|NOT\s+PAID|NOT\s+YET|"
    r"IN\s+PROGRESS|IN\s+REVIEW|UNDER\s+REVIEW|OUTSTANDING|SUSPENDED|EXPIRED|"
    r"LAPSED|NEEDS\s+REFRESH|TBD|WIP"
)
SIGNS = r"⚠✅❌⏸\x{1F504}⬜\x{1F6A7}⏳"
VARIATION = r"\x{FE0F}"
LEAD = r"[ \t>\-|*]*"
OPEN_STATUS_WORDS = ("ACTIVE", "PLANNING", "BLOCKED", "IN PROGRESS", "PENDING")
STATUS_HEADER = rf"(?md)^{LEAD}\*\*Status\*\*\s*:\s*(.+)$"
UPDATED_HEADER = rf"(?md)^{LEAD}\*\*Last Updated\*\*\s*:\s*({ISO})"
AS_OF = rf"(?i)(?=a)\bas of\s+({ISO})"
LEADING_DATE = rf"(?smd)\A---\r?\n.*?^date:\s*['\"]?({ISO})"
VERIFY_BY = rf"(?imd)^verify_by\s*:\s*({ISO})"
NOT_VOLATILE = r"(?imd)^volatile\s*:\s*(?:false|no)\s*$"
OPEN_MARKER = (
    rf"(?iU)(?:\*\*\s*[{SIGNS}{VARIATION}]*\s*\**\s*(?:{OPEN_STATES})\b"
    rf"|\|\s*[{SIGNS}{VARIATION}]*\s*\**\s*(?:{OPEN_STATES})\b"
    rf"|[{SIGNS}]{VARIATION}?\s*\**\s*(?:{OPEN_STATES})\b)"
)
MARKED = rf"(?=[^+-{{ -)]){OPEN_MARKER}"  # the same matches, not tried at characters where none can begin: most of ASCII
ODD_BREAKS = "[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
CODE_LIKE_STARTS = ('"', "'", "//", "#!", "|--", "```")


def struct_of(label, date):
    return F.struct(F.lit(label).alias("label") if isinstance(label, str) else label.alias("label"),
                    date.alias("date"))


def normalize_claim_date(value):
    v = F.left(strip(strip(blank(value)), "'\""), F.lit(10))
    return F.when(v.rlike(rf"\A{ISO}\z"), v).otherwise(F.lit(""))


def epoch_to_iso(seconds):
    """UTC calendar date of an epoch; '' for 0 or null. Independent of the session zone."""
    s = col(seconds)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s / 86400).cast("int"))
    return F.when(s.isNull() | (s == 0), F.lit("")).otherwise(day.cast("string"))


def claim_date(text, path, mtime_iso, declared=None):
    """STRUCT<label, date>, strongest evidence first. Each kind is looked for once, and only where no stronger one is found."""
    text = col(text)
    ladder = [
        ("verified", F.when(F.contains(text, F.lit("**Last Updated**")), F.regexp_extract(text, UPDATED_HEADER, 1))),
        ("as-of", F.array_max(F.regexp_extract_all(text, F.lit(AS_OF), F.lit(1)))),
        *([("dated", blank(declared))] if declared is not None else []),
        ("dated", F.when(F.startswith(text, F.lit("---")), F.regexp_extract(text, LEADING_DATE, 1))),
        ("dated", F.regexp_extract(F.element_at(F.split(col(path), r"[\\/]"), -1), f"({ISO})", 1)),
        ("file-dated", blank(mtime_iso)),
    ]

    def step(rest, label, found):
        return let(found, lambda date: F.when(date != "", struct_of(label, date)).otherwise(rest))

    out = struct_of("", F.lit(""))
    for label, found in reversed(ladder):
        out = step(out, label, found)
    return out


def record_date(text, heading_path, path, doc_type, mtime, declared, made=None):
    """The date shown with a served record. `made`: whether it is an abstraction, if known."""
    scan = F.when(blank(heading_path) != "", F.concat_ws("\n", col(heading_path), col(text))).otherwise(col(text))

    def dated(iso):
        generated = F.when(iso != "", struct_of("generated", iso)).otherwise(struct_of("", F.lit("")))
        return F.when(is_abstraction(doc_type, path) if made is None else made, generated).otherwise(
            let(scan, lambda s: claim_date(s, path, iso, declared)))

    return let(epoch_to_iso(mtime), dated)


def open_claim_lines(text):
    """Lines are cut only where the whole text holds a marker: what bounds a marker in a line, its ends, bounds it there too."""
    by_line = F.when(col(text).rlike(ODD_BREAKS), F.split(col(text), LINE_BREAKS)).otherwise(F.split(col(text), "\n"))
    stripped = F.transform(by_line, lambda x: strip(x))

    def asserts(s):
        looks_like_code = F.contains(s, F.lit('":'))
        for start in CODE_LIKE_STARTS:
            looks_like_code = looks_like_code | F.startswith(s, F.lit(start))
        return (s != "") & ~F.startswith(s, F.lit(">")) & s.rlike(MARKED) & ~looks_like_code

    return F.when(~col(text).rlike(MARKED), no_strings()).otherwise(F.filter(stripped, asserts))


def open_claims(text, limit=None, chars=None, lines=None):
    """Open claims as one line each; a display may ask for the first `limit`, cut to `chars`. `lines`: those of the text, if known."""
    shown = F.transform(open_claim_lines(text) if lines is None else col(lines), lambda s: F.regexp_replace(s, r"(?U)\s+", " "))
    if chars:
        shown = F.transform(shown, lambda s: F.left(s, F.lit(chars)))
    return F.slice(shown, 1, limit) if limit else shown


def volatility(text, lines=None):
    text = col(text)
    lines = open_claim_lines(text) if lines is None else col(lines)
    status = F.upper(F.when(F.contains(text, F.lit("**Status**")), F.regexp_extract(text, STATUS_HEADER, 1)))

    def in_flight(named):
        out = F.lit(False)
        for word in OPEN_STATUS_WORDS:
            out = out | F.contains(named, F.lit(word))
        return out

    return (
        F.when(text.rlike(NOT_VOLATILE), F.lit(""))
        .when(let(status, in_flight) | (F.size(lines) > 0), F.lit("open"))
        .otherwise(F.lit(""))
    )


def expired(text, today):
    """The author's own verify-by date when it lies before `today`, else null."""
    # without a date nothing is parsed: every failure costs an exception
    return let(F.regexp_extract(col(text), VERIFY_BY, 1), lambda named: F.when(
        (named != "") & (F.try_to_date(named, "yyyy-MM-dd") < F.lit(today).cast("date")), named))


def days_since(date, today):
    return F.datediff(F.lit(today).cast("date"), F.try_to_date(col(date), "yyyy-MM-dd"))


def stale_marker(text, heading_path, path, doc_type, mtime, declared, today, when=None):
    """`when`: the record's date, if known."""
    def aged(w):
        age = F.when(w["label"].isin("verified", "as-of", "dated"), days_since(w["date"], today))
        return F.coalesce(F.concat(F.lit("unverified "), age.cast("string"), F.lit("d")), F.lit("unverified (no claim date)"))

    when = record_date(text, heading_path, path, doc_type, mtime, declared) if when is None else when
    open_ = F.when(volatility(text) == "", F.lit("")).otherwise(let(when, aged))
    gone = let(expired(text, today), lambda named: F.when(named.isNotNull(), F.concat(F.lit("EXPIRED "), named)).otherwise(open_))
    return F.when(is_archive_path(path), F.lit("")).otherwise(gone)


def source_date(path, mtime):
    """Label for one source of a synthesis: last date in the path, else last month, else the file time."""
    days = F.regexp_extract_all(col(path), F.lit(f"({ISO})"), F.lit(1))
    months = F.regexp_extract_all(col(path), F.lit(r"(\d{4}-\d{2})(?!\d)"), F.lit(1))
    iso = epoch_to_iso(mtime)
    return (
        F.when(F.size(days) > 0, F.concat(F.lit("dated "), F.try_element_at(days, F.lit(-1))))
        .when(F.size(months) > 0, F.concat(F.lit("dated "), F.try_element_at(months, F.lit(-1))))
        .when(iso != "", F.concat(F.lit("last modified "), iso))
        .otherwise(F.lit("date unknown"))
    )


def age_band(days):
    """Age policy on `Last Updated`: active, flag, archive candidate."""
    d = col(days)
    return (
        F.when(d.isNull(), F.lit("undated"))
        .when(d < 30, F.lit("active"))
        .when(d < 60, F.lit("flag"))
        .otherwise(F.lit("archive-candidate"))
    )
