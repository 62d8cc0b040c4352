"""Archive, registry, signal-harvest and record-quality columns."""

from pyspark.sql import functions as F

from .dating import ISO
from .text import EVIDENCE_CLASSES, LINE_BREAKS, WHITESPACE, blank, col, fold_ascii, known_or_blank, let, strip

# Fixed values of the catalogue, registry and document formats.
SNAPSHOT_CUT = "… [snapshot truncated — full session in the archived record]"
REGISTRY_NAME = r"\A(gcx|aet)://([A-Za-z0-9._~/-]+)\z"
STATUSES = ("PLANNING", "ACTIVE", "OPERATIONAL", "BLOCKED", "DORMANT")
PRIORITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
BLOCKER = r"(?iU)\b(BLOCKED|needs deploy|broken|regression|TODO|WIP|min=0|COLD)\b"
HARD_BLOCKERS = ("blocked", "broken", "regression", "needs deploy")
DEPLOYED_WORDS = ("deployed", "operational", "production", " live", "shipped")
HIGH_WORDS = ("000-priority", "launch ready", "launch-ready", "x402", "stripe", "payment", "revenue", "live keys")
DORMANT_DAYS = 60
EXTERNAL_REF = r"(?i)\A[a-z][a-z0-9+.-]*://"


# ---- archive ---------------------------------------------------------------

def base64url(binary):
    return F.rtrim(F.translate(F.base64(binary), "+/", "-_"), F.lit("="))


def content_id(payload):
    return base64url(F.unhex(F.sha2(col(payload), 256)))


def source_hash(payload):
    return F.sha2(col(payload), 256)


def ascii_tag(c):
    """Index handle of a title: smart punctuation mapped, the rest folded to ASCII."""
    plain = F.translate(col(c), "—–‘’“”\u00a0", "--''\"\" ")
    return fold_ascii(F.replace(plain, F.lit("…"), F.lit("...")))


def extractive_snapshot(text, ratio=0.25, floor=200):
    """Headings, list lines and the lead line of each block, until the character budget is used."""
    text = col(text)
    rows = F.transform(F.split(text, LINE_BREAKS), lambda x: F.rtrim(x, F.lit(WHITESPACE)))
    budget = F.greatest(F.floor(F.length(text) * ratio).cast("int"), F.lit(floor))

    def step(acc, x):
        s = strip(x)
        heading = F.startswith(s, F.lit("#"))
        listed = heading | s.rlike(r"\A(- |\* |>|\d\d.?\.)")
        keep = (s != "") & (listed | acc["lead"])
        used = acc["used"] + F.length(x)
        full = used >= budget
        grown = F.concat(
            acc["out"], F.when(acc["out"] != "", F.lit("\n")).otherwise(F.lit("")), x,
            F.when(full, F.lit("\n" + SNAPSHOT_CUT)).otherwise(F.lit("")),
        )
        add = keep & ~acc["done"]
        return F.struct(
            F.when(add, grown).otherwise(acc["out"]).alias("out"),
            F.when(add, used).otherwise(acc["used"]).alias("used"),
            (acc["done"] | (keep & full)).alias("done"),
            ((s == "") | heading).alias("lead"),
        )

    start = F.struct(
        F.lit("").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("done"), F.lit(True).alias("lead")
    )
    return F.aggregate(rows, start, step, lambda acc: F.coalesce(F.nullif(strip(acc["out"]), F.lit("")), F.left(text, budget)))


# ---- registry --------------------------------------------------------------

def owner_address(key):
    """Address derived from a base64url public key; null when the key does not decode."""
    plain = F.translate(col(key), "-_", "+/")
    pad = F.repeat(F.lit("="), (F.lit(4) - F.length(plain) % 4) % 4)
    raw = F.unbase64(F.when(plain.rlike(r"\A[A-Za-z0-9+/]+\z") & (F.length(plain) % 4 != 1), F.concat(plain, pad)))
    return base64url(F.unhex(F.sha2(raw, 256)))


def name_parts(name):
    n = strip(name)
    return F.when(
        n.rlike("(?i)" + REGISTRY_NAME) & F.substring_index(n, "://", 1).isin("gcx", "aet"),
        F.struct(F.regexp_extract(n, REGISTRY_NAME, 1).alias("scheme"), F.regexp_extract(n, REGISTRY_NAME, 2).alias("path")),
    )


def hash_status(expected, actual, mode=None):
    e = F.lower(strip(blank(expected)))
    verified = F.lit("VERIFIED") if mode is None else F.when(
        blank(mode) != "", F.concat(F.lit("VERIFIED ("), col(mode), F.lit(")"))
    ).otherwise(F.lit("VERIFIED"))
    return (
        F.when(e == "", F.lit("UNVERIFIABLE (no hash recorded on-chain)"))
        .when(e != col(actual), F.lit("HASH MISMATCH"))
        .otherwise(verified)
    )


# ---- belief references -----------------------------------------------------

def reference_kind(ref):
    return F.when(strip(ref).rlike(EXTERNAL_REF), F.lit("external")).otherwise(F.lit("link"))


def parse_references(refs):
    """refs: ARRAY<STRUCT<ref, verified>> as authors wrote them -> ARRAY<STRUCT<ref, kind, verified>>."""
    from .text import WIKILINK

    def one(r):
        s = strip(r["ref"])
        inner = F.regexp_extract(s, WIKILINK, 1)
        kind = reference_kind(s)
        return F.struct(
            F.when((kind == "link") & (inner != ""), strip(inner)).otherwise(s).alias("ref"),
            kind.alias("kind"),
            F.when(kind == "link", F.lit(True)).otherwise(F.coalesce(r["verified"], F.lit(False))).alias("verified"),
        )

    return F.transform(F.filter(refs, lambda r: strip(blank(r["ref"])) != ""), one)


# ---- signal harvest --------------------------------------------------------

def _all(c, pattern, group=0):
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def harvest(text, most=None):
    """Signals of a project page, as one STRUCT; `most` names how many entries of a list to show, all where it does not."""
    text, most = col(text), most or {}

    def shown(name, found):
        return (F.slice(found, 1, most[name]) if name in most else found).alias(name)

    mission = F.coalesce(
        F.nullif(F.regexp_extract(text, r"(?md)^>?\s*\*\*Mission\*\*[:：]?\s*(.+)$", 1), F.lit("")),
        F.nullif(F.regexp_extract(text, r"(?md)^##\s*Mission\s*\n+>?\s*(.+)$", 1), F.lit("")),
        F.regexp_extract(text, r"(?d)\*\*What this is\*\*[:：]?\s*(.+)", 1),
    )
    return F.struct(
        strip(F.regexp_extract(text, r"(?md)^#\s+(.+)$", 1)).alias("h1"),
        strip(mission).alias("mission"),
        shown("tables", _all(text, r"(?md)(?:^\|.*\|\s*$\n?){2,}")),
        shown("file_refs", F.array_distinct(_all(text, r"(?U)`?([\w./-]+\.\w+:\d+)`?", 1))),
        shown("shell_blocks", _all(text, r"(?s)```(?:bash|sh)\n(.*?)```", 1)),
        F.array_sort(F.array_distinct(_all(text, BLOCKER, 1))).alias("blockers"),
        shown("urls", F.array_distinct(_all(text, r"(?U)https?://[\w.-]+[\w./?=&%-]*"))),
    )


def _mentions(low, words):
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def infer_status(text, blockers, artifacts, last_change, today):
    low = F.lower(blank(text))
    hard = F.size(F.filter(col(blockers), lambda b: F.lower(b).isin(*HARD_BLOCKERS))) > 0
    age = F.datediff(F.lit(today).cast("date"), F.try_to_date(col(last_change), "yyyy-MM-dd"))
    return (
        F.when(hard, F.lit("BLOCKED"))
        .when((F.size(col(artifacts)) > 0) & _mentions(low, DEPLOYED_WORDS), F.lit("OPERATIONAL"))
        .when(blank(text) == "", F.lit("PLANNING"))
        .when(age > DORMANT_DAYS, F.lit("DORMANT"))
        .otherwise(F.lit("ACTIVE"))
    )


def infer_priority(text, path, flag):
    low = F.lower(blank(text))
    return (
        F.when(blank(flag) != "", F.upper(col(flag)))
        .when(F.contains(F.lower(col(path)), F.lit("_archive")), F.lit("LOW"))
        .when(_mentions(low, HIGH_WORDS), F.lit("HIGH"))
        .otherwise(F.lit("MEDIUM"))
    )


def folder_name(title, priority):
    loud = F.concat(F.lit("000-PRIORITY-"), F.btrim(F.regexp_replace(F.upper(col(title)), "[^A-Z0-9]+", "-"), F.lit("-")))
    quiet = F.btrim(F.regexp_replace(F.lower(col(title)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(col(priority).isin("CRITICAL", "HIGH"), loud).otherwise(quiet)


# ---- record and structure rules -------------------------------------------

def record_violations(path, date, evidence):
    """Codes a shipped record breaks; the pack's own root README is exempt."""
    grade = known_or_blank(evidence, EVIDENCE_CLASSES)
    checks = F.array(
        F.when(~strip(blank(date)).rlike(rf"\A{ISO}\z"), F.lit("no-date")),
        F.when(grade == "", F.lit("no-evidence")).when(grade == "observed", F.lit("observed-shipped")),
    )
    return F.when(col(path) == "README.md", F.array().cast("array<string>")).otherwise(F.array_compact(checks))


def structure_violations(text):
    """Codes of a status page that misses required parts or is too long."""
    whole = F.split(F.regexp_replace(col(text), r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])\z", ""), LINE_BREAKS)

    def opened(t0):
        return F.when(F.startswith(strip(F.get(t0, F.lit(0))), F.lit("```")), F.slice(t0, F.lit(2), F.size(t0))).otherwise(t0)

    def closed(t1):
        return F.when(strip(F.try_element_at(t1, F.lit(-1))) == "```", F.slice(t1, F.lit(1), F.size(t1) - 1)).otherwise(t1)

    def codes(rows, body):
        n = F.size(rows)
        return F.array_compact(F.array(
            F.when(~F.startswith(F.coalesce(F.get(rows, F.lit(0)), F.lit("")), F.lit("# ")), F.lit("no-title")),
            F.when(~body.rlike(r"(?md)^\*\*Status\*\*:\s*(" + "|".join(STATUSES) + ")"), F.lit("bad-status")),
            F.when(~body.rlike(r"(?md)^\*\*Priority\*\*:\s*(" + "|".join(PRIORITIES) + ")"), F.lit("bad-priority")),
            F.when(~body.rlike(rf"(?md)^\*\*Last Updated\*\*:\s*{ISO}"), F.lit("bad-updated")),
            F.when(~F.contains(body, F.lit("## Current State")), F.lit("no-current-state")),
            F.when(~F.contains(body, F.lit("## Related Lairs")), F.lit("no-related")),
            F.when(n > 500, F.lit("over-500-lines")).when(n > 300, F.lit("over-300-lines")),
        ))

    return let(whole, lambda t0: let(opened(t0), lambda t1: let(closed(t1), lambda rows: let(
        F.array_join(rows, "\n"), lambda body: codes(rows, body)))))
