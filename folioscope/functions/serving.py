"""Hardening of corpus text before it is shown."""

from pyspark.sql import functions as F

from .text import col, fold_compat, let

# Characters a record may not smuggle into a header, and the fence marks.
BREAKS = r"[\r\n\x0b\x0c\x85\u2028\u2029]"
CONTROLS = r"[\x00-\x08\x0e-\x1f\x7f\u200e\u200f\u202a-\u202e\u2066-\u2069]"
FENCE_FROM, FENCE_TO = "⟪⟫《》⧼⧽", "⟨⟩〈〉⟨⟩"
DOTS = "\u00b7\u0387\u2027\u30fb\u2022\u2219\u22c5\u16eb"
STARS = "★☆"
# Texts without such a character are safe as they are: a field, a fenced text. Printable ASCII is passed over at one look.
UNSAFE_FIELD = r"[^ -~]|  |\A | \z"
UNSAFE_TEXT = rf"(?=[^\t\n -~])[\x00-\x08\x0b-\x1f\x7f\x85\u200e\u200f\u2028-\u202e\u2066-\u2069{FENCE_FROM}]"
FENCE_OPEN, FENCE_CLOSE, FENCE_PREFIX = "⟪note⟫", "⟪/note⟫", "│ "
SHOWN_DOC_TYPES = ("user", "feedback", "project", "reference", "abstraction", "belief")


def sanitize_folded(c, max_len=120):
    """For text whose compatibility folding is done or not needed."""
    def safe(c):
        s = F.regexp_replace(F.regexp_replace(c, BREAKS + "+", " "), CONTROLS, "")
        s = F.translate(s, FENCE_FROM + DOTS + STARS, FENCE_TO + "-" * len(DOTS) + "*" * len(STARS))
        return F.when(~c.rlike(UNSAFE_FIELD), c).otherwise(F.btrim(F.regexp_replace(s, r"(?U)\s+", " ")))

    def shown(s):
        return F.when(F.length(s) > max_len, F.concat(F.rtrim(F.left(s, F.lit(max_len))), F.lit("…"))).otherwise(s)

    return let(let(col(c), safe), shown)


def sanitize_field(c, max_len=120):
    return sanitize_folded(fold_compat(c), max_len)


def fence_block(c):
    safe = F.translate(col(c), FENCE_FROM, FENCE_TO)
    safe = F.regexp_replace(F.regexp_replace(safe, r"[\r\x0b\x0c\x85\u2028\u2029]", "\n"), CONTROLS, "")
    safe = F.when(~col(c).rlike(UNSAFE_TEXT), col(c)).otherwise(safe)
    body = F.concat(F.lit(FENCE_PREFIX), F.replace(safe, F.lit("\n"), F.lit("\n" + FENCE_PREFIX)))
    return F.concat(F.lit(FENCE_OPEN + "\n"), body, F.lit("\n" + FENCE_CLOSE))
