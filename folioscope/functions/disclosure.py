"""Who may see a record: classes, seals, envelopes and standing permissions."""

from pyspark.sql import functions as F

from .text import DISCLOSURE_CLASSES, blank, col, is_abstraction, no_strings, strip

# Modes from most to least restrictive, and the seal token shape.
MODES = ("adversarial", "independent", "collaborative", "full")
SEAL_TOKEN = r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z"


def disclosure_class(raw, belief_state, default, doc_type, path):
    explicit = F.lower(strip(blank(raw)))
    state = blank(belief_state)
    return (
        F.when(explicit.isin(*DISCLOSURE_CLASSES), explicit)
        .when(state == "draft", F.lit("private"))
        .when(state != "", F.lit("artifact"))
        .when(is_abstraction(doc_type, path), F.lit("proposal"))
        .otherwise(blank(default))
    )


def admits(mode, cls):
    return (
        F.when(mode == "full", F.lit(True))
        .when(mode == "collaborative", cls.isin("artifact", "proposal"))
        .when(mode == "independent", cls == "artifact")
        .otherwise(F.lit(False))
    )


def parse_seal(raw):
    """ARRAY of slugs; null = no seal declared; one malformed token voids the whole seal."""
    tokens = F.filter(F.split(strip(raw), r"[,\s]+"), lambda t: t != "")
    clean = F.forall(tokens, lambda t: t.rlike(SEAL_TOKEN))
    return F.when(col(raw).isNotNull(), F.when(clean, F.array_distinct(tokens)).otherwise(no_strings()))


def seal_is_void(raw):
    tokens = F.filter(F.split(strip(raw), r"[,\s]+"), lambda t: t != "")
    return F.coalesce(~F.forall(tokens, lambda t: t.rlike(SEAL_TOKEN)), F.lit(False))


def _mode(raw):
    v = F.lower(strip(raw))
    return F.when(v.isin(*MODES), v).otherwise(F.lit(MODES[0])), v.isin(*MODES)


def mode_rank(mode):
    return F.array_position(F.array(*[F.lit(m) for m in MODES]), mode)


def resolve_envelope(requests):
    """Requests carry ceiling_mode, ceiling_seal, requested_mode, requested_seal and the standing columns
    allowed_doc_types, allowed_path_prefixes, force_priority_only, default_class. Adds `envelope`; it never widens."""
    ceiling, ceiling_known = _mode("ceiling_mode")
    ceiling = F.when(F.col("ceiling_mode").isNull(), F.lit("full")).otherwise(ceiling)
    asked, asked_known = _mode("requested_mode")
    bad_ceiling = F.col("ceiling_mode").isNotNull() & ~ceiling_known
    bad_request = F.col("requested_mode").isNotNull() & ~asked_known
    mode = F.when(
        F.col("requested_mode").isNotNull() & (mode_rank(asked) < mode_rank(ceiling)), asked
    ).otherwise(ceiling)
    base = F.when(bad_ceiling | bad_request, no_strings()).otherwise(parse_seal("ceiling_seal"))
    wanted = parse_seal("requested_seal")
    sealed = (
        F.when(wanted.isNull(), base).when(base.isNull(), wanted).otherwise(F.array_intersect(base, wanted))
    )
    default = F.lower(strip(blank("default_class")))
    warnings = (
        bad_ceiling.cast("int") + bad_request.cast("int")
        + seal_is_void("ceiling_seal").cast("int") + seal_is_void("requested_seal").cast("int")
        + ((default != "") & ~default.isin(*DISCLOSURE_CLASSES)).cast("int")
    )
    types = F.transform(F.coalesce(F.col("allowed_doc_types"), no_strings()), lambda x: strip(x))
    prefixes = F.transform(
        F.coalesce(F.col("allowed_path_prefixes"), no_strings()), lambda p: strip(F.replace(p, F.lit("\\"), F.lit("/")))
    )
    return requests.withColumn(
        "envelope",
        F.struct(
            mode.alias("mode"),
            sealed.alias("sealed"),
            F.filter(types, lambda x: x != "").alias("allowed_doc_types"),
            F.filter(prefixes, lambda x: x != "").alias("allowed_path_prefixes"),
            F.coalesce(F.col("force_priority_only"), F.lit(False)).alias("force_priority_only"),
            F.when(default.isin(*DISCLOSURE_CLASSES), default).otherwise(F.lit("")).alias("default_class"),
            warnings.alias("warnings"),
        ),
    )


def permitted(path, doc_type, is_priority, env):
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    return (
        ((F.size(env["allowed_doc_types"]) == 0) | F.array_contains(env["allowed_doc_types"], col(doc_type)))
        & (~env["force_priority_only"] | col(is_priority))
        & ((F.size(env["allowed_path_prefixes"]) == 0)
           | F.exists(env["allowed_path_prefixes"], lambda pre: F.startswith(p, pre)))
    )


def in_scope(requested, env):
    """False when a request names a doc type outside its allowlist: it then gets nothing, never everything."""
    return (
        (F.size(env["allowed_doc_types"]) == 0)
        | col(requested).isNull()
        | F.coalesce(F.array_contains(env["allowed_doc_types"], col(requested)), F.lit(False))
    )
