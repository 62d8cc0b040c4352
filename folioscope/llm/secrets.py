"""Secret scan with corpus-wide ownership frequency.

Base spans are the matches of three fixed patterns; the method adds `owned` spans: long mixed tokens that few owners
hold. Every candidate value (of a base span, or a token of TOKEN that overlaps none) is hashed, and its distinct owners
and repositories are counted over the whole corpus. A value of WIDE or more owners is a widely copied example; a value
of fewer is specific to its owners and looks live. Base spans always stay; tokens are added if they look live.

DataFrame functions only. Positions are code points, end exclusive, from the lengths of the pieces between matches.
Candidates are few, leave the texts behind in a written table and are counted and joined by hash; of a value only its hash,
place and length are written or shuffled. Places, overlaps and cuts are running sums and extremes over the matches of a
text, so a very long text or one of very many matches costs in proportion (and a sort). The spans of one text are gathered
in its row. Owners are counted by partial aggregation, and the join is left to skew handling.

Null texts are empty and hold no spans. A null owner or repository counts as one named by the empty text. Repeated rows
are returned once each and add no owner. Columns named like the result's are kept inside `doc` and cannot clash. An empty
table gives an empty result.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import pin
from .common import blank, stored

#: The three base patterns; for each the group that holds the value and its least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}"
KINDS = [*BASE, "owned"]
WIDE = 3
MATCH = "array<struct<kind:int,nth:int,gap:int,size:int,hash:string,held:int>>"
SPANS = "array<struct<start:bigint,kind:int,end:bigint,live:boolean,n_owners:bigint,n_repositories:bigint>>"
CUTS = "array<struct<at:bigint,to:bigint>>"
BLOCK = 512  # code points of a block that redaction copies from


def matches(text, kind):
    """Leftmost non-overlapping matches in order: characters since the one before, own length, and its value's hash and
    length (a value ends where its match ends)."""
    pattern, group, _ = BASE.get(kind, (TOKEN, 0, 20))
    found = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length).alias("size"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def match(m, i):
        value = m["value"]
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("nth"), m["gap"].alias("gap"), m["size"].alias("size"), F.sha2(value, 256).alias("hash"), F.char_length(value).alias("held"))

    each = F.transform(F.filter(found, lambda m: m["size"].isNotNull()), match)
    return F.when(text.rlike(pattern), each.cast(MATCH)).otherwise(F.array().cast(MATCH))


def marked(docs: DataFrame, text, owner, repository, keep) -> DataFrame:
    """Written table: row, doc (the columns `keep`), owner, repository, matches of every kind."""
    whole = docs.select(F.struct(*keep).alias("doc"), blank(text).alias("body"), blank(owner).alias("owner"), blank(repository).alias("repository"))
    kinds = pin(whole, **{k: matches(F.col("body"), k) for k in KINDS})
    return stored(kinds.select(F.monotonically_increasing_id().alias("row"), "doc", "owner", "repository", F.concat(*KINDS).alias("matches")), "secrets")


def candidates(found: DataFrame) -> DataFrame:
    """Written table: row, owner, repository, kind, hash, held, start, end of base spans and of tokens that overlap none.

    Places are running sums of a kind's lengths in a text. A token is clear if no base span that starts up to its own
    start ends beyond it, and none that starts later does so before its end: two running extremes."""
    each = found.select("row", "owner", "repository", F.explode("matches").alias("m")).select("row", "owner", "repository", "m.*").repartition("row")
    first = Window.unboundedPreceding
    to_here = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(first, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(to_here)).withColumn("start", F.col("end") - F.col("size"))
    least = F.array(*[F.lit(BASE[k][2] if k in BASE else 0) for k in KINDS])
    long = placed.filter(F.col("held") >= least[F.col("kind")])
    base = F.col("kind") < len(BASE)
    earlier = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(first, 0)
    later = Window.partitionBy("row").orderBy(F.desc("start"), "kind").rowsBetween(first, 0)
    reach = long.withColumns({"reached": F.max(F.when(base, F.col("end"))).over(earlier), "next": F.min(F.when(base, F.col("start"))).over(later)})
    clear = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("next", "end") >= F.col("end"))
    return stored(reach.filter(base | clear).select("row", "owner", "repository", "kind", "hash", "held", "start", "end"), "secret-places")


def ownership(each: DataFrame) -> DataFrame:
    """Distinct owners and repositories of every candidate hash, over the whole corpus."""
    return each.groupBy("hash").agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("owner", "repository").alias("n_repositories"))


def judged(found: DataFrame, wide) -> DataFrame:
    """All base spans and the tokens that look live: row, kind, held, start, end, n_owners, n_repositories, live."""
    each = candidates(found)
    counted = each.join(ownership(each), "hash").withColumn("live", F.col("n_owners") < wide)
    return counted.filter((F.col("kind") < len(BASE)) | F.col("live"))


def scan(docs: DataFrame, text="text", owner="source", repository="lang", wide=WIDE, keep=("*",)) -> DataFrame:
    """doc (the columns `keep`), spans: array of (start, kind, end, live, n_owners, n_repositories)."""
    found = marked(docs, text, owner, repository, keep)
    span = F.struct("start", "kind", "end", "live", "n_owners", "n_repositories")
    by_row = judged(found, wide).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    return found.join(by_row, "row", "left").select("doc", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def joined(found):
    """kind:start:end of every span, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", kind[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """Per row: counts and digest of the base spans, all spans as text, and how many values look live or copied."""
    found = scan(docs, keep=["doc_id"], **options)
    spans_ = pin(found.select("doc.doc_id", F.col("spans").alias("all_spans")), base=F.filter("all_spans", lambda s: s["kind"] < len(BASE)))
    kinds = F.transform("base", lambda s: s["kind"])
    count = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    live = F.size(F.filter("all_spans", lambda s: s["live"])).cast("long")
    return spans_.select(
        "doc_id", *count, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"),
        live.alias("n_live"), (F.size("all_spans") - live).alias("n_copied"),
    )


def cuts(spans: DataFrame) -> DataFrame:
    """row, cuts: places of the values that look live, in order, overlapping ones as one."""
    live = spans.filter("live").select("row", (F.col("end") - F.col("held")).alias("at"), F.col("end").alias("to"))
    in_order = Window.partitionBy("row").orderBy("at", "to")
    first = Window.unboundedPreceding
    fresh = F.coalesce(F.max("to").over(in_order.rowsBetween(first, -1)) <= F.col("at"), F.lit(True))
    runs = live.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(in_order.rowsBetween(first, 0)))
    whole = runs.groupBy("row", "run").agg(F.min("at").alias("at"), F.max("to").alias("to"))
    return whole.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "to"))).alias("cuts"))


def between(blocks, a, b):
    """The code points from a up to b, copied from blocks of BLOCK: the cost follows the length, not the place."""

    def part(k):
        left = F.greatest(a - k * BLOCK, F.lit(0))
        right = F.least(b - k * BLOCK, F.lit(BLOCK))
        return F.substr(F.get(blocks, k), (left + 1).cast("int"), (right - left).cast("int"))

    block = [F.floor(x / BLOCK).cast("int") for x in (a, b - 1)]
    return F.when(b > a, F.array_join(F.transform(F.sequence(*block), part), "")).otherwise("")


def redact(docs: DataFrame, mark="<secret>", text="text", owner="source", repository="lang", wide=WIDE) -> DataFrame:
    """The rows, all columns, with every value that looks live replaced where it was found, and n_chars (if there) counted
    anew. Values that overlap are replaced by one mark; the text between is never searched, so nothing else changes."""
    found = marked(docs, text, owner, repository, ["*"])
    body = F.col("doc")[text]
    whole = found.join(cuts(judged(found, wide)), "row", "left").select("doc", F.coalesce("cuts", F.array().cast(CUTS)).alias("places"))
    has = F.size("places") > 0
    whole = pin(whole, blocks=F.when(has, F.regexp_extract_all(body, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))

    def piece(c, i):
        return F.concat(between(F.col("blocks"), F.coalesce(F.get(F.col("places"), i - 1)["to"], F.lit(0)), c["at"]), F.lit(mark))

    rest = between(F.col("blocks"), F.try_element_at("places", F.lit(-1))["to"], F.char_length(body))
    parted = pin(whole, fresh=F.when(has, F.concat(F.array_join(F.transform("places", piece), ""), rest)).otherwise(body))
    new = {text: F.col("fresh"), "n_chars": F.when(has, F.char_length("fresh").cast("bigint")).otherwise(F.col("doc")["n_chars"]) if "n_chars" in docs.columns else None}
    return parted.select(*[new[c].alias(c) if new.get(c) is not None else F.col("doc")[c].alias(c) for c in docs.columns])
