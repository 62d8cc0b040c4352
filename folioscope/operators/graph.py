"""Evidence graph of beliefs: grounding, promotion gate, withdrawal cascade; link graph."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank
from ..params import DEFAULTS
from ..session import cut, new_folder, written

UNSOUND = ("draft", "retracted")
SHOWN = 5  # examples in the text of a check; `gate_details` has all of them


def resolve_evidence(evidence: DataFrame, docs: DataFrame, beliefs: DataFrame) -> DataFrame:
    """One row per evidence edge with `target`: attested, unattested, unresolved, observation, unsound, belief.

    docs: slug, author. beliefs: belief_id, persona, state. A slug named by both is a belief."""
    b = beliefs.select(F.col("belief_id").alias("slug"), F.col("state").alias("_state"), F.col("persona").alias("_persona"))
    d = docs.groupBy("slug").agg(F.min("author").alias("_author")).withColumn("_doc", F.lit(True))  # the first author of a shared slug
    link = F.col("kind") == "link"
    j = evidence.join(b, "slug", "left").join(d, "slug", "left")
    target = (
        F.when(~link & ~F.col("verified"), F.lit("unattested"))
        .when(~link, F.lit("attested"))
        .when((F.col("slug") == "") | (F.col("_state").isNull() & F.col("_doc").isNull()), F.lit("unresolved"))
        .when(F.col("_state").isNull(), F.lit("observation"))
        .when(F.col("_state").isin(*UNSOUND), F.lit("unsound"))
        .otherwise(F.lit("belief"))
    )
    return j.select(
        "belief_id", "ref", "slug", target.alias("target"), F.col("_state").alias("state"),
        F.when(target == "attested", F.lit("")).otherwise(blank("_author")).alias("root_author"),
        F.when(target == "attested", F.col("ref")).otherwise(F.col("slug")).alias("root"),
    )


HOPS = 8  # hops of one round; a power of two


def jumps(steps: DataFrame, hops: int) -> DataFrame:
    """(node, next, by): every belief within `hops` steps of a node and the least number of steps, by doubling."""
    out, reached = steps.withColumn("by", F.lit(1)), 1
    while reached < hops:
        on = out.select(F.col("node").alias("next"), F.col("next").alias("_next"), F.col("by").alias("_by"))
        # a way of 2n steps is one of exactly n steps and one of up to n
        twice = out.filter(F.col("by") == reached).join(on, "next").select("node", F.col("_next").alias("next"), (F.col("by") + F.col("_by")).alias("by"))
        out = written(out.unionByName(twice).groupBy("node", "next").agg(F.min("by").alias("by")), "jumps")
        reached *= 2
    return out


def reach(edges: DataFrame, starts: DataFrame, hops: int = HOPS) -> DataFrame:
    """(start, node, dist) for every start: breadth first over sound beliefs, all starts at once.

    A round jumps up to `hops` steps from the nodes of the last level, keeps the least distance of each (start, node),
    drops what earlier rounds found and writes the rest to the shared folder; the nodes farthest out begin the next
    round. The shortest way to a node passes through the last level, so the distances are right. All rounds are read back
    as one table, however many there were. The table of jumps covers all beliefs: for a few starts, `hops` of 1 does less."""
    steps = written(edges.filter("target = 'belief'").select(F.col("belief_id").alias("node"), F.col("slug").alias("next")).distinct(), "steps")
    spark, folder = edges.sparkSession, new_folder(edges.sparkSession, "reach")
    jump = jumps(steps, hops)
    first = starts.select(F.col("belief_id").alias("start"), F.col("belief_id").alias("node")).distinct().withColumn("dist", F.lit(0))
    paths, far = [f"{folder}/0"], 0
    first.write.parquet(paths[0])

    def read(*some):
        return spark.read.schema(first.schema).parquet(*some)

    while True:
        last = read(paths[-1]).filter(F.col("dist") == far).select("start", "node")
        found = last.join(jump, "node").groupBy("start", F.col("next").alias("node")).agg((F.min("by") + far).alias("dist"))
        paths.append(f"{folder}/{len(paths)}")
        found.join(read(*paths[:-1]), ["start", "node"], "left_anti").write.parquet(paths[-1])
        far += hops
        if read(paths[-1]).filter(F.col("dist") == far).isEmpty():
            return read(*paths)


def arrivals(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Every evidence edge of every reached node, per start."""
    return reached.withColumnRenamed("node", "belief_id").join(edges, "belief_id")


def ground(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(belief_id, category, item, dist, author) in long form, one row per start and distinct thing below it.

    category: root, unresolved, unattested, unsound, cycle. `dist` of a root is its number of hops. A belief reached
    twice counts as a cycle, also when two sound paths meet in it."""
    a = arrivals(edges, reach(edges, starts)).withColumnRenamed("start", "start_id")
    target = F.col("target")
    is_root = target.isin("attested", "observation")
    item = F.when(is_root, F.col("root")).when(target.isin("belief", "unsound"), F.col("slug")).otherwise(F.col("ref"))
    per = a.groupBy("start_id", F.when(is_root, F.lit("root")).otherwise(target).alias("category"), item.alias("item")).agg(
        F.count(F.lit(1)).alias("times"), (F.min("dist") + 1).alias("dist"), F.max("root_author").alias("author"),
        F.max("state").alias("state"),
    )
    again = (F.col("category") == "belief") & ((F.col("times") > 1) | (F.col("item") == F.col("start_id")))
    return per.filter((F.col("category") != "belief") | again).select(
        F.col("start_id").alias("belief_id"),
        F.when(F.col("category") == "belief", F.lit("cycle")).otherwise(F.col("category")).alias("category"),
        F.when(F.col("category") == "unsound", F.concat("item", F.lit(" ("), "state", F.lit(")"))).otherwise(F.col("item")).alias("item"),
        "dist", "author",
    )


def ground_summary(beliefs: DataFrame, items: DataFrame, shown: int = SHOWN) -> DataFrame:
    """Per belief: depth, numbers of distinct roots, of roots written by someone else, of each defect, and the first
    `shown` examples of each defect."""
    d = items.join(beliefs.select("belief_id", "persona"), "belief_id")

    def n(category):
        return F.count_if(F.col("category") == category)

    counts = d.groupBy("belief_id").agg(
        n("root").alias("n_roots"),
        F.count_if((F.col("category") == "root") & (F.col("author") != F.col("persona"))).alias("n_independent"),
        F.min(F.when(F.col("category") == "root", F.col("dist"))).alias("depth"),
        *[n(c).alias(f"n_{c}") for c in ("unresolved", "unattested", "unsound", "cycle")],
    )
    first = Window.partitionBy("belief_id", "category").orderBy("item")
    few = items.filter("category <> 'root'").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= shown)
    names = few.groupBy("belief_id").agg(*[
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("category") == c, F.col("item")))), ", ").alias(f"some_{c}")
        for c in ("unresolved", "unattested", "unsound", "cycle")
    ])
    need = F.when((F.lower("confidence") == "high") | (F.lower("impact") == "action"), 2).otherwise(1)
    out = beliefs.select("belief_id", need.alias("need")).join(counts, "belief_id", "left").join(names, "belief_id", "left")
    numbers = ["n_roots", "n_independent"] + [f"n_{c}" for c in ("unresolved", "unattested", "unsound", "cycle")]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers}).withColumns(
        {f"some_{c}": blank(f"some_{c}") for c in ("unresolved", "unattested", "unsound", "cycle")}
    )


def rivals(beliefs: DataFrame, supersessions: DataFrame, asked: DataFrame = None) -> DataFrame:
    """Per asked belief (all by default) how many promoted beliefs claim its subject without being declared superseded, and the first of them.

    Counts are aggregated per subject before the join, so a hot subject costs one row per belief, never a pair."""
    asked = beliefs if asked is None else asked
    promoted = beliefs.filter("state = 'promoted' and subject <> ''")
    per_subject = promoted.groupBy("subject").agg(F.count(F.lit(1)).alias("n_promoted"))
    first = promoted.groupBy("subject").agg(F.min("belief_id").alias("first_id"))
    mine = asked.select("belief_id", "rel_path", "subject", "state").join(per_subject.join(first, "subject"), "subject")
    # rivals a belief declares replaced: bounded by its own supersession edges
    declared = (
        asked.select("belief_id", "rel_path", "subject")
        .join(supersessions.select(F.col("src_path").alias("rel_path"), F.col("tgt_slug").alias("other")).distinct(), "rel_path")
        .join(promoted.select(F.col("belief_id").alias("other"), F.col("subject").alias("other_subject")), "other")
        .filter("subject = other_subject and other <> belief_id")
        .groupBy("belief_id").agg(F.count(F.lit(1)).alias("n_declared"))
    )
    own = F.when(F.col("state") == "promoted", 1).otherwise(0)
    return mine.join(declared, "belief_id", "left").select(
        "belief_id", (F.col("n_promoted") - own - F.coalesce("n_declared", F.lit(0))).alias("n_rivals")
    ).filter("n_rivals > 0")


def rival_pairs(beliefs: DataFrame, supersessions: DataFrame, asked: DataFrame) -> DataFrame:
    """(belief_id, rival): every promoted belief that claims an asked belief's subject and is not declared superseded."""
    promoted = beliefs.filter("state = 'promoted' and subject <> ''").select(F.col("belief_id").alias("rival"), "subject")
    declared = supersessions.select(F.col("src_path").alias("rel_path"), F.col("tgt_slug").alias("rival")).distinct()
    pairs = asked.select("belief_id", "rel_path", "subject").join(promoted, "subject").filter("belief_id <> rival")
    return pairs.join(declared, ["rel_path", "rival"], "left_anti").select("belief_id", "rival")


def gate_details(beliefs: DataFrame, items: DataFrame, supersessions: DataFrame, asked: DataFrame = None) -> DataFrame:
    """(belief_id, code, item): everything that the checks G1, G2 and G5 found, one row each."""
    codes = {"unresolved": "G1", "unattested": "G1", "cycle": "G2", "unsound": "G2"}
    code = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.col("category")]
    found = items.filter(F.col("category").isin(*codes)).select("belief_id", code.alias("code"), "item")
    rival = rival_pairs(beliefs, supersessions, beliefs if asked is None else asked)
    return found.unionByName(rival.select("belief_id", F.lit("G5").alias("code"), F.col("rival").alias("item")))


def gate(beliefs: DataFrame, evidence: DataFrame, edges: DataFrame, supersessions: DataFrame, today: str,
         max_depth=DEFAULTS.belief_max_depth, items: DataFrame = None, asked: DataFrame = None) -> DataFrame:
    """(belief_id, code, passed, detail): every promotion check of every asked belief (all by default)."""
    asked = beliefs if asked is None else asked
    items = items if items is not None else cut(ground(edges, asked))
    cited = evidence.groupBy("belief_id").agg(F.count(F.lit(1)).alias("n_cited"))
    d = (
        asked.join(ground_summary(asked, items), "belief_id").join(cited, "belief_id", "left")
        .join(rivals(beliefs, supersessions, asked), "belief_id", "left")
        .withColumns({"n_cited": F.coalesce("n_cited", F.lit(0)), "n_rivals": F.coalesce("n_rivals", F.lit(0))})
    )
    due = F.try_to_date(F.left("verify_by", F.lit(10)), "yyyy-MM-dd")
    signer = F.trim("countersigned_by")
    action = F.lower("impact") == "action"
    missing = F.array_compact(F.array(
        *[F.when(F.col(c) == "", F.lit(c)) for c in ("persona", "created", "subject", "claim")],
        F.when(F.col("n_cited") == 0, F.lit("evidence")),
    ))
    loose = F.array_compact(F.array(
        F.when(F.col("n_unresolved") > 0, F.concat(F.lit("unresolved: "), "some_unresolved")),
        F.when(F.col("n_unattested") > 0, F.concat(F.lit("external not attested: "), "some_unattested")),
    ))

    def check(code, ladder, default):
        """ladder: (condition, passed, detail) in order."""
        out = F
        for cond, ok, detail in ladder:
            row = F.struct(F.lit(code).alias("code"), F.lit(ok).alias("passed"), detail.alias("detail"))
            out = out.when(cond, row)
        return out.otherwise(F.struct(F.lit(code).alias("code"), F.lit(True).alias("passed"), default.alias("detail")))

    def text(fmt, *cols):
        return F.format_string(fmt, *cols)

    checks = F.array_compact(F.array(
        check("G1", [(F.size(loose) > 0, False, F.array_join(loose, "; ")), (F.col("n_cited") == 0, False, F.lit("no evidence cited"))],
              text("%d citation(s) dereference", "n_cited")),
        check("G2", [(F.col("n_cycle") > 0, False, F.concat(F.lit("self-citation cycle via "), "some_cycle")),
                     (F.col("n_unsound") > 0, False, F.concat(F.lit("cites unreviewed/withdrawn belief: "), "some_unsound"))],
              F.lit("acyclic, cites no draft")),
        check("G3", [(F.col("depth").isNull(), False, F.lit("no path to any observation")),
                     (F.col("depth") > max_depth, False, text("nearest observation is %d hops (max " + str(max_depth) + ")", "depth"))],
              text("nearest observation %d hop(s) away", "depth")),
        check("G4", [(F.col("n_roots") < F.col("need"), False, text("%d distinct root(s), needs %d", "n_roots", "need")),
                     (F.col("n_independent") == 0, False, text("all %d root(s) authored by '%s'", "n_roots", "persona"))],
              text("%d distinct root(s), %d independent", "n_roots", "n_independent")),
        check("G5", [(F.col("n_rivals") > 0, False, text("%d promoted belief(s) contradict without a supersedes edge", "n_rivals"))],
              F.lit("no undeclared rival")),
        check("G6", [(F.size(missing) > 0, False, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))], F.lit("complete")),
        check("G7", [((F.col("verify_by") != "") & due.isNull(), False, F.lit("verify_by is not an ISO date")),
                     (due < F.lit(today).cast("date"), False, F.concat(F.lit("verify_by "), due.cast("string"), F.lit(" already passed")))],
              F.lit("not expired")),
        F.when(action, check("G7a", [(signer == "", False, F.lit("action requires a countersignature")),
                                     (signer == F.col("persona"), False, F.lit("countersigned by its own author"))],
                             F.concat(F.lit("countersigned by "), signer))),
    ))
    return d.select("belief_id", F.inline(checks))


def promotable(checks: DataFrame) -> DataFrame:
    return checks.groupBy("belief_id").agg(F.bool_and("passed").alias("passed"))


def promote(beliefs: DataFrame, checks: DataFrame, asked: DataFrame, today: str) -> DataFrame:
    """Belief table after promoting the asked ids whose every check passed."""
    ok = promotable(checks).filter("passed").join(asked.select("belief_id"), "belief_id", "left_semi").select("belief_id", F.lit(True).alias("_up"))
    up = F.coalesce("_up", F.lit(False))
    return beliefs.join(ok, "belief_id", "left").withColumns({
        "state": F.when(up, F.lit("promoted")).otherwise(F.col("state")),
        "promoted_at": F.when(up, F.lit(today)).otherwise(F.col("promoted_at")),
    }).select(*beliefs.columns)


def cascade(beliefs: DataFrame, evidence: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """(belief_id, hops): promoted beliefs resting on any withdrawn id through link evidence, nearest distance. One
    row per belief and level, whatever the number of sources."""
    promoted = beliefs.filter("state = 'promoted'").select("belief_id")
    parents = cut(
        evidence.filter("kind = 'link' and slug <> ''").select("belief_id", "slug").distinct()
        .join(promoted, "belief_id", "left_semi").join(withdrawn.select("belief_id"), "belief_id", "left_anti")
    )
    level = cut(withdrawn.select("belief_id").distinct())
    seen, out, hops = None, None, 0
    while True:
        hops += 1
        nxt = parents.join(level.withColumnRenamed("belief_id", "slug"), "slug", "left_semi").select("belief_id").distinct()
        level = cut(nxt if seen is None else nxt.join(seen, "belief_id", "left_anti"))
        if level.isEmpty():
            break
        tagged = level.withColumn("hops", F.lit(hops))
        seen = level if seen is None else seen.unionByName(level)
        out = tagged if out is None else out.unionByName(tagged)
    return out if out is not None else level.withColumn("hops", F.lit(0))


def retract(beliefs: DataFrame, evidence: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked ids become retracted; what rests on them is flagged for review, never deleted."""
    gone = asked.select("belief_id").distinct()
    flagged = cascade(beliefs, evidence, gone).select("belief_id", F.lit(True).alias("_flag"))
    d = beliefs.join(gone.withColumn("_gone", F.lit(True)), "belief_id", "left").join(flagged, "belief_id", "left")
    return d.withColumn(
        "state", F.when(F.col("_gone"), F.lit("retracted")).when(F.col("_flag"), F.lit("needs_review")).otherwise(F.col("state"))
    ).select(*beliefs.columns)


def dangling_targets(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Canonical link targets that name no document, with their number of edges."""
    named = links.filter("tgt_slug <> ''").groupBy(F.col("tgt_slug").alias("slug")).agg(F.count(F.lit(1)).alias("edges"))
    return named.join(docs.select("slug").distinct(), "slug", "left_anti")


def one_way_links(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Resolved references that are not answered by one in the other direction."""
    own = docs.select(F.col("rel_path").alias("src_path"), F.col("slug").alias("src_slug"))
    edges = links.filter("tgt_slug <> ''").join(own, "src_path").select("src_slug", "tgt_slug").distinct()
    known = edges.join(docs.select(F.col("slug").alias("tgt_slug")).distinct(), "tgt_slug", "left_semi").filter("src_slug <> tgt_slug")
    back = known.select(F.col("tgt_slug").alias("src_slug"), F.col("src_slug").alias("tgt_slug"))
    return known.join(back, ["src_slug", "tgt_slug"], "left_anti").select("src_slug", "tgt_slug")
