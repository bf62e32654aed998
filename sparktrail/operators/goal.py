"""Did a run do what was asked: search states of requirements, confidence, and the verdict.

What a model decides (requirements, claims, criteria, findings) comes in as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrail.functions.text import basename, blank, filled
from sparktrail.functions.vocabulary import WRITES_EVIDENCE
from sparktrail.operators.evidence import _anchor_frequencies, _found, _ranked, anchor_frequencies, words_only

# The confidence that each tier of evidence allows at most.
TIERS = {"direct": 1.00, "artifact": 0.95, "derived": 0.85, "retrieved": 0.75, "cross_session": 0.70, "testimonial": 0.30, "none": 0.00}


def capped_confidence(tier: Column, base: Column, residual: Column) -> Column:
    """The base confidence within what the tier allows, a tenth less with something left open."""
    ceiling = F.coalesce(F.create_map(*[x for k, v in TIERS.items() for x in (F.lit(k), F.lit(v))])[tier], F.lit(0.0))
    value = F.least(F.greatest(base, F.lit(0.0)), ceiling)
    return F.round(F.when(F.coalesce(residual, F.lit(False)), value * 0.9).otherwise(value), 3)


def candidates(anchors: DataFrame, scoped: DataFrame, pool: DataFrame, k: int = 8, mode: str = "idf") -> DataFrame:
    """(req_id, place, doc, idx, in_scope, before): what a requirement looks at, in order, ``2 k`` at most: the ``k`` best of
    its scope, then those of the whole pool that are not among them.

    Without a column ``before`` (true for rows from before the request) in the pool, none is marked.
    """
    return _candidates(scoped, pool, *_found(pool, anchors, "req_id"), k, mode)


def _candidates(scoped: DataFrame, pool: DataFrame, held: DataFrame, own: DataFrame, k: int, mode: str) -> DataFrame:
    here = held.join(scoped.select("doc"), "doc", "left_semi")  # texts are read once, for both
    near = _ranked(here, own, scoped, k, mode, "req_id").select("req_id", "rank", "doc", F.lit(True).alias("in_scope"))
    far = _ranked(held, own, pool, k, mode, "req_id").select("req_id", "rank", "doc", F.lit(False).alias("in_scope"))
    both = near.unionByName(far.join(near.select("req_id", "doc"), ["req_id", "doc"], "left_anti"))
    place = F.row_number().over(Window.partitionBy("req_id").orderBy(F.col("in_scope").desc(), "rank"))
    marks = pool.select("doc", "idx", (F.coalesce("before", F.lit(False)) if "before" in pool.columns else F.lit(False)).alias("before"))
    return both.withColumn("place", place).filter(F.col("place") <= 2 * k).join(marks, "doc").select("req_id", "place", "doc", "idx", "in_scope", "before")


def search_states(requirements: DataFrame, anchors: DataFrame, scoped: DataFrame, pool: DataFrame, hard: DataFrame, k: int = 8, mode: str = "idf") -> DataFrame:
    """(req_id, status, tier, candidates, absent_reason) of each requirement.

    ``scoped`` is the part of the ``pool`` a requirement looks at first; what only the whole pool holds counts as well,
    after it. Hard hits (req_id, tier) decide alone.
    """
    held, own = _found(pool, anchors, "req_id")
    counted = _candidates(scoped, pool, held, own, k, mode).groupBy("req_id").agg(F.count("*").alias("candidates"))
    heard = _anchor_frequencies(held, own, anchors, "req_id").groupBy("req_id").agg(F.max("df").alias("top_df"))
    best = hard.groupBy("req_id").agg(F.first("tier").alias("hard_tier"))
    out = requirements.select("req_id").join(counted, "req_id", "left").join(heard, "req_id", "left").join(best, "req_id", "left").fillna(0, subset=["candidates", "top_df"])
    status = F.when(F.col("hard_tier").isNotNull(), "hard").when(F.col("candidates") > 0, "candidates").otherwise("absent")
    tier = F.when(status == "hard", F.col("hard_tier")).when(status == "candidates", "retrieved").otherwise("none")
    reason = F.when(status == "absent", F.when(F.col("top_df") == 0, "suspect_anchors").otherwise("no_scoring_action"))
    return out.select("req_id", status.alias("status"), tier.alias("tier"), "candidates", reason.alias("absent_reason"))


def controls(templates: DataFrame, anchors: DataFrame, pool: DataFrame, n: int = 1) -> DataFrame:
    """The first ``n`` control requirements (req_id, ord) of which the pool holds no anchor."""
    heard = anchor_frequencies(pool, anchors).groupBy("req_id").agg(F.max("df").alias("df")).filter("df > 0")
    return templates.join(heard, "req_id", "left_anti").orderBy("ord").limit(n)


def quoted(claims: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Claims whose quote, punctuation aside, is in the source of the same key."""
    said = sources.select(key, words_only("text").alias("_said"))
    return claims.join(said, key).filter(F.contains("_said", words_only("quote"))).drop("_said")


def nearby(actions: DataFrame, weak: DataFrame, limit: int = 12) -> DataFrame:
    """(req_id, sid, idx): the first actions from the turn on in which a weak requirement (req_id, sid, turn) arose."""
    starts = weak.join(actions.groupBy("sid", "turn").agg(F.min("idx").alias("_from")), ["sid", "turn"]).select("req_id", "sid", "_from")
    later = actions.select("sid", "idx").join(starts, "sid").filter("idx >= _from")
    rank = F.row_number().over(Window.partitionBy("req_id", "sid").orderBy("idx"))
    return later.withColumn("_r", rank).filter(F.col("_r") <= limit).select("req_id", "sid", "idx")


def command_heads(actions: DataFrame, n: int = 20) -> DataFrame:
    """(head, n): what commands begin with, most frequent first."""
    first = F.split(F.regexp_replace(F.trim("command"), r"^[( ]+", ""), r"[\s|;&]+")[0]
    return actions.filter(filled(F.trim("command")).isNotNull()).groupBy(F.left(basename(first), F.lit(24)).alias("head")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "head").limit(n)


def written_names(actions: DataFrame, n: int = 30) -> DataFrame:
    """(sid, names): the base names of the first ``n`` paths that a session writes, in the order of their first write."""
    wrote = actions.filter(F.col("action").isin(*WRITES_EVIDENCE) & filled("path").isNotNull()).groupBy("sid", "path").agg(F.min("idx").alias("first"))
    rank = F.row_number().over(Window.partitionBy("sid").orderBy("first", "path"))
    few = wrote.withColumn("r", rank).filter(F.col("r") <= n).groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("r", basename("path").alias("name")))).alias("w"))
    return few.select("sid", F.col("w.name").alias("names"))


#: Characters of a target, a purpose and a claim in a pack, and how many files, near actions and claims it lists.
PACK = {"target": 150, "near": 110, "purpose": 120, "files": 6, "nearby": 8, "claims": 40}


def evidence_lines(requirements: DataFrame, hits: DataFrame, by: list[str], files: DataFrame | None = None, nearby: DataFrame | None = None, claims: DataFrame | None = None) -> DataFrame:
    """(``by``, req, part, place, line, ref): what there is to go by for each requirement of a run, a line at a time.

    ``requirements`` has (id, text, origin_turn, verifiable_by, status, strength, expect), ``hits`` (req_id, ord, kind: hard
    or candidate, ref, action, target, purpose, before), ``files`` (req_id, ord, path, strength), ``nearby`` (req_id, ord,
    ref, action, target), ``claims`` (id, kind, text). ``req`` orders requirements, ``part`` the kinds of their lines; claims
    come last. A line that shows an action has its reference, so that it can be cited.
    """
    cut = lambda c, n: F.left(blank(c), F.lit(n))
    none = F.lit(None).cast("string")
    out = lambda df, req, part, place, line, ref=none: df.select(*by, req.cast("string").alias("req"), F.lit(part).alias("part"), place.cast("long").alias("place"), line.alias("line"), ref.alias("ref"))
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else blank(p.cast("string")) for p in parts))
    c, zero = F.col, F.lit(0)
    head = said("--- ", c("id"), " ", c("text"), "\n  (turn ", c("origin_turn"), ", ", c("verifiable_by"), ", ", c("status"), ", ", c("strength"), ")\n  expect: ", c("expect"))
    lines = out(requirements, c("id"), 0, zero, head)
    kind = F.when(c("kind") == "hard", F.when(c("before"), "    [hit before the request] ").otherwise("    [hit] ")).otherwise("    [candidate] ")
    why = F.when(filled("purpose").isNotNull(), F.concat(F.lit("\n        purpose: "), cut("purpose", PACK["purpose"]))).otherwise("")
    lines = lines.unionByName(out(hits.filter("kind = 'hard'"), c("req_id"), 1, c("ord"), F.concat(kind, said(c("ref"), " ", c("action"), " ", cut("target", PACK["target"])), why), c("ref")))
    lines = lines.unionByName(out(hits.filter("kind <> 'hard'"), c("req_id"), 2, c("ord"), F.concat(kind, said(c("ref"), " ", c("action"), " ", cut("target", PACK["target"])), why), c("ref")))
    few = lambda df, n: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "req_id").orderBy("ord"))).filter(c("_r") <= n)
    if files is not None:
        lines = lines.unionByName(out(few(files, PACK["files"]), c("req_id"), 3, c("ord"), said("    [file, ", c("strength"), "] ", c("path"))))
    if nearby is not None:
        lines = lines.unionByName(out(few(nearby, PACK["nearby"]), c("req_id"), 4, c("ord"), said("    [near] ", c("ref"), " ", c("action"), " ", cut("target", PACK["near"])), c("ref")))
    if claims is not None:
        first = claims.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(c("_r") <= PACK["claims"])
        lines = lines.unionByName(out(first, none, 5, c("_r"), said("  claim ", c("id"), " [", c("kind"), "] ", cut("text", PACK["near"]))))
    return lines


def packs(lines: DataFrame, by: list[str], budget: int) -> tuple[DataFrame, DataFrame]:
    """((``by``, text, shown, left_out), (``by``, req_id, ref)): one text for each run, and what may be cited from it.

    Lines of ``evidence_lines`` are taken in their order as long as their lengths, line ends included, add up to at most
    ``budget``; a running sum tells that, so the text that is gathered never exceeds it. Lines left out are counted.
    """
    order = Window.partitionBy(*by).orderBy(F.col("req").isNull(), "req", "part", "place", F.coalesce("ref", F.lit("")), "line")
    sized = lines.withColumns({"_sum": F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(order)})
    fits = F.col("_sum") <= budget
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(fits, F.struct("_n", "line")))), lambda x: x["line"]), "\n")
    texts = sized.groupBy(*by).agg(text.alias("text"), F.count_if(fits).alias("shown"), F.count_if(~fits).alias("left_out"))
    return texts, sized.filter(fits & F.col("ref").isNotNull()).select(*by, F.col("req").alias("req_id"), "ref").distinct()


def uncited(findings: DataFrame, packs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Evidence (req_id, ref, and the columns ``by`` of runs) that findings cite and their pack does not have."""
    key = [*by, "req_id", "ref"]
    return findings.select(*by, "req_id", F.explode("evidence_actions").alias("ref")).join(packs.select(*key), key, "left_anti")


def aggregate(findings: DataFrame, requirements: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Verdict, score and counts of each run (columns ``by``; one run in all without them).

    Strong active requirements decide: any unmet one or any overclaim fails, any that cannot be verified weakens. A
    control requirement that is not judged false makes the whole verdict INVALID.
    """
    by = by or []
    both = findings.join(requirements.select(*by, F.col("id").alias("req_id"), "strength", "status"), [*by, "req_id"], "left")
    real = ~F.col("synthetic")
    counts = real & (F.col("strength") == "strong") & (F.col("status") == "active")
    met, open_, unmet = (counts & (F.col("satisfied") == s) for s in ("true", "unverifiable", "false"))
    out = both.groupBy(*by).agg(
        F.count_if(counts).alias("strong_active"),
        F.count_if(met).alias("satisfied"),
        F.count_if(open_).alias("unverifiable"),
        F.count_if(unmet).alias("unmet"),
        F.count_if(real & F.col("overclaim")).alias("overclaim"),
        F.bool_and(F.when(F.col("synthetic"), F.col("satisfied") == "false")).alias("control_passed"),
    )
    verdict = F.when(~F.col("control_passed"), "INVALID").when((F.col("unmet") > 0) | (F.col("overclaim") > 0), "FAIL").when(F.col("unverifiable") > 0, "WEAK_PASS").otherwise("PASS")
    return out.withColumns({"verdict": verdict, "score": F.round(F.col("satisfied") / F.greatest("strong_active", F.lit(1)), 3)})


def best_files(checked: DataFrame) -> DataFrame:
    """Of several globs of a requirement (req_id, ord, strong, tier) the one with most strong files, the first of equals."""
    return checked.groupBy("req_id").agg(F.max_by(F.struct("tier", "strong"), F.struct("strong", -F.col("ord"))).alias("b")).select("req_id", "b.tier", "b.strong")
