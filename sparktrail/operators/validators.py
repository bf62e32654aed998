"""Checks of tables that come from outside: each gives the rows that are wrong and why; an empty result is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrail.functions.text import blank, filled
from sparktrail.operators.evidence import words_only

# What enumerated columns may hold.
INTENTS = ("request", "question", "clarification", "cancellation")
VERIFIABLE = ("action", "artifact", "outcome")
STATUSES = ("active", "superseded", "cancelled")
STRENGTHS = ("strong", "weak")
CLAIMS = ("did", "produced", "verified", "declined")
GRADES = ("A", "B", "C", "D")


def _wrong(rows: DataFrame, **tests: Column) -> DataFrame:
    """Rows with the names of the tests that they fail."""
    why = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tests.items())))
    return rows.withColumn("problems", why).filter(F.size("problems") > 0)


def _unique(*keys: str) -> Column:
    return F.count("*").over(Window.partitionBy(*keys)) == 1


def _bounded(rows: DataFrame, turns: int | DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with the last turn of their run: a number, or the highest of a table of turns (``by``, turn)."""
    if isinstance(turns, int):
        return rows.withColumn("_last", F.lit(turns))
    last = turns.groupBy(*by).agg(F.max("turn").alias("_last"))
    return rows.join(last, list(by), "left") if by else rows.crossJoin(F.broadcast(last))  # a single row


def requirements(rows: DataFrame, turns: int | DataFrame, intents: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(id, text, origin_turn, verifiable_by, status, strength, expect); turns that ask for nothing must yield none.

    A table of many runs is told apart by the columns ``by``.
    """
    rows = _bounded(rows, turns, by)
    if intents is not None:
        asks = intents.select(*by, F.col("turn").alias("origin_turn"), F.col("intent").isin("request", "clarification", "cancellation").alias("_asks"))
        rows = rows.join(asks, [*by, "origin_turn"], "left")
    return _wrong(
        rows,
        id=filled("id").isNotNull() & _unique(*by, "id"),
        text=filled(F.trim("text")).isNotNull(),
        origin_turn=F.col("origin_turn").between(F.lit(1), F.col("_last")),
        verifiable_by=F.col("verifiable_by").isin(*VERIFIABLE),
        status=F.col("status").isin(*STATUSES),
        strength=F.col("strength").isin(*STRENGTHS),
        expect=filled(F.trim("expect")).isNotNull(),
        **({"intent": F.coalesce(F.col("_asks"), F.lit(True))} if intents is not None else {}),
    ).drop("_last", "_asks")


def claims(rows: DataFrame, turns: int | DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(id, turn, kind, text, quote); a quote needs four word characters at least."""
    rows = _bounded(rows, turns, by)
    return _wrong(rows, id=filled("id").isNotNull() & _unique(*by, "id"), turn=F.col("turn").between(F.lit(1), F.col("_last")), kind=F.col("kind").isin(*CLAIMS), quote=F.length(words_only("quote")) >= 4).drop("_last")


# What a hard check may ask for, and what the map of an agent and each of its skills must have.
HARD_CHECKS = ("read_path", "artifact_glob", "invoke_agent")
AGENT_MAP = ("agent", "role", "execution_style", "skills", "hooks", "mcp_servers", "subagents")
SKILL = ("name", "purpose", "triggers", "not_for")


def _kind(value: Column) -> Column:
    """STRING, ARRAY, OBJECT, … of a variant; null of null."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(_kind(value) == kind, F.lit(False))


def _fields(value: Column) -> Column:
    """The fields of a variant object, none of anything else."""
    return F.coalesce(F.when(_is(value, "OBJECT"), F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))), F.array().cast("array<string>"))


def _items(value: Column, path: str) -> Column:
    """The items of an array in a variant, none of anything else."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def _texts(value: Column) -> Column:
    """A variant that is a string or an array of strings, as an array."""
    return F.when(_is(value, "STRING"), F.array(F.try_variant_get(value, "$", "string"))).otherwise(F.try_variant_get(value, "$", "array<string>"))


def _said(value: Column, path: str) -> Column:
    return F.coalesce(F.length(F.trim(F.try_variant_get(value, path, "string"))) > 0, F.lit(False))


def hard_checks(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, req_id, problems) of hard checks (a variant column ``hard_check``; null is none) that are no object, ask
    for what is unknown, ask for nothing, or name files with braces, which globs do not know."""
    h = F.col("hard_check")
    values = F.transform(_fields(h), lambda k: F.struct(k.alias("k"), F.element_at(F.try_variant_get(h, "$", "map<string,variant>"), k).alias("v")))
    full = lambda x: F.coalesce(F.when(_is(x["v"], "STRING"), F.length(F.try_variant_get(x["v"], "$", "string")) > 0).when(_is(x["v"], "ARRAY"), F.size(_items(x["v"], "$")) > 0), F.lit(False))
    plain = lambda x: (x["k"] != "artifact_glob") | ~F.exists(F.coalesce(_texts(x["v"]), F.array().cast("array<string>")), lambda g: g.rlike(r"\{.*?\}"))
    bad = _wrong(rows, hard_check=h.isNull() | _is(h, "OBJECT"), keys=F.forall(_fields(h), lambda k: k.isin(*HARD_CHECKS)), values=F.forall(values, full), artifact_glob=F.forall(values, plain))
    return bad.select(*by, "req_id", "problems")


def judgement_documents(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(sid, problems) of efficiency judgements (sid, data as a variant) whose parts are missing, unknown or too thin.

    Grades are A to D, for the whole and for each segment of ``known`` (sid, seg), with reasons; up to six operations of a
    segment are told in 120 characters and two digits at least, and name no segment by its number; three to eight
    recommendations have a digit each.
    """
    d = F.col("data")
    seg = lambda s: F.coalesce(F.try_variant_get(s, "$.seg", "int"), F.lit(-1))
    grade = lambda s, path: F.coalesce(F.try_variant_get(s, path, "string").isin(*GRADES), F.lit(False))
    ops = lambda s: _items(s, "$.suspicious_ops")
    text = lambda o: F.coalesce(F.when(_is(o, "STRING"), F.try_variant_get(o, "$", "string")), F.lit(""))
    told = lambda o: (F.length(text(o)) >= 120) & (F.regexp_count(text(o), F.lit("[0-9]")) >= 2) & ~text(o).rlike(r"(?i)\bseg\s*\d+\b")
    own = known.groupBy("sid").agg(F.collect_set(F.col("seg").cast("int")).alias("_segs"))
    both = rows.join(own, "sid", "left").withColumns({"_segs": F.coalesce("_segs", F.array().cast("array<int>")), "_per": _items(d, "$.per_segment"), "_recs": _items(d, "$.recommendations")})
    kind_of_ops = lambda s: F.try_variant_get(s, "$.suspicious_ops", "variant")
    return _wrong(
        both,
        document=_is(d, "OBJECT"),
        global_grade=grade(d, "$.global_grade"),
        global_reason=_said(d, "$.global_reason"),
        segments=F.forall("_per", lambda s: F.array_contains("_segs", seg(s))) & (F.size(F.array_except("_segs", F.transform("_per", seg))) == 0),
        grades=F.forall("_per", lambda s: grade(s, "$.grade")),
        reasons=F.forall("_per", lambda s: _said(s, "$.reason")),
        operations=F.forall("_per", lambda s: (kind_of_ops(s).isNull() | F.is_variant_null(kind_of_ops(s)) | _is(kind_of_ops(s), "ARRAY")) & (F.size(ops(s)) <= 6) & F.forall(ops(s), told)),
        recommendations=F.size("_recs").between(3, 8) & F.forall("_recs", lambda r: text(r).rlike("[0-9]")),
    ).select("sid", "problems")


def agent_maps(rows: DataFrame, by: str = "agent") -> DataFrame:
    """(``by``, problems) of maps of agents (a variant column ``data``) that lack a field, or a skill of which does."""
    d = F.col("data")
    skills = F.try_variant_get(d, "$.skills", "variant")
    return _wrong(
        rows,
        document=_is(d, "OBJECT"),
        fields=F.size(F.array_except(F.array(*(F.lit(k) for k in AGENT_MAP)), _fields(d))) == 0,
        skills=_is(skills, "ARRAY"),
        skill=F.forall(_items(d, "$.skills"), lambda s: _is(s, "OBJECT") & (F.size(F.array_except(F.array(*(F.lit(k) for k in SKILL)), _fields(s))) == 0)),
    ).select(by, "problems")


def sole_rules(rules: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent, files, problem) of agents that not exactly one rule file (path, target_agent) is meant for."""
    n = agents.join(rules.select(F.col("target_agent").alias("agent"), "path"), "agent", "left").groupBy("agent").agg(F.array_sort(F.collect_list("path")).alias("files"))
    return n.withColumn("problem", F.when(F.size("files") == 0, "none").when(F.size("files") > 1, "several")).filter("problem is not null")


def criteria(rows: DataFrame, required: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(req_id, anchors, artifact_glob): every requirement has one, with short anchors and globs without braces."""
    key = [*by, "req_id"]
    missing = required.select(*by, F.col("id").alias("req_id")).join(rows.select(*key), key, "left_anti").withColumn("problems", F.array(F.lit("missing")))
    bad = _wrong(rows, anchors=(F.size("anchors") > 0) & F.forall("anchors", lambda a: (F.length(F.trim(a)) > 0) & (F.length(a) <= 60)), artifact_glob=~blank("artifact_glob").rlike("[{}]"), req_id=_unique(*key))
    return bad.select(*key, "problems").unionByName(missing)


def segments(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """(sid, seg, start, stop, theme): the segments of a session follow each other from its first turn to its last."""
    order = Window.partitionBy("sid").orderBy("start", "stop")
    own = rows.join(turns.groupBy("sid").agg(F.max("turn").alias("_last")), "sid", "left")
    before = F.lag("stop").over(order)
    last = F.lead("start").over(order).isNull()
    return _wrong(
        own.withColumn("_follows", F.col("start") == F.coalesce(before, F.lit(0)) + 1).withColumn("_ends", ~last | (F.col("stop") == F.col("_last"))),
        start=F.col("_follows"), stop=(F.col("stop") >= F.col("start")) & F.col("_ends"), theme=(F.length(F.trim("theme")) > 0) & (F.length("theme") <= 60),
    ).drop("_last", "_follows", "_ends")


def judgements(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(sid, seg, grade, reason): a grade from A to D, with a reason that has digits, for every segment and no other."""
    bad = _wrong(rows.join(known.select("sid", "seg", F.lit(True).alias("_k")), ["sid", "seg"], "left"), grade=F.col("grade").isin(*GRADES), seg=F.col("_k") & _unique("sid", "seg"), reason=blank("reason").rlike("[0-9]"))
    missing = known.select("sid", "seg").join(rows.select("sid", "seg"), ["sid", "seg"], "left_anti").withColumn("problems", F.array(F.lit("missing")))
    return bad.select("sid", "seg", "problems").unionByName(missing)


def recommendations(rows: DataFrame) -> DataFrame:
    """(sid, text): three to eight for each session, each with a digit."""
    n = F.count("*").over(Window.partitionBy("sid"))
    return _wrong(rows.withColumn("_n", n), number=F.col("_n").between(3, 8), text=blank("text").rlike("[0-9]")).drop("_n")


def narratives(rows: DataFrame, least: int = 120, most: int = 4000, banned: tuple[str, ...] = ()) -> DataFrame:
    """(sid, text): of a length within bounds, with digits, without banned words."""
    clean = ~F.lower(blank("text")).rlike("|".join(banned)) if banned else F.lit(True)
    return _wrong(rows, length=F.length("text").between(least, most), digits=blank("text").rlike("[0-9]"), words=clean)
