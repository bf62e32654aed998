"""Evidence: trees of sessions, retrieval of actions by anchors, hard checks, files against a run's time window."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrail.functions.text import blank, dirname, filled, first_filled, glob_expression
from sparktrail.functions.vocabulary import WRITES_EVIDENCE
from sparktrail.operators.links import small, written
from sparktrail.operators.predicates import serialised

# Actions that read, for hard checks.
READS = ("read_file", "list_dir", "read_image", "search_content", "search_files")


def run_tree(sessions: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, sid, depth): each root with its descendants down to ``depth``, by equi-joins on the parent link.

    ``sessions`` has (sid, parent), ``roots`` (sid). A session that can be reached twice keeps its smallest depth, so
    cycles end.
    """
    links = sessions.filter("parent is not null").select(F.col("parent").alias("_p"), F.col("sid").alias("_c"))
    level = roots.select(F.col("sid").alias("root"), "sid", F.lit(0).alias("depth"))
    out = level
    for d in range(1, depth + 1):
        level = level.join(links, F.col("sid") == F.col("_p")).select("root", F.col("_c").alias("sid"), F.lit(d).alias("depth"))
        out = out.unionByName(level)
    return out.groupBy("root", "sid").agg(F.min("depth").alias("depth"))


def tree_actions(actions: DataFrame, sessions: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """The actions of every root's tree in one order: (root, place from 0, depth, and the columns of ``actions``).

    Sessions come level by level, those of a level in the order of their parents and then of their ids, each with its
    actions in their order; a session that can be reached twice counts where it is met first. A session's place among the
    others is told by the ids on its way from the root, so no tree is gathered to walk it.
    """
    links = sessions.filter("parent is not null").select(F.col("parent").alias("_p"), F.col("sid").alias("_c"))
    level = roots.select(F.col("sid").alias("root"), "sid", F.array("sid").alias("way"))
    met = level
    for _ in range(depth):
        level = level.join(links, F.col("sid") == F.col("_p")).select("root", F.col("_c").alias("sid"), F.concat("way", F.array("_c")).alias("way"))
        met = met.unionByName(level)
    first = met.groupBy("root", "sid").agg(F.min(F.struct(F.size("way").alias("n"), "way")).alias("w"))
    both = first.join(actions, "sid")
    place = F.row_number().over(Window.partitionBy("root").orderBy("w.n", "w.way", "idx")) - 1
    return both.select("root", place.alias("place"), (F.col("w.n") - 1).alias("depth"), *actions.columns)


def time_windows(tree: DataFrame, sessions: DataFrame) -> DataFrame:
    """(root, lower, upper): from the first creation to the last change in a tree."""
    return tree.join(sessions.select("sid", "created_at", "modified_at"), "sid").groupBy("root").agg(F.min("created_at").alias("lower"), F.max("modified_at").alias("upper"))


def searchable() -> Column:
    """What anchors are looked for in: the action's text, its purpose and its thought, in lower case."""
    return F.lower(F.concat_ws("\n", serialised(), filled("purpose"), filled("reasoning")))


def overview(actions: DataFrame) -> DataFrame:
    """Of each session: sizes, written folders, what there is to go by, and what went wrong."""
    written = F.col("action").isin(*WRITES_EVIDENCE) & filled("path").isNotNull()
    return actions.groupBy("sid").agg(
        F.max("turn").alias("turns"),
        F.count("*").alias("actions"),
        F.count_if(written).alias("writes"),
        F.array_sort(F.collect_set(F.when(written, dirname("path")))).alias("written_dirs"),
        F.coalesce(F.bool_or(filled("reasoning").isNotNull()), F.lit(False)).alias("has_reasoning"),
        F.coalesce(F.bool_or(F.col("ts").isNotNull()), F.lit(False)).alias("has_timestamps"),
        F.count_if("blocked").alias("blocked"),
        F.count_if(~F.coalesce(F.col("completed"), F.lit(False)) & ~F.coalesce(F.col("blocked"), F.lit(False))).alias("orphans"),
    )


def turn_ranges(actions: DataFrame) -> DataFrame:
    """(sid, turn, actions, first_idx, last_idx)."""
    return actions.groupBy("sid", "turn").agg(F.count("*").alias("actions"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


#: Anchors that one pass over the texts looks for, finds that it gives out at a time, and texts that it is given at a time.
PASS_ANCHORS, PASS_FOUND, PASS_TEXTS = 200_000, 1 << 16, 512


@contextlib.contextmanager
def _few_texts(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most PASS_TEXTS rows for what is run inside; afterwards the session is as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), PASS_TEXTS) if int(before) > 0 else PASS_TEXTS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _holding(pool: DataFrame, anchors: list[str]) -> DataFrame:
    """(doc, idx, anchor) of the pool rows for each of some anchors that their text holds, in one pass over the texts."""
    kind = T.StructType([pool.schema["doc"], pool.schema["idx"], T.StructField("anchor", T.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        finder = ahocorasick.Automaton()
        names = pa.array(anchors, pa.string())
        for nth, anchor in enumerate(anchors):
            finder.add_word(anchor, nth)
        finder.make_automaton()
        for batch in batches:

            def told(rows: list[int], held: list[int], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                take = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), names.take(pa.array(held, pa.int64()))], kind.names)

            rows, held = [], []
            for i, text in enumerate(batch.column(2)):
                own = {nth for _, nth in finder.iter(text.as_py() or "")}
                rows += [i] * len(own)
                held += own
                if len(rows) >= PASS_FOUND:
                    yield told(rows, held)
                    rows, held = [], []
            if rows:
                yield told(rows, held)

    return pool.select("doc", "idx", "text").mapInArrow(find, kind)


def _found(pool: DataFrame, anchors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Written down: what is held of distinct anchors (doc, idx, _low), and the anchors (_key, anchor,
    _low, _nth), _low being an anchor in lower case.

    The anchors are what callers state, a few for a requirement, so the driver holds them; texts are read once for
    ``PASS_ANCHORS`` of them by one automaton, however many requirements share an anchor.
    """
    own = anchors.filter(F.trim("anchor") != "").select(F.col(key).alias("_key"), "anchor", F.lower("anchor").alias("_low"), F.monotonically_increasing_id().alias("_nth"))
    own = written(own)
    wanted = sorted(r[0] for r in own.select("_low").distinct().toLocalIterator())
    parts = [_holding(pool, wanted[at : at + PASS_ANCHORS]) for at in range(0, max(len(wanted), 1), PASS_ANCHORS)]
    held = parts[0]
    for part in parts[1:]:
        held = held.unionByName(part)
    with _few_texts(pool.sparkSession):
        return written(held.withColumnRenamed("anchor", "_low")), own


def _frequencies(held: DataFrame) -> DataFrame:
    """(_low, df): how many rows of the pool hold each anchor."""
    return held.groupBy("_low").agg(F.count_distinct("doc").alias("df"))


def anchor_frequencies(pool: DataFrame, anchors: DataFrame, key: str = "req_id") -> DataFrame:
    """(req_id, anchor, df): how many rows of the pool hold each anchor; 0 for those that none does."""
    return _anchor_frequencies(*_found(pool, anchors, key), anchors, key)


def _anchor_frequencies(held: DataFrame, own: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    counted = own.select(F.col("_key").alias(key), "anchor", "_low").distinct().join(_frequencies(held), "_low").drop("_low")
    return anchors.select(key, "anchor").distinct().join(counted, [key, "anchor"], "left").fillna(0, subset=["df"])


def retrieve(pool: DataFrame, anchors: DataFrame, k: int = 8, mode: str = "idf", key: str = "req_id") -> DataFrame:
    """(req_id, rank, doc, score, hits): the ``k`` pool rows (doc, text, idx) that hold most anchors of a requirement.

    By ``idf`` an anchor counts ln(1 + n / (1 + df)), n rows being in the pool; by ``count`` one. An anchor that is
    given twice counts twice.
    """
    return _ranked(*_found(pool, anchors, key), pool, k, mode, key)


def _ranked(held: DataFrame, own: DataFrame, pool: DataFrame, k: int, mode: str, key: str) -> DataFrame:
    n = max(pool.count(), 1) if mode == "idf" else 1
    weight = F.log(1 + F.lit(n) / (1 + F.col("df"))) if mode == "idf" else F.lit(1.0)
    weighed = own.join(_frequencies(held), "_low").select("_low", "_key", weight.alias("w"))
    scored = held.join(weighed, "_low").groupBy("_key", "doc", "idx").agg(F.sum("w").alias("score"), F.count("*").alias("hits"))
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(F.round("score", 9).desc(), F.col("hits").desc(), "idx", "doc"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("_key").alias(key), "rank", "doc", F.round("score", 3).alias("score"), "hits")


def around(actions: DataFrame, centres: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """(sid, centre, idx, action) of the actions around each centre (sid, idx), by their order in the session."""
    order = Window.partitionBy("sid").orderBy("idx")
    spread = actions.withColumn("_near", F.collect_list(F.struct("idx", "action")).over(order.rowsBetween(-before, after)))
    return spread.join(centres.select("sid", "idx"), ["sid", "idx"]).select("sid", F.col("idx").alias("centre"), F.inline("_near"))


def summaries(actions: DataFrame, cap: int = 220) -> DataFrame:
    """One bounded line for each action."""
    target = F.regexp_replace(blank(first_filled("command", "path", "pattern", "root")), "\n", " ⏎ ")
    return actions.select("sid", "idx", "turn", "action", F.left(target, F.lit(cap)).alias("target"), F.left(blank("purpose"), F.lit(160)).alias("purpose"))


def hard_hits(actions: DataFrame, criteria: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """(req_id, sid, tier, hits) of criteria (req_id, read_path, invoke_agent) that a session (of a tree) fulfils.

    Reading the path or dispatching the agent is ``direct``; an agent that a command names by a flag is ``derived`` in
    the root session and ``cross_session`` in others, as is a child session of that agent (``agents``: sid, agent_name).
    """
    read = criteria.filter("read_path is not null").select("req_id", "read_path")
    called = criteria.filter("invoke_agent is not null").select("req_id", "invoke_agent")
    # criteria are what callers state, a few for a run; only reads of a path and commands with an agent's flag meet them all
    reads = actions.filter(F.col("action").isin(*READS) & filled("path").isNotNull()).join(small(read), F.contains("path", F.col("read_path")))
    spawned = actions.filter("action = 'spawn_subagent'").join(called, F.col("pattern") == F.col("invoke_agent"))
    flags = r"(?i)(?:--agent|--target|--developer[_-]agent)[=\s]+['\"]?"
    flagged = actions.filter((F.col("action") == "run_command") & F.col("command").rlike(flags))
    flagged = flagged.join(small(called), F.regexp_like("command", F.concat(F.lit(flags + r"\Q"), F.col("invoke_agent"), F.lit(r"\E"))))
    is_root = F.coalesce(F.col("is_root"), F.lit(True)) if "is_root" in actions.columns else F.lit(True)
    direct = F.struct(F.lit(3).alias("o"), F.lit("direct").alias("tier"))
    by_flag = F.when(is_root, F.struct(F.lit(2).alias("o"), F.lit("derived").alias("tier"))).otherwise(F.struct(F.lit(1).alias("o"), F.lit("cross_session").alias("tier")))
    some = reads.select("req_id", "sid", "idx", direct.alias("t")).unionByName(spawned.select("req_id", "sid", "idx", direct.alias("t"))).unionByName(flagged.select("req_id", "sid", "idx", by_flag.alias("t")))
    hits = some.groupBy("req_id", "sid", "idx").agg(F.max("t").alias("t"))
    out = hits.groupBy("req_id", "sid").agg(F.max("t").alias("t"), F.count("*").alias("hits")).select("req_id", "sid", "t.tier", "hits")
    if agents is None:
        return out
    kids = agents.join(called, F.col("agent_name") == F.col("invoke_agent")).select("req_id", "sid", F.lit("cross_session").alias("tier"), F.lit(1).cast("long").alias("hits"))
    return out.unionByName(kids.join(out.select("req_id", "sid"), ["req_id", "sid"], "left_anti"))


def files_in_window(files: DataFrame, patterns: DataFrame, windows: DataFrame) -> DataFrame:
    """(req_id, root, found, strong, tier): files (root, path, modified_at) that a glob (req_id, root, glob) names.

    A file changed within the run's time window is strong evidence (``artifact``), another only ``derived``.
    """
    named = files.join(patterns, "root").filter(F.regexp_like("path", F.concat(F.lit("(?dU)(?:^|/)"), glob_expression("glob"), F.lit("$")))).join(windows, "root", "left")
    strong = F.coalesce(F.col("modified_at").between(F.col("lower"), F.col("upper")), F.lit(False))
    out = named.groupBy("req_id", "root").agg(F.count("*").alias("found"), F.count_if(strong).alias("strong"))
    return out.withColumn("tier", F.when(F.col("strong") > 0, "artifact").otherwise("derived"))


def words_only(text: Column | str) -> Column:
    """A text without all that are not word characters, to compare quotes by."""
    return F.regexp_replace(blank(text), r"(?U)\W+", "")
