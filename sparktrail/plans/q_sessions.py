"""Queries: efficiency, provenance, evidence, goals, statistics, spans and views over the stand-in sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktrail.functions.text import utc_clock
from sparktrail.operators import efficiency, evidence, goal, graph, spans, stats, validators, views
from sparktrail.plans.catalog import query
from sparktrail.sources import cache
from sparktrail.sources.standin import ACTIONS_SQL, actions, with_matcher_fields

A = ACTIONS_SQL


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_matcher_fields(actions(spark, sf_dir)).withColumns({"blocked": F.lit(False), "reasoning": F.lit(None).cast("string"), "call_idx": F.col("idx")})


def _turns(acts: DataFrame) -> DataFrame:
    """Turns as the official record gives them: cost is summed from the actions, time from their timestamps."""
    secs = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    return acts.groupBy("sid", "turn").agg(F.round(F.sum("credits"), 6).alias("credits"), F.count("*").alias("cycles"), F.count_if(F.col("action") == "run_command").alias("llm_reqs"), secs.alias("dur_s"), F.max("k").cast("double").alias("ctx_pct"))


TURNS_SQL = f"""{A}, turns AS (SELECT sid, turn, round(sum(credits), 6) AS credits, count(*) AS cycles, count(*) FILTER (WHERE action = 'run_command') AS llm_reqs,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS dur_s, CAST(max(k) AS DOUBLE) AS ctx_pct FROM actions GROUP BY sid, turn),
  segments AS (SELECT sid, seg, min(turn) AS start, max(turn) AS stop FROM actions GROUP BY sid, seg)"""


def _segments(acts: DataFrame) -> DataFrame:
    return acts.groupBy("sid", "seg").agg(F.min("turn").alias("start"), F.max("turn").alias("stop"))


# ---- efficiency ------------------------------------------------------------------------------------------------


@query(
    "eff_totals",
    f"""{TURNS_SQL}, w AS (SELECT sid, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS wall_s FROM actions GROUP BY sid),
    t AS (SELECT sid, sum(dur_s) AS net_s, round(sum(credits), 4) AS credits, CAST(sum(llm_reqs) AS BIGINT) AS llm_reqs, CAST(sum(cycles) AS BIGINT) AS cycles FROM turns GROUP BY sid)
    SELECT sid, round(wall_s, 3) AS wall_s, round(net_s, 3) AS net_s, credits, llm_reqs, cycles, CASE WHEN wall_s > 0 THEN round((1 - net_s / wall_s) * 100, 1) END AS idle_pct FROM w JOIN t USING (sid)""",
)
def eff_totals(spark, sf_dir):
    acts = _acts(spark, sf_dir)
    sessions = acts.groupBy("sid").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    out = efficiency.totals(_turns(acts), sessions)
    return out.withColumns({"wall_s": F.round("wall_s", 3), "net_s": F.round("net_s", 3), "credits": F.round("credits", 4)})


@query(
    "eff_segment_cost",
    f"""{TURNS_SQL} SELECT s.sid, s.seg, count(*) AS n_turns, round(sum(credits), 4) AS credits, CAST(sum(cycles) AS BIGINT) AS cycles, max(ctx_pct) AS ctx_pct_max,
    round(sum(credits) / count(*), 4) AS credits_per_turn, round(sum(cycles) / count(*), 4) AS cycles_per_turn
    FROM segments s JOIN turns t ON t.sid = s.sid AND t.turn BETWEEN s.start AND s.stop GROUP BY s.sid, s.seg""",
)
def eff_segment_cost(spark, sf_dir):
    acts = _acts(spark, sf_dir)
    out = efficiency.segment_cost(_turns(acts), _segments(acts))
    return out.select("sid", "seg", "n_turns", F.round("credits", 4).alias("credits"), "cycles", "ctx_pct_max", F.round("credits_per_turn", 4).alias("credits_per_turn"), F.round("cycles_per_turn", 4).alias("cycles_per_turn"))


@query(
    "eff_worst_turn",
    f"""{TURNS_SQL} SELECT sid, turn, credits, CASE WHEN total > 0 THEN round(credits / total * 100, 2) END AS share_pct FROM
    (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY credits DESC, turn) AS r, sum(credits) OVER (PARTITION BY sid) AS total FROM turns) WHERE r = 1""",
)
def eff_worst_turn(spark, sf_dir):
    return efficiency.worst_turn(_turns(_acts(spark, sf_dir)))


@query("eff_top_turns", f"{TURNS_SQL} SELECT sid, turn, cycles, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY cycles DESC, turn) AS rank FROM turns) WHERE rank <= 5")
def eff_top_turns(spark, sf_dir):
    return efficiency.top_turns(_turns(_acts(spark, sf_dir)), "cycles").select("sid", "turn", "cycles", "rank")


#: Vectors of the driver's tables stand for commands; groups of ids for segments. Nothing there is very similar.
_ALIKE = {"command_strong": 0.35, "purpose_strong": 0.35, "reasoning_strong": 0.35, "combined_min": 0.3}
_VEC = """WITH v AS (SELECT vec_id AS idx, CAST(label AS INTEGER) AS seg, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (
  SELECT x.seg, x.idx AS idx1, y.idx AS idx2, list_cosine_similarity(x.e, y.e) AS sim FROM v x JOIN v y ON x.seg = y.seg AND x.idx < y.idx)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lit(0).alias("sid"), F.col("label").alias("seg"), F.col("vec_id").alias("idx"), F.lit("command").alias("dim"), F.col("embedding").alias("vector"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _vectors(spark, sf_dir)
    return efficiency.duplicate_pairs(own, own.drop("seg"), bars=_ALIKE)


@query("eff_similar_pairs", f"{_VEC} SELECT seg, idx1, idx2, 'command_strong' AS reason FROM p WHERE sim > 0.35")
def eff_similar_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("seg", "idx1", "idx2", "reason")


_BRANCHES = {"command_strong": 0.3, "purpose_strong": 0.3, "reasoning_strong": 0.3, "combined_min": 0.12}


@query(
    "eff_vote_branches",
    """WITH v AS (SELECT vec_id // 3 AS idx, vec_id % 3 AS dim, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    o AS (SELECT idx, idx % 7 AS seg, max(e) FILTER (WHERE dim = 0) AS c, max(e) FILTER (WHERE dim = 1) AS p, max(e) FILTER (WHERE dim = 2) AS r FROM v GROUP BY idx),
    s AS (SELECT x.seg, x.idx AS idx1, y.idx AS idx2, coalesce(list_cosine_similarity(x.c, y.c), 0) AS c, coalesce(list_cosine_similarity(x.p, y.p), 0) AS p, coalesce(list_cosine_similarity(x.r, y.r), 0) AS r FROM o x JOIN o y ON x.seg = y.seg AND x.idx < y.idx)
    SELECT * FROM (SELECT seg, idx1, idx2, CASE WHEN c > 0.3 THEN 'command_strong' WHEN p > 0.3 THEN 'purpose_strong' WHEN r > 0.3 THEN 'reasoning_strong' WHEN p > 0.12 AND r > 0.12 THEN 'combined_pr' WHEN c > 0.12 AND p > 0.12 THEN 'combined_cp' END AS reason FROM s) WHERE reason IS NOT NULL""",
)
def eff_vote_branches(spark, sf_dir):
    """Three vectors in a row stand for command, purpose and reasoning of one action."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    dim = F.element_at(F.array(*(F.lit(d) for d in ("command", "purpose", "reasoning"))), (F.col("vec_id") % 3 + 1).cast("int"))
    vectors = rows.select(F.lit(0).alias("sid"), F.floor(F.col("vec_id") / 3).alias("idx"), dim.alias("dim"), F.col("embedding").alias("vector"))
    commands = vectors.select("sid", (F.col("idx") % 7).alias("seg"), "idx").distinct()
    return efficiency.duplicate_pairs(commands, vectors, bars=_BRANCHES, chunk=50).select("seg", "idx1", "idx2", "reason")


@query("eff_sibling_anti", f"{_VEC} SELECT seg, idx1, idx2 FROM p WHERE sim > 0.35 AND idx1 // 50 <> idx2 // 50")
def eff_sibling_anti(spark, sf_dir):
    own = _vectors(spark, sf_dir)
    thoughts = own.groupBy("sid", F.floor(F.col("idx") / 50).alias("thought")).agg(F.collect_list("idx").alias("action_idx"))
    return efficiency.duplicate_pairs(own, own.drop("seg"), efficiency.siblings(thoughts), _ALIKE).select("seg", "idx1", "idx2")


@query(
    "eff_clusters",
    _VEC.replace("WITH v", "WITH RECURSIVE v")
    + """, e AS (SELECT seg, idx1 AS a, idx2 AS b FROM p WHERE sim > 0.35 UNION SELECT seg, idx2, idx1 FROM p WHERE sim > 0.35),
    reach AS (SELECT seg, a AS id, a AS r FROM e UNION SELECT reach.seg, reach.id, e.b FROM reach JOIN e ON e.seg = reach.seg AND e.a = reach.r)
    SELECT seg, array_to_string(list_sort(list(DISTINCT id)), ',') AS members, 'command_strong' AS dominant_reason FROM (SELECT seg, id, min(r) AS c FROM reach GROUP BY seg, id) GROUP BY seg, c""",
)
def eff_clusters(spark, sf_dir):
    own = _vectors(spark, sf_dir)
    return efficiency.duplicate_clusters(own, own.drop("seg"), bars=_ALIKE).select("seg", F.array_join("members", ",").alias("members"), "dominant_reason")


@query(
    "eff_wasted_reads",
    f"""{A} SELECT sid, seg, idx, path FROM (SELECT *, list(concat_ws(' ', coalesce(command, ''), coalesce(path, ''), purpose, '')) OVER (PARTITION BY sid ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS said FROM actions)
    WHERE action = 'read_file' AND length(split_part(path, '/', 3)) >= 5 AND len(list_filter(coalesce(said, []), lambda t: contains(t, split_part(path, '/', 3)))) = 0""",
)
def eff_wasted_reads(spark, sf_dir):
    return efficiency.wasted_reads(_acts(spark, sf_dir)).select("sid", "seg", "idx", "path")


_MW = f"""{A}, mw AS (SELECT sid, seg, path, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM actions WHERE action = 'modify_file' GROUP BY sid, seg, path HAVING count(*) >= 2)"""


@query("eff_multi_write", f"{_MW} SELECT sid, seg, path, n, last_turn - first_turn + 1 AS turn_span, round(n / (last_turn - first_turn + 1), 6) AS density, first_turn = last_turn AS is_single_turn FROM mw")
def eff_multi_write(spark, sf_dir):
    return efficiency.multi_writes(_acts(spark, sf_dir)).select("sid", "seg", "path", "n", "turn_span", F.round("density", 6).alias("density"), "is_single_turn")


_FAIL = """fails AS (SELECT sid, seg, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n FROM
  (SELECT *, pos - row_number() OVER (PARTITION BY sid, seg ORDER BY idx) AS run FROM (SELECT *, row_number() OVER (PARTITION BY sid, seg ORDER BY idx) AS pos FROM actions) WHERE error IS NOT NULL)
  GROUP BY sid, seg, run HAVING count(*) >= 3)"""


@query("eff_failure_islands", f"{A}, {_FAIL} SELECT * FROM fails")
def eff_failure_islands(spark, sf_dir):
    return efficiency.failure_groups(_acts(spark, sf_dir))


@query("eff_stuck_turns", f"{TURNS_SQL} SELECT t.sid, s.seg, t.turn, t.cycles FROM turns t JOIN segments s ON t.sid = s.sid AND t.turn BETWEEN s.start AND s.stop WHERE cycles > 12")
def eff_stuck_turns(spark, sf_dir):
    acts = _acts(spark, sf_dir)
    return efficiency.stuck_turns(_turns(acts), _segments(acts), 12).select("sid", "seg", "turn", "cycles")


@query(
    "eff_grade",
    f"""{TURNS_SQL}, {_FAIL}, mw AS (SELECT sid, seg, path, count(*) AS n, min(turn) = max(turn) AS one FROM actions WHERE action = 'modify_file' GROUP BY sid, seg, path HAVING count(*) >= 2),
    x AS (SELECT s.sid, s.seg, (SELECT max(t.credits / tt.total) FROM turns t JOIN (SELECT sid, sum(credits) AS total FROM turns GROUP BY sid) tt USING (sid) WHERE t.sid = s.sid AND t.turn BETWEEN s.start AND s.stop) AS share,
      (SELECT count(*) FROM mw WHERE mw.sid = s.sid AND mw.seg = s.seg AND one AND n >= 3) AS thrash, (SELECT count(*) FROM mw WHERE mw.sid = s.sid AND mw.seg = s.seg AND n >= 5) AS heavy,
      (SELECT count(*) FROM fails f WHERE f.sid = s.sid AND f.seg = s.seg) AS fails, (SELECT count(*) FROM turns t WHERE t.sid = s.sid AND t.turn BETWEEN s.start AND s.stop AND cycles > 12) AS stuck FROM segments s)
    SELECT sid, seg, CASE WHEN share >= 0.25 OR thrash >= 1 OR fails >= 1 OR heavy >= 2 THEN 'D' WHEN share >= 0.15 OR heavy >= 1 OR stuck >= 2 THEN 'C' WHEN share >= 0.10 OR stuck >= 1 THEN 'B' ELSE 'A' END AS grade FROM x""",
)
def eff_grade(spark, sf_dir):
    acts = _acts(spark, sf_dir)
    turns, segments = _turns(acts), _segments(acts)
    none = segments.select("sid", "seg", F.array().cast("array<int>").alias("members")).limit(0)
    return efficiency.grades(segments, turns, none, efficiency.multi_writes(acts), efficiency.stuck_turns(turns, segments, 12), efficiency.failure_groups(acts)).select("sid", "seg", "grade")


def _clusters(acts: DataFrame) -> DataFrame:
    """Commands of a segment that do the same, by the hashed counts of their texts; the stand-in has no thoughts, so no siblings."""
    commands = acts.filter("action = 'run_command'")
    said = cache.texts(commands).filter(F.col("dim").isin("command", "purpose", "reasoning"))
    return efficiency.duplicate_text_clusters(commands, said, cache.encoded(said.select("dim", "sha1", "text").dropDuplicates(["dim", "sha1"])))


@query("eff_grade_clusters")
def eff_grade_clusters(spark, sf_dir):
    """Grades with all their inputs, commands compared by their texts."""
    acts = _acts(spark, sf_dir)
    turns, segments = _turns(acts), _segments(acts)
    return efficiency.grades(segments, turns, _clusters(acts), efficiency.multi_writes(acts), efficiency.stuck_turns(turns, segments, 12), efficiency.failure_groups(acts)).select("sid", "seg", "clusters", "grade")


@query(
    "eff_grade_alike",
    f"""{TURNS_SQL}, {_FAIL}, mw AS (SELECT sid, seg, path, count(*) AS n, min(turn) = max(turn) AS one FROM actions WHERE action = 'modify_file' GROUP BY sid, seg, path HAVING count(*) >= 2),
    same AS (SELECT sid, seg, count(*) AS clusters FROM (SELECT sid, seg, k % 7 FROM actions WHERE action = 'run_command' GROUP BY sid, seg, k % 7 HAVING count(*) >= 3) GROUP BY sid, seg),
    x AS (SELECT s.sid, s.seg, (SELECT max(t.credits / tt.total) FROM turns t JOIN (SELECT sid, sum(credits) AS total FROM turns GROUP BY sid) tt USING (sid) WHERE t.sid = s.sid AND t.turn BETWEEN s.start AND s.stop) AS share,
      (SELECT count(*) FROM mw WHERE mw.sid = s.sid AND mw.seg = s.seg AND one AND n >= 3) AS thrash, (SELECT count(*) FROM mw WHERE mw.sid = s.sid AND mw.seg = s.seg AND n >= 5) AS heavy,
      (SELECT count(*) FROM fails f WHERE f.sid = s.sid AND f.seg = s.seg) AS fails, (SELECT count(*) FROM turns t WHERE t.sid = s.sid AND t.turn BETWEEN s.start AND s.stop AND cycles > 12) AS stuck,
      coalesce((SELECT clusters FROM same WHERE same.sid = s.sid AND same.seg = s.seg), 0) AS clusters FROM segments s)
    SELECT sid, seg, clusters, CASE WHEN share >= 0.25 OR thrash >= 1 OR fails >= 1 OR heavy >= 2 THEN 'D' WHEN share >= 0.15 OR clusters >= 2 OR heavy >= 1 OR stuck >= 2 THEN 'C' WHEN share >= 0.10 OR clusters >= 1 OR stuck >= 1 THEN 'B' ELSE 'A' END AS grade FROM x""",
)
def eff_grade_alike(spark, sf_dir):
    """Grades with all their inputs; commands are alike where their numbers are equal modulo seven."""
    acts = _acts(spark, sf_dir)
    turns, segments, commands = _turns(acts), _segments(acts), acts.filter("action = 'run_command'")
    vector = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: (i == F.col("k") % 7).cast("double"))
    clusters = efficiency.duplicate_clusters(commands, commands.select("sid", "idx", F.lit("command").alias("dim"), vector.alias("vector")))
    return efficiency.grades(segments, turns, clusters, efficiency.multi_writes(acts), efficiency.stuck_turns(turns, segments, 12), efficiency.failure_groups(acts)).select("sid", "seg", "clusters", "grade")


@query("eff_report")
def eff_report(spark, sf_dir):
    acts = _acts(spark, sf_dir)
    turns, segments = _turns(acts), _segments(acts)
    clusters, rewrites, failures = _clusters(acts), efficiency.multi_writes(acts), efficiency.failure_groups(acts)
    graded = efficiency.grades(segments, turns, clusters, rewrites, efficiency.stuck_turns(turns, segments), failures)
    return efficiency.report(turns, segments, graded, rewrites, failures, clusters)


# ---- provenance ------------------------------------------------------------------------------------------------

_G = f"""{A}, t AS (SELECT sid, idx, turn, action, path, action = 'modify_file' AS w,
    coalesce(sum((action = 'modify_file')::INT) OVER (PARTITION BY sid, path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM actions WHERE path IS NOT NULL AND error IS NULL),
  ents AS (SELECT sid, path AS key, before + 1 AS version, idx AS producer_idx, idx AS born_idx FROM t WHERE w UNION ALL SELECT DISTINCT sid, path, 0::BIGINT, NULL::INT, -1 FROM t),
  edges AS (SELECT sid, idx, path AS key, before + 1 AS version, 'generatedBy' AS kind FROM t WHERE w UNION ALL SELECT sid, idx, path, before, 'usedBy' FROM t)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    acts = _acts(spark, sf_dir)
    touched = graph.touches(acts)
    return acts, touched, graph.entities(touched), graph.edges(touched)


@query("graph_versions", f"{_G} SELECT * FROM ents")
def graph_versions(spark, sf_dir):
    return _graph(spark, sf_dir)[2]


@query("graph_used_by_asof", f"{_G} SELECT sid, idx, key, version FROM edges WHERE kind = 'usedBy'")
def graph_used_by_asof(spark, sf_dir):
    return _graph(spark, sf_dir)[3].filter("kind = 'usedBy'").select("sid", "idx", "key", "version")


@query("graph_isolated", f"{_G} SELECT a.sid, a.idx, a.action FROM actions a WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.sid = a.sid AND e.idx = a.idx)")
def graph_isolated(spark, sf_dir):
    acts, _, _, edges = _graph(spark, sf_dir)
    return graph.isolated(acts, edges).select("sid", "idx", "action")


@query(
    "graph_stats",
    f"""{_G}, a AS (SELECT sid, count(*) AS activities FROM actions GROUP BY sid), n AS (SELECT sid, count(*) AS entities FROM ents GROUP BY sid),
    e AS (SELECT sid, count(*) FILTER (WHERE kind = 'generatedBy') AS generated_by, count(*) FILTER (WHERE kind = 'usedBy') AS used_by, count(DISTINCT idx) AS l FROM edges GROUP BY sid)
    SELECT a.sid, activities, coalesce(entities, 0) AS entities, coalesce(generated_by, 0) AS generated_by, coalesce(used_by, 0) AS used_by, activities - coalesce(l, 0) AS isolated,
    round(100 * (activities - coalesce(l, 0)) / activities, 1) AS isolated_pct FROM a LEFT JOIN n USING (sid) LEFT JOIN e USING (sid)""",
)
def graph_stats(spark, sf_dir):
    acts, _, ents, edges = _graph(spark, sf_dir)
    return graph.stats(acts, ents, edges)


_FATE = f"""{_G}, f AS (SELECT n.sid, n.key, n.version, n.producer_idx, max(n.version) OVER (PARTITION BY n.sid, n.key) AS newest, coalesce(r.readers, 0) AS readers
  FROM ents n LEFT JOIN (SELECT sid, key, version, count(DISTINCT idx) AS readers FROM edges WHERE kind = 'usedBy' GROUP BY ALL) r ON r.sid = n.sid AND r.key = n.key AND r.version = n.version),
  fates AS (SELECT *, CASE WHEN version = 0 AND producer_idx IS NULL THEN 'input' WHEN version < newest THEN 'superseded' WHEN readers > 0 THEN 'consumed' ELSE 'unconsumed' END AS fate FROM f)"""


@query("graph_fates", f"{_FATE} SELECT sid, key, version, readers, fate, fate = 'superseded' AND readers = 0 AS never_read FROM fates")
def graph_fates(spark, sf_dir):
    _, _, ents, edges = _graph(spark, sf_dir)
    return graph.fates(ents, edges).select("sid", "key", "version", "readers", "fate", "never_read")


@query("graph_fate_summary", f"{_FATE} SELECT sid, fate, count(*) AS n FROM fates GROUP BY sid, fate")
def graph_fate_summary(spark, sf_dir):
    _, _, ents, edges = _graph(spark, sf_dir)
    return graph.fates(ents, edges).groupBy("sid", "fate").agg(F.count("*").alias("n"))


@query("graph_highest_versions", f"{_G} SELECT sid, key, max(version) AS version FROM ents GROUP BY sid, key")
def graph_highest_versions(spark, sf_dir):
    return graph.highest_versions(_graph(spark, sf_dir)[2])


@query(
    "graph_overview_shared",
    f"""{_G} SELECT e.sid, e.key, e.version, min(CASE WHEN kind = 'generatedBy' THEN turn END) AS made_in, array_to_string(list_sort(list(DISTINCT turn) FILTER (WHERE kind = 'usedBy')), ',') AS read_in, count(DISTINCT turn) AS turns
    FROM edges e JOIN actions a ON a.sid = e.sid AND a.idx = e.idx GROUP BY ALL HAVING count(DISTINCT turn) >= 2""".replace("GROUP BY ALL", "GROUP BY e.sid, e.key, e.version"),
)
def graph_overview_shared(spark, sf_dir):
    acts, _, _, edges = _graph(spark, sf_dir)
    return graph.shared_across_turns(acts, edges).withColumn("read_in", F.array_join("read_in", ","))


@query(
    "graph_turn_summary",
    f"""{A} SELECT sid, turn, count(*) AS actions, min(idx) AS first_idx, max(idx) AS last_idx, array_to_string(list_slice(list(purpose ORDER BY idx), 1, 3), ',') AS purposes FROM actions GROUP BY sid, turn""",
)
def graph_turn_summary(spark, sf_dir):
    out = graph.turn_summaries(_acts(spark, sf_dir))
    return out.select("sid", "turn", "actions", "first_idx", "last_idx", F.array_join("purposes", ",").alias("purposes"))


@query(
    "graph_trail",
    f"""{_G}, r AS (SELECT sid, path AS key, before + 1 AS version, false AS is_read, turn, idx FROM t WHERE w UNION ALL SELECT sid, path, before, true, turn, idx FROM t)
    SELECT sid, key, CAST(row_number() OVER (PARTITION BY sid, key ORDER BY version, is_read, turn, idx) AS INTEGER) AS step, version, is_read, turn, idx FROM r""",
)
def graph_trail(spark, sf_dir):
    return graph.trails(_graph(spark, sf_dir)[1]).select("sid", "key", "step", "version", "is_read", "turn", "idx")


@query(
    "graph_version_chain",
    f"""{_G} SELECT sid, key, string_agg('v' || version || CASE WHEN producer_idx IS NULL THEN ' (before)' ELSE ' #' || producer_idx END, chr(10) ORDER BY version) AS chain FROM ents GROUP BY sid, key""",
)
def graph_version_chain(spark, sf_dir):
    return graph.version_chains(_graph(spark, sf_dir)[2])


@query("graph_violations", "SELECT CAST(NULL AS BIGINT) AS sid, CAST(NULL AS INTEGER) AS idx, '' AS key, CAST(0 AS BIGINT) AS version, '' AS why WHERE false")
def graph_violations(spark, sf_dir):
    _, _, ents, edges = _graph(spark, sf_dir)
    return graph.violations(ents, edges)


@query(
    "graph_violations_planted",
    f"""{_G}, e2 AS (SELECT sid, CASE WHEN kind = 'generatedBy' AND idx % 7 = 0 THEN idx + 1 WHEN kind = 'usedBy' AND idx % 5 = 0 THEN 0 ELSE idx END AS idx, key, CASE WHEN kind = 'usedBy' AND idx % 11 = 0 THEN version + 1000 ELSE version END AS version, kind FROM edges)
    SELECT * FROM (SELECT e2.sid, e2.idx, e2.key, e2.version, CASE WHEN n.born_idx IS NULL THEN 'no entity' WHEN kind = 'usedBy' AND born_idx >= e2.idx THEN 'used before it was made' WHEN kind = 'generatedBy' AND producer_idx IS DISTINCT FROM e2.idx THEN 'made by another' END AS why
      FROM e2 LEFT JOIN ents n ON n.sid = e2.sid AND n.key = e2.key AND n.version = e2.version) WHERE why IS NOT NULL
    UNION ALL SELECT sid, idx, key, version, 'made and used' FROM e2 GROUP BY sid, idx, key, version HAVING count(DISTINCT kind) > 1""",
)
def graph_violations_planted(spark, sf_dir):
    """Edges of which some are moved to another action, to the first one, or to a version that does not exist."""
    _, _, ents, edges = _graph(spark, sf_dir)
    at, made = F.col("idx"), F.col("kind") == "generatedBy"
    moved = F.when(made & (at % 7 == 0), at + 1).when(~made & (at % 5 == 0), F.lit(0)).otherwise(at)
    bad = edges.withColumns({"version": F.when(~made & (at % 11 == 0), F.col("version") + 1000).otherwise(F.col("version")), "idx": moved})
    return graph.violations(ents, bad)


@query("graph_confidence", f"{_G} SELECT sid, kind, CASE WHEN idx % 3 = 0 THEN 'likely' ELSE 'certain' END AS confidence, count(*) AS n FROM edges GROUP BY ALL")
def graph_confidence(spark, sf_dir):
    edges = _graph(spark, sf_dir)[3].withColumn("confidence", F.when(F.col("idx") % 3 == 0, "likely").otherwise("certain"))
    return graph.confidence_counts(edges)


@query("graph_at_least", f"{_G} SELECT sid, idx, key, version, kind FROM edges WHERE idx % 3 > 0")
def graph_at_least(spark, sf_dir):
    edges = _graph(spark, sf_dir)[3].withColumn("confidence", F.when(F.col("idx") % 3 == 0, "likely").otherwise("certain"))
    return edges.filter(graph.at_least("certain")).select("sid", "idx", "key", "version", "kind")


@query("graph_in_turns", f"{_G} SELECT a.sid, a.idx, count(e.kind) AS n FROM actions a JOIN edges e ON e.sid = a.sid AND e.idx = a.idx WHERE a.turn BETWEEN 2 AND 3 GROUP BY a.sid, a.idx")
def graph_in_turns(spark, sf_dir):
    acts, _, _, edges = _graph(spark, sf_dir)
    chosen, touching = graph.in_turns(acts, edges, 2, 3)
    return chosen.select("sid", "idx").join(touching.groupBy("sid", "idx").agg(F.count("*").alias("n")), ["sid", "idx"])


@query(
    "graph_command_edges",
    f"""{A}, c AS (SELECT sid, idx, '/w/in' || k % 5 || '.txt' AS r, '/w/out' || k % 3 || '.txt' AS w FROM actions WHERE command IS NOT NULL),
    m AS (SELECT sid, idx, w AS key, row_number() OVER (PARTITION BY sid, w ORDER BY idx) AS version FROM c)
    SELECT sid, idx, key, version, 'generatedBy' AS kind FROM m UNION ALL SELECT DISTINCT sid, idx, r, CAST(0 AS BIGINT), 'usedBy' FROM c""",
)
def graph_command_edges(spark, sf_dir):
    """Edges of commands that copy files: what they read was there before, what they write gets versions."""
    acts = _acts(spark, sf_dir)
    copies = acts.withColumn("command", F.when(F.col("command").isNotNull(), F.concat(F.lit("D=/w; cat $D/in"), F.col("k") % 5, F.lit(".txt > ${D}/out"), F.col("k") % 3, F.lit(".txt"))))
    edges = graph.with_commands(graph.touches(acts.filter("false")), graph.command_touches(copies))[1]
    return edges.select("sid", "idx", "key", "version", "kind")


def _with_output(acts: DataFrame) -> DataFrame:
    """Commands that write a log named by the time, and an output that tells its name, or two names for every fifth."""
    log = F.concat(F.lit("/w/log/run_"), F.col("k"), F.lit(".log"))
    two = F.when(F.col("idx") % 5 == 0, F.concat(F.lit("\n"), F.lit("/w/log/run_x.log"))).otherwise("")
    is_command = F.col("command").isNotNull()
    said = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("LOG="), log, two, F.lit("\n  at /w/src.py line 1")).alias("stdout")).alias("Json"))).alias("items")).alias("Success")))
    return acts.withColumns({"command": F.when(is_command, F.lit("python3 a.py > /w/log/run_$(date +%s).log")), "response": F.when(is_command, said)})


@query(
    "graph_command_paths",
    f"""{A} SELECT sid, idx, '/w/log/run_' || k || '.log' AS path, true AS is_write FROM actions WHERE command IS NOT NULL AND idx % 5 > 0""",
)
def graph_command_paths(spark, sf_dir):
    """Files that a command leaves open, by what its output tells; two candidates tell nothing."""
    return graph.resolved_touches(_with_output(_acts(spark, sf_dir)))


@query("graph_unresolved", f"{A} SELECT sid, idx, '/w/log/run_$(date +%s).log' AS word FROM actions WHERE command IS NOT NULL AND idx % 5 = 0")
def graph_unresolved(spark, sf_dir):
    return graph.unresolved_words(_with_output(_acts(spark, sf_dir)))


def _errands(acts: DataFrame) -> DataFrame:
    """Commands of six kinds: scopes of directories, a job in the background with its output, a signal, another machine,
    a script by a variable that nothing sets, and a program that Python is fed."""
    k = lambda n: (F.col("k") % n).cast("string")
    text = F.element_at(
        F.array(
            F.concat(F.lit("(cd sub && cat a"), k(5), F.lit(".txt); cat b.txt > /w/o"), k(3), F.lit(".log")),
            F.lit("nohup python3 /w/run.py > /w/r_$(date +%s).log 2>&1 & echo PID=$!"),
            F.concat(F.lit("kill "), (F.col("k") % 50 + 1000).cast("string"), F.lit(" && tail -5 /w/o"), k(3), F.lit(".log")),
            F.concat(F.lit("ssh me@box"), k(4), F.lit(" 'cat /w/b.txt'")),
            F.concat(F.lit("bash ${TOOLS}/t"), k(3), F.lit(".sh")),
            F.concat(F.lit("python3 - <<'EOF'\nwith open('in%d.csv' % 7) as f: pass\nopen('in"), k(4), F.lit(".csv')\nEOF\n")),
        ),
        (F.col("idx") % 6 + 1).cast("int"),
    )
    said = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("PID="), (F.col("k") + 1000).cast("string"), F.lit("\nLOG=/w/r_"), F.col("k"), F.lit(".log")).alias("stdout")).alias("Json"))).alias("items")).alias("Success")))
    is_command = F.col("command").isNotNull()
    return acts.withColumns({"command": F.when(is_command, text), "response": F.when(is_command & (F.col("idx") % 6 == 1), said), "root": F.when(is_command, "/w")})


_ERRANDS = f"""{_G}, c AS (SELECT sid, idx, k, idx % 6 AS m FROM actions WHERE command IS NOT NULL),
  w AS (SELECT sid, idx, '/w/o' || k % 3 || '.log' AS key FROM c WHERE m = 0 UNION ALL SELECT sid, idx, '/w/r_' || k || '.log' FROM c WHERE m = 1),
  r AS (SELECT sid, idx, '/w/sub/a' || k % 5 || '.txt' AS key, 'likely' AS confidence FROM c WHERE m = 0 UNION ALL SELECT sid, idx, '/w/b.txt', 'likely' FROM c WHERE m = 0 UNION ALL SELECT sid, idx, '/w/run.py', 'likely' FROM c WHERE m = 1
    UNION ALL SELECT sid, idx, '/w/o' || k % 3 || '.log', 'likely' FROM c WHERE m = 2 UNION ALL SELECT sid, idx, '$TOOLS/t' || k % 3 || '.sh', 'weak' FROM c WHERE m = 4 UNION ALL SELECT sid, idx, '/w/in' || k % 4 || '.csv', 'likely' FROM c WHERE m = 5),
  stated AS (SELECT sid, idx, CAST(1000 + k AS VARCHAR) AS key FROM c WHERE m = 1), born AS (SELECT sid, key, min(idx) AS born FROM stated GROUP BY sid, key),
  named AS (SELECT c.sid, c.idx, b.key FROM c JOIN born b ON b.sid = c.sid AND b.key = CAST(1000 + c.k % 50 AS VARCHAR) AND b.born < c.idx WHERE m = 2),
  every AS (SELECT sid, idx, key, version, kind, 'certain' AS confidence FROM edges
    UNION ALL SELECT sid, idx, key, row_number() OVER (PARTITION BY sid, key ORDER BY idx), 'generatedBy', 'likely' FROM w
    UNION ALL SELECT r.sid, r.idx, r.key, count(w.idx), 'usedBy', r.confidence FROM r LEFT JOIN w ON w.sid = r.sid AND w.key = r.key AND w.idx < r.idx GROUP BY r.sid, r.idx, r.key, r.confidence
    UNION ALL SELECT sid, idx, '/w/in7.csv', 0, 'usedBy', 'likely' FROM c WHERE m = 5
    UNION ALL SELECT sid, idx, key, 1, 'generatedBy', 'likely' FROM stated UNION ALL SELECT sid, idx, key, 1, 'usedBy', 'likely' FROM named
    UNION ALL SELECT sid, idx, 'ssh://me@box' || k % 4, 0, 'connectedBy', 'likely' FROM c WHERE m = 3)"""


@query("graph_all_edges", f"{_ERRANDS} SELECT sid, idx, key, CAST(version AS BIGINT) AS version, kind, confidence FROM every")
def graph_all_edges(spark, sf_dir):
    """Files by tools, commands, outputs and unset variables, hosts and processes in one graph."""
    return graph.provenance(_errands(_acts(spark, sf_dir)))[1]


@query(
    "graph_pids",
    f"""{_ERRANDS} SELECT b.sid, b.key, CAST(b.born AS INTEGER) AS producer_idx, count(DISTINCT s.idx) AS stated, count(DISTINCT n.idx) AS named FROM born b JOIN stated s ON s.sid = b.sid AND s.key = b.key LEFT JOIN named n ON n.sid = b.sid AND n.key = b.key GROUP BY b.sid, b.key, b.born""",
)
def graph_pids(spark, sf_dir):
    """Processes, how many outputs state each and how many later commands name it."""
    ents, edges = graph.provenance(_errands(_acts(spark, sf_dir)))
    uses = edges.groupBy("sid", "key").agg(F.count_if(F.col("kind") == "generatedBy").alias("stated"), F.count_if(F.col("kind") == "usedBy").alias("named"))
    return ents.filter("entity = 'pid'").join(uses, ["sid", "key"]).select("sid", "key", "producer_idx", "stated", "named")


@query("graph_hosts", f"{_ERRANDS} SELECT sid, 'ssh://me@box' || k % 4 AS key, count(*) AS n FROM c WHERE m = 3 GROUP BY sid, k % 4")
def graph_hosts(spark, sf_dir):
    """Machines that commands reach, and how often."""
    ents, edges = graph.provenance(_errands(_acts(spark, sf_dir)))
    uses = edges.filter("kind = 'connectedBy'").groupBy("sid", "key").agg(F.count("*").alias("n"))
    return ents.filter("entity = 'host'").join(uses, ["sid", "key"]).select("sid", "key", "n")


@query(
    "graph_weak_paths",
    f"""{_ERRANDS} SELECT c.sid, c.idx, '$TOOLS/t' || k % 3 || '.sh' AS path FROM c WHERE m = 4 AND NOT EXISTS (SELECT 1 FROM c x WHERE x.sid = c.sid AND x.m = 1 AND x.k = 7)""",
)
def graph_weak_paths(spark, sf_dir):
    """Scripts by a variable, in the sessions in which no command sets it, before or after."""
    acts = _errands(_acts(spark, sf_dir))
    sets = acts.withColumn("command", F.when((F.col("idx") % 6 == 1) & (F.col("k") == 7), F.concat(F.lit("TOOLS=$(pwd); "), "command")).otherwise(F.col("command")))
    return graph.weak_touches(sets).filter("not is_write").select("sid", "idx", "path")


_FORMS_SQL = f"""{A}, c AS (SELECT sid, idx, k, idx % 5 AS m FROM actions WHERE command IS NOT NULL)
    SELECT sid, idx, '/w/run' || k || '.py' AS path, false AS is_write FROM c WHERE m = 0 UNION ALL SELECT sid, idx, '/w/d' || k % 9 || '.md', true FROM c WHERE m = 1 UNION ALL SELECT sid, idx, '/w/e.md', false FROM c WHERE m = 1
    UNION ALL SELECT sid, idx, '/w/s' || n || '_' || k % 9 || '.txt', false FROM c, (SELECT unnest([1, 2, 3]) AS n) WHERE m = 2 UNION ALL SELECT sid, idx, '/w/all.log', true FROM c WHERE m = 2
    UNION ALL SELECT sid, idx, '/w/b' || k % 9 || '.c', false FROM c WHERE m = 3 UNION ALL SELECT sid, idx, '/w/b.out', true FROM c WHERE m = 3 UNION ALL SELECT sid, idx, '/w/go.sh', true FROM c WHERE m = 4"""


@query("graph_command_forms", _FORMS_SQL)
def graph_command_forms(spark, sf_dir):
    """What commands touch that are wrapped, verbs of version control, loops, compilers, or change modes and delete."""
    k = F.col("k") % 9
    text = F.element_at(
        F.array(
            F.concat(F.lit("sudo nohup env A=b timeout 1.5s python3 -u run"), "k", F.lit(".py --fast &")),
            F.concat(F.lit("git add d"), k, F.lit(".md && git diff --stat e.md; git push origin f.md")),
            F.concat(F.lit("for n in 1 2 3; do cat s${n}_"), k, F.lit(".txt >> all.log; done")),
            F.concat(F.lit("gcc -O2 -o b.out b"), k, F.lit(".c && ls x.txt")),
            F.lit("chmod +x go.sh; rm -f old.txt; mkdir -p y.txt"),
        ),
        (F.col("idx") % 5 + 1).cast("int"),
    )
    acts = _acts(spark, sf_dir).withColumns({"command": F.when(F.col("command").isNotNull(), text), "root": F.lit("/w")})
    return graph.command_touches(acts)


@query(
    "graph_variables",
    f"""{A}, c AS (SELECT sid, idx, k, k % 11 = 0 AS forgets, k % 4 = 1 AS sets FROM actions WHERE command IS NOT NULL), v AS (SELECT *, CASE WHEN sets AND NOT forgets THEN '/w/v' || k % 3 || '.log' END AS value,
      max(CASE WHEN sets OR forgets THEN idx END) OVER (PARTITION BY sid ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM c)
    SELECT v.sid, v.idx, p.value AS path FROM v JOIN v p ON p.sid = v.sid AND p.idx = v.at WHERE NOT v.sets AND NOT v.forgets AND p.value IS NOT NULL""",
)
def graph_variables(spark, sf_dir):
    """Commands that read a file by a variable which an earlier command of the session set, or set to what no text tells."""
    text = F.when(F.col("k") % 11 == 0, "OUT=$(mktemp)").when(F.col("k") % 4 == 1, F.concat(F.lit("export OUT=/w/v"), F.col("k") % 3, F.lit(".log"))).otherwise("tail -5 \"$OUT\"")
    acts = _acts(spark, sf_dir).withColumn("command", F.when(F.col("command").isNotNull(), text))
    return graph.command_touches(acts).filter("not is_write").select("sid", "idx", "path")


_SEARCHES = f"""{A}, t AS (SELECT sid, idx, idx % 4 = 3 AND action = 'read_file' AS looks, '/w/d' || k % 4 AS at, '/w/d' || k % 4 || '/f' || k || '.py' AS path, action FROM actions WHERE path IS NOT NULL)"""


@query("graph_probed", f"{_SEARCHES}, keys AS (SELECT DISTINCT t.sid, t.path FROM t JOIN actions a USING (sid, idx) WHERE NOT looks AND a.error IS NULL) SELECT t.sid, t.idx, keys.path AS key FROM t JOIN keys ON keys.sid = t.sid AND starts_with(keys.path, t.at || '/') WHERE looks")
def graph_probed(spark, sf_dir):
    """Every fourth action that is a read searches a folder instead; the artifacts of its session below that folder."""
    folder = F.concat(F.lit("/w/d"), F.col("k") % 4)
    looks = (F.col("idx") % 4 == 3) & (F.col("action") == "read_file")
    acts = _acts(spark, sf_dir).filter("path is not null").withColumn("action", F.when(looks, "search_content").otherwise(F.col("action")))
    acts = acts.withColumn("path", F.when(F.col("action") == "search_content", folder).otherwise(F.concat(folder, F.lit("/f"), "k", F.lit(".py"))))
    return graph.probed_artifacts(graph.probes(acts), graph.entities(graph.touches(acts)))


@query(
    "graph_unlinked_mentions",
    f"""{_G} SELECT DISTINCT a.sid, a.idx, n.key FROM actions a JOIN (SELECT DISTINCT sid, key FROM ents) n USING (sid) WHERE a.command IS NOT NULL
    AND (contains(replace(a.command, 'run_', '/w/f'), n.key)) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.sid = a.sid AND e.idx = a.idx AND e.key = n.key)""",
)
def graph_unlinked_mentions(spark, sf_dir):
    acts, _, ents, edges = _graph(spark, sf_dir)
    return graph.unlinked_mentions(acts.withColumn("command", F.replace("command", F.lit("run_"), F.lit("/w/f"))), ents, edges)


# ---- evidence and goals ----------------------------------------------------------------------------------------


@query(
    "ev_overview",
    f"""{A} SELECT sid, max(turn) AS turns, count(*) AS actions, count(*) FILTER (WHERE action = 'modify_file') AS writes, CASE WHEN bool_or(action = 'modify_file') THEN '/w' ELSE '' END AS written_dirs,
    count(*) FILTER (WHERE NOT completed) AS orphans FROM actions GROUP BY sid""",
)
def ev_overview(spark, sf_dir):
    return evidence.overview(_acts(spark, sf_dir)).select("sid", "turns", "actions", "writes", F.array_join("written_dirs", ",").alias("written_dirs"), "orphans")


@query("ev_turn_ranges", f"{A} SELECT sid, turn, count(*) AS actions, min(idx) AS first_idx, max(idx) AS last_idx FROM actions GROUP BY sid, turn")
def ev_turn_ranges(spark, sf_dir):
    return evidence.turn_ranges(_acts(spark, sf_dir))


_TREE_SQL = """WITH RECURSIVE s AS (SELECT DISTINCT user_id AS sid FROM events), l AS (SELECT sid, sid // 3 AS parent FROM s WHERE sid // 3 > 0 AND sid // 3 <> sid),
    t AS (SELECT sid AS root, sid, 0 AS depth FROM s UNION ALL SELECT t.root, l.sid, t.depth + 1 FROM t JOIN l ON l.parent = t.sid WHERE t.depth < 3)
    SELECT root, sid, min(depth) AS depth FROM t GROUP BY root, sid"""


@query("ev_run_tree", _TREE_SQL)
def ev_run_tree(spark, sf_dir):
    """Every session as a root."""
    sid = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("sid")).distinct()
    parent = F.floor(F.col("sid") / 3).cast("long")
    return evidence.run_tree(sid.withColumn("parent", F.when((parent > 0) & (parent != F.col("sid")), parent)), sid)


@query(
    "ev_tree_actions",
    f"""WITH RECURSIVE {A.strip().removeprefix("WITH")}, s AS (SELECT DISTINCT sid FROM actions), l AS (SELECT sid, sid // 3 AS parent FROM s WHERE sid // 3 > 0 AND sid // 3 <> sid),
    t AS (SELECT sid AS root, sid, 0 AS depth, [sid] AS way FROM s UNION ALL SELECT t.root, l.sid, t.depth + 1, list_append(t.way, l.sid) FROM t JOIN l ON l.parent = t.sid WHERE t.depth < 3)
    SELECT t.root, CAST(row_number() OVER (PARTITION BY t.root ORDER BY t.depth, t.way, a.idx) - 1 AS INTEGER) AS place, t.depth, a.sid, a.idx, a.action FROM t JOIN actions a ON a.sid = t.sid""",
)
def ev_tree_actions(spark, sf_dir):
    """The actions of every session's tree in one order, level by level."""
    acts = actions(spark, sf_dir).select("sid", "idx", "action")
    sid = acts.select("sid").distinct()
    parent = F.floor(F.col("sid") / 3).cast("long")
    sessions = sid.withColumn("parent", F.when((parent > 0) & (parent != F.col("sid")), parent))
    return evidence.tree_actions(acts, sessions, sid)


#: Texts stand for actions, the words of six letters and more of a benchmark item for the anchors of a requirement.
_ANCHORS_SQL = """a AS (SELECT item_id AS req_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) AS anchor FROM benchmark),
  pool AS (SELECT doc_id AS doc, doc_id AS idx, lower(text) AS text FROM documents)"""


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("req_id"), F.explode(words).alias("anchor"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("idx"), F.lower("text").alias("text"))


@query("ev_anchor_df", f"WITH {_ANCHORS_SQL} SELECT req_id, anchor, count(doc) AS df FROM a LEFT JOIN pool ON contains(pool.text, a.anchor) GROUP BY req_id, anchor")
def ev_anchor_df(spark, sf_dir):
    return evidence.anchor_frequencies(_pool(spark, sf_dir), _anchors(spark, sf_dir))


def _retrieve_sql(weight: str) -> str:
    return f"""WITH {_ANCHORS_SQL}, m AS (SELECT req_id, anchor, doc, idx FROM a JOIN pool ON contains(pool.text, a.anchor)), n AS (SELECT greatest(count(*), 1) AS n FROM pool),
    w AS (SELECT req_id, anchor, {weight} AS w FROM m, n GROUP BY req_id, anchor, n.n), s AS (SELECT m.req_id, doc, idx, sum(w) AS score, count(*) AS hits FROM m JOIN w USING (req_id, anchor) GROUP BY m.req_id, doc, idx)
    SELECT req_id, CAST(rank AS INTEGER) AS rank, doc, round(score, 3) AS score, hits FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY round(score, 9) DESC, hits DESC, idx, doc) AS rank FROM s) WHERE rank <= 8"""


@query("ev_retrieve_count", _retrieve_sql("1.0::DOUBLE"))
def ev_retrieve_count(spark, sf_dir):
    return evidence.retrieve(_pool(spark, sf_dir), _anchors(spark, sf_dir), mode="count")


@query("ev_retrieve_idf_topk", _retrieve_sql("ln(1 + n.n / (1 + count(DISTINCT doc)))"))
def ev_retrieve_idf_topk(spark, sf_dir):
    return evidence.retrieve(_pool(spark, sf_dir), _anchors(spark, sf_dir))


_AROUND_SQL = f"{A} SELECT c.sid, c.idx AS centre, a.idx, a.action FROM actions c JOIN actions a ON a.sid = c.sid AND a.idx BETWEEN c.idx - 2 AND c.idx + 2 WHERE c.error IS NOT NULL"


@query("ev_window_pm2", _AROUND_SQL)
def ev_window_pm2(spark, sf_dir):
    """Every error as a centre."""
    acts = _acts(spark, sf_dir)
    return evidence.around(acts, acts.filter("error is not null"), 2, 2)


@query(
    "ev_hard_check_tier",
    f"""{A}, c AS (SELECT * FROM (VALUES (1, '/w/f1', NULL), (2, '/w/f77.py', NULL), (3, NULL, 'run_5')) AS t(req_id, read_path, invoke_agent))
    SELECT req_id, sid, 'direct' AS tier, count(*) AS hits FROM actions JOIN c ON action = 'read_file' AND contains(path, read_path) GROUP BY req_id, sid
    UNION ALL SELECT req_id, sid, CASE WHEN sid < 50 THEN 'derived' ELSE 'cross_session' END, count(*) FROM actions JOIN c ON action = 'run_command' AND contains(command, 'run_5') WHERE req_id = 3 GROUP BY req_id, sid""",
)
def ev_hard_check_tier(spark, sf_dir):
    acts = _acts(spark, sf_dir).withColumn("is_root", F.col("sid") < 50).withColumn("command", F.replace("command", F.lit("python3 "), F.lit("run --target ")))
    criteria = spark.createDataFrame([(1, "/w/f1", None), (2, "/w/f77.py", None), (3, None, "run_5")], "req_id int, read_path string, invoke_agent string")
    return evidence.hard_hits(acts, criteria)


@query(
    "ev_files_in_window",
    f"""{A}, f AS (SELECT sid AS root, path, max(ts) AS modified_at FROM actions WHERE action = 'modify_file' GROUP BY sid, path), w AS (SELECT sid AS root, min(ts) AS lower, min(ts) + INTERVAL 90 DAY AS upper FROM actions GROUP BY sid)
    SELECT 1 AS req_id, root, count(*) AS found, count(*) FILTER (WHERE modified_at BETWEEN lower AND upper) AS strong, CASE WHEN count(*) FILTER (WHERE modified_at BETWEEN lower AND upper) > 0 THEN 'artifact' ELSE 'derived' END AS tier
    FROM f JOIN w USING (root) WHERE regexp_matches(path, '(^|/)f1[^/]*[.]p.$') GROUP BY root""",
)
def ev_files_in_window(spark, sf_dir):
    """Files named by a glob, strong where they were last written in the first three months of their run."""
    acts = _acts(spark, sf_dir).drop("root").withColumnRenamed("sid", "root")
    files = acts.filter("action = 'modify_file'").groupBy("root", "path").agg(F.max("ts").alias("modified_at"))
    windows = acts.groupBy("root").agg(F.min("ts").alias("lower"), (F.min("ts") + F.expr("interval 90 days")).alias("upper"))
    patterns = windows.select(F.lit(1).alias("req_id"), "root", F.lit("f1*.p?").alias("glob"))
    return evidence.files_in_window(files, patterns, windows)


@query("ev_summaries", f"{A} SELECT sid, idx, turn, action, left(coalesce(command, path, ''), 220) AS target, purpose FROM actions")
def ev_summaries(spark, sf_dir):
    return evidence.summaries(_acts(spark, sf_dir))


@query("ev_time_windows", f"{A}, s AS (SELECT sid, min(ts) AS lo, max(ts) AS hi FROM actions GROUP BY sid) SELECT sid // 10 AS root, CAST(epoch_us(min(lo)) AS BIGINT) AS lower, CAST(epoch_us(max(hi)) AS BIGINT) AS upper FROM s GROUP BY sid // 10")
def ev_time_windows(spark, sf_dir):
    sessions = _acts(spark, sf_dir).groupBy("sid").agg(F.min("ts").alias("created_at"), F.max("ts").alias("modified_at"))
    tree = sessions.select(F.floor(F.col("sid") / 10).alias("root"), "sid")
    return evidence.time_windows(tree, sessions).select("root", F.unix_micros("lower").alias("lower"), F.unix_micros("upper").alias("upper"))


@query(
    "goal_tri_state",
    f"""WITH {_ANCHORS_SQL}, h AS (SELECT item_id AS req_id FROM benchmark WHERE item_id % 7 = 0), m AS (SELECT req_id, count(DISTINCT doc) AS n FROM a JOIN pool ON contains(pool.text, a.anchor) GROUP BY req_id)
    SELECT b.item_id AS req_id, CASE WHEN h.req_id IS NOT NULL THEN 'hard' WHEN m.n > 0 THEN 'candidates' ELSE 'absent' END AS status, CASE WHEN h.req_id IS NOT NULL THEN 'direct' WHEN m.n > 0 THEN 'retrieved' ELSE 'none' END AS tier
    FROM benchmark b LEFT JOIN h ON h.req_id = b.item_id LEFT JOIN m ON m.req_id = b.item_id""",
)
def goal_tri_state(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("req_id"))
    hard = items.filter(F.col("req_id") % 7 == 0).withColumn("tier", F.lit("direct"))
    return goal.search_states(items, _anchors(spark, sf_dir), pool.filter(F.col("doc") % 2 == 0), pool, hard).select("req_id", "status", "tier")


_WORDS_SQL = "regexp_replace({0}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+', '', 'g')"
_QUOTES_SQL = f"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations),
  q AS (SELECT conv_id, turn, text, 'own' AS quoted, text AS said FROM c UNION ALL SELECT conv_id, turn, text, 'before', prior FROM c WHERE prior IS NOT NULL)
  SELECT conv_id, turn, quoted FROM q WHERE contains({_WORDS_SQL.format("text")}, {_WORDS_SQL.format("left(said, 40)")})"""


@query("goal_quote_filter", _QUOTES_SQL)
def goal_quote_filter(spark, sf_dir):
    """Every turn claims to hold its own opening and that of the turn before."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("at", F.concat_ws("/", "conv_id", "turn"))
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    quotes = F.array(F.struct(F.lit("own").alias("quoted"), F.col("text").alias("of")), F.struct(F.lit("before").alias("quoted"), before.alias("of")))
    claims = said.select("conv_id", "turn", "at", quotes.alias("q")).select("conv_id", "turn", "at", F.inline("q")).filter("of is not null")
    return goal.quoted(claims.withColumn("quote", F.left("of", F.lit(40))), said.select("at", "text"), "at").select("conv_id", "turn", "quoted")


_FINDINGS_SQL = f"""{A}, f AS (SELECT sid, seg AS req_id, CASE WHEN bool_or(error IS NOT NULL AND k < 3) THEN 'false' WHEN count(*) < 8 THEN 'unverifiable' ELSE 'true' END AS satisfied,
  bool_or(error IS NOT NULL AND k = 99) AS overclaim, seg = 5 AS synthetic, CASE WHEN seg % 3 = 0 THEN 'weak' ELSE 'strong' END AS strength FROM actions GROUP BY sid, seg)"""


@query(
    "goal_candidates",
    f"""WITH {_ANCHORS_SQL}, m AS (SELECT req_id, anchor, doc FROM a JOIN pool ON contains(pool.text, a.anchor)),
    s AS (SELECT req_id, doc, count(*) AS hits FROM m GROUP BY req_id, doc), far AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY hits DESC, doc) AS r FROM s) WHERE r <= 8),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY hits DESC, doc) AS r FROM s WHERE doc % 2 = 0) WHERE r <= 8),
    b AS (SELECT req_id, doc, true AS in_scope, r FROM near UNION ALL SELECT req_id, doc, false, r FROM far WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.req_id = far.req_id AND n.doc = far.doc))
    SELECT req_id, CAST(row_number() OVER (PARTITION BY req_id ORDER BY in_scope DESC, r) AS INTEGER) AS place, doc, in_scope, doc < 100 AS before FROM b""",
)
def goal_candidates(spark, sf_dir):
    """What each requirement looks at: the best of its scope, then of the whole pool, early rows marked."""
    pool = _pool(spark, sf_dir).withColumn("before", F.col("doc") < 100)
    return goal.candidates(_anchors(spark, sf_dir), pool.filter(F.col("doc") % 2 == 0), pool, mode="count").select("req_id", "place", "doc", "in_scope", "before")


_PACK_SQL = f"""{A}, r AS (SELECT sid, 'r' || lpad(CAST(seg AS VARCHAR), 4, '0') AS id, seg, min(turn) AS t FROM actions GROUP BY sid, seg),
    l AS (SELECT sid, id AS req, 0 AS part, 0 AS place, '--- ' || id || ' do it' || chr(10) || '  (turn ' || t || ', action, active, strong)' || chr(10) || '  expect: done' AS line, NULL AS ref FROM r
      UNION ALL SELECT sid, 'r' || lpad(CAST(seg AS VARCHAR), 4, '0'), CASE WHEN error IS NOT NULL THEN 1 ELSE 2 END, idx,
        CASE WHEN error IS NULL THEN '    [candidate] ' WHEN k < 50 THEN '    [hit before the request] ' ELSE '    [hit] ' END || sid || '#' || idx || ' ' || action || ' ' || coalesce(command, path, '') || chr(10) || '        purpose: ' || purpose, sid || '#' || idx FROM actions WHERE action <> 'user_prompt'),
    s AS (SELECT *, sum(length(line) + 1) OVER w AS total, row_number() OVER w AS n FROM l WINDOW w AS (PARTITION BY sid ORDER BY req, part, place, coalesce(ref, ''), line ROWS UNBOUNDED PRECEDING))"""


def _pack_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as requirements, their failed actions as hits of a hard check, the others as candidates."""
    acts = _acts(spark, sf_dir)
    name = F.concat(F.lit("r"), F.lpad(F.col("seg").cast("string"), 4, "0"))
    asked = acts.groupBy("sid", "seg").agg(F.min("turn").alias("origin_turn")).select("sid", name.alias("id"), F.lit("do it").alias("text"), "origin_turn", F.lit("action").alias("verifiable_by"), F.lit("active").alias("status"), F.lit("strong").alias("strength"), F.lit("done").alias("expect"))
    hits = acts.filter("action <> 'user_prompt'").select("sid", name.alias("req_id"), F.col("idx").alias("ord"), F.when(F.col("error").isNotNull(), "hard").otherwise("candidate").alias("kind"), F.concat_ws("#", "sid", "idx").alias("ref"), "action", F.coalesce("command", "path").alias("target"), "purpose", (F.col("k") < 50).alias("before"))
    return goal.evidence_lines(asked, hits, ["sid"])


@query("goal_packs", f"{_PACK_SQL} SELECT sid, string_agg(line, chr(10) ORDER BY n) FILTER (WHERE total <= 2000) AS text, count(*) FILTER (WHERE total <= 2000) AS shown, count(*) FILTER (WHERE total > 2000) AS left_out FROM s GROUP BY sid")
def goal_packs(spark, sf_dir):
    """What there is to go by in each session, up to 2,000 characters."""
    return goal.packs(_pack_lines(spark, sf_dir), ["sid"], 2000)[0]


@query("goal_uncited", f"{_PACK_SQL}, cited AS (SELECT sid, 'r' || lpad(CAST(seg AS VARCHAR), 4, '0') AS req_id, sid || '#' || idx AS ref FROM actions WHERE k % 10 = 0) SELECT c.* FROM cited c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.sid = c.sid AND s.req = c.req_id AND s.ref = c.ref AND total <= 2000)")
def goal_uncited(spark, sf_dir):
    """Findings cite every tenth action; those that their session's pack does not show."""
    acts = _acts(spark, sf_dir).filter("k % 10 = 0")
    name = F.concat(F.lit("r"), F.lpad(F.col("seg").cast("string"), 4, "0"))
    findings = acts.groupBy("sid", name.alias("req_id")).agg(F.collect_list(F.concat_ws("#", "sid", "idx")).alias("evidence_actions"))
    return goal.uncited(findings, goal.packs(_pack_lines(spark, sf_dir), ["sid"], 2000)[1], ("sid",))


@query(
    "goal_written_names",
    f"""{A}, w AS (SELECT sid, path, min(idx) AS f FROM actions WHERE action = 'modify_file' GROUP BY sid, path)
    SELECT sid, string_agg(replace(path, '/w/', ''), ',' ORDER BY f, path) AS names FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY f, path) AS r FROM w) WHERE r <= 30 GROUP BY sid""",
)
def goal_written_names(spark, sf_dir):
    return goal.written_names(_acts(spark, sf_dir)).withColumn("names", F.array_join("names", ","))


@query(
    "goal_aggregate",
    f"""{_FINDINGS_SQL}, g AS (SELECT sid, count(*) FILTER (WHERE s) AS strong_active, count(*) FILTER (WHERE s AND satisfied = 'true') AS satisfied, count(*) FILTER (WHERE s AND satisfied = 'unverifiable') AS unverifiable,
    count(*) FILTER (WHERE s AND satisfied = 'false') AS unmet, count(*) FILTER (WHERE NOT synthetic AND overclaim) AS overclaim, bool_and(satisfied = 'false') FILTER (WHERE synthetic) AS control_passed
    FROM (SELECT *, strength = 'strong' AND NOT synthetic AS s FROM f) GROUP BY sid)
    SELECT *, CASE WHEN NOT control_passed THEN 'INVALID' WHEN unmet > 0 OR overclaim > 0 THEN 'FAIL' WHEN unverifiable > 0 THEN 'WEAK_PASS' ELSE 'PASS' END AS verdict, round(satisfied / greatest(strong_active, 1), 3) AS score FROM g""",
)
def goal_aggregate(spark, sf_dir):
    bad = F.col("error").isNotNull()
    found = _acts(spark, sf_dir).groupBy("sid", F.col("seg").alias("req_id")).agg(
        F.when(F.bool_or(bad & (F.col("k") < 3)), "false").when(F.count("*") < 8, "unverifiable").otherwise("true").alias("satisfied"),
        F.bool_or(bad & (F.col("k") == 99)).alias("overclaim"),
    )
    found = found.withColumn("synthetic", F.col("req_id") == 5)
    asked = found.select("sid", F.col("req_id").alias("id"), F.when(F.col("req_id") % 3 == 0, "weak").otherwise("strong").alias("strength"), F.lit("active").alias("status"))
    return goal.aggregate(found, asked, ["sid"])


@query(
    "goal_confidence_cap",
    f"""{A} SELECT sid, idx, round(CASE WHEN k % 2 = 0 THEN v * 0.9 ELSE v END, 3) AS confidence FROM (SELECT sid, idx, k, least(greatest(k / 90.0::DOUBLE, 0.0), CASE action WHEN 'read_file' THEN 0.75 WHEN 'modify_file' THEN 1.0 WHEN 'run_command' THEN 0.85 ELSE 0.0 END::DOUBLE) AS v FROM actions)""",
)
def goal_confidence_cap(spark, sf_dir):
    tier = F.when(F.col("action") == "read_file", "retrieved").when(F.col("action") == "modify_file", "direct").when(F.col("action") == "run_command", "derived").otherwise("none")
    return _acts(spark, sf_dir).select("sid", "idx", goal.capped_confidence(tier, F.col("k") / F.lit(90.0), F.col("k") % 2 == 0).alias("confidence"))


@query("goal_command_heads", f"{A} SELECT 'cd' AS head, count(*) AS n FROM actions WHERE command IS NOT NULL")
def goal_command_heads(spark, sf_dir):
    return goal.command_heads(_acts(spark, sf_dir))


@query("goal_nearby", f"{A}, w AS (SELECT sid, min(idx) AS lo FROM actions WHERE turn = 3 GROUP BY sid) SELECT 1 AS req_id, sid, idx FROM (SELECT a.sid, a.idx, row_number() OVER (PARTITION BY a.sid ORDER BY a.idx) AS r FROM actions a JOIN w USING (sid) WHERE a.idx >= w.lo) WHERE r <= 12")
def goal_nearby(spark, sf_dir):
    acts = _acts(spark, sf_dir)
    weak = acts.select("sid").distinct().select(F.lit(1).alias("req_id"), "sid", F.lit(3).alias("turn"))
    return goal.nearby(acts, weak)


# ---- statistics, spans, views ----------------------------------------------------------------------------------

_STATS = """count(*) AS actions, count(*) AS calls, count(DISTINCT path) FILTER (WHERE action = 'read_file') AS files_read, count(DISTINCT path) FILTER (WHERE action = 'modify_file') AS files_written,
  CAST(sum(CASE WHEN command IS NULL THEN 0 ELSE 2 END) AS BIGINT) AS subcommands, count(*) FILTER (WHERE NOT completed) AS orphans, CAST(0 AS BIGINT) AS blocked"""


@query("norm_session_stats", f"{A} SELECT sid, {_STATS} FROM actions GROUP BY sid")
def norm_session_stats(spark, sf_dir):
    return stats.session_stats(_acts(spark, sf_dir))


@query("norm_corpus_rollup", f"{A} SELECT sid, {_STATS} FROM actions GROUP BY ROLLUP (sid)")
def norm_corpus_rollup(spark, sf_dir):
    return stats.corpus_stats(_acts(spark, sf_dir))


@query("norm_action_histogram", f"{A} SELECT action, count(*) AS n FROM actions GROUP BY action")
def norm_action_histogram(spark, sf_dir):
    return stats.histogram(_acts(spark, sf_dir), "action")


@query("norm_tools_per_turn", f"{A} SELECT sid, turn, count(*) AS calls, string_agg(tool, ',' ORDER BY idx) AS tools FROM actions GROUP BY sid, turn")
def norm_tools_per_turn(spark, sf_dir):
    return stats.calls_per_turn(_acts(spark, sf_dir)).withColumn("tools", F.array_join("tools", ","))


@query(
    "otel_spans",
    f"""{A} SELECT sid, idx, substring(sha256('trace:' || sid), 1, 32) AS trace_id, substring(sha256('span:' || sid || ':act:1:' || idx), 1, 16) AS span_id, substring(sha256('span:' || sid || ':run:1'), 1, 16) AS parent_id,
    'execute_tool ' || tool AS name, CASE WHEN error IS NOT NULL THEN 'ERROR' ELSE 'OK' END AS status, epoch_us(ts) * 1000 AS start_ns FROM actions""",
)
def otel_spans(spark, sf_dir):
    return spans.spans(_acts(spark, sf_dir)).select("sid", "idx", "trace_id", "span_id", "parent_id", "name", "status", "start_ns")


@query("otel_root_envelope", f"{A} SELECT sid, substring(sha256('span:' || sid || ':run:1'), 1, 16) AS span_id, min(epoch_us(ts)) * 1000 AS start_ns, max(epoch_us(ts)) * 1000 AS end_ns, count(*) AS children FROM actions GROUP BY sid")
def otel_root_envelope(spark, sf_dir):
    return spans.roots(spans.spans(_acts(spark, sf_dir))).select("sid", "span_id", "start_ns", "end_ns", "children")


def _attribute(key: str, value: str, kind: str = "string") -> str:
    """SQL of an attribute as text; of no text where the value is null."""
    shown = {"string": f"'{{\"stringValue\":\"' || {value} || '\"}}'", "int": f"'{{\"intValue\":\"' || {value} || '\"}}'", "bool": f"'{{\"boolValue\":' || {value} || '}}'"}[kind]
    return f"'{{\"key\":\"{key}\",\"value\":' || {shown} || '}}'"


def _json(*fields: tuple[str, str]) -> str:
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in fields) + " || '}'"


def _quoted(value: str) -> str:
    return f"'\"' || {value} || '\"'"


_OF_ACTION = ", ".join(
    [
        _attribute("gen_ai.operation.name", "'execute_tool'"),
        _attribute("gen_ai.tool.name", "tool"),
        f"CASE WHEN tool IN ({', '.join(repr(t) for t in spans.TOOL_TYPES)}) THEN " + _attribute("gen_ai.tool.type", "CASE tool " + " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in spans.TOOL_TYPES.items()) + " END") + " END",
        _attribute("error.type", "error"),
        _attribute("agent.action", "action"),
        _attribute("agent.raw_tool", "raw_tool"),
        _attribute("agent.tool.purpose", "purpose"),
        _attribute("agent.blocked", "false", "bool"),
        _attribute("agent.completed", "completed", "bool"),
        _attribute("agent.turn", "turn", "int"),
        _attribute("agent.run", "1", "int"),
        _attribute("agent.idx", "idx", "int"),
    ]
)
_TRACE, _RUN_SPAN = "substring(sha256('trace:' || sid), 1, 32)", "substring(sha256('span:' || sid || ':run:1'), 1, 16)"
_SPAN_SQL = _json(
    ("traceId", _quoted(_TRACE)), ("spanId", _quoted("substring(sha256('span:' || sid || ':act:1:' || idx), 1, 16)")), ("parentSpanId", _quoted(_RUN_SPAN)), ("name", _quoted("'execute_tool ' || tool")), ("kind", "1"),
    ("startTimeUnixNano", _quoted("epoch_us(ts) * 1000")), ("endTimeUnixNano", _quoted("epoch_us(ts) * 1000")), ("attributes", f"'[' || concat_ws(',', {_OF_ACTION}) || ']'"), ("status", _json(("code", "CASE WHEN error IS NOT NULL THEN 2 ELSE 1 END"))),
)
_ROOT_SQL = _json(
    ("traceId", _quoted(_TRACE)), ("spanId", _quoted(_RUN_SPAN)), ("name", _quoted("'invoke_agent ' || left(CAST(sid AS VARCHAR), 8)")), ("kind", "1"), ("startTimeUnixNano", _quoted("min(epoch_us(ts)) * 1000")), ("endTimeUnixNano", _quoted("max(epoch_us(ts)) * 1000")),
    ("attributes", f"'[' || {_attribute('gen_ai.operation.name', chr(39) + 'invoke_agent' + chr(39))} || ',' || {_attribute('gen_ai.conversation.id', 'sid')} || ']'"), ("status", _json(("code", "1"))),
)
_RESOURCE_SQL = _json(("attributes", f"'[' || {_attribute('service.name', chr(39) + 'agent' + chr(39))} || ',' || {_attribute('gen_ai.conversation.id', 'sid')} || ']'"))


@query(
    "otel_documents",
    f"""{A}, s AS (SELECT sid, idx, {_SPAN_SQL} AS span FROM actions), r AS (SELECT sid, {_ROOT_SQL} AS root FROM actions GROUP BY sid), l AS (SELECT sid, string_agg(span, ',' ORDER BY idx) AS spans FROM s GROUP BY sid)
    SELECT sid, '{{"resourceSpans":[{{"resource":' || {_RESOURCE_SQL} || ',"scopeSpans":[{{"scope":{{"name":"sparktrail"}},"spans":[' || root || ',' || spans || ']}}]}}]}}' AS document FROM l JOIN r USING (sid)""",
)
def otel_documents(spark, sf_dir):
    return spans.documents(spans.spans(_acts(spark, sf_dir)))


@query(
    "viz_timeline_buckets",
    f"""{A}, b AS (SELECT sid, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi, min(idx) AS f, max(idx) AS l FROM actions GROUP BY sid)
    SELECT sid, cell, arg_max(symbol, idx) AS symbol FROM (SELECT a.sid, idx, CASE WHEN NOT completed THEN 'x' ELSE CASE action WHEN 'run_command' THEN '$' WHEN 'read_file' THEN 'r' WHEN 'modify_file' THEN 'w' ELSE '?' END END AS symbol,
      CAST(floor(CASE WHEN hi > lo THEN (epoch_us(ts) - lo) / (hi - lo) ELSE coalesce((idx - f) / nullif(l - f, 0), 0) END * 69) AS INTEGER) AS cell FROM actions a JOIN b USING (sid)) GROUP BY sid, cell""",
)
def viz_timeline_buckets(spark, sf_dir):
    return views.timeline(_acts(spark, sf_dir))


@query("viz_turn_spans", f"{A} SELECT sid, turn, min(ts) AS started, max(ts) AS ended, count(*) AS actions FROM actions GROUP BY sid, turn")
def viz_turn_spans(spark, sf_dir):
    out = views.turn_spans(_acts(spark, sf_dir))
    return out.withColumns({c: utc_clock(c) for c in ("started", "ended")})


@query(
    "viz_replay",
    f"""{A} SELECT sid, idx, CASE action WHEN 'run_command' THEN command WHEN 'read_file' THEN 'cat ' || path WHEN 'modify_file' THEN '# [side effect: modify_file] ' || path ELSE '# [' || action || ']' END
    || CASE WHEN completed THEN '' ELSE '   # ✗ incomplete/failed' END AS line FROM actions""",
)
def viz_replay(spark, sf_dir):
    return views.replay(_acts(spark, sf_dir))


@query(
    "viz_judge_view",
    f"""{A} SELECT sid, string_agg('[' || idx || '] ' || action || '(' || tool || ') ' || coalesce(command, path, '') || CASE WHEN error IS NOT NULL THEN ' [ERROR:' || error || ']' ELSE '' END
    || chr(10) || '    ↳ purpose: ' || purpose, chr(10) ORDER BY idx) AS text FROM actions GROUP BY sid""",
)
def viz_judge_view(spark, sf_dir):
    return views.judge_view(_acts(spark, sf_dir))


@query(
    "viz_gantt",
    f"""{A}, b AS (SELECT sid, turn, 'turn ' || turn || ' :' || strftime(min(ts), '%Y-%m-%dT%H:%M:%S') || ', ' || strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS bar FROM actions GROUP BY sid, turn)
    SELECT sid, 'gantt' || chr(10) || 'dateFormat YYYY-MM-DDTHH:mm:ss' || chr(10) || string_agg(bar, chr(10) ORDER BY turn) AS chart FROM b GROUP BY sid""",
)
def viz_gantt(spark, sf_dir):
    return views.gantt(_acts(spark, sf_dir))


@query(
    "viz_flow",
    f"""{_G}, l AS (SELECT sid, idx, key, version, CASE WHEN kind = 'generatedBy' THEN 'a' || idx || ' --> e' || substring(sha1(key || '@' || version), 1, 8) ELSE 'e' || substring(sha1(key || '@' || version), 1, 8) || ' --> a' || idx END AS line FROM edges)
    SELECT sid, 'graph LR' || chr(10) || string_agg(line, chr(10) ORDER BY idx, key, version, line) AS graph FROM l GROUP BY sid""",
)
def viz_flow(spark, sf_dir):
    return views.flow(_graph(spark, sf_dir)[3])


_FLAGS_SQL = f"""{A}, f AS (SELECT sid * 1000000 + idx AS flag_id, 'Mistake' AS tag, sid, idx FROM actions WHERE error IS NOT NULL)
    SELECT f.flag_id, f.tag, f.sid, f.idx AS centre, a.idx, a.action FROM f JOIN actions a ON a.sid = f.sid AND a.idx BETWEEN f.idx - 2 AND f.idx + 2"""


@query("tune_flag_context", _FLAGS_SQL)
def tune_flag_context(spark, sf_dir):
    """Every error flagged, half of them by a reference that is not found."""
    acts = _acts(spark, sf_dir).withColumn("ref", F.concat_ws("#", "sid", "idx"))
    flags = acts.filter("error is not null").select((F.col("sid") * 1_000_000 + F.col("idx")).alias("flag_id"), F.lit("Mistake").alias("tag"), "sid", F.when(F.col("idx") % 2 == 0, F.col("ref")).otherwise("none").alias("ref"), "idx")
    return views.flag_contexts(flags, acts)


# ---- checks of tables that come from outside -------------------------------------------------------------------


@query(
    "val_requirements",
    f"""{A}, t AS (SELECT sid, max(turn) AS last FROM actions GROUP BY sid), r AS (SELECT sid, 'r' || (idx // 2) AS id, CASE WHEN k % 9 = 0 THEN ' ' ELSE purpose END AS text, turn + CASE WHEN k % 7 = 0 THEN 1000 ELSE 0 END AS origin_turn, CASE WHEN k % 5 = 0 THEN 'odd' ELSE 'action' END AS v FROM actions WHERE idx % 2 = 0 OR k % 11 = 0),
    w AS (SELECT r.*, count(*) OVER (PARTITION BY r.sid, id) = 1 AS alone, origin_turn BETWEEN 1 AND last AS within FROM r JOIN t USING (sid))
    SELECT sid, id, origin_turn, concat_ws(',', CASE WHEN NOT alone THEN 'id' END, CASE WHEN trim(text) = '' THEN 'text' END, CASE WHEN NOT within THEN 'origin_turn' END, CASE WHEN v = 'odd' THEN 'verifiable_by' END) AS problems
    FROM w WHERE NOT alone OR trim(text) = '' OR NOT within OR v = 'odd'""",
)
def val_requirements(spark, sf_dir):
    """Requirements of all sessions, some with a repeated id, no text, a turn that is none or an unknown kind."""
    acts, k = _acts(spark, sf_dir), F.col("k")
    made = acts.filter("idx % 2 = 0 or k % 11 = 0").select(
        "sid", F.concat(F.lit("r"), F.floor(F.col("idx") / 2)).alias("id"), F.when(k % 9 == 0, " ").otherwise(F.col("purpose")).alias("text"), (F.col("turn") + F.when(k % 7 == 0, 1000).otherwise(0)).alias("origin_turn"),
        F.when(k % 5 == 0, "odd").otherwise("action").alias("verifiable_by"), F.lit("active").alias("status"), F.lit("strong").alias("strength"), F.lit("something").alias("expect"),
    )
    out = validators.requirements(made, acts.select("sid", "turn"), by=["sid"])
    return out.select("sid", "id", "origin_turn", F.array_join("problems", ",").alias("problems"))


@query(
    "val_segments",
    f"""{A}, s AS (SELECT sid, seg, min(turn) + CASE WHEN seg % 5 = 0 THEN 1 ELSE 0 END AS start, max(turn) AS stop FROM actions GROUP BY sid, seg), l AS (SELECT sid, max(turn) AS last FROM actions GROUP BY sid),
    w AS (SELECT *, start = coalesce(lag(stop) OVER o, 0) + 1 AS follows, lead(start) OVER o IS NULL AS final FROM s JOIN l USING (sid) WINDOW o AS (PARTITION BY sid ORDER BY start, stop))
    SELECT sid, seg, concat_ws(',', CASE WHEN NOT follows THEN 'start' END, CASE WHEN stop < start OR final AND stop <> last THEN 'stop' END) AS problems FROM w WHERE NOT follows OR stop < start OR final AND stop <> last""",
)
def val_segments(spark, sf_dir):
    """Segments of all sessions, every fifth of which begins a turn too late."""
    acts = _acts(spark, sf_dir)
    rows = _segments(acts).withColumns({"start": F.col("start") + F.when(F.col("seg") % 5 == 0, 1).otherwise(0), "theme": F.lit("a theme")})
    return validators.segments(rows, acts.select("sid", "turn")).select("sid", "seg", F.array_join("problems", ",").alias("problems"))


@query(
    "val_claims",
    """WITH c AS (SELECT conv_id, turn, lag(text, 1, '!?') OVER (PARTITION BY conv_id ORDER BY turn) AS quote, turn % 3 = 2 AS odd FROM conversations), m AS (SELECT *, length(regexp_replace(coalesce(quote, ''), '[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]+', '', 'g')) >= 4 AS said FROM c)
    SELECT conv_id, turn, concat_ws(',', CASE WHEN turn < 1 THEN 'turn' END, CASE WHEN odd THEN 'kind' END, CASE WHEN NOT said THEN 'quote' END) AS problems FROM m WHERE turn < 1 OR odd OR NOT said""",
)
def val_claims(spark, sf_dir):
    """Claims of all conversations, quoting the turn before: the first ones quote no word, every third is of no known kind."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    quote = F.lag("text", 1, "!?").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = said.select("conv_id", F.col("turn").cast("string").alias("id"), "turn", F.when(F.col("turn") % 3 == 2, "odd").otherwise("did").alias("kind"), quote.alias("quote"))
    return validators.claims(rows, said.select("conv_id", "turn"), ["conv_id"]).select("conv_id", "turn", F.array_join("problems", ",").alias("problems"))


@query(
    "val_judgements",
    f"""{A}, g AS (SELECT sid, seg, min(k) AS k FROM actions GROUP BY sid, seg)
    SELECT sid, concat_ws(',', CASE WHEN gone THEN 'segments' END, CASE WHEN bad_grade THEN 'grades' END, CASE WHEN thin OR named THEN 'operations' END, CASE WHEN recs NOT BETWEEN 3 AND 8 THEN 'recommendations' END) AS problems
    FROM (SELECT g.sid, bool_or(g.k % 5 = 0 AND NOT (g.seg = 2 AND g.k % 2 = 0)) AS bad_grade, bool_or(g.k % 7 = 0 AND NOT (g.seg = 2 AND g.k % 2 = 0)) AS thin, bool_or(g.k % 11 = 0 AND NOT (g.seg = 2 AND g.k % 2 = 0)) AS named, bool_or(g.seg = 2 AND g.k % 2 = 0) AS gone, max(g.seg) % 9 AS recs FROM g GROUP BY g.sid)
    WHERE gone OR bad_grade OR thin OR named OR recs NOT BETWEEN 3 AND 8""",
)
def val_judgements(spark, sf_dir):
    """Judgements of all sessions as documents: some leave a segment out, grade it by an unknown letter, tell too little of
    an operation or name a segment by its number, or give too few recommendations."""
    k = F.col("k")
    segs = _acts(spark, sf_dir).groupBy("sid", "seg").agg(F.min("k").alias("k"))
    op = F.concat(F.repeat(F.lit("words that tell of an operation "), F.when(k % 7 == 0, 1).otherwise(5)), F.lit("12 times, 34 lines"), F.when(k % 11 == 0, " in seg 2").otherwise(""))
    one = F.struct("seg", F.when(k % 5 == 0, "E").otherwise("A").alias("grade"), F.lit("a reason").alias("reason"), F.array(op).alias("suspicious_ops"))
    per = F.collect_list(F.when(~((F.col("seg") == 2) & (k % 2 == 0)), one))
    recs = F.array_repeat(F.lit("do 1 thing"), (F.max("seg") % 9).cast("int"))
    docs = segs.groupBy("sid").agg(F.parse_json(F.to_json(F.struct(F.lit("B").alias("global_grade"), F.lit("so").alias("global_reason"), per.alias("per_segment"), recs.alias("recommendations")))).alias("data"))
    return validators.judgement_documents(docs, segs).select("sid", F.array_join("problems", ",").alias("problems"))


@query(
    "val_hard_checks",
    f"""{A} SELECT sid, idx, CASE k % 6 WHEN 0 THEN 'hard_check' WHEN 1 THEN 'keys' WHEN 2 THEN 'values' WHEN 3 THEN 'artifact_glob' END AS problems FROM actions WHERE k % 6 < 4""",
)
def val_hard_checks(spark, sf_dir):
    """A criterion for each action: no object, an unknown key, an empty value, braces in a glob, a good one, none."""
    acts = _acts(spark, sf_dir)
    texts = F.array(F.lit('"x"'), F.lit('{"shell": "x"}'), F.lit('{"read_path": []}'), F.lit('{"artifact_glob": ["a.py", "b.{c,d}"]}'), F.lit('{"read_path": "/w/a", "invoke_agent": ["x"]}'), F.lit(None).cast("string"))
    rows = acts.select("sid", "idx", F.col("idx").alias("req_id"), F.parse_json(F.element_at(texts, (F.col("k") % 6 + 1).cast("int"))).alias("hard_check"))
    return validators.hard_checks(rows, ["sid", "idx"]).select("sid", "idx", F.array_join("problems", ",").alias("problems"))
