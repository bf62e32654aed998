"""``python -m sparktrail WHAT --official DIR | --hook DIR | --normalized FILE [--session SID] [--out DIR]``

WHAT is stats, totals, actions, rules (with --rules FILE, or --rules DIR and --agent NAME, and --scoring FILE), efficiency, graph, fates, spans, replay,
judge or timeline. Results are written as JSON to --out, or the first rows are shown.
"""

from __future__ import annotations

import argparse
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrail.functions.vocabulary import SCORING
from sparktrail.operators import efficiency, graph, rules, spans, stats, views
from sparktrail.sources import cache, hooks, normalized, official


def load(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The actions of the source that the arguments name."""
    if args.official:
        acts = official.actions(official.read_events(spark, args.official))
    elif args.hook:
        acts = hooks.actions(hooks.read_events(spark, args.hook))
    else:
        acts = normalized.read_actions(spark, args.normalized).withColumn("ts", F.try_to_timestamp("ts"))
    return acts if args.session is None else acts.filter(F.col("sid") == args.session)


def _graph(acts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return graph.provenance(acts)


def _scoring(spark: SparkSession, path: str | None) -> dict:
    """Scoring from a file over the defaults; the defaults alone, with a warning, where it cannot be read."""
    if path is None:
        return SCORING
    try:
        return SCORING | normalized.read_config(spark, path)
    except Exception as e:  # noqa: BLE001  any unreadable file counts alike
        warnings.warn(f"{path}: {e}; default scoring is used", stacklevel=2)
        return SCORING


def _verdicts(spark: SparkSession, acts: DataFrame, args: argparse.Namespace) -> DataFrame:
    config = normalized.read_config(spark, args.rules) if args.agent is None else normalized.rules_of(spark, args.rules, args.agent)
    results = rules.evaluate(acts, config["checks"] if isinstance(config, dict) else config)
    told = rules.verdicts(results, _scoring(spark, args.scoring))
    return told.join(results.groupBy("sid").agg(F.collect_list(F.struct(*rules.RESULT.names)).alias("checks")), "sid").withColumn("health", F.round("health", 3))


def _efficiency(spark: SparkSession, acts: DataFrame, args: argparse.Namespace) -> DataFrame:
    """With official records the cost of turns counts; each session is one segment."""
    if args.official:
        turns = official.turn_meta(official.read_sessions(spark, args.official)).select("sid", "turn", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("dur_s", "credits", "cycles", "llm_reqs", "ctx_pct")))
    else:
        turns = acts.groupBy("sid", "turn").agg(F.lit(0.0).alias("dur_s"), F.lit(0.0).alias("credits"), F.count("*").alias("cycles"), F.count("*").alias("llm_reqs"), F.lit(0.0).alias("ctx_pct"))
    segments = turns.groupBy("sid").agg(F.lit(1).alias("seg"), F.min("turn").alias("start"), F.max("turn").alias("stop"))
    own = acts.withColumn("seg", F.lit(1))
    rewrites, failures = efficiency.multi_writes(own), efficiency.failure_groups(own)
    commands = own.filter("action = 'run_command'")
    said = cache.texts(commands).filter(F.col("dim").isin("command", "purpose", "reasoning"))
    repeated = efficiency.duplicate_text_clusters(commands, said, cache.encoded(said.select("dim", "sha1", "text").dropDuplicates(["dim", "sha1"])))
    graded = efficiency.grades(segments, turns, repeated, rewrites, efficiency.stuck_turns(turns, segments), failures)
    return efficiency.report(turns, segments, graded, rewrites, failures, repeated)


WHAT = {
    "actions": lambda s, a, o: a,
    "stats": lambda s, a, o: stats.session_stats(a),
    "totals": lambda s, a, o: stats.corpus_stats(a),
    "rules": _verdicts,
    "efficiency": _efficiency,
    "graph": lambda s, a, o: _graph(a)[1],
    "fates": lambda s, a, o: graph.fates(*_graph(a)),
    "spans": lambda s, a, o: spans.documents(spans.spans(a)),
    "replay": lambda s, a, o: views.replay(a).orderBy("sid", "idx"),
    "judge": lambda s, a, o: views.judge_view(a),
    "timeline": lambda s, a, o: views.timeline(a).orderBy("sid", "cell"),
}


def main(argv: list[str] | None = None) -> DataFrame:
    parser = argparse.ArgumentParser(prog="sparktrail", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("what", choices=sorted(WHAT))
    source = parser.add_mutually_exclusive_group(required=True)
    for kind in ("official", "hook", "normalized"):
        source.add_argument(f"--{kind}")
    for option in ("session", "rules", "agent", "scoring", "out"):
        parser.add_argument(f"--{option}")
    args = parser.parse_args(argv)
    if args.what == "rules" and not args.rules:
        parser.error("rules needs --rules")
    spark = SparkSession.builder.appName("sparktrail").getOrCreate()
    found = WHAT[args.what](spark, load(spark, args), args)
    if args.out:
        found.write.json(args.out)
    else:
        found.show(50, truncate=120)
    return found


if __name__ == "__main__":
    main()
