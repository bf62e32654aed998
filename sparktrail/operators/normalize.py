"""From tool calls to actions: names, fan-out, pairing of calls with their ends, and two sources held together."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrail.functions.shell import split_subcommands
from sparktrail.functions.text import blank, command_dir, filled, first_filled
from sparktrail.functions.vocabulary import READ_MODES, SINGLE_ACTIONS, TOOL_ALIASES, WRITE_ACTIONS

ACTION_PARTS = ("action", "path", "root", "cwd", "command", "subcommands", "pattern")
_PART = "struct<action:string,path:string,root:string,cwd:string,command:string,subcommands:array<string>,pattern:string>"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[key]


def canonical_tool(raw: Column) -> Column:
    return F.coalesce(_lookup(TOOL_ALIASES, raw), raw)


def folded(value: Column) -> Column:
    """A parameter value without the marks that naming styles differ in."""
    return F.lower(F.regexp_replace(blank(value), "[_-]", ""))


def text_of(item: Column) -> Column:
    """The text of a content item: its data, or the text in it."""
    plain = F.when(F.schema_of_variant(F.try_variant_get(item, "$.data", "variant")) == "STRING", F.try_variant_get(item, "$.data", "string"))
    return F.coalesce(plain, F.try_variant_get(item, "$.data.text", "string"), F.lit(""))


def _part(action: Column | str, **fields: Column) -> Column:
    action = F.lit(action) if isinstance(action, str) else action
    empty = F.array().cast("array<string>")
    values = {"action": action, **{c: F.lit(None) for c in ACTION_PARTS[1:]}, "subcommands": empty} | fields
    return F.struct(*(values[c].alias(c) for c in ACTION_PARTS)).cast(_PART)


def fan_out(raw_tool: Column, args: Column) -> Column:
    """The actions of one call, as an array of structs: one for each operation, image or dispatched agent."""
    get = lambda path, kind="string": F.try_variant_get(args, path, kind)
    tool = canonical_tool(raw_tool)

    def operation(op: Column) -> Column:
        own = lambda path, kind="string": F.try_variant_get(op, path, kind)
        action = F.coalesce(_lookup(READ_MODES, folded(own("$.mode"))), F.lit("read_file"))
        images = own("$.image_paths", "array<string>")
        one = F.array(_part(action, path=own("$.path")))
        return F.when((action == "read_image") & (F.size(images) > 0), F.transform(images, lambda p: _part(action, path=p))).otherwise(one)

    operations = get("$.operations", "array<variant>")
    objects = F.filter(operations, lambda o: F.startswith(F.schema_of_variant(o), F.lit("OBJECT")))
    nothing = F.array(_part("read_file"))
    read = F.when(F.coalesce(F.size(operations), F.lit(0)) == 0, F.array(_part("read_file", path=get("$.path")))).when(F.size(objects) == 0, nothing).otherwise(F.flatten(F.transform(objects, operation)))
    write = F.array(_part(F.coalesce(_lookup(WRITE_ACTIONS, folded(get("$.command"))), F.lit("modify_file")), path=get("$.path")))
    command = blank(get("$.command"))
    subs = split_subcommands(command)
    shell = F.array(_part("run_command", command=command, subcommands=subs, root=get("$.working_dir"), cwd=F.coalesce(command_dir(subs), get("$.working_dir"))))
    search = F.array(_part(_lookup(SINGLE_ACTIONS, tool), root=get("$.path"), pattern=get("$.pattern")))
    code = F.array(_part(F.concat(F.lit("code_"), F.coalesce(filled(get("$.operation")), F.lit("query"))), path=get("$.file_path"), root=get("$.path"), pattern=first_filled(get("$.symbol_name"), get("$.pattern"))))
    cloud = F.array(_part("aws_call", pattern=F.concat(F.coalesce(filled(get("$.service_name")), F.lit("?")), F.lit("/"), F.coalesce(filled(get("$.operation_name")), F.lit("?")))))
    knowledge = F.array(_part(F.concat(F.lit("knowledge_"), F.coalesce(filled(get("$.command")), F.lit("op"))), path=get("$.path"), pattern=get("$.query")))
    old = get("$.content.subagents", "array<variant>")
    spawn_old = F.when(folded(get("$.command")) == "listagents", F.array(_part("list_subagents"))).when(F.size(old) > 0, F.transform(old, lambda s: _part("spawn_subagent", pattern=F.try_variant_get(s, "$.agent_name", "string")))).otherwise(F.array(_part("spawn_subagent")))
    stages = get("$.stages", "array<variant>")
    spawn_new = F.when(F.size(stages) > 0, F.transform(stages, lambda s: _part("spawn_subagent", pattern=F.try_variant_get(s, "$.role", "string"), command=F.try_variant_get(s, "$.name", "string")))).otherwise(F.array(_part("spawn_subagent", pattern=get("$.task"))))
    return (
        F.when(tool == "read", read)
        .when(tool == "write", write)
        .when(tool == "shell", shell)
        .when(tool.isin("grep", "glob"), search)
        .when(tool == "code", code)
        .when(tool == "use_aws", cloud)
        .when(tool == "knowledge", knowledge)
        .when(tool == "introspect", F.array(_part("docs_query", pattern=get("$.query"))))
        .when(tool == "summary", F.array(_part("summarize", pattern=get("$.taskDescription"))))
        .when(raw_tool == "use_subagent", spawn_old)
        .when(tool == "subagent", spawn_new)
        .otherwise(F.array(_part(F.concat(F.lit("unknown:"), tool))))
    )


# ---- pairing ---------------------------------------------------------------------------------------------------


def canonical_input(raw: str | None, start: bool) -> str:
    """A tool input in one spelling; at the start of a call anything but an object counts as an empty one."""
    try:
        value = json.loads(raw) if raw else None
    except ValueError:
        value = raw
    return json.dumps(({} if start and not isinstance(value, dict) else value), sort_keys=True, ensure_ascii=False)


class Pairing:
    """Calls of one session that wait for their end: the latest of the same tool and input, else of the same tool."""

    def __init__(self, waiting: list[tuple[int, str, str]] | None = None):
        self._open: dict[int, tuple[str, str]] = {}
        self._latest: dict[tuple[str, ...], list[int]] = {}
        for call, tool, given in waiting or []:
            self._wait(call, tool, given)

    @property
    def waiting(self) -> list[tuple[int, str, str]]:
        return [(call, tool, given) for call, (tool, given) in self._open.items()]

    def _wait(self, call: int, tool: str, given: str) -> None:
        self._open[call] = tool, given
        for key in ((tool, given), (tool,)):
            self._latest.setdefault(key, []).append(call)

    def _last(self, *key: str) -> int | None:
        calls = self._latest.get(key, [])
        while calls and calls[-1] not in self._open:  # ended by way of the other key
            calls.pop()
        return calls[-1] if calls else None

    def start(self, call: int, tool: str | None, given: str | None) -> None:
        self._wait(call, tool or "", canonical_input(given, True))

    def end(self, tool: str | None, given: str | None, compare: bool = True) -> int | None:
        """The call that ends, if any; it waits no longer."""
        exact = self._last(tool or "", canonical_input(given, False)) if compare else None
        found = self._last(tool or "") if exact is None else exact
        self._open.pop(found, None)
        return found


def pair_calls(events: DataFrame) -> DataFrame:
    """(sid, call, line_no, end_no, blocked): each call of a log with the line that ended it, if one did.

    ``events`` has (sid, line_no, event, tool, tool_input). Which end belongs to which call depends on all calls still
    open, so a session is paired in one piece, in the order of its lines.
    """

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = Pairing(), []
        for r in rows.sort_values("line_no").itertuples():
            if r.event == "pre_tool_use":
                state.start(len(out), r.tool, r.tool_input)
                out.append([r.sid, len(out), r.line_no, None, False])
            elif r.event in ("post_tool_use", "tool_blocked"):
                call = state.end(r.tool, r.tool_input, r.event == "post_tool_use")
                if call is not None:
                    out[call][3 if r.event == "post_tool_use" else 4] = r.line_no if r.event == "post_tool_use" else True
        frame = pd.DataFrame(out, columns=["sid", "call", "line_no", "end_no", "blocked"])
        frame["end_no"] = frame["end_no"].astype("Int64")
        return frame

    wanted = events.filter(F.col("event").isin("pre_tool_use", "post_tool_use", "tool_blocked")).select("sid", "line_no", "event", "tool", "tool_input")
    return wanted.groupBy("sid").applyInPandas(pair, "sid string, call int, line_no int, end_no int, blocked boolean")


# ---- two sources -----------------------------------------------------------------------------------------------


def fingerprint() -> Column:
    """What an action is recognised by in another source."""
    return F.struct(canonical_tool(F.col("tool")).alias("tool"), F.col("action").alias("action"), F.left(blank(first_filled("command", "path", "pattern", "root")), F.lit(200)).alias("target"))


def orphans(actions: DataFrame) -> DataFrame:
    """Actions that neither ended nor were blocked."""
    return actions.filter(~F.coalesce(F.col("completed"), F.lit(False)) & ~F.coalesce(F.col("blocked"), F.lit(False)))


def backfilled(actions: DataFrame, official: DataFrame) -> DataFrame:
    """``actions`` in which orphans that the official record has as completed are completed, each success used once."""
    keyed = actions.withColumn("_key", fingerprint())
    rank = F.row_number().over(Window.partitionBy("sid", "_key").orderBy("idx"))
    open_ = orphans(keyed).select("sid", "idx", "_key", rank.alias("_n"))
    known = official.filter("completed").groupBy("sid", fingerprint().alias("_key")).agg(F.count("*").alias("_ok"))
    fixed = open_.join(known, ["sid", "_key"]).filter(F.col("_n") <= F.col("_ok")).select("sid", "idx", F.lit(True).alias("official_verified"))
    out = actions.drop("official_verified").join(fixed, ["sid", "idx"], "left").fillna(False, subset=["official_verified"])
    return out.withColumn("completed", F.coalesce(F.col("completed"), F.lit(False)) | F.col("official_verified"))


def tool_differences(official: DataFrame, hook: DataFrame, rejected: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(sid, tool, missing, extra, explained): how the tools of two sources (sid, tool) differ as multisets.

    Calls that were rejected before they ran explain as many missing ones.
    """
    keys = keys or ["sid"]
    count = lambda df, name: df.groupBy(*keys, canonical_tool(F.col("tool")).alias("tool")).agg(F.count("*").alias(name))
    both = count(official, "o").join(count(hook, "h"), [*keys, "tool"], "full").join(count(rejected, "r"), [*keys, "tool"], "left").fillna(0, subset=["o", "h", "r"])
    missing = F.greatest(F.col("o") - F.col("h"), F.lit(0))
    out = both.select(*keys, "tool", missing.alias("missing"), F.greatest(F.col("h") - F.col("o"), F.lit(0)).alias("extra"), F.least(missing, "r").alias("explained"))
    return out.filter("missing > 0 or extra > 0")


def coverage(official: DataFrame, hook: DataFrame, differences: DataFrame) -> DataFrame:
    """(sid, level): agreed, explained, suspected missing record or coverage scope may differ."""
    sizes = official.groupBy("sid").agg(F.count("*").alias("o")).join(hook.groupBy("sid").agg(F.count("*").alias("h")), "sid", "left").fillna(0)
    worst = differences.groupBy("sid").agg(F.sum(F.col("missing") - F.col("explained")).alias("open"), F.sum("extra").alias("extra"))
    far = F.abs(F.col("o") - F.col("h")) > F.greatest(F.lit(3), F.floor(F.col("o") / 10))
    level = F.when(F.col("open").isNull(), "agreed").when((F.col("open") == 0) & (F.col("extra") == 0), "explained").when(far, "coverage scope may differ").otherwise("suspected missing record")
    return sizes.join(worst, "sid", "left").select("sid", level.alias("level"))


#: Characters of a title that a run's prompt is compared with, and the width of the bins of time that runs and sessions meet in.
HEAD, BIN_S = 40, 86_400


def attribute_runs(runs: DataFrame, sessions: DataFrame, minutes: int = 5, hours: int = 6) -> DataFrame:
    """(sid, run, session): the official session that each run of a log is, if one can be told.

    ``runs`` has (sid, run, prompt, started_at, cwd), ``sessions`` (sid, title, cwd, created_at, modified_at). A session
    fits if it has the run's directory (where the log has one), was created within the log's time (and some minutes),
    changed within some hours of it, and the first characters of its title begin the run's prompt. Runs take turns, each
    the nearest in time that is left (ties: the smaller id), which is decided for each log in one piece.

    Runs and sessions meet by equal keys only: the beginning of a prompt at every length it can be compared at, and the
    bin of time that the session was created in, which a log has one of for each day it lasts. Logs without a time meet
    sessions by the beginning of the prompt alone.
    """
    spans = runs.groupBy("sid").agg(F.min("started_at").alias("lo"), F.max("started_at").alias("hi"), F.max("cwd").alias("log_cwd"))
    head = F.left(F.regexp_replace("title", r"[.… ]+\z", ""), F.lit(HEAD))
    bin_of = lambda t: F.floor(F.unix_seconds(t) / BIN_S)
    gap, wide = F.make_dt_interval(mins=F.lit(minutes)), F.make_dt_interval(hours=F.lit(hours))
    at = sessions.select(F.col("sid").alias("session"), head.alias("head"), F.col("cwd").alias("own_cwd"), "created_at", "modified_at", bin_of("created_at").alias("bin")).filter("created_at is not null and head <> ''")

    said = F.left(blank("prompt"), F.lit(HEAD))
    heads = F.transform(F.sequence(F.lit(1), F.length(said)), lambda n: F.left(said, n))
    asked = runs.join(spans, "sid").filter(F.length(said) > 0).select("sid", "run", "started_at", "lo", "hi", "log_cwd", F.explode(heads).alias("head"))
    timed = asked.filter("lo is not null").withColumn("bin", F.explode(F.sequence(bin_of(F.col("lo") - gap), bin_of(F.col("hi") + gap))))
    fits = timed.join(at, ["head", "bin"]).unionByName(asked.filter("lo is null").join(at.drop("bin"), "head"), allowMissingColumns=True)
    same = F.col("log_cwd").isNull() | (F.col("log_cwd") == F.col("own_cwd"))
    in_time = lambda c, room: F.coalesce(F.col(c).between(F.col("lo") - room, F.col("hi") + room), F.lit(True))
    away = F.coalesce(F.abs(F.unix_micros("created_at") - F.unix_micros("started_at")), F.lit(0))
    ranked = fits.filter(same & in_time("created_at", gap) & in_time("modified_at", wide)).select("sid", "run", "session", away.alias("away"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        out = []
        for run, own in rows.sort_values(["run", "away", "session"]).groupby("run", sort=True):
            free = own[~own["session"].isin(used)]
            if len(free):
                used.add(free.iloc[0]["session"])
                out.append((rows.iloc[0]["sid"], run, free.iloc[0]["session"]))
        return pd.DataFrame(out, columns=["sid", "run", "session"])

    chosen = ranked.groupBy("sid").applyInPandas(choose, "sid string, run int, session string")
    return runs.select("sid", "run").join(chosen, ["sid", "run"], "left")


def bag_differences(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, common, only_first, only_second): two tables as multisets, how often each row is in both and in one alone."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    # grouped once more instead of joined, so that null keys meet
    both = count(first, "a").withColumn("b", F.lit(0)).unionByName(count(second, "b").withColumn("a", F.lit(0)))
    n = both.groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return n.select(*keys, F.least("a", "b").alias("common"), F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("only_first"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("only_second"))


def side_by_side(hook: DataFrame, official: DataFrame) -> DataFrame:
    """(sid, idx, hook_tool, official_tool, same) of sessions in which both sources have as many actions."""
    sizes = hook.groupBy("sid").agg(F.count("*").alias("h")).join(official.groupBy("sid").agg(F.count("*").alias("o")), "sid").filter("h = o").select("sid")
    h = hook.select("sid", "idx", canonical_tool(F.col("tool")).alias("hook_tool"))
    o = official.select("sid", "idx", canonical_tool(F.col("tool")).alias("official_tool"))
    out = h.join(o, ["sid", "idx"]).join(sizes, "sid", "left_semi")
    return out.withColumn("same", F.col("hook_tool").eqNullSafe(F.col("official_tool")))
