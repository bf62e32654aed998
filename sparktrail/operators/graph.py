"""Provenance: versions of artifacts, what made them and what read them.

Nodes are activities (sid, idx) and entities (sid, key, version); edges say generatedBy or usedBy. One window by
(sid, path) numbers versions and finds the version that an action sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrail.functions.commands import ENDINGS, hosts, paths_by_variables, paths_said, paths_touched, pids_said, said_by_tool, variables_set, variables_used, words_left_open
from sparktrail.functions.text import filled, normal_path
from sparktrail.operators.links import written

# Actions that write, those that read what they change, and those that imply an earlier state.
WRITES = ("write_file", "modify_file", "create_file", "edit_file")
PARTIAL = ("modify_file", "edit_file")
IMPLIES_EARLIER = ("modify_file", "edit_file", "write_file")
READS = ("read_file",)
# Confidences, from the weakest on.
CONFIDENCE = ("weak", "likely", "certain")
# Actions that look for something without touching it.
PROBES = ("search_content", "search_files", "list_dir", "code_search_symbols")


def touches(actions: DataFrame) -> DataFrame:
    """(sid, idx, turn, action, path, is_write, visible, version): actions that read or write an artifact.

    ``visible`` is the version current just before the action, null where there is none; ``version`` the one that a
    write makes. Failed actions touch nothing.
    """
    known = actions.filter(F.col("action").isin(*WRITES, *READS) & filled("path").isNotNull() & filled("error").isNull())
    write = F.col("action").isin(*WRITES)
    order = Window.partitionBy("sid", "path").orderBy("idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("action").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    has_zero = first.isin(*READS, *IMPLIES_EARLIER)
    done = F.coalesce(F.sum(write.cast("int")).over(before), F.lit(0))
    visible = F.when(has_zero | (done > 0), done)
    return known.select("sid", "idx", "turn", "action", "path", write.alias("is_write"), visible.alias("visible"), F.when(write, done + 1).alias("version"), has_zero.alias("has_zero"))


def entities(touched: DataFrame) -> DataFrame:
    """(sid, key, version, producer_idx, born_idx): each version; version 0 stands for what was there before."""
    made = touched.filter("is_write").select("sid", F.col("path").alias("key"), "version", F.col("idx").alias("producer_idx"), F.col("idx").alias("born_idx"))
    zero = touched.filter("has_zero").select("sid", F.col("path").alias("key")).distinct().select("sid", "key", F.lit(0).cast("long").alias("version"), F.lit(None).cast("int").alias("producer_idx"), F.lit(-1).alias("born_idx"))
    return made.withColumn("version", F.col("version").cast("long")).unionByName(zero)


def edges(touched: DataFrame) -> DataFrame:
    """(sid, idx, key, version, kind, confidence): generatedBy from writes, usedBy from reads and partial edits."""
    made = touched.filter("is_write").select("sid", "idx", F.col("path").alias("key"), F.col("version").cast("long").alias("version"), F.lit("generatedBy").alias("kind"))
    used = touched.filter(F.col("action").isin(*READS, *PARTIAL) & F.col("visible").isNotNull()).select("sid", "idx", F.col("path").alias("key"), F.col("visible").cast("long").alias("version"), F.lit("usedBy").alias("kind"))
    return made.unionByName(used).withColumn("confidence", F.lit("certain"))


def at_least(confidence: str) -> Column:
    """Edges of a confidence or a higher one."""
    return F.col("confidence").isin(*CONFIDENCE[CONFIDENCE.index(confidence) :])


def confidence_counts(all_edges: DataFrame) -> DataFrame:
    """(sid, kind, confidence, n): edges by kind and confidence."""
    return all_edges.groupBy("sid", "kind", "confidence").agg(F.count("*").alias("n"))


def isolated(actions: DataFrame, all_edges: DataFrame) -> DataFrame:
    """Actions without an edge."""
    return actions.join(all_edges.select("sid", "idx").distinct(), ["sid", "idx"], "left_anti")


def stats(actions: DataFrame, all_entities: DataFrame, all_edges: DataFrame) -> DataFrame:
    """Counts of each session's graph and the share of isolated actions in per cent."""
    acts = actions.groupBy("sid").agg(F.count("*").alias("activities"))
    ents = all_entities.groupBy("sid").agg(F.count("*").alias("entities"))
    links = all_edges.groupBy("sid").agg(F.count_if(F.col("kind") == "generatedBy").alias("generated_by"), F.count_if(F.col("kind") == "usedBy").alias("used_by"), F.count_distinct("idx").alias("_linked"))
    out = acts.join(ents, "sid", "left").join(links, "sid", "left").fillna(0)
    alone = F.col("activities") - F.col("_linked")
    return out.withColumns({"isolated": alone, "isolated_pct": F.round(100 * alone / F.col("activities"), 1)}).drop("_linked")


def fates(all_entities: DataFrame, all_edges: DataFrame) -> DataFrame:
    """What became of each version: input, superseded, consumed or unconsumed, and how many actions read it."""
    readers = all_edges.filter("kind = 'usedBy'").groupBy("sid", "key", "version").agg(F.count_distinct("idx").alias("readers"))
    newest = F.max("version").over(Window.partitionBy("sid", "key"))
    out = all_entities.withColumn("newest", newest).join(readers, ["sid", "key", "version"], "left").fillna(0, subset=["readers"])
    fate = F.when((F.col("version") == 0) & F.col("producer_idx").isNull(), "input").when(F.col("version") < F.col("newest"), "superseded").when(F.col("readers") > 0, "consumed").otherwise("unconsumed")
    return out.withColumn("fate", fate).withColumn("never_read", (F.col("fate") == "superseded") & (F.col("readers") == 0))


def highest_versions(all_entities: DataFrame) -> DataFrame:
    return all_entities.groupBy("sid", "key").agg(F.max("version").alias("version"))


def shared_across_turns(actions: DataFrame, all_edges: DataFrame) -> DataFrame:
    """Versions that at least two turns touch: the turn that made each, and the turns that read it."""
    turn = all_edges.join(actions.select("sid", "idx", "turn"), ["sid", "idx"])
    made = F.min(F.when(F.col("kind") == "generatedBy", F.col("turn")))
    read = F.array_sort(F.collect_set(F.when(F.col("kind") != "generatedBy", F.col("turn"))))
    out = turn.groupBy("sid", "key", "version").agg(made.alias("made_in"), read.alias("read_in"), F.count_distinct("turn").alias("turns"))
    return out.filter("turns >= 2")


def turn_summaries(actions: DataFrame) -> DataFrame:
    """Of each turn: actions, first and last idx, the first three purposes and the longest thought (the first of equals)."""
    said = F.slice(F.transform(F.array_sort(F.collect_list(F.when(filled("purpose").isNotNull(), F.struct("idx", "purpose")))), lambda s: s["purpose"]), 1, 3)
    thought = F.max_by("reasoning", F.struct(F.length("reasoning"), -F.col("idx")))
    return actions.groupBy("sid", "turn").agg(F.count("*").alias("actions"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), said.alias("purposes"), thought.alias("thinking"))


def trails(touched: DataFrame) -> DataFrame:
    """(sid, key, step, idx, turn, version, is_read): the history of artifacts with several versions or any reader."""
    rows = touched.filter("is_write").select("sid", F.col("path").alias("key"), F.col("version").cast("long").alias("version"), F.lit(False).alias("is_read"), "turn", "idx")
    rows = rows.unionByName(touched.filter(F.col("action").isin(*READS, *PARTIAL) & F.col("visible").isNotNull()).select("sid", F.col("path").alias("key"), F.col("visible").cast("long").alias("version"), F.lit(True).alias("is_read"), "turn", "idx"))
    whole = Window.partitionBy("sid", "key")
    kept = rows.withColumn("_any", F.max("is_read").over(whole)).withColumn("_top", F.max(F.when(~F.col("is_read"), F.col("version")).otherwise(0)).over(whole)).filter("_any or _top >= 2")
    return kept.withColumn("step", F.row_number().over(whole.orderBy("version", "is_read", "turn", "idx"))).drop("_any", "_top")


def version_chains(all_entities: DataFrame) -> DataFrame:
    """(sid, key, chain): one line for each version with what made it."""
    line = F.concat(F.lit("v"), F.col("version").cast("string"), F.coalesce(F.concat(F.lit(" #"), F.col("producer_idx").cast("string")), F.lit(" (before)")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("version", line.alias("line")))), lambda s: s["line"])
    return all_entities.groupBy("sid", "key").agg(F.array_join(lines, "\n").alias("chain"))


def violations(all_entities: DataFrame, all_edges: DataFrame) -> DataFrame:
    """Edges that break the graph's rules: a use before the birth, a generation of another action, a loop of both."""
    both = all_edges.join(all_entities.select("sid", "key", "version", "producer_idx", "born_idx"), ["sid", "key", "version"], "left")
    late = (F.col("kind") == "usedBy") & (F.col("born_idx") >= F.col("idx"))
    other = (F.col("kind") == "generatedBy") & ~F.col("producer_idx").eqNullSafe(F.col("idx"))
    why = F.when(F.col("born_idx").isNull(), "no entity").when(late, "used before it was made").when(other, "made by another")
    loops = all_edges.groupBy("sid", "idx", "key", "version").agg(F.count_distinct("kind").alias("kinds")).filter("kinds > 1").select("sid", "idx", "key", "version", F.lit("made and used").alias("why"))
    return both.withColumn("why", why).filter("why is not null").select("sid", "idx", "key", "version", "why").unionByName(loops)


def in_turns(actions: DataFrame, all_edges: DataFrame, first: int, last: int, hide_isolated: bool = True) -> tuple[DataFrame, DataFrame]:
    """(actions, edges) of a span of turns; the edges are those that touch it."""
    chosen = actions.filter(F.col("turn").between(first, last))
    touching = all_edges.join(chosen.select("sid", "idx"), ["sid", "idx"], "left_semi")
    return (chosen.join(touching.select("sid", "idx").distinct(), ["sid", "idx"], "left_semi") if hide_isolated else chosen), touching


#: Characters that a command and the name of an artifact must share before they are compared.
_GRAM = 5


def unlinked_mentions(actions: DataFrame, all_entities: DataFrame, all_edges: DataFrame) -> DataFrame:
    """(sid, idx, key): commands that name an artifact (by its path or a base name of over 4 characters) without an edge.

    What names an artifact has the first characters of its base name (or the last of its path, where the base name is
    short), so commands and keys of a session meet by those and only then are compared; keys shorter than that, by all.
    """
    name = F.element_at(F.split("key", "/"), -1)
    keys = all_entities.select("sid", "key").distinct().withColumn("_name", name)
    gram = F.when(F.length("_name") >= _GRAM, F.left("_name", F.lit(_GRAM))).when(F.length("key") >= _GRAM, F.right("key", F.lit(_GRAM)))
    keys = keys.withColumn("_gram", gram)
    commands = actions.filter(filled("command").isNotNull()).select("sid", "idx", "command")
    last = F.length("command") - _GRAM + 1
    grams = F.array_distinct(F.transform(F.when(last >= 1, F.sequence(F.lit(1), last)), lambda i: F.substring(F.col("command"), i, F.lit(_GRAM))))
    met = commands.select("sid", "idx", "command", F.explode(grams).alias("_gram")).join(keys.filter("_gram is not null"), ["sid", "_gram"])
    met = met.select("sid", "idx", "command", "key", "_name").unionByName(commands.join(keys.filter("_gram is null"), "sid").select("sid", "idx", "command", "key", "_name"))
    found = met.filter(F.contains("command", "key") | ((F.length("_name") > 4) & F.contains("command", "_name")))
    return found.join(all_edges.select("sid", "idx", "key").distinct(), ["sid", "idx", "key"], "left_anti").select("sid", "idx", "key")


def short_duration(ms: Column | str) -> Column:
    """A duration for people: ``<1s``, ``12s``, ``3m 4s`` or ``1h 23m``."""
    s = F.floor((F.col(ms) if isinstance(ms, str) else ms) / 1000)
    return F.when(s < 1, "<1s").when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


# ---- what commands touch ---------------------------------------------------------------------------------------


def _assigning(commands: DataFrame) -> DataFrame:
    """Those that may set a variable: what has no sign for it need not be read."""
    return commands.filter(F.contains("command", F.lit("=")))


def variable_values(commands: DataFrame) -> DataFrame:
    """(sid, idx, env): the variables that a command uses and their values, as commands before it have set them.

    A variable that was last set to what the text does not tell has no value, whatever it was before.
    """
    sets = _assigning(commands).select("sid", "idx", F.explode(variables_set(F.col("command"))).alias("v")).select("sid", "idx", "v.name", "v.value", F.lit(False).alias("use"))
    uses = commands.filter(F.contains("command", F.lit("$"))).select("sid", "idx", F.explode(variables_used(F.col("command"))).alias("name")).select("sid", "idx", "name", F.lit(None).cast("string").alias("value"), F.lit(True).alias("use"))
    before = Window.partitionBy("sid", "name").orderBy("idx").rangeBetween(Window.unboundedPreceding, -1)
    # only assignments count; their value may be null, which is what makes it forgotten
    last = F.max_by(F.struct("value"), F.when(~F.col("use"), F.col("idx"))).over(before)
    known = sets.unionByName(uses).withColumn("last", last).filter("use and last.value is not null")
    return known.groupBy("sid", "idx").agg(F.map_from_entries(F.collect_list(F.struct("name", "last.value"))).alias("env"))


def _commands(actions: DataFrame) -> DataFrame:
    """(sid, idx, command, cwd, response, env) of shell commands: where each starts, and the values of the variables it uses."""
    if "action" not in actions.columns:  # such a table already
        return actions
    return _with_values(_own_commands(actions))


def _own_commands(actions: DataFrame) -> DataFrame:
    """(sid, idx, command, cwd, response) of shell commands."""
    commands = actions.filter((F.col("action") == "run_command") & filled("command").isNotNull())
    start = [filled(c) for c in ("root", "cwd") if c in actions.columns]  # ``cwd`` is where a command ends up
    response = F.col("response") if "response" in actions.columns else F.lit(None).cast("string")
    return commands.select("sid", "idx", "command", F.coalesce(*start, F.lit(None).cast("string")).alias("cwd"), response.alias("response"))


def _with_values(commands: DataFrame) -> DataFrame:
    """Commands with the values of the variables that each uses (``env``)."""
    return commands.join(variable_values(commands), ["sid", "idx"], "left").withColumn("env", F.coalesce("env", F.create_map().cast("map<string,string>")))


def command_touches(actions: DataFrame) -> DataFrame:
    """(sid, idx, path, is_write): the files that commands read and write, variables put in."""
    found = _commands(actions).select("sid", "idx", F.explode(paths_touched(F.col("command"), F.col("cwd"), F.col("env"))).alias("t"))
    return found.select("sid", "idx", "t.path", (F.col("t.direction") == "write").alias("is_write"))


def weak_touches(actions: DataFrame) -> DataFrame:
    """(sid, idx, path, is_write): files that commands name by variables that no command of the session ever sets.

    The path is the one in the text (``$HOME_DIR/x.sh``): such a variable has one value all along, so the same words mean
    the same file. Words with a variable that is set somewhere are left out, before and after that.
    """
    commands = _commands(actions)
    named = commands.filter(F.contains("command", F.lit("$"))).select("sid", "idx", F.inline(paths_by_variables(F.col("command"), F.col("env"))))
    named = named.select("sid", "idx", "path", (F.col("direction") == "write").alias("is_write"), F.explode("names").alias("name"))
    own = _assigning(commands).select("sid", F.explode(variables_set(F.col("command"))).alias("v")).select("sid", F.col("v.name").alias("name")).distinct()
    told = named.join(own.withColumn("own", F.lit(True)), ["sid", "name"], "left")
    return told.groupBy("sid", "idx", "path", "is_write").agg(F.max("own").alias("own")).filter("own is null").drop("own")


def all_touches(actions: DataFrame) -> DataFrame:
    """(sid, idx, path, is_write, confidence): what commands touch by their text, by their own output, and (weak) by
    variables that nothing sets; each once, with its highest confidence."""
    sure = command_touches(actions)
    if "response" in actions.columns:
        sure = sure.unionByName(resolved_touches(actions))
    both = sure.withColumn("confidence", F.lit("likely")).unionByName(weak_touches(actions).withColumn("confidence", F.lit("weak")))
    return both.groupBy("sid", "idx", "path", "is_write").agg(F.min("confidence").alias("confidence"))  # likely before weak


def _open_words(actions: DataFrame) -> DataFrame:
    """(sid, idx, word, direction, head, ending) of what commands leave open, known variables put in."""
    return _commands(actions).filter(F.col("command").rlike(r"[$*?`]")).select("sid", "idx", F.inline(words_left_open(F.col("command"), F.col("env"))))


def _outputs(actions: DataFrame) -> DataFrame:
    """(sid, idx, said): what commands put out, read from their records unless a table has it already."""
    if "_said" in actions.columns:
        return actions.filter(F.trim("_said") != "").select("sid", "idx", F.col("_said").alias("said"))
    return actions.filter(filled("response").isNotNull()).select("sid", "idx", said_by_tool(F.col("response")).alias("said"))


def _paths_of_outputs(actions: DataFrame) -> DataFrame:
    """(sid, idx, path): the files (by their ending) that the outputs of commands state, in normal form."""
    said = _outputs(actions).select("sid", "idx", F.explode(paths_said(F.col("said"))).alias("path"))
    return said.filter(F.col("path").rlike(rf"(?i)\.(?:{'|'.join(ENDINGS)})$")).select("sid", "idx", normal_path("path").alias("path")).distinct()


def resolved_touches(actions: DataFrame) -> DataFrame:
    """(sid, idx, path, is_write): files that a command leaves open and its own output (``response``) tells.

    Of the paths that an output states those count that begin and end like the word; a word is resolved if that is one
    path. The direction is that of the word in the command.
    """
    said = _paths_of_outputs(actions)
    met = _open_words(actions).filter("direction is not null").join(said, ["sid", "idx"]).filter(F.startswith("path", F.col("head")) & F.endswith("path", F.col("ending")))
    sole = met.groupBy("sid", "idx", "word", "direction").agg(F.min("path").alias("path"), F.count_distinct("path").alias("n")).filter("n = 1")
    return sole.select("sid", "idx", "path", (F.col("direction") == "write").alias("is_write")).distinct()


def unresolved_words(actions: DataFrame) -> DataFrame:
    """(sid, idx, word): words that name a file and that neither the command nor its output resolves."""
    left = _open_words(actions).filter(F.col("word").rlike(r"\.\w+[\"'`,()]*$"))
    met = left.join(_paths_of_outputs(actions), ["sid", "idx"], "left").withColumn("path", F.when(F.col("direction").isNotNull() & F.startswith("path", F.col("head")) & F.endswith("path", F.col("ending")), F.col("path")))
    return met.groupBy("sid", "idx", "word").agg(F.count_distinct("path").alias("n")).filter("n <> 1").select("sid", "idx", "word")


def pid_statements(actions: DataFrame) -> DataFrame:
    """(sid, idx, pid): outputs that state the id of a process."""
    return _outputs(actions).select("sid", "idx", F.explode(pids_said(F.col("said"))).alias("pid"))


def pids(actions: DataFrame) -> DataFrame:
    """(sid, pid, born_idx): processes by the output that first states them."""
    return pid_statements(actions).groupBy("sid", "pid").agg(F.min("idx").alias("born_idx"))


def with_commands(touched: DataFrame, by_command: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of the whole graph: what tools touch, then what commands do.

    ``by_command`` has (sid, idx, path, is_write) and maybe confidence. Commands go on with the counter of versions that
    the tools have left, so the number of a version does not follow time. What a command sees is the highest version that
    was born before it: one running maximum over births and reads of a key in their order, so a file that is read very
    often takes time in proportion. A command that reads what no tool ever makes, before any command makes it, sees
    version 0; one that reads before a tool makes the file sees nothing.
    """
    tools = entities(touched)
    own = by_command if "confidence" in by_command.columns else by_command.withColumn("confidence", F.lit("likely"))
    own = own.groupBy("sid", "idx", F.col("path").alias("key"), "is_write").agg(F.min("confidence").alias("confidence"))
    top = tools.groupBy("sid", "key").agg(F.max("version").alias("top"))
    rank = F.row_number().over(Window.partitionBy("sid", "key").orderBy("idx"))
    made = own.filter("is_write").withColumn("n", rank).join(top, ["sid", "key"], "left")
    made = made.select("sid", "key", (F.coalesce("top", F.lit(0)) + F.col("n")).cast("long").alias("version"), F.col("idx").alias("producer_idx"), F.col("idx").alias("born_idx"), "confidence")
    born = tools.unionByName(made.drop("confidence"))

    nothing = F.lit(None)
    births = tools.withColumn("by_tool", F.lit(True)).unionByName(made.drop("confidence").withColumn("by_tool", F.lit(False)))
    births = births.select("sid", "key", F.col("born_idx").alias("idx"), "version", "by_tool", nothing.cast("string").alias("confidence"))
    reads = own.filter("not is_write").select("sid", "key", "idx", nothing.cast("long").alias("version"), F.lit(False).alias("by_tool"), "confidence")
    of_key = Window.partitionBy("sid", "key")
    before = of_key.orderBy("idx").rangeBetween(Window.unboundedPreceding, -1)
    seen = births.unionByName(reads).withColumns({"seen": F.max("version").over(before), "known": F.max("by_tool").over(of_key)}).filter("confidence is not null")
    seen = seen.filter("seen is not null or not known").select("sid", "idx", "key", F.coalesce("seen", F.lit(0)).cast("long").alias("version"), "confidence")
    zero = seen.filter("version = 0").select("sid", "key", "version").distinct().join(tools.filter("version = 0"), ["sid", "key", "version"], "left_anti")
    zero = zero.select("sid", "key", "version", F.lit(None).cast("int").alias("producer_idx"), F.lit(-1).alias("born_idx"))
    links = made.select("sid", F.col("producer_idx").alias("idx"), "key", "version", F.lit("generatedBy").alias("kind"), "confidence")
    links = links.unionByName(seen.select("sid", "idx", "key", "version", F.lit("usedBy").alias("kind"), "confidence"))
    return born.unionByName(zero), edges(touched).unionByName(links)


def host_edges(actions: DataFrame) -> DataFrame:
    """(sid, idx, key): machines and containers that commands reach."""
    return actions.filter(filled("command").isNotNull()).select("sid", "idx", F.explode(hosts(F.col("command"))).alias("key"))


def pid_mentions(pids: DataFrame, commands: DataFrame) -> DataFrame:
    """(sid, pid, idx): later commands that name a process (sid, pid, born_idx), as a number of its own."""
    numbers = F.array_distinct(F.regexp_extract_all("command", F.lit(r"(?<!\d)(\d{3,})(?!\d)"), 1))
    named = commands.select("sid", "idx", F.explode(numbers).alias("_pid"))
    met = pids.withColumn("_pid", F.col("pid").cast("string")).join(named, ["sid", "_pid"]).filter(F.col("born_idx") < F.col("idx"))
    return met.select("sid", "pid", "idx")


def provenance(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of everything that actions touch: files by tools and by commands, hosts and processes.

    Entities are (sid, key, version, producer_idx, born_idx, entity: file, host or pid). Edges are generatedBy, usedBy and,
    for hosts, connectedBy, each with its confidence: certain from tools, likely from commands and their outputs, weak
    where a path has a variable without a value. Hosts have version 0, processes version 1; a process is made by every
    command whose output states it, and used by later ones that name it.
    """
    # what is looked at several times is written: sessions put in order, commands read and records parsed once
    own = written(_own_commands(actions).withColumn("_said", said_by_tool(F.col("response"))).drop("response"))
    commands = written(_with_values(own).withColumn("response", F.col("_said")))
    files, links = with_commands(written(touches(actions)), written(all_touches(commands)))
    entity_of = lambda df, kind: df.withColumn("entity", F.lit(kind))
    likely = lambda df, version, kind: df.select("sid", "idx", "key", F.lit(version).cast("long").alias("version"), F.lit(kind).alias("kind"), F.lit("likely").alias("confidence"))
    reached = host_edges(commands)
    machines = reached.select("sid", "key").distinct().select("sid", "key", F.lit(0).cast("long").alias("version"), F.lit(None).cast("int").alias("producer_idx"), F.lit(-1).alias("born_idx"))
    all_entities, all_edges = entity_of(files, "file").unionByName(entity_of(machines, "host")), links.unionByName(likely(reached, 0, "connectedBy"))
    if "response" not in actions.columns:
        return all_entities, all_edges
    stated = pid_statements(commands)
    born = stated.groupBy("sid", "pid").agg(F.min("idx").alias("born_idx"))
    processes = born.select("sid", F.col("pid").alias("key"), F.lit(1).cast("long").alias("version"), F.col("born_idx").alias("producer_idx"), "born_idx")
    named = pid_mentions(born, commands).withColumnRenamed("pid", "key")
    all_edges = all_edges.unionByName(likely(stated.withColumnRenamed("pid", "key"), 1, "generatedBy")).unionByName(likely(named, 1, "usedBy"))
    return all_entities.unionByName(entity_of(processes, "pid")), all_edges


def probes(actions: DataFrame) -> DataFrame:
    """(sid, idx, action, pattern, path, root) of actions that search or list: what they look for and where.

    They touch nothing, so they have no edges; a root that says no more than the path is left out.
    """
    own = {c: filled(c) if c in actions.columns else F.lit(None).cast("string") for c in ("pattern", "path", "root")}
    own["root"] = F.when(~own["root"].eqNullSafe(own["path"]), own["root"])
    found = actions.filter(F.col("action").isin(*PROBES)).select("sid", "idx", "action", *(c.alias(n) for n, c in own.items()))
    return found.filter("pattern is not null or path is not null or root is not null")


def probed_artifacts(probes: DataFrame, all_entities: DataFrame) -> DataFrame:
    """(sid, idx, key): artifacts at or below the place where an action searches.

    A key meets searches by each of the folders above it, so this is an equal join whose rows grow with the depth of paths
    and not with all keys of a session.
    """
    where = F.regexp_replace(F.coalesce("path", "root"), "(?<=.)/+$", "")
    keys = all_entities.select("sid", "key").distinct().filter(F.startswith("key", F.lit("/")))
    parts = F.split("key", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    return probes.select("sid", "idx", where.alias("_at")).filter("_at is not null").join(keys.select("sid", "key", F.explode(above).alias("_at")), ["sid", "_at"]).select("sid", "idx", "key")
