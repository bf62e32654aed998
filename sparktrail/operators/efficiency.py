"""Was the budget well spent: cost by segment, repeated work, wasted reads, rewrites, failures and grades.

Tables: actions (sid, idx, turn, action, path, command, purpose, reasoning, error, blocked, ...), turns (sid, turn,
dur_s, credits, cycles, llm_reqs, ctx_pct), sessions (sid, created_at, updated_at), segments (sid, seg, start, stop),
vectors (sid, idx, dim, vector). Windows and groups are all by session, so one shuffle on ``sid`` serves them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparktrail.functions.text import basename, blank, filled
from sparktrail.functions.vocabulary import WRITES_EFFICIENCY
from sparktrail.operators.links import connected, written

# Thresholds of the duplicate vote, wasted reads, stuck turns and failure groups.
VOTE = {"command_strong": 0.90, "purpose_strong": 0.85, "reasoning_strong": 0.85, "combined_min": 0.80}
READ_WINDOW, READ_NAME, READ_ALIKE = 20, 5, 0.60
STUCK_CYCLES, FAILURES = 20, 3


def segment_of(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """``rows`` with the segment whose turns hold theirs; rows in none are left out."""
    bounds = segments.select(F.col("sid").alias("_sid"), "seg", "start", "stop")
    within = (F.col("sid") == F.col("_sid")) & F.col("turn").between(F.col("start"), F.col("stop"))
    return rows.drop("seg").join(bounds, within).drop("_sid", "start", "stop")


def totals(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sums by session, wall time and the share of it that no turn took."""
    sums = turns.groupBy("sid").agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(n) for c, n in (("dur_s", "net_s"), ("credits", "credits"), ("llm_reqs", "llm_reqs"), ("cycles", "cycles"))))
    wall = (F.unix_micros("updated_at") - F.unix_micros("created_at")) / 1e6
    out = sessions.select("sid", wall.alias("wall_s")).join(sums, "sid", "left")
    return out.withColumn("idle_pct", F.when(F.col("wall_s") > 0, F.round((1 - F.try_divide("net_s", "wall_s")) * 100, 1)))


def segment_cost(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """Cost of each segment, and its means by turn (0 for a segment without turns)."""
    cost = segment_of(turns, segments).groupBy("sid", "seg").agg(
        F.count("*").alias("n_turns"),
        *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("dur_s", "credits", "cycles", "llm_reqs")),
        F.max("ctx_pct").alias("ctx_pct_max"),
    )
    out = segments.select("sid", "seg", "start", "stop").join(cost, ["sid", "seg"], "left").fillna(0, subset=["n_turns", "dur_s", "credits", "cycles", "llm_reqs", "ctx_pct_max"])
    mean = lambda c: F.coalesce(F.try_divide(c, "n_turns"), F.lit(0.0))
    return out.withColumns({"credits_per_turn": mean("credits"), "cycles_per_turn": mean("cycles")})


def top_turns(turns: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The ``n`` turns of each session that cost most, the earlier first where equal."""
    rank = F.row_number().over(Window.partitionBy("sid").orderBy(F.col(by).desc_nulls_last(), "turn"))
    return turns.withColumn("rank", rank).filter(F.col("rank") <= n)


def worst_turn(turns: DataFrame) -> DataFrame:
    """The costliest turn of each session and its share of the credits in per cent."""
    worst = F.max_by(F.struct("turn", "credits"), F.struct("credits", -F.col("turn")))
    out = turns.groupBy("sid").agg(worst.alias("w"), F.sum("credits").alias("total"))
    return out.select("sid", "w.turn", "w.credits", F.when(F.col("total") > 0, F.round(F.col("w.credits") / F.col("total") * 100, 2)).alias("share_pct"))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def vote(command: Column, purpose: Column, reasoning: Column, bars: dict = VOTE) -> Column:
    """Why two actions count as duplicates, by their similarities (null: not to be told); null if they don't."""
    c, p, r = (F.coalesce(x, F.lit(0.0)) for x in (command, purpose, reasoning))
    both = bars["combined_min"]
    return (
        F.when(c > bars["command_strong"], "command_strong")
        .when(p > bars["purpose_strong"], "purpose_strong")
        .when(r > bars["reasoning_strong"], "reasoning_strong")
        .when((p > both) & (r > both), "combined_pr")
        .when((c > both) & (p > both), "combined_cp")
    )


def siblings(thinkings: DataFrame) -> DataFrame:
    """(sid, idx1, idx2) of actions that one thought led to, from (sid, action_idx array)."""
    some = thinkings.filter(F.size("action_idx") >= 2).withColumn("a", F.explode("action_idx"))
    return some.select("sid", F.col("a").alias("idx1"), F.explode("action_idx").alias("idx2")).filter("idx1 < idx2").distinct()


#: Commands of a segment that one side of a matrix product holds, and that one side of a task holds where pairs are asked
#: for: a command goes to as many tasks as its segment has such sides.
CHUNK, TILE = 1024, 2048
#: Pairs that a task looks at before it gives out what it has found.
CELLS = CHUNK * CHUNK
_DIMS = ("command", "purpose", "reasoning")


_WHY = ("", "command_strong", "purpose_strong", "reasoning_strong", "combined_pr", "combined_cp")


def _tiles(rows: DataFrame, by: str, tile: int) -> DataFrame:
    """``rows`` (sid, seg, ...) dealt out to pairs of parts (ca, cb) of their segment, parts of about ``tile`` rows; ``left``
    and ``right`` tell of which sides a row is, ``whole`` whether the segment is one part."""
    sizes = rows.groupBy("sid", "seg").agg(F.ceil(F.count("*") / tile).alias("parts"))
    own = rows.join(sizes, ["sid", "seg"]).withColumn("me", F.pmod(F.xxhash64(by), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    sides = {"ca": F.least("me", "other"), "cb": F.greatest("me", "other"), "left": F.col("me") <= F.col("other"), "right": F.col("me") >= F.col("other"), "whole": F.col("parts") == 1}
    return own.withColumns(sides).drop("parts", "me", "other")


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole tasks (sid, seg, ca, cb), as they come in order, with where each task begins and the last one ends.

    Many small segments make one slab, so what is done once for a slab costs little for each; a task of ``CELLS`` pairs
    and more is a slab of its own.
    """

    def cut(rows: pa.Table, at: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
        first, cells = 0, 0
        for i, n in enumerate(np.diff(at).tolist()):
            if cells and cells + n * n > CELLS:
                yield rows.slice(at[first], at[i] - at[first]), at[first : i + 1] - at[first]
                first, cells = i, 0
            cells += n * n
        yield rows.slice(at[first], at[-1] - at[first]), at[first:] - at[first]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.Table.from_batches([*held, batch])
        other = np.zeros(max(rows.num_rows - 1, 0), bool)
        for c in ("sid", "seg", "ca", "cb"):
            other |= pc.not_equal(rows[c].slice(1), rows[c].slice(0, len(other))).to_numpy().astype(bool)
        at = np.concatenate(([0], np.flatnonzero(other) + 1))
        if len(at) > 1:
            yield from cut(rows.slice(0, at[-1]).combine_chunks(), at)
        held = rows.slice(at[-1]).to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, np.array([0, rows.num_rows])


def _units(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of length one (zeros for none), and how many components each has."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    out[np.arange(out.shape[1]) < sizes[:, None]] = pc.list_flatten(vectors).to_numpy()
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1), sizes


def _votes(left: list[np.ndarray], right: list[np.ndarray], bars: dict) -> np.ndarray:
    """The number of the reason (in _WHY) why each row of one side and each of the other count as duplicates; 0 for none."""
    return _reasons(*(x @ y.T for x, y in zip(left, right, strict=True)), bars)


def _reasons(c: np.ndarray, p: np.ndarray, r: np.ndarray, bars: dict) -> np.ndarray:
    both = bars["combined_min"]
    ways = [c > bars["command_strong"], p > bars["purpose_strong"], r > bars["reasoning_strong"], (p > both) & (r > both), (c > both) & (p > both)]
    return np.select(ways, [np.int8(n) for n in range(1, 6)], np.int8(0))


def _links(rows: pa.Table, at: np.ndarray, number: np.ndarray, bars: dict, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, rows, reasons): the pairs of each task of a slab that count as duplicates, product by product. Within a part
    a pair begins with the smaller ``number``."""
    units = [_units(rows[d]) for d in _DIMS]
    for _, sizes in units:
        for x, y in zip(at[:-1], at[1:], strict=True) if len(np.unique(sizes[sizes > 0])) > 1 else ():
            if len(np.unique(own := sizes[x:y][sizes[x:y] > 0])) > 1:
                raise ValueError(f"vectors of one segment have {own.min()} and {own.max()} components")
    left, right = (rows[c].to_numpy().astype(bool) for c in ("left", "right"))
    for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        one, two = x + np.flatnonzero(left[x:y]), x + np.flatnonzero(right[x:y])
        within = bool(left[x] and right[x])
        for i in range(0, len(one), chunk):
            for j in range(0, len(two), chunk):
                a, b = one[i : i + chunk], two[j : j + chunk]
                why = _votes([u[a] for u, _ in units], [u[b] for u, _ in units], bars)
                if within:
                    why *= number[a][:, None] < number[b]
                m, n = np.nonzero(why)
                yield a[m], b[n], why[m, n]


def _in_tasks(tasks: DataFrame, by: str, found: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """What ``found`` makes of the slabs of tasks, their rows in the order of ``by``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in _slabs(batches):
            yield from found(rows, at)

    key = ["sid", "seg", "ca", "cb"]
    return tasks.repartition(*key).sortWithinPartitions(*key, by).mapInArrow(run, schema)


def _table(schema: T.StructType, columns: list) -> pa.RecordBatch:
    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c)).cast(f.type) for c, f in zip(columns, kinds, strict=True)], kinds.names)


def _similar(bars: dict, chunk: int, schema: T.StructType) -> Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]:
    """Pairs of a slab's commands with the reason why they count as duplicates."""

    def similar(rows: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        idx = rows["idx"].to_numpy()

        def told(some: list[tuple]) -> pa.RecordBatch:
            i, j, why = (np.concatenate(part) for part in zip(*some, strict=True))
            return _table(schema, [rows["sid"].take(pa.array(i)), rows["seg"].take(pa.array(i)), np.minimum(idx[i], idx[j]), np.maximum(idx[i], idx[j]), pa.array(_WHY).take(pa.array(why))])

        some: list[tuple] = []
        for links in _links(rows, at, idx, bars, chunk):
            some.append(links)
            if sum(len(i) for i, _, _ in some) >= CHUNK * 64:
                yield told(some)
                some = []
        if some:
            yield told(some)

    return similar


def duplicate_pairs(commands: DataFrame, vectors: DataFrame, sibling_pairs: DataFrame | None = None, bars: dict = VOTE, chunk: int = CHUNK) -> DataFrame:
    """(sid, seg, idx1, idx2, reason): pairs of commands of one segment that do the same.

    ``commands`` has (sid, seg, idx). The vectors of a command are gathered once; then parts of a segment meet, so that no
    task holds more than two of them, however long a segment is, and are compared as matrix products of ``chunk`` rows.
    """
    by_dim = vectors.groupBy("sid", "idx").pivot("dim", list(_DIMS)).agg(F.first("vector"))
    own = commands.select("sid", "seg", "idx").join(by_dim, ["sid", "idx"])
    tasks = _tiles(own, "idx", max(chunk, TILE)).select("sid", "seg", "ca", "cb", "idx", *_DIMS, "left", "right")
    kinds = {f.name: f.dataType for f in commands.schema.fields}
    schema = T.StructType([T.StructField(n, kinds[k]) for n, k in (("sid", "sid"), ("seg", "seg"), ("idx1", "idx"), ("idx2", "idx"))] + [T.StructField("reason", T.StringType())])
    out = _in_tasks(tasks, "idx", _similar(bars, chunk, schema), schema)
    return out if sibling_pairs is None else out.join(sibling_pairs, ["sid", "idx1", "idx2"], "left_anti").select(*schema.names)


def _grouped(bars: dict, chunk: int, schema: T.StructType) -> Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]:
    """Links of a slab's classes: for each class an edge to the first of its group, and for each class and reason the
    pairs of members that count as duplicates, with the first of them."""

    def grouped(rows: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        rep, n, second, left, right = (rows[c].to_numpy() for c in ("rep", "n", "second", "left", "right"))
        none = np.zeros(0, np.int64)
        i, j, why = (np.concatenate(part) for part in zip((none, none, none), *_links(rows, at, rep, bars, chunk), strict=True))
        alone = pc.list_parent_indices(rows["apart"]).to_numpy()
        if len(alone):
            kept = ~pd.MultiIndex.from_arrays([i, rep[j]]).isin(pd.MultiIndex.from_arrays([alone, pc.list_flatten(rows["apart"]).to_numpy()]))
            i, j, why = i[kept], j[kept], why[kept]
        both = pd.DataFrame({"row": i, "why": why, "n": n[i] * n[j], "a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j])})
        counts = [both.sort_values(["a", "b"]).groupby(["row", "why"], as_index=False).agg(n=("n", "sum"), a=("a", "first"), b=("b", "first"))]
        many = np.flatnonzero((n > 1) & left.astype(bool) & right.astype(bool))  # members of one class with each other
        if len(many):
            c, p, r = (np.einsum("ij,ij->i", u, u) for u, _ in (_units(rows[d].take(pa.array(many))) for d in _DIMS))
            own = _reasons(c, p, r, bars)
            many, own = many[own > 0], own[own > 0]
            counts.append(pd.DataFrame({"row": many, "why": own, "n": n[many] * (n[many] - 1) // 2, "a": rep[many], "b": second[many]}))
        counts = pd.concat(counts)
        heads = _heads(i, j)
        edges = pd.DataFrame({"row": list(heads)}, dtype=np.int64)
        out = pd.concat([counts, edges.assign(why=0, n=0, a=0, b=0)])
        of = out["row"].to_numpy(np.int64)
        to = np.array([heads.get(row, row) for row in of.tolist()], np.int64)
        take = pa.array(of)
        yield _table(schema, [rows["sid"].take(take), rows["seg"].take(take), rows["whole"].take(take), rep[of], rep[to], pa.array(_WHY).take(pa.array(out["why"].to_numpy(np.int64))), *(out[c].to_numpy(np.int64) for c in ("n", "a", "b"))])

    return grouped


def _heads(one: np.ndarray, two: np.ndarray) -> dict[int, int]:
    """For each vertex of some links the smallest one it can reach over them."""
    names, at = np.unique(np.concatenate((one, two)), return_inverse=True)
    x, y, head = at[: len(one)], at[len(one) :], np.arange(len(names))
    while len(x):
        before = head.copy()
        np.minimum.at(head, x, head[y])
        np.minimum.at(head, y, head[x])
        head = head[head]
        if (head == before).all():
            break
    return dict(zip(names.tolist(), names[head].tolist(), strict=True))


def _clusters(classes: DataFrame, bars: dict, chunk: int) -> DataFrame:
    """Clusters from classes of equal commands (sid, seg, rep, n, second, members, apart, a vector for each dimension)."""
    classes = written(classes)
    tasks = _tiles(classes.drop("members"), "rep", chunk).select("sid", "seg", "ca", "cb", "rep", "n", "second", "apart", *_DIMS, "left", "right", "whole")
    kinds = {f.name: f.dataType for f in classes.schema.fields}
    schema = T.StructType([T.StructField("sid", kinds["sid"]), T.StructField("seg", kinds["seg"]), T.StructField("whole", T.BooleanType()), T.StructField("rep", T.LongType()), T.StructField("to", T.LongType()), T.StructField("reason", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n", "a", "b"))])
    found = written(_in_tasks(tasks, "rep", _grouped(bars, chunk, schema), schema))
    node = lambda c: F.struct("sid", "seg", F.col(c).alias("rep"))
    # what one task has seen whole is final; only groups of segments in several parts are joined further
    final = found.filter("whole").withColumns({"id": node("rep"), "component": node("to")})
    parts = found.filter("not whole").withColumn("id", node("rep"))
    linked = final.select("id", "component", "reason", "n", "a", "b")
    if not parts.isEmpty():
        further = connected(parts.select(F.col("id").alias("a"), node("to").alias("b")))
        linked = linked.unionByName(parts.join(further, "id").select(*linked.columns))
    groups = linked.select("id", "component").distinct()
    counted = linked.filter("n > 0").groupBy("component", "reason").agg(F.sum("n").alias("n"), F.min(F.struct("a", "b")).alias("first"))
    top = Window.partitionBy("component").orderBy(F.col("n").desc(), "first")
    dominant = counted.withColumn("r", F.row_number().over(top)).filter("r = 1").select("component", F.col("reason").alias("dominant_reason"))
    members = classes.select(node("rep").alias("id"), "members").join(groups, "id").groupBy("component").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("members"))
    return members.join(dominant, "component").select("component.sid", "component.seg", "members", "dominant_reason")


def _classes(commands: DataFrame, key: list[Column], sibling_pairs: DataFrame | None) -> DataFrame:
    """Commands (sid, seg, idx) with equal keys as one class; those with siblings are classes of their own."""
    own = commands
    if sibling_pairs is not None:
        both = sibling_pairs.select("sid", F.col("idx1").alias("idx"), F.col("idx2").alias("of")).unionByName(sibling_pairs.select("sid", F.col("idx2").alias("idx"), F.col("idx1").alias("of")))
        own = own.join(both.groupBy("sid", "idx").agg(F.collect_set(F.col("of").cast("long")).alias("apart")), ["sid", "idx"], "left")
    else:
        own = own.withColumn("apart", F.lit(None).cast("array<long>"))
    own = own.withColumn("key", F.struct(*key, F.when(F.col("apart").isNotNull(), F.col("idx")).alias("alone")))
    kept = [F.first(c).alias(c) for c in own.columns if c not in ("sid", "seg", "idx", "key", "apart")]
    out = own.groupBy("sid", "seg", "key").agg(F.min("idx").cast("long").alias("rep"), F.count("*").alias("n"), F.array_sort(F.collect_list("idx")).alias("members"), F.first("apart").alias("apart"), *kept)
    return out.withColumn("second", F.coalesce(F.get("members", F.lit(1)).cast("long"), F.col("rep"))).drop("key")


def duplicate_clusters(commands: DataFrame, vectors: DataFrame, sibling_pairs: DataFrame | None = None, bars: dict = VOTE, chunk: int = CHUNK) -> DataFrame:
    """(sid, seg, members, dominant_reason): groups of commands (sid, seg, idx) of a segment linked as duplicates by their
    vectors (sid, idx, dim, vector). The reason of most pairs is dominant; among equals the one of the first pair.

    Commands with equal vectors are one class, and two chunks of classes give one edge for each class and one count for
    each class and reason, so a segment of equal commands takes time and room in proportion; pairs are never written.
    """
    by_dim = vectors.groupBy("sid", "idx").pivot("dim", list(_DIMS)).agg(F.first("vector"))
    own = commands.select("sid", "seg", "idx").join(by_dim, ["sid", "idx"])
    key = [F.xxhash64(F.lit(salt), F.col(d)).alias(f"{d}{salt}") for d in _DIMS for salt in (0, 1)]  # 128 bits a vector
    return _clusters(_classes(own, key, sibling_pairs), bars, chunk)


def duplicate_text_clusters(commands: DataFrame, texts: DataFrame, vectors: DataFrame, sibling_pairs: DataFrame | None = None, bars: dict = VOTE, chunk: int = CHUNK) -> DataFrame:
    """As duplicate_clusters, from texts (sid, idx, dim, sha1) and a vector for each (dim, sha1): commands of equal texts
    are one class before any vector is looked up."""
    by_dim = texts.groupBy("sid", "idx").pivot("dim", list(_DIMS)).agg(F.first("sha1"))
    classes = _classes(commands.select("sid", "seg", "idx").join(by_dim, ["sid", "idx"]), [F.col(d) for d in _DIMS], sibling_pairs)
    for d in _DIMS:
        of = vectors.filter(F.col("dim") == d).select(F.col("sha1").alias(d), F.col("vector").alias("_v"))
        classes = classes.join(of, d, "left").drop(d).withColumnRenamed("_v", d)
    return _clusters(classes, bars, chunk)


def wasted_reads(actions: DataFrame, vectors: DataFrame | None = None, window: int = READ_WINDOW, least: int = READ_NAME, alike: float = READ_ALIKE) -> DataFrame:
    """(sid, seg, idx, path, max_sim) of reads whose file no later action of the next ``window`` names or resembles."""
    said = F.concat_ws(" ", blank("command"), blank("path"), blank("purpose"), blank("reasoning"))
    ahead = Window.partitionBy("sid").orderBy("idx").rowsBetween(1, window)
    seen = actions.withColumn("_said", F.collect_list(said).over(ahead)).withColumn("_next", F.collect_list("idx").over(ahead))
    name = basename("path")
    reads = seen.filter((F.col("action") == "read_file") & filled("path").isNotNull() & (F.length(name) >= least))
    left = reads.filter(~F.exists("_said", lambda t: F.contains(t, name)))
    if vectors is None:
        return left.select("sid", "seg", "idx", "path", F.lit(0.0).alias("max_sim"))
    own = vectors.filter("dim = 'response'").select("sid", "idx", F.col("vector").alias("_own"))
    other = vectors.filter(F.col("dim").isin("command", "purpose", "reasoning")).select("sid", F.col("idx").alias("_later"), F.col("vector").alias("_theirs"))
    later = left.select("sid", "idx", F.explode("_next").alias("_later")).join(own, ["sid", "idx"]).join(other, ["sid", "_later"])
    best = later.groupBy("sid", "idx").agg(F.max(cosine("_own", "_theirs")).alias("max_sim"))
    out = left.join(best, ["sid", "idx"], "left").withColumn("max_sim", F.greatest(F.coalesce("max_sim", F.lit(0.0)), F.lit(0.0)))
    return out.filter(F.col("max_sim") <= alike).select("sid", "seg", "idx", "path", "max_sim")


def read_counts(actions: DataFrame) -> DataFrame:
    """(sid, seg, n_reads): all reads with a path, short names included."""
    return actions.filter((F.col("action") == "read_file") & filled("path").isNotNull()).groupBy("sid", "seg").agg(F.count("*").alias("n_reads"))


def multi_writes(actions: DataFrame) -> DataFrame:
    """Paths written more than once in a segment: how often, over how many turns, and where."""
    writes = actions.filter(F.col("action").isin(*WRITES_EFFICIENCY) & filled("path").isNotNull())
    out = writes.groupBy("sid", "seg", "path").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.array_sort(F.collect_list("idx")).alias("at")).filter("n >= 2")
    span = F.col("last_turn") - F.col("first_turn") + 1
    return out.withColumns({"turn_span": span, "density": F.col("n") / span, "is_single_turn": F.col("first_turn") == F.col("last_turn")})


def failure_groups(actions: DataFrame, least: int = FAILURES) -> DataFrame:
    """(sid, seg, first_idx, last_idx, n): runs of at least ``least`` failed or blocked actions within a segment."""
    failed = F.coalesce(F.col("blocked"), F.lit(False)) | filled("error").isNotNull()
    order = Window.partitionBy("sid", "seg").orderBy("idx")
    both = actions.withColumn("_f", failed).withColumn("_pos", F.row_number().over(order))
    fails = both.filter("_f").withColumn("_run", F.col("_pos") - F.row_number().over(order))
    return fails.groupBy("sid", "seg", "_run").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("_run")


def stuck_turns(turns: DataFrame, segments: DataFrame, cycles: int = STUCK_CYCLES) -> DataFrame:
    """Turns of more than ``cycles`` cycles, with their segment."""
    return segment_of(turns.filter(F.col("cycles") > cycles), segments)


def grades(segments: DataFrame, turns: DataFrame, clusters: DataFrame, rewrites: DataFrame, stuck: DataFrame, failures: DataFrame) -> DataFrame:
    """(sid, seg, grade) from A to D by the evidence of each segment."""
    key = ["sid", "seg"]
    share = F.try_divide(F.col("credits"), F.sum("credits").over(Window.partitionBy("sid")))
    parts = [
        segment_of(turns.withColumn("share", share), segments).groupBy(*key).agg(F.max("share").alias("share")),
        clusters.groupBy(*key).agg(F.count_if(F.size("members") >= 3).alias("clusters")),
        rewrites.groupBy(*key).agg(F.count_if(F.col("is_single_turn") & (F.col("n") >= 3)).alias("thrash"), F.count_if(F.col("n") >= 5).alias("heavy")),
        stuck.groupBy(*key).agg(F.count("*").alias("stuck")),
        failures.groupBy(*key).agg(F.count("*").alias("fails")),
    ]
    out = segments.select(*key)
    for part in parts:
        out = out.join(part, key, "left")
    out = out.fillna(0)
    c = F.col
    grade = (
        F.when((c("share") >= 0.25) | (c("thrash") >= 1) | (c("fails") >= 1) | (c("heavy") >= 2), "D")
        .when((c("share") >= 0.15) | (c("clusters") >= 2) | (c("heavy") >= 1) | (c("stuck") >= 2), "C")
        .when((c("share") >= 0.10) | (c("clusters") >= 1) | (c("stuck") >= 1), "B")
        .otherwise("A")
    )
    return out.withColumn("grade", grade)


def session_grade(graded: DataFrame) -> DataFrame:
    """(sid, grade): the worst of a session's segments."""
    return graded.groupBy("sid").agg(F.max("grade").alias("grade"))


def report(turns: DataFrame, segments: DataFrame, graded: DataFrame, rewrites: DataFrame, failures: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(sid, report): one JSON document for each session, with its duplicate work if ``clusters`` are given."""
    cost = segment_cost(turns, segments).join(graded.select("sid", "seg", "grade"), ["sid", "seg"], "left")
    rows = lambda df, name, *fields: df.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    out = rows(cost, "segments", "seg", "grade", "n_turns", "dur_s", "credits", "cycles", "llm_reqs")
    out = out.join(rows(rewrites, "multi_write", "seg", "path", "n", "density"), "sid", "left").join(rows(failures, "failures", "seg", "first_idx", "n"), "sid", "left")
    out = out.join(worst_turn(turns).select("sid", F.struct("turn", "credits", "share_pct").alias("worst_turn")), "sid", "left").join(session_grade(graded), "sid", "left")
    fields = ["grade", "segments", "multi_write", "failures", "worst_turn"]
    if clusters is not None:
        out, fields = out.join(rows(clusters, "duplicates", "seg", "members", "dominant_reason"), "sid", "left"), [*fields, "duplicates"]
    return out.select("sid", F.to_json(F.struct(*fields)).alias("report"))
