"""Operator 12: the prefix trie of conversations, with counts of each node's subtree.

A node of depth d is a distinct sequence of the first d turns (role, text); its members are the conversations that begin
with it, and the smallest of them owns it. A conversation that owns a node owns all its deeper ones, too, so what it owns
is a chain, from its first owned depth to its end, and the tree is a tree of chains.

1. Turns are dealt out by ranges of (conversation, turn) and numbered; of each only its place, a digest and what is
   counted of it are kept. A prefix is known by four sums of 32 bits of its turns' digests (each made with the turn's
   place), digested again to 128 bits. Sums are taken by blocks of places, so one very long conversation is spread, too.
2. One aggregation gives each prefix digest its minimum, the owner, and its number of members.
3. Each conversation's first owned depth is found by binary search: all conversations that are still open ask for the
   owner of the prefix in the middle of their bounds, in one join with the minima for each round, so the rounds grow with
   the logarithm of the longest conversation. The last owner that is another one is where the chain hangs (or, for a
   conversation without a depth of its own, where it ends).
4. Sums over subtrees: each chain sums its own nodes; chains then pass sums to those they hang on, by pointer doubling,
   in as many rounds as the logarithm of how deep chains are nested; each node at last gets the sum of its chain from it
   on, with all that hangs there.
5. The ids of conversations that end at a node are numbered in their order, joined by thousands, and one task runs
   through the joined pieces of a node, so that the digest of many ids needs neither their list nor a row for each.

No step gathers the conversations of a node in one task: what many share is counted by aggregations or joined with tables
written before, whose skewed side Spark splits. Every round is written.

Null role or text count as empty. Turns of a null number come first; turns of one number are in the order of their
digests. Rows without a conversation id are left out; repeated rows are turns each. A conversation without turns is a
member of the root alone. Without conversations there is no node. Very long texts are digested whole. Other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrail.llm.common import in_order, materialize, running_sums, small, table
from sparktrail.llm.resample import CRC_SQL, CRC_TABLE_SQL

#: Ids of conversations that are joined to one piece before a node's are digested.
ENDS = 4096
_LANES = [f"lane{i}" for i in range(4)]


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, sign, words): turns in the order of conversations, numbered over all of them."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sign = F.sha2(F.concat(F.octet_length(own(role)).cast("string"), F.lit(":"), own(role), own(text)), 256)
    words = F.regexp_count(own(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    narrow = conversations.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), sign.alias("sign"), words.alias("words"))
    return in_order(materialize(narrow, "turns"), [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("sign")], "at").drop("turn")


def branched(numbered: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """((conv, len), (conv, depth, sign, words)) of conversations whose first turns are those of another one.

    Conversation c begins with the first h turns of c - c % ``every`` (all, if it has fewer), h being the CRC-32 of c in
    decimal modulo ``most``; its own turns after its first h follow.
    """
    base = F.col("conv") - F.col("conv") % every
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = numbered.groupBy("conv").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    convs = materialize(convs.select("conv", "first", "n", base.alias("base"), h.alias("h")), "conversations")
    have = convs.select(F.col("conv").alias("base"), F.col("n").alias("there"))
    lent = F.least("h", F.coalesce("there", F.lit(0)))
    convs = convs.join(have, "base", "left").select("conv", "first", "base", "h", lent.alias("lent"), (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    convs = materialize(convs, "conversations")

    place = F.col("at") - F.col("first")
    placed = numbered.join(small(convs.select("conv", "first", "h", "lent")), "conv").select("conv", place.alias("place"), "h", "lent", "sign", "words")
    placed = materialize(placed, "placed")
    own = placed.filter("place >= h").select("conv", (F.col("lent") + F.col("place") - F.col("h") + 1).alias("depth"), "sign", "words")
    heads = placed.filter((F.col("conv") % every == 0) & (F.col("place") < most)).select(F.col("conv").alias("base"), "place", "sign", "words")
    given = convs.select("conv", "base", "h").join(heads, "base").filter("place < h").select("conv", (F.col("place") + 1).alias("depth"), "sign", "words")
    return convs.select("conv", "len"), own.unionByName(given)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv, depth, digest, words): every prefix of each conversation (conv, depth from 1 on, sign, words)."""
    signed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("sign")), 256)
    lane = lambda i: F.conv(F.substring("signed", 8 * i + 1, 8), 16, 10).cast("long")
    lanes = rebuilt.select("conv", "depth", "words", signed.alias("signed")).select("conv", "depth", "words", *(lane(i).alias(c) for i, c in enumerate(_LANES)))
    summed = running_sums(materialize(lanes, "lanes"), "conv", "depth", _LANES)
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(",", "depth", *_LANES), 256), 1, 32))
    return materialize(summed.select("conv", "depth", digest.alias("digest"), "words"), "prefixes")


def first_owned(convs: DataFrame, own: DataFrame, minima: DataFrame, root: int) -> DataFrame:
    """(conv, len, first, above): the first depth that a conversation owns (len + 1 if none), and the owner of its prefix
    one turn shorter (null for the root's owner)."""
    is_root = F.col("conv") == root
    start = convs.select("conv", "len", F.lit(0).cast("long").alias("low"), F.when(is_root, 0).otherwise(F.col("len") + 1).cast("long").alias("high"), F.when(~is_root, root).cast("long").alias("above"))
    state = materialize(start, "bounds")
    done = []
    while True:
        done.append(state.filter("high - low <= 1"))
        left = state.filter("high - low > 1").withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2))
        asked = materialize(left.join(own.select("conv", "depth", "digest"), ["conv", "depth"]), "asked")
        if asked.isEmpty():
            break
        told = asked.join(small(minima.select("depth", "digest", "owner")), ["depth", "digest"])
        mine = F.col("owner") == F.col("conv")
        state = told.select("conv", "len", F.when(mine, F.col("low")).otherwise(F.col("depth")).alias("low"), F.when(mine, F.col("depth")).otherwise(F.col("high")).alias("high"), F.when(mine, F.col("above")).otherwise(F.col("owner")).alias("above"))
        state = materialize(state, "bounds")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return materialize(out.select("conv", "len", F.col("high").alias("first"), "above"), "chains")


def subtree_sums(links: DataFrame, columns: list[str]) -> DataFrame:
    """``links`` (id, up, ``columns``) with each column summed over all that hang below a row; ids are unique.

    After round k a row has the sums of those less than 2^k below it and knows the one 2^k above it.
    """
    own = materialize(links.select("id", "up", *columns), "sums")
    while not own.filter("up is not null").isEmpty():
        given = own.filter("up is not null").groupBy("up").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
        given = small(materialize(given.withColumnRenamed("up", "_id"), "given"))
        above = own.filter("up is not null").select(F.col("id").alias("_up"), F.col("up").alias("_next"))
        added = own.join(given, F.col("id") == F.col("_id"), "left").select("id", "up", *((F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in columns))
        own = materialize(materialize(added, "added").join(small(above), F.col("up") == F.col("_up"), "left").select("id", F.col("_next").alias("up"), *columns), "sums")
    return own.select("id", *columns)


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of (node, depth, conv): the digest of the ids of each node in order, joined by commas."""
    numbered = in_order(materialize(ends, "ends"), [F.asc("node"), F.asc("depth"), F.asc("conv")], "at")
    piece = F.floor(F.col("at") / ENDS)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = materialize(numbered.groupBy("node", "depth", piece.alias("piece")).agg(joined.alias("ids")), "pieces")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == node:
                    state.update(b"," + ids.encode())
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], ["node", "depth", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["node", "depth", "ends_sha256"])

    dealt = pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "piece").select("node", "depth", "ids")
    return dealt.mapInArrow(digest, "node long, depth long, ends_sha256 string")


def trie(convs: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """One row per node of conversations (conv, len) with turns (conv, depth from 1 on, sign, words).

    conv_id (the owner), depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens of its subtree, ends_sha256.
    """
    everyone = convs.agg(F.min("conv").alias("root"), F.count("*").alias("n")).first()
    own = prefixes(rebuilt)
    minima = own.groupBy("depth", "digest").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    minima = materialize(minima, "minima")
    root = everyone.root if everyone.n else -1
    chains = first_owned(convs, own, minima, root)

    named = minima.select(F.col("owner").alias("conv"), F.col("depth").cast("long").alias("depth"), "n_convs", "words")
    top = convs.filter(F.col("conv") == root).select("conv", F.lit(0).cast("long").alias("depth"), F.lit(everyone.n).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    saved: Column = (F.col("n_convs") - 1) * F.col("words")
    nodes = named.unionByName(top).join(small(chains), "conv")
    parent = F.when(F.col("depth") > F.col("first"), F.col("conv")).otherwise(F.col("above"))
    nodes = materialize(nodes.select("conv", "depth", "len", parent.alias("parent"), "n_convs", saved.alias("saved")), "nodes")

    hanging = chains.filter("first > 0 and first <= len").select("conv", "above", (F.col("first") - 1).alias("depth"))
    branches = materialize(hanging.groupBy("above", "depth").agg(F.count("*").alias("branches")).withColumnRenamed("above", "conv"), "branches")
    nodes = nodes.join(small(branches), ["conv", "depth"], "left").fillna(0, ["branches"])
    deeper = (F.col("depth") < F.col("len")).cast("long")
    nodes = nodes.withColumn("n_children", F.col("branches") + deeper).withColumn("leaves", (F.col("n_children") == 0).cast("long")).drop("branches")
    nodes = materialize(nodes, "nodes")

    totals = nodes.groupBy("conv").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    above = chains.filter("first > 0").select("conv", F.col("above").alias("up"))
    below = subtree_sums(totals.join(above, "conv", "left").withColumnRenamed("conv", "id"), ["saved", "leaves"])
    given = hanging.join(below.withColumnRenamed("id", "conv"), "conv").groupBy(F.col("above").alias("conv"), "depth").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    given = small(materialize(given, "given"))
    summed = nodes.join(given, ["conv", "depth"], "left").fillna(0, ["more_saved", "more_leaves"])
    summed = summed.select("conv", "depth", (F.col("len") - F.col("depth")).alias("left"), "parent", "n_convs", "n_children", (F.col("leaves") + F.col("more_leaves")).alias("n_leaves"), (F.col("saved") + F.col("more_saved")).alias("saved_tokens"))
    summed = materialize(running_sums(materialize(summed, "nodes"), "conv", "left", ["n_leaves", "saved_tokens"]), "nodes")

    last = F.when(F.col("first") <= F.col("len"), F.col("conv")).otherwise(F.col("above"))
    ends = end_digests(chains.select(last.alias("node"), F.col("len").cast("long").alias("depth"), "conv"))
    ends = materialize(ends, "ends").withColumnRenamed("node", "conv")
    out = summed.join(ends, ["conv", "depth"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, rebuilt so that they branch off from every twentieth."""
    return trie(*branched(turns(table(spark, sf_dir, "conversations"))))


OP12_SQL = rf"""
WITH {CRC_TABLE_SQL},
said AS (
  SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT DISTINCT c, c - c % 20 AS base FROM said),
heads AS (SELECT c, base, {CRC_SQL.format(w="CAST(c AS VARCHAR)")} % 4 AS h FROM ids, crc),
lent AS (SELECT i.c, s.p AS d, s.role, s.text FROM heads i JOIN said s ON s.c = i.base AND s.p <= i.h),
counts AS (SELECT c, count(*) AS n FROM lent GROUP BY c),
built AS (
  SELECT * FROM lent UNION ALL
  SELECT s.c, coalesce(k.n, 0) + s.p - i.h, s.role, s.text FROM said s JOIN heads i USING (c) LEFT JOIN counts k USING (c) WHERE s.p > i.h
), paths AS (
  SELECT c, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    list({{'r': role, 't': text}}) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM built
), steps AS (SELECT c, d, words, path FROM paths UNION ALL SELECT c, 0, 0, [] FROM ids),
owned AS (SELECT c, d, words, min(c) OVER (PARTITION BY d, path) AS o, count(*) OVER (PARTITION BY d, path) AS n FROM steps),
lens AS (SELECT c, max(d) AS len FROM steps GROUP BY c),
nodes AS (SELECT o, d, n, words FROM owned WHERE o = c),
linked AS (SELECT k.o, k.d, k.n, (k.n - 1) * k.words AS saved, p.o AS parent FROM nodes k LEFT JOIN owned p ON p.c = k.o AND p.d = k.d - 1),
children AS (SELECT parent AS o, d - 1 AS d, count(*) AS children FROM linked WHERE d > 0 GROUP BY ALL),
leafy AS (SELECT l.*, coalesce(k.children, 0) AS children FROM linked l LEFT JOIN children k USING (o, d)),
sums AS (SELECT a.o, a.d, sum(l.saved) AS saved, sum(CASE WHEN l.children = 0 THEN 1 ELSE 0 END) AS leaves FROM leafy l JOIN owned a ON a.c = l.o AND a.d <= l.d GROUP BY a.o, a.d),
ends AS (SELECT w.o, w.d, sha256(string_agg(CAST(w.c AS VARCHAR), ',' ORDER BY w.c)) AS ends FROM owned w JOIN lens l ON l.c = w.c AND l.len = w.d GROUP BY w.o, w.d)
SELECT l.o AS conv_id, l.d AS depth, l.parent AS parent_conv_id, l.n AS n_convs, l.children AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM leafy l JOIN sums s USING (o, d) LEFT JOIN ends e USING (o, d)"""
