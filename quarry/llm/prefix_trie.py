"""Prefix trie of conversations, built level by level.

At each depth the live conversations, those that share their node with another, are
grouped by (parent node, next turn); the least conv_id names the new node, so
(depth, conv_id) is a node's key. A conversation that is alone in its node leaves:
the rest of it is a chain of nodes of one member, known from its length, so the number
of levels is the longest shared prefix and not the longest conversation. Afterwards
levels are joined to their parents in reverse to add up leaves and savings.

Turns travel as 128-bit digests of (role, text) with the text's length in bytes. Turn
numbers come from a sort by ranges, so a conversation of very many turns is spread over
tasks. Members of a node and the node are read from files where they are joined, so
Spark may split the join of a node that holds most conversations. Each level is written
to the shared folder.

Null role, null text: empty. Null turn: before all others. Equal turns of one
conversation: by digest; repeated rows are turns of their own. Null conv_id: no
conversation, left out. An empty table has no nodes, not even a root. Extra columns
aren't read. Negative ids: remainders have the sign of the id, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, scratch, written

#: From this depth on, only the turns of live conversations are kept for the levels to come.
DEEP = 16
#: Nodes of a chain made from one row; bits of the range of ids that make one piece of a list.
CHAIN, IDS = 4096, 16
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def ordered(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos from 1, key, bytes): every turn numbered within its conversation."""
    role, text = (F.coalesce(df[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    slim = df.where(df[id_col].isNotNull()).select(
        df[id_col].cast("long").alias("conv_id"), df[turn_col].alias("turn"), F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("key"), F.octet_length(text).cast("long").alias("bytes")
    )
    order = ["conv_id", "turn", "key", "row"]  # the row's number only keeps many equal rows from one task
    rows = written(slim, "turns").withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            before = np.zeros(len(first), dtype=np.int64)
            before[0] = seen if last == ids[0] else 0
            sizes = np.diff(np.append(first, len(ids)))
            pos = np.arange(1, len(ids) + 1) - np.repeat(first - before, sizes)
            last, seen = ids[-1], int(pos[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(ids), part)), pa.array(pos), b.column(1), b.column(2)], ["conv_id", "part", "pos", "key", "bytes"])

    local = written(rows.select("conv_id", "key", "bytes").mapInArrow(number, "conv_id long, part long, pos long, key binary, bytes long"), "numbered")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = local.groupBy("conv_id", "part").agg(F.max("pos").alias("n")).withColumn("before", F.sum("n").over(earlier)).where("before > 0")
    # a range goes on from the one before it in its first conversation only: fewer rows than there are tasks
    return local.join(F.broadcast(held.select("conv_id", "part", "before")), ["conv_id", "part"], "left").select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "bytes")


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations as ``nodes`` takes them, unchanged."""
    convs = written(turns.groupBy("conv_id").agg(F.max("pos").alias("len")), "conversations")
    return turns.join(convs, "conv_id").select("conv_id", F.col("pos").alias("depth"), "key", "bytes", "len"), convs


def grafted(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversation c rebuilt: the first h turns of conversation c - c % every, then its own after its first h; h is crc32(c) % most."""
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    convs = own.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))).withColumn("len", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv_id", "base", "h", "taken", "len"), "conversations")
    first = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base").join(convs.where("taken > 0"), "base").where("pos <= taken")
    rest = turns.join(convs.select("conv_id", "h", "taken", "len"), "conv_id").where("pos > h")
    rows = first.select("conv_id", F.col("pos").alias("depth"), "key", "bytes", "len").union(rest.select("conv_id", F.expr("taken + pos - h").alias("depth"), "key", "bytes", "len"))
    return rows, convs.select("conv_id", "len")


def nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``turns`` (conv_id, depth from 1, key, bytes, len) of ``convs`` (conv_id, len)."""
    spark = turns.sparkSession
    base = scratch(spark, "trie")

    def put(df: DataFrame, name: str, level: int) -> DataFrame:
        path = f"{base}/{name}/level={level}"
        save(df, path)
        return spark.read.schema(df.schema).parquet(path)

    members = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("len").alias("len"))
    groups = [put(members.select("conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("bytes"), "len").where("n_convs > 0"), "groups", 0)]
    if (root := groups[0].first()) is not None and root.n_convs > 1:
        blocks = spark.read.parquet(_by_block(turns, f"{base}/blocks"))
        shared = put(convs.select("conv_id", F.lit(root.conv_id).alias("node"), "len"), "shared", 0)
        while True:
            depth = len(groups)
            live, block = shared.where(F.col("len") >= depth), depth.bit_length() - 1
            if depth & (depth - 1) == 0:
                here = blocks.where(F.col("block") == block).drop("block")
                if depth >= DEEP:
                    here = put(here.join(live.select("conv_id"), "conv_id", "left_semi"), "turns", block)
            step = put(live.select("conv_id", "node").join(here.where(F.col("depth") == depth), "conv_id").select("conv_id", "node", "key", "bytes", "len"), "steps", depth)
            grouped = step.groupBy("node", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("len").alias("len"))
            named = put(grouped, "named", depth)
            groups.append(named.select("conv_id", F.col("node").alias("parent_conv_id"), "n_convs", "bytes", "len"))
            several = named.where("n_convs > 1").select("node", "key", F.col("conv_id").alias("child"))
            if several.isEmpty():
                break
            shared = put(step.join(several, ["node", "key"]).select("conv_id", F.col("child").alias("node"), "len"), "shared", depth)
    return _result(groups, base, put)


def _by_block(turns: DataFrame, path: str) -> str:
    """Turns by the power of two under their depth, so that a level reads the turns near it."""
    turns.withColumn("block", F.length(F.bin("depth")) - 1).write.partitionBy("block").option("compression", "zstd").parquet(path)
    return path


def _result(groups: list[DataFrame], base: str, put) -> DataFrame:
    """Sums over subtrees from the deepest level up, then all nodes with their ends."""
    spark = groups[0].sparkSession
    below = None
    for depth in range(len(groups) - 1, -1, -1):
        up = groups[depth].where("n_convs > 1")
        if below is None:
            up = up.withColumns({"n_children": F.lit(0).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": F.expr("(n_convs - 1) * bytes")})
        else:
            sums = below.groupBy("parent_conv_id").agg(F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("parent_conv_id", "conv_id")
            up = up.join(sums, "conv_id", "left").withColumns(
                {"n_children": F.coalesce("n", F.lit(0)), "n_leaves": F.coalesce("leaves", F.lit(1)), "saved_tokens": F.expr("(n_convs - 1) * bytes") + F.coalesce("saved", F.lit(0))}
            )
        up = put(up.select("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), "up", depth)
        alone = groups[depth].where("n_convs = 1").select("parent_conv_id", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        below = up.select("parent_conv_id", "n_leaves", "saved_tokens").union(alone)
    several = spark.read.option("basePath", f"{base}/up").schema("conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, level long").parquet(f"{base}/up")
    several = several.withColumnRenamed("level", "depth")
    single = groups[0].withColumn("depth", F.lit(0).cast("long"))
    if len(groups) > 1:
        named = spark.read.schema("node long, conv_id long, n_convs long, len long, level long").parquet(f"{base}/named")
        single = single.select("conv_id", "parent_conv_id", "n_convs", "len", "depth").union(named.select("conv_id", "node", "n_convs", "len", "level"))
        shared = spark.read.schema("conv_id long, node long, len long, level long").parquet(f"{base}/shared")
        ends = _ends(shared.where("len = level").select(F.col("level").alias("depth"), F.col("node").alias("conv_id"), F.col("conv_id").alias("id")))
        several = several.join(ends, ["depth", "conv_id"], "left")
    else:
        several = several.withColumn("ends_sha256", F.lit(None).cast("string"))
    several = several.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return several.select(*out).union(_chains(single.where("n_convs = 1")).select(*out))


def _chains(single: DataFrame) -> DataFrame:
    """The nodes of conversations that are alone from ``depth`` on, down to their length."""
    tasks = int(single.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = single.select("conv_id", "parent_conv_id", F.col("depth").alias("top"), "len", F.explode(F.sequence(F.col("depth"), F.col("len"), F.lit(CHAIN).cast("long"))).alias("at"))
    rows = blocks.repartition(tasks, "conv_id", "at").withColumn("depth", F.explode(F.sequence("at", F.least(F.col("at") + (CHAIN - 1), F.col("len")))))
    last = F.col("depth") == F.col("len")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return rows.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def _ends(ids: DataFrame) -> DataFrame:
    """SHA-256 of each node's ended conversations, ascending: lists of ids of one range each, then hashed in order, one piece in memory."""
    place = F.shiftright("id", IDS)
    pieces = ids.groupBy("depth", "conv_id", place.alias("place")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["depth", "conv_id", "ends_sha256"])

        for b in batches:
            for depth, conv, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (depth, conv) != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (depth, conv), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if done:
                yield flush()
        if node is not None:
            done.append((*node, state.hexdigest()))
            yield flush()

    order = ["depth", "conv_id", "place"]
    return pieces.repartition("depth", "conv_id").sortWithinPartitions(*order).select("depth", "conv_id", "ids").mapInArrow(hashed, "depth long, conv_id long, ends_sha256 string")


def conversation_trie(df: DataFrame) -> DataFrame:
    """The trie of a conversation table whose conversations are rebuilt by ``grafted``."""
    return nodes(*grafted(ordered(df)))
