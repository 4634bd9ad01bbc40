"""The prefix trie of conversations: which openings they share, and what sharing them saves.

A node is a distinct sequence of first turns. Its key is the exclusive or of two 64-bit hashes of each turn with its place, so a prefix's
key comes from running aggregates, which are cut at any row: a conversation of any length is spread over partitions, and what the partitions
before a row hold of its conversation is added. Each partition combines its own rows to a partial trie, a table of nodes; partial tries
are merged in rounds, up to FAN of them at a time by the node's key. Lists of the conversations that end at a node are merged as sorted runs.
The rollup from the leaves up doubles its reach in each round: after k rounds a node holds the sums of all descendants less than 2^k below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, spread, written

#: Partial tries that a round merges into one; ids in a run of an end list.
FAN, RUN = 16, 4_096
KEY = ["k1", "k2"]


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (conv_id, ...) with `i`, the place in the conversation from 1, and `part`: dealt by ranges of conversation and order, so a long conversation has many parts."""
    n = max(spread(rows.sparkSession), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(rows.repartitionByRange(n, "conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    sizes = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("conv_id", "part", (F.sum("_n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    return dealt.withColumn("_at", at).join(before, ["conv_id", "part"]).withColumn("i", F.col("_at") + F.col("_before")).drop("_at", "_before")


def opening(conv_id: Column, most: int = 9) -> Column:
    """How many turns of its anchor a conversation opens with: crc32 of the id in decimals, modulo `most`."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(most))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, role, text) of the rebuilt conversations, and the conv_id of every one, even of those without turns.

    A conversation is the first h turns of conversation c - c % group, then its own turns after its first h, h being opening(c). Turns go by
    number, null first; those of one number by role, then text. Null roles and texts are empty; rows without a conv_id are left out.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("conv_id IS NOT NULL")
    own = written(_numbered(rows, ["turn", "role", "text"]).select("conv_id", "i", "role", "text"), "own-turns")
    sizes = own.groupBy("conv_id").agg(F.max("i").alias("n"))
    ids = sizes.select("conv_id", F.col("n"), opening(F.col("conv_id"), most).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("anchor"))
    ids = ids.join(sizes.select(F.col("conv_id").alias("anchor"), F.col("n").alias("anchor_n")), "anchor", "left").withColumn("opened", F.least("h", F.coalesce("anchor_n", F.lit(0)))).select("conv_id", "anchor", "h", "opened")
    ids = written(ids, "conversations")
    # at most `most` turns of an anchor go to at most `group` conversations
    first = own.filter(F.col("i") <= most).withColumnRenamed("conv_id", "anchor").join(ids, "anchor").filter(F.col("i") <= F.col("opened")).select("conv_id", F.col("i").alias("depth"), "role", "text")
    rest = own.join(ids.select("conv_id", "h", "opened"), "conv_id").filter(F.col("i") > F.col("h")).select("conv_id", (F.col("i") - F.col("h") + F.col("opened")).alias("depth"), "role", "text")
    return first.unionByName(rest), ids.select("conv_id")


def _prefixes(turns: DataFrame) -> DataFrame:
    """(part, conv_id, depth, k1, k2, p1, p2, size): for each turn the keys of the prefix that it ends and of the one before, and its bytes."""
    n = max(spread(turns.sparkSession), int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hashed = turns.select("conv_id", "depth", F.xxhash64(F.lit("first"), "depth", "role", "text").alias("h1"), F.xxhash64(F.lit("second"), "text", "depth", "role").alias("h2"), F.octet_length("text").cast("long").alias("size"))
    dealt = written(hashed.repartitionByRange(n, "conv_id", "depth").withColumn("part", F.spark_partition_id()), "hashed-turns")
    own = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.groupBy("conv_id", "part").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    upto = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("conv_id", "part", F.coalesce(F.bit_xor("x1").over(upto), F.lit(0)).alias("b1"), F.coalesce(F.bit_xor("x2").over(upto), F.lit(0)).alias("b2"))
    keyed = dealt.withColumns({"r1": F.bit_xor("h1").over(own), "r2": F.bit_xor("h2").over(own)}).join(before, ["conv_id", "part"])
    keyed = keyed.withColumn("k1", F.col("r1").bitwiseXOR(F.col("b1"))).withColumn("k2", F.col("r2").bitwiseXOR(F.col("b2")))
    return keyed.select("part", "conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "size")


def _merged(prefixes: DataFrame, fan: int = FAN) -> DataFrame:
    """The nodes of all partitions' partial tries: (depth, k1, k2, p1, p2, size, n_convs, conv_id), conv_id being the smallest member."""
    own = [*KEY, "depth", "p1", "p2", "size"]
    tries = prefixes.groupBy("part", *own).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    parts = int(prefixes.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        tries = tries.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("part", *own).agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
        parts = -(-parts // fan)
    return tries.drop("part")


def _end_lists(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the conversations (k1, k2, conv_id) that end at each node.

    Sorted ranges of all ends give runs of at most RUN ids; the runs of a node are read in order by one task, which holds one at a time.
    """
    n = max(spread(ends.sparkSession), int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def close() -> None:
            if held:
                out.append((*key, held[0], ",".join(map(str, held))))

        for b in batches:
            for *k, c in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if k != key or len(held) >= RUN:
                    close()
                    key, held = k, []
                held.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], ["k1", "k2", "first", "ids"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], ["k1", "k2", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        for b in batches:
            for *k, _, ids in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if k != key:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["k1", "k2", "ends_sha256"])
                out.clear()
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([digest.hexdigest()])], ["k1", "k2", "ends_sha256"])

    listed = ends.select(*KEY, "conv_id").repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(runs, "k1 long, k2 long, first long, ids string")
    return listed.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, "k1 long, k2 long, ends_sha256 string")


def _rolled_up(nodes: DataFrame, depth: int) -> DataFrame:
    """nodes (k1, k2, p1, p2, depth, leaves, saved) with leaves and saved summed over subtrees. The root, to which every pointer leads in the end, is added up apart."""
    out = nodes.select(*KEY, "leaves", "saved", F.when(F.col("depth") > 1, F.col("p1")).alias("a1"), F.when(F.col("depth") > 1, F.col("p2")).alias("a2"))
    reach, old = 1, None
    while reach < depth:
        out = written(out, "rollup")
        if old is not None:
            drop_written(old)
        old = out
        below = out.filter("a1 IS NOT NULL").groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        up = out.filter("a1 IS NOT NULL").select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("n1"), F.col("a2").alias("n2"))
        out = out.join(up, ["a1", "a2"], "left").join(below, KEY, "left")
        out = out.select(*KEY, (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.col("n1").alias("a1"), F.col("n2").alias("a2"))
        reach *= 2
    return out.select(*KEY, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of turns (conv_id, depth, role, text; depths from 1 on without gaps) of conversations (conv_id).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Conversations without turns
    end at the root, whose row is there where any conversation is.
    """
    empty = hashlib.sha256(b"").hexdigest()
    prefixes = written(_prefixes(turns), "prefixes")
    nodes = written(_merged(prefixes), "nodes")
    depth = int(nodes.agg(F.max("depth")).first()[0] or 0)
    children = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = written(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted-nodes")
    valued = counted.select(*KEY, "p1", "p2", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    sums = _rolled_up(valued, depth)

    length = turns.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    last = prefixes.join(length, ["conv_id", "depth"]).select(*KEY, "conv_id")
    turnless = conversations.join(length, "conv_id", "left_anti").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
    lists = written(_end_lists(last.unionByName(turnless)), "end-lists")

    parents = counted.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    every = conversations.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    below = counted.filter("depth > 1").join(parents, ["p1", "p2"])
    top = counted.filter("depth = 1").crossJoin(F.broadcast(every.select(F.col("conv_id").alias("parent"))))  # one row
    named = below.select(*KEY, "depth", "conv_id", "parent", "n_convs", "n_children").unionByName(top.select(*KEY, "depth", "conv_id", "parent", "n_convs", "n_children"))
    root_sums = valued.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    root = every.crossJoin(F.broadcast(root_sums)).select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("depth"), "conv_id", F.lit(None).cast("long").alias("parent"), "n_convs", "n_children", F.greatest("leaves", F.lit(1)).alias("n_leaves"), "saved_tokens")
    full = named.join(sums, KEY).select(*KEY, F.col("depth").cast("long").alias("depth"), "conv_id", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens").unionByName(root)
    out = full.join(lists, KEY, "left")
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
