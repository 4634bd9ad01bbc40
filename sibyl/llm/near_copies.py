"""Documents whose five-word shingle sets are similar, of which the pipeline keeps one.

At a Jaccard similarity of 0.8 about 10 of 64 fingerprint bits differ, and up to 18 may. Pigeonhole keys for 18 bits would let in a large
share of all pairs, so candidates come from two sources: groups of fingerprints joined by the Golay keys' distance, and MinHash bands tuned to
find the share RECALL of the pairs at the similarity.

The exact Jaccard similarity decides inside each group, before anything is joined up, so a group is no larger than what shares a band. First all
members of a group are compared with one leader, then with another; what verified links connect need not be compared again. Only groups that
are still apart go on: what lies outside a group's largest connected part meets all of the group, block by block. Sets of shingle hashes are sent, not texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, drop_written, map_columns, written
from .components import components
from .paragraphs import SHINGLE, SIMILARITY, linked, set_keys, shingle_hashes, tuned_bands
from .simhash import fingerprints, links

#: Documents of a group that are compared with others in one task; larger groups are compared in blocks. Leaders that a group is compared with before that.
BLOCK, LEADERS = 2_048, 2


def words_of(text: str | None) -> list[bytes]:
    """Words as the fingerprints take them: ASCII letters in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _signed(texts: list[str | None], bands: int, rows: int) -> list:
    words = [words_of(t) for t in texts]
    pids = np.array([xxhash.xxh3_64_intdigest(b" ".join(w)) for w in words], np.uint64).view(np.int64)
    return [pids, fingerprints(texts, SHINGLE).view(np.int64), set_keys([shingle_hashes(w) for w in words], bands, rows).tolist()]


def _groups(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, pid) of the groups of two or more texts that share a band or are joined by near fingerprints; groups of the same members once."""
    near = components(links(distinct.select("fp").distinct())).withColumnRenamed("id", "fp")
    by_print = distinct.join(near, "fp", "left").select(F.xxhash64(F.lit("fingerprints"), F.coalesce("component", "fp")).alias("key"), "pid")
    keyed = written(distinct.select(F.explode("keys").alias("key"), "pid").unionByName(by_print), "near-keys")
    sums = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("least"), F.max("pid").alias("most"), F.bit_xor(F.xxhash64("pid")).alias("all"))
    kept = sums.filter("n > 1").groupBy("n", "least", "most", "all").agg(F.min("key").alias("key")).select("key", "n")
    out = scratch.written(keyed.join(kept, "key").select("key", "pid", "n", F.col("pid").alias("root")), "near-groups")
    drop_written(keyed)
    return out


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                least, most = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if least >= similarity * most - 1e-9 else 0
                near.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            at = pa.array(np.flatnonzero(near))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    first, second = sets.select(F.col("pid").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("pid").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _still_apart(groups: DataFrame, links_: DataFrame, scratch: Scratch) -> DataFrame:
    """The groups with their members' roots by the links so far, without those that are connected; a group of two has been compared."""
    rooted = groups.drop("root").join(components(links_).select(F.col("id").alias("pid"), F.col("component").alias("root")), "pid", "left").withColumn("root", F.coalesce("root", "pid"))
    rooted = scratch.written(rooted.filter("n > 2"), "near-rooted")
    apart = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("key")
    return scratch.written(rooted.join(apart, "key").select(groups.columns), "near-apart")


def _block_links(groups: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links of groups that are still apart: what is not in a group's largest connected part, in blocks, meets every block of the group."""
    sizes = groups.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("all"))
    of = lambda n: F.greatest(F.ceil(n / F.lit(block / 2)), F.lit(1)).cast("int")
    sized = largest.select("key", F.col("top.root").alias("top"), of(F.col("all")).alias("blocks"), of(F.col("all") - F.col("top.m")).alias("guests"))
    dealt = groups.join(sized, "key")
    every = dealt.select("key", "pid", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("guests") - 1)).alias("j"))
    guests = dealt.filter("root <> top").select("key", "pid", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(F.xxhash64("pid", F.lit(1)), F.col("guests")).cast("int").alias("j"))
    met = every.unionByName(guests).distinct().join(sets, "pid")

    def compare(t: pa.Table) -> pa.Table:
        a, b = linked(np.asarray(t.column("pid")), [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()], similarity)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def _all_links(distinct: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, block: int, scratch: Scratch, leaders: int = LEADERS) -> DataFrame:
    """Links (a, b) that connect all candidates of distinct texts that are similar."""
    groups = _groups(distinct, scratch)
    sets = sets_of(groups.select("pid").distinct())
    found = None
    for r in range(leaders):
        order = F.xxhash64("pid", F.lit(r))
        lead = groups.groupBy("key").agg(F.min_by(F.struct("pid", "root"), order).alias("lead"))
        pairs = groups.join(lead, "key").filter("root <> lead.root").select(F.least("pid", "lead.pid").alias("a"), F.greatest("pid", "lead.pid").alias("b")).distinct()
        new = scratch.written(_similar(pairs, sets, similarity), "near-links")
        found = new if found is None else found.unionByName(new)
        groups = _still_apart(groups, found, scratch)
    return found.unionByName(scratch.written(_block_links(groups, sets, similarity, block), "near-links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """docs without near copies: of each group of texts that are equal or similar, directly or through others, the row of the smallest id stays.

    Rows without an id are not judged and stay. Texts without words are equal. Rows that share an id but not the text are documents of their own; of rows equal in both one stays.
    """
    bands, rows = tuned_bands(similarity)
    scratch = Scratch()
    named = docs.filter(F.col(id_col).isNotNull())
    texts = named.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    made = [("pid", "long"), ("fp", "long"), ("keys", "array<long>")]
    signed = written(map_columns(texts, ["doc_id", "row"], [F.col("text")], made, lambda t: _signed(t, bands, rows)), "near-rows")
    distinct = scratch.written(signed.groupBy("pid").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "near-texts")

    def sets_of(pids: DataFrame) -> DataFrame:
        wanted = distinct.join(pids, "pid").select("pid", "first.doc_id", "first.row")
        made = map_columns(texts.join(wanted, ["doc_id", "row"]), ["pid"], [F.col("text")], [("hashes", "binary")], lambda t: [[shingle_hashes(words_of(x)).tobytes() for x in t]])
        return scratch.written(made.dropDuplicates(["pid"]), "near-sets")

    classes = components(_all_links(distinct, sets_of, similarity, block, scratch)).select(F.col("id").alias("pid"), F.col("component").alias("root"))
    roots = written(distinct.select("pid", "first").join(classes, "pid", "left").withColumn("root", F.coalesce("root", "pid")), "near-roots")
    scratch.drop()  # the links are in the roots now
    heads = roots.groupBy("root").agg(F.min("first").alias("head"))
    # rows of one id and different texts are told apart by the text; of rows equal in both one stays
    chosen = heads.select("head.doc_id", "head.row").distinct().join(signed.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n")), ["doc_id", "row"])
    kept = chosen.select(F.col("doc_id").alias("__near_id"), F.col("row").alias("__near_row"), F.col("n").alias("__near_n"))
    mine = named.join(kept, (F.col(id_col) == F.col("__near_id")) & (F.xxhash64(F.col(text_col)) == F.col("__near_row")))
    one = mine.filter("__near_n > 1").dropDuplicates(["__near_id", "__near_row"])
    return mine.filter("__near_n = 1").unionByName(one).select(docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
