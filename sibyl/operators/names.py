"""Names of a list in texts: of names that overlap, the one that begins first, of these the longest.

A list of few words is sent to the tasks as a trie of words. A longer one is joined: each name is looked up by that word of it which the texts
have least often, and compared with the words around. Which way is taken is decided by counting the list's words, and both give the same rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

#: Words of a list that is sent to the tasks.
MOST_WORDS = 200_000

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _trie(names: Sequence[str]) -> dict:
    """Nested dictionaries by word; an end is marked by the key None."""
    root: dict = {}
    for name in names:
        node = root
        for word in name.split(" "):
            node = node.setdefault(word, {})
        node[None] = True
    return root


def _longest(words: Sequence[str], trie: dict) -> list[dict]:
    """Spans of names, each looked for from where the last one ended."""
    out, i = [], 0
    while i < len(words):
        node, end = trie.get(words[i]), None
        j = i
        while node is not None:
            if None in node:
                end = j
            j += 1
            node = node.get(words[j]) if j < len(words) else None
        if end is None:
            i += 1
        else:
            out.append({"begin": i, "end": end})
            i = end + 1
    return out


def _by_trie(words: DataFrame, list_: DataFrame) -> DataFrame:
    """The texts' rows with their spans; the list was counted."""
    shared = words.sparkSession.sparkContext.broadcast([r[0] for r in list_.select("text").collect()])
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(shared.value)
        for b in batches:
            found = pa.array([_longest(w or (), trie) for w in b.column(b.num_columns - 1).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, "_s"])

    span = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return words.mapInArrow(run, T.StructType([*words.schema.fields, T.StructField("_s", T.ArrayType(span))]))


def _leftmost(spans: Column) -> Column:
    """The spans that stay of some, each begun after the last one's end."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["begin"].alias("begin"), (-x["end"]).alias("end"))))
    zero = F.struct(F.lit(-1).alias("to"), F.array().cast("array<struct<begin:int,end:int>>").alias("kept"))
    step = lambda a, x: F.when(x["begin"] > a["to"], F.struct((-x["end"]).alias("to"), F.concat(a["kept"], F.array(F.struct(x["begin"].alias("begin"), (-x["end"]).alias("end")))).alias("kept"))).otherwise(a)
    return F.aggregate(ordered, zero, step, lambda a: a["kept"])


def _by_join(words: DataFrame, list_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The texts' rows with their spans, names being looked up by their rarest word. Only places of such words are shuffled, with as many words around as the longest name has."""
    each = words.select(*keys, F.posexplode("_w").alias("_i", "word"))
    own = list_.select("text", F.split("text", " ").alias("_n"))
    parts = own.select("text", F.posexplode("_n").alias("_j", "word"))
    often = each.join(parts.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # a name of which a word stands nowhere can't be found
    rare = parts.join(often, "word", "left").groupBy("text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_j", "word")).alias("r")).filter("r.n > 0")
    asked = own.join(rare.select("text", "r._j", "r.word"), "text")
    reach = asked.agg(F.max(F.size("_n"))).first()[0] or 1
    around = words.select(*keys, "_w", F.posexplode("_w").alias("_i", "word")).withColumn("_from", F.greatest(F.col("_i") - (reach - 1), F.lit(0)))
    near = around.select(*keys, "_i", "word", "_from", F.slice("_w", F.col("_from") + 1, F.lit(2 * reach - 1)).alias("_near"))
    start = F.col("_i") - F.col("_j")
    hits = near.join(asked, "word").withColumn("_b", start).filter("_b >= _from").filter(F.slice("_near", F.col("_b") - F.col("_from") + 1, F.size("_n")) == F.col("_n"))
    spans = hits.groupBy(*keys).agg(F.collect_set(F.struct(F.col("_b").alias("begin"), (F.col("_b") + F.size("_n") - 1).alias("end"))).alias("_s"))
    return words.join(spans.withColumn("_s", _leftmost(F.col("_s"))), list(keys))


def longest_names(passages: DataFrame, names: DataFrame, keys: Sequence[str], text: str = "sentence", most: int = MOST_WORDS) -> DataFrame:
    """(keys, begin, end, text, kind) of the names (name, kind) in passages, in lower case; a name of several kinds gives a row for each.

    keys tell the passages apart and are not null; words are numbered from 0 and compared in lower case, what stands between them does not count. Null texts, null names and
    names without a word give nothing. most: words of a list that is sent to the tasks as a trie.
    """
    listed = names.select(F.array_join(tx.tokens(F.col("name")), " ").alias("text"), "kind").filter("text <> ''").distinct()
    own = listed.select("text").distinct()
    n_words = own.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    words = passages.select(*keys, tx.tokens(F.col(text)).alias("_w"))
    found = _by_trie(words, own) if n_words <= most else _by_join(words, own, keys)
    spans = found.withColumn("_x", F.explode("_s")).select(*keys, "_x.begin", "_x.end", F.array_join(F.slice("_w", F.col("_x.begin") + 1, F.col("_x.end") - F.col("_x.begin") + 1), " ").alias("text"))
    return spans.join(listed, "text").select(*keys, "begin", "end", "text", "kind")
