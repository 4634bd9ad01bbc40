"""Queries of the sequence tagger and of models that are trained here, over documents and benchmark texts."""

from __future__ import annotations

import sys
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stages
from ..functions import text as tx
from ..operators import candidates as cd
from ..operators import lemmas as lm
from ..operators import tagging
from .base import Query, questions, table

BUCKETS = 1 << 14

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _tokens(sentences: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Words of sentences with the shapes that a tagger sees: the lower-case word, its ending, and whether it begins with a capital."""
    words = sentences.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(tx.TOKEN), F.lit(0))).alias("i", "token"))
    shape = F.when(F.col("token").rlike(r"^\p{Lu}"), "A").when(F.col("token").rlike(r"^\p{N}"), "0").otherwise("a")
    return words.withColumn("shape", F.concat(shape, F.lit(":"), F.lower(F.substring("token", -2, 2))))


def _features(tokens: DataFrame, keys: list[str]) -> DataFrame:
    own = F.array(F.concat(F.lit("word="), F.lower("token")))
    shaped = cd.context_features(tokens, keys, "shape")
    return shaped.withColumn("features", F.concat("features", own))


def tag_mentions(s: SparkSession, d: str) -> DataFrame:
    """Mentions that a tagger finds in every sentence of every document, after it has learned where the benchmark's texts name their longest capitalised runs."""
    asked = questions(s, d)
    runs = cd.capitalised_runs(asked, ["qid"], "text").filter(F.col("end") > F.col("begin"))
    learned = _features(tagging.gold_tags(_tokens(asked, ["qid"], "text"), runs, ["qid"]), ["qid"])
    tagger = tagging.train(tagging.encoded(learned, ["qid"], BUCKETS, tag="tag"), ("B", "I", "O"), BUCKETS, rounds=25, decay=0.5)
    lines = table(s, d, "documents").select("doc_id", F.transform(tx.sentences(F.col("text")), tx.spaced_words).alias("sentences"))
    return tagging.mentions(lines, tagger, "doc_id", "sentences", _shaped_ids).withColumn("score", F.round("score", 4))


def _shaped_ids(words: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Buckets of what `_features` makes of words of sentences that are laid end to end; each word's shape is found once."""
    own = words.dictionary_encode()
    code, texts = own.indices.to_numpy(zero_copy_only=False), own.dictionary.to_pylist()
    kind = lambda c: "A" if c == "Lu" else "0" if c[0] == "N" else "a"
    shapes = pa.array([f"{kind(category(w[0]))}:{w[-2:].lower()}" for w in texts], pa.string()).dictionary_encode()
    shape = shapes.indices.to_numpy(zero_copy_only=False)
    word = np.array([tagging.bucket(f"word={w.lower()}", BUCKETS) for w in texts])
    return np.column_stack([tagging.context_ids([x.encode() for x in shapes.dictionary.to_pylist()], shape[code], sizes, "shape", BUCKETS), word[code]])


def corpus_lemmas(s: SparkSession, d: str) -> DataFrame:
    """Every word of the documents with its lemma, by rules learned from those words whose plain form stands in the documents too."""
    # the distinct words are few beside the texts, and are read several times: they are found once
    words = stages.staged(table(s, d, "documents").select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("word")).distinct(), "words")
    form = F.col("form")
    cut = [F.when(form.endswith(goes) & (F.length(form) > len(goes) + 2), F.concat(F.left(form, F.length(form) - len(goes)), F.lit(comes))) for goes, comes in GUESSES]
    pairs = lm.attested_pairs(words, F.array_compact(F.array(*cut)))
    return lm.lemmas(words, lm.learn(pairs))


#: Endings of inflected forms and what may stand in their place in the plain form.
GUESSES = (("s", ""), ("es", ""), ("ies", "y"), ("ed", ""), ("ed", "e"), ("ing", ""), ("ing", "e"))
QUERIES = {"tag_mentions": Query(tag_mentions), "corpus_lemmas": Query(corpus_lemmas)}
