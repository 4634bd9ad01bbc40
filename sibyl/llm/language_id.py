"""Language identification, word by word, for texts that may change their language: a linear-chain conditional random field.

A word is described by its affixes, its letter n-grams and the lexicons that hold it; moves between languages are learned. The probability
of each word's language comes from forward-backward sums over its whole text, and a text's language is that of most of its words.

Training rows have one language for each text, so the field is trained on sequences spliced from pieces of different texts: it sees
changes of language and learns how rare they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import tagging
from .common import map_columns, spread, written
from .store import mix

#: Buckets of the hashed features.
BUCKETS = 1 << 15
#: Labelled texts of each language that the field is fitted on, and words of each language's lexicon.
TEXTS, LEXICON = 200, 1_000
#: Words of a piece, and pieces of a training sequence.
PIECE, PIECES = (4, 24), 8
#: Word types whose scores a worker keeps; words labelled at once. A text of more words is labelled in parts of so many.
MOST_KEPT, MOST_AT_ONCE = 200_000, 1 << 18
#: The answer for a text without a letter.
UNDETERMINED = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(word: bytes) -> str:
    """The lower-case letters of a word; "" where it has none."""
    text = word.decode("utf-8", "replace").lower()
    return text if text.isalpha() else _NOT_LETTERS.sub("", text)


def _bucket(*codes: np.ndarray | int) -> np.ndarray:
    h = np.uint64(len(codes))
    for c in codes:
        h = mix(c + h * np.uint64(0x100000001B3))
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) of each feature of words of letters, in the order of the words.

    Features are the n-grams of two and three letters of the word with a mark at each end, those of four at the ends (so affixes of up to
    three letters), and the lexicons that hold it. A word without letters has none.
    """
    marked = [f"\x02{w}\x03" if w else "" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    owners, ids = [], []
    for n in (2, 3, 4):
        last = len(codes) - n + 1
        if last <= 0:
            continue
        at = np.flatnonzero(owner[:last] == owner[n - 1 :])
        if n == 4:
            at = at[(codes[at] == 2) | (codes[at + 3] == 3)]
        owners.append(owner[at])
        ids.append(_bucket(*[codes[at + i] for i in range(n)]))
    if lexicon:
        known = [(i, x) for i, w in enumerate(words) if w in lexicon for x in lexicon[w]]
        owners.append(np.array([i for i, _ in known], np.int64))
        ids.append(_bucket(np.array([x for _, x in known], np.uint64)))
    owner, at = np.concatenate(owners or [np.zeros(0, np.int64)]), np.concatenate(ids or [np.zeros(0, np.int64)])
    order = np.argsort(owner, kind="stable")
    return owner[order], at[order]


@dataclass
class LanguageModel:
    """The field and the lexicons: for each word the numbers of the languages that it is typical of."""

    tagger: tagging.Tagger
    lexicon: dict[str, tuple[int, ...]]
    _at: dict = field(default_factory=dict, repr=False)
    _kept: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"tagger": self.tagger, "lexicon": self.lexicon, "_at": {}, "_kept": None}

    @property
    def languages(self) -> tuple[str, ...]:
        return self.tagger.labels

    def scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word for each language, and whether it has a letter."""
        k = len(self.languages)
        if self._kept is None:
            self._kept = np.empty((MOST_KEPT + MOST_AT_ONCE, k + 1))
        if len(self._at) > MOST_KEPT:
            self._at.clear()
        new = [w for w in set(words) if w not in self._at]
        if new:
            plain = [letters(w) for w in new]
            owner, ids = features(plain, self.lexicon)
            at = len(self._at)
            self._at.update(zip(new, range(at, at + len(new)), strict=True))
            self._kept[at : at + len(new), :k] = tagging.summed(self.tagger.parts[0], ids, np.bincount(owner, minlength=len(new)))
            self._kept[at : at + len(new), k] = [bool(w) for w in plain]
        got = self._kept[np.fromiter(map(self._at.__getitem__, words), np.int64, len(words))]
        return got[:, :k], got[:, k] > 0

    def word_probabilities(self, texts: list[list[bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the text, probabilities of its words' languages, which words have a letter), in parts of bounded size."""
        _, moves, first = self.tagger.parts
        parts = [(i, t[k : k + MOST_AT_ONCE]) for i, t in enumerate(texts) for k in range(0, len(t), MOST_AT_ONCE)]
        held, size = [], 0
        for n, part in enumerate(parts):
            held.append(part)
            size += len(part[1])
            if n + 1 == len(parts) or size + len(parts[n + 1][1]) > MOST_AT_ONCE:
                scores, lettered = self.scores([w for _, t in held for w in t])
                sizes = np.array([len(t) for _, t in held])
                p = tagging.chain(scores, sizes, moves, first).marginals()
                ends = np.cumsum(sizes)
                for (i, _), a, b in zip(held, ends - sizes, ends, strict=True):
                    yield i, p[a:b], lettered[a:b]
                held, size = [], 0


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", texts: int = TEXTS, rounds: int = 25) -> LanguageModel:
    """A model fitted on at most `texts` texts of each language, those of the lowest hash of the id; null ids, texts and languages are left out.

    The bounded sample's whole texts are read. Their lexicons go to the driver, at most LEXICON words a language. Without rows every text is undetermined.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
    # the ids are chosen first: no text is shuffled that is not used
    chosen = rows.select("lang", "id", F.xxhash64("text").alias("row"), F.row_number().over(order).alias("n")).filter(F.col("n") <= texts).select("id", "lang", "row").distinct()
    sample = written(rows.withColumn("row", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "lang", "row"]).dropDuplicates(["id", "lang", "row"]), "lang-sample")
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not languages:
        return LanguageModel(tagging.Tagger((), BUCKETS), {})
    number = {x: i for i, x in enumerate(languages)}

    plain = map_columns(sample.repartition(spread(spark)), ["id", "lang"], [F.col("text")], [("words", "array<string>")], lambda t: [[[letters(w) for w in _words(x)] for x in t]], rows=64)
    plain = written(plain, "lang-words")
    counts = plain.select("lang", F.explode("words").alias("word")).filter("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("word"))
    typical = counts.withColumn("share", share).filter("n >= 3 AND share >= 0.5").withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("i") <= LEXICON)
    lexicon: dict[str, tuple[int, ...]] = {}
    for r in typical.select("word", "lang").orderBy("word", "lang").collect():
        lexicon[r.word] = (*lexicon.get(r.word, ()), number[r.lang])

    least, most = PIECE

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, lang, words in zip(*[c.to_pylist() for c in b.columns], strict=True):
                keys, sizes, at = [], [], 0
                while at < len(words):
                    sizes.append(min(len(words) - at, least + crc32(f"{doc}:{len(keys)}".encode()) % (most - least + 1)))
                    at += sizes[-1]
                    keys.append(crc32(f"{lang}:{len(keys)}:{doc}".encode()))
                owner, ids = features(words, lexicon)
                of_word = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]), pa.int32()), pa.array(ids, pa.int32()))
                of_piece = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), of_word)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([lang] * len(keys), pa.string()), of_piece], ["key", "lang", "ids"])

    cut = written(plain.select(F.col("id").cast("string"), "lang", "words").mapInArrow(pieces, "key long, lang string, ids array<array<int>>"), "lang-pieces")
    n = max(1, cut.count() // PIECES)
    spliced = cut.groupBy(F.pmod("key", F.lit(n)).alias("g")).agg(F.sort_array(F.collect_list(F.struct("key", "lang", "ids"))).alias("p"))
    tags = F.flatten(F.transform("p", lambda p: F.array_repeat(p["lang"], F.size(p["ids"]))))
    sequences = spliced.select(F.flatten(F.transform("p", lambda p: p["ids"])).alias("ids"), tags.alias("tags"))
    return LanguageModel(tagging.train(sequences, languages, BUCKETS, rounds, tasks=spread(spark)), lexicon)


def labelled(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep's columns, lang_pred and score for every whole text, in one pass without a shuffle.

    lang_pred: the language that most words (with a letter, weighed by their probabilities) are in, score: its share of them. A text that is null or has no
    letter is undetermined, with score 0. Ties: the first by name. Of texts of over MOST_AT_ONCE words each part of so many is a chain of its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: list[str | None]) -> list:
        m = shared.value
        k = len(m.languages)
        total = np.zeros((len(texts), max(1, k)))
        if k:
            for i, p, lettered in m.word_probabilities([_words(t) for t in texts]):
                total[i] += p[lettered].sum(0)
        n = total.sum(1)
        best = total.argmax(1)
        found = n > 0
        return [[m.languages[b] if f else UNDETERMINED for b, f in zip(best, found, strict=True)], np.where(found, np.minimum(1.0, total[np.arange(len(texts)), best] / np.where(found, n, 1)), 0.0)]

    return map_columns(docs, keep, [F.col(text_col)], [("lang_pred", "string"), ("score", "double")], predict)


def spans(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep's columns and `spans` (begin, end, lang: first word, word after the last, language) of every text: runs of words of one most probable language. Words without a letter go with the word before them, those at the start with the first run."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def cut(texts: list[str | None]) -> list:
        m = shared.value
        out: list[list[dict]] = [[] for _ in texts]
        done = [0] * len(texts)
        if m.languages:
            for i, p, lettered in m.word_probabilities([_words(t) for t in texts]):
                for at, best in enumerate(p.argmax(1).tolist()):
                    name = m.languages[best] if lettered[at] else None
                    if out[i] and (name is None or out[i][-1]["lang"] in (name, None)):
                        out[i][-1] |= {"end": done[i] + at + 1, "lang": out[i][-1]["lang"] or name}
                    else:
                        out[i].append({"begin": done[i] + at, "end": done[i] + at + 1, "lang": name})
                done[i] += len(p)
        return [[[s | {"lang": s["lang"] or UNDETERMINED} for s in row] for row in out]]

    return map_columns(docs, keep, [F.col(text_col)], [("spans", "array<struct<begin:int,end:int,lang:string>>")], cut)
