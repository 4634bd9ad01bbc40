"""Question analysis over parsed tokens, and clues.

Tokens: (qid, i, begin, end, text, lemma, pos). Edges: (qid, gov, dep, rel), both ends token numbers. Parsers are not part of this
library; any table of this shape will do, and `functions.annotate` has rule-based stand-ins for some.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Verbs that never are the selecting verb; clue labels that never name a concept; parts of speech of clues.
VERB_BLACKLIST = "be|have|do|'s|'re|'d|'ve|doe|has|get|give|list"
LABEL_BLACKLIST = "name|script|music|director|film|movie|voice"
CLUE_TOKENS, CLUE_PHRASES = "CD|FW|JJ.*|NN.*|RB.*|UH.*", "AD.*|NP|QP"
# Answer types of question words, as (word, type, synset).
QUESTION_WORD_TYPES = (("who", "person", 7846), ("whom", "person", 7846), ("when", "time", 15147173), ("when", "date", 15184543), ("where", "location", 27365), ("many", "amount", 33914), ("much", "amount", 33914))

# Weight and reliability of each kind of clue.
CLUE_KINDS = {"Token": (1.0, True), "Phrase": (0.99, False), "SV": (1.0, True), "NE": (2.0, True), "LAT": (1.5, False), "SubjectNE": (2.2, True), "SubjectToken": (2.5, True), "SubjectPhrase": (2.7, False), "Ngram": (1.01, False)}


def _ends(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    g = tokens.select("qid", F.col("i").alias("gov"), *[F.col(c).alias(f"g_{c}") for c in ("text", "lemma", "pos", "begin")])
    d = tokens.select("qid", F.col("i").alias("dep"), *[F.col(c).alias(f"d_{c}") for c in ("text", "lemma", "pos", "begin")])
    return edges.join(g, ["qid", "gov"], "left").join(d, ["qid", "dep"], "left")


def focus(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, focus, rule): the token that the question asks about, by the first of six rules that finds one, at its first token.

    1 a noun with a question determiner; 2 what "how" governs over, or another question adverb itself; 3 a generic dependent question
    word; 4 a question word as object; 5 the subject; 6 the object of an imperative.
    """
    e = _ends(tokens, edges)
    wh, verb = F.col("d_pos").rlike("^W"), F.col("g_pos").rlike("^V")
    ambiguous = F.lower("d_lemma").rlike("^what|why|how|which|name$")
    rules = [
        ((F.col("rel") == "det") & wh & ~verb, F.col("gov")),
        ((F.col("rel") == "advmod") & wh, F.when(F.lower("d_lemma") == "how", F.col("gov")).otherwise(F.col("dep"))),
        ((F.col("rel") == "dep") & wh, F.when(F.col("d_pos") == "WRB", F.col("dep")).otherwise(F.col("gov"))),
        ((F.col("rel") == "dobj") & wh & ~ambiguous, F.col("dep")),
        (F.col("rel").isin("nsubj", "nsubjpass"), F.col("dep")),
        (F.col("rel") == "dobj", F.col("dep")),
    ]
    found = reduce(DataFrame.unionByName, [e.filter(cond).select("qid", at.alias("focus"), F.lit(n).alias("rule")) for n, (cond, at) in enumerate(rules, 1)])
    return found.groupBy("qid").agg(F.min(F.struct("rule", "focus")).alias("x")).select("qid", "x.focus", "x.rule")


def focus_through_name(foci: DataFrame, tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """Foci, in which "name" gives way to what it is the name of (its prepositional objects or possessors)."""
    lemmas = tokens.select("qid", F.col("i").alias("focus"), "lemma")
    name = foci.join(lemmas, ["qid", "focus"]).filter("lemma = 'name'").drop("lemma")
    of = edges.filter(F.col("rel").isin("pobj", "poss", "nmod:of", "prep_of")).select("qid", F.col("gov").alias("focus"), F.col("dep").alias("_to"))
    proxy = name.join(of, ["qid", "focus"])
    return foci.join(proxy.select("qid", "focus").distinct(), ["qid", "focus"], "left_anti").unionByName(proxy.select("qid", F.col("_to").alias("focus"), "rule"))


def selecting_verbs(tokens: DataFrame, edges: DataFrame, foci: DataFrame) -> DataFrame:
    """(qid, verb): what governs the focus, else the focus if it is a verb, else the first verb that is none of the blacklist."""
    verb = F.col("pos").rlike("^V") & ~F.col("lemma").rlike(f"^({VERB_BLACKLIST})$")
    verbs = tokens.filter(verb).select("qid", "i", "begin")
    by = foci.select("qid", "focus")
    governing = by.join(edges.select("qid", F.col("dep").alias("focus"), "gov"), ["qid", "focus"]).join(verbs.withColumnRenamed("i", "gov"), ["qid", "gov"]).select("qid", F.lit(1).alias("rule"), "begin", F.col("gov").alias("verb"))
    itself = by.join(verbs.withColumnRenamed("i", "focus"), ["qid", "focus"]).select("qid", F.lit(2).alias("rule"), "begin", F.col("focus").alias("verb"))
    first = verbs.select("qid", F.lit(3).alias("rule"), "begin", F.col("i").alias("verb"))
    return governing.unionByName(itself).unionByName(first).groupBy("qid").agg(F.min(F.struct("rule", "begin", "verb")).alias("x")).select("qid", "x.verb")


def subjects(tokens: DataFrame, edges: DataFrame, phrases: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, kind, begin, end, text) of the subjects: the entity that covers it, else the content word; the widest phrase around it, entities in that, and the shortest phrase.

    phrases and entities: (qid, begin, end, text).
    """
    at = edges.filter(F.col("rel").isin("nsubj", "nsubjpass")).select("qid", F.col("dep").alias("i")).join(tokens, ["qid", "i"]).select("qid", "i", F.col("begin").alias("tb"), F.col("end").alias("te"), F.col("text").alias("tt"), "pos", "lemma")
    covers = (F.col("begin") <= F.col("tb")) & (F.col("end") >= F.col("te"))
    entity = at.join(entities, "qid").filter(covers).select("qid", "i", F.lit("NE").alias("kind"), "begin", "end", "text")
    word = at.filter(F.col("pos").rlike(f"^({CLUE_TOKENS})$")).join(entity.select("qid", "i"), ["qid", "i"], "left_anti").select("qid", "i", F.lit("Token").alias("kind"), F.col("tb").alias("begin"), F.col("te").alias("end"), F.col("tt").alias("text"))
    around = at.join(phrases, "qid").filter(covers)
    size = F.col("end") - F.col("begin")
    pick = lambda best, kind: around.groupBy("qid", "i").agg(best(F.struct("begin", "end", "text"), size).alias("x")).select("qid", "i", F.lit(kind).alias("kind"), "x.*")
    wide, short = pick(F.max_by, "Phrase"), pick(F.min_by, "Phrase").filter("lower(text) <> 'name'")
    inside = wide.select("qid", "i", F.col("begin").alias("wb"), F.col("end").alias("we")).join(entities, "qid").filter("begin >= wb AND end <= we").select("qid", "i", F.lit("NE").alias("kind"), "begin", "end", "text")
    return reduce(DataFrame.unionByName, [entity, word, wide, short, inside]).select("qid", "kind", "begin", "end", "text").distinct()


def answer_types(foci: DataFrame, tokens: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """(qid, lat_type, text, synset, specificity) by focus: the fixed types of question words, else the focus in its surface form and lemma, and the shortest phrase around it."""
    spark = tokens.sparkSession
    at = foci.join(tokens.withColumnRenamed("i", "focus"), ["qid", "focus"])
    words = F.broadcast(spark.createDataFrame(QUESTION_WORD_TYPES, "word string, text string, synset long"))
    fixed = at.join(words, F.lower(at["text"]) == words["word"]).select("qid", F.lit("QuestionWord").alias("lat_type"), words["text"], "synset", F.lit(0.0).alias("specificity"))
    other = at.join(words.select("word").distinct(), F.lower("text") == F.col("word"), "left_anti")
    none = F.lit(0).cast("long").alias("synset")
    forms = other.select("qid", F.explode(F.array_distinct(F.array(F.lower("text"), F.lower("lemma")))).alias("text"), none, F.lit(0.0).alias("specificity"))
    out = fixed.unionByName(forms.select("qid", F.lit("Focus").alias("lat_type"), "text", "synset", "specificity"))
    if phrases is not None:
        p = phrases.select("qid", F.col("begin").alias("pb"), F.col("end").alias("pe"), F.col("text").alias("pt"))
        short = other.join(p, "qid").filter("pb <= begin AND pe >= end").groupBy("qid", "focus").agg(F.min_by("pt", F.col("pe") - F.col("pb")).alias("text"))
        out = out.unionByName(short.select("qid", F.lit("Focus").alias("lat_type"), F.lower(tx.canonical(F.col("text"))).alias("text"), none, F.lit(1.0).alias("specificity")))
    return out.distinct()


def verb_types(verbs: DataFrame, derivations: DataFrame) -> DataFrame:
    """Nouns derived from the selecting verb as answer types, one for each synset. verbs: (qid, lemma); derivations: (lemma, noun, synset)."""
    return verbs.join(derivations, "lemma").groupBy("qid", "synset").agg(F.min("noun").alias("text")).select("qid", F.lit("SV").alias("lat_type"), "text", "synset", F.lit(0.0).alias("specificity"))


def clues(spans: DataFrame) -> DataFrame:
    """Clues of spans (qid, clue_type, text): canonical label, weight and reliability of the kind."""
    kinds = F.create_map(*[x for k, (w, r) in CLUE_KINDS.items() for x in (F.lit(k), F.struct(F.lit(w).alias("weight"), F.lit(r).alias("reliable")))])
    label = F.when(F.col("clue_type") == "Ngram", F.col("text")).otherwise(tx.canonical(F.col("text")))
    return spans.select("qid", "clue_type", label.alias("label"), kinds[F.col("clue_type")]["weight"].alias("weight"), kinds[F.col("clue_type")]["reliable"].alias("reliable")).filter("label <> ''")


def token_clues(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    """Clues of the tokens that carry meaning and of phrases, by their parts of speech. phrases: (qid, kind, text)."""
    words = tokens.filter(F.col("pos").rlike(f"^({CLUE_TOKENS})$")).select("qid", F.lit("Token").alias("clue_type"), "text")
    return clues(words.unionByName(phrases.filter(F.col("kind").rlike(f"^({CLUE_PHRASES})$")).select("qid", F.lit("Phrase").alias("clue_type"), "text")))


def user_clues(questions: DataFrame, weight: float = 2.5) -> DataFrame:
    """Clues that whoever asks adds: artificial_clue, and the titles of the chosen concepts (title, page_id)."""
    own = questions.filter("trim(artificial_clue) <> ''").select("qid", F.lit("Concept").alias("clue_type"), F.trim("artificial_clue").alias("label"))
    titles = questions.select("qid", F.lit("Concept").alias("clue_type"), F.explode("concepts.title").alias("label")).filter("trim(label) <> ''")
    return own.unionByName(titles).distinct().select("*", F.lit(weight).alias("weight"), F.lit(True).alias("reliable"))


def ngram_clues(questions: DataFrame, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """Runs of two to four words of a question (qid, words)."""
    every = F.flatten(F.array(*[tx.ngrams(F.col("words"), n) for n in sizes]))
    return clues(questions.select("qid", F.lit("Ngram").alias("clue_type"), F.explode(every).alias("text")))


def linkable(label: Column) -> Column:
    """False for labels that never name a concept."""
    return ~F.lower(label).rlike(f"^({LABEL_BLACKLIST})$")


def merge_clues(rows: DataFrame, order: str = "seq") -> DataFrame:
    """One clue for each label: of the greatest weight, the later one; reliable if any is."""
    best = F.max_by(F.struct("clue_type", "weight"), F.struct("weight", order))
    return rows.groupBy("qid", "label").agg(best.alias("x"), F.bool_or("reliable").alias("reliable")).select("qid", "x.clue_type", "label", "x.weight", "reliable")


def subsume_once(rows: DataFrame) -> DataFrame:
    """Linked clues (qid, begin, end, dist) without those that a longer one covers, unless they are nearer by more than 1 edit; one pass over all pairs of a question."""
    a, b = rows.alias("a"), rows.select("qid", F.col("begin").alias("b2"), F.col("end").alias("e2"), F.col("dist").alias("d2")).alias("b")
    over = (F.col("b2") <= F.col("begin")) & (F.col("e2") >= F.col("end")) & ((F.col("e2") - F.col("b2")) > (F.col("end") - F.col("begin"))) & ~(F.col("dist") + 1.0 < F.col("d2"))
    covered = a.join(b, "qid").filter(over).select("qid", "begin", "end").distinct()
    return rows.join(covered, ["qid", "begin", "end"], "left_anti")


def subsume(rows: DataFrame) -> DataFrame:
    """The same, longest first and one after the other: what is dropped covers nothing, and what stays inherits flags and the greatest weight of what it covers. rows: (qid, begin, end, label, weight, dist, by_subject, by_ne, by_lat)."""
    import pandas as pd

    def greedy(q: pd.DataFrame) -> pd.DataFrame:
        left = q.assign(_n=q["end"] - q["begin"]).sort_values(["_n", "begin", "label"], ascending=[False, True, True]).drop(columns="_n").to_dict("records")
        kept: list[dict] = []
        while left:
            c, rest = left[0], []
            for x in left[1:]:
                covered = c["begin"] <= x["begin"] and c["end"] >= x["end"]
                if covered and not x["dist"] + 1.0 < c["dist"]:
                    for f in ("by_subject", "by_ne", "by_lat"):
                        c[f] = bool(c[f] or x[f])
                    c["weight"] = max(c["weight"], x["weight"])
                else:
                    rest.append(x)
            kept.append(c)
            left = rest
        return pd.DataFrame(kept, columns=q.columns)

    return rows.groupBy("qid").applyInPandas(greedy, rows.schema)


def concept_ranks(concepts: DataFrame, per_clue: int = 5) -> DataFrame:
    """The best concepts of each clue, and reciprocal ranks: source_rr of a concept under its clue, label_rr of a label among the question's labels."""
    w = Window.partitionBy("qid", "clue").orderBy(F.desc("score"), "entity")
    top = concepts.withColumn("source_rr", 1 / F.row_number().over(w)).filter(F.col("source_rr") >= 1 / per_clue)
    labels = top.groupBy("qid", "label").agg(F.max("score").alias("_s"))
    by = labels.withColumn("label_rr", 1 / F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("_s"), "label"))).drop("_s")
    return top.join(by, ["qid", "label"])


def concept_clues(concepts: DataFrame) -> DataFrame:
    """Clues of linked concepts: weight a little above the source clue's, reliable where the label is unchanged; a reworded label also is an entity clue."""
    same = F.lower("label") == F.lower("clue")
    out = concepts.select("qid", F.lit("Concept").alias("clue_type"), "label", (F.col("weight") + 0.1).alias("weight"), same.alias("reliable"))
    entity = concepts.filter(~same).select("qid", F.lit("NE").alias("clue_type"), "label", F.lit(CLUE_KINDS["NE"][0]).alias("weight"), F.lit(False).alias("reliable"))
    return out.unionByName(entity).distinct()


def classify(features: DataFrame, weights: DataFrame) -> DataFrame:
    """One-vs-rest logistics: qid, class of the greatest probability. features: (qid, feature); weights: (class, feature, weight), "_" the intercept."""
    bias = weights.filter("feature = '_'").select("class", F.col("weight").alias("_b"))
    z = features.join(weights.filter("feature <> '_'"), "feature").groupBy("qid", "class").agg(F.sum("weight").alias("_z"))
    every = features.select("qid").distinct().crossJoin(F.broadcast(bias)).join(z, ["qid", "class"], "left")  # classes are few and fixed
    prob = F.round(1 / (1 + F.exp(-(F.coalesce("_z", F.lit(0.0)) + F.col("_b")))), 6)
    return every.select("qid", "class", prob.alias("prob")).groupBy("qid").agg(F.min(F.struct((-F.col("prob")).alias("p"), "class")).alias("x")).select("qid", "x.class", (-F.col("x.p")).alias("prob"))


def class_features(lats: DataFrame, verbs: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, feature): lat texts and types, and the selecting verb or its absence."""
    lat = lats.select("qid", F.explode(F.array(F.concat(F.lit("lat/"), "text"), F.concat(F.lit("lat/"), "text", F.lit("/"), "lat_type"))).alias("feature"))
    sv = questions.select("qid").join(verbs.select("qid", "lemma"), "qid", "left").select("qid", F.coalesce(F.concat(F.lit("sv="), "lemma"), F.lit("sv_not_present")).alias("feature"))
    return lat.unionByName(sv).distinct()


def path_features(subject_rows: DataFrame, verbs: DataFrame, lats: DataFrame) -> DataFrame:
    """(qid, feature) of the path models: shortest subject phrase, first subject word, verb, its lemma, and all answer types."""
    phrase = subject_rows.filter("kind = 'Phrase'").groupBy("qid").agg(F.min_by("text", F.struct(F.length("text"), "text")).alias("t")).select("qid", F.concat(F.lit("subject_phrase:"), F.lower("t")).alias("feature"))
    word = subject_rows.filter("kind = 'Token'").groupBy("qid").agg(F.min_by("text", "begin").alias("t")).select("qid", F.concat(F.lit("subject_word:"), F.lower("t")).alias("feature"))
    verb = verbs.select("qid", F.explode(F.array(F.concat(F.lit("sv:"), "text"), F.concat(F.lit("sv_lemma:"), "lemma"))).alias("feature"))
    lat = lats.select("qid", F.concat(F.lit("lat:"), "text").alias("feature"))
    return reduce(DataFrame.unionByName, [phrase, word, verb, lat]).distinct()
