"""Answer analysis: clue overlap, focus, answer types, their hypernyms, and type coercion against the question's types.

Types are rows (…, text, synset, specificity, lat_type); a synset of 0 is none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stages
from ..functions import text as tx
from .hitlist import CASES, _case

#: Between a clue and the rest of an answer stands a character that is no letter, digit or underscore.
WORD_BOUNDARY = r"\s*\W\s*"

# Words at which generalisation ends.
TOP_WORDS = (
    "entity", "physical entity", "abstraction", "thing", "object", "whole", "congener", "living thing", "organism", "benthos", "dwarf",
    "heterotroph", "parent", "life", "biont", "cell", "causal agent", "person", "animal", "plant", "native", "natural object", "substance",
    "substance1", "matter", "food", "nutrient1", "artifact", "article", "psychological feature", "cognition", "motivation", "attribute",
    "state", "feeling", "location", "shape", "time", "space", "absolute space", "phase space", "event", "process", "act", "group",
    "relation", "possession", "social relation", "communication", "measure", "phenomenon",
)
# Synsets too general for a match between two generalised types.
GENERAL_SYNSETS = (
    33319, 23451, 5624029, 5778661, 32220, 33914, 3580409, 22119, 13597072, 8024893, 31563, 8206589, 24444, 4623416, 3187746, 7967506, 30657,
    408356, 24900, 5130681, 5097645, 4475, 3133774, 4014270, 2137, 6264799, 7991473, 5842164, 5847533, 4923519, 4731092, 5844071, 2452,
    32912, 7298313, 6804229, 7123727, 29677,
)
# Synsets of entity kinds.
ENTITY_SYNSETS = {"date": 15184543, "location": 27365, "money": 13405730, "organization": 8024893, "percentage": 13837954, "person": 7846, "time": 15154879}


def clue_overlap(answers: DataFrame, clues: DataFrame) -> DataFrame:
    """Counts of how each answer (qid, text) overlaps its question's clues: one of seven cases for each clue, apart for entity and concept clues (clOC…) and others (clO…).

    The first case that holds counts, equality first; metaMatch is the mean of prefixed and suffixed where both occur. Features not set are null.
    """
    a = answers.select("qid", "text", F.lower("text").alias("_a")).filter("_a <> ''")
    c = clues.select("qid", F.lower("label").alias("_c"), F.col("clue_type").isin("NE", "Concept").alias("_named"))
    near = F.contains("_a", "_c") | F.contains("_c", "_a")
    case = F.when(F.col("_a") == F.col("_c"), "match").otherwise(_case(F.col("_a"), F.col("_c"), WORD_BOUNDARY))
    hits = a.join(c, "qid").filter(near).withColumn("_case", case).filter(F.col("_case").isNotNull())
    made = []
    for prefix, named in (("clOC", True), ("clO", False)):
        n = {k: F.nullif(F.count_if((F.col("_named") == named) & (F.col("_case") == k)), F.lit(0)).cast("double") for k in ("match", *CASES)}
        made += [v.alias(f"{prefix}{k.capitalize()}Score") for k, v in n.items()] + [((n["prefixed"] + n["suffixed"]) / 2).alias(f"{prefix}MetaMatchScore")]
    return hits.groupBy("qid", "text").agg(*made)


def answer_focus(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """(answer, focus): the first token that no other governs though it governs some; else the first noun, else the last adverb, adjective or number. Numbers have none.

    tokens: (answer, i, begin, text, pos); edges: (answer, gov, dep).
    """
    heads = edges.select("answer", F.col("gov").alias("i")).distinct().join(edges.select("answer", F.col("dep").alias("i")), ["answer", "i"], "left_anti")
    at = tokens.join(heads.withColumn("_head", F.lit(1)), ["answer", "i"], "left")
    whole = tokens.groupBy("answer").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("begin", "text"))), lambda x: x["text"]), " ").alias("_t"))
    rules = ((F.col("_head") == 1, 1, F.col("begin")), (F.col("pos").rlike("^NN"), 2, F.col("begin")), (F.col("pos").rlike("^(RB|JJ|CD)"), 3, -F.col("begin")))
    rule = F.coalesce(*[F.when(holds, F.struct(F.lit(n).alias("r"), at.alias("b"))) for holds, n, at in rules])
    found = at.filter(rule.isNotNull()).groupBy("answer").agg(F.min_by("i", rule).alias("focus"))
    return found.join(whole, "answer").filter(~tx.is_quantity(F.col("_t"))).select("answer", "focus")


def entity_synset(kind: Column) -> Column:
    """Synset of an entity kind, 0 for others."""
    return F.coalesce(F.create_map(*[x for k, v in ENTITY_SYNSETS.items() for x in (F.lit(k), F.lit(v).cast("long"))])[kind], F.lit(0).cast("long"))


def instance_types(answers: DataFrame, instances: DataFrame) -> DataFrame:
    """Types of what an answer is an instance of, by its text, else its canonical text, else its focus: the first form that has any. instances: (name, type, synset)."""
    forms = answers.select("qid", "text", F.posexplode(F.array(F.col("text"), tx.canonical(F.col("text")), F.col("focus"))).alias("_form", "name")).filter("name IS NOT NULL")
    hits = forms.join(instances, F.lower(forms["name"]) == F.lower(instances["name"])).select("qid", "text", "_form", "type", "synset")
    first = F.min("_form").over(Window.partitionBy("qid", "text"))
    return hits.withColumn("_first", first).filter("_form = _first").select("qid", "text", F.col("type").alias("lat_text"), "synset", F.lit(0.0).alias("specificity"), F.lit("WnInstance").alias("lat_type")).distinct()


def fallback_types(known: DataFrame, answers: DataFrame, types: DataFrame, lat_type: str) -> DataFrame:
    """Types by another source for answers that have none yet. types: (name, type)."""
    bare = answers.join(known.select("qid", "text").distinct(), ["qid", "text"], "left_anti")
    return bare.join(types, F.lower("text") == F.lower("name")).select("qid", "text", F.col("type").alias("lat_text"), F.lit(0).cast("long").alias("synset"), F.lit(0.0).alias("specificity"), F.lit(lat_type).alias("lat_type")).distinct()


def replaced_types(known: DataFrame, better: DataFrame) -> DataFrame:
    """Types with those of a better source put in place of equal texts."""
    return known.join(better.select("qid", "text", "lat_text"), ["qid", "text", "lat_text"], "left_anti").unionByName(better)


def quantity_types(answers: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """Measure, magnitude relation and magnitude as types of answers that are numbers as a whole, and of those whose focus a number belongs to.

    numbered: (qid, text) of answers whose focus has a numeric dependent that is no part of a name.
    """
    kinds = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).cast("long").alias("s")) for t, s in (("measure", 33914), ("magnitude relation", 13815152), ("magnitude", 5097645))])
    rows = answers.filter(tx.is_quantity(F.col("text"))).withColumn("k", F.explode(kinds))
    whole = rows.select("qid", "text", F.col("k.t").alias("lat_text"), F.col("k.s").alias("synset"), F.lit(0.0).alias("specificity"), F.lit("QuantityCD").alias("lat_type"))
    if numbered is None:
        return whole
    beside = answers.filter(~tx.is_quantity(F.col("text"))).join(numbered.select("qid", "text").distinct(), ["qid", "text"], "left_semi").withColumn("k", F.explode(kinds))
    return whole.unionByName(beside.select("qid", "text", F.col("k.t").alias("lat_text"), F.col("k.s").alias("synset"), F.lit(0.0).alias("specificity"), F.lit("Quantity").alias("lat_type")))


def normalised_types(types: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Types with their last word in the singular; those of several words also as that word alone. "people" is person. lemmas: (form, lemma)."""
    words = F.split(F.lower("lat_text"), " ")
    rows = types.withColumn("_w", words).withColumn("_head", F.element_at("_w", -1))
    rows = rows.join(lemmas, rows["_head"] == lemmas["form"], "left").withColumn("_one", F.when(F.col("_head") == "people", "person").otherwise(F.coalesce("lemma", "_head")))
    many = F.array_join(F.concat(F.slice("_w", 1, F.size("_w") - 1), F.array("_one")), " ")
    return rows.withColumn("lat_text", F.explode(F.array_distinct(F.array(many, F.col("_one"))))).select(*types.columns).distinct()


def generalised(types: DataFrame, hypernyms: DataFrame, depth: int = 12, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Types with all their hypernyms, 1 less specific for each level, the best specificity for each; nothing goes beyond TOP_WORDS.

    hypernyms: (synset, up_synset, up_text). Synsets are walked once for all rows that have them.
    """
    tops = ", ".join(f"'{t}'" for t in TOP_WORDS)
    walked = stages.closure(hypernyms.select("synset", "up_synset", "up_text"), "synset", "up_synset", depth, passing=f"up_text NOT IN ({tops})")
    walked = walked.filter("synset <> 0").withColumnsRenamed({"synset": "start"})
    up = types.join(walked, types["synset"] == walked["start"])
    more = up.select(*keys, F.col("up_text").alias("lat_text"), F.col("up_synset").alias("synset"), (F.col("specificity") - F.col("level")).alias("specificity"), F.lit("Wordnet").alias("lat_type"), "base_lat_type")
    every = types.select(*keys, "lat_text", "synset", "specificity", "lat_type", "base_lat_type").unionByName(more)
    w = Window.partitionBy(*keys, "lat_text", "synset").orderBy(F.desc("specificity"), "lat_type")
    return every.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")


def matches(question_types: DataFrame, answer_types: DataFrame) -> DataFrame:
    """Pairs of equal types of a question and its answers, synsets equal where both are set; not two generalised ones of a general synset. The sum of specificities is the match's."""
    q = question_types.select("qid", "lat_text", F.col("synset").alias("q_synset"), F.col("specificity").alias("q_sp"), F.col("lat_type").alias("q_type"))
    a = answer_types.select("qid", "text", "lat_text", F.col("synset").alias("a_synset"), F.col("specificity").alias("a_sp"), F.col("lat_type").alias("a_type"), "base_lat_type")
    same = (F.col("q_synset") == 0) | (F.col("a_synset") == 0) | (F.col("q_synset") == F.col("a_synset"))
    general = (F.col("q_type") == "Wordnet") & (F.col("a_type") == "Wordnet") & F.col("a_synset").isin(list(GENERAL_SYNSETS))
    return q.join(a, ["qid", "lat_text"]).filter(same & ~general).withColumn("specificity", F.col("q_sp") + F.col("a_sp"))


def coercion_features(answers: DataFrame, question_types: DataFrame, answer_types: DataFrame) -> DataFrame:
    """spWordNet (e^ specificity of the best match) and the flags of sharp hits by side and by source, and of absent types."""
    m = matches(question_types, answer_types)
    q0, a0 = F.col("q_sp") == 0, F.col("a_sp") == 0
    sources = ("NE", "DBp", "DBpWN", "Quantity", "QuantityCD", "WnInstance", "DBpOntology", "DBpProperty", "FBOntology")
    hit = m.groupBy("qid", "text").agg(
        F.exp(F.max("specificity")).alias("spWordNet"), F.max(F.when(q0, 1.0)).alias("tyCorSpQHit"), F.max(F.when(a0, 1.0)).alias("tyCorSpAHit"), F.max(F.when(q0 & a0, 1.0)).alias("tyCorSpQAHit"),
        F.when(F.count_if(q0 | a0) == 0, 1.0).alias("tyCorSpNoHit"), F.when(F.count_if(q0 | a0) > 1, 1.0).alias("tyCorSpMultiHit"), *[F.max(F.when((q0 | a0) & (F.col("base_lat_type") == s), 1.0)).alias(f"tyCorA{s}") for s in sources],
    )
    own = answer_types.groupBy("qid", "text").agg(F.max((F.col("lat_type") == "Wordnet").cast("int")).alias("_a_wn"))
    asked = question_types.groupBy("qid").agg(F.max((F.col("lat_type") == "Wordnet").cast("int")).alias("_q_wn"))
    out = answers.select("qid", "text").distinct().join(hit, ["qid", "text"], "left").join(own, ["qid", "text"], "left").join(asked, "qid", "left")
    none, q_wn, a_wn, missed = F.col("_a_wn").isNull(), F.coalesce("_q_wn", F.lit(0)) == 1, F.coalesce("_a_wn", F.lit(0)) == 1, F.col("spWordNet").isNull()
    out = out.withColumn("LATANone", F.when(missed & none, -1.0)).withColumn("noTyCor", F.when(missed & ~none & q_wn & a_wn, -1.0))
    return out.withColumn("LATQNoWordNet", F.when(~q_wn, -1.0)).withColumn("LATANoWordNet", F.when(~none & ~a_wn, -1.0)).drop("_a_wn", "_q_wn")


def class_features(answers: DataFrame, classes: DataFrame) -> DataFrame:
    """Answers with a flag for their question's class."""
    out = answers.join(classes.select("qid", "class"), "qid", "left")
    return reduce(lambda d, c: d.withColumn(f"questionClass{c}", F.when(F.col("class") == c, 1.0)), ("ABBR", "DESC", "ENTY", "HUM", "LOC", "NUM"), out).drop("class")


def needs_parse(n_tokens: Column, n_pos: Column, text: Column) -> Column:
    """True for answers that have tokens but no parts of speech yet."""
    return (n_tokens > 0) & (n_pos == 0) & (F.length(text) > 0)
