"""The question-answering plan: from questions and documents, and a graph where there is one, to ranked answers, all questions at once.

    questions -> clues -> concepts
    clues -> best documents -> best passages of each -> name candidates; titles of the best documents
    concepts -> properties of their resources
    all candidates -> one hitlist by text -> overlap with clues, answer types and coercion, question classes -> phase 0 score
    -> the best by canonical text, diffusion -> phase 1 score -> evidence for the best -> phase 2 score -> top answers

Every step is keyed by the question. Passages are chosen row by row: a document that was found for a question meets the question's few clues
as one array, so its sentences are split once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stages
from ..functions import text as tx
from ..operators import answers as an
from ..operators import candidates as cd
from ..operators import graph as gr
from ..operators import hitlist as hl
from ..operators import questions as qs
from ..operators import retrieval as rt
from ..operators import scoring as sc
from ..operators.index import PostingIndex

#: Documents that a question searches, passages of each, answers that phases 1 and 2 keep, and answers for which evidence is gathered.
DOCUMENTS, PASSAGES, FIRST, SECOND, EVIDENCE = 20, 3, 100, 25, 5
#: Features that each step may set; what a producer does not set is null.
PRODUCED = ("passageLogScore", "resultRR", "resultLogScore", "propertyScore", "originPsg", "originPsgSurprise", "originPsgNP", "originDocTitle", "originDBpOntology", "originConcept", "originConceptScore")
ORIGINS = ("originPsg", "originDocTitle", "originDBpOntology")
#: Weights of the three phases' logistics where no model is given, as (@, %, !) of each feature.
WEIGHTS: dict[str, dict[str, tuple[float, float, float]]] = {
    "": {"passageLogScore": (0.3, 0.6, 0.0), "originPsgSurprise": (0.8, 0.2, 0.0), "resultRR": (0.5, 0.3, 0.0), "propertyScore": (0.8, 0.2, 0.0), "spWordNet": (1.0, 0.2, 0.0)},
    "1": {"phase0Score": (2.0, 0.5, 0.0), "evdPrefixedScore": (0.4, 0.2, 0.0), "evdSubstredScore": (0.4, 0.2, 0.0)},
    "2": {"phase1Score": (2.0, 0.5, 0.0), "solrHitsANormEv": (0.5, 0.2, 0.0)},
}


@dataclass(frozen=True)
class Graph:
    """triples (s, p, o, o_is_uri, lang); labels (name, entity); cross (label, entity, n); the namespace of properties and the predicate of labels."""

    triples: DataFrame
    labels: DataFrame
    cross: DataFrame
    namespace: str = ""
    label: str = "label"


@dataclass(frozen=True)
class Types:
    """What types of answers come from: instances (name, type, synset), other (name, type), hypernyms (synset, up_synset, up_text); types of questions as operators.questions makes them, and their classes (qid, class)."""

    questions: DataFrame
    instances: DataFrame
    hypernyms: DataFrame
    other: DataFrame | None = None
    classes: DataFrame | None = None


@dataclass(frozen=True)
class Models:
    """For each phase ("", "1", "2") the features that are expanded, and an expression over them; by default the logistics of WEIGHTS."""

    features: Mapping[str, Sequence[str]] = field(default_factory=lambda: {p: list(w) for p, w in WEIGHTS.items()})
    score: Mapping[str, Callable[[], Column]] = field(default_factory=lambda: {p: (lambda w=w: sc.logistic_score(w, -1.0)) for p, w in WEIGHTS.items()})


def question_clues(questions: DataFrame, least: int = 1) -> DataFrame:
    """Single-word clues of questions (qid, text): words that are no stop words, of `least` letters or more (1: all); longer words weigh more."""
    words = questions.select("qid", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("text"))
    kept = words.filter((F.length("text") >= least) & ~tx.is_stop_word(F.col("text")))
    return kept.select("qid", F.lit("Token").alias("clue_type"), F.col("text").alias("label"), F.length("text").cast("double").alias("weight"), F.lit(qs.CLUE_KINDS["Token"][1]).alias("reliable"))


def with_titles(docs: DataFrame) -> DataFrame:
    """docs with a title: their own, else the first five words."""
    return docs if "title" in docs.columns else docs.withColumn("title", F.array_join(F.slice(F.split("text", " ", 6), 1, 5), " "))


def found_documents(clues: DataFrame, docs: DataFrame | PostingIndex, n: int = DOCUMENTS) -> DataFrame:
    """The n best documents for each question's clues: qid, doc_id, score, rank."""
    asked = clues.select("qid", F.col("label").alias("term"), "weight", F.lit(False).alias("required"))
    return rt.ranked_search(asked, docs, n).select("qid", "doc_id", "score", "rank")


def best_passages(found: DataFrame, docs: DataFrame, clues: DataFrame, k: int = PASSAGES) -> DataFrame:
    """(qid, doc_id, doc_rank, sent, sentence, score, rank): the k best sentences of each document that was found; ties: the earlier one.

    A sentence counts the weights of the clues that it holds, those that the document's title holds at a quarter.
    """
    own = clues.groupBy("qid").agg(F.array_sort(F.collect_set(F.struct("label", "weight"))).alias("_clues"))  # a question's few clues
    held = found.select("qid", "doc_id", F.col("rank").alias("doc_rank")).join(with_titles(docs).select("doc_id", "title", "text"), "doc_id").join(own, "qid")
    # words are cut once for each text: inside a function of the clues, which binds them to a variable, they are not cut again for each clue
    once = lambda text, fn: F.transform(F.array(tx.tokens(F.col(text))), fn)[0]
    about = once("title", lambda t: F.transform("_clues", lambda c: F.struct(c["label"].alias("label"), F.when(F.array_contains(t, c["label"]), c["weight"] / 4).otherwise(c["weight"]).alias("weight"))))
    # hits and their sum are worked out once for a sentence, inside the array: as columns, a filter on them and what reads them would each work them out
    hits = lambda s: F.filter("_clues", lambda c: F.array_contains(s, c["label"]))
    summed = lambda h: F.struct(F.size(h).alias("n"), F.aggregate(h, F.lit(0.0), lambda a, c: a + c["weight"]).alias("score"))
    point = lambda s: F.transform(F.transform(F.array(tx.tokens(s)), hits), summed)[0]
    every = F.transform(tx.sentences(F.col("text")), lambda s, i: F.struct(i.alias("sent"), s.alias("sentence"), point(s).alias("x")))
    held = held.withColumn("_clues", about).select("qid", "doc_id", "doc_rank", F.inline(F.filter(every, lambda e: e["x"]["n"] > 0)))
    scored = held.select("qid", "doc_id", "doc_rank", "sent", "sentence", F.col("x.score").alias("score"))
    return hl.ranked(scored, ("qid", "doc_id"), [F.desc("score"), "sent"]).filter(F.col("rank") <= k)


def passage_answers(best: DataFrame, clues: DataFrame) -> DataFrame:
    """Name candidates in passages (best_passages), stop words and single characters left out."""
    runs = cd.capitalised_runs(best, ["qid", "doc_id", "sent", "score", "doc_rank"])
    named = cd.with_surprise(runs, clues).filter(~cd.blacklisted(F.col("text")))
    return named.select("qid", "text", F.lit(1).alias("occurences"), F.log1p("score").alias("passageLogScore"), (1 / F.col("doc_rank")).alias("resultRR"), F.lit(1.0).alias("originPsg"), F.when(F.col("surprise"), 1.0).alias("originPsgSurprise"))


def phrase_answers(best: DataFrame, clues: DataFrame) -> DataFrame:
    """Noun phrases in passages (best_passages), leading determiners cut, stop words and single characters left out."""
    phrases = cd.noun_phrases(best, ["qid", "doc_id", "sent", "score", "doc_rank"])
    bare = F.regexp_replace("text", rf"(?i)^(?:{'|'.join(cd.LETTERS['D'])}) (?=.)", "")
    named = cd.with_surprise(phrases.withColumn("text", bare), clues).filter(~cd.blacklisted(F.col("text")))
    return named.select("qid", "text", F.lit(1).alias("occurences"), F.log1p("score").alias("passageLogScore"), (1 / F.col("doc_rank")).alias("resultRR"), F.lit(1.0).alias("originPsg"), F.lit(1.0).alias("originPsgNP"), F.when(F.col("surprise"), 1.0).alias("originPsgSurprise"))


def title_answers(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Titles of the documents that were found."""
    rows = rt.title_answers(found, with_titles(docs)).filter("text <> ''")
    return rows.select("qid", "text", F.lit(1).alias("occurences"), "resultRR", "resultLogScore", "originDocTitle")


def concepts(clues: DataFrame, graph: Graph, score: Column | None = None) -> DataFrame:
    """Concepts that clues name, with their ranks: qid, clue, label, entity, score, source_rr, label_rr."""
    score = sc.sigmoid(F.col("label_probability") * 4 + F.col("log_popularity") / 2 - F.col("edit_dist") - 3) if score is None else score
    linked = gr.linked_concepts(clues.filter(qs.linkable(F.col("label"))), graph.labels, graph.cross, gr.popularity(graph.triples), score)
    return qs.concept_ranks(linked.select("qid", F.col("label").alias("clue"), "label", "entity", "score"))


def graph_answers(linked: DataFrame, graph: Graph, clues: DataFrame) -> DataFrame:
    """Property values of the concepts' resources."""
    own = linked.groupBy("qid", F.col("entity").alias("resource")).agg(F.max("score").alias("score"))
    values = gr.properties(own, graph.triples, graph.namespace, graph.label)
    marked = gr.clues_in_property(values, clues, "originDBpONoClue")
    rows = gr.property_answers(marked.withColumn("score", F.col("score") * F.when(F.col("n_clues") > 0, 2.0).otherwise(1.0)), "originDBpOntology")
    return rows.select("qid", "text", "occurences", "resultLogScore", "propertyScore", "originDBpOntology")


def hitlist(produced: Sequence[DataFrame]) -> DataFrame:
    """Answers of all producers as one hitlist, merged by text."""
    rows = [p.select("qid", "text", F.col("occurences").cast("int").alias("occurences"), *[(F.col(f) if f in p.columns else F.lit(None)).cast("double").alias(f) for f in PRODUCED]) for p in produced]
    return hl.merge_hitlist(reduce(DataFrame.unionByName, rows), PRODUCED, ORIGINS)


def analysed(rows: DataFrame, clues: DataFrame, types: Types | None = None) -> DataFrame:
    """Answers with what their analysis adds: overlap with the clues; types, their hypernyms and coercion against the question's; the question's class."""
    out = rows.join(an.clue_overlap(rows, clues), ["qid", "text"], "left")
    if types is None:
        return out.withColumn("spWordNet", F.lit(None).cast("double"))
    forms = rows.select("qid", "text", F.lit(None).cast("string").alias("focus"))
    known = an.instance_types(forms, types.instances)
    if types.other is not None:
        known = known.unionByName(an.fallback_types(known, forms, types.other, "DBpType"))
    known = known.unionByName(an.quantity_types(forms)).withColumn("base_lat_type", F.col("lat_type"))
    up = an.generalised(known, types.hypernyms, keys=("qid", "text"))
    asked = an.generalised(types.questions.withColumn("base_lat_type", F.col("lat_type")), types.hypernyms)
    out = out.join(an.coercion_features(forms, asked, up), ["qid", "text"], "left")
    return an.class_features(out, types.classes) if types.classes is not None else out


def with_evidence(rows: DataFrame, clues: DataFrame, docs: DataFrame | PostingIndex, n: int = EVIDENCE) -> DataFrame:
    """rows with topAnswer, and for the n best of each question the counts of documents with them; others have none."""
    marked = hl.ranked(rows, column="_rank").withColumn("topAnswer", F.when(F.col("_rank") <= n, 1.0)).drop("_rank")
    top = marked.filter("topAnswer = 1").select("qid", F.col("text").alias("_answer"), F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("text"))
    asked = clues.select("qid", F.col("label").alias("term"), "weight", F.lit(False).alias("required"))
    found = rt.evidence(top.select("qid", "text").distinct(), docs, asked).join(top, ["qid", "text"])
    # an answer of several words counts by its rarest
    rarest = found.groupBy("qid", F.col("_answer").alias("text")).agg(F.min(F.struct("solrAHitsEv", "solrHitsEv", "solrMaxScoreEv", "solrHitsANormEv", "solrHitsMaxScoreEv")).alias("_e"))
    return marked.join(rarest, ["qid", "text"], "left").select(*marked.columns, "_e.*")


def scored(rows: DataFrame, phase: str, models: Models) -> DataFrame:
    """rows with the phase's model score as confidence, carried on as a feature."""
    missing = [f for f in models.features[phase] if f not in rows.columns]
    full = rows.withColumns({f: F.lit(None).cast("double") for f in missing})
    out = hl.expanded(full, list(models.features[phase])).withColumn("confidence", F.round(models.score[phase](), 6))
    return sc.carry_over(out.select(*[c for c in full.columns if c != "confidence"], "confidence"), phase)


def asked_clues(questions: DataFrame, clues: DataFrame | None = None) -> DataFrame:
    """The given clues, else the questions' words, with those that whoever asks adds; written, as many steps read them."""
    clues = question_clues(questions) if clues is None else clues
    if "artificial_clue" in questions.columns:
        clues = clues.unionByName(qs.user_clues(questions).withColumn("label", F.lower("label")))
    return stages.staged(clues, "clues")


def found_answers(clues: DataFrame, docs: DataFrame, graph: Graph | None = None, types: Types | None = None, index: PostingIndex | None = None, phrases: bool = False) -> DataFrame:
    """What phase 0 scores: answers of all producers with their analysis."""
    found = stages.staged(found_documents(clues, docs if index is None else index), "found")
    best = best_passages(found, docs, clues)
    produced = [phrase_answers(best, clues) if phrases else passage_answers(best, clues), title_answers(found, docs)]
    if graph is not None:
        produced.append(graph_answers(concepts(clues, graph), graph, clues))
    return analysed(stages.staged(hitlist(produced), "hitlist"), clues, types)


def merged_answers(zero: DataFrame) -> DataFrame:
    """What phase 1 scores: the best answers of phase 0 (written, as they are read more than once) by canonical text, with what they lend each other."""
    kept = [c for c in zero.columns if c not in ("qid", "text", "occurences", "confidence")]
    one = stages.staged(hl.merge_by_canonical_text(zero, tx.canonical(F.col("text")), kept).drop("canon_text"), "merged")
    by_case = hl.diffuse(one.select("qid", "text", "confidence")).groupBy("qid", "text").pivot("case", list(hl.CASES)).agg(F.first("score"))
    return one.join(by_case.withColumnsRenamed({c: f"evd{c.capitalize()}Score" for c in hl.CASES}), ["qid", "text"], "left")


def answer(questions: DataFrame, docs: DataFrame, top: int = 5, graph: Graph | None = None, types: Types | None = None, models: Models = Models(), clues: DataFrame | None = None, index: PostingIndex | None = None, phrases: bool = False) -> DataFrame:
    """qid, rank, text, confidence: the `top` answers of each question by three phases. clues: better ones than the question's words, where a parser is at hand. index: a kept one of docs, which all searches then read.
    phrases: passages give their noun phrases as candidates, not only runs of capitalised words."""
    clues = asked_clues(questions, clues)
    # each phase is written: later steps read it more than once
    zero = stages.staged(hl.top_k(scored(found_answers(clues, docs, graph, types, index, phrases), "", models), FIRST), "phase-0")
    one = stages.staged(hl.top_k(scored(merged_answers(zero), "1", models), SECOND), "phase-1")
    last = scored(with_evidence(one, clues, docs if index is None else index), "2", models)
    return hl.ranked(last.select("qid", "text", "confidence")).filter(F.col("rank") <= top).select("qid", "rank", "text", "confidence")


def question_dump(questions: DataFrame, clues: DataFrame | None = None, lats: DataFrame | None = None, graph: Graph | None = None) -> DataFrame:
    """What is known of questions before any search, one JSON line each: qid, json of clues, answer types and concepts."""
    from ..sources import sinks

    clues = question_clues(questions) if clues is None else clues
    parts = {"clues": clues.select("qid", "label", "weight")}
    if lats is not None:
        parts["lats"] = lats.select("qid", "text", "specificity")
    if graph is not None:
        parts["concepts"] = concepts(clues, graph).select("qid", "entity", "score")
    return sinks.question_json(questions.select("qid"), **parts)
