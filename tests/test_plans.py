"""The joined-up plan and its parts on literal tables."""

import pytest
from pyspark.sql import functions as F

from sibyl.functions import stages
from sibyl.operators import answers as an
from sibyl.operators import candidates as cd
from sibyl.operators import graph as gr
from sibyl.operators import passages as ps
from sibyl.operators import questions as qs
from sibyl.operators import retrieval as rt
from sibyl.operators import training as tr
from sibyl.plans import answering, entry
from sibyl.sources import readers, sinks

DOCS = [
    (1, "Harbour notes", "The harbour bridge was built by Ann Miller. Bridges need care. Ann Miller also painted the harbour."),
    (2, "Garden notes", "Gardens grow. Bob Stone planted the garden beside the bridge."),
    (3, "Nothing", "Plain text of other things."),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, title string, text string")


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([("1", "Which engineer built the harbour bridge?"), ("2", "Who planted the garden?"), ("3", "of the")], "qid string, text string")


@pytest.fixture
def graph(spark):
    t = [("r1", "label", "harbour", False), ("r1", "builder", "r2", True), ("r2", "label", "Ann Miller", False), ("r2", "job", "engineer", False), ("r3", "label", "harbours", False)]
    triples = spark.createDataFrame([(*x, None) for x in t], "s string, p string, o string, o_is_uri boolean, lang string")
    labels = spark.createDataFrame([("harbour", "r1"), ("harbours", "r3")], "name string, entity string")
    return answering.Graph(triples, labels, spark.createDataFrame([("harbour", "r1", 9), ("harbour", "r3", 1)], "label string, entity string, n long"))


@pytest.fixture
def types(spark):
    q = spark.createDataFrame([("1", "Focus", "engineer", 5, 0.0)], "qid string, lat_type string, lat_text string, synset long, specificity double")
    instances = spark.createDataFrame([("Ann Miller", "bridge engineer", 6)], "name string, type string, synset long")
    ups = spark.createDataFrame([(6, 5, "engineer"), (5, 4, "worker")], "synset long, up_synset long, up_text string")
    return answering.Types(q, instances, ups, classes=spark.createDataFrame([("1", "HUM")], "qid string, class string"))


def test_plan_answers_from_texts(docs, asked):
    out = answering.answer(asked, docs).collect()
    best = {r.qid: r.text for r in out if r["rank"] == 1}
    assert best == {"1": "Ann Miller", "2": "Bob Stone"} and all(0 < r.confidence < 1 for r in out)


def test_plan_with_graph_and_types(docs, asked, graph, types):
    clues = answering.question_clues(asked)
    linked = answering.concepts(clues, graph).collect()
    assert {(r.qid, r.clue, r.entity) for r in linked} == {("1", "harbour", "r1"), ("1", "harbour", "r3")}
    values = answering.graph_answers(answering.concepts(clues, graph), graph, clues)
    assert {r.text for r in values.collect()} == {"Ann Miller", "harbour", "harbours"}
    full = answering.analysed(answering.hitlist([values]), clues, types)
    got = {r.text: r for r in full.collect()}
    assert got["Ann Miller"].spWordNet == pytest.approx(0.36787944) and got["Ann Miller"].questionClassHUM == 1 and got["harbour"].clOMatchScore == 1
    out = answering.answer(asked, docs, graph=graph, types=types)
    assert [r.text for r in out.filter("qid = '1' AND rank = 1").collect()] == ["Ann Miller"]
    dump = answering.question_dump(asked, graph=graph).filter("qid = '1'").first().json
    assert '"entity":"r1"' in dump and '"label":"harbour"' in dump


def test_evidence_only_for_the_best(spark, docs):
    rows = spark.createDataFrame([("1", f"Word{i}", 1.0 - i / 10) for i in range(7)] + [("1", "Ann Miller", 0.99)], "qid string, text string, confidence double")
    clues = spark.createDataFrame([("1", "Token", "harbour", 1.0, True)], "qid string, clue_type string, label string, weight double, reliable boolean")
    got = {r.text: r for r in answering.with_evidence(rows, clues, docs).collect()}
    assert sum(r.topAnswer == 1 for r in got.values()) == 5 and got["Ann Miller"].solrAHitsEv == 1 and got["Ann Miller"].solrHitsEv == 1
    assert got["Word6"].topAnswer is None and got["Word6"].solrAHitsEv is None and got["Word0"].solrAHitsEv == 0


def test_entry_points(spark, docs, tmp_path):
    lines = {r.qid: r.line for r in entry.run_lines(spark, ["Who planted the garden?", "of the"], docs).collect()}
    assert lines["0"].startswith("Bob Stone (") and lines["1"] == "No answer found."
    assert "1. Bob Stone (conf. " in entry.run_lines(spark, ["Who planted the garden?"], docs, machine=False).filter("rank = 1").first().line
    (tmp_path / "q.tsv").write_text("7\tfactoid\tWho planted the garden?\tStone\n8\tfactoid\tof the\tx\n")
    stats = entry.run_gold_tsv(spark, str(tmp_path / "q.tsv"), docs, str(tmp_path / "run")).first()
    assert (stats.n, stats.n_first) == (2, 1) and "Bob Stone" in "".join(p.read_text() for p in (tmp_path / "run").glob("part*"))
    own = spark.createDataFrame([("9", "of the", [("harbour", "5")], " bridge ")], "qid string, text string, concepts array<struct<title: string, page_id: string>>, artificial_clue string")
    assert {(r.label, r.clue_type) for r in qs.user_clues(own).collect()} == {("harbour", "Concept"), ("bridge", "Concept")}
    sinks.ask(own, str(tmp_path / "in"))
    entry.run_stream(spark, str(tmp_path / "in"), docs, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).filter("qid = '9' AND rank = 1").first().text == "Ann Miller"


def test_search_settings(spark, docs):
    terms = spark.createDataFrame([("q", "harbour", 2.0, True), ("q", "bridge", 1.0, True), ("q", "garden", 1.0, False)], "qid string, term string, weight double, required boolean")
    found = lambda **o: {r.doc_id for r in rt.search(terms, docs, rt.QuerySettings(**o), None).collect()}
    assert found() == {1} and found(all_required=False) == {1, 2} and found(proximity_only=True) == {1}
    assert found(fields=("title",)) == set() and found(fields=("title",), all_required=False) == {1, 2}
    title = ps.title_passages(terms.select("qid", F.col("term").alias("label"), "weight"), docs, 5).collect()
    assert {(r.doc_id, r.sentence) for r in title} == {(1, "The harbour bridge was built by Ann Miller"), (2, "Gardens grow")}


def test_passage_rules(spark):
    sents = spark.createDataFrame([("q", 1, "The film, a FILM of films.")], "qid string, k int, sentence string")
    clues = spark.createDataFrame([("q", "film", 1.0)], "qid string, label string, weight double")
    got = ps.clue_matches(sents, clues).collect()
    text = sents.first().sentence
    assert sorted((r.begin, text[r.begin : r.end].strip(" ,.").lower()) for r in got) == [(text.index("film"), "film"), (text.index("FILM"), "film"), (text.index("films"), "films")] or len(got) == 3
    tokens = spark.createDataFrame([("q", 0, 0, 3, "the", "the", "DT"), ("q", 1, 4, 11, "capital", "capital", "NN"), ("q", 2, 12, 14, "is", "be", "VBZ"), ("q", 3, 15, 20, "Paris", "Paris", "NNP")], "qid string, i int, begin int, end int, text string, lemma string, pos string")
    edges = spark.createDataFrame([("q", 3, 1, "nsubj")], "qid string, gov int, dep int, rel string")
    lats = spark.createDataFrame([("q", "capital", -1.0), ("q", "place", 0.0)], "qid string, text string, specificity double")
    phrases = spark.createDataFrame([("q", "NP", 15, 20, "Paris"), ("q", "NP", 15, 40, "Paris of old"), ("q", "VP", 12, 40, "is Paris")], "qid string, kind string, begin int, end int, text string")
    assert [r.text for r in cd.type_subjects(tokens, edges, lats, phrases, ["qid"]).collect()] == ["Paris of old"]
    assert ps.type_matches(tokens, lats, ["qid"]).collect() == [("q", 1, "capital", -1.0)]
    assert {(r.clue_type, r.label) for r in qs.token_clues(tokens, phrases.select("qid", "kind", "text")).collect()} == {("Token", "capital"), ("Token", "Paris"), ("Phrase", "Paris"), ("Phrase", "Paris of old")}
    answers = spark.createDataFrame([("q", "42"), ("q", "five miles"), ("q", "Paris")], "qid string, text string")
    numbered = answers.filter("text = 'five miles'")
    assert {(r.text, r.lat_type) for r in an.quantity_types(answers, numbered).collect()} == {("42", "QuantityCD"), ("five miles", "Quantity")}


def test_closures(spark):
    edges = spark.createDataFrame([(i, i + 1, f"n{i + 1}") for i in range(9)] + [(0, 3, "n3"), (9, 0, "n0")], "a int, b int, name string")
    got = {(r.a, r.b): r.level for r in stages.closure(edges, "a", "b", 4).collect()}
    assert got[0, 3] == 1 and got[0, 6] == 4 and (0, 7) not in got and got[8, 2] == 4
    stopped = {(r.a, r.b): r.level for r in stages.closure(edges, "a", "b", 4, passing="name <> 'n3'").collect()}
    assert stopped[0, 3] == 1 and (0, 4) not in stopped and stopped[3, 7] == 4
    assert stages.closure(edges.limit(0), "a", "b", 4).count() == 0


def test_short_labels_are_linked(spark):
    labels = spark.createDataFrame([("ab", "x"), ("abcd", "y"), ("zz", "z"), ("b", "w")], "name string, entity string")
    asked = spark.createDataFrame([(1, "AB"), (2, "b"), (3, "q"), (4, ""), (5, "abc"), (6, "abcde")], "qid int, label string")
    assert {(r.qid, r.entity, r.dist) for r in gr.fuzzy_hits(asked, labels).collect()} == {(1, "x", 0), (2, "w", 0), (5, "x", 1), (6, "y", 1)}


def test_paths_and_bindings(spark):
    t = spark.createDataFrame([("r", "p", f"v{i}", False, None) for i in range(9)], "s string, p string, o string, o_is_uri boolean, lang string")
    paths = spark.createDataFrame([("q", "r", "p", 0.5)], "qid string, resource string, path string, score double")
    none = spark.createDataFrame([], "qid string, w_resource string, w_label string")
    assert [r.value for r in gr.path_values(paths, t, none, "label", 3).orderBy("value").collect()] == ["v0", "v1", "v2"]
    gold = spark.createDataFrame([("q", "a"), ("q", "b"), ("z", "c")], "qid string, path string")
    said = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("z", "c", 1)], "qid string, path string, rank int")
    assert tr.path_measures(said, gold).first() == (1.0, 0.5, 0.75, pytest.approx(2 / 3))


def test_folds(spark):
    rows = spark.createDataFrame([(i, float(i % 3), i % 3) for i in range(60)], "id int, x double, class int")
    got = tr.cross_validated(rows, ["x"], "id", folds=3).collect()
    assert sum(r.n for r in got) == 60 and min(r.accuracy for r in got) > 0.9 and tr.cross_validated(rows.limit(0), ["x"], "id").count() == 0


def test_lexical_database(spark, tmp_path):
    (tmp_path / "data.noun").write_text("  1 licence line\n00000005 03 n 02 engineer 0 applied_scientist 0 002 @ 00000004 n 0000 ~ 00000006 n 0000 | a person\n00000004 03 n 01 worker 0 000 | one who works\n00000006 03 n 01 Ann_Miller 0 001 @i 00000005 n 0000 | built it\n")
    words, up = readers.wordnet(spark, str(tmp_path / "data.noun"))
    assert {tuple(r) for r in words.collect()} == {("engineer", "n", 5), ("applied scientist", "n", 5), ("worker", "n", 4), ("ann miller", "n", 6)}
    assert {tuple(r) for r in up.collect()} == {(5, 4, "worker", False), (6, 5, "engineer", True)}
