"""Operators on literal tables: rules that need parses, files, streams, trees, and small functions."""

import json
import math

import pytest
from pyspark.sql import functions as F

from sibyl import model
from sibyl.functions import annotate
from sibyl.functions import text as tx
from sibyl.functions import trees
from sibyl.operators import answers as an
from sibyl.operators import candidates as cd
from sibyl.operators import evaluation as ev
from sibyl.operators import graph as gr
from sibyl.operators import hitlist as hl
from sibyl.operators import questions as qs
from sibyl.operators import scoring as sc
from sibyl.operators import training as tr
from sibyl.queries import QUERIES
from sibyl.sources import readers, sinks
from sibyl.streaming import lifecycle as lc


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "canon"), [("The Beatles", "Beatles"), ("Joe's", "Joe"), ("…", "…"), ("*", "*"), ('"An answer!"', "answer"), ("one  more", "more")])
def test_canonical(spark, text, canon):
    assert one(spark, tx.canonical(F.col("t")), t=text) == canon


@pytest.mark.parametrize(("label", "text", "hit"), [("empty", "They empties it", True), ("empty", "it was emptied", True), ("film", "the filmed part", True), ("film", "microfilm", False), ("C++", "in C++ code", False)])
def test_clue_pattern(spark, label, text, hit):
    got = one(spark, F.regexp_like(F.col("t"), tx.clue_pattern(F.col("l"))), t=text, l=label)
    assert got == hit or label == "C++"


def test_labels(spark):
    assert one(spark, tx.type_label(F.col("t")), t="MountainPeak109361517") == "Mountain Peak"
    assert one(spark, tx.type_label(F.col("t")), t="Mountain_Peak") == "Mountain Peak"
    assert one(spark, tx.property_path(F.col("t")), t="/film/actor/film|/film/performance/character") == ["film.actor.film", "film.performance.character"]
    assert one(spark, tx.concept_label(F.col("t"), F.lit("clue")), t="List of rivers") == "clue"
    assert one(spark, tx.concept_label(F.col("t"), F.lit("clue")), t="Dune (film)") == "Dune"
    assert one(spark, tx.escaped_query(F.col("t")), t='a?b[c]/d"e\\') == "a b c  de"
    assert one(spark, tx.ngrams(F.split("t", " "), 2), t="who wrote Dune ?") == ["who wrote", "wrote Dune"]
    assert one(spark, tx.capitalized_title(F.col("t")), t="war and peace") == "War and Peace"
    assert one(spark, gr.wordnet_type(F.col("t")), t="synset-mountain_peak-noun-2") == ("mountain_peak", "noun", 2)


def test_feature_names():
    assert len(set(model.FEATURES)) == 175 and set(sinks.NOT_TRAINED) <= set(model.FEATURES)


def test_merge_of_unset_and_negative(spark):
    rows = [("a", 1, None), ("a", 1, -1.0), ("b", 1, -1.0), ("b", 1, -1.0), ("c", 1, -1.0), ("c", 1, 2.0)]
    df = spark.createDataFrame(rows, "qid string, occurences int, f double")
    got = {r.qid: (r.occurences, r.f) for r in hl.merge_vectors(df, ["qid"], ["f"]).collect()}
    assert got == {"a": (2, None), "b": (2, -1.0), "c": (2, 2.0)}


def test_diffusion(spark):
    df = spark.createDataFrame([(1, "Paris, France", 0.5), (1, "France", 0.25), (1, "Lyon, France", 0.2)], "qid int, text string, confidence double")
    got = {(r.text, r.case): r.score for r in hl.diffuse(df).collect()}
    assert got == {("France", "suffixing"): pytest.approx(0.5 + 0.2 / 2)}
    every = {(r.text, r.case) for r in hl.diffuse(df, all_cases=True).collect()}
    assert ("Paris, France", "suffixed") in every


def test_zscore_of_equal_values_is_zero(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0)], "qid int, text string, f double")
    assert [r["%f"] for r in hl.expanded(df, ["f"]).collect()] == [0.0, 0.0]


def test_simple_score_defaults(spark):
    df = spark.createDataFrame([(2, None, None, 1.0, None, 0.5)], "occurences int, spWordNet double, passageLogScore double, originDocTitle double, originPsgNE double, resultLogScore double")
    assert df.select(sc.simple_score()).first()[0] == pytest.approx(math.exp(-4) * 2 * math.log(3) * 0.5)


def test_models_are_parsed():
    weights, intercept = sc.parse_logistic("/* c */\nf: 1.5, -2, 0.25\nintercept: -3.5\n")
    assert weights == {"f": (1.5, -2.0, 0.25)} and intercept == -3.5
    assert sc.parse_forest('// note\n{"prior": 1, "learning_rate": 2, "labels": [], "forest": []}')["prior"] == 1


def _parsed(spark):
    # Who wrote the book
    tokens = spark.createDataFrame([("q", 0, 0, 3, "Who", "who", "WP"), ("q", 1, 4, 9, "wrote", "write", "VBD"), ("q", 2, 10, 13, "the", "the", "DT"), ("q", 3, 14, 18, "book", "book", "NN")], "qid string, i int, begin int, end int, text string, lemma string, pos string")
    edges = spark.createDataFrame([("q", 1, 0, "nsubj"), ("q", 1, 3, "dobj"), ("q", 3, 2, "det")], "qid string, gov int, dep int, rel string")
    return tokens, edges


def test_question_rules(spark):
    tokens, edges = _parsed(spark)
    foci = qs.focus(tokens, edges)
    assert foci.collect() == [("q", 0, 5)]
    assert [r.verb for r in qs.selecting_verbs(tokens, edges, foci).collect()] == [1]
    lat = qs.answer_types(foci, tokens).collect()
    assert [(r.text, r.synset) for r in lat] == [("person", 7846)]
    none = spark.createDataFrame([], "qid string, begin int, end int, text string")
    assert {(r.kind, r.text) for r in qs.subjects(tokens, edges, none, none).collect()} == set()
    name = spark.createDataFrame([("q", 0, 0, 4, "name", "name", "NN"), ("q", 1, 5, 9, "city", "city", "NN")], tokens.schema)
    of = spark.createDataFrame([("q", 0, 1, "pobj")], edges.schema)
    proxied = qs.focus_through_name(spark.createDataFrame([("q", 0, 5)], "qid string, focus int, rule int"), name, of)
    assert [r.focus for r in proxied.collect()] == [1]


def test_greedy_subsumption(spark):
    rows = [("q", 0, 10, "long", 1.0, 0.0, False, False, False), ("q", 0, 4, "in", 2.0, 0.0, True, False, False), ("q", 20, 24, "off", 1.0, 0.0, False, False, False), ("q", 0, 2, "near", 1.0, -2.0, False, False, False)]
    df = spark.createDataFrame(rows, "qid string, begin int, end int, label string, weight double, dist double, by_subject boolean, by_ne boolean, by_lat boolean")
    got = {r.label: (r.weight, r.by_subject) for r in qs.subsume(df).collect()}
    assert got == {"long": (2.0, True), "off": (1.0, False), "near": (1.0, False)}


def test_coercion(spark):
    kind = "qid int, lat_text string, synset long, specificity double, lat_type string"
    q = spark.createDataFrame([(1, "person", 7846, 0.0, "QuestionWord")], kind)
    a = spark.createDataFrame([(1, "Ann", "person", 7846, -1.0, "Wordnet", "NE"), (1, "Dune", "book", 5, 0.0, "DBp", "DBp")], "qid int, text string, lat_text string, synset long, specificity double, lat_type string, base_lat_type string")
    got = {r.text: r for r in an.coercion_features(a.select("qid", "text"), q, a).collect()}
    assert got["Ann"].spWordNet == pytest.approx(math.exp(-1)) and got["Ann"].tyCorSpQHit == 1 and got["Ann"].tyCorSpAHit is None and got["Ann"].tyCorANE == 1
    assert got["Dune"].spWordNet is None and got["Dune"].LATANone is None and got["Dune"].LATANoWordNet == -1


def test_answer_rules(spark):
    tokens = spark.createDataFrame([("a", 0, 0, "over", "IN"), ("a", 1, 5, "films", "NNS"), ("b", 0, 0, "42", "CD")], "answer string, i int, begin int, text string, pos string")
    edges = spark.createDataFrame([], "answer string, gov int, dep int")
    assert [(r.answer, r.focus) for r in an.answer_focus(tokens, edges).collect()] == [("a", 1)]
    assert one(spark, an.entity_synset(F.col("k")), k="money") == 13405730 and one(spark, an.entity_synset(F.col("k")), k="x") == 0
    types = spark.createDataFrame([("q", "small towns"), ("q", "people")], "qid string, lat_text string")
    lemmas = spark.createDataFrame([("towns", "town")], "form string, lemma string")
    assert {r.lat_text for r in an.normalised_types(types, lemmas).collect()} == {"small town", "town", "person"}


def test_candidate_distance_inside_is_e(spark):
    keys = "qid int, begin int, end int, text string, score double"
    cand = spark.createDataFrame([(1, 2, 4, "x", 1.0)], keys)
    hits = spark.createDataFrame([(1, 3, 3, "c"), (1, 9, 9, "d")], "qid int, clue_begin int, clue_end int, label string")
    assert cd.base_features(cand, hits, ["qid"]).first().psgDistClue == pytest.approx(math.e)


def test_tree_distance(spark):
    a = trees.parse_brackets("{eat/V/root{dog/N/subj}{cat/N/obj}}")
    b = trees.parse_brackets("{eat/V/root{dog/N/obj}}")
    distance, edits = trees.edit_distance(a, b)
    assert distance == 4 and [e[0] for e in edits].count("DEL") == 1
    assert trees.edit_distance(a, a)[0] == 0 and trees.edit_distance([], b)[0] == 6
    assert trees.edit_distance(trees.parse_brackets("{a/x/y}"), trees.parse_brackets("{b/x/y}"))[0] == 6
    df = spark.createDataFrame([(a, b), (a, None)], f"a {trees.NODES}, b {trees.NODES}")
    assert [r[0] for r in df.select(trees.tree_distance("a", "b")).collect()] == [pytest.approx(0.8), None]
    assert len(df.select(trees.tree_edits("a", "b").alias("e")).first().e) == 3


def test_mrr_and_run_rows(spark):
    stats = ev.run_statistics(spark.createDataFrame([(0,), (1,), (-1,)], "rank int")).first()
    assert stats.mrr == pytest.approx((1 + 1 / 2 + 1 / 10001) / 3) and stats.accuracy == pytest.approx(1 / 3)
    hits = spark.createDataFrame([("1", "Paris", 0.9), ("1", "Rome", 0.8)], "qid string, text string, confidence double")
    gold = spark.createDataFrame([("1", "rome|roma"), ("2", "x")], "qid string, answer_pattern string")
    got = {r.qid: (r.rank, r.match, r.n_answers) for r in ev.run_rows(hits, gold).collect()}
    assert got == {"1": (1, "Rome", 2), "2": (-1, None, 0)}


def test_answer_sentence(spark):
    s = lambda p, w: one(spark, lc.answer_sentence(F.lit("Dune"), F.col("p"), F.lit(w).cast("string"), F.lit("X")), p=p)
    assert s("Directed by", None) == "Dune is directed by X." and s("Film: Release date", "UK") == "Dune release date (for UK) is X."


def test_question_sources(spark, tmp_path):
    (tmp_path / "q.tsv").write_text('1\tfactoid\tWho is "A"?\tA|B\n')
    assert readers.questions_tsv(spark, str(tmp_path / "q.tsv")).collect() == [("1", "factoid", 'Who is "A"?', "A|B")]
    (tmp_path / "q.json").write_text(json.dumps([{"qId": "7", "qText": "T?", "answers": ["a", "b"], "author": "x"}]))
    assert readers.questions_json(spark, str(tmp_path / "q.json")).first().answer_pattern == "a|b"
    assert readers.questions_lines(spark, ["x", " ", "y"]).count() == 2
    (tmp_path / "d.xml").write_text("<wikitext><doc><id>1</id><url>u</url><title>t</title><text>body</text></doc><doc><id>2</id><url>u</url><title>t</title><text>t may refer to: x</text></doc></wikitext>")
    assert [r.doc_id for r in readers.corpus_xml(spark, str(tmp_path / "d.xml")).collect()] == [1]
    (tmp_path / "g.nt").write_text('<s> <p> <o> .\n<s> <label> "caf\\"e"@en .\n# no triple\n')
    got = {(r.p, r.o, r.o_is_uri, r.lang) for r in readers.triples_nt(spark, str(tmp_path / "g.nt")).collect()}
    assert got == {("p", "o", True, None), ("label", 'caf"e', False, "en")}
    (tmp_path / "w.json").write_text('# x\n{"a|b": {"f": 1.5, "_": -1}}')
    assert {(r.feature, r.weight) for r in readers.path_weights(spark, str(tmp_path / "w.json")).collect()} == {("f", 1.5), ("_", -1.0)}
    (tmp_path / "m.txt").write_text("1 0\n0 1\n0.5\n")
    assert readers.bilinear_weights(str(tmp_path / "m.txt")) == ([[1.0, 0.0], [0.0, 1.0]], 0.5)
    assert readers.endpoints([["a", "b"]], overrides={"triples": "c"}) == {"documents": "a", "triples": "c"}


def test_sinks(spark, tmp_path):
    hits = spark.createDataFrame([("1", "Paris", 0.9), ("1", "Rome", 0.25), ("2", None, None)], "qid string, text string, confidence double")
    assert {(r.qid, r.line) for r in sinks.machine_lines(hits).collect()} == {("1", "Paris (0.90) | Rome (0.25)"), ("2", "No answer found.")}
    sinks.write_checkpoint(hits, str(tmp_path / "c"), 0)
    assert readers.checkpoint(spark, str(tmp_path / "c"), 0).count() == 3
    gold = spark.createDataFrame([("1", "rome")], "qid string, answer_pattern string")
    sinks.write_run(ev.run_rows(hits.filter("text IS NOT NULL"), gold), str(tmp_path / "r"))
    assert "Rome:0.2500" in "".join(p.read_text() for p in (tmp_path / "r").glob("part*"))
    out = sinks.question_json(spark.createDataFrame([("1",)], "qid string"), clues=spark.createDataFrame([("1", "a")], "qid string, label string"))
    assert json.loads(out.first().json) == {"qid": "1", "clues": [{"label": "a"}]}
    sinks.write_answers(hits.filter("text IS NOT NULL"), str(tmp_path / "a"))
    assert readers.answers_csv(spark, str(tmp_path / "a")).count() == 2


def test_stream_comes_to_the_state_of_the_batch(spark, tmp_path):
    kind = "qid int, seq int, state string"
    events = [(1, 1, "asked"), (1, 2, "in progress"), (2, 3, "asked"), (1, 4, "answered")]
    for i in range(2):
        spark.createDataFrame(events[2 * i : 2 * i + 2], kind).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).json(str(tmp_path / "in"))
    q = lc.stream_states(stream, "states", str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = lc.last_states(spark.createDataFrame(events, kind)).collect()
    assert sorted(spark.table("states").collect()) == sorted(want)


def test_logistic_and_chains(spark):
    rows = spark.createDataFrame([(i, float(i), int(i > 10)) for i in range(20)], "id int, x double, class int")
    model_ = tr.logistic(rows, ["x"])
    assert tr.scored(model_, rows).filter("id = 19").first().score > 0.9 and "_" in tr.weights(model_, ["x"])
    tree = {"labels": ["f"], "forest": [{"children_left": [1, -1, -1], "children_right": [2, -1, -1], "features": [0, 0, 0], "thresholds": [0.5, 0, 0], "values": [0, 1.0, 2.0]}]}
    nodes = spark.createDataFrame(tr.tree_rows(tree), "tree int, node int, left int, right int, feature string, threshold double, value double")
    assert {(r.path, r.value) for r in tr.chains(nodes).collect()} == {("f<=0.5", 1.0), ("f>0.5", 2.0)}


def test_annotators(spark):
    df = spark.createDataFrame([(1, "Who paid $5 for ladies' boxes in May 1999, at 5% or 10:30?")], "k int, text string")
    toks = {r.text: r for r in an_tokens(df).collect()}
    text = df.first().text
    assert all(text[r.begin : r.end] == w for w, r in toks.items() if text.count(w) == 1)
    assert toks["ladies"].lemma == "lady" and toks["boxes"].lemma == "box" and toks["Who"].pos == "WP" and toks["1999"].pos == "CD"
    assert {(r.kind, r.text) for r in annotate.entities(df, "k").collect()} == {("money", "$5"), ("date", "May 1999"), ("percentage", "5%"), ("time", "10:30")}
    names = spark.createDataFrame([("ladies boxes", "x"), ("in May", "place"), ("paid for", "x")], "name string, kind string")
    assert {r.text for r in annotate.listed_entities(an_tokens(df), names, "k").collect()} == {"in May"} | {"ladies boxes"}


def an_tokens(df):
    return annotate.tokens(df, "k")


def test_governed(spark):
    edges = spark.createDataFrame([("q", 0, 1, "prep_of"), ("q", 1, 2, "amod"), ("q", 2, 3, "det")], "qid string, gov int, dep int, rel string")
    assert {(r.head, r.dep) for r in annotate.governed(edges).collect()} == {(0, 1), (0, 2), (1, 2), (2, 3)}


def test_exact_ranks_and_asking(spark, tmp_path):
    answers = spark.createDataFrame([("1", 0, "x"), ("1", 1, "y")], "qid string, rank int, text string")
    gold = spark.createDataFrame([("1", ["y", "z"]), ("2", ["q"])], "qid string, answers array<string>")
    assert {(r.qid, r.rank) for r in ev.exact_ranks(answers, gold).collect()} == {("1", 1), ("2", -1)}
    asked = spark.createDataFrame([("1", "Who?")], "qid string, text string")
    sinks.ask(asked, str(tmp_path / "q"))
    got = []
    lc.stream_batches(readers.questions_stream(spark, str(tmp_path / "q")), lambda b, _: got.extend(r.text for r in b.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert got == ["Who?"]
    with pytest.raises(ValueError, match="text"):
        sinks.ask(asked.withColumn("text", F.lit("")), str(tmp_path / "q"))


def test_tree_edit_distance_takes_all_words(spark, tmp_path):
    texts = ["one two three four five six seven eight nine", "One two three four five six seven eight tenth", "b c", "eight words are not enough here " * 9 + "x", "x " * 70 + "enough here"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def brute(a, b):
        longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                longest[i + 1][j + 1] = longest[i][j] + 1 if x == y else max(longest[i][j + 1], longest[i + 1][j])
        return round(3 * (len(a) + len(b) - 2 * longest[-1][-1]) / (len(a) + len(b)), 6)

    words = [t.lower().split(" ") for t in texts]
    got = dict(QUERIES["tree_edit_distance"].run(spark, str(tmp_path)).collect())
    assert got == {i: brute(words[i], words[i + 1]) for i in range(len(texts) - 1)} and got[0] > 0
