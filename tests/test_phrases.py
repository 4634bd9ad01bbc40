"""Noun phrases over letters of parts of speech, against spans that plain regular expressions find."""

import random
import re

from pyspark.sql import functions as F

from sibyl.operators import candidates as cd
from sibyl.plans import answering


def plain(tags):
    base = [(m.start(), m.end() - 1, 1) for m in re.finditer(r"D?[JC]*[NP]+", tags)]
    out, run = list(base), []
    for b in [*base, None]:
        if run and b and b[0] == run[-1][1] + 2 and tags[b[0] - 1] == "O":
            run.append(b)
            continue
        if len(run) > 1:
            out.append((run[0][0], run[-1][1], 2))
        run = [b] if b else []
    return sorted(out)


def test_spans_of_random_letters(spark):
    rng = random.Random(5)
    tags = ["", ".", "N", "NON", "DJ", "O" * 9] + ["".join(rng.choice("DJCNPOVI.") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in tags], "t string").select("t", cd.phrase_spans(F.col("t")).alias("x")).collect()
    assert all(sorted(map(tuple, r.x)) == plain(r.t) for r in got) and len(got) == 306


def test_phrases_of_sentences(spark):
    rows = spark.createDataFrame([(1, "The famous author of the second book lived in Berlin, and wrote."), (2, ""), (3, None), (4, "!!")], "qid int, sentence string")
    got = {(r.level, r.text) for r in cd.noun_phrases(rows, ["qid"]).collect()}
    assert got == {(1, "The famous author"), (1, "the second book"), (1, "Berlin"), (2, "The famous author of the second book"), (1, "wrote")}
    spans = F.array(*[F.struct(F.lit(a).alias("begin"), F.lit(b).alias("end"), F.lit(1).alias("level")) for a, b in [(0, 2), (0, 6), (4, 6), (4, 6)]])
    out = spark.range(1).select(*[cd.covering_phrase(spans, F.lit(i), w).alias(f"{w}{i}") for i in (1, 5, 9) for w in (True, False)]).first()
    assert [x and (x.begin, x.end) for x in out] == [(0, 6), (0, 2), (0, 6), (4, 6), None, None]


def test_the_plan_takes_phrases(spark):
    docs = spark.createDataFrame([(1, "Marie Curie discovered a new element called polonium. The bright metal of the old lab was heavy."), (2, "Nothing here matters.")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "Who discovered polonium?")], "qid long, text string")
    texts = {r.text for r in answering.answer(asked, docs, top=20, phrases=True).collect()}
    assert {"Marie Curie", "new element"} <= texts and "a new element" not in texts


def test_letters_by_form(spark):
    words = "The the apple Apple iPhone Über über ly only fully ed seed wed ing king sing singing ous joyous thing 12 1a , of Because between betweens able table capable ish dish boorish est test 東京 is it".split()
    got = spark.createDataFrame([(words,), ([],), (None,)], "w array<string>").select(cd.tag_letters(F.col("w")).alias("t")).collect()

    def plain(w):
        low = w.lower()
        if not w[0].isalnum() or w[0].isnumeric():
            return "C" if w[0].isnumeric() else "."
        for code, listed in cd.LETTERS.items():
            if low in listed:
                return code
        ends = ((r".{2}ly$", "R"), (r".{2}(?:ing|ed)$", "V"), (r".{2}(?:ful|ous|ive|ic|ical|able|ible|less|ish|est)$", "J"))
        return "P" if w[0].isupper() else next((c for p, c in ends if re.search(p, low)), "N")

    assert [r.t for r in got] == ["".join(map(plain, words)), "", None]


def test_words_are_not_copied_to_each_phrase(spark):
    """What makes rows of phrases gets the phrases, not the sentence's words beside them."""
    rows = spark.createDataFrame([(1, "The red fox saw a dog of the house.")], "qid int, sentence string")
    out = cd.noun_phrases(rows, ["qid"])
    made = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate " in x]
    assert made and all("_w" not in x for x in made) and out.count() == 4
