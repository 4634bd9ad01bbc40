"""Graph retrieval: joins over one table of triples (s, p, o, o_is_uri, lang)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stages
from ..functions import text as tx
from .scoring import sigmoid

# Properties that flood results and are left out of generic look-ups.
FLOODING_PROPERTIES = (
    "award.award.category location.location.contains book.book.editions olympics.olympic_games.events chemistry.chemical_element.isotopes "
    "military.military_conflict.military_personnel_involved government.government_office_category.offices book.author.works_written "
    "tv.tv_program.episodes music.genre.artists organization.organization_sector.organizations_in_this_sector "
    "people.profession.people_with_this_profession people.person.profession music.composition.recordings book.book_subject.works "
    "music.artist.track location.location.people_born_here astronomy.orbital_relationship.orbited_by olympics.olympic_games.competitions "
    "people.cause_of_death.people location.citytown.postal_codes location.location.time_zones media_common.netflix_genre.titles "
    "tv.tv_genre.programs music.genre.albums fictional_universe.character_occupation.characters_with_this_occupation "
    "organization.organization_scope.organizations_with_this_scope music.composer.compositions film.film_subject.films "
    "travel.travel_destination.tourist_attractions music.artist.album location.location.events music.compositional_form.compositions "
    "cvg.cvg_genre.games film.film_location.featured_in_films time.event.includes_event periodicals.newspaper_circulation_area.newspapers "
    "location.location.partially_contains symbols.name_source.namesakes meteorology.cyclone_affected_area.cyclones "
    "fictional_universe.fictional_setting.fictional_characters_born_here film.film_genre.films_in_this_genre business.industry.companies "
    "military.military_unit_place_of_origin.military_units sports.sports_team_location.teams"
).split()

#: Limits of a look-up: topics of a title, properties of a topic, paths of a question, values of all its paths.
TOPIC_LIMIT, PROPERTY_LIMIT, PATH_LIMIT, UNION_LIMIT = 5, 40, 15, 400
#: Weights of path models that are sent to the tasks.
MOST_WEIGHTS = 200_000


def objects(triples: DataFrame, predicate: str | Column, subject: str = "s", value: str = "o") -> DataFrame:
    """(subject, value) of one predicate."""
    p = F.col("p") == predicate if isinstance(predicate, str) else predicate
    return triples.filter(p).select(F.col("s").alias(subject), F.col("o").alias(value))


def chain(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """Ends of a sequence of predicates: s, o. Each step is an equi-join."""
    steps = [objects(triples, p, f"n{i}", f"n{i + 1}") for i, p in enumerate(predicates)]
    joined = reduce(lambda a, b: a.join(b[1], f"n{b[0]}"), list(enumerate(steps))[1:], steps[0])
    return joined.select(F.col("n0").alias("s"), F.col(f"n{len(steps)}").alias("o"))


def popularity(triples: DataFrame) -> DataFrame:
    """ln of the number of triples that a resource is a part of, as subject or as object."""
    ends = triples.select(F.col("s").alias("resource")).unionAll(triples.filter("o_is_uri").select("o"))
    return ends.groupBy("resource").agg(F.log(F.count(F.lit(1))).alias("log_popularity"))


def articles(triples: DataFrame, label: str, redirect: str, disambiguation: str, page_id: str, comment: str | None = None) -> DataFrame:
    """Articles by label: directly, by redirect, by disambiguation, and by a redirect to a disambiguation.

    What is itself a redirect or a disambiguation is no article. Columns: title, article, page_id, how, comment.
    """
    named = objects(triples, label, "a", "title")
    to, of = objects(triples, redirect, "a", "b"), objects(triples, disambiguation, "a", "b")
    ways = [
        named.select("title", F.col("a").alias("article"), F.lit("direct").alias("how")),
        named.join(to, "a").select("title", F.col("b").alias("article"), F.lit("redirect").alias("how")),
        named.join(of, "a").select("title", F.col("b").alias("article"), F.lit("disambiguation").alias("how")),
        named.join(to, "a").select("title", F.col("b").alias("a")).join(of, "a").select("title", F.col("b").alias("article"), F.lit("redirect disambiguation").alias("how")),
    ]
    found = reduce(DataFrame.unionByName, ways).distinct()
    for kind in (to, of):
        found = found.join(kind.select(F.col("a").alias("article")), "article", "left_anti")
    out = found.join(objects(triples, page_id, "article", "page_id"), "article")
    if comment:
        return out.join(objects(triples, comment, "article", "comment"), "article", "left")
    return out.withColumn("comment", F.lit(None).cast("string"))


def most_specific(types: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(resource, type) without types that are a supertype of another type of the same resource; hierarchy: (type, supertype), closed."""
    above = types.join(hierarchy, "type").select("resource", F.col("supertype").alias("type")).distinct()
    return types.join(above, ["resource", "type"], "left_anti")


def usable_type(name: Column) -> Column:
    """False for types that say nothing: Thing, names with Feature, Q, Economy, Languages Of."""
    return ~(name.isin("Thing", "Q", "Economy") | F.contains(name, F.lit(" Feature")) | name.startswith("Languages Of "))


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """(type, supertype, level) over up to `depth` levels of (type, supertype) edges."""
    return stages.closure(edges.select("type", "supertype"), "type", "supertype", depth)


def properties(concepts: DataFrame, triples: DataFrame, namespace: str, label: str | None, mandatory_label: bool = False, excluded: str = r"^(wiki|abstract)") -> DataFrame:
    """Property values of concepts (resource): property, value (its label where it has one), value_resource."""
    at = triples.filter(F.col("p").startswith(namespace)).withColumn("property", F.substring("p", F.lit(len(namespace) + 1), F.length("p"))).filter(~F.col("property").rlike(excluded))
    held = concepts.join(at.withColumnRenamed("s", "resource"), "resource")
    if label is None:
        return held.select(*concepts.columns, "property", F.col("o").alias("value"), F.when(F.col("o_is_uri"), F.col("o")).alias("value_resource"))
    named = objects(triples, label, "_v", "_label")
    joined = held.join(named, held["o"] == named["_v"], "inner" if mandatory_label else "left")
    return joined.select(*concepts.columns, "property", F.coalesce("_label", "o").alias("value"), F.when(F.col("o_is_uri"), F.col("o")).alias("value_resource"))


def limited(rows: DataFrame, group: list[str], order: list, limit: int) -> DataFrame:
    """The first rows of each group."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_i") <= limit).drop("_i")


def generic_properties(topics: DataFrame, triples: DataFrame, limit: int = PROPERTY_LIMIT) -> DataFrame:
    """Up to `limit` values of each topic (resource) in English or without language, flooding properties left out."""
    at = triples.filter((F.col("lang").isNull() | (F.col("lang") == "en")) & ~F.col("p").isin(list(FLOODING_PROPERTIES)))
    rows = topics.join(at.select(F.col("s").alias("resource"), F.col("p").alias("property"), F.col("o").alias("value")), "resource")
    return limited(rows, [*topics.columns], ["property", "value"], limit)


def one_hop(paths: DataFrame, triples: DataFrame) -> DataFrame:
    """Values at one property: paths (qid, resource, p0, score)."""
    at = triples.select(F.col("s").alias("resource"), F.col("p").alias("p0"), F.col("o").alias("value"))
    return paths.join(at, ["resource", "p0"]).select("qid", "resource", F.col("p0").alias("property"), "value", "score")


def two_hop(paths: DataFrame, triples: DataFrame) -> DataFrame:
    """Values at two properties in a row: paths (qid, resource, p0, p1, score)."""
    first = triples.select(F.col("s").alias("resource"), F.col("p").alias("p0"), F.col("o").alias("_m"))
    second = triples.select(F.col("s").alias("_m"), F.col("p").alias("p1"), F.col("o").alias("value"))
    return paths.join(first, ["resource", "p0"]).join(second, ["_m", "p1"]).select("qid", "resource", F.concat_ws(": ", "p0", "p1").alias("property"), "value", "score")


def witnessed(paths: DataFrame, triples: DataFrame, witnesses: DataFrame, label: str) -> DataFrame:
    """Values over a mediator that also leads to a witness: paths (qid, resource, p0, p1, p2, score), witnesses (qid, w_resource, w_label).

    The witness is met as a resource, or by a label that holds its name in any case.
    """
    hop = lambda a, p, b: triples.select(F.col("s").alias(a), F.col("p").alias(p), F.col("o").alias(b))
    at = paths.join(hop("resource", "p0", "_m"), ["resource", "p0"]).join(hop("_m", "p1", "value"), ["_m", "p1"]).join(hop("_m", "p2", "_w"), ["_m", "p2"])
    keep = ["qid", "resource", F.concat_ws(": ", "p0", "p1").alias("property"), "value", "score", "witness", "by"]
    direct = at.join(witnesses.select("qid", F.col("w_resource").alias("_w"), F.col("w_label").alias("witness")), ["qid", "_w"]).withColumn("by", F.lit("id"))
    named = at.join(objects(triples, label, "_w", "_name"), "_w").join(witnesses.select("qid", F.col("w_label").alias("witness")), "qid")
    named = named.filter(F.contains(F.lower("_name"), F.lower("witness"))).withColumn("by", F.lit("label"))
    return direct.select(*keep).unionByName(named.select(*keep)).distinct()


def path_values(paths: DataFrame, triples: DataFrame, witnesses: DataFrame, label: str, limit: int = UNION_LIMIT) -> DataFrame:
    """Values of all paths of a question in one table: paths (qid, resource, path, score) of one, two, or three properties, split at "|"; a third one leads to a witness.

    At most `limit` values of each question and topic, those of the best paths first. Columns: qid, resource, property, value, score.
    """
    parts = paths.withColumn("_p", F.split("path", r"\|")).select("qid", "resource", "score", F.size("_p").alias("_n"), *[F.get("_p", F.lit(i)).alias(f"p{i}") for i in range(3)])
    names = ["qid", "resource", "property", "value", "score"]
    found = [
        one_hop(parts.filter("_n = 1").select("qid", "resource", "p0", "score"), triples),
        two_hop(parts.filter("_n = 2").select("qid", "resource", "p0", "p1", "score"), triples),
        witnessed(parts.filter("_n = 3").select("qid", "resource", "p0", "p1", "p2", "score"), triples, witnesses, label),
    ]
    every = reduce(DataFrame.unionByName, [f.select(*names) for f in found]).distinct()
    return limited(every, ["qid", "resource"], [F.desc("score"), "property", "value"], limit)


def topics(titles: DataFrame, triples: DataFrame, label: str, page_key: str, kind: str, limit: int = TOPIC_LIMIT) -> DataFrame:
    """(qid, title, topic): resources of a kind by label, or by page id where one is given; at most `limit` for a title.

    titles: (qid, title, page_id). kind: the predicate that every topic has.
    """
    known = objects(triples, kind, "topic", "_kind").select("topic").distinct()
    by_label = titles.join(objects(triples, label, "topic", "title"), "title").select("qid", "title", "topic")
    by_page = titles.filter("page_id IS NOT NULL").join(objects(triples, page_key, "topic", "page_id"), "page_id").select("qid", "title", "topic")
    return limited(by_label.unionByName(by_page).distinct().join(known, "topic", "left_semi"), ["qid", "title"], ["topic"], limit).select("qid", "title", "topic")


def source_bindings(values: DataFrame, sources: Sequence[tuple[str, Column]]) -> DataFrame:
    """values with the feature of the source that each came from: (name, condition) in order; the first that holds sets name to 1, others are null."""
    taken, out = F.lit(False), values
    for name, holds in sources:
        out = out.withColumn(name, F.when(~taken & holds, 1.0))
        taken = taken | F.coalesce(holds, F.lit(False))
    return out


def linked_concepts(clues: DataFrame, labels: DataFrame, cross: DataFrame, popular: DataFrame, score: Column, most: int = 3, top: int = 5) -> DataFrame:
    """Entity linking: clues (qid, clue_type, label) to scored concepts: fuzzy and cross look-ups merged by entity, one row for each, the `top` best of each clue.

    N-gram clues take exact hits only. labels: (name, entity); cross: (label, entity, n); popular: (resource, log_popularity). score is an expression over edit_dist,
    label_probability, log_popularity and the flags by_fuzzy, by_cross.
    """
    fuzzy = fuzzy_hits(clues.select("qid", "label"), labels, most).join(clues.select("qid", "label", "clue_type").distinct(), ["qid", "label"]).filter((F.col("clue_type") != "Ngram") | (F.col("dist") == 0))
    fuzzy = fuzzy.groupBy("qid", "label", "entity").agg(F.min("dist").alias("dist"), F.lit(True).alias("by_fuzzy"))
    wide = label_probability(cross).join(clues.select("qid", "label").distinct(), "label").groupBy("qid", "label", "entity").agg(F.max("prob").alias("prob"), F.lit(True).alias("by_cross"))
    both = fuzzy.join(wide, ["qid", "label", "entity"], "full_outer").na.fill({"by_fuzzy": False, "by_cross": False, "prob": 0.0, "dist": 0})
    both = both.join(popular.select(F.col("resource").alias("entity"), "log_popularity"), "entity", "left").na.fill({"log_popularity": 0.0})
    named = both.select("qid", "label", "entity", F.col("dist").alias("edit_dist"), F.col("prob").alias("label_probability"), "log_popularity", "by_fuzzy", "by_cross").withColumn("score", F.round(score, 6))
    return limited(named, ["qid", "label"], [F.desc("score"), "entity"], top)


def best_paths(features: DataFrame, weights: DataFrame, limit: int = PATH_LIMIT) -> DataFrame:
    """Per-path logistic models over a question's features (qid, feature): the best paths, with their scores. weights: (path, feature, weight); feature "_" is the intercept.

    Up to MOST_WEIGHTS weights go to the tasks, so features that are dealt by question stay there; more are joined by feature.
    """
    if weights.limit(MOST_WEIGHTS + 1).count() <= MOST_WEIGHTS:
        weights = F.broadcast(weights)
    bias = weights.filter("feature = '_'").select("path", F.col("weight").alias("_bias"))
    sums = features.join(weights.filter("feature <> '_'"), "feature").groupBy("qid", "path").agg(F.sum("weight").alias("_z"))
    every = sums.join(bias, "path")
    scored = every.select("qid", "path", F.round(sigmoid(F.col("_z") + F.col("_bias")), 6).alias("score"))
    return limited(scored, ["qid"], [F.desc("score"), "path"], limit)


def relatedness(question: Column, answer: Column, matrix: list[list[float]], bias: float) -> Column:
    """sigmoid(q M a + bias) of two mean vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in matrix])
    return sigmoid(dot(question, F.transform(rows, lambda r: dot(r, answer))) + F.lit(float(bias)))


def property_answers(values: DataFrame, origin: str) -> DataFrame:
    """Property values (qid, property, value, score) as candidate answers with their base features."""
    return values.select(
        "qid", F.col("value").alias("text"), tx.canonical(F.col("value")).alias("canon_text"), F.lit(1).alias("occurences"), F.log1p(F.lit(1.0)).alias("resultLogScore"),
        F.col("score").alias("propertyScore"), F.lit(1.0).alias(origin), F.col("property").alias("lat_text"),
    )


def clues_in_property(values: DataFrame, clues: DataFrame, no_clue: str) -> DataFrame:
    """Property rows with n_clues, the clues whose label is a word of the property's name, and no_clue = -1 where there are none."""
    named = values.select("qid", "property").distinct()
    words = named.withColumn("label", F.explode(F.array_distinct(tx.tokens(F.regexp_replace("property", r"[_.]", " ")))))
    hits = words.join(clues.select("qid", "label").distinct(), ["qid", "label"]).groupBy("qid", "property").agg(F.count(F.lit(1)).alias("n_clues"))
    out = values.join(hits, ["qid", "property"], "left").withColumn("n_clues", F.coalesce("n_clues", F.lit(0)))
    return out.withColumn(no_clue, F.when(F.col("n_clues") == 0, -1.0))


def concept_features(answers: DataFrame, concepts: DataFrame) -> DataFrame:
    """Answers with the features of concepts of equal label in any case: flags, best reciprocal ranks and score."""
    by = concepts.groupBy("qid", F.lower("label").alias("_key")).agg(F.max("source_rr").alias("originConceptSourceRR"), F.max("label_rr").alias("originConceptLabelRR"), F.max("score").alias("originConceptScore"))
    out = answers.withColumn("_key", F.lower("text")).join(by, ["qid", "_key"], "left").drop("_key")
    return out.withColumn("originConcept", F.when(F.col("originConceptScore").isNotNull(), 1.0))


def fuzzy_hits(queries: DataFrame, labels: DataFrame, most: int = 3) -> DataFrame:
    """Entities whose label is within `most` edits of the asked one: all exact hits, else the nearest.

    Labels meet only where they share a cut of the query: with at most k edits, one of k + 1 pieces of the asked label stands in the found one,
    shifted by at most k; so the pieces and their possible places are join keys. A label of k letters or fewer is cut into its
    letters, and a found label must share one: any other label as short would be within k edits. Empty labels are not asked for.
    """
    q = queries.select("qid", "label", F.lower("label").alias("_q")).distinct().filter(F.length("_q") > 0)
    n = F.length("_q")
    pieces = F.least(F.lit(most + 1), n)
    begin = lambda i: F.floor(i * n / pieces).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.struct(F.substring(F.col("_q"), begin(i) + 1, begin(i + 1) - begin(i)).alias("piece"), begin(i).alias("at")))
    asked = q.withColumn("c", F.explode(cuts)).select("qid", "label", "_q", F.col("c.piece").alias("piece"), F.explode(F.sequence(F.greatest(F.col("c.at") - most, F.lit(0)), F.col("c.at") + most)).alias("at"))
    # a row for each length of a piece: the lengths of labels that such pieces can find, and how far in they can stand
    wanted = asked.groupBy(F.length("piece").alias("_len")).agg((F.min(F.length("_q")) - most).alias("_least"), (F.max(F.length("_q")) + most).alias("_most"), F.max("at").alias("_far"))
    names = labels.select("name", "entity", F.lower("name").alias("_n"))
    cut = names.join(F.broadcast(wanted), F.length("_n").between(F.col("_least"), F.col("_most")) & (F.length("_n") >= F.col("_len")))
    cut = cut.withColumn("at", F.explode(F.sequence(F.lit(0), F.least(F.length("_n") - F.col("_len"), F.col("_far")))))
    cut = cut.withColumn("piece", F.substring(F.col("_n"), F.col("at") + 1, F.col("_len"))).select("name", "entity", "_n", "at", "piece")
    near = asked.join(cut, ["piece", "at"]).filter(F.abs(F.length("_q") - F.length("_n")) <= most).select("qid", "label", "_q", "name", "entity", "_n").distinct()
    hits = near.withColumn("dist", F.levenshtein("_q", "_n")).filter(F.col("dist") <= most)
    first = Window.partitionBy("qid", "label").orderBy("dist", "name", "entity")
    return hits.withColumn("_i", F.row_number().over(first)).filter((F.col("dist") == 0) | (F.col("_i") == 1)).select("qid", "label", "name", "entity", "dist")


def label_probability(links: DataFrame) -> DataFrame:
    """P(entity | label) from counts (label, entity, n)."""
    return links.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def merge_lookups(fuzzy: DataFrame, cross: DataFrame) -> DataFrame:
    """Full outer join of two look-ups by entity: distance from one, probability from the other, flags for both."""
    joined = fuzzy.withColumn("_f", F.lit(True)).join(cross.withColumn("_c", F.lit(True)), "entity", "full_outer")
    return joined.select("entity", F.coalesce("dist", F.lit(0)).alias("dist"), F.coalesce("prob", F.lit(0.0)).alias("prob"), F.coalesce("_f", F.lit(False)).alias("by_fuzzy"), F.coalesce("_c", F.lit(False)).alias("by_cross"))


def one_per_page(rows: DataFrame) -> DataFrame:
    """One row for each page: the nearest name, the greatest probability, flags of any."""
    return rows.groupBy("page_id").agg(F.min_by("name", F.struct("dist", "name")).alias("name"), F.min("dist").alias("dist"), F.max("prob").alias("prob"), F.bool_or("by_fuzzy").alias("by_fuzzy"), F.bool_or("by_cross").alias("by_cross"))


def wordnet_type(name: Column) -> Column:
    """"synset-word-pos-n" as word, pos and sense number."""
    p = r"^synset-(.*)-([a-z]+)-([0-9]+)$"
    return F.struct(F.regexp_extract(name, p, 1).alias("word"), F.regexp_extract(name, p, 2).alias("pos"), F.regexp_extract(name, p, 3).cast("int").alias("sense"))
