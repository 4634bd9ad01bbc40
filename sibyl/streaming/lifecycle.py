"""The life of questions: asked, in progress, answered. As a batch over events, and as a stream that comes to the same state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: States in order; a question's state is that of its last event.
STATES = ("asked", "in progress", "answered")


def last_states(events: DataFrame) -> DataFrame:
    """Last state of each question from events (qid, seq, state): one aggregation, no ordering of whole groups."""
    return events.groupBy("qid").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n_events"))


def recent(states: DataFrame, state: str, k: int | None = 6) -> DataFrame:
    """The newest questions in a state."""
    rows = states.filter(F.col("state") == state).orderBy(F.desc("seq"), "qid")
    return rows if k is None else rows.limit(k)


def current_answers(updates: DataFrame) -> DataFrame:
    """Answers of each question from updates (qid, seq, text, confidence): of equal texts the newest counts; generation is the number of updates."""
    newest = updates.groupBy("qid", "text").agg(F.max_by("confidence", "seq").alias("confidence"), F.max("seq").alias("seq"))
    return newest.join(updates.groupBy("qid").agg(F.count(F.lit(1)).alias("generation")), "qid")


def source_registry(sources: DataFrame) -> DataFrame:
    """Distinct sources (type, origin, title, url) of each question with a number from 0 in order of first use, and the furthest state they reached."""
    each = sources.groupBy("qid", "type", "origin", "title", "url").agg(F.min("seq").alias("first"), F.max("state").alias("state"))
    return each.withColumn("source_id", F.row_number().over(Window.partitionBy("qid").orderBy("first", "type", "origin", "title", "url")) - 1)


def stable_id(*parts: Column) -> Column:
    """An id that is the same in every run."""
    return F.xxhash64(*parts)


def answer_sentence(source: Column, prop: Column, witness: Column, answer: Column) -> Column:
    """A sentence of a property snippet: "<source> [is] <property> [(for w)] [is] <answer>."; "is" comes before a property that ends in " by"."""
    before = F.lower(prop).endswith(" by")
    return F.concat(
        source, F.lit(" "), F.when(before, "is ").otherwise(""), F.lower(F.regexp_replace(prop, ".*: ", "")), F.lit(" "),
        F.when(witness.isNotNull(), F.concat(F.lit("(for "), witness, F.lit(") "))).otherwise(""), F.when(before, "").otherwise("is "), answer, F.lit("."),
    )


def answer_sentences(snippets: DataFrame) -> DataFrame:
    """A sentence for each answer of snippets (qid, answer, pos, source, property, witness): the last snippet, one with a witness before others. Other kinds of snippets give none."""
    best = F.struct(F.col("witness").isNotNull().alias("w"), "pos")
    last = snippets.groupBy("qid", "answer").agg(F.max_by(F.struct("source", "property", "witness"), best).alias("x"))
    return last.select("qid", "answer", answer_sentence(F.col("x.source"), F.col("x.property"), F.col("x.witness"), F.col("answer")).alias("sentence"))


def merge_states(old: DataFrame, events: DataFrame) -> DataFrame:
    """States after more events: (qid, state, seq, n_events)."""
    new = last_states(events)
    both = old.select("qid", "state", "seq", "n_events").unionByName(new)
    return both.groupBy("qid").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"), F.sum("n_events").alias("n_events"))


def stream_states(events: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """A stream of events (qid, seq, state) kept as the last state of each question in a memory table; it ends when what is there is read."""
    return last_states(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_batches(questions: DataFrame, answer, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs answer(batch, number) on every new batch of questions, as a batch job over all of them."""
    writer = questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events (ts, state) by state and hour; a watermark lets old windows go."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "state").agg(F.count(F.lit(1)).alias("n"))


def completed(parts: DataFrame, expected: DataFrame) -> DataFrame:
    """Questions of which as many last markers arrived, in any order, as origins are expected."""
    got = parts.filter("is_last").groupBy("qid").agg(F.countDistinct("origin").alias("n"))
    return expected.join(got, "qid").filter("n >= expected").select("qid")
