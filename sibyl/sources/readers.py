"""Sources: questions, corpora, triples, labels, models, run files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import QUESTIONS


def questions_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions: id, type, text and answer pattern, tab separated, without header or quotes."""
    return spark.read.csv(path, sep="\t", quote="", escape="", schema=QUESTIONS)


def questions_json(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON array of {qId, qText, answers, author}; the answers become one pattern of alternatives."""
    schema = "qId string, qText string, answers array<string>, author string"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(F.col("qId").alias("qid"), F.lit("factoid").alias("type"), F.col("qText").alias("text"), F.array_join("answers", "|").alias("answer_pattern"))


def questions_lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    """Questions typed in or piped: the id is the running number. Blank lines are none."""
    rows = [(str(i), "factoid", x.strip(), None) for i, x in enumerate(x for x in lines if x.strip())]
    return spark.createDataFrame(rows, QUESTIONS)


def questions_stream(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """Unbounded queue of questions: JSON lines that are put into a folder, with the concepts and the clue a user may add."""
    schema = "qid string, text string, concepts array<struct<title: string, page_id: string>>, artificial_clue string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(folder)


def corpus_xml(spark: SparkSession, path: str) -> DataFrame:
    """Documents (doc_id, url, title, text) of an XML dump; pages that only list meanings are left out."""
    schema = "id long, url string, title string, text string"
    rows = spark.read.format("xml").option("rowTag", "doc").schema(schema).load(path)
    return without_disambiguation(rows.withColumnRenamed("id", "doc_id"))


def without_disambiguation(docs: DataFrame, mark: str = "may refer to:") -> DataFrame:
    return docs.filter(~F.contains("text", F.lit(mark)))


def triples_nt(spark: SparkSession, path: str) -> DataFrame:
    """Triples (s, p, o, o_is_uri, lang) of an N-Triples file; lines that are none are left out."""
    line = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<[^>]*>)?)\s*\.\s*$'
    rows = spark.read.text(path).filter(F.col("value").rlike(line))
    part = lambda i: F.nullif(F.regexp_extract("value", line, i), F.lit(""))
    uri = part(3)
    text = F.regexp_replace(F.regexp_replace(F.regexp_extract("value", line, 4), r'\\"', '"'), r"\\n", "\n")
    return rows.select(part(1).alias("s"), part(2).alias("p"), F.coalesce(uri, text).alias("o"), uri.isNotNull().alias("o_is_uri"), part(5).alias("lang"))


def repaired_triples(lines: DataFrame) -> DataFrame:
    """Lines (value) of a dump with broken ones mended: bare quotes and backslashes inside IRIs are escaped, empty lines go."""
    iri = F.regexp_replace("value", r"\\(?=[^u\"nrt\\])", r"\\\\")
    return lines.withColumn("value", iri).filter(F.trim("value") != "")


def label_counts(spark: SparkSession, path: str) -> DataFrame:
    """(label, entity, n) of a tab-separated table of link labels."""
    return spark.read.csv(path, sep="\t", quote="", schema="label string, entity string, n long")


def web_results(cache: DataFrame, queries: DataFrame, k: int = 6) -> DataFrame:
    """Stored web results (query, title, description, url, rank) of the asked queries, the first k of each, with resultRR, 1 / rank."""
    return cache.join(queries.select("query").distinct(), "query", "left_semi").filter(F.col("rank") <= k).withColumn("resultRR", 1 / F.col("rank"))


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of a text file of words and numbers."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(F.element_at(parts, 1).alias("word"), F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.cast("float")).alias("vector"))


def bilinear_weights(path: str) -> tuple[list[list[float]], float]:
    """A square matrix and a bias, from lines of numbers; the last line is the bias."""
    rows = [[float(x) for x in line.split()] for line in Path(path).read_text().splitlines() if line.strip()]
    return rows[:-1], rows[-1][0]


def path_weights(spark: SparkSession, path: str) -> DataFrame:
    """(path, feature, weight) of a JSON object path -> {feature: weight}; comment lines are left out."""
    text = "\n".join(x for x in Path(path).read_text().splitlines() if not x.lstrip().startswith(("#", "//")))
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
    rows = spark.createDataFrame([(text,)], "value string").select(F.explode(F.from_json("value", kind)).alias("path", "w"))
    return rows.select("path", F.explode("w").alias("feature", "weight"))


def class_weights(spark: SparkSession, path: str) -> DataFrame:
    """(class, feature, weight) of a JSON object class -> {feature: weight}."""
    return path_weights(spark, path).withColumnRenamed("path", "class")


def wordnet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Words (word, type, synset) and hypernyms (synset, up_synset, up_text, instance) of the lexical database's data files.

    A line holds the synset's number, file, kind, number of words (hexadecimal), words with their numbers, number of pointers, and pointers of
    sign, synset, kind and places. "@" points to a hypernym, "@i" to what the synset is an instance of. Other lines are left out.
    """
    parts = F.split(F.element_at(F.split("value", r" \| ", 2), 1), " ")
    rows = spark.read.text(path).filter(F.col("value").rlike(r"^[0-9]{8} ")).select(F.get(parts, F.lit(0)).cast("long").alias("synset"), F.get(parts, F.lit(2)).alias("type"), F.conv(F.get(parts, F.lit(3)), 16, 10).cast("int").alias("_n"), parts.alias("_p"))
    word = lambda i: F.lower(F.replace(F.get("_p", 4 + 2 * i), F.lit("_"), F.lit(" ")))
    words = rows.select("synset", "type", F.explode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), word)).alias("word")).select("word", "type", "synset")
    first = 5 + 2 * F.col("_n")
    count = F.get("_p", first - 1).cast("int")
    pointer = lambda i: F.struct(F.get("_p", first + 4 * i).alias("sign"), F.get("_p", first + 4 * i + 1).cast("long").alias("up_synset"))
    up = rows.filter(count > 0).select("synset", F.explode(F.transform(F.sequence(F.lit(0), count - 1), pointer)).alias("x")).select("synset", "x.*").filter(F.col("sign").isin("@", "@i"))
    names = rows.select(F.col("synset").alias("up_synset"), word(F.lit(0)).alias("up_text"))
    return words, up.join(names, "up_synset").select("synset", "up_synset", "up_text", (F.col("sign") == "@i").alias("instance"))


def checkpoint(spark: SparkSession, folder: str, phase: int) -> DataFrame:
    """The hitlist that was saved at a phase."""
    return spark.read.parquet(folder).filter(F.col("phase") == phase).drop("phase")


def answers_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Answer files, one folder per question; qid comes from the folder's name."""
    return spark.read.csv(folder, header=True, inferSchema=False)


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text) of web pages: scripts, styles and tags go, common entities are put in, white space is made single."""
    html = F.regexp_replace("html", r"(?is)<(script|style|nav)[^>]*>.*?</(script|style|nav)>", " ")
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return pages.select("page_id", "url", title.alias("title"), F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " ")).alias("text"))


def endpoints(table: list[list[str]], environment: int = 0, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Back ends of an environment: a row of five places, each of which an option may override."""
    names = ("documents", "triples", "topics", "labels", "cross_labels")
    return dict(zip(names, table[environment], strict=False)) | (overrides or {})


def register(spark: SparkSession, name: str, df: DataFrame) -> None:
    """Names a source, so that queries find it."""
    df.createOrReplaceTempView(f"source_{name}")


def source(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(f"source_{name}")
