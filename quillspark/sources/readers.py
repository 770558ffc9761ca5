"""Readers of the input formats: texts, chats, articles, lexicons, vectors, treebanks, reviews, feature tables.

Every schema is declared. All readers are Spark's own, so any store that Spark reads will do, and files are read
where they lie in parallel; only whole small files (wholetext) are one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Date formats of chats, tried in this order (fixed values).
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss.SSSSSS z", "yyyy-MM-dd HH:mm:ss z", "yyyy-MM-dd HH:mm z", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH.mm.ss.SSSSSS", "dd/MM/yyyy HH:mm:ss.SSSSSS", "HH.mm.ss", "HH:mm:ss"]


def date(text: Column) -> Column:
    """The first format that parses, else null; a time alone is on the first day of 1970."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """name, text: every *.txt as one row."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def texts_by_blank_line(spark: SparkSession, folder: str) -> DataFrame:
    """name, part, text: every *.txt cut at blank lines."""
    return texts(spark, folder).select("name", F.posexplode(F.split("text", r"\n\s*\n")).alias("part", "text")).filter(F.trim("text") != "")


def labelled_texts(spark: SparkSession, folder: str, labels: str, limit: int | None = None) -> DataFrame:
    """Texts with the columns of a CSV (filename, ...) of the same name; texts or rows without partner are left out."""
    rows = spark.read.csv(labels, header=True)
    out = texts(spark, folder).join(rows.withColumnRenamed(rows.columns[0], "name"), "name")
    return out.limit(limit) if limit else out


def chat_json(spark: SparkSession, path: str) -> DataFrame:
    """id, parent_id, ts, user, text of a JSON array of posts."""
    rows = spark.read.json(path, schema="genid string, ref string, time string, nickname string, text string", multiLine=True)
    number = lambda c: F.expr(f"try_cast({c} AS double)").cast("bigint")
    return rows.select(number("genid").alias("id"), F.coalesce(number("ref"), F.lit(-1)).alias("parent_id"), F.timestamp_seconds(number("time")).alias("ts"), F.col("nickname").alias("user"), "text")


def chat_csv(spark: SparkSession, path: str) -> DataFrame:
    """id, parent_id, ts, user, text of a CSV with columns id, parent, user, text, time; a blank parent is -1."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', schema="id bigint, parent_id string, user string, text string, time string")
    return rows.select("id", F.expr("coalesce(try_cast(nullif(trim(parent_id), '') AS bigint), -1)").alias("parent_id"), F.coalesce(date(F.col("time")), F.timestamp_seconds(F.expr("try_cast(time AS bigint)"))).alias("ts"), "user", "text")


def chat_csv_large(spark: SparkSession, path: str) -> DataFrame:
    """The same of a CSV with columns id, parent, user, date, -, -, text."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', schema="id bigint, parent_id string, user string, time string, c5 string, c6 string, text string")
    return rows.select("id", F.expr("coalesce(try_cast(nullif(trim(parent_id), '') AS bigint), -1)").alias("parent_id"), date(F.col("time")).alias("ts"), "user", "text")


def chat_xml(spark: SparkSession, path: str) -> DataFrame:
    """id, parent_id, ts, user, text of corpus files: ids count from 0, utterances without text are left out."""
    rows = spark.read.xml(path, rowTag="Turn", schema="_nickname string, Utterance array<struct<_genid: string, _ref: string, _time: string, _VALUE: string>>")
    u = rows.select(F.col("_nickname").alias("user"), F.explode("Utterance").alias("u")).filter("trim(u._VALUE) <> ''")
    return u.select((F.col("u._genid").cast("bigint") - 1).alias("id"), F.expr("coalesce(try_cast(u._ref AS bigint) - 1, -1)").alias("parent_id"), date(F.col("u._time")).alias("ts"), "user", F.trim("u._VALUE").alias("text"))


def articles_xml(spark: SparkSession, path: str, row_tag: str = "article") -> DataFrame:
    """title, abstract, authors, date; articles that lack one of them are left out."""
    rows = spark.read.xml(path, rowTag=row_tag, schema="title string, abstract string, authors string, year string")
    out = rows.select(F.trim("title").alias("title"), F.trim("abstract").alias("abstract"), F.transform(F.filter(F.split("authors", "[,;]"), lambda x: F.trim(x) != ""), lambda x: F.trim(x)).alias("authors"), F.expr("try_to_date(concat('01-01-', year), 'dd-MM-yyyy')").alias("date"))
    return out.filter("title <> '' and abstract <> '' and size(authors) > 0 and date is not null")


def ratings(spark: SparkSession, path: str, measures: list[str]) -> DataFrame:
    """word, measure, value of a CSV of ratings with two header rows; blank cells are left out."""
    rows = spark.read.csv(path, schema="word string, " + ", ".join(f"`{m}` string" for m in measures))
    long = rows.unpivot("word", measures, "measure", "value").withColumn("value", F.expr("try_cast(value AS double)"))
    return long.filter("value is not null and word is not null")


def valence(spark: SparkSession, path: str) -> DataFrame:
    """list, word of a ;-separated table of words by lists, where the cell isn't 0 or blank."""
    rows = spark.read.csv(path, header=True, sep=";")
    long = rows.unpivot(rows.columns[0], rows.columns[1:], "list", "value")
    return long.filter("value is not null and trim(value) not in ('', '0')").select("list", F.col(rows.columns[0]).alias("word"))


def sectioned_words(spark: SparkSession, path: str, headers: dict[str, str]) -> DataFrame:
    """kind, word of a list file: a line that holds a key of headers opens the section of that kind.

    A lexicon is one small file, read whole, so line order is the order in the text.
    """
    line = F.posexplode(F.split("value", "\n")).alias("at", "line")
    rows = spark.read.text(path, wholetext=True).select(line).withColumn("line", F.trim("line")).filter("line <> ''")
    kind = F.coalesce(*[F.when(F.contains(F.lower("line"), F.lit(k.lower())), F.lit(v)) for k, v in headers.items()])
    w = Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("own", kind).withColumn("kind", F.last("own", True).over(w)).filter("own is null and kind is not null").select("kind", F.lower("line").alias("word"))


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word, vec of a text file of vectors; a header line (count, dimension) is left out."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), " +").alias("p")).filter(F.size("p") > 2)
    return parts.select(F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("double")).alias("vec"))


def syllables(spark: SparkSession, path: str) -> DataFrame:
    """word, syllables (arrays of phonemes): word SYL-SYL, phonemes parted by spaces."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^(\S+)\s+(.*)$", 1).alias("word"), F.regexp_extract("value", r"^(\S+)\s+(.*)$", 2).alias("s")).filter("word <> ''")
    return rows.select("word", F.transform(F.split("s", "-"), lambda x: F.split(F.trim(x), " +")).alias("syllables"))


def merged_syllables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two dictionaries in one; entries of a word with equal sets of syllables are one."""
    both = a.union(b).withColumn("k", F.array_sort(F.transform("syllables", lambda s: F.array_join(s, " "))))
    return both.dropDuplicates(["word", "k"]).drop("k")


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """sentence, ix, form, lemma, upos, xpos, feats (map), head, deprel; comments and multi-word ranges are left out."""
    sentences = spark.read.text(path, lineSep="\n\n").withColumn("sentence", F.monotonically_increasing_id())  # numbered before they are exploded
    blocks = sentences.select("sentence", F.explode(F.split("value", "\n")).alias("line"))
    c = F.split("line", "\t")
    rows = blocks.filter(F.col("line").rlike(r"^\d+\t")).select("sentence", c.alias("c"))
    return rows.select("sentence", F.col("c")[0].cast("int").alias("ix"), F.col("c")[1].alias("form"), F.col("c")[2].alias("lemma"), F.col("c")[3].alias("upos"), F.col("c")[4].alias("xpos"), F.when(F.col("c")[5] != "_", F.str_to_map(F.col("c")[5], F.lit(r"\|"), F.lit("="))).alias("feats"), F.expr("try_cast(c[6] AS int)").alias("head"), F.col("c")[7].alias("deprel"))


def reviews(spark: SparkSession, path: str, original: bool = True) -> DataFrame:
    """text, rating, category of JSON lines; ratings of 0 are left out if original."""
    rows = spark.read.json(path, schema="_source struct<Review: struct<ReviewBody: string, ReviewRating: int>, Product: struct<ProductCategory: string>>")
    out = rows.select(F.col("_source.Review.ReviewBody").alias("text"), F.col("_source.Review.ReviewRating").alias("rating"), F.col("_source.Product.ProductCategory").alias("category"))
    return out.filter("rating <> 0") if original else out


def correction_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, text of a file of correction pairs, read whole."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "text")).filter("text <> ''")


def feature_table(spark: SparkSession, path: str) -> DataFrame:
    """A wide table of a name and index values, as CSV."""
    return spark.read.csv(path, header=True, inferSchema=True)


def paired_features(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """pair, label and ratios (x 100) of each row to its pair's sum: rows in pairs by order, label 0 for the first of a pair."""
    at = rows.withColumn("pair", F.floor(F.col(order) / 2)).withColumn("label", F.col(order) % 2)
    w = Window.partitionBy("pair")
    return at.select("pair", "label", *[F.coalesce(F.try_divide(100 * F.col(c), F.sum(c).over(w)), F.lit(0.0)).alias(c) for c in columns])
