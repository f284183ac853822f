"""Line dedup: winnowed fingerprints of lines, matches extended both ways, later runs deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that a repeated run of lines has to have; the guarantee of the fingerprints.
MIN_WORDS = 5


def words_of(line: Column) -> Column:
    return F.regexp_count(F.concat(line, F.lit(" ")), F.lit(r"[^\x20\x09-\x0D][\x20\x09-\x0D]"))


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, mark, pos, h1, h2, words: the lines with a word of each document.

    ``mark`` is a hash of the text, so that rows with one id but other texts are
    other documents.  A line is compared without the white space around it.
    """
    line = F.regexp_replace("line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    rows = docs.select("doc_id", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "mark", "pos", line.alias("line"))
    rows = rows.filter(F.col("line") != "")
    return rows.select("doc_id", "mark", "pos", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), words_of(F.col("line")).cast("long").alias("words"))


def fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """The windows of each document, each with the line whose hash is least in it, its fingerprint.

    A window is a shortest run of lines with ``min_words`` words: the one that
    starts at a line, or the one that ends there.  What a window holds decides
    which line is its minimum, so equal runs with ``min_words`` words always
    share a fingerprint.  A line with that many words is a window by
    itself; the minima thin out where lines are short.  ``span`` (two hashes) names the window's content.  lo and hi
    are line numbers, first and last count lines with a word.
    """
    doc = Window.partitionBy("doc_id", "mark").orderBy("pos")
    once = lines.withColumn("before", F.lag("pos").over(doc)).filter(F.col("before").isNull() | (F.col("before") != F.col("pos")))  # repeated rows
    upto = doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = once.withColumns({"stop": F.sum("words").over(upto), "k": F.row_number().over(doc)})
    line = F.struct("h1", "h2", "pos", "k", "words", "stop")
    ahead = Window.partitionBy("doc_id", "mark").orderBy("pos").rowsBetween(0, min_words - 1)
    behind = Window.partitionBy("doc_id", "mark").orderBy("pos").rowsBetween(1 - min_words, 0)
    start = F.col("stop") - F.col("words")
    around = placed.withColumns({"from": F.collect_list(line).over(ahead), "till": F.collect_list(line).over(behind)})
    around = around.withColumns({"from": F.filter("from", lambda x: x["stop"] - x["words"] - start < min_words), "till": F.filter("till", lambda x: F.col("stop") - x["stop"] < min_words)})
    n_from = F.element_at("from", -1)["stop"] - start
    n_till = F.col("stop") - F.element_at("till", 1)["stop"] + F.element_at("till", 1)["words"]
    # a run that ends here is another than that which starts at its first line only if it has enough words without this one
    held = F.array_compact(F.array(F.when(n_from >= min_words, F.col("from")), F.when(n_till - F.col("words") >= min_words, F.col("till"))))
    runs = around.select("doc_id", "mark", F.explode(held).alias("held"))
    hashes, ends = F.transform("held", lambda x: x["h1"]), (F.element_at("held", 1), F.element_at("held", -1))
    return runs.select(
        "doc_id", "mark", ends[0]["pos"].alias("lo"), ends[1]["pos"].alias("hi"), ends[0]["k"].alias("first"), ends[1]["k"].alias("last"),
        F.array_min(hashes).alias("fingerprint"), F.xxhash64(hashes).alias("span1"), F.xxhash64(F.transform("held", lambda x: x["h2"])).alias("span2"),
    )


def repeated_ranges(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, mark, lo, hi, first, last: windows that repeat an earlier one.

    Windows meet by fingerprint and content; each joins with the first occurrence only, by (doc_id, mark,
    position), so a window in a third of all rows gives a row for each
    occurrence, not for each pair.  Any longer run that repeats consists of windows that do, so the matches extend both ways
    as far as windows follow one another.
    """
    found = fingerprints(lines, min_words)
    key = ("fingerprint", "span1", "span2")
    seen = found.groupBy(*key).agg(F.min(F.struct("doc_id", "mark", "lo", "hi")).alias("earliest"), F.count("*").alias("n")).filter(F.col("n") > 1)
    seen = seen.select(*[F.col(c).alias(f"s_{c}") for c in key], "earliest")
    pairs = found.join(seen, (F.col("fingerprint") == F.col("s_fingerprint")) & (F.col("span1") == F.col("s_span1")) & (F.col("span2") == F.col("s_span2")))
    later = pairs.filter(~F.col("earliest").eqNullSafe(F.struct("doc_id", "mark", "lo", "hi")))
    return later.select("doc_id", "mark", "lo", "hi", "first", "last")


def merged(ranges: DataFrame) -> DataFrame:
    """doc_id, mark, gaps: the ranges of each document, merged and in order.

    Ranges between which no line with a word lies are one: white space
    between two deleted lines goes with them.
    """
    doc = Window.partitionBy("doc_id", "mark").orderBy("first", "last")
    rows = ranges.withColumn("new", F.coalesce(F.col("first") > F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.groupBy("doc_id", "mark", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return rows.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("gaps"))  # ranges of one document


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Delete runs of lines that repeat an earlier run of ``min_words`` words or more.

    Earlier is by (doc_id, line); within a document too.  A line goes if any run
    with ``min_words`` words that holds it occurred before, in whichever
    document.  Returns doc_id, text
    (without the deleted lines), n_lines, n_deleted; lines are split at \\n and
    those without a word count as lines but neither start nor end a run; they go
    where the lines around them go.

    DataFrame operations only.  Texts are shuffled once, to meet their ranges;
    all else moves hashes and positions.  A null text stays null, with no lines;
    an empty one has one line.  Null ids come first.  Rows with equal id and
    text are one document: they all get the same result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep).withColumn("mark", F.xxhash64("text"))
    with_text = rows.filter(F.col("text").isNotNull())
    gaps = merged(repeated_ranges(line_rows(with_text), min_words)).withColumnsRenamed({"doc_id": "of", "mark": "of_mark"})
    out = rows.join(gaps, rows["doc_id"].eqNullSafe(gaps["of"]) & (rows["mark"] == gaps["of_mark"]), "left")
    split = F.split("text", "\n")
    ends = F.concat(F.transform("gaps", lambda g: g["lo"]), F.array(F.size(split)))
    starts = F.concat(F.array(F.lit(0)), F.transform("gaps", lambda g: g["hi"] + 1))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.slice(F.col("parts"), x["s"] + 1, x["e"] - x["s"])))
    deleted = F.aggregate("gaps", F.lit(0), lambda acc, g: acc + g["hi"] - g["lo"] + 1)
    text = F.when(F.col("gaps").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = out.withColumn("parts", split)
    return out.select("doc_id", text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size("parts")).cast("long").alias("n_lines"), F.coalesce(deleted, F.lit(0)).cast("long").alias("n_deleted"), *keep)


def emptied(text: Column, n_deleted: Column) -> Column:
    """Whether nothing but white space is left of a document that lost lines."""
    return (n_deleted > 0) & ~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


ORACLE_SQL = """
WITH rows AS (SELECT DISTINCT doc_id, text, md5(text) AS mark FROM documents WHERE text IS NOT NULL),
split AS (
  SELECT doc_id, mark, u.pos, u.raw, regexp_replace(u.raw, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS line
  FROM rows, LATERAL (SELECT unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u),
lines AS (SELECT *, count(*) FILTER (WHERE line <> '') OVER (PARTITION BY doc_id, mark ORDER BY pos) AS k FROM split),
counted AS (SELECT *, len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')) AS words FROM lines WHERE line <> ''),
worded AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, mark ORDER BY k) AS stop FROM counted),
windows AS (
  SELECT doc_id, mark, k AS lo, k + count(*) OVER f - 1 AS hi, string_agg(line, chr(10)) OVER f AS content, sum(words) OVER f AS n
  FROM worded WINDOW f AS (PARTITION BY doc_id, mark ORDER BY stop - words RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING)
  UNION
  SELECT doc_id, mark, k - count(*) OVER b + 1, k, string_agg(line, chr(10)) OVER b, sum(words) OVER b
  FROM worded WINDOW b AS (PARTITION BY doc_id, mark ORDER BY stop RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id NULLS FIRST, mark, lo) AS place FROM windows WHERE n >= 5),
gone AS (SELECT DISTINCT doc_id, mark, unnest(range(lo, hi + 1)) AS k FROM ranked WHERE place > 1),
marked AS (
  SELECT l.*, a.k IS NOT NULL AND (l.line <> '' OR b.k IS NOT NULL) AS deleted FROM lines l
  LEFT JOIN gone a ON a.doc_id = l.doc_id AND a.mark = l.mark AND a.k = l.k LEFT JOIN gone b ON b.doc_id = l.doc_id AND b.mark = l.mark AND b.k = l.k + 1),
kept AS (
  SELECT doc_id, mark, string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT deleted) AS text, count(*) AS n_lines, count(*) FILTER (WHERE deleted) AS n_deleted FROM marked GROUP BY ALL)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_deleted, 0) AS n_deleted
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id AND k.mark = md5(d.text)
"""
