"""The four derived views over the test tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOWED_NATIONS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows: who said what about which product, where and when."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    rows = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(part, line["l_partkey"] == part["p_partkey"]).join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return rows.select(
        F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents, day)).alias("evidence_id"), F.col("o_custkey").alias("author_id"), F.col("l_returnflag").alias("family"),
        F.col("p_brand").alias("product"), F.col("p_type").alias("topic"), F.col("l_suppkey").alias("repo"), (F.col("s_nationkey") < ALLOWED_NATIONS).alias("allowed"), F.col("l_orderkey").alias("thread"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"), (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(days=F.col("l_linenumber"))).alias("updated_at"), (F.col("l_quantity") > 25).alias("artifact"), (F.col("l_discount") > 0.03).alias("implication"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("l_linestatus") == "F"), "MIGRATION").when(F.col("o_orderstatus") == "P", "EMERGING_TOOL").when(F.col("l_linestatus") == "O", "FRICTION").otherwise("WORKFLOW_SHIFT").alias("finding_type"),
    )


EVIDENCE = f"""v_evid AS (
  SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y-%m-%d'))) AS evidence_id,
    o_custkey AS author_id, l_returnflag AS family, p_brand AS product, p_type AS topic, l_suppkey AS repo, s_nationkey < {ALLOWED_NATIONS} AS allowed, l_orderkey AS thread,
    l_shipdate AS created_at, l_shipdate + to_days(CAST(l_linenumber AS INTEGER)) AS updated_at, l_quantity > 25 AS artifact, l_discount > 0.03 AS implication,
    CASE WHEN o_orderstatus = 'P' AND l_linestatus = 'F' THEN 'MIGRATION' WHEN o_orderstatus = 'P' THEN 'EMERGING_TOOL' WHEN l_linestatus = 'O' THEN 'FRICTION' ELSE 'WORKFLOW_SHIFT' END AS finding_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity rows: (event_type, user_id), time, value and the number k of the payload."""
    events = table(spark, sf_dir, "events")
    k = F.from_json("props", "k int")["k"]
    return events.select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value", k.alias("k"))


ACTIVITY = "v_ev AS (SELECT event_id, event_type, user_id, ts, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source records: pages with their titles and, by id, a document's head as summary."""
    from gleanery.functions.text import squeeze
    from gleanery.functions.urls import canonical_url, registrable_host

    title = squeeze(F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", title.alias("title"))  # no html goes through the join
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 200).alias("summary"))
    words = F.split(F.lower(F.regexp_replace(F.col("title"), r"[^A-Za-z ]+", "")), " +")
    rows = pages.join(docs, pages["page_id"] == docs["doc_id"], "left").select("page_id", "url", "title", F.coalesce("summary", F.lit("")).alias("summary"))
    return rows.select(
        F.concat(F.lit("r"), F.lpad(F.col("page_id").cast("string"), 9, "0")).alias("id"), registrable_host(F.col("url")).alias("org"), "url", canonical_url(F.col("url")).alias("canonical_url"), "title", "summary",
        (60 + F.col("page_id") % 5 * 10).cast("int").alias("authority"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(F.col("page_id") % 40).cast("int"))).alias("published_at"),
        F.nullif(F.get(words, F.lit(0)), F.lit("")).alias("product"), F.nullif(F.get(words, F.lit(1)), F.lit("")).alias("model"), F.nullif(F.regexp_extract("url", r"/([0-9]+)", 1), F.lit("")).alias("version"),
    )


CANONICAL = """CASE WHEN lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) = '' THEN trim(url) ELSE
  lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')
  || coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '/$', ''), ''), '/')
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
     lambda p: p <> '' AND NOT starts_with(split_part(p, '=', 1), 'utm_') AND split_part(p, '=', 1) NOT IN ('fbclid','gclid','mc_cid','mc_eid','ref','source'))), '&'), ''), '') END"""
HOST2 = "array_to_string(list_reverse(list_reverse(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '.'))[1:2]), '.')"

RECORDS = f"""v_rec0 AS (
  SELECT page_id, url, trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '\\s+', ' ', 'g')) AS title, coalesce(substring(text, 1, 200), '') AS summary
  FROM pages LEFT JOIN documents ON page_id = doc_id),
v_rec1 AS (SELECT *, regexp_split_to_array(lower(regexp_replace(title, '[^A-Za-z ]+', '', 'g')), ' +') AS words FROM v_rec0),
v_rec AS (
  SELECT 'r' || lpad(CAST(page_id AS VARCHAR), 9, '0') AS id, {HOST2} AS org, url, {CANONICAL} AS canonical_url, title, summary, CAST(60 + page_id % 5 * 10 AS INTEGER) AS authority,
    TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 40 AS INTEGER)) AS published_at, nullif(words[1], '') AS product, nullif(words[2], '') AS model, nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS version
  FROM v_rec1)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed items from documents and labels."""
    heads = {"title": F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 110), "summary": F.substring("text", 1, 420)}
    docs, labels = table(spark, sf_dir, "documents").withColumns(heads).drop("text"), table(spark, sf_dir, "labels")  # no whole text goes through the join
    rows = docs.join(labels.select(F.col("doc_id").alias("of"), "quality", "toxic"), docs["doc_id"] == F.col("of"), "left")
    return rows.select(
        F.concat(F.lit("i"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("id"), "title", "summary", "source", "lang",
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("published_at"), (40 + F.col("n_chars") % 60).cast("int").alias("impact"),
        (50 + F.coalesce("quality", F.lit(0)) * 30 + F.col("doc_id") % 20).cast("int").alias("relevance"), (30 + F.coalesce("toxic", F.lit(0)) * 20 + F.col("n_chars") % 50).cast("int").alias("trend"),
        F.when(F.col("lang") == "en", "SUPPLY").when(F.col("lang") == "fr", "CAPABILITY").when(F.col("lang") == "de", "ADOPTION").otherwise("BACKGROUND").alias("role"), F.col("source").alias("organization"),
        F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string")).alias("topic"), F.col("n_chars").alias("stars"),
        F.array(F.concat(F.lit("tag"), (F.col("doc_id") % 11).cast("string")), F.concat(F.lit("ai-"), F.col("lang")), F.concat(F.lit("x"), (F.col("n_chars") % 5).cast("string"))).alias("tags"),
    )


ITEMS = """v_item AS (
  SELECT 'i' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id, substring(split_part(text, chr(10), 1), 1, 110) AS title, substring(text, 1, 420) AS summary, source, lang,
    TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS published_at, CAST(40 + n_chars % 60 AS INTEGER) AS impact, CAST(50 + coalesce(quality, 0) * 30 + doc_id % 20 AS INTEGER) AS relevance,
    CAST(30 + coalesce(toxic, 0) * 20 + n_chars % 50 AS INTEGER) AS trend, CASE lang WHEN 'en' THEN 'SUPPLY' WHEN 'fr' THEN 'CAPABILITY' WHEN 'de' THEN 'ADOPTION' ELSE 'BACKGROUND' END AS role,
    source AS organization, 't' || CAST(doc_id % 7 AS VARCHAR) AS topic, n_chars AS stars, ['tag' || CAST(doc_id % 11 AS VARCHAR), 'ai-' || lang, 'x' || CAST(n_chars % 5 AS VARCHAR)] AS tags
  FROM documents LEFT JOIN labels USING (doc_id))"""
