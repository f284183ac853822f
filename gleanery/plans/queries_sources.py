"""Queries over landed payloads, which Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions.rules import found
from gleanery.functions.text import inverted
from gleanery.plans import views
from gleanery.plans.registry import query
from gleanery.sources import feeds, html, payloads

c = F.col
AS_OF = "2024-02-01"


def xml(col):
    """A text made safe for XML: the five special characters escaped."""
    out = col
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def rss_payloads(spark, d):
    """One RSS document for each source and 20 documents."""
    docs = views.table(spark, d, "documents").withColumn("t", F.split_part("text", F.lit("\n"), F.lit(1)))
    item = F.concat(
        F.lit("<item><title>"), xml(c("t")), F.lit("</title><link>https://example.com/d/"), c("doc_id").cast("string"), F.lit("</link><pubDate>2024-01-0"), (1 + c("doc_id") % 9).cast("string"), F.lit("T00:00:00Z</pubDate><category>"), c("lang"),
        F.lit("</category>"), F.when(c("doc_id") % 3 == 0, F.lit('<enclosure url="https://example.com/i.png" type="image/png"/>')).otherwise(F.lit("")), F.lit("</item>"),
    )
    page = F.floor(c("doc_id") / 20)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))), lambda x: x["item"]), "")
    rows = docs.groupBy("source", page.alias("page")).agg(body.alias("items"))
    return rows.select(F.concat_ws(":", "source", "page").alias("feed"), F.concat(F.lit("<rss><channel><title>x</title><description>about</description>"), "items", F.lit("</channel></rss>")).alias("body"))


LINE = "split_part(text, chr(10), 1)"
SQUEEZED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def rss_rows(spark, d):
    return feeds.rss_items(rss_payloads(spark, d), "feed", "body", 6, F.lit(AS_OF).cast("timestamp"))


RSS_SQL = f"""WITH n AS (SELECT source || ':' || CAST(doc_id // 20 AS VARCHAR) AS feed, 'https://example.com/d/' || CAST(doc_id AS VARCHAR) AS url, doc_id, lang FROM documents WHERE trim({LINE}) <> ''
  QUALIFY row_number() OVER (PARTITION BY source, doc_id // 20 ORDER BY doc_id) <= 6)"""


@query("s1_rss_items", RSS_SQL + " SELECT feed, url, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 9 AS INTEGER)) AS published_at, lang AS tag FROM n")
def s1(spark, d):
    return rss_rows(spark, d).select("feed", "url", "published_at", F.get("tags", F.lit(0)).alias("tag"))


@query("s2_rss_channel_records", RSS_SQL + " SELECT 'rec-' || substring(sha256(feed || '|' || url), 1, 12) AS id, split_part(feed, ':', 1) AS org FROM n")
def s2(spark, d):
    return rss_rows(spark, d).select(F.concat(F.lit("rec-"), F.substring(F.sha2(F.concat_ws("|", "feed", "url"), 256), 1, 12)).alias("id"), F.split_part("feed", F.lit(":"), F.lit(1)).alias("org"))


@query("s3_media_image", RSS_SQL + " SELECT feed, url, CASE WHEN doc_id % 3 = 0 THEN 'https://example.com/i.png' END AS image FROM n")
def s3(spark, d):
    return rss_rows(spark, d).select("feed", "url", "image")


LINKS_SQL = """WITH a AS (SELECT page_id, url AS page_url, generate_subscripts(regexp_extract_all(html, '(?is)<a\\b[^>]*href="[^"]+"[^>]*>.*?</a>'), 1) AS pos, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*href="[^"]+"[^>]*>.*?</a>')) AS a FROM pages),
  l AS (SELECT page_id, pos, regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || regexp_extract(a, '(?is)href="([^"]+)"', 1) AS url, page_url, trim(regexp_replace(regexp_extract(a, '(?is)>(.*)</a>', 1), '\\s+', ' ', 'g')) AS title FROM a),
  f AS (SELECT *, {canonical} AS canonical FROM l WHERE length(title) >= 6 AND NOT regexp_matches(title, '(?i)^(?:featured|read more|learn more|view (?:more|all)|this documentation|next|previous|blog|home)$')),
  o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY page_id, canonical ORDER BY pos) = 1)
  SELECT page_id, canonical, title FROM o QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 4""".replace("{canonical}", views.CANONICAL)


@query("s4_html_listing", LINKS_SQL)
def s4(spark, d):
    return html.listed_links(views.table(spark, d, "pages"), "page_id", "url", "html", "/", 4).select("page_id", "canonical", "title")


def note_pages(spark, d, kind):
    """Release notes from orders: a page for each customer segment and year, a heading for each day."""
    rows = views.table(spark, d, "orders").join(views.table(spark, d, "customer"), c("o_custkey") == c("c_custkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = rows.groupBy("c_mktsegment", F.date_format("o_orderdate", "yyyy-MM").alias("month"), day.alias("day")).agg(F.count("*").alias("n"))
    name = F.concat(F.lit("Orders: "), c("n").cast("string"))
    part = F.concat(F.lit("<h2>"), c("day"), F.lit("</h2><h3>"), name, F.lit("</h3><p>Count of the day</p>")) if kind == "html" else F.concat(F.lit("\n## "), c("day"), F.lit("\n- "), name, F.lit(" of the day\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("day"), part.alias("p")))), lambda x: x["p"]), "")
    return rows.groupBy(F.concat_ws(":", "c_mktsegment", "month").alias("page")).agg(body.alias("body"))


NOTES_SQL = """WITH n AS (SELECT c_mktsegment || ':' || strftime(o_orderdate, '%Y-%m') AS page, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
  SELECT page, day, 'Orders: ' || CAST(n AS VARCHAR) || '{0}' AS title FROM n QUALIFY row_number() OVER (PARTITION BY page ORDER BY day) <= 10"""


@query("s5_html_release_notes", NOTES_SQL.format(""))
def s5(spark, d):
    return html.release_notes(note_pages(spark, d, "html"), "page", "body", "html").select("page", "day", "title")


@query("s6_markdown_release_notes", NOTES_SQL.format(" of the day"))
def s6(spark, d):
    return html.release_notes(note_pages(spark, d, "md"), "page", "body", "bullets").select("page", "day", "title")


@query("s7_article_extraction", """WITH a AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\\s+', ' ', 'g')) AS h1,
  trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\\s+', ' ', 'g')) AS v FROM pages)
  SELECT page_id, md5(h1) AS h1, length(v) AS visible, length(v) >= 200 AS keep FROM a""")
def s7(spark, d):
    parts = html.article(c("html"))
    n = F.length(parts["visible"]).cast("long")
    return views.table(spark, d, "pages").select("page_id", F.md5(parts["h1"]).alias("h1"), n.alias("visible"), (n >= 200).alias("keep"))


@query("s8_og_images", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://img.example.com/' || CAST(page_id AS VARCHAR) END AS image FROM pages")
def s8(spark, d):
    pages = views.table(spark, d, "pages")
    tag = F.concat(F.lit('<meta content="https://img.example.com/'), c("page_id").cast("string"), F.lit('" property="og:image">'))
    with_tags = pages.withColumn("html", F.when(c("page_id") % 2 == 0, F.concat(tag, "html")).otherwise(c("html"))).select(F.concat_ws("#p", "url", "page_id").alias("u"), "html")
    items = pages.select("page_id", F.concat_ws("#p", "url", "page_id").alias("u"), F.lit(None).cast("string").alias("image"))
    return html.fill_images(items, with_tags, "u", "image", "html").select("page_id", "image")


def atom_payloads(spark, d):
    docs = views.table(spark, d, "documents")
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/24.0"), c("doc_id").cast("string"), F.lit("v3</id><title>"), xml(F.split_part("text", F.lit("\n"), F.lit(1))), F.lit("</title><published>2024-01-05T00:00:00Z</published><author><name>A "), c("source"),
        F.lit("</name></author><author><name>B</name></author><category term=\""), c("lang"), F.lit("\"/></entry>"),
    )
    return docs.groupBy(F.floor(c("doc_id") / 25).alias("page")).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("body"))


@query("s9_atom_papers", "SELECT doc_id // 25 AS page, regexp_replace('24.0' || CAST(doc_id AS VARCHAR), '^arxiv:', '') AS arxiv_id, 'A ' || source || ';B' AS authors, lang AS category FROM documents")
def s9(spark, d):
    rows = feeds.atom_papers(atom_payloads(spark, d), "page", "body")
    return rows.select("page", "arxiv_id", F.array_join("authors", ";").alias("authors"), F.get("categories", F.lit(0)).alias("category"))


@query("s21_legacy_listing", "SELECT '24.0' || CAST(doc_id AS VARCHAR) AS id, TIMESTAMP '2024-01-05' AS published_at FROM documents")
def s21(spark, d):
    return feeds.atom_papers(atom_payloads(spark, d), "page", "body").select(c("arxiv_id").alias("id"), c("submitted_at").alias("published_at"))


@query("s10_daily_papers", "SELECT CAST(l_orderkey AS VARCHAR) AS paper_id, CAST(max(CAST(epoch_ms(l_shipdate) AS BIGINT)) // 86400000 AS BIGINT) AS day, 'N;' || CAST(l_orderkey % 7 AS VARCHAR) AS authors FROM lineitem GROUP BY l_orderkey")
def s10(spark, d):
    day = F.floor(F.unix_millis(c("l_shipdate").cast("timestamp")) / 86400000)
    rows = views.table(spark, d, "lineitem").select(day.alias("day"), "l_orderkey").distinct()
    authors = F.concat(F.lit('[{"name": "N"}, "'), (c("l_orderkey") % 7).cast("string"), F.lit('"]'))
    paper = F.concat(F.lit('{"paper": {"id": "'), c("l_orderkey").cast("string"), F.lit('", "title": "t", "summary": "s", "upvotes": 1, "authors": '), authors, F.lit("}}"))
    landed = rows.groupBy("day").agg(F.concat(F.lit("["), F.array_join(F.collect_list(paper), ","), F.lit("]")).alias("body"))
    return payloads.captured_papers(landed, "body", "day").select("paper_id", "day", F.array_join("authors", ";").alias("authors"))


@query("s11_works_with_abstract", "SELECT CAST(doc_id AS VARCHAR) AS id, md5(array_to_string(list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda w: w <> ''), ' ')) AS abstract FROM documents")
def s11(spark, d):
    docs = views.table(spark, d, "documents")
    words = F.filter(F.split("text", "[^A-Za-z]+"), lambda w: w != "")
    rows = docs.select("doc_id", inverted(words).alias("m")).select(F.to_json(F.struct(F.array(F.struct(c("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), c("m").alias("abstract_inverted_index"))).alias("results"))).alias("body"))
    return payloads.works(rows, "body").select("id", F.md5(F.coalesce("abstract", F.lit(""))).alias("abstract"))


@query("s12_proceedings_toc", "SELECT 'part ' || CAST(p_partkey AS VARCHAR) AS title, CASE WHEN p_size > 10 THEN '10.1/' || CAST(p_partkey AS VARCHAR) END AS doi FROM part WHERE p_partkey % 10 <> 0")
def s12(spark, d):
    part = views.table(spark, d, "part")
    key = c("p_partkey").cast("string")
    ee = F.when(c("p_size") > 10, F.concat(F.lit("<ee>https://doi.org/10.1/"), key, F.lit("</ee>"))).otherwise(F.lit(""))
    title = F.when(c("p_partkey") % 10 == 0, F.concat(F.lit("Proceedings of "), key)).otherwise(F.concat(F.lit("part "), key))
    block = F.concat(F.lit("<inproceedings><author>a</author><title>"), title, F.lit(".</title>"), ee, F.lit("</inproceedings>"))
    landed = part.groupBy(F.floor(c("p_partkey") / 50).alias("toc")).agg(F.array_join(F.collect_list(block), "\n").alias("body"))
    return feeds.proceedings(landed, "toc", "body").select("title", "doi")


@query("s13_venue_rss", RSS_SQL.replace("WITH n AS (SELECT source", "WITH n AS (SELECT source").replace("<= 6)", "<= 1000)") + " SELECT url, CASE WHEN contains(url, '7') THEN 'seven' WHEN contains(url, '3') THEN 'three' END AS venue FROM n WHERE TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 9 AS INTEGER)) >= TIMESTAMP '2024-01-08' - INTERVAL 4 DAY AND (contains(url, '7') OR contains(url, '3')) AND NOT contains(url, '99')")
def s13(spark, d):
    rows = feeds.rss_items(rss_payloads(spark, d), "feed", "body", 1000, F.lit(AS_OF).cast("timestamp"))
    venue = F.when(found(c("url"), "7"), "seven").when(found(c("url"), "3"), "three")
    recent = c("published_at") >= F.lit("2024-01-08").cast("timestamp") - F.make_dt_interval(days=F.lit(4))
    return rows.filter(recent & ~F.contains("url", F.lit("99"))).select("url", venue.alias("venue")).filter("venue is not null")


def issue_payloads(spark, d):
    rows = views.table(spark, d, "orders").join(views.table(spark, d, "customer"), c("o_custkey") == c("c_custkey"))
    issue = F.struct(
        c("o_orderkey").cast("string").alias("id"), c("o_orderpriority").alias("title"), F.when(c("o_orderkey") % 11 != 0, c("c_name")).alias("author"), (c("o_orderkey") % 300).alias("comments"), c("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(c("o_orderkey") % 13 == 0, "{}").alias("pull_request"),
    )
    return rows.groupBy("c_mktsegment", F.floor(c("o_orderkey") / 500).alias("page")).agg(F.to_json(F.struct(F.collect_list(issue).alias("items"))).alias("body"))


@query("s14_issue_evidence", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderdate AS created_at FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 300 < 200 AND NOT regexp_matches(o_orderpriority, '(?i)low')")
def s14(spark, d):
    rows = payloads.issues(issue_payloads(spark, d), "body", F.when(c("comments") >= 200, "agent-spam").when(found(c("title"), "low"), "low-priority"))
    return rows.filter("reject is null").select("id", "created_at")


@query("s15_story_rejections", "SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'pull-request' WHEN o_orderkey % 11 = 0 THEN 'bot' WHEN o_orderkey % 300 >= 200 THEN 'agent-spam' END AS reject, count(*) AS n FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 300 >= 200 GROUP BY ALL")
def s15(spark, d):
    rows = payloads.issues(issue_payloads(spark, d), "body", F.when(c("comments") >= 200, "agent-spam"))
    return rows.filter("reject is not null").groupBy("reject").agg(F.count("*").alias("n"))


@query("s16_repo_search", "SELECT p_partkey AS id, p_name AS full_name, CAST(p_size * 100 AS BIGINT) AS stargazers_count FROM part WHERE p_size * 100 >= 1000 ORDER BY p_size DESC, p_partkey LIMIT 40")
def s16(spark, d):
    part = views.table(spark, d, "part")
    repo = F.struct(c("p_partkey").alias("id"), c("p_name").alias("full_name"), (c("p_size") * 100).cast("long").alias("stargazers_count"))
    landed = part.groupBy(F.floor(c("p_partkey") / 100).alias("page")).agg(F.to_json(F.struct(F.collect_list(repo).alias("items"))).alias("body"))
    return payloads.repositories(landed.unionByName(landed), "body", 1000, 40)


@query("s17_video_details", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title, CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) END AS views FROM orders")
def s17(spark, d):
    orders = views.table(spark, d, "orders")
    page = F.floor(c("o_orderkey") / 500).alias("page")
    search = orders.groupBy(page).agg(F.to_json(F.struct(F.collect_list(F.struct(c("o_orderkey").cast("string").alias("id"), c("o_orderpriority").alias("title"))).alias("items"))).alias("body"))
    detail = orders.filter("o_orderstatus = 'F'").groupBy(page).agg(F.to_json(F.struct(F.collect_list(F.struct(c("o_orderkey").cast("string").alias("id"), F.floor("o_totalprice").alias("views"))).alias("items"))).alias("body"))
    left = payloads.json_rows(search, "body", "id string, title string", "items").drop("pos")
    return left.join(payloads.json_rows(detail, "body", "id string, views long", "items").drop("pos"), "id", "left")


@query("s18_posts_with_users", "SELECT o_orderkey AS id, c_name AS author, o_orderkey % 50 + 2 * (o_orderkey % 7) AS engagement FROM orders JOIN customer ON o_custkey = c_custkey")
def s18(spark, d):
    orders = views.table(spark, d, "orders")
    page = F.floor(c("o_orderkey") / 500).alias("page")
    post = F.struct(c("o_orderkey").alias("id"), c("o_custkey").alias("author_id"), (c("o_orderkey") % 50).alias("likes"), (c("o_orderkey") % 7).alias("reposts"))
    posts = payloads.json_rows(orders.groupBy(page).agg(F.to_json(F.struct(F.collect_list(post).alias("data"))).alias("body")), "body", "id long, author_id long, likes long, reposts long", "data")
    users = views.table(spark, d, "customer").groupBy(F.floor(c("c_custkey") / 200).alias("page")).agg(F.to_json(F.struct(F.collect_list(F.struct(c("c_custkey").alias("user_id"), c("c_name").alias("name"))).alias("users"))).alias("body"))
    users = payloads.json_rows(users, "body", "user_id long, name string", "users").drop("pos")
    return posts.join(users, c("author_id") == c("user_id"), "left").select("id", c("name").alias("author"), (c("likes") + 2 * c("reposts")).alias("engagement"))


@query("s19_posts_json", "SELECT p_partkey AS id, 'post ' || p_name AS title FROM part")
def s19(spark, d):
    from gleanery.functions.text import strip_html

    post = F.struct(c("p_partkey").alias("id"), F.struct(F.concat(F.lit("<b>post</b> "), "p_name").alias("rendered")).alias("title"))
    landed = views.table(spark, d, "part").groupBy(F.floor(c("p_partkey") / 100).alias("page")).agg(F.to_json(F.collect_list(post)).alias("body"))
    return payloads.json_rows(landed, "body", "id long, title struct<rendered: string>").select("id", strip_html(c("title.rendered")).alias("title"))
