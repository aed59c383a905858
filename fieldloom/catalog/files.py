"""Queries on URL lists, JSON result texts, pages of single sites, entities, and deep or broken replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.catalog import inputs as I
from fieldloom.catalog import register
from fieldloom.catalog.texts import SPACES_SQL
from fieldloom.functions import json as J
from fieldloom.functions import text as X
from fieldloom.operators import content as content_ops
from fieldloom.session import deal
from fieldloom.sources import readers as R


@register(
    """
with kept as (
  select url, row_number() over (order by page_id) as ordinal
  from pages where not contains(html, '&amp;')
)
select ordinal, url, sha256(url) as url_key,
  'url_' || lpad(cast(ordinal as varchar),
    cast(greatest(3, length(cast(ordinal as varchar))) as integer), '0') as url_id
from kept
"""
)
def url_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    pages = I.table(spark, folder, "pages")
    # Pages with an ampersand stand for lines that are commented out.
    line = F.concat(F.when(F.contains("html", F.lit("&amp;")), "# ").otherwise(" "), "url", F.lit("\t"))
    keep = (X.strip(line) != "") & ~F.startswith(X.strip(line), F.lit("#"))
    rows = R.with_ordinal(pages, keep)
    return rows.select(
        "ordinal",
        X.strip(line).alias("url"),
        X.url_key(X.strip(line)).alias("url_key"),
        X.url_id(F.col("ordinal")).alias("url_id"),
    )


def _result_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON result text per customer: whole, without data, cut short, followed by more, failed."""
    text = F.expr(
        """case c_custkey % 5
        when 1 then concat(head, '"error":null,"data":{}}')
        when 2 then concat(head, '"error":null,"data":{"name":"', c_name, '"}')
        when 3 then concat(head, '"error":null,"data":null} trailing')
        when 4 then concat(head, '"error":"failed, \\\\"', c_mktsegment, '\\\\"","data":null}')
        else concat(head, '"error":null,"data":{"name":"', c_name, '"}}') end"""
    )
    head = F.expr(
        """concat('{"url":"http://x/', c_custkey, '","url_id":"url_', c_custkey, '","timestamp":',
        c_custkey, '.5, "content_length":', c_nationkey, ',')"""
    )
    customers = I.table(spark, folder, "customer").withColumn("head", head)
    return customers.select("c_custkey", J.strict_json(text).alias("record"))


@register(
    """
with texts as (select *, c_custkey % 5 as k from customer)
select c_custkey, k not in (2, 3) as readable,
  case when k not in (2, 3) then 'http://x/' || c_custkey end as url,
  case when k not in (2, 3) then 'url_' || c_custkey end as url_id,
  case when k not in (2, 3) then c_custkey + 0.5::double end as timestamp,
  case when k not in (2, 3) then c_nationkey::integer end as content_length,
  case when k = 4 then 'failed, "' || c_mktsegment || '"' end as error,
  case when k not in (2, 3) then k = 0 end as has_data, case when k = 0 then c_name end as name
from texts
"""
)
def result_texts(spark: SparkSession, folder: str) -> DataFrame:
    texts = _result_texts(spark, folder)
    data = F.col("data")
    good = R.result_fields(texts, "c_custkey").select(
        "c_custkey",
        F.lit(True).alias("readable"),
        "url",
        "url_id",
        "timestamp",
        "content_length",
        "error",
        J.has_data(data).alias("has_data"),
        F.try_variant_get(data, "$.name", "string").alias("name"),
    )
    bad = R.unreadable(texts).select("c_custkey", F.lit(False).alias("readable"))
    return good.unionByName(bad, allowMissingColumns=True)


SITES = [
    ("https://www.linkedin.com/jobs/", '<div class="top jobs-description__x">'),
    ("https://Indeed.com/view/", '<div id="jobDescriptionText">'),
    ("https://uk.indeed.com/", '<div class="a jobsearch-jobDescriptionText">'),
    ("https://www.glassdoor.com:443/", '<div class="jobDescriptionContent desc">'),
    ("http://www.monster.com/", '<div class="job-description">'),
    ("https://angel.co/", '<div class="the-job-description">'),
    ("https://wellfound.com/", '<div class="job-description-2">'),
    ("https://example.org/linkedin.com/", '<div class="jobs-description">'),
]


@register(
    f"""
with titles as (
  select page_id, page_id % 8 as k, trim(regexp_replace(replace(replace(replace(replace(
    regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'),
    '&quot;', '"'), '&amp;', '&'), '{SPACES_SQL}+', ' ', 'g')) as title
  from pages
)
select page_id, case k when 0 then 'site_linkedin.com' when 1 then 'site_indeed.com'
    when 2 then 'site_indeed.com' when 3 then 'site_glassdoor.com' when 4 then 'site_monster.com'
    when 5 then 'site_angel.co' when 6 then 'site_wellfound.com' else 'full_body' end as strategy,
  case when k = 7 then title || ' Apply' else title end as content
from titles
"""
)
def site_content(spark: SparkSession, folder: str) -> DataFrame:
    def by_site(at: int):
        k = F.pmod("page_id", F.lit(len(SITES)))
        return F.element_at(F.array(*[F.lit(site[at]) for site in SITES]), (k + 1).cast("int"))

    # Titles are too short for the selectors and the largest block, so the site's own rule decides.
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    pages = I.table(spark, folder, "pages").select(
        "page_id",
        F.concat(by_site(0), "page_id").alias("url"),
        F.concat(F.lit("<body><nav>Menu</nav>"), by_site(1), title, F.lit("</div><p>Apply</p></body>")).alias("html"),
    )
    return content_ops.extract_content(pages).select("page_id", "strategy", "content")


@register(
    f"""
with cleaned as (
  select doc_id, trim(regexp_replace('<' || replace(coalesce(text, ''), 'e', 'é&') || chr(160) || '"  >',
    '[ \\t\\n\\r\\f\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+',
    ' ', 'g')) as c
  from documents
)
select doc_id, length(c) as chars, md5(c) as digest from cleaned
"""
)
def entity_documents(spark: SparkSession, folder: str) -> DataFrame:
    marked = F.replace(F.coalesce("text", F.lit("")), F.lit("e"), F.lit("&eacute;&amp;"))
    text = F.concat(F.lit("&lt;"), marked, F.lit("&nbsp;&#34;  &#x3E;"))
    cleaned = I.table(spark, folder, "documents").select("doc_id", X.clean_text(text).alias("c"))
    return cleaned.select("doc_id", F.length("c").cast("bigint").alias("chars"), F.md5("c").alias("digest"))


@register(
    """
select o_orderkey, o_orderpriority as priority, cast(null as varchar) as missing,
  o_custkey % 2 = 0 as flag, 'a_b,n,priority_text,the_flag' as names
from orders
"""
)
def deep_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    # Twenty levels, with untidy keys and values at the inmost one.
    text = F.expr(
        """concat(repeat('{"In Ner":', 20), '{" Priority Text ":"  ', o_orderpriority, ' ","N":"n/a",',
        '"The-Flag":"', if(o_custkey % 2 = 0, 'YES', 'false'), '","A B":[{"X-Y":"N/A"}]}', repeat('}', 20))"""
    )
    inner = "$" + ".in_ner" * 20
    orders = deal(I.table(spark, folder, "orders"))
    cleaned = orders.select("o_orderkey", J.clean_json(text).alias("v"))
    inmost = F.try_variant_get("v", inner, "variant")
    return cleaned.select(
        "o_orderkey",
        F.try_variant_get("v", f"{inner}.priority_text", "string").alias("priority"),
        F.try_variant_get("v", f"{inner}.n", "string").alias("missing"),
        F.try_variant_get("v", f"{inner}.the_flag", "boolean").alias("flag"),
        F.array_join(F.array_sort(F.map_keys(J.object_map(inmost))), ",").alias("names"),
    )


@register(
    """
select o_orderkey, 'http://x/' || o_orderkey || '?a=1,}' as u,
  case o_orderkey % 3 when 0 then 'it''s ' || o_orderstatus || ', {b: 2,}'
    when 1 then 'say "' || o_orderstatus || '": ' else o_orderstatus end as a,
  o_custkey as n
from orders
"""
)
def repaired_replies(spark: SparkSession, folder: str) -> DataFrame:
    # Broken outside strings only: commas before brackets, bare keys, single quotes.
    text = F.expr(
        """concat('{"u": "http://x/', o_orderkey, '?a=1,}", ', case o_orderkey % 3
        when 0 then concat('"a": "it\\'s ', o_orderstatus, ', {b: 2,}", "l": [1, 2,],')
        when 1 then concat('a: \\'say "', o_orderstatus, '": \\',')
        else concat('"a": "', o_orderstatus, '", l: {x: [],},') end, ' n: ', o_custkey, ',}')"""
    )
    replies = I.table(spark, folder, "orders").select("o_orderkey", J.reply_json(text, repair=True).alias("t"))
    value = F.try_parse_json("t")
    return replies.select(
        "o_orderkey",
        F.try_variant_get(value, "$.u", "string").alias("u"),
        F.try_variant_get(value, "$.a", "string").alias("a"),
        F.try_variant_get(value, "$.n", "bigint").alias("n"),
    )
