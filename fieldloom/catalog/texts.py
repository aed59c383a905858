"""Queries on texts, replies, pages and repeated runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.catalog import inputs as I
from fieldloom.catalog import register
from fieldloom.functions import html as P
from fieldloom.functions import json as J
from fieldloom.functions import text as X
from fieldloom.operators import content as content_ops
from fieldloom.operators import replies as reply_ops
from fieldloom.operators.incremental import latest, remaining, reuse_or_compute
from fieldloom.operators.scoring import assemble_prompts, score
from fieldloom.session import deal

SPACES_SQL = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}]"
)


@register(
    f"""
with cleaned as (
  select doc_id, trim(regexp_replace(text, '{SPACES_SQL}+', ' ', 'g')) as c from documents
)
select doc_id, length(c) as chars, md5(c) as digest from cleaned
"""
)
def clean_documents(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = I.table(spark, folder, "documents").select(
        "doc_id", X.clean_text(F.col("text")).alias("c")
    )
    return cleaned.select(
        "doc_id", F.length("c").cast("bigint").alias("chars"), F.md5("c").alias("digest")
    )


TRUNCATE_SQL = """
select {key}, case when length(text) <= {n} then text
  when instr(reverse(left(text, {n})), ' ') > 0
    and length(left(text, {n})) - instr(reverse(left(text, {n})), ' ') > {n} * 0.8
  then left(text, {n} - instr(reverse(left(text, {n})), ' ')) || '...'
  else left(text, {n}) || '...' end as truncated
from {table}
"""


@register(TRUNCATE_SQL.format(key="doc_id", n=200, table="documents"))
def truncate_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = I.table(spark, folder, "documents")
    return documents.select("doc_id", X.truncate_text(F.col("text"), 200).alias("truncated"))


@register(
    """
select conv_id, turn, case when length(text) > 200 then left(text, 200) || '...' else text end
  as preview, length(trim(text)) > 100 as substantial, contains(upper(text), 'OK') as accepted,
  length(text) // 4 as tokens
from conversations
"""
)
def turn_texts(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return I.table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        X.preview(text).alias("preview"),
        X.is_substantial(text).alias("substantial"),
        X.reply_accepted(text).alias("accepted"),
        X.estimate_tokens(text).alias("tokens"),
    )


@register(
    """
with b as (select c_custkey, cast(abs(c_acctbal) as varchar) as t, c_acctbal from customer)
select c_custkey, round(case c_custkey % 6
    when 0 then abs(c_acctbal)
    when 1 then cast(floor(abs(c_acctbal)) as double) * 1000
    when 2 then abs(c_acctbal)
    when 3 then cast('9' || t as double)
    when 4 then null
    else cast(floor(abs(c_acctbal)) as double) * 1000 end, 4) as amount
from b
"""
)
def normalize_amount(spark: SparkSession, folder: str) -> DataFrame:
    text = F.expr(
        """case c_custkey % 6
        when 0 then concat('$', cast(c_acctbal as string))
        when 1 then concat(cast(cast(floor(abs(c_acctbal)) as bigint) as string), 'K a year')
        when 2 then replace(cast(c_acctbal as string), '.', ',')
        when 3 then concat('9,', cast(abs(c_acctbal) as string))
        when 4 then 'market rate, 1.2.3'
        else concat('week', cast(cast(floor(abs(c_acctbal)) as bigint) as string)) end"""
    )
    amount = F.round(X.normalize_amount(text), 4)
    return I.table(spark, folder, "customer").select("c_custkey", amount.alias("amount"))


# Crawled forms of a page's URL: odd characters, a port, a user, no scheme.
_URL_FORMS = """case page_id % 7
        when 0 then url
        when 1 then replace(url, '/en/', '/x|y/')
        when 2 then concat(url, '&q={a b}')
        when 3 then replace(replace(url, '://blog.', '://blog_1.'), '://www.', '://www_1.')
        when 4 then concat('HTTP://user:pw@Blog.example.org:8080/', cast(page_id as varchar(20)))
        when 5 then concat('example.org/', cast(page_id as varchar(20)))
        else concat('//blog.example.org:443?', cast(page_id as varchar(20))) end"""


@register(
    f"""
with u as (select page_id, {_URL_FORMS} as url from pages),
p as (
  select page_id, url,
    lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) as authority
  from u
)
select page_id, authority, regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', '')
  as host, contains(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', ''), 'blog.')
  as is_blog, sha256(url) as url_key
from p
"""
)
def url_host(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("url")
    pages = I.table(spark, folder, "pages").select("page_id", F.expr(_URL_FORMS).alias("url"))
    return pages.select(
        "page_id",
        X.url_authority(url).alias("authority"),
        X.url_host(url).alias("host"),
        X.host_contains(url, "blog.").alias("is_blog"),
        X.url_key(url).alias("url_key"),
    )


def _document_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as untidy replies: the object is bare, wrapped, fenced, broken or missing."""
    reply = F.expr(
        """case doc_id % 8
        when 0 then body
        when 1 then concat(text, ' ', body, ' ', text)
        when 2 then concat('set {1} ```json\\n', body, '\\n``` ', text)
        when 3 then concat('{x} ```\\n', body, '\\n```')
        when 4 then concat(text, ' ', body, ' and {"b":2}')
        when 5 then text
        when 6 then concat('[', body, ']')
        else concat('{', substring(body, 2, length(body) - 2), ',}') end"""
    )
    body = F.to_json(F.struct(F.col("doc_id").alias("Doc Id"), F.col("lang").alias("Lang-Code")))
    named = I.table(spark, folder, "documents").select("doc_id", "text", body.alias("body"))
    return named.select("doc_id", reply.alias("raw_response"))


@register(
    """
select doc_id, case doc_id % 8 when 0 then 'whole' when 1 then 'greedy' when 2 then 'json_fence'
    when 3 then 'fence' when 4 then 'balanced' when 6 then 'whole' when 7 then 'repaired' end
    as rung,
  case when doc_id % 8 not in (5, 6) then doc_id end as found_id,
  case when doc_id % 8 not in (5, 6) then lang end as found_lang
from documents
"""
)
def reply_extraction(spark: SparkSession, folder: str) -> DataFrame:
    parsed = reply_ops.parse_replies(_document_replies(spark, folder), repair=True)
    data = F.col("parsed_response")
    return parsed.select(
        "doc_id",
        "rung",
        F.try_variant_get(data, "$.doc_id", "bigint").alias("found_id"),
        F.try_variant_get(data, "$.lang_code", "string").alias("found_lang"),
    )


@register(
    """
select doc_id, md5(case doc_id % 8 when 5 then trim(text) else
    '[{"Doc Id":' || doc_id || ',"Lang-Code":"' || lang || '"}]' end) as digest
from documents where doc_id % 8 in (5, 6)
union all
select doc_id, md5('{"Doc Id":' || doc_id || ',"Lang-Code":"' || lang || '",}')
from documents where doc_id % 8 = 7
"""
)
def reply_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    _, bad = reply_ops.split_replies(reply_ops.parse_replies(_document_replies(spark, folder)))
    digest = F.md5(X.strip(F.col("raw_response")))
    return bad.select("doc_id", digest.alias("digest"))


@register(
    """
select c_custkey, c_name as customer_name, cast(c_nationkey as double) * 1000 as salary_min,
  c_custkey % 2 = 0 as remote_work, cast(null as varchar) as n_a,
  c_mktsegment || '|' || case when c_nationkey = 0 then '' else c_nationkey || '|' end || 'True'
    as tags,
  c_custkey % 3 = 0 as x_y, 'later' as twice,
  'customer_name,n_a,nested_block,remote_work,salary_min,tags,twice' as names
from customer
"""
)
def value_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    text = F.expr(
        """concat('{" Customer Name":" ', c_name, ' ","Salary Min":"', c_nationkey, 'k",',
        '"remote-work":"', if(c_custkey % 2 = 0, 'Yes', 'no'), '","N-A":"N/A",',
        '"tags":[" ', c_mktsegment, ' ","",null,0,', c_nationkey, ',true,[]],',
        '"Nested Block":{"X Y":"', if(c_custkey % 3 = 0, 'TRUE', 'False'), '"},',
        '"Twice":"first","twice":" later "}')"""
    )
    customers = deal(I.table(spark, folder, "customer"))
    cleaned = customers.select("c_custkey", J.clean_json(text).alias("v"))

    def read(path: str, kind: str):
        return F.try_variant_get("v", f"$.{path}", kind).alias(path.split(".")[-1])

    names = F.array_join(F.array_sort(F.map_keys(J.object_map(F.col("v")))), ",")
    tags = F.array_join(F.try_variant_get("v", "$.tags", "array<string>"), "|")
    return cleaned.select(
        "c_custkey",
        read("customer_name", "string"),
        read("salary_min", "double"),
        read("remote_work", "boolean"),
        read("n_a", "string"),
        tags.alias("tags"),
        read("nested_block.x_y", "boolean"),
        read("twice", "string"),
        names.alias("names"),
    )


ARTICLE_SQL = f"""
article as (
  select page_id, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|\\z)', 1) as raw from pages
),
tagless as (
  select page_id, regexp_replace(regexp_replace(raw, '</?(b|a)( [^>]*)?>', '', 'g'),
    '<[^>]*>', ' ', 'g') as raw
  from article
),
decoded as (
  select page_id,
    replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')
    as raw
  from tagless
),
content as (
  select page_id, trim(regexp_replace(raw, '{SPACES_SQL}+', ' ', 'g')) as text from decoded
)
"""


BODY_SQL = f"""
body as (
  select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_extract(html, '(?s)<body[^>]*>(.*)', 1), '(?s)<!--.*?-->', '', 'g'),
    '(?s)<(script|DROPPED).*?</(script|DROPPED)>', '', 'g'),
    '</?(b|a)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') as raw
  from pages
),
body_text as (
  select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(raw,
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
    '{SPACES_SQL}+', ' ', 'g')) as text
  from body
)
"""


@register(
    f"with {ARTICLE_SQL}, {BODY_SQL.replace('DROPPED', 'nav|footer')},"
    + """
plain as (
  select page_id, regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) as block from pages
),
chosen as (
  select page_id, case when length(a.text) > 100 then 'article'
      when length(trim(block)) > 50 and length(b.text) > 100 then 'largest_block'
      else 'full_body' end as strategy,
    case when length(a.text) > 100 then a.text else b.text end as text
  from content a join body_text b using (page_id) join plain using (page_id)
),
cut as ("""
    + TRUNCATE_SQL.format(key="page_id, strategy", n=50000, table="chosen")
    + """)
select page_id, strategy, length(truncated) as chars, md5(truncated) as digest from cut
"""
)
def page_content(spark: SparkSession, folder: str) -> DataFrame:
    found = content_ops.extract_content(I.table(spark, folder, "pages"))
    return found.select(
        "page_id",
        "strategy",
        F.length("content").cast("bigint").alias("chars"),
        F.md5("content").alias("digest"),
    )


@register(
    f"""
with {ARTICLE_SQL}, {BODY_SQL.replace('DROPPED', 'style')},
lengths as (
  select 'selector_article' as strategy, length(text) as length from content
  union all select 'full_body', length(text) from body_text
)
select strategy, count(*) as pages, round(avg(length), 4) as avg_length
from lengths group by strategy
"""
)
def page_strategy_profile(spark: SparkSession, folder: str) -> DataFrame:
    strategies = content_ops.page_strategies(I.table(spark, folder, "pages"))
    summary = content_ops.strategy_summary(strategies)
    return summary.withColumn("avg_length", F.round("avg_length", 4))


@register(
    """
select page_id, replace(replace(replace(replace(
    regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'),
    '&quot;', '"'), '&amp;', '&') as title
from pages
"""
)
def page_titles(spark: SparkSession, folder: str) -> DataFrame:
    title = P.page_title(F.col("html"))
    return I.table(spark, folder, "pages").select("page_id", title.alias("title"))


@register(
    """
with sized as (
  select source, doc_id, length(trim(text)) as chars,
    row_number() over (partition by source order by length(trim(text)) desc, doc_id) as rank
  from documents
)
select source, doc_id, chars from sized where rank = 1
"""
)
def largest_block(spark: SparkSession, folder: str) -> DataFrame:
    documents = I.table(spark, folder, "documents").select("source", "doc_id", "text")
    best = content_ops.largest_block(documents, ["source"], "text", "doc_id")
    chars = F.length(X.strip(F.col("text"))).cast("bigint")
    return best.select("source", "doc_id", chars.alias("chars"))


def _template(spark: SparkSession, folder: str) -> DataFrame:
    regions = I.table(spark, folder, "region")
    return regions.agg(F.concat(F.lit("Region "), F.min("r_name")).alias("template"))


PROMPT_SQL = """
prompts as (
  select doc_id, lang, 'Region ' || (select min(r_name) from region) || chr(10) || chr(10)
    || 'Job Advertisement Content:' || chr(10) || text as prompt, text
  from documents
)
"""


@register(
    f"""
with {PROMPT_SQL}
select doc_id, md5(prompt) as digest, length(prompt) as chars, length(prompt) // 4 as tokens
from prompts
"""
)
def prompt_assembly(spark: SparkSession, folder: str) -> DataFrame:
    documents = I.table(spark, folder, "documents").select("doc_id", "text")
    prompts = assemble_prompts(documents, _template(spark, folder), text="text")
    return prompts.select(
        "doc_id",
        F.md5("prompt").alias("digest"),
        F.length("prompt").cast("bigint").alias("chars"),
        X.estimate_tokens(F.col("prompt")).alias("tokens"),
    )


@register(
    f"""
with {PROMPT_SQL}
select lang, count(*) as replies, cast(sum(length(prompt)) as bigint) as prompt_chars,
  cast(sum(length(text)) as bigint) as response_chars,
  round(avg(length(prompt)), 4) as avg_prompt_length,
  round(avg(length(text)), 4) as avg_response_length, max(length(text)) as max_response_length
from prompts group by lang
"""
)
def reply_metrics(spark: SparkSession, folder: str) -> DataFrame:
    documents = I.table(spark, folder, "documents").select("lang", "text")
    prompts = assemble_prompts(documents, _template(spark, folder), text="text")
    metrics = reply_ops.reply_metrics(reply_ops.with_lengths(prompts, "prompt", "text"), ["lang"])
    return metrics.select(
        "lang",
        "replies",
        "prompt_chars",
        "response_chars",
        F.round("avg_prompt_length", 4).alias("avg_prompt_length"),
        F.round("avg_response_length", 4).alias("avg_response_length"),
        F.col("max_response_length").cast("bigint").alias("max_response_length"),
    )


def open_length_scorer():
    """Stand-in for a model: gives the prompt length, refuses lengths divisible by seven."""

    def reply(system: str, prompt: str) -> tuple[str, dict]:
        if len(prompt) % 7 == 0:
            raise ValueError("refused")
        return json.dumps({"Prompt Length": len(prompt)}), {"calls": 1}

    return reply


@register(
    f"""
with {PROMPT_SQL}
select doc_id, case when length(prompt) % 7 <> 0 then length(prompt) end as found,
  case when length(prompt) % 7 = 0 then 'refused' end as error,
  case when length(prompt) % 7 = 0 then 2 else 1 end as attempts,
  case when length(prompt) % 7 <> 0 then '{{"calls": 1}}' end as usage
from prompts
"""
)
def score_stub(spark: SparkSession, folder: str) -> DataFrame:
    documents = I.table(spark, folder, "documents").select("doc_id", "text")
    prompts = assemble_prompts(documents, _template(spark, folder), text="text")
    scored = score(
        prompts, open_length_scorer, ["doc_id"], attempts=2, wait_factor=0.0, wait_range=(0, 0)
    )
    parsed = reply_ops.parse_replies(scored)
    found = F.try_variant_get("parsed_response", "$.prompt_length", "bigint")
    return parsed.select("doc_id", found.alias("found"), "error", "attempts", "usage")


@register(
    """
select conv_id, turn, role, md5(text) as digest from conversations
qualify row_number() over (partition by conv_id order by turn desc) = 1
"""
)
def latest_reply(spark: SparkSession, folder: str) -> DataFrame:
    last = latest(I.table(spark, folder, "conversations"), ["conv_id"], "turn")
    return last.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


def _work(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = I.table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("key"), "o_totalprice"
    )
    done = I.table(spark, folder, "customer").filter("c_acctbal > 4000").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value")
    )
    return orders, done


@register(
    """
select o_orderkey, o_custkey as key from orders
where not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 4000)
"""
)
def incremental_work(spark: SparkSession, folder: str) -> DataFrame:
    orders, done = _work(spark, folder)
    return remaining(orders, done, ["key"]).select("o_orderkey", "key")


@register(
    """
select c_custkey as key, c_acctbal as value, 'reused' as origin from customer
where c_acctbal > 4000 and exists (select 1 from orders where o_custkey = c_custkey)
union all
select o_custkey, max(o_totalprice), 'computed' from orders
where not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 4000)
group by o_custkey
"""
)
def incremental_union(spark: SparkSession, folder: str) -> DataFrame:
    orders, done = _work(spark, folder)
    merged = reuse_or_compute(
        orders,
        done.withColumn("origin", F.lit("reused")),
        ["key"],
        lambda work: work.groupBy("key").agg(
            F.max("o_totalprice").alias("value"), F.lit("computed").alias("origin")
        ),
    )
    return merged.select("key", "value", "origin")
