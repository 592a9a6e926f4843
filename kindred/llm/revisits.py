"""Resolution of not-modified revisit records by an as-of join.

A revisit (a capture whose server answered that nothing had changed) is completed from the latest
earlier full response of the same canonical URL. Its validators are checked against that response:
an entity tag decides where both have one (weak comparison), else the modification date, else the
revisit stands unconfirmed. A confirmed revisit gets the response's payload and the response's
headers, updated by the headers that a not-modified answer may change.

DataFrame functions only. All captures' keys and validators are sorted by ranges of (URL, time, record) and
kept; the as-of join is a window over (URL, range) and a second one over the ranges' last responses, so
that a URL with very many captures, at one instant even, is spread over many tasks and the plan does not
grow with the table. Payloads are fetched once, by the id of the response, of confirmed revisits alone.

Defined results: a record with a null URL or time resolves nothing and is not resolved (reason
'no response'); records of equal time are ordered by record_id, and only earlier ones in that order
count; a null kind is neither a response nor a revisit. Repeated rows are resolved each; where several
responses share an id, URL and time, the one with the least digest, then the least headers, is used. Header names count in lower case, and of names that differ in
case only the first stands. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.shared import cut, thinned

#: Header fields of a stored response that a not-modified answer does not change.
FIXED_HEADERS = ("content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag", "transfer-encoding")


def canonical_url(url: Column) -> Column:
    """Without scheme, `www.`, default port, fragment, `utm_` parameters and a last slash; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z]+://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    rest = F.regexp_replace(rest, "([?&])utm_[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&+", "&"), "[?]&", "?"), "[?&]$", "")
    return F.concat(host, F.regexp_replace(rest, "/$", ""))


def _tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def lower_names(headers: Column) -> Column:
    """A map with its names in lower case; of names that differ in case only the first stays."""
    names = F.transform(F.map_keys(headers), F.lower)
    first = F.map_filter(headers, lambda k, _: F.array_position(names, F.lower(k)) == F.array_position(F.map_keys(headers), k))
    return F.transform_keys(first, lambda k, _: F.lower(k))


def _listed(headers: Column) -> Column:
    """Headers in a form that can be ordered."""
    return F.coalesce(F.array_sort(F.map_entries(headers)), F.array().cast("array<struct<key:string,value:string>>"))


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit of a table (record_id, url, ts, kind, etag, last_modified, headers, payload).

    kind is 'response' or 'revisit'; headers a map. Result: record_id, url (canonical),
    ts, response_id, confirmed, reason, headers (merged, null unless confirmed), payload.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url"), F.col("ts").cast("long").alias("ts"), "kind", "etag", "last_modified", lower_names(F.col("headers")).alias("headers"), "payload")
    own = F.when(F.col("kind") == "revisit", F.col("headers")).alias("new_headers")
    dated = rows.where("url is not null and ts is not null and kind in ('response', 'revisit')").select("record_id", "url", "ts", "kind", "etag", "last_modified", own)
    # a block is a range of the sorted captures: the partition number in the row's id
    keys = cut(dated.orderBy("url", "ts", "record_id").withColumn("block", F.shiftright(F.monotonically_increasing_id(), 33)))
    seen = F.when(F.col("kind") == "response", F.struct("ts", F.col("record_id").alias("response_id"), F.col("etag").alias("was_etag"), F.col("last_modified").alias("was_modified")))
    keys = keys.withColumn("seen", seen)
    here = Window.partitionBy("url", "block").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    within = keys.withColumn("found", F.last("seen", ignorenulls=True).over(here)).where("kind = 'revisit'")
    # of each URL and block: the last response of an earlier block
    before = Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = keys.groupBy("url", "block").agg(F.max("seen").alias("seen"))
    carried = ends.select("url", "block", F.last("seen", ignorenulls=True).over(before).alias("carried"))
    joined = within.join(carried, ["url", "block"], "left").select("record_id", "url", "ts", "etag", "last_modified", "new_headers", F.coalesce("found", "carried").alias("r"))
    missing = rows.where("kind = 'revisit' and (url is null or ts is null)").select("record_id", "url", "ts", "etag", "last_modified", own, F.lit(None).cast(joined.schema["r"].dataType).alias("r"))
    both_tags = F.col("etag").isNotNull() & F.col("r.was_etag").isNotNull()
    both_dates = F.col("last_modified").isNotNull() & F.col("r.was_modified").isNotNull()
    reason = (
        F.when(F.col("r").isNull(), "no response")
        .when(both_tags, F.when(_tag(F.col("etag")) == _tag(F.col("r.was_etag")), "etag").otherwise("etag differs"))
        .when(both_dates, F.when(F.col("last_modified") == F.col("r.was_modified"), "last-modified").otherwise("last-modified differs"))
        .otherwise("no validator")
    )
    judged = joined.unionByName(missing).withColumn("reason", reason).withColumn("confirmed", F.col("reason").isin("etag", "last-modified"))
    judged = cut(judged.select("record_id", "url", "ts", "new_headers", F.col("r.response_id").alias("response_id"), F.col("r.ts").alias("response_ts"), "confirmed", "reason"))
    full = rows.where("kind = 'response'").select(F.col("record_id").alias("response_id"), F.col("ts").alias("response_ts"), "url", "headers", "payload")
    full = thinned(full, judged.where("confirmed").select("response_id"), "response_id")
    order = F.struct(F.sha2(F.coalesce("payload", F.lit("")), 256), _listed(F.col("headers")))
    full = full.groupBy("response_id", "response_ts", "url").agg(F.min_by(F.struct("headers", "payload"), order).alias("full"))
    out = judged.join(full, ["response_id", "response_ts", "url"], "left")
    changed = F.map_filter(F.coalesce("new_headers", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*FIXED_HEADERS))
    stored = F.coalesce(F.col("full.headers"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(changed), k))
    return out.select("record_id", "url", "ts", "response_id", "confirmed", "reason", F.when(F.col("confirmed"), F.map_concat(kept, changed)).alias("headers"), F.when(F.col("confirmed"), F.col("full.payload")).alias("payload"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Captures told from pages, one response and one revisit a page.

    A page is captured at hour 2 * page_id; the revisit of its URL follows at an hour that depends on
    page_id mod 7. Revisits carry the right tag, a weak tag, only a date, a wrong tag, or no validator,
    by page_id mod 5; every fourth page has no tag, so that dates decide.
    """
    n = F.col("page_id")
    tag = F.when(n % 4 != 0, F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16), F.lit('"')))
    date = F.concat(F.lit("day "), (n % 28).cast("string"))
    text = lambda x: x.cast("string")
    response = pages.select(
        (2 * n).alias("record_id"), "url", (2 * n).alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), date.alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), text(F.length("html")), F.lit("cache-control"), F.lit("no-cache"), F.lit("server"), F.lit("a")).alias("headers"),
        F.col("html").alias("payload"),
    )
    sent = F.when(n % 5 == 0, tag).when(n % 5 == 1, F.concat(F.lit("W/"), tag)).when(n % 5 == 3, F.lit('"other"'))
    revisit = pages.select(
        (2 * n + 1).alias("record_id"), "url", (2 * n + 1 + 20 * (n % 7)).alias("ts"), F.lit("revisit").alias("kind"), sent.alias("etag"), F.when(n % 5 <= 2, date).alias("last_modified"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.concat(F.lit("max-age="), text(n % 100)), F.lit("date"), F.concat(F.lit("hour "), text(n))).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)


def op6_revisits(spark, sf_dir: str) -> DataFrame:
    """Revisits of all pages, resolved."""
    found = resolve(records_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    header = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return found.select("record_id", "url", "ts", "response_id", "confirmed", "reason", header.alias("headers"), F.sha2(F.col("payload").cast("binary"), 256).alias("payload_sha256"))


ORACLE = r"""
with u as (select page_id n, html, regexp_replace(regexp_replace(trim(url), '^[A-Za-z]+://', ''), '#.*$', '') b from pages),
c as (select n, html, regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^www[.]', ''), ':(80|443)$', '') ||
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '^[^/?]*', ''), '([?&])utm_[^&]*', '\1', 'g'), '&+', '&', 'g'), '[?]&', '?', 'g'), '[?&]$', ''), '/$', '') url,
        case when n % 4 <> 0 then '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' end tag, 'day ' || (n % 28) dated from u),
r as (select 2 * n id, url, 2 * n ts, tag, dated, html from c),
v as (select n, 2 * n + 1 id, url, 2 * n + 1 + 20 * (n % 7) ts, case n % 5 when 0 then tag when 1 then 'W/' || tag when 3 then '"other"' end tag, case when n % 5 <= 2 then dated end dated from c),
j as (select v.*, r.id rid, r.tag rtag, r.dated rdated, r.html, row_number() over (partition by v.id order by r.ts desc, r.id desc) k
      from v left join r on r.url = v.url and (r.ts < v.ts or r.ts = v.ts and r.id < v.id)),
w as (select *, case when rid is null then 'no response'
        when tag is not null and rtag is not null then case when regexp_replace(tag, '^W/', '') = regexp_replace(rtag, '^W/', '') then 'etag' else 'etag differs' end
        when dated is not null and rdated is not null then case when dated = rdated then 'last-modified' else 'last-modified differs' end
        else 'no validator' end reason from j where k = 1)
select id record_id, url, ts, rid response_id, reason in ('etag', 'last-modified') confirmed, reason,
  case when reason in ('etag', 'last-modified') then 'cache-control=max-age=' || (n % 100) || ';content-length=' || length(html) || ';content-type=text/html;date=hour ' || n || ';server=a' end headers,
  case when reason in ('etag', 'last-modified') then sha256(html) end payload_sha256
from w
"""
