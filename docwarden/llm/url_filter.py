"""URL filtering by dated lists, as a temporal join in DataFrame operations only.

A list is a log: on a day an entry (a host, a parent domain, or a host with leading path parts) is added
to a category or removed from it. The log of a pattern and category becomes validity intervals, from a
day on until the day of the next change. A capture asks for its own host, every parent domain, and every
leading part of its path, each at its own fetch day: an as-of join that finds what was listed on that day,
not what is listed today.

Intervals are cut at the borders of ``SPAN``-day buckets, so that the join has equal keys (pattern,
bucket) and a capture meets the few intervals of one bucket only. Changes of one day are one change
before they are ordered, so that a pattern has one row per calendar day at most, whatever the log's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 30

#: Captures and a list made from the given pages (Spark and DuckDB SQL alike). Days count from 0.
CAPTURES = "select page_id, url, cast((page_id * 7919) % 365 as int) as day from pages"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 2))


def patterns_of(url: Column) -> Column:
    """What a list may name to cover this URL: host, parent domains, host with leading path parts."""
    host = host_of(url)
    labels = F.split(host, r"\.", -1)
    parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/", -1), lambda p: p != "")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    leading = F.when(F.size(parts) > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"))))
    return F.when(host != "", F.array_distinct(F.concat(parents, F.coalesce(leading, F.array().cast("array<string>")))))


def intervals(log: DataFrame, end: Column | int) -> DataFrame:
    """(pattern, category, since, until) from a log (pattern, category, day, listed). Of an addition and
    a removal on one day the addition counts. What is still listed lasts until ``end``. Rows with a null
    are ignored."""
    daily = log.dropna(subset=["pattern", "category", "day", "listed"]).groupBy("pattern", "category", "day").agg(F.max("listed").alias("listed"))
    following = F.lead("day").over(Window.partitionBy("pattern", "category").orderBy("day"))
    return (
        daily.withColumn("until", F.coalesce(following, F.lit(end) if isinstance(end, int) else end)).filter("listed and day < until")
        .select("pattern", "category", F.col("day").alias("since"), "until")
    )


def judged(captures: DataFrame, log: DataFrame) -> DataFrame:
    """One row per distinct capture (page_id, url, day): blocked, n_listings, and the categories and
    patterns that were listed on its day. A capture without a URL or day, or whose URL has no host, is
    not blocked. Other columns are ignored; an empty list blocks nothing."""
    keys = captures.select("page_id", "url", "day").distinct()
    asked = keys.select("*", F.explode_outer(patterns_of(F.col("url"))).alias("pattern")).withColumn("bucket", F.expr(f"day div {SPAN}"))
    last = captures.agg(F.coalesce(F.max("day"), F.lit(0))).first()[0]
    listed = intervals(log, last + 1).select(
        "pattern", "category", "since", "until", F.explode(F.sequence(F.expr(f"since div {SPAN}"), F.expr(f"(until - 1) div {SPAN}"))).alias("bucket"))
    a, b = asked.alias("a"), listed.alias("b")
    hits = a.join(b, F.expr("a.pattern = b.pattern and a.bucket = b.bucket and a.day >= b.since and a.day < b.until"), "left")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return hits.groupBy("a.page_id", "a.url", "a.day").agg(
        (F.count("b.pattern") > 0).alias("blocked"), F.count("b.pattern").alias("n_listings"),
        joined("b.category").alias("categories"), joined("b.pattern").alias("patterns"),
    )


def list_sql(number: str) -> str:
    """A list over the hosts, parent domains and first path parts of the pages; ``number`` turns a text
    into a whole number. Additions, removals and renewed additions on days that its patterns decide."""
    return f"""
  select pattern, ['malware', 'adult', 'spam'][1 + seed % 3] as category, seed % 200 + step * 45 as day, step % 2 = 0 as listed
  from (select pattern, {number} as seed from names) seeded, (select 0 as step union all select 1 union all select 2) steps
  where seed % 5 < 2 and (step = 0 or seed % 7 < 3 * (3 - step))"""


_SPARK_NUMBER, _DUCK_NUMBER = "cast(conv(substr(md5(pattern), 1, 7), 16, 10) as int)", "('0x' || substr(md5(pattern), 1, 7))::int"


def log_of(pages: DataFrame) -> DataFrame:
    """The list made from the pages: hosts, their parents of three labels, and first path parts."""
    names = pages.select(F.explode(F.filter(patterns_of(F.col("url")), lambda p: ~p.rlike("^example[.]|^[a-z]+$"))).alias("pattern")).distinct()
    seed = F.expr(_SPARK_NUMBER)
    steps = names.withColumn("seed", seed).withColumn("step", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return steps.filter("seed % 5 < 2 and (step = 0 or seed % 7 < 3 * (3 - step))").select(
        "pattern", F.expr("element_at(array('malware', 'adult', 'spam'), 1 + seed % 3)").alias("category"),
        F.expr("seed % 200 + step * 45").alias("day"), F.expr("step % 2 = 0").alias("listed"))


def oracle_sql() -> str:
    quoted = lambda p: p.replace("'", "''")
    return f"""
with captures as ({CAPTURES}),
split as (
  select *, string_split(host, '.') as labels, list_filter(string_split(path, '/'), lambda p: p <> '') as parts
  from (select *, lower(regexp_extract(url, '{quoted(HOST)}', 2)) as host, regexp_extract(url, '{quoted(PATH)}', 1) as path from captures)),
asked as (
  select page_id, url, day, unnest(list_distinct(list_concat(
    list_transform(range(1, len(labels) + 1), lambda k: array_to_string(labels[k:], '.')),
    list_transform(range(1, len(parts) + 1), lambda k: host || '/' || array_to_string(parts[1:k], '/'))))) as pattern
  from split where host <> ''),
names as (select distinct pattern from asked where not regexp_matches(pattern, '^example[.]|^[a-z]+$')),
log as ({list_sql(_DUCK_NUMBER)}),
daily as (select pattern, category, day, bool_or(listed) as listed from log group by all),
valid as (
  select pattern, category, day as since, listed, coalesce(lead(day) over (partition by pattern, category order by day), (select max(day) + 1 from captures)) as until
  from daily),
hits as (
  select a.page_id, a.url, a.day, b.pattern, b.category
  from asked a join valid b on a.pattern = b.pattern and b.listed and a.day >= b.since and a.day < b.until),
per as (
  select page_id, url, day, count(*) as n, array_to_string(list_sort(list(distinct category)), ',') as categories,
         array_to_string(list_sort(list(distinct pattern)), ',') as patterns
  from hits group by all)
select c.page_id, c.url, c.day, coalesce(n, 0) > 0 as blocked, coalesce(n, 0)::bigint as n_listings, coalesce(categories, '') as categories, coalesce(patterns, '') as patterns
from (select distinct * from captures) c left join per p on c.page_id = p.page_id and c.url = p.url and c.day = p.day"""
