"""URL filters: dated list entries become validity intervals, and an as-of join evaluates each capture against the entries
active when it was fetched.  DataFrame functions only.

An entry names a key: "host.tld" (the host and all below it) or "host.tld/dir/" (the host's paths below it).  A capture has
one key for each suffix of its host (an address has itself only) and each directory of its path; the longest active key decides
(allow or block).  Interval lists are gathered by key and joined on it, so the list side has one row a key and a hot host splits freely
on the capture side (AQE); Spark broadcasts the list only where its measured size is below the broadcast threshold.  A key's row is
bounded by the days that the lists cover, as entries are distinct by key, day, action and verdict.

Rows: a null or malformed url has no host, no key and isn't blocked; equal captures fold into one row with n_rows; of entries
for one key and day, "add" comes after "remove"; entries with a null key, day or action are ignored; empty lists block
nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)"
ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|\[.*)$"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """(key, day, action add|remove, verdict) to one row a key with an array of (since, until, verdict); until is exclusive, null: open."""
    w = Window.partitionBy("key").orderBy("day", F.col("action") == "add", "verdict")
    good = entries.where("key is not null and day is not null and action is not null").select("key", "day", "action", "verdict").distinct()
    spans = good.withColumn("until", F.lead("day").over(w)).where("action = 'add' and (until is null or until > day)")
    return spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("day").alias("since"), "until", "verdict"))).alias("spans"))


def keys_of(url: Column) -> Column:
    """All keys under which an entry for this url may stand."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = F.when(host.rlike(ADDRESS), F.array(host)).otherwise(suffixes)
    dirs = F.split(F.regexp_replace(F.regexp_extract(url, PATH, 1), "[^/]*$", ""), "/")
    paths = F.transform(F.sequence(F.lit(2), F.size(dirs)), lambda i: F.concat(host, F.array_join(F.slice(dirs, 1, i - 1), "/"), F.lit("/")))
    return F.when(host != "", F.array_distinct(F.concat(hosts, F.when(F.size(dirs) > 1, paths).otherwise(F.array().cast("array<string>")))))


def evaluate(captures: DataFrame, lists: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched) against intervals(): one row a different capture, with its verdict and active entries."""
    own = ["page_id", "url", "fetched"]
    folded = captures.groupBy(*own).agg(F.count("*").alias("n_rows"))
    asked = folded.withColumn("key", F.explode_outer(keys_of(F.col("url"))))
    active = F.filter(F.col("spans"), lambda s: (s.since <= F.col("fetched")) & (s.until.isNull() | (s.until > F.col("fetched"))))
    found = asked.join(lists, "key", "left").withColumn("active", F.try_element_at(F.coalesce(active, F.array().cast(lists.schema["spans"].dataType)), F.lit(-1)))
    hit = F.when(F.col("active").isNotNull(), F.struct(F.length("key").alias("n"), F.col("key").alias("key"), F.col("active.verdict").alias("verdict")))
    said = F.when(F.col("active").isNotNull(), F.concat_ws(":", "key", "active.verdict", F.date_format("active.since", "yyyy-MM-dd")))
    out = found.groupBy(*own, "n_rows").agg(F.max(hit).alias("best"), F.count(hit).alias("n_active"), F.array_join(F.array_sort(F.collect_list(said)), ",").alias("entries"))
    return out.select(*own, "n_rows", "n_active", F.coalesce(F.col("best.verdict") == "block", F.lit(False)).alias("blocked"), F.col("best.key").alias("decided_by"), "entries")


def _number(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 7), 16, 10).cast("int")


def demo_list(pages: DataFrame) -> DataFrame:
    """Dated entries made by rule from the hosts seen, since the data holds no list: every third host is blocked on some day,
    most are released later and some blocked again; the directory /en/ of every fifth of all hosts is allowed; example.net is blocked for a year."""
    hosts = pages.select(F.lower(F.regexp_extract("url", HOST, 1)).alias("h")).where("h <> ''").distinct().withColumn("m", _number(F.col("h")))
    day = lambda c: F.date_add(F.lit("2020-01-01").cast("date"), c.cast("int"))
    entry = lambda key, at, action, verdict: F.struct(key.alias("key"), at.alias("day"), F.lit(action).alias("action"), F.lit(verdict).alias("verdict"))
    h, m, none = F.col("h"), F.col("m"), F.array().cast("array<struct<key:string,day:date,action:string,verdict:string>>")
    made = F.concat(
        F.when(m % 3 == 0, F.array(entry(h, day(m % 700), "add", "block"))).otherwise(none),
        F.when((m % 3 == 0) & (m % 4 != 0), F.array(entry(h, day(m % 700 + 30 + m % 301), "remove", "block"))).otherwise(none),
        F.when((m % 3 == 0) & (m % 8 == 1), F.array(entry(h, day(m % 700 + 600), "add", "block"))).otherwise(none),
        F.when(m % 5 == 0, F.array(entry(F.concat(h, F.lit("/en/")), day(m % 900), "add", "allow"))).otherwise(none),
    )
    fixed = pages.sparkSession.sql("SELECT 'example.net' key, date'2021-01-01' day, 'add' action, 'block' verdict UNION ALL SELECT 'example.net', date'2022-01-01', 'remove', 'block'")
    return hosts.select(F.inline(made)).unionByName(fixed)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, as fetched on a day that the md5 of the url sets (the data holds no fetch time)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2020-01-01").cast("date"), _number(F.coalesce("url", F.lit(""))) % 1500))
    return evaluate(captures, intervals(demo_list(pages)))


ORACLE = r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)', 1)) AS h,
    DATE '2020-01-01' + (('0x' || substr(md5(coalesce(url, '')), 1, 7))::INT % 1500) AS fetched,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '[^/]*$', '') AS dir FROM pages),
hosts AS (SELECT DISTINCT h, ('0x' || substr(md5(h), 1, 7))::INT AS m FROM p WHERE h <> ''),
e AS (SELECT DISTINCT * FROM (
  SELECT h AS key, DATE '2020-01-01' + m % 700 AS day, 'add' AS action, 'block' AS verdict FROM hosts WHERE m % 3 = 0
  UNION ALL SELECT h, DATE '2020-01-01' + (m % 700 + 30 + m % 301), 'remove', 'block' FROM hosts WHERE m % 3 = 0 AND m % 4 <> 0
  UNION ALL SELECT h, DATE '2020-01-01' + (m % 700 + 600), 'add', 'block' FROM hosts WHERE m % 3 = 0 AND m % 8 = 1
  UNION ALL SELECT h || '/en/', DATE '2020-01-01' + m % 900, 'add', 'allow' FROM hosts WHERE m % 5 = 0
  UNION ALL VALUES ('example.net', DATE '2021-01-01', 'add', 'block'), ('example.net', DATE '2022-01-01', 'remove', 'block'))),
spans AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY key ORDER BY day, action = 'add', verdict) AS until FROM e)
  WHERE action = 'add' AND (until IS NULL OR until > day)),
keys AS (SELECT DISTINCT page_id, url, fetched, key FROM (
  SELECT page_id, url, fetched, array_to_string(list_slice(string_split(h, '.'), i, len(string_split(h, '.'))), '.') AS key
    FROM (SELECT *, unnest(range(1, CASE WHEN regexp_matches(h, '^(\d{1,3}(\.\d{1,3}){3}|\[.*)$') THEN 2 ELSE len(string_split(h, '.')) + 1 END)) AS i FROM p WHERE h <> '')
  UNION ALL SELECT page_id, url, fetched, h || array_to_string(list_slice(string_split(dir, '/'), 1, i), '/') || '/'
    FROM (SELECT *, unnest(range(1, len(string_split(dir, '/')))) AS i FROM p WHERE h <> '' AND dir <> ''))),
hit AS (SELECT k.*, s.verdict, s.day FROM keys k JOIN spans s ON k.key = s.key AND s.day <= k.fetched AND (s.until IS NULL OR s.until > k.fetched)),
best AS (SELECT page_id, url, fetched, count(*) AS n_active, arg_max(verdict, (length(key), key)) AS verdict, arg_max(key, (length(key), key)) AS decided_by,
  string_agg(key || ':' || verdict || ':' || strftime(day, '%Y-%m-%d'), ',' ORDER BY key || ':' || verdict || ':' || strftime(day, '%Y-%m-%d')) AS entries FROM hit GROUP BY ALL)
SELECT c.page_id, c.url, c.fetched, c.n_rows, coalesce(b.n_active, 0) AS n_active, coalesce(b.verdict = 'block', false) AS blocked, b.decided_by, coalesce(b.entries, '') AS entries
FROM (SELECT page_id, url, fetched, count(*) AS n_rows FROM p GROUP BY ALL) c LEFT JOIN best b
  ON c.page_id IS NOT DISTINCT FROM b.page_id AND c.url IS NOT DISTINCT FROM b.url AND c.fetched = b.fetched
"""
