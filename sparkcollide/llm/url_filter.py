"""Temporal URL lists: dated entries, validity intervals and an as-of join, in DataFrame functions only.

An entry says that from a time on a pattern is blocked, allowed or retired on
one list.  Entries of a pattern in time order become intervals that do not
overlap.  A capture is looked up under its host, its parent domains and its
path prefixes, each with the interval that holds its fetch time.  The longest
pattern decides; between lists of equal pattern, a block wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)"
SHARE = 1024  # a key with more than 1 / SHARE of all lookups is hot, hence fewer than SHARE of them
SALTS = 64  # parts of a hot key


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, action, valid_from, valid_to): what a pattern's entries say, from each until the next.

    ``entries``: (list, pattern, action, effective_at).  Of entries with equal
    times, the alphabetically last action holds (retire, then block, then
    allow); repeated rows are one.  ``valid_to`` is exclusive, null for the last
    one.  Retired stretches and entries with a null are left out.
    """
    known = entries.select("list", "pattern", "action", "effective_at").na.drop()
    once = known.groupBy("list", "pattern", "effective_at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "pattern").orderBy("effective_at")
    return once.select("list", "pattern", "action", F.col("effective_at").alias("valid_from"), F.lead("effective_at").over(w).alias("valid_to")).where("action <> 'retire'")


def lookup_keys(url: Column) -> Column:
    """Patterns that a URL can match: host, parent domains, and host with each path prefix that ends in a slash."""
    host, path = host_of(url), F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    parts = F.split(path, "/")
    depth = F.size(parts) - 2  # directories
    prefixes = F.when(depth >= 1, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda k: F.concat(host, F.lit("/"), F.concat_ws("/", F.slice(parts, 2, k)), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array(F.lit(""))).otherwise(F.array_distinct(F.concat(domains, prefixes)))


def hot_keys(keyed: DataFrame) -> DataFrame:
    """(hot): the keys of more than 1 / SHARE of all rows; there are fewer than SHARE, whatever the input."""
    total = keyed.agg(F.count("*")).scalar()
    return keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * SHARE > total).select(F.col("key").alias("hot"))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at, host, action, list, pattern, valid_from, valid_to), one row per distinct capture.

    ``captures``: (page_id, url, fetched_at); other columns are not read.
    Nothing in force: the last five are null.  A null or relative URL, or a null
    time, matches nothing and keeps its row.  Both join sides are dealt by the
    pattern, whose intervals are few; captures of a hot pattern are dealt into
    SALTS parts, each of which meets a copy of the pattern's intervals, and are
    reduced to one row each before they are dealt again.
    """
    rows = captures.select("page_id", "url", "fetched_at")
    keyed = rows.select("*", F.explode(lookup_keys(F.col("url"))).alias("key"))
    hot = F.broadcast(hot_keys(keyed.select("key")))
    salt = F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id", "url", "fetched_at"), F.lit(SALTS)).cast("int"))
    keyed = keyed.join(hot, F.col("key") == F.col("hot"), "left").select("page_id", "url", "fetched_at", "key", salt.alias("salt"))
    parts = F.sequence(F.lit(0), F.when(F.col("hot").isNull(), 0).otherwise(SALTS - 1))
    active = intervals(entries).join(hot, F.col("pattern") == F.col("hot"), "left").select("list", "pattern", "action", "valid_from", "valid_to", F.explode(parts).alias("part"))
    holds = (F.col("key") == F.col("pattern")) & (F.col("salt") == F.col("part")) & (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    met = keyed.join(active, holds, "left")
    # longest pattern first, then block before allow, then the list's name
    rank = F.struct(F.length("pattern").alias("size"), (F.col("action") == "block").alias("block"), F.col("list"), F.col("pattern"), F.col("action"), F.col("valid_from"), F.col("valid_to"))
    best = met.groupBy("page_id", "url", "fetched_at").agg(F.max(F.when(F.col("pattern").isNotNull(), rank)).alias("best"))
    return best.select("page_id", "url", "fetched_at", host_of(F.col("url")).alias("host"), *[F.col(f"best.{c}").alias(c) for c in ("action", "list", "pattern", "valid_from", "valid_to")])


def _digits(text: Column, at: int) -> Column:
    """A number below 16**4 from a digest."""
    return F.conv(F.substring(F.md5(text.cast("binary")), at, 4), 16, 10).cast("int")


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list history for the hosts, domains and directories that occur in ``pages``.

    The table holds no lists, so each pattern's history (none to four dated
    entries on two lists, from 2019 on) follows from the digest of its text.
    """
    key = F.explode(lookup_keys(F.col("url"))).alias("pattern")
    patterns = pages.select(key).distinct().where("pattern like '%.%'")
    each = patterns.select("pattern", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"))
    text = F.concat_ws("|", "pattern", "k")
    each = each.where(_digits(text, 1) % 3 == 0)
    action = F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("retire")), _digits(text, 5) % 3 + 1)
    return each.select(F.when(_digits(text, 9) % 2 == 0, "adult").otherwise("malware").alias("list"), "pattern", action.alias("action"), F.date_add(F.lit("2019-01-01").cast("date"), _digits(text, 13) % 1500).alias("effective_at"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date from 2019 to 2023 that follows from page_id and url."""
    text = F.concat_ws("|", F.col("page_id").cast("string"), "url")
    return pages.select("page_id", "url", F.date_add(F.lit("2019-01-01").cast("date"), _digits(text, 1) % 1800).alias("fetched_at"))


def op1_url_filter(pages: DataFrame) -> DataFrame:
    return filter_urls(captures_of(pages), entries_of(pages))


ORACLE = r"""
WITH urls AS (
  SELECT page_id, url, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host,
         coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), '') AS path,
         DATE '2019-01-01' + CAST(CAST('0x' || substr(md5(concat_ws('|', CAST(page_id AS VARCHAR), url)), 1, 4) AS INT) % 1800 AS INT) AS fetched_at
  FROM pages),
keyed AS (
  SELECT DISTINCT page_id, url, host, fetched_at, unnest(list_concat(
      list_transform(generate_series(1, len(string_split(host, '.'))), lambda k: array_to_string(string_split(host, '.')[k:], '.')),
      list_transform(generate_series(1, len(string_split(path, '/')) - 2), lambda k: host || '/' || array_to_string(string_split(path, '/')[2:k + 1], '/') || '/'))) AS key
  FROM urls),
dated AS (
  SELECT key AS pattern, md5(key || '|' || CAST(k AS VARCHAR)) AS m
  FROM (SELECT DISTINCT key FROM keyed WHERE key LIKE '%.%'), (SELECT unnest([1, 2, 3, 4]) AS k)),
entries AS (
  SELECT DISTINCT pattern, CASE WHEN CAST('0x' || substr(m, 9, 4) AS INT) % 2 = 0 THEN 'adult' ELSE 'malware' END AS list,
         ['block', 'allow', 'retire'][CAST('0x' || substr(m, 5, 4) AS INT) % 3 + 1] AS action,
         DATE '2019-01-01' + CAST(CAST('0x' || substr(m, 13, 4) AS INT) % 1500 AS INT) AS effective_at
  FROM dated WHERE CAST('0x' || substr(m, 1, 4) AS INT) % 3 = 0),
once AS (SELECT list, pattern, effective_at, max(action) AS action FROM entries GROUP BY ALL),
spans AS (
  SELECT list, pattern, action, effective_at AS valid_from, lead(effective_at) OVER (PARTITION BY list, pattern ORDER BY effective_at) AS valid_to FROM once),
ranked AS (
  SELECT k.page_id, k.url, k.fetched_at, k.host, s.action, s.list, s.pattern, s.valid_from, s.valid_to,
         row_number() OVER (PARTITION BY k.page_id, k.url, k.fetched_at
                            ORDER BY length(s.pattern) DESC NULLS LAST, CASE WHEN s.action = 'block' THEN 0 ELSE 1 END, s.list DESC, s.pattern DESC) AS r
  FROM keyed k LEFT JOIN spans s ON s.action <> 'retire' AND k.key = s.pattern AND k.fetched_at >= s.valid_from AND (s.valid_to IS NULL OR k.fetched_at < s.valid_to))
SELECT page_id, url, fetched_at, host, action, list, pattern, valid_from, valid_to FROM ranked WHERE r = 1
"""
