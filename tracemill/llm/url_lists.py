"""URL filters with dated lists: an as-of join of captures with the entries that were active when they were fetched.

An entry (list, kind, value, action, day) adds or removes a host, a domain with all its subdomains, or a host with a path
prefix. Entries become validity intervals [add, next remove): of several entries for one value and day the removal
counts, repeated additions go on, a removal of nothing does nothing, and an interval without an end stays open.

A capture has one key per host suffix and path prefix. Keys and intervals meet by key, level and time bucket: an interval
takes the finest level at which it covers at most ``WIDE`` + 1 buckets (each level's buckets are ``WIDE`` times as long), and
an open one a level with a single bucket, so no interval becomes many rows however far its days lie apart. A capture looks
into one bucket of each level that occurs. A value with a long history sends a capture only the intervals of its own
buckets; a salt spreads a frequent host over many tasks.

A url without a scheme and host has no keys; null urls and days match nothing. Repeated captures are rows of their own;
captures that share an id are told apart by url and day.
An interval table without rows leaves all captures unmatched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 64               # days of a time bucket
SALTS = 8
WIDE = 16                 # a level's buckets are so many of the level below
LEVELS = 8                # 64 * 16^7 days are more than any two int days lie apart
OPEN = -1                 # the level of intervals without an end
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)"


def host_of(url: Column) -> Column:
    """The lower-case host, empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def keys_of(url: Column) -> Column:
    """(kind, value) of everything a list can name: the host, its domain suffixes, its path prefixes."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    steps = F.filter(F.split(F.coalesce(F.regexp_extract(url, PATH, 1), F.lit("")), "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(
        F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("value")))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    at = F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("value"))), domains, F.when(F.size(steps) > 0, prefixes).otherwise(none))
    return F.array_distinct(F.when(host != "", at).otherwise(none))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, value, since, until) with until null while open."""
    known = entries.where("list IS NOT NULL AND kind IS NOT NULL AND value IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    host = F.substring_index("value", "/", 1)       # hosts have no case, paths do
    known = known.withColumn("value", F.concat(F.lower(host), F.expr("substring(value, char_length(substring_index(value, '/', 1)) + 1)")))
    daily = known.groupBy("list", "kind", "value", "day").agg(F.max(F.col("action") == "remove").alias("off"))
    w = Window.partitionBy("list", "kind", "value").orderBy("day")
    turns = daily.withColumn("before", F.lag("off").over(w)).where(F.col("off") != F.coalesce("before", F.lit(True)))
    return turns.withColumn("until", F.lead("day").over(w)).where(~F.col("off")).select("list", "kind", "value", F.col("day").alias("since"), "until")


def _days(level: int) -> int:
    return BUCKET * WIDE ** level


def _bucket(day: Column, level: Column) -> Column:
    """The bucket of a day at a level; open intervals have one bucket."""
    size = F.element_at(F.array(*[F.lit(_days(n)).cast("bigint") for n in range(LEVELS)]), F.greatest(level, F.lit(0)) + 1)
    return F.when(level == OPEN, F.lit(0).cast("bigint")).otherwise(F.floor(day / size))


def active(captures: DataFrame, spans: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """(id, url, day, list, kind, value, since) of every entry active for a capture, once each."""
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(day_col).cast("int").alias("_day")).where("_url IS NOT NULL AND _day IS NOT NULL")
    length = F.col("until").cast("bigint") - F.col("since")
    level = F.lit(LEVELS - 1)
    for n in range(LEVELS - 2, -1, -1):
        level = F.when(length <= _days(n) * WIDE, F.lit(n)).otherwise(level)
    laid = spans.withColumn("level", F.when(F.col("until").isNull(), F.lit(OPEN)).otherwise(level))
    # at most LEVELS + 1 values
    levels = laid.agg(F.array_sort(F.collect_set("level")).alias("levels")).scalar()
    laid = laid.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("since"), F.col("level")), _bucket(F.coalesce(F.col("until") - 1, F.col("since")), F.col("level")))))
    laid = laid.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = rows.select("_id", "_url", "_day", F.explode(keys_of(F.col("_url"))).alias("k"), levels.alias("levels")).select(
        "_id", "_url", "_day", "k.kind", "k.value", F.explode("levels").alias("level"), F.pmod(F.xxhash64("_id", "_url", "_day"), F.lit(SALTS)).cast("int").alias("salt"))
    keyed = keyed.withColumn("bucket", _bucket(F.col("_day"), F.col("level")))
    met = keyed.join(laid, ["kind", "value", "level", "bucket", "salt"]).where((F.col("_day") >= F.col("since")) & (F.col("until").isNull() | (F.col("_day") < F.col("until"))))
    return met.select(F.col("_id").alias("id"), F.col("_url").alias("url"), F.col("_day").alias("day"), "list", "kind", "value", "since")


def filtered(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day", allow: str = "allow") -> DataFrame:
    """id, n_active, lists, first_since, blocked for every capture. ``blocked``: a list other than ``allow`` names it and
    ``allow`` does not."""
    met = active(captures, intervals(entries), id_col, url_col, day_col).distinct()
    per = met.select(F.col("id").alias("_id"), F.col("url").alias("_url"), F.col("day").alias("_day"), "list", "since").groupBy("_id", "_url", "_day").agg(F.count(F.lit(1)).alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min("since").alias("first_since"),
                                (F.max((F.col("list") != allow).cast("int")) > F.max((F.col("list") == allow).cast("int"))).alias("blocked"))
    url = F.col(url_col).cast("string")
    rows = captures.select(F.col(id_col).alias(id_col), F.col(day_col).cast("int").alias(day_col), host_of(url).alias("host"), url.alias("_own"))
    same = rows[id_col].eqNullSafe(per["_id"]) & rows["_own"].eqNullSafe(per["_url"]) & rows[day_col].eqNullSafe(per["_day"])
    return rows.join(per, same, "left").select(
        id_col, day_col, "host", F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"),
        F.col("first_since").cast("int").alias("first_since"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
