"""URL filter with dated lists: every capture meets the entries that were active when it was fetched.

List events (a domain is put on a list or taken off it on a day) become validity
intervals. A capture depends on its host and day only, so captures are reduced to
distinct (host, day) first, and a host with a third of all pages leaves as many rows
as there are days. Each is asked under all its parent domains by an as-of join:
events and questions of a domain in one window by day, the last event decides.
Verdicts per (host, day) go back to the captures. All steps are DataFrame
operations; of the pages only id, URL and fetch time are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def host_of(url: Column) -> Column:
    """Lower-cased host without port, credentials and closing dot; empty if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"\.$", "")


def domains_of(host: Column) -> Column:
    """The host and its parent domains, longest first; the last label alone is none."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), ".")
    )
    return F.when(host != "", parents).otherwise(F.array().cast("array<string>"))


def validity(events: DataFrame) -> DataFrame:
    """Intervals (list, domain, category, valid_from, valid_to) from events (list, domain, day, listed, category).

    Of several events of a domain on a list and day the last holds: delisting before
    listing, then the larger category. ``valid_to`` is exclusive and null while an
    entry stands. Rows without list, domain or day are left out.
    """
    daily = _daily(events)
    upto = F.lead("day").over(Window.partitionBy("list", "domain").orderBy("day"))
    return daily.withColumn("valid_to", upto).where("listed").select(
        "list", "domain", "category", F.col("day").alias("valid_from"), "valid_to"
    )


def _daily(events: DataFrame) -> DataFrame:
    """One event per list, domain and day; at most as many rows per domain as lists and days."""
    whole = events.where("list is not null and domain is not null and day is not null")
    state = F.max(F.struct(F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("category", F.lit("")).alias("category")))
    return whole.groupBy("list", F.lower("domain").alias("domain"), "day").agg(state.alias("s")).select("list", "domain", "day", "s.*")


def active_entries(questions: DataFrame, intervals: DataFrame) -> DataFrame:
    """As-of join: (domain, day) of ``questions`` with each interval that holds on that day.

    Per domain, starts and ends of intervals and the questions form one sequence by
    day; the state of each list is carried along, so nothing is paired that does not
    hold. Rows per domain are bounded by days times lists.
    """
    lists = intervals.groupBy("domain").agg(F.array_sort(F.collect_set("list")).alias("lists"))
    asked = questions.join(lists, "domain").select("domain", "day", F.explode("lists").alias("list"))
    empty = F.lit(None).cast("string")
    state = "struct<on: boolean, category: string, since: date>"
    begin = intervals.select("domain", "list", F.col("valid_from").alias("day"), F.lit(1).alias("turn"), F.struct(
        F.lit(True).alias("on"), "category", F.col("valid_from").alias("since")).cast(state).alias("state"))
    end = intervals.where("valid_to is not null").select("domain", "list", F.col("valid_to").alias("day"), F.lit(0).alias("turn"), F.struct(
        F.lit(False).alias("on"), empty.alias("category"), F.lit(None).cast("date").alias("since")).cast(state).alias("state"))
    ask = asked.select("domain", "list", "day", F.lit(2).alias("turn"), F.lit(None).cast(state).alias("state"))
    last = Window.partitionBy("domain", "list").orderBy("day", "turn").rowsBetween(Window.unboundedPreceding, 0)
    merged = begin.unionAll(end).unionAll(ask).withColumn("now", F.last("state", ignorenulls=True).over(last))
    return merged.where("turn = 2 and now.on").select("domain", "day", "list", "now.category", "now.since")


def judge_captures(
    captures: DataFrame, events: DataFrame, blocking: list[str], allowing: list[str],
    id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at",
) -> DataFrame:
    """One row per capture: page_id, host, day, n_entries, lists, decided_by, kept.

    Entries of a domain hold for its subdomains too. The longest listed domain
    decides; of its lists an allowing one wins. A capture without host or fetch time
    meets no entry and is kept. Repeated rows are judged each for itself; other
    columns are not read; an empty table gives no rows, an empty list keeps all.
    """
    seen = captures.select(
        F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), F.to_date(time_col).alias("day")
    )
    hosts = seen.where("host != '' and day is not null").select("host", "day").distinct()
    asked = hosts.select("host", "day", F.explode(domains_of(F.col("host"))).alias("domain"))
    active = active_entries(asked.select("domain", "day").distinct(), validity(events))
    met = asked.join(active, ["domain", "day"]).where(F.col("list").isin(blocking + allowing))
    rank = F.struct(F.length("domain").alias("width"), F.col("list").isin(allowing).alias("allowed"), "domain")
    verdict = met.groupBy("host", "day").agg(
        F.count("*").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.max(rank).alias("top")
    )
    return seen.join(verdict, ["host", "day"], "left").select(
        "page_id", "host", "day", F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"),
        F.coalesce("lists", F.lit("")).alias("lists"), F.col("top.domain").alias("decided_by"),
        F.coalesce("top.allowed", F.lit(True)).alias("kept"),
    )
