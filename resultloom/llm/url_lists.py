"""URL filters by a temporal list join, in DataFrame functions only.

A list has dated entries: from its day on a domain is blocked, allowed or no longer listed. Entries become validity intervals: each holds until
the next one of its domain. A capture is judged by the entries that were active when it was fetched, for its host and each parent domain;
the longest listed domain decides. The as-of join runs over the different (domain, day) pairs, entries and fetches in one sorted pass
per domain. So a window holds at most two rows per day of the calendar, however many captures and entries a domain has, and
captures only meet the verdict of their (host, day).

Defined results: of several entries of one domain and day the strictest holds (block, then allow, then remove). Captures without a
usable host (null, no scheme) or without a day match nothing; entries without a domain, day or known action are ignored, and so are those
longer than the 253 characters that a name may have. A longer host still meets its listed parent domains. Domains are compared in lower case, without a port, user or closing dot. Repeated captures
each get a row. Other columns of the captures are kept; one with the name of a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: actions from lenient to strict
ACTIONS = ("remove", "allow", "block")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
MAX_NAME, MAX_LABELS = 253, 127   # characters of a domain name, and labels that fit into them


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.+$", "")


def domains_of(host: Column) -> Column:
    """The host and all its parent domains that are names a list can hold, longest first; none of an empty host."""
    labels = F.split(F.right(host, F.lit(MAX_NAME + 1)), r"\.")
    parts = F.slice(labels, F.greatest(F.size(labels) - MAX_LABELS, F.lit(1)), F.lit(MAX_LABELS + 1))
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    # of a host that was cut the first piece may be a part of a label: only what follows a dot of the host is its parent
    whole = F.filter(every, lambda d: (F.length(d) <= MAX_NAME) & ((d == host) | F.endswith(host, F.concat(F.lit("."), d))))
    return F.when(host != "", whole).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame, domain: str = "domain", day: str = "day", action: str = "action") -> DataFrame:
    """``domain, valid_from, valid_to, action``: valid_to is exclusive, null for the last entry of a domain."""
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col(action))
    name = F.regexp_replace(F.lower(F.trim(domain)), r"\.+$", "")
    daily = entries.select(name.alias("domain"), F.col(day).cast("date").alias("valid_from"), rank.alias("rank")).filter(f"rank > 0 AND domain <> '' AND length(domain) <= {MAX_NAME} AND valid_from IS NOT NULL")
    daily = daily.groupBy("domain", "valid_from").agg(F.max("rank").alias("rank"))
    following = F.lead("valid_from").over(Window.partitionBy("domain").orderBy("valid_from"))
    return daily.select("domain", "valid_from", following.alias("valid_to"), F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank").cast("int")).alias("action"))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Adds ``host, listed_domain, action, valid_from, valid_to, blocked`` to the captures."""
    results = ("host", "listed_domain", "action", "valid_from", "valid_to", "blocked")
    kept = [c for c in captures.columns if c not in results]
    captures = captures.withColumn("host", host_of(F.col(url))).withColumn("__day", F.col(fetched).cast("date"))
    visits = captures.select("host", "__day").filter("host <> '' AND __day IS NOT NULL").distinct()
    asked = visits.select("host", "__day", F.posexplode(domains_of(F.col("host"))).alias("depth", "domain"))
    # as-of: on its day an entry comes before the fetches of that day
    points = asked.select("domain", "__day").distinct().select("domain", "__day", F.lit(None).cast("struct<valid_from:date,valid_to:date,action:string>").alias("entry"), F.lit(1).alias("seq"))
    listed = intervals(entries).select("domain", F.col("valid_from").alias("__day"), F.struct("valid_from", "valid_to", "action").alias("entry"), F.lit(0).alias("seq"))
    order = Window.partitionBy("domain").orderBy("__day", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = listed.unionByName(points).withColumn("entry", F.last("entry", ignorenulls=True).over(order)).filter("seq = 1 AND entry IS NOT NULL AND entry.action <> 'remove'")
    verdicts = asked.join(active.select("domain", "__day", "entry"), ["domain", "__day"])
    verdicts = verdicts.groupBy("host", "__day").agg(F.min_by(F.struct("domain", "entry"), "depth").alias("best"))
    out = captures.join(verdicts, ["host", "__day"], "left")
    entry = "best.entry"
    return out.select(*kept, "host", F.col("best.domain").alias("listed_domain"), F.col(f"{entry}.action").alias("action"), F.col(f"{entry}.valid_from").alias("valid_from"),
                      F.col(f"{entry}.valid_to").alias("valid_to"), F.coalesce(F.col(f"{entry}.action") == "block", F.lit(False)).alias("blocked"))
