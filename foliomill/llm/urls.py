"""URL filters by a temporal list join, in DataFrame functions only.

A list is a history of dated entries: a domain is added to or removed from a
named list on a date.  Entries become validity intervals, half open, and every
capture is evaluated as of its fetch time against the entries then active on its
host or any parent domain.

Scale: captures are not exploded.  Distinct hosts (pre-aggregated) are matched to
the lists by equi-join on their domain suffixes, and each host gets the array of
its intervals, which is bounded by the list's own history of that domain.  One
join brings the array to the captures: the listed hosts are broadcast up to a
checked number and captures stay where they are; beyond it the host side is still
unique, so adaptive execution can split a host that holds a third of all captures.

Hosts are read as browsers read them: a web scheme may lack its slashes
(``http:a.com``) and a link may lack its scheme (``//a.com/x``); user, port and a
trailing dot are dropped; an address in brackets or of four numbers is a host
without parent domains.

Defined results: a null url has a null host and no matches; one without a host has
an empty host and no matches; an entry that is added twice in a row counts from
the first; a removal without an addition has no effect; several events of one
entry at one time count as the last action in alphabetical order; repeated rows
are reported each; empty lists match nothing, and no captures give no rows;
captures' own columns named host or matches are replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, small

MATCH = "array<struct<list:string,domain:string,valid_from:date,valid_to:date>>"


#: the host is the first group
HOST = r"^[\x00-\x20]*(?:(?:[Hh][Tt][Tt][Pp][Ss]?|[Ff][Tt][Pp]|[Ww][Ss][Ss]?):[/\\]*|[A-Za-z][A-Za-z0-9+.-]*://|//)(?:[^/?#\\]*@)?(\[[^\]/?#\\]*\]|[^/?#:@\\\[\]]*?)\.?(?::[0-9]*)?[\x00-\x20]*(?:[/?#\\]|$)"
ADDRESS = r"^(?:\[.*\]|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$"


def host(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def suffixes(host_: Column) -> Column:
    """The host and its parent domains of two and more labels."""
    labels = F.split(host_, r"\.")
    n = F.size(labels)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host_.rlike(ADDRESS), F.array(host_)).otherwise(F.array_distinct(cut))


def intervals(events: DataFrame) -> DataFrame:
    """(list, domain, valid_from, valid_to) from (list, domain, action, day); open ends are null."""
    once = events.groupBy("list", "domain", "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "domain").orderBy("day")
    changed = once.withColumn("was", F.lag("action").over(order)).filter(F.col("was").isNull() | (F.col("was") != F.col("action")))
    return changed.withColumn("valid_to", F.lead("day").over(order)).filter("action = 'add'").select("list", "domain", F.col("day").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with ``host`` and ``matches``: the entries active when each was fetched."""
    # the capture travels as one column, so no name of its own can clash
    named = captures.select(F.struct("*").alias("capture"), host(F.col(url)).alias("host"))
    spans = intervals(events)
    hosts = named.select("host").distinct().filter("host is not null and host <> ''")
    domains = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("domain"))
    of_host = domains.join(spans, "domain").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("list", "domain", "valid_from", "valid_to"))).alias("entries"))
    t = F.col("capture")[fetched]
    active = F.filter(F.coalesce("entries", F.array().cast(MATCH)), lambda e: (e["valid_from"] <= t) & (e["valid_to"].isNull() | (t < e["valid_to"])))
    kept = [F.col("capture")[c].alias(c) for c in captures.columns if c.lower() not in ("host", "matches")]
    listed = small(materialize(of_host, "listed"))
    return named.join(listed, "host", "left").withColumn("matches", active).select(*kept, "host", "matches")
