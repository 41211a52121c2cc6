"""Temporal list join: captures against the list entries that were active when they were fetched.

A list is a table of dated entries (pattern, listed_on, action). For each pattern an entry is
valid from its date up to the pattern's next one, so entries become intervals that never
overlap. A capture's host asks for itself and each parent domain; the as-of join takes the
entry whose interval holds the fetch date, and the longest pattern decides.

Captures are first reduced to their distinct (host, date) pairs, in each task before any
shuffle, so a host with a third of all captures is one key for each date. Suffixes are asked for
by distinct hosts, without dates, and dealt over ``SALTS`` keys each, as all hosts of a top domain
ask for its name; a host's few patterns then meet its dates. Captures without a host or date take
no part in any join. Whether a side is broadcast is left to the planner's size limit; the other
plan is a shuffle join.

Cases: urls without a host, null urls and null dates match no entry and are kept; entries with
a null field are ignored; of entries of one pattern and date a block wins; repeated rows are
answered once each; extra columns of captures are dropped, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopframe.llm.common import column

#: A dated list of hosts and domains for the pages table.
ENTRIES = [
    ("cheap-pills.example.com", "2024-01-15", "block"),
    ("cheap-pills.example.com", "2024-06-01", "allow"),
    ("cheap-pills.example.com", "2024-08-20", "block"),
    ("free-bets.example.com", "2024-03-01", "block"),
    ("www.cheap-pills.example.com", "2024-09-10", "allow"),
    ("example.net", "2024-04-05", "block"),
    ("example.net", "2024-04-25", "allow"),
    ("tiontion.example.com", "2024-02-11", "block"),
    ("m.tiontion.example.com", "2024-05-30", "allow"),
    ("tionsh.example.com", "2024-07-01", "block"),
    ("example.org", "2024-11-01", "block"),
    ("example.org", "2024-11-01", "allow"),
    ("never-seen.example.com", "2024-01-01", "block"),
]
#: Keys over which the hosts that ask for one suffix are dealt.
SALTS = 16
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host(url) -> F.Column:
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to, action); valid_to is exclusive, null while the entry stands."""
    known = entries.select(F.lower("pattern").alias("pattern"), F.col("listed_on").cast("date").alias("valid_from"), "action").dropna()
    one = known.groupBy("pattern", "valid_from").agg(F.max("action").alias("action"))  # block > allow
    return one.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("pattern").orderBy("valid_from")))


def judged(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, date_col: str) -> DataFrame:
    """Per capture: its id, host, fetched_on, and pattern, action and valid_from of the entry that decides, else nulls."""
    seen = captures.select(column(id_col).alias(id_col), host(column(url_col)).alias("host"), column(date_col).cast("date").alias("fetched_on"))
    known = F.col("host").isNotNull() & F.col("fetched_on").isNotNull()
    asked = seen.where(known).groupBy("host", "fetched_on").agg(F.count("*").alias("n")).select("host", "fetched_on")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = seen.where(known).select("host").distinct()
    salted = hosts.select("host", F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(suffixes).alias("pattern"))
    listed = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    matched = salted.join(listed, ["pattern", "salt"]).drop("salt")
    active = asked.join(matched, "host").where("valid_from <= fetched_on and (valid_to is null or fetched_on < valid_to)")
    best = active.groupBy("host", "fetched_on").agg(F.max_by(F.struct("pattern", "action", "valid_from"), F.length("pattern")).alias("e"))
    found = seen.where(known).join(best, ["host", "fetched_on"], "left").select(id_col, "host", "fetched_on", "e")
    rest = seen.where(~known).select(id_col, "host", "fetched_on", F.lit(None).cast(best.schema["e"].dataType).alias("e"))
    return found.unionByName(rest).select(column(id_col), "host", "fetched_on", "e.pattern", "e.action", "e.valid_from")


def blocked(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, date_col: str) -> DataFrame:
    """The captures' verdicts with ``blocked``: whether the deciding entry blocks."""
    return judged(captures, entries, id_col, url_col, date_col).withColumn("blocked", F.coalesce(F.col("action") == "block", F.lit(False)))
