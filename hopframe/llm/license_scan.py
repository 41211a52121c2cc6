"""License scans by diagonal voting, in DataFrame functions only.

All rolling k-word hashes of every text meet the k-word hashes of a few template texts in one
broadcast join; the template table is a literal of known size. A hit at word ``pos`` of a text
and ``tpos`` of a template votes for the diagonal ``pos - tpos``. Votes are summed per document,
template and diagonal; diagonals at most ``gap`` apart, as insertions and deletions make them,
are merged; a merged span counts where the template's words it covers reach ``coverage``; of spans that
begin at one word, those with most of their template covered. The
join compares the words besides their hash, so spans hold no hash collisions.

Cases: null and empty texts have no words, no labels and score 0; texts of any length are read
whole; repeated rows are reported once each; a null id stays null; extra columns, whatever their
names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopframe.llm.common import column

#: Phrases that count wherever their words stand consecutively.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Opening or naming passages of licenses, which may be found with changes.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the terms of the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
]
K = 3
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates(spark: SparkSession, base: list, more: list, k: int) -> DataFrame:
    """(tid, label, is_base, m, tpos, g0.., h): a row per k-word gram of each template of m words."""
    rows = []
    for tid, (label, text) in enumerate([*base, *more]):
        ws = text.split()
        if len(ws) < k:
            raise ValueError(f"{text!r} has fewer than {k} words")
        rows += [(tid, label, tid < len(base), len(ws), i, *ws[i : i + k]) for i in range(len(ws) - k + 1)]
    grams = [f"g{j}" for j in range(k)]
    df = spark.createDataFrame(rows, "tid int, label string, is_base boolean, m int, tpos int, " + ", ".join(f"{g} string" for g in grams))
    return df.withColumn("h", F.xxhash64(*grams))


def words(text) -> F.Column:
    """Words of a text column after lower-casing A-Z."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, _GAPS), "")


def scan(docs: DataFrame, base: list = BASE, more: list = TEMPLATES, k: int = K, gap: int = 2, coverage: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Spans are the merged ones: label, first word, end word, covered share of the template.
    """
    told = templates(docs.sparkSession, base, more, k)
    read = docs.select(column(id_col).alias("doc_id"), words(column(text_col).cast("string")).alias("ws"))
    each = read.withColumn("n_words", F.size("ws").cast("long")).withColumn("row", F.monotonically_increasing_id())
    shifted = [F.col("ws"), *(F.slice("ws", j + 1, F.size("ws")) for j in range(1, k))]  # zipped: transform is not compiled
    grams = F.arrays_zip(*(ws.alias(f"w{j}") for j, ws in enumerate(shifted)))
    at = each.select("row", "doc_id", "n_words", F.posexplode_outer(grams).alias("pos", "g"))
    same = F.xxhash64(*(F.col(f"g.w{j}") for j in range(k))) == F.col("h")
    for j in range(k):
        same = same & (F.col(f"g.w{j}") == F.col(f"g{j}"))
    hits = at.join(F.broadcast(told), same, "left").where("tid is not null or coalesce(pos, 0) = 0")
    hits = hits.select("row", "doc_id", "n_words", "tid", "label", "is_base", "m", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    doc = ["row", "doc_id", "n_words"]
    what = ["tid", "label", "is_base", "m"]
    votes = hits.repartition("row").groupBy(*doc, *what, "diagonal").agg(F.collect_set("tpos").alias("seen"))
    in_order = Window.partitionBy(*doc, *what).orderBy("diagonal")
    far = (F.col("diagonal") - F.lag("diagonal").over(in_order) > gap).cast("int")
    island = votes.withColumn("far", far).withColumn("island", F.coalesce(F.sum("far").over(in_order), F.lit(0)))
    whole = F.col("is_base") & (F.size("seen") == F.col("m") - k + 1)
    span = island.groupBy(*doc, *what, "island").agg(
        F.count_if(whole).alias("places"),
        F.min(F.when(whole, F.col("diagonal"))).alias("low"),
        F.max(F.when(whole, F.col("diagonal"))).alias("high"),
        F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"),
        F.min(F.col("diagonal") + F.array_min("seen")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("seen") + k).alias("end"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("seen", lambda i: F.sequence(i, i + k - 1)))))
    span = span.withColumn("share", F.when(F.col("tid").isNotNull(), covered / F.col("m")))
    span = span.withColumn("best", F.max("share").over(Window.partitionBy(*doc, "first")))
    good = (F.col("share") >= coverage) & (F.col("share") == F.col("best"))
    named = F.when(good & (~F.col("is_base") | (F.col("places") > 0)), F.col("label"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = span.groupBy(*doc).agg(
        F.sum("places").cast("long").alias("n_base"),
        F.min("low").cast("long").alias("first_word"),
        F.max("high").cast("long").alias("last_word"),
        listed(F.when(F.col("places") > 0, F.col("label"))).alias("base_labels"),
        listed(named).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(named.isNotNull(), F.struct("label", "first", "end", "share")))).alias("spans"),
    )
    return out.drop("row")
