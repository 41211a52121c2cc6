"""Exact Jaccard join of word-shingle sets by a token-group matrix.

1. Documents with equal sets form a class, known by its set's digest.
2. Classes that share minimum hashes with a class of a smaller id are dealt into parts of bounded
   size, and that class, their pivot, into each of them. In a part, the first class that is not
   linked yet takes all those it links with, the pivot before others; only such leaders go on,
   dealt anew, while a part's size keeps them apart. The components of these links are the groups. A
   group of any size is thus linked by about as many tests as it has members, also where many
   of them resemble a class of another group and fail the test against it.
3. The token-group matrix holds, for the tokens by which a link must show (a prefix in an order
   of rising frequency), the groups whose union of tokens has them. A group is cut into parts
   of bounded size. A class meets a part of another group only over such tokens, if their number
   and both sizes allow a link: what two prefixes do not share, the rest of one of the sets must.
   A token of many entries is dealt over several tasks.
4. For each such pair the overlap with the part's whole union bounds the overlap with any
   member. Only parts whose bound reaches the threshold are opened. A part's sets are read once
   for a run of classes that meet it, and one link between a class and a part is enough.

Step 2 only spares work: step 3 finds every link between two groups, whatever the groups are.

Cases: null or wordless texts have an empty set and link with nothing; a null id is left out
of linking and its component is null; ids of any type that has an order will do; rows of one id
and different texts are linked each by its own text, and their component is the smallest id in
it; repeated rows are copies; extra columns, whatever their names, are ignored or kept; an empty
table gives no rows.
"""

from __future__ import annotations

from itertools import count, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm.common import Scratch, column, fresh, map_rows, release, written
from hopframe.llm.components import components
from hopframe.llm.shingles import digests, mix, shingle_sets

#: Frequency classes of tokens, a fixed number that the driver can hold and broadcast.
BUCKET_BITS = 17
#: Minimum hashes by which classes are dealt, and how many of them two classes share at least.
HASHES, AGREE = 8, 2
#: Tokens, with repetitions, in a part of a group, and of the classes that meet it in one task.
PART_TOKENS, RUN_TOKENS = 50_000, 1_000_000
#: Entries of one token that are joined with the matrix in one task.
TOKEN_ENTRIES = 5_000
#: Ids that may be broadcast; for more, documents and ids are joined by a shuffle.
BROADCAST_IDS = 500_000

_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, HASHES, dtype=np.uint64)


def described(docs: DataFrame, k: int, id_col: str, text_col: str, seed: int = 0) -> DataFrame:
    """Per document its set's size, digests and minimum hashes; per task and token bucket a count."""

    def run(batches):
        loads = np.zeros(1 << BUCKET_BITS, np.int64)
        for ids, texts in batches:
            n, d1, d2, low, tokens = [], [], [], [], []
            for s in shingle_sets(texts, k):
                n.append(len(s))
                a, b = digests(s, seed)
                d1.append(a)
                d2.append(b)
                low.append(mix(s ^ _SEEDS[:, None]).min(axis=1).view(np.int64).tolist() if len(s) else [])
                tokens.append((s >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
            if tokens:
                loads += np.bincount(np.concatenate(tokens), minlength=1 << BUCKET_BITS)
            none = [None] * len(ids)
            yield ids, n, d1, d2, low, none, none
        used = np.flatnonzero(loads)
        for lo in range(0, len(used), 50_000):
            part = used[lo : lo + 50_000]
            none = [None] * len(part)
            yield none, none, none, none, none, part.tolist(), loads[part].tolist()

    kind = docs.schema[id_col].dataType
    out = [("id", kind), ("n", "int"), ("d1", "long"), ("d2", "long"), ("low", "array<long>"), ("bucket", "int"), ("load", "long")]
    return map_rows(docs, [(id_col, kind.simpleString()), (text_col, "binary")], out, run)


def bucket_ranks(counts: DataFrame) -> np.ndarray:
    """The rank of each token bucket by rising number of tokens."""
    loads = np.zeros(1 << BUCKET_BITS, np.int64)
    for bucket, load in counts.groupBy("bucket").agg(F.sum("load")).collect():
        loads[bucket] = load
    ranks = np.empty(1 << BUCKET_BITS, np.uint64)
    ranks[np.argsort(loads, kind="stable")] = np.arange(1 << BUCKET_BITS, dtype=np.uint64)
    return ranks


def prefixes(docs: DataFrame, ranks, k: int, percent: int, id_col: str, text_col: str, seed: int = 0) -> DataFrame:
    """(token, d1): the tokens of which two linked sets share one, once a class and task.

    Tokens are put in order by their bucket's rank, then by themselves. A token's 64 bits are
    replaced one to one by that order. A set of n has n - ceil(n * percent / 100) + 1 of them.
    """

    def run(batches):
        rank, seen = ranks.value, set()
        shift, rest = np.uint64(64 - BUCKET_BITS), np.uint64((1 << (64 - BUCKET_BITS)) - 1)
        for no_id, texts in batches:
            token, owner = [], []
            for without, s in zip(no_id, shingle_sets(texts, k), strict=True):
                n = len(s)
                if not n or without:
                    continue
                d = digests(s, seed)[0]
                if d in seen:
                    continue
                seen.add(d)
                key = (rank[(s >> shift).astype(np.int64)] << shift) | (s & rest)
                p = n - -(-percent * n // 100) + 1
                top = np.partition(key, p - 1)[:p] if p < n else key
                token.append(top.view(np.int64))
                owner.append(np.full(len(top), d))
            if token:
                yield tuple(pa.array(np.concatenate(x)) for x in (token, owner))

    asked = docs.select(column(id_col).isNull().alias("_no_id"), column(text_col).alias("_text"))
    return map_rows(asked, [("_no_id", "boolean"), ("_text", "binary")], [("token", "long"), ("d1", "long")], run)


def sets_of(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str, seed: int) -> DataFrame:
    """The rows of ``wanted``, a written table (id, d1, ...), each with its set's tokens as sorted 64-bit hashes.

    A row that repeats another gives the same set again, unless one task sees both.
    """
    few = wanted.count() <= BROADCAST_IDS
    hint = F.broadcast if few else lambda df: df
    picked = docs.select(column(id_col).alias("id"), column(text_col).alias("_text")).join(hint(wanted.select("id").distinct()), "id", "left_semi")

    def run(batches):
        seen = set()
        for got, texts in batches:
            rows = []
            for i, s in zip(got, shingle_sets(texts, k), strict=True):
                d = digests(s, seed)[0]
                if (i, d) not in seen:
                    seen.add((i, d))
                    rows.append((i, d, s.tobytes()))
            if rows:
                yield tuple(zip(*rows, strict=True))

    kind = picked.schema["id"].dataType
    found = map_rows(picked, [("id", kind.simpleString()), ("_text", "binary")], [("id", kind), ("d1", "long"), ("tokens", "binary")], run)
    return found.join(hint(wanted), ["id", "d1"])


class Part:
    """The sets of a part with the union of their tokens, and for each token the sets that have it."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sizes, self.percent = np.array([len(s) for s in sets], np.int64), percent
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.union, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]

    def links(self, s: np.ndarray) -> np.ndarray | None:
        """Which sets link with ``s``; None where the overlap with the union is too small for any."""
        at = np.searchsorted(self.union, s)
        at = at[self.union[np.minimum(at, len(self.union) - 1)] == s]
        if 100 * len(at) < self.percent * len(s):
            return None
        n = self.first[at + 1] - self.first[at]
        places = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.owner[places], minlength=len(self.sizes))
        return 100 * both >= self.percent * (len(s) + self.sizes - both)


def _tokens(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _runs(batches, keys: int):
    """(key, rows) of neighbouring rows that agree in the first ``keys`` columns."""
    rows = (r for cols in batches for r in zip(*cols, strict=True))
    return groupby(rows, key=lambda r: r[:keys])


def led(dealt: DataFrame, percent: int) -> DataFrame:
    """(d1, leader, n, grp, parts) of rows (grp, no, d1, id, n, parts, tokens): a class's leader in its part is the
    first class there, the pivot before others by id, that it links with and that has no leader but itself."""

    def run(batches):
        for _, rows in _runs(batches, 2):
            rows = list({r[2]: r for r in rows}.values())
            sets = [_tokens(r[5]) for r in rows]
            part, leader = Part(sets, percent), np.full(len(rows), -1)
            for i, s in enumerate(sets):
                if leader[i] < 0:
                    mine = (leader < 0) & part.links(s)
                    leader[mine] = i
            yield tuple(zip(*((r[2], rows[j][2], r[3], r[0], r[4]) for r, j in zip(rows, leader.tolist(), strict=True)), strict=True))

    columns = [("grp", "long"), ("no", "long"), ("d1", "long"), ("n", "int"), ("parts", "long"), ("tokens", "binary")]
    ordered = dealt.repartition("grp", "no").sortWithinPartitions("grp", "no", F.expr("d1 <> grp"), "id", "d1")
    return map_rows(ordered, columns, [("d1", "long"), ("leader", "long"), ("n", "int"), ("grp", "long"), ("parts", "long")], run)


def opened(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of rows (grp, no, run, meets, d1, tokens): members of a part (meets 0), then classes that meet it (1).

    A class is linked with at most one member, as members are linked with one another.
    """

    def run(batches):
        found = []
        for _, rows in _runs(batches, 3):
            members, part = {}, None
            for _, _, _, meets, d, raw in rows:
                if not meets:
                    members[d] = raw
                    continue
                if part is None:
                    names, part = list(members), Part([_tokens(x) for x in members.values()], percent)
                linked = part.links(_tokens(raw))
                if linked is not None and linked.any():
                    found.append((d, names[int(linked.argmax())]))
            if len(found) > 1000:
                yield tuple(zip(*found, strict=True))
                found = []
        if found:
            yield tuple(zip(*found, strict=True))

    columns = [("grp", "long"), ("no", "long"), ("run", "long"), ("meets", "int"), ("d1", "long"), ("tokens", "binary")]
    ordered = rows.repartition("grp", "no", "run").sortWithinPartitions("grp", "no", "run", "meets", "d1")
    return map_rows(ordered, columns, [("a", "long"), ("b", "long")], run)


def _classes(docs: DataFrame, k: int, id_col: str, text_col: str, keep: Scratch) -> tuple[int, DataFrame, DataFrame]:
    """A seed under which digests d1 tell all sets apart, what :func:`described` says, and the classes (d1, n, id, low)."""
    for seed in count():
        first = keep(described(docs, k, id_col, text_col, seed))
        sets = first.where("bucket is null and id is not null and n > 0").groupBy("d1")
        classes = keep(sets.agg(F.min("d2").alias("d2"), F.max("d2").alias("other"), F.first("n").alias("n"), F.min("id").alias("id"), F.first("low").alias("low")))
        if not classes.where("d2 <> other").limit(1).count():
            return seed, first, classes.select("d1", "n", "id", "low")
        keep.drop(first)
        keep.drop(classes)


def _dealt(classes: DataFrame) -> DataFrame:
    """(d1, grp): each class with the class of the smallest id that shares most minimum hashes, its pivot, and pivots with themselves."""
    low = classes.select("d1", "id", F.posexplode("low").alias("pos", "value"))
    buckets = low.groupBy("pos", "value").agg(F.min_by("d1", "id").alias("grp"), F.count("*").alias("c")).where("c > 1").drop("c")
    pairs = low.drop("id").join(buckets, ["pos", "value"]).where("d1 <> grp").groupBy("d1", "grp").agg(F.count("*").alias("agree"))
    best = pairs.where(f"agree >= {AGREE}").groupBy("d1").agg(F.max(F.struct("agree", "grp")).alias("b")).select("d1", F.col("b.grp").alias("grp"))
    return best.unionByName(best.select(F.col("grp").alias("d1"), "grp").distinct())


def _parts(member: DataFrame, *salt) -> DataFrame:
    """``member`` (d1, n, grp, ...) with ``parts``, the number of its group's parts, and ``no``, its own."""
    sizes = member.groupBy("grp").agg(F.ceil(F.sum("n") / PART_TOKENS).alias("parts")).where("parts > 1")
    each = member.join(sizes, "grp", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    return each.withColumn("no", F.pmod(F.xxhash64("d1", *salt), "parts"))


def _grouped(docs: DataFrame, classes: DataFrame, k: int, percent: int, id_col: str, text_col: str, seed: int, keep: Scratch) -> DataFrame:
    """Links (a, b) between classes that share minimum hashes."""
    known = classes.select("d1", "n", "id")
    active, links = _dealt(classes).join(known, "d1"), None
    for turn in count():
        dealt = _parts(active, F.lit(turn))
        if not turn:  # a pivot takes part everywhere
            everywhere = F.when(F.col("d1") == F.col("grp"), F.expr("sequence(0L, parts - 1)")).otherwise(F.array("no"))
            dealt = dealt.withColumn("no", F.explode(everywhere))
        dealt = keep(dealt.select("id", "d1", "n", "grp", "no", "parts"))
        found = keep(led(sets_of(docs, dealt, k, id_col, text_col, seed), percent))
        linked = found.where("d1 <> leader").select(F.col("d1").alias("a"), F.col("leader").alias("b"))
        links = linked if links is None else links.unionByName(linked)
        split = found.where("parts > 1 and d1 <> grp")
        left, went = split.agg(F.expr("count_if(d1 = leader)"), F.expr("count_if(d1 <> leader)")).first()
        if 10 * went <= left or not left:  # what is still apart is left to the matrix
            return links
        active = split.where("d1 = leader").select("d1", "grp").join(known, "d1")


def _met(docs: DataFrame, loads: DataFrame, member: DataFrame, k: int, percent: int, id_col: str, text_col: str, seed: int) -> DataFrame:
    """(d1, n, grp, no), written: the classes and parts of other groups that meet over a token of their prefixes."""
    with Scratch() as keep:
        ranks = docs.sparkSession.sparkContext.broadcast(bucket_ranks(loads))
        post = keep(prefixes(docs, ranks, k, percent, id_col, text_col, seed))
        tokens = post.groupBy("token").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.ceil(F.count("*") / TOKEN_ENTRIES).cast("int").alias("salts"))
        shared = keep(tokens.where("lo < hi").select("token", "salts"))
        release(docs.sparkSession)
        entry = keep(post.join(shared, "token").join(member, "d1").select("token", "salts", "d1", "n", "grp", "no").distinct())
        keep.drop(post)
        keep.drop(shared)
        release(docs.sparkSession)
        matrix = entry.groupBy("token", "grp", "no").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("salts").alias("salts"))
        matrix = matrix.select("token", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.col("grp").alias("p_grp"), F.col("no").alias("p_no"), "least", "most")
        asked = entry.select("token", F.pmod(F.xxhash64("d1"), "salts").cast("int").alias("salt"), "d1", "n", "grp")
        met = asked.join(matrix, ["token", "salt"]).where(f"grp > p_grp and 100 * most >= {percent} * n and {percent} * least <= 100 * n")
        met = met.groupBy("d1", "n", F.col("p_grp").alias("grp"), F.col("p_no").alias("no")).agg(F.count("*").alias("c"), F.min("least").alias("least"), F.max("most").alias("most"))
        rest = f"c + greatest({percent} * n + 99, {percent} * most + 99) div 100 - 1"
        return written(met.where(f"(100 + {percent}) * ({rest}) >= {percent} * (cast(n as bigint) + least)").select("d1", "n", "grp", "no"))


def _between(docs: DataFrame, classes: DataFrame, member: DataFrame, met: DataFrame, k: int, percent: int, id_col: str, text_col: str, seed: int, keep: Scratch) -> DataFrame:
    """Links (a, b), written, between classes and the parts of other groups that they meet."""
    runs = keep(met.groupBy("grp", "no").agg(F.ceil(F.sum("n") / RUN_TOKENS).alias("runs")))
    inside = member.join(runs, ["grp", "no"]).select("grp", "no", F.explode(F.expr("sequence(0L, runs - 1)")).alias("run"), F.lit(0).alias("meets"), "d1")
    asking = met.join(runs, ["grp", "no"]).select("grp", "no", F.pmod(F.xxhash64("d1"), "runs").alias("run"), F.lit(1).alias("meets"), "d1")
    rows = keep(inside.unionByName(asking).join(classes.select("d1", "id"), "d1"))
    return keep(opened(sets_of(docs, rows, k, id_col, text_col, seed), percent))


def join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, class_id (smallest id with an equal set), component_id."""
    spark, where = docs.sparkSession, (k, percent, id_col, text_col)
    with Scratch() as keep:
        seed, first, classes = _classes(docs, k, id_col, text_col, keep)
        links = _grouped(docs, classes, *where, seed, keep)
        groups = keep.adopt(components(links, "a", "b"))
        release(spark)
        member = classes.join(groups.withColumnRenamed("node", "d1"), "d1", "left").select("d1", "n", F.coalesce("component", "d1").alias("grp"))
        member = keep(_parts(member).select("d1", "n", "grp", "no"))
        met = keep.adopt(_met(docs, first.where("bucket is not null"), member, *where, seed))
        release(spark)
        more = _between(docs, classes, member, met, *where, seed, keep)
        if more.limit(1).count():
            groups = keep.adopt(components(links.unionByName(more), "a", "b"))
        known = classes.select("d1", F.col("id").alias("class_id"))
        found = groups.select(F.col("node").alias("d1"), "component").join(known, "d1")
        least = found.groupBy("component").agg(F.min("class_id").alias("component_id"))
        named = known.join(found.select("d1", "component").join(least, "component").drop("component"), "d1", "left")
        each = first.where("bucket is null").select("id", "n", "d1")
        alone = each.where("id is null or n = 0").select("id", "n", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
        linked = each.where("id is not null and n > 0").join(named, "d1").select("id", "n", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
        rows = linked.unionByName(alone)
        return written(rows.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "class_id", "component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document, the smallest id, of each group of linked documents.

    Rows are linked by their texts alone: rows that have one id and different texts are different
    documents. Of rows with that id and equal sets one stays. Rows without words or without an id all stay.
    """
    key, gone_key = fresh(docs.columns, "_key"), fresh(docs.columns, "_gone")
    if not docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():
        gone = join(docs, k, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(gone_key))
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone  # else every text would be shuffled
        return docs.join(gone, F.col("doc_id") == F.col(gone_key), "left_anti")
    # ids stand on several rows: a row is told by its id and text
    names = [column(n) for n in docs.columns]
    keyed = docs.select(*names, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).alias(key))
    marked = join(keyed, k, percent, id_col=key).select(F.col("doc_id").alias("k"), "n_shingles", F.col("component_id").alias("g"))
    groups = marked.where("g <> k").select("g").distinct()
    members = keyed.select(F.col(key).alias("k"), F.col("doc_id").alias("id")).join(marked.join(groups, "g", "left_semi").select("k", "g").distinct(), "k").distinct()
    with Scratch() as keep:
        members = keep(members.select("g", "id", "k"))
        first = members.groupBy("g").agg(F.min(F.struct("id", "k")).alias("first"))
        gone = written(members.join(first, "g").where("k <> first.k").select(F.col("k").alias(gone_key)))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = keyed.join(gone, F.col(key) == F.col(gone_key), "left_anti")
    twice = marked.where("n_shingles > 0 and k is not null").groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select(F.col("k").alias(gone_key))
    if not twice.limit(1).count():
        return kept.select(*names)
    again = kept.join(twice, F.col(key) == F.col(gone_key), "left_semi")
    once = kept.join(twice, F.col(key) == F.col(gone_key), "left_anti")
    return once.unionByName(again.dropDuplicates([key])).select(*names)
