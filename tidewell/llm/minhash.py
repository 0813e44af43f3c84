"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Each set of word shingles is thrown into the bins of its sketch in rounds: in the first T rounds an element's
bin is hashed anew, in the next T rounds round T+j fills bin j, and a bin keeps the least value of the earliest
round that reached it. So every coordinate fills, however small the set. Sets equal in full are one node. Nodes
that share a band are candidates; each is first held against a leader of its bucket, then, where a bucket still
spans several components, for a few turns against a random member of the largest, and at last against all
members of the others that an exact prefix filter leaves. Links are confirmed on full sets.

Defined results: a null or wordless text has no shingles and no links; a text of fewer words than the width is
one shingle; repeated rows fall together; rows of one doc_id with different texts are nodes of their own; rows
without doc_id take part, and their component_id is null only if no linked row has an id. An empty table gives
an empty result. Only doc_id and text are read, so other columns can't clash.

At similarity 0.8 and the defaults a pair shares no band with a probability of 5e-8, and its sketch bits differ in
more than BITS_APART places, beyond which it isn't verified, with one of 3e-8 (5.4 standard deviations).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import chunks, discard, documents, mix, released, shingles, sized, stored

COORDINATES, BANDS = 128, 32
#: Of 256 sketch bits, how many may differ: 5 standard deviations above what a similarity of 0.8 gives.
BITS_APART = 57
#: Turns in which open buckets are tried against random members before all remaining pairs are.
TURNS = 2
#: A key or node is hot if it has more than this part of all; hot sets go to so many tasks.
HOT, SALTS = 1000, 64
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(s: np.ndarray, offsets: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """One row of t values for each set; all EMPTY for an empty one."""
    n = len(offsets) - 1
    out = np.full((n, t), EMPTY)
    size = np.diff(offsets)
    live = np.flatnonzero(size)
    h, owner = s, np.repeat(np.arange(n), size)
    for i in range(2 * t):
        if not len(live):
            break
        seed = np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF)
        value = mix(h ^ seed)
        bins = (value & np.uint64(t - 1)).astype(np.int64) if i < t else np.full(len(h), i - t)
        row = np.searchsorted(live, owner)
        made = np.full(len(live) * t, EMPTY)
        np.minimum.at(made, row * t + bins, value >> np.uint64(7))
        now = out[live]
        now = np.where(now == EMPTY, made.reshape(-1, t), now)
        out[live] = now
        open_ = (now == EMPTY).any(axis=1)
        keep = open_[row]
        h, owner, live = h[keep], owner[keep], live[open_]
    return out


def rows_of_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, offsets, set sizes and the set's fingerprint (0 for an empty one)."""
    s, offsets = shingles(column, width)
    size = np.diff(offsets)
    run = np.concatenate([[np.uint64(0)], np.cumsum(mix(s), dtype=np.uint64)])
    fp = mix(run[offsets[1:]] - run[offsets[:-1]] + size.astype(np.uint64))
    return s, offsets, size, np.where(size > 0, fp, np.uint64(0)).view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, fp, bands (one key for each band) and q (four words of sketch bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            s, offsets, size, fp = rows_of_sets(b.column("text"), width)
            sk = sketches(s, offsets)
            parts = sk.reshape(len(sk), BANDS, COORDINATES // BANDS)
            key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sk), 1))
            for k in range(parts.shape[2]):
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
            bits = np.stack([(sk >> np.uint64(9)) & np.uint64(1), (sk >> np.uint64(10)) & np.uint64(1)], 1).astype(np.uint8)
            q = np.packbits(bits.reshape(len(sk), 2 * COORDINATES), axis=1).view(np.int64)
            lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(fp), lists(key.view(np.int64)), lists(q)], ["doc_id", "n", "fp", "bands", "q"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n long, fp long, bands array<long>, q array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """fp and the whole shingle set of each node; nodes has fp and rep, the id of a document that has it."""
    picked = docs.select("doc_id", "text").join(nodes, F.col("doc_id").eqNullSafe(F.col("rep"))).select("fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            s, offsets, _, fp = rows_of_sets(b.column("text"), width)
            same = pa.array(fp == b.column("fp").to_numpy(zero_copy_only=False))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(s.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(fp), lists], ["fp", "shingles"]).filter(same)

    return picked.mapInArrow(released(run), "fp long, shingles array<long>")


def by_key(rows: DataFrame, few: DataFrame, number: int, key: str = "key") -> DataFrame:
    """rows joined by key with few, which has one row for each key and counts its `members` among rows.

    A node has one root and BANDS keys, so those of more than number / HOT members are BANDS * HOT at most: these are
    broadcast, and all others are small beside a partition.
    """
    hot = F.broadcast(few.where(F.col("members") * HOT > number))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(few.where(F.col("members") * HOT <= number), key))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    A node b of more than 1 / HOT of the pairs, of which there are HOT at most, has its set sent to SALTS tasks.
    """
    left = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("r"))
    hot = F.broadcast(pairs.groupBy("b").count().where(F.col("count") * HOT > pairs.count()).select("b", F.lit(True).alias("hot")))
    pairs = pairs.join(hot, "b", "left").select("a", "b", F.when(F.col("hot"), F.pmod(F.xxhash64("a"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
    right = right.join(hot, "b", "left").select("b", "r", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    both = F.size(F.array_intersect("s", "r"))
    return pairs.join(left, "a").join(right, ["b", "salt"]).where(both * 100 >= (F.size("s") + F.size("r") - both) * percent).select("a", "b").distinct()


def components(edges: DataFrame, paths: list[str]) -> DataFrame:
    """node and root, the least node that it reaches, by alternating large and small stars; edges: a, b."""
    e = stored(edges.select("a", "b").where("a <> b"), "star", paths)
    while not settled(e):
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        e = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        e = stored(e, "star", paths)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def settled(edges: DataFrame) -> bool:
    """Whether every node a has one b, less than itself, which is no other edge's a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), (F.col("b") > F.col("a")).cast("int").alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def alike(a: str, b: str) -> F.Column:
    """True if sketch bits and set sizes allow the similarity."""
    apart = sum((F.bit_count(F.col(f"{a}q")[k].bitwiseXOR(F.col(f"{b}q")[k])) for k in range(4)), F.lit(0))
    return (apart <= BITS_APART) & (F.least(f"{a}n", f"{b}n") * 5 >= F.greatest(f"{a}n", f"{b}n") * 4)


def sharing_prefix(open_: DataFrame, sets: DataFrame, percent: int, paths: list[str]) -> DataFrame:
    """Pairs of different components that can reach the similarity, by an exact prefix filter.

    In any one order of all shingles, two sets of n and m that are similar share one of the first
    n - ceil(percent n / 100) + 1 and m - ceil(percent m / 100) + 1. With the rarest first, a copy that was
    edited too much begins with shingles of its own. At the first shingle that two sets share, what is left of
    the shorter rest must also suffice for the overlap. open_: fp, root, n, q, probe.
    """
    each = sets.join(open_.select("fp"), "fp", "left_semi").select("fp", F.explode("shingles").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(shared, "s").groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("ranked"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("ranked"))
    head = F.slice("ranked", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))
    rows = stored(ranked.join(open_, "fp").select("fp", "root", "n", "q", "probe", (F.col("n") - F.size("ranked")).alias("own"), F.posexplode(head).alias("at", "t")).select("fp", "root", "n", "q", "probe", (F.col("n") - F.col("own") - F.col("at")).alias("rest"), F.col("t.s").alias("s")), "prefixes", paths)
    x = rows.where("probe").select("s", *(F.col(c).alias(f"x{c}") for c in ("fp", "root", "n", "q", "rest")))
    y = rows.select(F.col("s").alias("ys"), *(F.col(c).alias(f"y{c}") for c in ("fp", "root", "n", "q", "rest", "probe")))
    enough = F.least("xrest", "yrest") * (100 + percent) >= (F.col("xn") + F.col("yn")) * percent
    once = (F.col("xroot") != F.col("yroot")) & (~F.col("yprobe") | (F.col("xfp") < F.col("yfp")))
    return x.join(y, (F.col("s") == F.col("ys")) & once & enough & alike("x", "y"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. percent: 80 or more."""
    if percent < 80:
        raise ValueError("the banding is laid out for similarities of 0.8 or more")
    paths: list[str] = []
    keep = lambda df, name: stored(df, name, paths)
    sigs = stored(signatures(docs, width), "signatures")
    nodes = keep(sigs.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("q").alias("q")), "nodes")
    number = nodes.count()
    band = nodes.select("fp", F.explode("bands").alias("key"))
    order = F.struct(F.xxhash64("fp", F.pmod("key", F.lit(3))).alias("h"), F.col("fp").alias("leader"))
    leader = keep(band.groupBy("key").agg(F.count("*").alias("members"), F.min(order).alias("first")).where("members > 1").select("key", "members", "first.leader"), "leaders")
    full = keep(by_key(band, leader, number), "buckets")
    side = lambda p, c: nodes.select(F.col("fp").alias(c), F.col("n").alias(f"{p}n"), F.col("q").alias(f"{p}q"))
    star = full.where("fp <> leader").select(F.col("fp").alias("a"), F.col("leader").alias("b")).distinct()
    star = keep(star.join(side("x", "a"), "a").join(side("y", "b"), "b").where(alike("x", "y")).select("a", "b"), "pairs")
    # Only buckets of three or more can hold a pair that the leader hasn't settled.
    ids = full.select("fp").distinct()
    wanted = nodes.join(ids, "fp", "left_semi").select("fp", "rep")
    sets = keep(full_sets(docs, sized(wanted, 32), width), "sets")
    links = keep(confirmed(star, sets, percent), "links")
    roots, seen = components(links, paths), star.union(star.select("b", "a"))
    large = full.where("members > 2").select("key", "fp")
    for turn in range(TURNS + 1):
        label = keep(large.join(roots, large.fp == roots.node, "left").select("key", "fp", F.coalesce("root", "fp").alias("root")), "labels")
        most = label.groupBy("key", "root").count().groupBy("key").agg(F.sum("count").alias("members"), F.count("*").alias("roots"), F.max(F.struct("count", "root"))["root"].alias("most"))
        most = keep(most.where("roots > 1").drop("roots"), "most")
        if most.isEmpty():
            break
        open_ = keep(by_key(label, most, number).join(nodes.select("fp", "n", "q"), "fp"), "open")
        if turn < TURNS:  # against one random member of the bucket's largest component
            one = open_.where("root = most").groupBy("key").agg(F.max("members").alias("members"), F.min(F.struct(F.xxhash64("fp", "key", F.lit(turn)).alias("h"), *(F.col(c).alias(f"y{c}") for c in ("fp", "root", "n", "q")))).alias("one"))
            probe = open_.where("root <> most").select("key", *(F.col(c).alias(f"x{c}") for c in ("fp", "root", "n", "q")))
            asked = by_key(probe, one.select("key", "members", "one.*"), number).where(alike("x", "y"))
        else:
            asked = sharing_prefix(open_.groupBy("fp").agg(F.any_value("root").alias("root"), F.any_value("n").alias("n"), F.any_value("q").alias("q"), F.max(F.col("root") != F.col("most")).alias("probe")), sets, percent, paths)
        asked = asked.select(F.col("xfp").alias("a"), F.col("yfp").alias("b"), F.col("xroot").alias("ra"), F.col("yroot").alias("rb"))
        asked = keep(asked.distinct().join(seen, ["a", "b"], "left_anti"), "asked")
        if asked.isEmpty():
            continue
        found = keep(asked.join(confirmed(asked.select("a", "b"), sets, percent), ["a", "b"]), "found")
        merged = components(found.select(F.col("ra").alias("a"), F.col("rb").alias("b")), paths)
        seen = seen.union(asked.select("a", "b")).union(asked.select("b", "a"))
        moved = sized(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), 16)
        roots = keep(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")).union(merged), "roots")
    named = keep(nodes.select("fp", "rep").join(roots, nodes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted")
    least = keep(named.groupBy("root").agg(F.count("*").alias("members"), F.min("rep").alias("component_id")), "least")
    named = stored(by_key(named, least, number, "root").select("fp", "component_id"), "named")
    discard(docs.sparkSession, paths)
    out = sigs.select("doc_id", "n", "fp").join(named, "fp", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of docs, that of the least doc_id; a row without doc_id only if the group has no other."""
    at = "_row"
    while at in {c.lower() for c in docs.columns}:
        at += "_"
    keyed = stored(docs.withColumn(at, F.monotonically_increasing_id()), "keyed")
    groups = near_duplicates(keyed.select(F.col(at).alias("doc_id"), "text"), width, percent).select(F.col("doc_id").alias(at), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", at))[at]
    kept = groups.join(keyed.select(at, "doc_id"), at).groupBy("component_id").agg(first.alias(at)).select(at)
    return keyed.join(sized(kept, 16), at, "left_semi").select(*docs.columns)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"), width=2)


#: All pairs that share a shingle and could reach the threshold, counted in full, and what each document reaches.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id AND r.root < e.b)
SELECT s.doc_id, CAST(any_value(len(s.sh)) AS BIGINT) AS n_shingles, min(r.root) AS component_id, s.doc_id = min(r.root) AS kept FROM s JOIN r USING (doc_id) GROUP BY s.doc_id
"""
