"""N-gram Jaccard join by grouped prefixes.

A document is the set of its word n-grams. All n-grams are put in one global order, rare before
frequent, where the frequencies come from a count sketch over the whole corpus (the order changes
only the speed, never the result). Two sets can reach the threshold only if their prefixes in that
order share an n-gram. Sets with identical prefix and size are collapsed into one group, and groups
that are likely near copies into one unit, whose n-grams are those of all its groups: else a class of
near copies would meet as often as its square, for each n-gram of a prefix. Units that share a prefix
n-gram are joined under size and position filters, which hold for any of their groups; for surviving
pairs of units each pair of members is verified on its complete sets, by products of matrices where
there are many. Which groups make a unit changes only the speed.
Pairs of sets are never rows: a task gives the links that it counted and pairs that span the same classes.

Rows enter as (doc_id, 128-bit fingerprint of the set), so equal sets are verified once, and the
result has a row for each document, so that it grows with the input and not with its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesets import GRAM_CODES, WORD_BYTE, chunks, gram_hashes, mix, span_hashes, spans
from .common import cut, discard, flat, modest_batches, pick, small

N, THRESHOLD = 3, 0.6
#: Cells of the sketch, a power of two; n-grams of the sets that one verifying task takes, about; and
#: prefix n-grams that one joining task takes, about. A pair is counted once in each
#: task that has some of its n-grams, so these are not smaller than need be.
CELLS, TASK_GRAMS, TASK_ENTRIES = 1 << 20, 2_000_000, 1_500_000
#: Least n-grams of a prefix, by hash, that tell near copies; groups that make a unit, at least; and n-grams of a unit, about, at most.
LEAST, DENSE, UNIT_GRAMS = 4, 8, 500_000
#: Pairs of units that one verifying task takes, about; sets a side and n-grams that are multiplied at once.
TASK_PAIRS, SIDE, WIDE = 1_000_000, 1024, 1024
#: Rank from which on an n-gram of a prefix is hot: its cell has 32,768 occurrences or more.
HOT_RANK = 8 * 15


def gram_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the rows' sorted sets of n-gram hashes), a few megabytes of text at a time."""
    for lo, hi, raw, at in chunks(texts):
        starts, ends, first = spans(raw, at, WORD_BYTE)
        grams, begin = gram_hashes(span_hashes(raw, starts, ends), first, n)
        yield lo, [np.unique(grams[begin[i] : begin[i + 1]]) for i in range(hi - lo)]


def fingerprints(grams: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two signed integers; the sets lie one after another and none is empty."""
    return tuple(np.add.reduceat(mix(grams ^ GRAM_CODES[k]), begin[:-1]).view(np.int64) for k in (14, 15))


def needed(size: float, share: float) -> int:
    return int(np.ceil(share * size - 1e-9))


def sketch(texts: DataFrame, n: int) -> np.ndarray:
    """How often an n-gram of each cell occurs, over the whole table."""
    pieces = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for lo, hi, raw, at in chunks(batch.column(0)):
                starts, ends, first = spans(raw, at, WORD_BYTE)
                grams, _ = gram_hashes(span_hashes(raw, starts, ends), first, n)
                total += np.bincount((grams & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        if total.any():
            width = np.uint16 if total.max() < 1 << 16 else np.int64
            parts = total.astype(width).reshape(pieces, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["piece", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // pieces, np.int64)
        for x in table.column("counts"):
            raw = x.as_buffer()
            total += np.frombuffer(raw, np.uint16 if raw.size == 2 * len(total) else np.int64)
        return pa.table({"piece": table.column("piece")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "piece int, counts binary"
    rows = texts.mapInArrow(count, schema).groupBy("piece").applyInArrow(add, schema).collect()
    out = np.zeros((pieces, CELLS // pieces), np.int64)
    for r in rows:
        out[r["piece"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def ranks(counts: np.ndarray) -> np.ndarray:
    """The high byte of a cell's n-grams in the global order: an eighth of a power of two a step."""
    return np.floor(8 * np.log2(np.maximum(counts, 1))).astype(np.uint64) << np.uint64(56)


def prepared(docs: DataFrame) -> DataFrame:
    """(doc_id, t: hash of the text, key: of both, text in lower case, a null one as empty) of all rows."""
    modest_batches(docs.sparkSession)
    texts = pick(docs, "doc_id", "text").withColumn("t", F.xxhash64("text"))
    return texts.select("doc_id", "t", F.xxhash64("doc_id", "t").alias("key"), F.coalesce(F.lower("text"), F.lit("")).alias("text"))


def prefixes(texts: DataFrame, order, n: int, threshold: float) -> DataFrame:
    """(doc_id, t, key, h1, h2, size, p1, p2, top, prefix, least) of each row.

    h1, h2 and p1, p2 are the fingerprints of the set and of its prefix in the global order, top is the
    prefix's greatest rank. All are 0 for a text without words. least: the LEAST n-grams of the prefix by hash.
    """
    none, bits = np.empty(0, np.uint64), np.uint64((1 << 56) - 1)

    def as_lists(values: list[np.ndarray]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(v) for v in values]))), pa.int32()), pa.array(np.concatenate(values).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        for batch in batches:
            for lo, sets in gram_sets(batch.column(3), n):
                sizes = np.array([len(s) for s in sets])
                some = np.flatnonzero(sizes)
                marks = np.zeros((6, len(sets)), np.int64)
                found, least = [none] * len(sets), [none] * len(sets)
                marks[2] = sizes
                if len(some):
                    every = np.concatenate(sets)
                    tokens = rank[(every & np.uint64(CELLS - 1)).astype(np.int64)] | (every >> np.uint64(8))
                    begin = np.concatenate(([0], np.cumsum(sizes)))
                    for i in some:
                        token = tokens[begin[i] : begin[i + 1]]
                        token.sort()
                        found[i] = token[: sizes[i] - needed(sizes[i], threshold) + 1]
                        marks[5, i] = int(found[i][-1]) >> 56
                        if len(found[i]) >= LEAST:
                            least[i] = np.partition(found[i] & bits, LEAST - 1)[:LEAST]
                    kept = np.concatenate(([0], np.cumsum([len(found[i]) for i in some])))
                    marks[0, some], marks[1, some] = fingerprints(every, np.append(begin[some], len(every)))
                    marks[3, some], marks[4, some] = fingerprints(np.concatenate(found), kept)
                own = batch.slice(lo, len(sets))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), *(pa.array(c, pa.int64()) for c in marks), as_lists(found), as_lists(least)], names)

    names = ["doc_id", "t", "key", "h1", "h2", "size", "p1", "p2", "top", "prefix", "least"]
    fields = [T.StructField(k, T.LongType()) for k in names[1:-2]] + [T.StructField(k, T.ArrayType(T.LongType())) for k in names[-2:]]
    schema = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), *fields])
    return texts.select("doc_id", "t", "key", "text").mapInArrow(run, schema)


def candidates(every: DataFrame, threshold: float, tasks: int, hot: bool) -> DataFrame:
    """Pairs (a, b) of units that can have sets that reach the threshold, by what their prefixes share.

    every: (uid, lo, hi, pos, token), the sizes of the unit's sets from lo to hi, its n-grams and their
    first place in a prefix. What is asked of a pair is the least that any two of its sets need.

    Common n-grams come in the same order in both sets. So those beyond the prefixes are at most
    as many as the larger of the two rests, and the ones in the prefixes must make up for what is
    missing then. Before that, a pair needs a common n-gram so early in both that enough can follow
    it, and sizes that are close enough. With sets s <= l, what the prefixes share is at least
    share * (s + l) - threshold * l, which is least for the least s and the greatest l. Both sides of the join are the same exchange.

    hot: some n-grams of prefixes occur so often that one task shouldn't have all their units.
    Their units are cut into k parts each way, and each pair of parts meets in a task of its own.
    """
    share = threshold / (1 + threshold)

    def joined(entries: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
        a = entries.select(*on, *[F.col(c).alias(f"a_{c}") for c in ("uid", "lo", "hi", "pos")])
        b = other.select(*on, *[F.col(c).alias(f"b_{c}") for c in ("uid", "lo", "hi", "pos")])
        first = (F.col("a_lo") < F.col("b_lo")) | ((F.col("a_lo") == F.col("b_lo")) & (F.col("a_uid") < F.col("b_uid")))
        # The second half always holds; it asks the same of both sides, else they wouldn't be one exchange.
        large = (F.col("a_hi") >= F.ceil(F.lit(threshold) * F.col("b_lo") - 1e-9)) & (F.col("b_hi") >= F.ceil(F.lit(threshold) * F.col("a_lo") - 1e-9))
        same = [a[c] == b[c] for c in on]
        return a.join(b, reduce(Column.__and__, same) & first & large).select(*[f"{x}_{c}" for x in "ab" for c in ("uid", "lo", "hi", "pos")])

    rank = F.shiftrightunsigned("token", 56).cast("int")
    entries = (every.where(rank < HOT_RANK) if hot else every).repartition(tasks, "token")
    met = joined(entries, entries, ["token"])
    if hot:
        common = every.where(rank >= HOT_RANK)
        k = F.pow(F.lit(2), F.floor((rank - HOT_RANK) / 8) + 1).cast("int")
        own, all_ = F.pmod(F.xxhash64("uid"), k).cast("int"), F.sequence(F.lit(0), k - 1)
        left = common.withColumn("i", own).withColumn("j", F.explode(all_)).repartition(tasks, "token", "i", "j")
        right = common.withColumn("j", own).withColumn("i", F.explode(all_)).repartition(tasks, "token", "i", "j")
        met = met.unionAll(joined(left, right, ["token", "i", "j"]))
    enough = F.ceil(F.lit(share) * (F.col("a_lo") + F.col("b_lo")) - 1e-9)
    room = F.least(F.col("a_hi") - F.col("a_pos"), F.col("b_hi") - F.col("b_pos"))
    rest = F.greatest(*[F.ceil(F.lit(threshold) * F.col(f"{x}_lo") - 1e-9) - 1 for x in "ab"])
    single = (F.col("a_lo") == F.col("a_hi")) & (F.col("b_lo") == F.col("b_hi"))
    bound = F.floor(F.least(*[F.lit(share) * (F.col(s) + F.col(l)) - F.lit(threshold) * F.col(l) for s, l in (("a_lo", "b_hi"), ("b_lo", "a_hi"))]) - 1e-9)
    # One number for each pair and task: how many are common, less how many must be, as its sizes say.
    met = met.select(F.col("a_uid").alias("a"), F.col("b_uid").alias("b"), F.when(single, enough - rest).otherwise(bound).cast("int").alias("need"), (room >= enough).alias("early"))
    counted = met.groupBy("a", "b").agg(F.count("*").cast("int").alias("common"), F.max("need").alias("need"), F.max("early").alias("early"))
    return counted.where("early AND common >= need").select("a", "b")


def units(groups: DataFrame) -> DataFrame:
    """(gid, uid, lo, hi) of those of groups(gid, size, least) that make units with others, lo and hi being the unit's least and greatest size.

    A near copy has most of the least n-grams of its model, which few other texts of that size have. Each
    group takes the commonest of its own, if another of them is common as well.
    """
    band = F.floor(4 * F.log2("size")).alias("band")
    each = groups.where(F.size("least") == LEAST).select("gid", "size", band, F.explode("least").alias("gram"))
    common = each.groupBy("gram", "band").agg(F.count("*").alias("c")).where(F.col("c") >= DENSE)
    chosen = each.join(common, ["gram", "band"]).groupBy("gid", "size", "band").agg(F.count("*").alias("k"), F.max(F.struct("c", "gram")).alias("most"))
    chosen = cut(chosen.where("k > 1").select("gid", "size", "band", F.col("most.gram").alias("gram")))
    parts = chosen.groupBy("gram", "band").agg(F.count("*").alias("m"), F.ceil(F.sum("size") / UNIT_GRAMS).alias("parts")).where(F.col("m") >= DENSE)
    placed = chosen.join(parts, ["gram", "band"]).withColumn("part", F.pmod(F.xxhash64("gid"), "parts"))
    named = placed.groupBy("gram", "band", "part").agg(F.min("gid").alias("uid"), F.min("size").alias("lo"), F.max("size").alias("hi"))
    out = cut(placed.join(named, ["gram", "band", "part"]).select("gid", "uid", "lo", "hi"))
    discard(chosen)
    return out


def candidate_sets(docs: DataFrame, texts: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows (doc_id, t, h1, h2, size), sets (sid, uid, h1, h2, size, n: rows, best: least (z, d, t), key of a row), pairs of units to verify (a, b), a unit with itself if it has several sets)."""
    order = docs.sparkSession.sparkContext.broadcast(ranks(sketch(texts.select("text"), n)))
    found = cut(prefixes(texts, order, n, threshold))
    rows = cut(found.drop("prefix"))
    worded = rows.where("size > 0")
    # One row stands for each group. Groups and sets get small numbers, so that pairs of them are small as well.
    named = cut(cut(worded.groupBy("p1", "p2", "size").agg(F.min("key").alias("key"))).withColumn("gid", F.monotonically_increasing_id()))
    light = cut(rows.join(named, ["key", "p1", "p2", "size"]).select("gid", "size", "least"))
    dense = units(light)
    own = named.join(dense, "gid", "left").withColumn("alone", F.col("uid").isNull())
    own = cut(own.select("key", "p1", "p2", "size", "alone", F.coalesce("uid", "gid").alias("uid"), *[F.coalesce(c, "size").cast("int").alias(c) for c in ("lo", "hi")]))
    discard(named, light, dense)
    groups = cut(found.join(own, ["key", "p1", "p2", "size"]).select("uid", "lo", "hi", "alone", "prefix"))
    discard(found)
    entries = groups.select("uid", "lo", "hi", "alone", F.posexplode("prefix").alias("pos", "token"))
    merged = cut(entries.where("NOT alone").groupBy("uid", "lo", "hi", "token").agg(F.min("pos").alias("pos")))
    entries = entries.where("alone").drop("alone").unionByName(merged)
    known = worded.agg(F.sum(F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1).alias("n"), F.max("top").alias("top")).first()
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, int(known["n"] or 0) // TASK_ENTRIES)
    pairs = cut(candidates(entries, threshold, tasks, (known["top"] or 0) >= HOT_RANK))
    discard(groups, merged)
    best = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("t").alias("t"))
    sets = worded.groupBy("p1", "p2", "size", "h1", "h2").agg(F.count("*").alias("n"), F.min(best).alias("best"), F.min("key").alias("key"))
    sets = cut(sets.join(own.select("p1", "p2", "size", "uid"), ["p1", "p2", "size"]).drop("p1", "p2"))
    sets = cut(sets.withColumn("sid", F.monotonically_increasing_id()))
    discard(own)
    inner = sets.groupBy("uid").count().where("count > 1").select(F.col("uid").alias("a"), F.col("uid").alias("b"))
    todo = cut(pairs.unionAll(inner))
    discard(pairs)
    return rows, sets, todo


def verified(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows and sets as of candidate_sets, what compared() found of different sets: (x, null, far) and (x, y, null))."""
    texts = prepared(docs)
    rows, sets, todo = candidate_sets(docs, texts, n, threshold)
    # Each pair goes to the bucket of the least unit among its neighbours, so that dense ones meet in one place.
    ends = todo.select("a", "b").unionAll(todo.select("b", "a"))
    labels = ends.groupBy("a").agg(F.min("b").alias("b")).select("a", F.xxhash64(F.least("a", "b")).alias("label"))
    weights = cut(sets.groupBy("uid").agg(F.sum("size").alias("w")))
    joined = todo.join(labels, "a").join(weights.select(F.col("uid").alias("a"), F.col("w").alias("aw")), "a").join(weights.select(F.col("uid").alias("b"), F.col("w").alias("bw")), "b")
    placed = cut(joined)
    total = placed.agg(F.sum(F.col("aw") + F.col("bw")).alias("s")).first()["s"] or 0
    discard(todo, weights)
    todo = placed
    buckets = max(1, int(total) // TASK_GRAMS)
    placed = todo.withColumn("bucket", F.pmod("label", F.lit(buckets))).drop("label")
    sides = placed.select("bucket", "a", F.col("aw").alias("w")).unionAll(placed.select("bucket", "b", "bw")).distinct()
    by_size = sides.groupBy("bucket").agg(F.ceil(F.sum("w") / (4 * TASK_GRAMS)).alias("cuts"))
    by_pairs = placed.groupBy("bucket").agg(F.ceil(F.sqrt(F.count("*") / TASK_PAIRS)).alias("cuts"))
    cuts = by_size.unionAll(by_pairs).groupBy("bucket").agg(F.greatest(F.lit(1), F.max("cuts")).alias("cuts"))
    placed = placed.join(cuts, "bucket")
    block = lambda c: F.pmod(F.xxhash64(c), F.col("cuts"))
    placed = cut(placed.select("a", "b", F.struct("bucket", block("a").alias("i"), block("b").alias("j")).alias("cell")))
    discard(todo)
    where = placed.select("cell", F.col("a").alias("uid")).unionAll(placed.select("cell", "b")).distinct()
    where = cut(where.join(sets.select("sid", "uid", "n", "h1", "h2", "key"), "uid"))
    keys = cut(where.select(F.col("key").alias("asked")).distinct())
    asked = texts.join(small(keys), F.col("key") == F.col("asked"), "left_semi").select("text")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in gram_sets(batch.column(0), n):
                own = [s for s in sets if len(s)]
                if own:
                    marks = fingerprints(np.concatenate(own), np.concatenate(([0], np.cumsum([len(s) for s in own]))))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in marks), pa.array([s.tobytes() for s in own], pa.binary())], ["h1", "h2", "grams"])

    grams = asked.mapInArrow(again, "h1 long, h2 long, grams binary")
    # A set may come more than once, from rows that are copies; compare() takes any.
    located = where.select(F.col("cell").alias("spot"), "sid", "uid", "n", "h1", "h2").join(grams, ["h1", "h2"]).select("spot", "sid", "uid", "n", "grams")
    compare = lambda pairs, own: compared(pairs, own, threshold)
    result = cut(placed.groupBy("cell").cogroup(located.groupBy("spot")).applyInArrow(compare, "x long, y long, far long"))
    discard(placed, where, keys)
    return rows, sets, result


def compared(pairs: pa.Table, own: pa.Table, threshold: float) -> pa.Table:
    """(x, null, far: rows of other sets that reach the threshold with x) among pairs(a, b) of units, and
    (x, y, null) of pairs that reach it and connect all sets that are connected; own has (sid, uid, n, grams) of the sets.

    Less than two rows for each set, however many pairs reach the threshold.
    """
    sid, first = np.unique(own["sid"].to_numpy(), return_index=True)
    uid, many = own["uid"].to_numpy()[first], own["n"].to_numpy()[first]
    every = [np.frombuffer(g.as_buffer(), np.uint64) for g in own["grams"]]
    by = np.argsort(uid, kind="stable")
    names, begin = np.unique(uid[by], return_index=True)
    members = dict(zip(names.tolist(), np.split(by, begin[1:])))
    far, xs, ys, root = np.zeros(len(sid), np.int64), [], [], list(range(len(sid)))

    def of(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def connect(x: int, y: int) -> None:
        p, q = of(x), of(y)
        if p != q:
            root[q] = p
            xs.append(x)
            ys.append(y)

    a, b = (pairs[c].to_numpy() for c in "ab")
    for k in range(len(a)):
        u, v = members[int(a[k])], members[int(b[k])]
        if len(u) == len(v) == 1:
            p, q = every[first[u[0]]], every[first[v[0]]]
            common = overlap(p, q)
            if common / (len(p) + len(q) - common) >= threshold:
                far[u] += many[v]
                far[v] += many[u]
                connect(int(u[0]), int(v[0]))
            continue
        for x, y, same in sides(u, v):
            p, q = [every[first[i]] for i in x], [every[first[i]] for i in y]
            common = overlaps(p, q)
            sizes = np.array([len(g) for g in p])[:, None] + np.array([len(g) for g in q])
            hits = common / (sizes - common) >= threshold
            if same:
                np.fill_diagonal(hits, False)
            if not hits.any():
                continue
            far[x] += hits @ many[y]
            if not same:
                far[y] += many[x] @ hits
            i, j = spanning(hits)
            for e in zip(x[i].tolist(), y[j].tolist()):
                connect(*e)
    some = np.flatnonzero(far)
    xs, ys = (np.array(v, np.int64) for v in (xs, ys))
    none = lambda k: pa.nulls(k, pa.int64())
    linked = pa.Table.from_arrays([pa.array(sid[some]), none(len(some)), pa.array(far[some])], ["x", "y", "far"])
    return pa.concat_tables([linked, pa.Table.from_arrays([pa.array(sid[xs]), pa.array(sid[ys]), none(len(xs))], ["x", "y", "far"])])


def sides(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Parts of two units' sets, each pair of different sets in one of them, and whether both parts are the same."""
    itself = a is b
    for i in range(0, len(a), SIDE):
        for j in range(i if itself else 0, len(b), SIDE):
            yield a[i : i + SIDE], b[j : j + SIDE], itself and i == j


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    both = np.concatenate((a, b))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each sorted set of a shares with each of b."""
    if len(a) > len(b):
        return overlaps(b, a).T
    places = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(g) for g in s])) for s in (a, b)]
    both = a[0] if len(a) == 1 else np.intersect1d(places[0][0], places[1][0])
    out = np.zeros((len(a), len(b)), np.float32)
    coded = []
    for elements, row in places:
        at = np.minimum(np.searchsorted(both, elements), max(0, len(both) - 1))
        met = np.flatnonzero(both[at] == elements) if len(both) else np.empty(0, np.int64)
        met = met[np.argsort(at[met], kind="stable")]
        coded.append((at[met], row[met]))
    if len(a) == 1:
        return np.bincount(coded[1][1], minlength=len(b))[None, :]
    for low in range(0, len(both), WIDE):
        parts = []
        for (at, row), s in zip(coded, (a, b)):
            lo, hi = np.searchsorted(at, (low, low + WIDE))
            part = np.zeros((len(s), WIDE), np.float32)
            part[row[lo:hi], at[lo:hi] - low] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def spanning(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of true places that connect the same rows and columns as all of them do, fewer than both together."""
    rows, columns = np.flatnonzero(hits.any(1)), np.ones(hits.shape[1], bool)
    if hits.size == 1:
        return rows, rows
    out_rows, out_columns = [], []
    left = np.zeros(hits.shape[0], bool)
    left[rows] = True
    for i in rows:
        if not left[i]:
            continue
        left[i], reached = False, np.array([i])
        while len(reached):
            near = hits[reached] & columns
            new = np.flatnonzero(near.any(0))
            out_rows.append(reached[near[:, new].argmax(0)])
            out_columns.append(new)
            columns[new] = False
            rest = np.flatnonzero(left)
            near = hits[np.ix_(rest, new)]
            got = near.any(1)
            reached = rest[got]
            out_rows.append(reached)
            out_columns.append(new[near[got].argmax(1)] if len(new) else new)
            left[reached] = False
    return np.concatenate(out_rows), np.concatenate(out_columns)


def components(pairs: DataFrame) -> DataFrame:
    """(x, root) of pairs(x, y): the least of each connected component, by label propagation with pointer jumping."""
    edges = cut(pairs.select("x", "y").unionAll(pairs.select("y", "x")).distinct())
    labels = cut(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")))
    while True:
        seen = edges.join(labels.select(F.col("x").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("via"))
        step = labels.join(seen, "x").select("x", F.col("root").alias("old"), F.least("root", "via").alias("root"))
        jump = step.join(labels.select(F.col("x").alias("root"), F.col("root").alias("over")), "root", "left")
        after = cut(jump.select("x", "old", F.least("root", F.coalesce("over", "root")).alias("root")))
        discard(labels)
        labels = after.select("x", "root")
        if not after.where("old <> root").limit(1).count():
            discard(edges)
            return labels
        labels = cut(labels)
        discard(after)


def classes(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(doc_id, t, size, root, links) of each row.

    root: the least (z: is the id null, d: the id, t) of the row's connected component, so that it
    tells the class and which row stands for it. links: other rows whose sets reach the threshold.
    Both are null for a text without words.
    """
    rows, sets, found = verified(docs, n, threshold)
    links = found.where("y IS NULL").groupBy("x").agg(F.sum("far").alias("far"))
    roots = components(found.where("y IS NOT NULL"))
    known = cut(sets.join(links.join(roots, "x").withColumnRenamed("x", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    discard(found, sets)
    best = known.groupBy("root").agg(F.min("best").alias("of"))
    about = cut(known.join(best, "root").select("h1", "h2", "n", F.col("of").alias("root"), (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links")))
    discard(known)
    # Rows of a set that a thousandth of all rows share meet it by broadcast, the others by shuffle.
    most = max(10_000, rows.count() // 1_000)
    hot = F.broadcast(about.where(F.col("n") > most))
    own = rows.select("doc_id", "t", "size", "h1", "h2")
    few = own.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(small(about.where(F.col("n") <= most)), ["h1", "h2"], "left")
    return own.join(hot, ["h1", "h2"]).unionByName(few).select("doc_id", "t", "size", "root", "links")


def linked(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) for each row: its class and to how many other rows its similarity reaches the threshold.

    Two rows are linked if the Jaccard similarity of their n-gram sets is the threshold or more; a class is a
    connected component of these links, named by its least doc_id. Copies are not expanded into
    pairs: their links are counted from the links of the different sets, none of which is left out.

    Words are runs of ASCII letters, digits and characters beyond ASCII, in lower case; a text of
    fewer than n words, but one at least, has one n-gram of all its words. Defined cases: a text
    without words (null, empty) is like nothing, not even another, and a class of its own with no links;
    rows with a null doc_id take part, and a class of such rows only has a null class_id; repeated
    rows, and rows that share a doc_id but not the text, count each for itself; an empty table
    gives no rows; extra columns are ignored; doc_id keeps its type.
    """
    out = classes(docs, n, threshold)
    alone = F.col("root").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("root.d")).alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"))


def deduplicated(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs without all but one document of each class, with its columns.

    Classes are those of linked(); the row with the least doc_id stays, a null counting as the
    greatest, of rows that share it the one whose text has the least hash, and of repeated rows
    one. Documents without words stay.
    """
    marked = classes(docs, n, threshold).where("root IS NOT NULL")
    stays = F.struct(F.col("doc_id").isNull(), "doc_id", "t").eqNullSafe(F.struct("root.z", "root.d", "root.t"))
    marked = cut(marked.groupBy("doc_id", "t").agg(F.count("*").alias("n"), F.max(stays).alias("stays")))
    out, where, _ = flat(docs)
    columns = out.columns
    out = out.withColumn("t_key", F.xxhash64(F.col(where["text"])))
    same = lambda m: F.col(where["doc_id"]).eqNullSafe(m["doc_id"]) & (F.col("t_key") == m["t"]) & F.col(where["text"]).isNotNull()
    gone = small(marked.where("NOT stays").select("doc_id", "t"))
    kept = out.join(gone, same(gone), "left_anti")
    many = cut(marked.where("stays AND n > 1").select("doc_id", "t"))
    if many.limit(1).count():
        many = small(many)
        alone = kept.join(many, same(many), "left_anti")
        one = kept.join(many, same(many), "left_semi").dropDuplicates([where["doc_id"], "t_key"])
        kept = alone.unionAll(one)
    return kept.select(*columns).toDF(*docs.columns)


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, CASE WHEN len(ws) < {N} THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - {N} + 2), lambda i: array_to_string(ws[i:i + {N} - 1], ' '))) END AS gs FROM w WHERE len(ws) > 0),
e AS (SELECT doc_id, len(gs) AS size, unnest(gs) AS gram FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.size) AS sa, any_value(b.size) AS sb, count(*) AS common FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE common::DOUBLE / (sa + sb - common) >= {THRESHOLD}),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, least(x, min(y)) AS class_id FROM r GROUP BY x),
d AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM documents LEFT JOIN c ON c.x = doc_id LEFT JOIN d ON d.x = doc_id
"""
