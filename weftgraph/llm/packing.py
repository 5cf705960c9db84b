"""Best-fit packing of documents into sequences of a fixed number of tokens.

Linear grouping: the large pieces, in order of length, are cut into groups of equal cardinality,
and each length counts as its group's largest. Few sizes remain, so the bins' configurations are
optimised by column generation over a small linear programme. Then the actual pieces take the
slots, and what room they leave is filled with the small pieces, best fit first.

All of this is computed from the histogram of lengths alone, which has at most `capacity` rows
whatever the corpus, as runs: "the pieces of length l that rank from a to b go to the bins from x
on, q to each". Executors only rank the pieces and look up their runs. No text is shuffled.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, kind_of, n_tokens, pick

CAPACITY = 2048
#: Pieces over capacity / SMALL are large; groups of equal cardinality among them.
SMALL, GROUPS = 8, 12
#: Hash parts that the pieces of a length are ranked in, side by side.
PARTS = 4096


def best_pattern(values: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within capacity that is worth most (unbounded knapsack)."""
    worth = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    use = np.flatnonzero(values > 1e-12)
    use = use[np.argsort(np.array(sizes)[use], kind="stable")]
    size, value = np.array(sizes)[use], values[use]
    fit = np.searchsorted(size, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        worth[c] = worth[c - 1]
        if fit[c]:
            found = worth[c - size[: fit[c]]] + value[: fit[c]]
            g = int(found.argmax())
            if found[g] > worth[c] + 1e-12:
                worth[c], last[c] = found[g], use[g]
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= sizes[last[c]]
    return worth[capacity], pattern


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(how many slots of each size, how many such bins), enough for the demand.

    The linear programme is solved by column generation with a revised simplex method, rounded
    down, and the few pieces that are then left are put first-fit by decreasing size. Any columns
    make a valid packing, so generation may end before the optimum if it goes round in a circle.
    """
    k = len(sizes)
    columns = [np.eye(k)[g] * (capacity // sizes[g]) for g in range(k)]
    need = np.array(demand, float)
    for _ in range(1000 * k):
        basis = np.array(columns).T
        inverse = np.linalg.inv(basis)
        x, prices = inverse @ need, np.ones(k) @ inverse
        value, pattern = best_pattern(np.maximum(prices, 0), sizes, capacity)
        if value <= 1 + 1e-9:
            break
        way = inverse @ pattern
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        columns[int(np.argmin(ratio))] = pattern
    x = np.linalg.inv(np.array(columns).T) @ need
    left = [int(d) for d in demand]
    out = []
    for column, times in sorted(zip([tuple(int(a) for a in c) for c in columns], x), reverse=True):
        bins = max(0, int(times + 1e-9))
        if bins and any(column):
            out.append((column, bins))
            left = [max(0, a - b * bins) for a, b in zip(left, column)]
    while any(left):
        room, slots = capacity, [0] * k
        for g in range(k):
            slots[g] = min(left[g], room // sizes[g])
            room -= slots[g] * sizes[g]
        times = min(left[g] // slots[g] for g in range(k) if slots[g])
        out.append((tuple(slots), times))
        left = [a - b * times for a, b in zip(left, slots)]
    return out


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(runs (length, rank from, rank to, first bin, pieces a bin), number of bins) for so many pieces of each length."""
    runs: list[tuple[int, int, int, int, int]] = []
    bins = histogram.get(capacity, 0)
    if bins:
        runs.append((capacity, 0, bins, 0, 1))
    free: dict[int, list[tuple[int, int]]] = {}
    large = sorted((s for s, n in histogram.items() if capacity // SMALL < s < capacity and n), reverse=True)
    total = sum(histogram[s] for s in large)
    if total:
        starts = [0]
        for s in large:
            starts.append(starts[-1] + histogram[s])
        cuts = sorted({total * g // groups for g in range(groups)})
        at = lambda place: bisect.bisect_right(starts, place) - 1
        sizes = [large[at(c)] for c in cuts]
        demand = [b - a for a, b in zip(cuts, [*cuts[1:], total])]
        merged: list[list[int]] = []
        for s, n in zip(sizes, demand):
            if merged and merged[-1][0] == s:
                merged[-1][1] += n
            else:
                merged.append([s, n])
        sizes, demand = [s for s, _ in merged], [n for _, n in merged]
        place = [sum(demand[:g]) for g in range(len(sizes))]
        ends = [sum(demand[: g + 1]) for g in range(len(sizes))]
        for slots, times in configurations(sizes, demand, capacity):
            segments: list[tuple[int, int, int]] = []
            for g, several in enumerate(slots):
                for _ in range(several):
                    take, i = min(times, ends[g] - place[g]), 0
                    while i < take:
                        k = at(place[g] + i)
                        n = min(take - i, starts[k + 1] - place[g] - i)
                        rank = place[g] + i - starts[k]
                        runs.append((large[k], rank, rank + n, bins + i, 1))
                        segments.append((i, i + n, large[k]))
                        i += n
                    place[g] += take
            edges = sorted({0, times, *(x for a, b, _ in segments for x in (a, b))})
            room = np.full(len(edges) - 1, capacity)
            for a, b, s in segments:
                room[bisect.bisect_left(edges, a) : bisect.bisect_left(edges, b)] -= s
            for a, b, r in zip(edges, edges[1:], room):
                free.setdefault(int(r), []).append((bins + a, b - a))
            bins += times
    rooms = sorted(r for r in free if r > 0)
    for s in sorted((s for s, n in histogram.items() if 0 < s <= capacity // SMALL and n), reverse=True):
        rank, left = 0, histogram[s]

        def give(start: int, several: int, room: int) -> None:
            if several and room > 0:
                if not free.get(room):
                    free[room] = []
                    i = bisect.bisect_left(rooms, room)
                    if i == len(rooms) or rooms[i] != room:
                        rooms.insert(i, room)
                free[room].append((start, several))

        while left:
            i = bisect.bisect_left(rooms, s)
            while i < len(rooms) and not free.get(rooms[i]):
                rooms.pop(i)
            if i == len(rooms):
                several = -(-left // (capacity // s))
                give(bins, several, capacity)
                bins += several
                continue
            room = rooms[i]
            start, several = free[room].pop()
            each = room // s
            full = min(several, left // each)
            if full:
                runs.append((s, rank, rank + full * each, start, each))
                rank, left = rank + full * each, left - full * each
                give(start, full, room - each * s)
            rest = 0
            if full < several and left:
                rest = left
                runs.append((s, rank, rank + rest, start + full, rest))
                rank, left = rank + rest, 0
                give(start + full, 1, room - rest * s)
            if full + (rest > 0) < several:
                give(start + full + (rest > 0), several - full - (rest > 0), room)
    return runs, bins


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length): documents over capacity are cut, the last piece is the rest."""
    n = n_tokens(F.col("text"))
    out = pick(docs, "doc_id", "text").select("doc_id", n.alias("n")).where("n > 0")
    last = ((F.col("n") - 1) / capacity).cast("int")
    out = out.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece") * capacity
    return out.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(capacity)).alias("length"))


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: bin_id, doc_id, piece, start, n_tokens (start: tokens of the document before it).

    No bin holds more than capacity tokens, and every token of every document is in one bin.
    Defined cases: a null or empty text has no tokens and so no piece; a null doc_id is packed like
    another; repeated rows are packed each for itself; pieces that tie in length are ranked by a
    hash of doc_id and piece (mod PARTS), then doc_id, piece, so the result depends on the table
    alone; an empty table gives no rows; extra columns are ignored; doc_id keeps its type.
    """
    items = cut(pieces(docs, capacity).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)).cast("int")))
    counts = items.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = cut(counts)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    runs.sort()
    shift = max([1, *(r[2] for r in runs)]).bit_length()
    if shift + capacity.bit_length() > 62:
        raise ValueError("too many pieces of a length")
    keys = np.array([(r[0] << shift) + r[1] for r in runs], np.int64)
    lows, firsts, each = (np.array([r[i] for r in runs], np.int64) for i in (1, 3, 4))
    look = docs.sparkSession.sparkContext.broadcast((keys, lows, firsts, each))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lows, firsts, each = look.value
        for b in batches:
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(keys, (b.column("length").to_numpy().astype(np.int64) << shift) + rank, "right") - 1
            found = pa.array(firsts[at] + (rank - lows[at]) // each[at], pa.int64())
            yield pa.RecordBatch.from_arrays([found, *(b.column(k) for k in ("doc_id", "piece", "start", "length"))], ["bin_id", "doc_id", "piece", "start", "n_tokens"])

    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    before = before.select("length", "part", "before")
    order = Window.partitionBy("length", "part").orderBy(F.col("doc_id").asc_nulls_last(), "piece")
    ranked = items.withColumn("row", F.row_number().over(order)).join(before, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", (F.col("before") + F.col("row") - 1).alias("rank"))
    return ranked.mapInArrow(place, f"bin_id long, doc_id {kind_of(docs, 'doc_id')}, piece int, start int, n_tokens int")
