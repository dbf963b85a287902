"""Operator 4: exact top-k inner products from an impact-ordered, score-at-a-time index.

Vectors become integers floor(scale * x).  The index is cut into blocks of
rows; in a block every dimension is a posting list ordered by descending
magnitude of its values, so the postings with an impact (query value times
posting value) of some magnitude are one segment of each list.

For a query the segments are processed by descending quantised impact: each
level adds its postings to the rows' accumulators.  A row's unread
postings have impacts below the level, so its score lies within (unread
dimensions) * (level - 1) of its accumulator.  Processing stops only when that
proof leaves few rows that can still be among the k best; these, and no others,
are rescored exactly.  If the proof never comes, all levels are read.  There
is no product with a whole block.

Queries go through the lists in groups: each list is passed over once a level
for the whole group, whose accumulators of a row lie side by side, and a posting
adds nothing to the queries whose level it does not reach.  Every query has a
level of its own, ends by its own proof and then leaves the group.  The first
level is the one that ended the query's last block, as a proof seldom comes much
earlier; it decides how much is read at once, never which rows are found.

Index blocks fall into strips.  A query block is searched in one strip first,
block after block; the k-th best score found so far is a bar that k rows surely
reach, so it is carried from block to block, and then, as a column of the query
block, to all other strips.  A row that cannot reach the bar is out, and so is
a block whose largest impacts cannot.  Blocks meet by an equi-join on strip and
salt, which moves an index block as often as there are salts, not once a query
block; the k best of each block are merged by a window over what passed the bar.

Cases: vectors that are null, empty, or hold null or non-finite components
take no part, nor do rows whose id is null; vectors of another length than the
query's are not its candidates; rows that share the query's id are its own;
a query id in several rows is asked once (its largest vector); ties go to the
smaller id; fewer than k candidates give fewer rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardinal.llm.common import release_memory, reliable_checkpoint
from cardinal.llm.vectors import finite, matrix

BLOCK_ROWS = 4096
QUERY_ROWS = 256
STRIP_BLOCKS = 8  # index blocks searched one after the other, with a running bar
SALTS = 8  # parts of the query blocks that meet a strip in tasks of their own
BUILT_BYTES = 64 << 20  # posting lists a task keeps
GROUP = 128  # queries that a posting list is passed over for at once
ADDED = 256  # postings added up at a time
POSSIBLE = 64  # so many rows may be rescored instead of reading on
NO_BAR = -(1 << 62)  # below every score


class ImpactIndex:
    """Posting lists of one block of integer vectors, each by descending magnitude."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.postings = self.rescored = 0  # read and rescored so far, by all queries
        self.passed = 0  # postings passed over for groups of queries
        n, self.width = rows.shape
        size = np.abs(rows)
        self.largest = size.max(axis=0) if n else np.zeros(self.width, np.int64)
        self.mean = size.mean(axis=0) if n else np.zeros(self.width)
        self.by_id = np.argsort(ids, kind="stable")
        self.sorted_ids = ids[self.by_id]
        # A list: its rows, the segment of each (postings of one value), and the segments' values and ends.  No zeros.
        self.lists = []
        for d in range(self.width):
            value, largest = rows[:, d], int(self.largest[d])
            key = 2 * (largest - size[:, d]) + (value > 0)
            order = np.argsort(key.astype(np.int16) if largest < 1 << 14 else key, kind="stable")[:np.count_nonzero(value)]
            held = value[order]
            new = np.ones(len(held), bool)
            new[1:] = held[1:] != held[:-1]
            first = np.flatnonzero(new)
            self.lists.append((order, np.cumsum(new) - 1, held[first], np.append(first, len(held))))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest score any row could have for each query."""
        weight = np.abs(queries)
        if (weight.astype(np.float64) @ self.largest.astype(np.float64)).max(initial=0) < 1 << 52:
            return weight @ self.largest
        exact = [sum(a * b for a, b in zip(w, self.largest.tolist(), strict=True)) for w in weight.tolist()]
        if max(exact) >= 1 << 62:
            raise ValueError("scores of this size do not fit into a long")
        return np.array(exact, np.int64)

    def top(self, query: np.ndarray, own: int, k: int, floor: int = NO_BAR) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the block's k best rows for the query that reach ``floor``, best first."""
        return self.top_many(query[None, :], np.array([own]), k, np.array([floor]), np.zeros(1, np.int64))[0]

    def top_many(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray,
                 levels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """``top`` of each query.  ``levels`` tells where to begin (0: not known) and is set to where the next block may."""
        found = [(self.ids[:0], np.zeros(0, np.int64))] * len(queries)
        if len(self.ids):
            bounds = self.bounds(queries)
            asked = np.flatnonzero(bounds >= floors)
            for at in range(0, len(asked), GROUP):
                group = asked[at:at + GROUP]
                got, levels[group] = self.search(queries[group], own[group], k, floors[group], levels[group], int(bounds[group].max()))
                for i, one in zip(group.tolist(), got, strict=True):
                    found[i] = one
        return found

    def read(self, sums: list[np.ndarray], queries: np.ndarray, since: np.ndarray, level: np.ndarray, unit: float) -> None:
        """Add to each query's accumulators the postings whose impacts reach its ``level`` and not ``since``.

        A list is passed over once for all queries; a posting adds nothing to those whose level it does not reach.
        """
        weight = np.abs(queries)
        gains = [(np.empty((ADDED, len(queries)), x.dtype), np.empty((ADDED, len(queries)), x.dtype)) for x in sums]
        for d, (order, segment, values, ends) in enumerate(self.lists):
            if not len(order):
                continue
            impact = np.multiply.outer(np.abs(values), weight[:, d])
            new = (impact >= level) & (impact < since)
            readers = np.count_nonzero(new, axis=1)
            hit = np.flatnonzero(readers)
            if not len(hit):
                continue
            self.postings += int(readers @ np.diff(ends))
            impact = np.multiply.outer(values, queries[:, d])
            if len(sums) == 1:
                impact = impact.astype(sums[0].dtype)
                impact += sums[0].dtype.type(unit)
            impact *= new
            begin, end = int(ends[hit[0]]), int(ends[hit[-1] + 1])
            self.passed += end - begin
            for table, total, (gain, held) in zip((impact, new.astype(sums[-1].dtype)), sums, gains):
                for at in range(begin, end, ADDED):
                    places = order[at:min(at + ADDED, end)]
                    # Into buffers at hand ("clip" only spares the copy that "raise" makes of them).
                    a, b = gain[:len(places)], held[:len(places)]
                    table.take(segment[at:at + len(places)], axis=0, out=a, mode="clip")
                    total.take(places, axis=0, out=b, mode="clip")
                    a += b
                    total[places] = a

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray, levels: np.ndarray,
               bound: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """``top_many`` of a group of queries whose scores are at most ``bound``."""
        n, m = len(self.ids), len(queries)
        # One accumulator holds score and number of postings read: score + unit * read, exact below 2**24 or 2**53.
        # Larger scores have two accumulators of integers.
        unit = float(1 << (2 * bound + 1).bit_length())
        room = 2 * unit * (self.width + 1)
        if room <= 1 << 53:
            sums = [np.zeros((n, m), np.float32 if room <= 1 << 24 else np.float64)]
        else:
            sums = [np.zeros((n, m), np.int64), np.zeros((n, m), np.int64)]
        weight = np.abs(queries)
        dims = np.count_nonzero((weight > 0) & (self.largest > 0), axis=1)
        # No proof is near while most postings are unread: begin where the last block ended, or at half the mean impact.
        level = np.where(levels > 0, levels, (weight @ self.mean / np.maximum(2 * dims, 1)).astype(np.int64))
        level = np.clip(level, 1, bound + 1)
        since = np.full(m, 1 << 62)
        bars = np.maximum(floors, -bound - 1)  # every score passes the latter
        left, right = (np.searchsorted(self.sorted_ids, own, side) for side in ("left", "right"))
        found: list = [None] * m
        later = level.copy()
        enough = max(POSSIBLE, 2 * k)
        active = np.arange(m)
        while len(active):
            self.read(sums, queries[active], since[active], level[active], unit)
            rest = level[active] - 1
            # Unread postings add less than the level each, and no more than all postings can.
            if len(sums) == 1:
                kind = sums[0].dtype.type
                read = np.floor(sums[0] * kind(1 / unit) + kind(0.5))
                score = sums[0] - read * kind(unit)
                slack = (dims[active].astype(kind) - read) * rest.astype(kind)
            else:
                score, unread = sums[0], dims[active] - sums[1]
                slack = np.where(unread > 0, np.where(rest < (1 << 62) // (self.width + 1), unread * rest, bound), 0)
            most = score + slack
            reach = most >= bars[active].astype(most.dtype)
            for i in np.flatnonzero(left[active] < right[active]).tolist():
                reach[self.by_id[left[active[i]]:right[active[i]]], i] = False
            number = np.count_nonzero(reach, axis=0)
            for i in np.flatnonzero(number > enough).tolist():
                q = active[i]
                possible = np.flatnonzero(reach[:, i])
                low = score[possible, i] - slack[possible, i]
                bar = np.partition(low, len(low) - k)[len(low) - k]  # k rows surely reach this
                if bar > bars[q]:
                    bars[q] = int(bar)
                    reach[:, i] &= most[:, i] >= bar
                    number[i] = np.count_nonzero(reach[:, i])
            ended = (number <= enough) | (level[active] == 1)
            if ended.any():
                at, place = np.nonzero(np.ascontiguousarray(reach[:, ended].T))
                cut = np.searchsorted(at, np.arange(np.count_nonzero(ended) + 1))
                for i, q in enumerate(active[ended].tolist()):
                    found[q] = self.rescore(place[cut[i]:cut[i + 1]], queries[q], k, int(floors[q]))
                few = number[ended] <= enough // 4
                later[active[ended]] = level[active[ended]] + few * (level[active[ended]] // 8 + 1)
                active = active[~ended]
                sums = [np.ascontiguousarray(x[:, ~ended]) for x in sums]  # by rows again
            since[active] = level[active]
            level[active] = np.maximum(level[active] * 2 // 3, 1)
        return found, later

    def rescore(self, possible: np.ndarray, query: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        self.rescored += len(possible)
        exact = self.rows[possible] @ query
        reach = exact >= floor
        possible, exact = possible[reach], exact[reach]
        if len(possible) > 4 * k:  # the k best and all that tie with the last of them
            keep = np.flatnonzero(exact >= np.partition(exact, len(exact) - k)[len(exact) - k])
            possible, exact = possible[keep], exact[keep]
        best = np.lexsort((self.ids[possible], -exact))[:k]
        return self.ids[possible][best], exact[best]


def blocks(vectors: DataFrame, rows: int, scale: float) -> DataFrame:
    """The vectors as integer matrices of at most ``rows`` rows: width, n, ids, data.  No row order is implied."""

    def run(batches):
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(sizes):
                part = b.filter(pa.array(sizes == width))
                for at in range(0, part.num_rows, rows):
                    cut = part.slice(at, rows)
                    data = np.floor(scale * matrix(cut.column(1), int(width)))
                    if np.abs(data).max(initial=0) >= 1 << 62:  # as an integer it would wrap
                        raise ValueError("scores of this size do not fit into a long")
                    data = data.astype("<i8")
                    ids = np.asarray(cut.column(0).to_numpy(zero_copy_only=False), "<i8")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([width], pa.int32()), pa.array([len(ids)], pa.int32()),
                         pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())],
                        names=["width", "n", "ids", "data"])

    return vectors.mapInArrow(run, "width int, n int, ids binary, data binary")


def decode(ids: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, "<i8").reshape(-1, width)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row where ``is_query`` is true."""
    usable = vectors.where(finite(vector_col) & F.col(id_col).isNotNull())
    usable = usable.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"),
                           F.coalesce(is_query, F.lit(False)).alias("asks"))
    n = usable.count()
    even = usable.select("id", "v").repartition(max(1, -(-n // BLOCK_ROWS)))
    index = blocks(even, BLOCK_ROWS, scale).withColumn("block", F.monotonically_increasing_id())
    index = reliable_checkpoint(index)
    asked = usable.where("asks").groupBy("id").agg(F.max("v").alias("v"))
    asks = blocks(asked.repartition(max(1, -(-n // (20 * QUERY_ROWS)))), QUERY_ROWS, scale)
    asks = reliable_checkpoint(asks.select(
        "width", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.monotonically_increasing_id().alias("q")))
    strips = max(1, -(-index.count() // STRIP_BLOCKS))
    tasks = max(strips * SALTS, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["width", "strip", "salt"]
    index = index.withColumn("strip", F.pmod(F.xxhash64("block"), F.lit(strips)).cast("int"))
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(tasks, *keys)
    asks = asks.withColumn("salt", F.pmod(F.shiftright("q", 33) + F.col("q"), F.lit(SALTS)).cast("int"))
    own = F.pmod(F.xxhash64("q"), F.lit(strips)).cast("int")

    def search(part: DataFrame) -> DataFrame:
        met = part.repartition(tasks, *keys).join(index, keys)
        met = met.select("q", "q_ids", "q_data", "bars", "block", "width", "ids", "data")
        return met.mapInArrow(lambda batches: searched(batches, k),
                              "q bigint, bars binary, level double, found array<struct<query_id:bigint,vec_id:bigint,score:bigint>>")

    first = reliable_checkpoint(search(asks.withColumn("bars", F.lit(None).cast("binary")).withColumn("strip", own)))
    found = first
    if strips > 1:
        bars = first.groupBy("q").agg(F.max_by("bars", "level").alias("bars"))  # every one holds; the highest serve best
        rest = asks.join(bars, "q", "left").withColumn("own", own)
        rest = rest.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))).where("strip != own")
        found = first.unionByName(search(rest.drop("own")))
    found = found.select(F.inline("found"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def searched(batches, k: int):
    """Per pair of a query block and an index block: the rows found, and the bars after it."""
    built: dict[int, ImpactIndex] = {}
    running: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of each query of a block: the k best scores, the level to begin at
    for b in batches:
        for at in range(b.num_rows):
            row = b.slice(at, 1).to_pylist()[0]
            if row["block"] not in built:
                if built and (len(built) + 1) * 4 * len(row["data"]) > BUILT_BYTES:
                    built.pop(next(iter(built)))
                built[row["block"]] = ImpactIndex(*decode(row["ids"], row["data"], row["width"]))
            index = built[row["block"]]
            q_ids, q_rows = decode(row["q_ids"], row["q_data"], row["width"])
            bars = np.full(len(q_ids), NO_BAR) if row["bars"] is None else np.frombuffer(row["bars"], "<i8").copy()
            if row["q"] not in running:
                if len(running) >= STRIP_BLOCKS:
                    running.pop(next(iter(running)))
                running[row["q"]] = np.full((len(q_ids), k), NO_BAR), np.zeros(len(q_ids), np.int64)
            best, levels = running[row["q"]]
            bars = np.maximum(bars, best[:, 0])
            got = index.top_many(q_rows, q_ids, k, bars, levels)
            for i, (_, scores) in enumerate(got):
                if len(scores):
                    best[i] = np.sort(np.concatenate([best[i], scores]))[-k:]
            bars = np.maximum(bars, best[:, 0])
            rows = pa.StructArray.from_arrays(
                [pa.array(np.repeat(q_ids, [len(g[0]) for g in got])), pa.array(np.concatenate([g[0] for g in got])),
                 pa.array(np.concatenate([g[1] for g in got]).astype(np.int64))], names=["query_id", "vec_id", "score"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["q"]], pa.int64()), pa.array([bars.astype("<i8").tobytes()], pa.binary()),
                 pa.array([float(bars.astype(np.float64).sum())]),
                 pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)],
                names=["q", "bars", "level", "found"])
    release_memory()
