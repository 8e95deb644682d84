"""Lines carried back through long histories by composed line maps.

The edits of one commit move a line: outside of them by what was added or removed above it, inside to the edge of the old
lines.  That is a piecewise linear map for the first line of a range and another for the last, and a range is touched
if some edit meets it.  Maps of neighbouring commits compose to maps of the same kind, whose pieces are at most the lines of the
file, however many commits they stand for.

History, newest first, is cut into segments; a file with several gets a tree of maps over 1, 2, 4 … segments.  A target climbs
from the segment in which it starts to the end of history, taking each time the largest block that begins where it is, and
then descends only into blocks that touch it, both halves at once, because the map of the newer half tells what
enters the older.  The rounds are logarithmic in the segments of the longest file, whatever is touched; what is met
in a segment is walked for all targets of a task at a time in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from whylake.operators.ranking import among, positions, top_n
from whylake.session import cut_lineage, written

FILE = ["project", "file"]
FAR = 1 << 60
#: Targets that are walked together in one row.
CHUNK = 4096

_EDITS = "array<struct<back:bigint,sha:string,edits:array<struct<new_start:bigint,new_count:bigint,old_start:bigint,old_count:bigint>>>>"
_MAP = "f_at array<bigint>, f_slope array<bigint>, f_value array<bigint>, g_at array<bigint>, g_slope array<bigint>, g_value array<bigint>, " \
       "t_first array<bigint>, t_last array<bigint>, loose boolean"


# --- one commit, many ranges ------------------------------------------------------

class Ranges:
    """First and last lines on their way through the edits of one commit, taken in the order of their lines."""

    def __init__(self, first: np.ndarray, last: np.ndarray):
        self.first, self.last = first, last
        self.to_first, self.to_last = first.copy(), last.copy()
        self.shift_first, self.shift_last = np.zeros_like(first), np.zeros_like(last)
        self.touched = np.zeros(len(first), bool)
        self.held_first, self.held_last = np.zeros(len(first), bool), np.zeros(len(first), bool)

    def through(self, at: np.ndarray | slice, begin, count, old_begin, old_count) -> None:
        """Pass one edit each for the ranges ``at``; values are arrays of that length or numbers."""
        first, last = self.first[at], self.last[at]
        end, delta, removed = begin + count - 1, old_count - count, count == 0
        above = ~removed & (end < first)
        meets = ~removed & (end >= first) & (begin <= last)
        holds_first, holds_last = meets & (begin <= first), meets & (end >= last)
        # a pure deletion sits between the lines begin and begin + 1
        self.touched[at] |= meets | removed & (begin < last) & (begin >= first)
        self.shift_first[at] += np.where(removed & (begin < first) | above, delta, 0)
        self.shift_last[at] += np.where(removed & (begin < last) | above | meets & ~holds_last, delta, 0)
        self.to_first[at] = np.where(holds_first, old_begin + (old_count == 0) - self.shift_first[at], self.to_first[at])
        self.to_last[at] = np.where(holds_last, np.where(old_count > 0, old_begin + old_count - 1, old_begin) - self.shift_last[at], self.to_last[at])
        self.held_first[at] |= holds_first
        self.held_last[at] |= holds_last

    def moved(self) -> tuple[np.ndarray, np.ndarray]:
        return self.to_first + self.shift_first, self.to_last + self.shift_last


class Histories:
    """Commits with their edits of the rows of a batch, as flat arrays."""

    def __init__(self, commits: pa.ListArray):
        each = commits.flatten()
        self.rows = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(commits).fill_null(0)))])
        self.place = -np.asarray(each.field("back"))
        self.sha = each.field("sha")
        edits = each.field("edits")
        self.commits = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(edits)))])
        flat = edits.flatten()
        self.edit = [np.asarray(flat.field(n)).astype(np.int64) for n in ("new_start", "new_count", "old_start", "old_count")]


def walk(known: Histories, row: np.ndarray, first: np.ndarray, last: np.ndarray, own: np.ndarray, limit: int) -> tuple:
    """Carry ranges, each through the commits of its row before its own place, newest first.

    Gives the hits as (range, commit), where each range is after that, whether it goes on, and its number of hits.
    """
    first, last, hits = first.copy(), last.copy(), np.zeros(len(first), np.int64)
    met = []
    length = known.rows[row + 1] - known.rows[row]
    live = np.flatnonzero((length > 0) & (last >= first))
    k = 0
    while len(live):
        c = known.rows[row[live]] + k
        open_ = known.place[c] < own[live]
        who, c = live[open_], c[open_]
        if len(who):
            ranges, n = Ranges(first[who], last[who]), known.commits[c + 1] - known.commits[c]
            for j in range(int(n.max(initial=0))):
                at = np.flatnonzero(n > j)
                ranges.through(at, *(v[known.commits[c[at]] + j] for v in known.edit))
            first[who], last[who] = ranges.moved()
            hits[who] += ranges.touched
            met.append((who[ranges.touched], c[ranges.touched]))
        k += 1
        live = live[(last[live] >= first[live]) & (hits[live] < limit) & (k < length[live])]
    who, commit = (np.concatenate([m[i] for m in met]) if met else np.zeros(0, np.int64) for i in (0, 1))
    return who, commit, first, last, (last >= first) & (hits < limit), hits


# --- maps and their composition ------------------------------------------------------

class Map:
    """x → slope * x + value from each breakpoint on, with slopes 0 and 1."""

    def __init__(self, at, slope, value):
        keep = np.ones(len(at), bool)
        keep[1:] = (slope[1:] != slope[:-1]) | (value[1:] != value[:-1])
        self.at, self.slope, self.value = at[keep], slope[keep], value[keep]

    @classmethod
    def nothing(cls) -> Map:
        return cls(np.array([-FAR]), np.array([1]), np.array([0]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.at, x, side="right") - 1
        return self.slope[i] * x + self.value[i]

    def ends(self) -> np.ndarray:
        return np.concatenate([self.at[1:] - 1, [FAR]])

    def falls(self) -> bool:
        return bool(np.any(self.slope[:-1] * self.ends()[:-1] + self.value[:-1] > self.slope[1:] * self.at[1:] + self.value[1:]))

    def then(self, other: Map) -> Map:
        """This map first, ``other`` after it."""
        line = np.flatnonzero(self.slope == 1)
        low = np.searchsorted(other.at, self.at[line] + self.value[line], side="right")
        high = np.searchsorted(other.at, self.ends()[line] + self.value[line], side="right")
        count = np.maximum(high - low, 0)
        inner = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        at = np.unique(np.concatenate([self.at, other.at[inner] - np.repeat(self.value[line], count)]))
        mine = np.searchsorted(self.at, at, side="right") - 1
        y = self.slope[mine] * at + self.value[mine]
        theirs = np.searchsorted(other.at, y, side="right") - 1
        slope = self.slope[mine] * other.slope[theirs]
        return Map(at, slope, other.slope[theirs] * y + other.value[theirs] - slope * at)

    def highest(self, v: np.ndarray) -> np.ndarray:
        """For a map that never falls: the greatest x that it sends to at most ``v``."""
        i = np.searchsorted(self.slope * self.at + self.value, v, side="right") - 1
        return np.where(self.slope[i] == 1, np.minimum(v - self.value[i], self.ends()[i]), self.ends()[i])

    def lowest(self, v: np.ndarray) -> np.ndarray:
        """For a map that never falls: the least x that it sends to at least ``v``."""
        i = np.minimum(np.searchsorted(self.slope * self.ends() + self.value, v, side="left"), len(self.at) - 1)
        return np.where(self.slope[i] == 1, np.maximum(self.at[i], v - self.value[i]), self.at[i])


class LineMap:
    """What a stretch of history does to ranges: maps of first and last lines, and which ranges it touches.

    A range is touched if for some corner (a, b) it begins at a or before and ends at b or after.  Where edits of one
    commit overlap or contradict each other, maps may fall and corners cannot be told; the stretch is then ``loose`` and taken to
    touch all ranges, which are looked at commit by commit.
    """

    def __init__(self, first: Map, last: Map, a: np.ndarray, b: np.ndarray, loose: bool):
        order = np.lexsort((b, -a))  # corners from the greatest a on; one is needed only if its b is below all before
        a, b = a[order], b[order]
        below = np.minimum.accumulate(b) if len(b) else b
        keep = np.ones(len(a), bool)
        keep[1:] = b[1:] < below[:-1]
        self.first, self.last, self.a, self.b, self.loose = first, last, a[keep], b[keep], loose

    @classmethod
    def nothing(cls) -> LineMap:
        return cls(Map.nothing(), Map.nothing(), np.zeros(0, np.int64), np.zeros(0, np.int64), False)

    @classmethod
    def of_commit(cls, begin, count, old_begin, old_count) -> LineMap:
        end = begin + count - 1
        points = np.unique(np.concatenate([[-FAR], np.where(count > 0, begin, begin + 1), end + 1]))
        ranges = Ranges(points, points)
        for e in zip(begin, count, old_begin, old_count, strict=True):
            ranges.through(slice(None), *(np.int64(v) for v in e))
        to_first, to_last = ranges.moved()
        maps = []
        for to, held in ((to_first, ranges.held_first), (to_last, ranges.held_last)):
            slope = np.where(held, 0, 1)
            maps.append(Map(points, slope, to - slope * points))
        overlap = bool(np.any(np.maximum.accumulate(np.maximum(end, begin))[:-1] >= begin[1:])) if len(begin) > 1 else False
        loose = overlap or any(m.falls() for m in maps)
        # an edit meets a range that begins at its end or before and ends at its beginning or after
        return cls(*maps, np.where(count > 0, end, begin), np.where(count > 0, begin, begin + 1), loose)

    def then(self, older: LineMap) -> LineMap:
        a, b = self.first.highest(older.a), self.last.lowest(older.b)
        return LineMap(self.first.then(older.first), self.last.then(older.last), np.concatenate([self.a, a]), np.concatenate([self.b, b]), self.loose or older.loose)

    def touches(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        if self.loose or not len(self.a):
            return np.full(len(first), self.loose)
        i = np.searchsorted(-self.a, -first, side="right")  # corners with a >= first come first, the last of them has the least b
        return (i > 0) & (last >= self.b[np.maximum(i - 1, 0)])

    def columns(self) -> list:
        return [self.first.at, self.first.slope, self.first.value, self.last.at, self.last.slope, self.last.value, self.a, self.b, self.loose]

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int, prefix: str = "") -> LineMap | None:
        names = [c.split()[0] for c in _MAP.split(", ")]
        if batch.column(prefix + "loose")[i].as_py() is None:
            return None
        v = [batch.column(prefix + n)[i].values.to_numpy() for n in names[:-1]]
        return cls(Map(*v[:3]), Map(*v[3:6]), v[6], v[7], batch.column(prefix + "loose")[i].as_py())


def _with_maps(batch: pa.RecordBatch, keys: list[str], maps: list[LineMap]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _MAP.split(", ")]
    rows = [m.columns() for m in maps]
    columns = [pa.array([r[k] for r in rows], pa.bool_() if n == "loose" else pa.list_(pa.int64())) for k, n in enumerate(names)]
    return pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + columns, names=[*keys, *names])


def segment_maps(segments: DataFrame) -> DataFrame:
    """(project, file, node, map) of every segment (project, file, segment, commits)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, maps = Histories(batch.column("commits")), []
            for r in range(batch.num_rows):
                whole = LineMap.nothing()
                for c in range(known.rows[r], known.rows[r + 1]):
                    own = slice(known.commits[c], known.commits[c + 1])
                    whole = whole.then(LineMap.of_commit(*(v[own] for v in known.edit)))
                maps.append(whole)
            yield _with_maps(batch, [*FILE, "node"], maps)

    return segments.withColumnRenamed("segment", "node").mapInArrow(of, f"project string, file string, node int, {_MAP}")


def paired(nodes: DataFrame) -> DataFrame:
    """Two neighbouring nodes in one row, the newer on the left; the last may stand alone."""
    names = [c.split()[0] for c in _MAP.split(", ")]

    def side(which: int, name: str) -> DataFrame:
        return nodes.filter(F.col("node") % 2 == which).select(*FILE, F.expr("CAST(node div 2 AS INT)").alias("node"), *(F.col(n).alias(name + n) for n in names))

    return side(0, "left_").join(side(1, "right_"), [*FILE, "node"], "left")


def composed(pairs: DataFrame) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for i in range(batch.num_rows):
                left, right = LineMap.read(batch, i, "left_"), LineMap.read(batch, i, "right_")
                maps.append(left if right is None else left.then(right))
            yield _with_maps(batch, [*FILE, "node"], maps)

    return pairs.mapInArrow(of, f"project string, file string, node int, {_MAP}")


# --- targets ------------------------------------------------------------------

_TARGET = "project string, file string, target_id string, own_pos bigint, first bigint, last bigint"


def chunked(targets: DataFrame, keys: list[str]) -> DataFrame:
    """Targets of one key gathered in rows of about ``CHUNK``."""
    counts = targets.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_chunks"))
    salted = targets.join(counts, keys).withColumn("_chunk", F.pmod(F.xxhash64("target_id"), F.col("_chunks")))
    return salted.groupBy(*keys, "_chunk").agg(F.collect_list(F.struct("target_id", "own_pos", "first", "last")).alias("targets")).drop("_chunk")


class Chunk:
    """The targets of the rows of a batch, as flat arrays; ``row`` is the row of each."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch.column("targets")
        each = lists.flatten()
        self.row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(lists)))
        self.target_id = each.field("target_id")
        self.own = np.asarray(pc.fill_null(each.field("own_pos"), FAR))
        self.own_pos = each.field("own_pos")
        self.first, self.last = np.asarray(each.field("first")).copy(), np.asarray(each.field("last")).copy()

    def keys(self, batch: pa.RecordBatch, at: np.ndarray, names: list[str]) -> list[pa.Array]:
        return [batch.column(n).take(pa.array(self.row[at])) for n in names]


def walked(targets: DataFrame, segments: DataFrame, limit: int) -> DataFrame:
    """One row for each hit (target_id, sha, log_pos) of targets in their ``segment``, and one without a commit for each
    target that goes on, with where it is then."""
    rows = chunked(targets, [*FILE, "segment"]).join(segments, [*FILE, "segment"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, known = Chunk(batch), Histories(batch.column("commits"))
            who, commit, first, last, goes_on, _ = walk(known, chunk.row, chunk.first, chunk.last, chunk.own, limit)
            for at, hit in ((who, commit), (np.flatnonzero(goes_on), None)):
                index, nothing = pa.array(at), lambda kind, at=at: pa.nulls(len(at), kind)
                yield pa.RecordBatch.from_arrays([
                    *chunk.keys(batch, at, [*FILE, "segment"]), chunk.target_id.take(index), chunk.own_pos.take(index),
                    nothing(pa.int64()) if hit is not None else pa.array(first[at]), nothing(pa.int64()) if hit is not None else pa.array(last[at]),
                    nothing(pa.string()) if hit is None else known.sha.take(pa.array(hit)), nothing(pa.int64()) if hit is None else pa.array(known.place[hit])],
                    names=["project", "file", "segment", "target_id", "own_pos", "first", "last", "sha", "log_pos"])

    return rows.mapInArrow(of, "project string, file string, segment int, target_id string, own_pos bigint, first bigint, last bigint, sha string, log_pos bigint")


def climbed(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Targets (with ``node``) behind that node, and whether it touches them and is sure to."""
    rows = chunked(targets, [*FILE, "node"]).join(nodes, [*FILE, "node"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = Chunk(batch)
            first, last, touched, sure = chunk.first.copy(), chunk.last.copy(), np.zeros(len(chunk.row), bool), np.zeros(len(chunk.row), bool)
            for i in range(batch.num_rows):
                own, known = chunk.row == i, LineMap.read(batch, i)
                touched[own], sure[own] = known.touches(chunk.first[own], chunk.last[own]), not known.loose
                first[own], last[own] = known.first(chunk.first[own]), known.last(chunk.last[own])
            every = np.arange(len(chunk.row))
            yield pa.RecordBatch.from_arrays([
                *chunk.keys(batch, every, [*FILE, "node"]), chunk.target_id, chunk.own_pos, pa.array(chunk.first), pa.array(chunk.last),
                pa.array(first), pa.array(last), pa.array(touched), pa.array(sure)],
                names=["project", "file", "node", "target_id", "own_pos", "first", "last", "to_first", "to_last", "touched", "sure"])

    return rows.mapInArrow(of, "project string, file string, node int, target_id string, own_pos bigint, first bigint, last bigint, "
                               "to_first bigint, to_last bigint, touched boolean, sure boolean")


def descended(active: DataFrame, pairs: DataFrame) -> DataFrame:
    """Targets in the halves of their node that touch them."""
    rows = chunked(active, [*FILE, "node"]).join(pairs, [*FILE, "node"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = Chunk(batch)
            for i in range(batch.num_rows):
                own = np.flatnonzero(chunk.row == i)
                first, last, node = chunk.first[own], chunk.last[own], batch.column("node")[i].as_py()
                for k, side in enumerate(("left_", "right_")):
                    known = LineMap.read(batch, i, side)
                    if known is None:
                        continue
                    at = own[touched := known.touches(first, last)]
                    yield pa.RecordBatch.from_arrays([
                        *chunk.keys(batch, at, FILE), pa.array(np.full(len(at), 2 * node + k, np.int32)), chunk.target_id.take(pa.array(at)), chunk.own_pos.take(pa.array(at)),
                        pa.array(first[touched]), pa.array(last[touched]), pa.array(np.full(len(at), not known.loose))],
                        names=["project", "file", "node", "target_id", "own_pos", "first", "last", "sure"])
                    first, last = known.first(first), known.last(last)

    return rows.mapInArrow(of, "project string, file string, node int, target_id string, own_pos bigint, first bigint, last bigint, sure boolean")


def _newest(active: DataFrame, limit: int) -> DataFrame:
    """Each block that is sure to touch a target holds a hit, so blocks behind ``limit`` of them hold none that count."""
    before = W.partitionBy("target_id").orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    return active.withColumn("_sure", F.coalesce(F.sum(F.col("sure").cast("int")).over(before), F.lit(0))).filter(F.col("_sure") < limit).drop("_sure")


def line_history(targets: DataFrame, hunks: DataFrame, segment: int, limit: int) -> DataFrame:
    """(project, file, target_id, sha, log_pos): commits behind the lines of targets (project, file, target_id, own_pos,
    first, last), the newest ``limit`` of each.  Files of both sides carry the same names."""
    targets = written(targets)
    day = F.datediff(F.col("date"), F.lit("1970-01-01")).alias("day")
    slim = hunks.select(*FILE, "sha", "log_pos", day, "new_start", "new_count", "old_start", "old_count")
    edits = among(slim, FILE, targets)
    commits = written(edits.groupBy(*FILE, "sha", "log_pos", "day").agg(
        F.array_sort(F.collect_list(F.struct("new_start", "new_count", "old_start", "old_count"))).alias("edits"))).withColumn("back", -F.col("log_pos"))
    long = cut_lineage(commits.groupBy(*FILE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > segment))
    most = long.agg(F.max("n")).first()[0] or 0

    def cut(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*FILE, "segment").agg(F.array_sort(F.collect_list(F.struct("back", "sha", "edits"))).cast(_EDITS).alias("commits"))

    if not most:
        first = walked(targets.withColumn("segment", F.lit(0)), cut(commits.withColumn("segment", F.lit(0))), limit)
        return first.filter("sha IS NOT NULL").select(*FILE, "target_id", "sha", "log_pos")

    placed = positions(commits.join(long, FILE, "left_semi"), FILE, -F.col("day"), [F.col("back")])
    parts = placed.withColumn("segment", F.floor((F.col("position") - 1) / segment).cast("int")).select(*FILE, "segment", "back", "sha", "edits")
    short = commits.join(long, FILE, "left_anti").select(*FILE, F.lit(0).alias("segment"), "back", "sha", "edits")
    segments = written(cut(parts.unionByName(short)))

    # where targets start: the last segment whose newest commit is not before their own place
    tops = segments.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("segment", (-F.get("commits", F.lit(0))["back"]).alias("place")))).alias("tops"))
    later = F.size(F.filter("tops", lambda x: x["place"] >= F.col("own_pos")))
    start = targets.join(tops, FILE).withColumn("segment", F.when(F.col("own_pos").isNull(), 0).otherwise(F.greatest(later - 1, F.lit(0))).cast("int"))
    first = written(walked(start.withColumn("n", F.size("tops")).drop("tops", "n"), segments, limit))
    found = [first.filter("sha IS NOT NULL").select(*FILE, "segment", "target_id", "sha", "log_pos")]

    # the trees of the long files
    nodes, pairs = [cut_lineage(segment_maps(segments.join(long, FILE, "left_semi")))], [None]
    while segment << (len(nodes) - 1) < most:
        pairs.append(cut_lineage(paired(nodes[-1])))
        nodes.append(cut_lineage(composed(pairs[-1])))

    sizes = long.select(*FILE, F.ceil(F.col("n") / segment).cast("int").alias("segments"))
    here = first.filter("sha IS NULL").withColumn("next", F.col("segment") + 1).join(sizes, FILE).filter("next < segments").select(
        *FILE, "segments", "target_id", "own_pos", "first", "last", "next")
    active: list[DataFrame | None] = []
    for level, own in enumerate(nodes):
        odd = F.shiftright("next", level) % 2 == 1
        up = cut_lineage(climbed(here.filter(odd).withColumn("node", F.expr(f"next >> {level}")).drop("segments", "next"), own))
        active.append(up.filter("touched").select(*FILE, "node", "target_id", "own_pos", "first", "last", "sure"))
        moved = up.filter("to_last >= to_first").select(
            *FILE, "target_id", "own_pos", F.col("to_first").alias("first"), F.col("to_last").alias("last"), ((F.col("node") + 1) * (1 << level)).cast("int").alias("next"))
        here = cut_lineage(here.filter(~odd).unionByName(moved.join(sizes, FILE)).filter("next < segments"))
    entered = None
    for level in range(len(nodes) - 1, -1, -1):
        if entered is not None:
            entered = descended(entered, pairs[level + 1]).unionByName(active[level])
        else:
            entered = active[level]
        entered = cut_lineage(_newest(entered, limit))
    last = written(walked(entered.withColumnRenamed("node", "segment").drop("sure"), segments, limit))
    found.append(last.filter("sha IS NOT NULL").select(*FILE, "segment", "target_id", "sha", "log_pos"))

    # a range that ends in a segment is not met behind it; one that goes on says so in the segment's own row
    walks = start.select("target_id", "segment").unionByName(entered.select("target_id", F.col("node").alias("segment")))
    on = first.unionByName(last).filter("sha IS NULL").select("target_id", "segment", F.lit(True).alias("on"))
    ends = walks.join(on, ["target_id", "segment"], "left").filter("on IS NULL").groupBy("target_id").agg(F.min("segment").alias("end"))
    hits = found[0].unionByName(found[1]).join(ends, "target_id", "left").filter("end IS NULL OR segment <= end")
    return top_n(hits.select(*FILE, "target_id", "sha", "log_pos"), ["target_id"], [F.col("log_pos").desc()], limit).drop("rank")
