"""Tracks of boxes over ordered frames, their range rate and time to collision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.geometry import time_to_collision
from kerbside.operators.runs import map_run_batches, portions

BUFFER = 12
TRACKS = (
    "track_id bigint, class_name string, x1 double, y1 double, x2 double, y2 double, age bigint, hits bigint, misses bigint, "
    "evicted boolean, range_rate double, last_distance double, ttc double"
)

#: A live track in the state of a stream.
STATE = "class_name string, x1 double, y1 double, x2 double, y2 double, age bigint, hits bigint, misses bigint, times array<double>, distances array<double>"


def range_rates(df: DataFrame, track: str, time: str, distance: str, ties: Sequence[str] = ()) -> DataFrame:
    """Add range_rate, last_distance and ttc over the last 12 rows of the track.

    The least-squares slope needs four known distances over some time; a missing
    distance takes a place in the buffer.
    """
    w = Window.partitionBy(track).orderBy(time, *ties).rowsBetween(-(BUFFER - 1), 0)
    known = F.col(distance).isNotNull()
    t = F.when(known, F.col(time))
    span = F.max(t).over(w) - F.min(t).over(w)
    enough = (F.count(distance).over(w) >= 4) & (span >= 1e-6)
    made = df.withColumns(
        {
            "range_rate": F.when(enough, F.regr_slope(F.col(distance), t).over(w)),
            "last_distance": F.last(distance, ignorenulls=True).over(w),
        }
    )
    return made.withColumn("ttc", time_to_collision(F.col("last_distance"), F.col("range_rate")))


def endpoints(df: DataFrame, track: str, time: str, distance: str, ties: Sequence[str] = ()) -> DataFrame:
    """Per track the first and last known distance of its last 12 rows, and its number of rows."""
    back = Window.partitionBy(track).orderBy(F.col(time).desc(), *[F.col(x).desc() for x in ties])
    rows = df.withColumns({"_n": F.row_number().over(back), "hits": F.count("*").over(Window.partitionBy(track))}).where(F.col("_n") <= BUFFER)
    known = F.when(F.col(distance).isNotNull(), F.col("_n"))
    return rows.groupBy(track, "hits").agg(F.max_by(distance, known).alias("first_distance"), F.min_by(distance, known).alias("last_distance"))


class Tracks:
    """All tracks of a clip, or of many, as arrays, a line each in the order in which they were made.

    A frame moves all lines at once: of the pairs of a track and a box of its clip
    and class that share enough, the tracks of a clip take their best free box
    one after the other.  ``evicted`` lines stay until ``drop_evicted``.
    """

    NUMBERS = ("track_id", "age", "hits", "misses")

    def __init__(self, min_overlap: float = 0.2, max_misses: int = 8, clips: int = 1) -> None:
        import numpy as np

        self.min_overlap, self.max_misses, self.next_ids = min_overlap, max_misses, np.ones(clips, np.int64)
        self.box, self.class_name, self.evicted = np.zeros((0, 4)), np.zeros(0, object), np.zeros(0, bool)
        self.clip = np.zeros(0, np.int64)
        self.counts = {k: np.zeros(0, np.int64) for k in self.NUMBERS}
        # the last BUFFER sightings, the newest last; places not yet used and unknown distances are NaN
        self.times, self.distances = np.full((0, BUFFER), np.nan), np.full((0, BUFFER), np.nan)

    @property
    def next_id(self) -> int:
        """The next track's id of the only clip."""
        return int(self.next_ids[0])

    def advance(self, class_name, box, distance, time: float, shift=None, clip=None, present=None) -> None:
        """One frame of boxes (n x 4), their classes and distances (NaN where unknown).

        ``shift`` (one line of dx, dy per live track) moves the tracks first, where
        image motion is known; such kernels stay outside.  With several clips,
        ``clip`` has the boxes' clips, ascending, and ``present`` tells of each clip whether it has a frame now.
        """
        import numpy as np

        clip = np.zeros(len(box), np.int64) if clip is None else clip
        live = np.flatnonzero(~self.evicted if present is None else ~self.evicted & present[self.clip])
        if shift is not None:
            self.box[live] += np.tile(shift, 2)
        self.counts["age"][live] += 1
        took = self._choose(live, class_name, box, clip)
        seen, found = live[took >= 0], took[took >= 0]
        self.box[seen] = box[found]
        self.counts["hits"][seen] += 1
        self.counts["misses"][live] = np.where(took >= 0, 0, self.counts["misses"][live] + 1)
        self._remember(seen, distance[found], time)
        self.evicted |= self.counts["misses"] > self.max_misses
        self._add(np.setdiff1d(np.arange(len(box)), found), class_name, box, distance, time, clip)

    def _choose(self, live, class_name, box, clip):
        """The box that each live track takes, or -1."""
        import numpy as np

        took = np.full(len(live), -1)
        first, last = (np.searchsorted(clip, self.clip[live], side) for side in ("left", "right"))
        pairs = []
        for a, b in portions(last - first):
            many = (last - first)[a:b]
            line = np.repeat(np.arange(a, b), many)
            at = first[line] + np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many)
            same = self.class_name[live[line]] == class_name[at]
            line, at = line[same], at[same]
            shared = _shared(self.box[live[line]], box[at])
            pairs.append([v[shared > self.min_overlap] for v in (line, at, shared)])
        if not pairs:
            return took
        line, at, shared = (np.concatenate(v) for v in zip(*pairs, strict=True))
        order = np.lexsort((at, -shared, line))  # a line's best box first, the first of equals
        line, at = line[order], at[order]
        while len(line):
            # the first line of each clip that still has a free box takes its best one
            lead = np.unique(self.clip[live[line]], return_index=True)[1]
            alone = np.bincount(at)[at] == 1
            # so does every line whose best box no other line wants
            lead = np.union1d(lead, np.flatnonzero((np.diff(line, prepend=-1) != 0) & alone))
            took[line[lead]] = at[lead]
            used = np.zeros(len(box), bool)
            used[at[lead]] = True
            left = (took[line] < 0) & ~used[at]
            line, at = line[left], at[left]
        return took

    def _remember(self, lines, distance, time: float) -> None:
        for kept, new in ((self.times, time), (self.distances, distance)):
            kept[lines, :-1] = kept[lines, 1:]
            kept[lines, -1] = new

    def _add(self, which, class_name, box, distance, time: float, clip) -> None:
        import numpy as np

        n, start, clip = len(which), len(self.box), clip[which]
        new = np.bincount(clip, minlength=len(self.next_ids))
        ids = self.next_ids[clip] + np.arange(n) - np.searchsorted(clip, clip)
        self.clip = np.append(self.clip, clip)
        self.box = np.vstack([self.box, box[which]])
        self.class_name, self.evicted = np.append(self.class_name, class_name[which]), np.append(self.evicted, np.zeros(n, bool))
        for name, first in (("track_id", ids), ("age", 0), ("hits", 1), ("misses", 0)):
            self.counts[name] = np.append(self.counts[name], np.broadcast_to(first, n))
        self.times, self.distances = (np.vstack([x, np.full((n, BUFFER), np.nan)]) for x in (self.times, self.distances))
        self._remember(start + np.arange(n), distance[which], time)
        self.next_ids = self.next_ids + new

    def rows(self) -> dict[int, tuple]:
        """Each track's class, box, counts and buffers by its id, as plain values in the order of STATE."""
        plain = zip(self.class_name, self.box.tolist(), *(self.counts[k].tolist() for k in self.NUMBERS), self.times.tolist(), self.distances.tolist(), strict=True)
        return {k: (name, *box, age, hits, misses, times, distances) for name, box, k, age, hits, misses, times, distances in plain}

    def restore(self, next_id: int, rows: dict[int, tuple]) -> Tracks:
        """Live tracks as ``rows`` gave them, in the order of their ids."""
        import numpy as np

        ids = sorted(rows)
        lines = [rows[k] for k in ids]
        self.next_ids, self.evicted, self.clip = np.array([next_id]), np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
        self.class_name = np.array([r[0] for r in lines], object)
        self.box = np.array([r[1:5] for r in lines], float).reshape(len(ids), 4)
        self.counts = {"track_id": np.array(ids, np.int64)} | {k: np.array([r[5 + i] for r in lines], np.int64) for i, k in enumerate(self.NUMBERS[1:])}
        self.times, self.distances = (np.array([r[i] for r in lines], float).reshape(len(ids), BUFFER) for i in (8, 9))
        return self

    def drop_evicted(self) -> None:
        keep = ~self.evicted
        for name in ("box", "class_name", "times", "distances", "evicted", "clip"):
            setattr(self, name, getattr(self, name)[keep])
        self.counts = {k: v[keep] for k, v in self.counts.items()}

    def columns(self) -> dict:
        """Columns of TRACKS; the rate is the least-squares slope of four known distances or more over some time."""
        import numpy as np

        known = ~np.isnan(self.distances)
        n = known.sum(1)
        mean = lambda x: np.where(known, x, 0).sum(1) / np.maximum(n, 1)
        t, z = (np.where(known, x - mean(x)[:, None], 0) for x in (self.times, self.distances))
        with np.errstate(invalid="ignore", divide="ignore"):
            rate = np.where((n >= 4) & (t.max(1, initial=0) - t.min(1, initial=0) >= 1e-6), (t * z).sum(1) / (t * t).sum(1), np.nan)
            newest = BUFFER - 1 - known[:, ::-1].argmax(1)
            last = np.where(n > 0, self.distances[np.arange(len(n)), newest], np.nan)
            ttc = np.where(rate < -1e-3, -last / rate, np.nan)
        none = lambda x: [None if np.isnan(v) else float(v) for v in x]
        edges = {e: self.box[:, i] for i, e in enumerate(("x1", "y1", "x2", "y2"))}
        return {
            "track_id": self.counts["track_id"], "class_name": self.class_name, **edges, "age": self.counts["age"], "hits": self.counts["hits"],
            "misses": self.counts["misses"], "evicted": self.evicted, "range_rate": none(rate), "last_distance": none(last), "ttc": none(ttc),
        }


def _shared(a, b):
    """Intersection over union of boxes in pairs, 0 without a union."""
    import numpy as np

    low, high = np.maximum(a[:, :2], b[:, :2]), np.minimum(a[:, 2:], b[:, 2:])
    both = np.prod(np.maximum(high - low, 0), 1)
    union = np.prod(a[:, 2:] - a[:, :2], 1) + np.prod(b[:, 2:] - b[:, :2], 1) - both
    return np.divide(both, union, out=np.zeros(both.shape), where=union > 0)


def boxed(rows: dict, at):
    """Those of the rows ``at`` that hold a box."""
    import pandas as pd

    return at[~pd.isna(rows["class_name"][at])]


def frame_arrays(rows: dict, at) -> tuple:
    """Classes, boxes and distances of the rows ``at`` that hold a box."""
    import numpy as np
    import pandas as pd

    at = boxed(rows, at)
    box = np.stack([rows[e][at].astype(float) for e in ("x1", "y1", "x2", "y2")], 1)
    return rows["class_name"][at], box, pd.to_numeric(pd.Series(rows["distance_m"][at])).to_numpy(float)


def track(df: DataFrame, clip: str, frame: str, order: str, frames: DataFrame | None = None, dt: float = 1.0, **options) -> DataFrame:
    """All tracks of every clip, the evicted ones too: columns of TRACKS behind the clip's key.

    Rows have class_name, box and distance_m, in ``order`` within a frame.
    ``frames`` (clip, frame) names frames without boxes too, which age tracks;
    otherwise frames with boxes count.  Later choices depend on earlier ones, so
    a clip is one run of sorted rows, and the
    clips of a batch go frame by frame together; clips are bounded and spread over the cluster.
    """
    rows = df.select(clip, frame, order, "class_name", *[F.col(e).cast("double") for e in ("x1", "y1", "x2", "y2")], "distance_m")
    if frames is not None:
        rows = frames.select(clip, frame).distinct().join(rows, [clip, frame], "left")
    key_type = dict(df.dtypes)[clip]

    def run(rows, starts):
        import numpy as np

        at, n = rows[frame], len(rows[frame])
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))  # a row's clip
        fresh = np.append(True, at[1:] != at[:-1])
        fresh[starts] = True
        number = np.cumsum(fresh)
        number -= number[starts][of]  # a row's frame in its clip, from 0
        order = np.lexsort((np.arange(n), of, number))
        tracks = Tracks(**options, clips=len(starts))
        for lines in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
            present = np.zeros(len(starts), bool)
            present[of[lines]] = True
            tracks.advance(*frame_arrays(rows, lines), number[lines[0]] * dt, clip=of[boxed(rows, lines)], present=present)
        by_clip = np.argsort(tracks.clip, kind="stable")
        made = {k: np.array(v, object)[by_clip] if isinstance(v, list) else v[by_clip] for k, v in tracks.columns().items()}
        return {clip: rows[clip][starts][tracks.clip[by_clip]]} | made

    return map_run_batches(rows, [clip], [frame, order], run, f"`{clip}` {key_type}, {TRACKS}")


def confirmed(tracks: DataFrame, min_hits: int = 3) -> DataFrame:
    return tracks.where(~F.col("evicted") & (F.col("hits") >= min_hits) & (F.col("misses") == 0))


def surviving(tracks: DataFrame, min_hits: int = 3) -> DataFrame:
    """Tracks with enough hits that were not evicted, soonest collision first, unknown last."""
    return tracks.where(~F.col("evicted") & (F.col("hits") >= min_hits)).orderBy(F.asc_nulls_last("ttc"), "track_id")


def flow_ok(dx: str, dy: str, back_dx: str, back_dy: str, limit: float = 3.0):
    """Whether flow forward and back returns to within ``limit`` pixels."""
    x, y = F.col(dx) + F.col(back_dx), F.col(dy) + F.col(back_dy)
    return F.sqrt(x * x + y * y) < limit
