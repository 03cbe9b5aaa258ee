"""Stateful streaming operators.

Cooldown, best row and consensus keep a small value per open key in map state. Keys are dealt to
lanes, and within a lane to cells. A lane is called once per micro-batch, with the rows of all
its keys (bounded by the source's admission limit), and loads and writes the cells of the
keys that come; its one timer stands at the first time at which a cell falls due. Cells
without rows and without a due key are never read. The target lock and the track links, with
few keys and whole steps, keep one state per key. Key and row id columns must be of types that JSON
keeps: text, whole numbers, doubles or booleans.

State is dropped once the watermark has passed the point where it matters. Rows later than
the watermark are dropped.
"""

from __future__ import annotations

import json
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightline.functions.text import is_known
from sightline.operators import kernels
from sightline.operators.enrolment import lock_parameters, lock_schema
from sightline.params import EnrolParams, TrackParams

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENT_TIME = GroupStateTimeout.EventTimeTimeout
MICROS = 1_000_000


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def _gather(frames, order: list[str]) -> pd.DataFrame:
    parts = list(frames)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    return rows.sort_values(order, kind="stable", ignore_index=True)


def _expire_at(state: GroupState, micros: int) -> None:
    """Set the timer at an event time, or just past the watermark if that is later."""
    state.setTimeoutTimestamp(int(max(micros // 1000 + 1, state.getCurrentWatermarkMs() + 1)))


LANES, CELLS = 64, 16
NEVER = 1 << 62
STORE = "spark.sql.streaming.stateStore.providerClass"
MAP_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lane(StatefulProcessor):
    """Map state of a lane's keys, several keys to a cell: ``rules`` says how a key's rows change its value.

    ``rules.fold(columns, low, high, value)`` gives (value, rows to give out); ``rules.due(value)``
    the event time (microseconds) at which to look again; ``rules.fire(key, value)`` is called
    then and gives (value or None to forget, rows). The agenda holds each cell's next time, and
    the lane's one timer stands at the first of them.
    """

    def __init__(self, rules, order: list[str], names: list[str], columns: list[str], cells: int):
        self.rules, self.order, self.names, self.given, self.cells = rules, order, names, columns, cells

    def init(self, handle) -> None:
        self.handle = handle
        self.values = handle.getMapState("cells", "cell int", "held string")
        self.agenda = handle.getValueState("agenda", "due array<long>, timer long")

    def _due(self, value) -> int:
        """The first whole millisecond after the value's time."""
        return self.rules.due(value) // 1000 + 1

    def _load(self, cell: int) -> dict:
        held = self.values.getValue((cell,))
        return {} if held is None else json.loads(held[0])

    def _store(self, cell: int, held: dict, agenda: list) -> None:
        agenda[cell] = min(map(self._due, held.values()), default=NEVER)
        if held:
            self.values.updateValue((cell,), (json.dumps(held),))
        else:
            self.values.removeKey((cell,))

    def _plan(self, agenda: list, timer: int, watermark: int) -> None:
        first = min(agenda)
        wanted = NEVER if first == NEVER else max(first, watermark + 1)
        if wanted != timer:
            if timer > watermark and timer != NEVER:
                self.handle.deleteTimer(timer)
            if wanted != NEVER:
                self.handle.registerTimer(wanted)
        self.agenda.update((agenda, wanted))

    def _plans(self) -> tuple[list, int]:
        held = self.agenda.get()
        return ([NEVER] * self.cells, NEVER) if held is None else (list(held[0]), held[1])

    def handleInputRows(self, key, rows, timerValues):
        # Rows come under plain names, since Spark loses names that start with an underscore.
        frame = _gather((r.set_axis(["_lane", *self.given], axis=1) for r in rows), ["_cell", "_key", *self.order])
        keys, cells = frame["_key"].to_numpy(dtype=object), frame["_cell"].tolist()
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist()
        columns = self.rules.columns(frame)
        agenda, timer = self._plans()
        at, held, out = None, {}, []
        for low, high in zip(starts, [*starts[1:], len(keys)]):
            if cells[low] != at:
                if at is not None:
                    self._store(at, held, agenda)
                at = cells[low]
                held = self._load(at)
            held[keys[low]], given = self.rules.fold(columns, low, high, held.get(keys[low]))
            out += given
        self._store(at, held, agenda)
        self._plan(agenda, timer, timerValues.getCurrentWatermarkInMs())
        if out:
            yield self.rules.shown(frame, out) if hasattr(self.rules, "shown") else pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark, out = timerValues.getCurrentWatermarkInMs(), []
        agenda, _ = self._plans()
        for cell in [c for c, due in enumerate(agenda) if due <= watermark]:
            held = self._load(cell)
            for name in [k for k, v in held.items() if self._due(v) <= watermark]:
                value, given = self.rules.fire(name, held[name])
                out += given
                # A value that is due again at once waits for the next look.
                if value is None:
                    del held[name]
                else:
                    held[name] = value
            self._store(cell, held, agenda)
        self._plan(agenda, NEVER, watermark)
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def _by_lane(stream: DataFrame, keys: list[str], rules, order: list[str], schema: T.StructType, lanes: int, cells: int) -> DataFrame:
    """Rows with their key as text, dealt to lanes and cells. Map state needs the disk-backed state
    store, which the session is set to. ``lanes`` and ``cells`` must stay the same when a stored
    stream goes on."""
    stream.sparkSession.conf.set(STORE, MAP_STORE)
    place = F.xxhash64("_key")
    keyed = stream.withColumn("_key", F.to_json(F.struct(*keys)))
    keyed = keyed.withColumn("_cell", F.pmod(F.shiftright(place, 32), F.lit(cells)).cast("int"))
    plain = [F.col(c).alias(f"c{k}") for k, c in enumerate(keyed.columns)]
    rows = keyed.select(F.pmod(place, F.lit(lanes)).cast("int").alias("lane"), *plain)
    lane = Lane(rules, order, schema.names, keyed.columns, cells)
    return rows.groupBy("lane").transformWithStateInPandas(lane, schema, "Append", "EventTime")


class _Cooldown:
    def __init__(self, gap: int, names: list[str]):
        self.gap, self.names = gap, names

    def columns(self, frame):
        return frame["_t"].tolist()

    def fold(self, times, low, high, value):
        last = None if value is None else value[0]
        kept = []
        for i in range(low, high):
            if last is None or times[i] - last >= self.gap:
                last = times[i]
                kept.append(i)
        return (last,), kept

    def shown(self, frame, kept):
        return frame.iloc[kept][self.names]

    def due(self, value):
        return value[0] + self.gap

    def fire(self, key, value):
        return None, []


def cooldown(
    stream: DataFrame, keys: list[str], ts: str, seconds: float, row_id: str, strict: bool = False, delay: str = "10 minutes",
    lanes: int = LANES, cells: int = CELLS,
) -> DataFrame:
    """Anchored cooldown over a stream; the state is each key's last kept time, kept
    until the watermark has passed its cooldown."""
    gap = int(round(seconds * MICROS)) + (1 if strict else 0)
    schema = _nullable(stream.schema)
    timed = stream.withWatermark(ts, delay).withColumn("_t", F.unix_micros(ts))
    return _by_lane(timed, keys, _Cooldown(gap, stream.columns), ["_t", row_id], schema, lanes, cells)


class _BestRow:
    def __init__(self, track: list[str], row_id: str, span: int, idle: int, max_rows: int):
        self.track, self.row_id, self.span, self.idle, self.max_rows = track, row_id, span, idle, max_rows

    def columns(self, frame):
        return [frame[c].tolist() for c in ("_t", self.row_id, "_estimate", *self.track)]

    def fold(self, columns, low, high, value):
        times, ids, values, *track = columns
        name = tuple(c[low] for c in track)
        first, seen, best, closed, last, winner = (None, 0, -1.0, False, None, None) if value is None else tuple(value)[:6]
        was_closed = closed
        for t, rid, got in zip(times[low:high], ids[low:high], values[low:high]):
            first, last = (t, t) if first is None else (first, max(last, t))
            if closed:
                continue
            if t - first < self.span:
                seen += 1
                if got > best:
                    best, winner = got, rid
            closed = t - first >= self.span or seen >= self.max_rows
        return (first, seen, best, closed, last, winner, *name), [(*name, winner, best)] if closed and not was_closed else []

    def due(self, value):
        return value[4] + self.idle if value[3] else value[0] + self.span

    def fire(self, key, value):
        first, seen, best, closed, last, winner, *name = value
        if closed:
            return None, []
        return (first, seen, best, True, last, winner, *name), [(*name, winner, best)]


def best_row(
    stream: DataFrame, track: list[str], ts: str, row_id: str, estimate: Column,
    max_rows: int = TrackParams().window_rows, max_seconds: float = TrackParams().window_seconds,
    idle_seconds: float = TrackParams().idle_seconds, delay: str = "1 second", lanes: int = LANES,
    cells: int = CELLS,
) -> DataFrame:
    """Best row of a track's opening window, emitted once when the window closes:
    by row count, by a later row, or by the timer. A track is forgotten when idle."""
    span, idle = int(round(max_seconds * MICROS)), int(round(idle_seconds * MICROS))
    fields = [stream.schema[c] for c in [*track, row_id]]
    schema = _nullable(T.StructType([*fields, T.StructField("estimate", T.DoubleType())]))
    timed = stream.withWatermark(ts, delay).select(
        *track, row_id, ts, F.unix_micros(ts).alias("_t"), estimate.alias("_estimate")
    )
    return _by_lane(timed, track, _BestRow(track, row_id, span, idle, max_rows), ["_t", row_id], schema, lanes, cells)


class _Consensus:
    def __init__(self, track: list[str], entity: str, similarity: str, window: int, idle: int, limit: int):
        self.track, self.entity, self.similarity = track, entity, similarity
        self.window, self.idle, self.limit = window, idle, limit

    def columns(self, frame):
        return [frame[c].tolist() for c in ("_t", "_known", self.entity, self.similarity, *self.track)]

    def fold(self, columns, low, high, value):
        track = tuple(c[low] for c in columns[4:])
        first, last, decided, votes = (None, None, False, []) if value is None else value
        out = []
        for t, known, name, sim in zip(*[c[low:high] for c in columns[:4]]):
            first, last = (t, t) if first is None else (first, max(last, t))
            if decided:
                continue
            if known:
                votes.append((name, sim))
            if t - first >= self.window or len(votes) >= self.limit:
                best = {}
                for n, s in votes:
                    best[n] = max(s, best.get(n, s))
                winner = max(best, key=best.get, default="unknown")
                out.append((*track, winner, best.get(winner, 0.0), sum(1 for n, _ in votes if n == winner)))
                votes, decided = [], True
        return (first, last, decided, votes), out

    def due(self, value):
        return value[1] + self.idle

    def fire(self, key, value):
        return None, []


def consensus(
    stream: DataFrame, track: list[str], ts: str, row_id: str, entity: str = "entity_id",
    similarity: str = "similarity", p: TrackParams = TrackParams(), delay: str = "1 second", lanes: int = LANES,
    cells: int = CELLS,
) -> DataFrame:
    """Track decision over a stream: state is the start, at most ``vote_limit`` votes
    and whether the track is decided. A decided track stays frozen until idle."""
    window, idle = int(round(p.vote_window_seconds * MICROS)), int(round(p.idle_seconds * MICROS))
    fields = [stream.schema[c] for c in track]
    extra = T._parse_datatype_string(f"{entity} string, similarity double, votes long")
    schema = _nullable(T.StructType([*fields, *extra]))
    timed = stream.withWatermark(ts, delay).select(
        *track, row_id, ts, entity, similarity, F.unix_micros(ts).alias("_t"), is_known(F.col(entity)).alias("_known")
    )
    rules = _Consensus(track, entity, similarity, window, idle, p.vote_limit)
    return _by_lane(timed, track, rules, ["_t", row_id], schema, lanes, cells)


def target_lock(
    stream: DataFrame, session: list[str], ts: str, p: EnrolParams = EnrolParams(), idle_seconds: float = 600.0,
    delay: str = "1 minute",
) -> DataFrame:
    """The enrolment lock over a stream. All rows of a step arrive in one batch."""
    schema = _nullable(lock_schema(stream, session))
    settings, idle = lock_parameters(p), int(idle_seconds * MICROS)
    open_gate = {**settings, "min_confidence": 0.0, "min_width": 0.0, "min_height": 0.0}
    names = schema.names

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        lock = kernels.TargetLock(settings)
        if state.exists:
            lock.unpack(json.loads(state.get[0]))
        rows = _gather(frames, ["seq", "track"])
        out = []
        for seq, group in rows.groupby("seq", sort=True):
            command = group["command"].iloc[0]
            gate = settings if command == "frame" else open_gate
            records = group.astype(object).where(group.notna(), None).to_dict("records")
            dets = [d for d in (kernels.usable_detection(r, gate) for r in records) if d is not None]
            captured, reason = kernels.lock_step(lock, command, dets, int(group["_t"].iloc[0]))
            track = None if lock.track is None else int(lock.track)
            out.append((*key, seq, lock.state, track, float(lock.similarity), captured, reason, len(lock.samples), lock.locked))
        state.update((json.dumps(lock.pack()),))
        _expire_at(state, int(rows["_t"].max()) + idle)
        frame = pd.DataFrame(out, columns=names)
        frame["track"] = frame["track"].astype("Int64")
        yield frame

    timed = stream.withWatermark(ts, delay).withColumn("_t", F.unix_micros(ts)).withColumn(
        "embedding", F.col("embedding").cast("array<double>")
    )
    return timed.groupBy(*session).applyInPandasWithState(step, schema, "lock string", "append", EVENT_TIME)


def track_frames(
    stream: DataFrame, source: str, frame: str, row_id: str, ts: str, p: TrackParams = TrackParams(),
    idle_seconds: float = 600.0, delay: str = "1 minute",
) -> DataFrame:
    """Track ids over a stream of detections, equal to the batch stitching.

    State per source: the tracked boxes of its last frame and the track each belongs to.
    All detections of a frame arrive in one batch.
    """
    corners = ["x1", "y1", "x2", "y2"]
    schema = _nullable(
        T.StructType([stream.schema[row_id], T.StructField("track_id", T.StringType())])
    )
    low, limits = p.low_score, (p.high_score, p.high_iou, p.low_iou, p.new_score)
    idle = int(idle_seconds * MICROS)

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        linker = kernels.FrameLinker(*limits)
        if state.exists:
            last, ids, boxes, heads = json.loads(state.get[0])
            linker.restart(last, ids, np.array(boxes, dtype=float).reshape(-1, 4), heads)
        rows = _gather(frames, [frame, row_id])
        rows = rows[rows["score"] >= low]
        out = []
        numbers, ids = rows[frame].to_numpy(), rows[row_id].tolist()
        scores, boxes = rows["score"].to_numpy(), rows[corners].to_numpy(dtype=float)
        starts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])).tolist() if len(rows) else []
        for at, end in zip(starts, [*starts[1:], len(ids)]):
            *_, heads = linker.step(int(numbers[at]), ids[at:end], scores[at:end], boxes[at:end])
            out += [(rid, f"{key[0]}:{head}") for rid, head in zip(ids[at:end], heads) if head is not None]
        state.update((json.dumps([linker.frame, linker.ids, linker.boxes.tolist(), linker.heads]),))
        _expire_at(state, int(rows["_t"].max() if len(rows) else 0) + idle)
        if out:
            yield pd.DataFrame(out, columns=[row_id, "track_id"])

    timed = stream.withWatermark(ts, delay).select(
        source, frame, row_id, "score", *corners, ts, F.unix_micros(ts).alias("_t")
    )
    return timed.groupBy(source).applyInPandasWithState(step, schema, "frame string", "append", EVENT_TIME)
