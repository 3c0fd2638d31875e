"""The gate over a live stream, with a ring of frames, a bounded queue, interpretation with retries, and a history."""

import json
import pickle
import time
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framegate.config import Gate, Streaming
from framegate.operators.gate import EVENT, INPUT, GateState, Pending, _frame, rows_of

RESULT = f"{EVENT}, status string, attempts int, interpretation string, error string, queue_depth int, goal string"
#: Interprets one event (a dict, with its goal), given the last interpretation; the stream's events come in order, never two at a time.
Interpreter = Callable[[dict, str | None], str]
_NAMES = [c.split()[0] for c in EVENT.split(", ")]
# The counters of a stream.
COUNTERS = (
    "frames_submitted", "detector_events", "events_enqueued", "events_dropped", "retry_requests", "detail_requests", "action_verifications",
    "interpretation_attempts", "interpretations_completed", "interpretations_failed", "max_observed_queue_depth",
)


class Session:
    """One stream. Rows go in by feed(); results come out of drain(). dump() and load() carry it between micro-batches."""

    def __init__(self, gate: Gate, streaming: Streaming, goal: str = ""):
        self.gate, self.streaming, self.goal = gate, streaming, goal
        self.state = GateState()
        self.ring: deque = deque(maxlen=streaming.ring_frames)
        self.queue: deque = deque()
        self.history: OrderedDict[int, tuple] = OrderedDict()
        self.previous: str | None = None
        self.counters = dict.fromkeys(COUNTERS, 0)

    def dump(self) -> bytes:
        kept = {k: v for k, v in vars(self).items() if k not in ("gate", "streaming", "state", "goal")}
        pending = self.state.pending
        return pickle.dumps(({**vars(self.state), "pending": vars(pending) if pending else None}, kept))

    @classmethod
    def load(cls, gate: Gate, streaming: Streaming, data: bytes, goal: str = "") -> "Session":
        session = cls(gate, streaming, goal)
        state, kept = pickle.loads(data)
        pending = state["pending"]
        vars(session.state).update(state | {"pending": Pending(**pending) if pending else None})
        vars(session).update(kept)
        return session

    def stats(self) -> dict[str, int]:
        """The counters, and what is held just now."""
        return {**self.counters, "current_queue_depth": len(self.queue), "retained_frames": len(self.ring), "retained_events": len(self.history)}

    def _count(self, *names: str) -> None:
        for name in names:
            self.counters[name] += 1

    def _detail(self, row: tuple) -> tuple[tuple, str]:
        """A request for detail as a row on the newest frame, and its goal: its own (in action_text) or the stream's."""
        _, _, control, changed, fraction, discovery, box, goal, expected = row
        if not self.ring:
            raise ValueError("no frame has been submitted")
        goal = self.goal if goal is None else goal.strip()
        if not goal and row[7] is not None:
            raise ValueError("goal cannot be empty")
        self._count("detail_requests")
        return (*self.ring[-1], control, changed, fraction, discovery, box, None, expected), goal

    def feed(self, row: tuple) -> list[tuple]:
        """Rows that are settled at once: an event that finds the queue full is a failed result without an attempt, and stays in the history."""
        goal = self.goal
        control = row[2]
        if control == "retry":
            held = self.history.get(row[1])
            self.counters["retry_requests"] += held is not None
            return self._enqueue(*held) if held else []
        if control == "detail":
            row, goal = self._detail(row)
        elif control == "verify":
            self.ring.append(row[:2])
            self._count("action_verifications")
        elif control is None:
            self.ring.append(row[:2])
            self._count("frames_submitted")
        event = self.state.feed(self.gate, *row)
        if event is None:
            return []
        self._count("detector_events")
        self.history[event[0]] = (event, goal)
        while len(self.history) > self.streaming.history_events:
            self.history.popitem(last=False)
        return self._enqueue(event, goal)

    def full(self) -> bool:
        return len(self.queue) >= self.streaming.pending_events

    def _enqueue(self, event: tuple, goal: str) -> list[tuple]:
        if self.full():
            self._count("events_dropped")
            return [(*event, "failed", 0, None, "queue is full", len(self.queue), goal)]
        self.queue.append((event, goal))
        self._count("events_enqueued")
        self.counters["max_observed_queue_depth"] = max(self.counters["max_observed_queue_depth"], len(self.queue))
        return []

    def drain(self, interpret: Interpreter | None, most: int | None = None) -> list[tuple]:
        """Queued events in order, all or `most` of them. A failure is tried again in place, so later events never overtake; it leaves the last interpretation as it is."""
        out = []
        while self.queue and (most is None or len(out) < most):
            event, goal = self.queue.popleft()
            if interpret is None:
                out.append((*event, "event", 0, None, None, len(self.queue), goal))
                continue
            answer = problem = None
            for attempt in range(1, self.streaming.retries + 2):
                self._count("interpretation_attempts")
                try:
                    answer, problem = interpret({**dict(zip(_NAMES, event)), "goal": goal}, self.previous), None
                    self.previous = answer
                    break
                except Exception as e:
                    problem = f"{type(e).__name__}: {e}"
            self._count("interpretations_failed" if problem else "interpretations_completed")
            out.append((*event, "failed" if problem else "completed", attempt, answer, problem, len(self.queue), goal))
        return out


def live_gate(rows: DataFrame, gate: Gate = Gate(), streaming: Streaming = Streaming(), interpret: Interpreter | None = None, goal: str = "", counters: bool = False) -> DataFrame:
    """Results of the gate over a stream; columns media_id and RESULT. rows: as from gate_input(), streaming.

    Per key and micro-batch, rows are taken in order of (timestamp_s, frame_index), controls after frames; across micro-batches in order of
    arrival. Control rows stand for the calls of a live source: 'verify', 'snapshot', 'detail' (newest frame of the ring; the box is what to look at, action_text
    the goal if it is not the stream's), 'retry' (frame_index holds the sequence number; nothing if the history has let it go) and 'end'. The queue is emptied
    whenever it is full, so each event is interpreted, however many rows a micro-batch has. A micro-batch that is run again after a
    failure gives the same rows; interpreters are called at least once per event.

    counters: each key and micro-batch also gives a row of status 'counters', whose interpretation is the stream's counters so far as JSON and whose
    sequence_no is the number of the next event.
    """
    kind = rows.schema["media_id"].dataType.simpleString()
    names = ["media_id", *_NAMES]
    extra = ["status", "attempts", "interpretation", "error", "queue_depth", "goal"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        session = Session.load(gate, streaming, held.get[0], goal) if held.exists else Session(gate, streaming, goal)
        new = pd.concat(list(frames), ignore_index=True).sort_values(["timestamp_s", "frame_index", "control"], na_position="first", kind="stable")
        out = []
        for _, row in rows_of(new):
            if session.full():  # rows wait here as a source waits, so the queue does not overflow by the size of a micro-batch
                out += session.drain(interpret)
            out += session.feed(row)
        out += session.drain(interpret)
        held.update((session.dump(),))
        if counters:
            blank = (session.state.sequence, *[None] * (len(_NAMES) - 1))
            out.append((*blank, "counters", 0, json.dumps(session.stats(), sort_keys=True), None, len(session.queue), goal))
        frame = _frame([(key[0], *r[: len(_NAMES)]) for r in out], names)
        for i, c in enumerate(extra):
            frame[c] = pd.Series([r[len(_NAMES) + i] for r in out], dtype=object)
        frame = frame.astype({"attempts": "int64", "queue_depth": "int64"})
        yield frame

    return rows.select(*INPUT).groupBy("media_id").applyInPandasWithState(step, f"media_id {kind}, {RESULT}", "session binary", "append", GroupStateTimeout.NoTimeout)


class LiveRun:
    """A running live gate: its results batch by batch in a folder, read on by poll()."""

    def __init__(self, results: DataFrame, folder: str):
        """results: as from live_gate(). folder: shared storage for results and the query's log; what is there is continued."""
        self.spark, self.folder = results.sparkSession, folder.rstrip("/")
        self._at = (0, 0)  # batch, and rows of it that were given out
        out = self.folder
        self.query = results.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", f"{out}/_log").start()

    def _done(self) -> int:
        """The first batch that is not finished."""
        last = self.query.lastProgress
        return last["batchId"] + (last["numInputRows"] > 0) if last else 0

    def poll(self, most: int = 1000) -> list:
        """The next results in order of (batch, media_id, sequence_no), `most` at a time."""
        if most < 0:
            raise ValueError("most cannot be negative")
        found: list = []
        batch, given = self._at
        while len(found) < most and batch < self._done():
            rows = self.spark.read.parquet(f"{self.folder}/batch={batch}").orderBy("media_id", "sequence_no", "status")
            new = rows.offset(given).limit(most - len(found)).collect()  # `most` rows at most
            found += new
            given += len(new)
            if not new:
                batch, given = batch + 1, 0
        self._at = (batch, given)
        return found

    def wait_until_idle(self, timeout: float | None = None) -> bool:
        """Whether everything that has arrived was worked off, within `timeout` seconds if given."""
        if timeout is not None and timeout < 0:
            raise ValueError("timeout cannot be negative")
        if timeout is None:
            self.query.processAllAvailable()
            return True
        ends = time.monotonic() + timeout
        quiet = 0
        while quiet < 3:  # between two micro-batches the query looks idle for a moment
            status = self.query.status
            quiet = 0 if status["isDataAvailable"] or status["isTriggerActive"] or not self.query.recentProgress else quiet + 1
            if quiet < 3 and time.monotonic() >= ends:
                return False
            time.sleep(0.05)
        return True

    def close(self, wait: bool = True, timeout: float | None = None) -> bool:
        """Stops the query, after it is idle if asked to wait; whether it ended idle. A second call says whether it has stopped."""
        if not self.query.isActive:
            return True
        idle = self.wait_until_idle(timeout) if wait else False
        self.query.stop()
        return idle and not self.query.isActive

    def __enter__(self) -> "LiveRun":
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
