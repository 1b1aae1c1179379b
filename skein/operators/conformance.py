"""Conformance of event logs with a process model: token replay case by case, precision by escaping edges."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most flows of one process; a model is read to the driver and sent to tasks, so it must be a definition, not data.
MAX_FLOWS = 10_000

Place = tuple[str, ...]


@dataclass(frozen=True)
class Transition:
    """What one way of doing an activity takes from places and puts into others."""

    inputs: tuple[Place, ...]
    outputs: tuple[Place, ...]


@dataclass
class Net:
    """A Petri net: transitions by activity, ends that consume the last tokens, tokens at the start."""

    transitions: dict[str, list[Transition]]
    ends: list[Transition]
    start: tuple[Place, ...] = (("start",),)


def net_of(flows: Iterable[tuple[str, str]], parallel: Iterable[str] = (), joins: Iterable[str] = ()) -> Net:
    """The net of flows (before, after).

    After an activity one of its successors follows, or all of them if it is in `parallel`: one token they compete for, or one
    each. An activity needs one predecessor's token, or all of them if it is in `joins`. Activities without a predecessor may
    start a case and those without a successor may end it; in a cycle without either, the smallest name starts and any ends.
    """
    pairs = sorted(set(flows))
    names = sorted({a for p in pairs for a in p})
    parallel, joins = set(parallel), set(joins)
    after = {a: [y for x, y in pairs if x == a] for a in names}
    place = {p: p if p[0] in parallel else (p[0],) for p in pairs}
    first = [a for a in names if all(y != a for _, y in pairs)] or names[:1]
    last = [a for a in names if not after[a]] or names
    net = Net({}, [Transition(((a,),), ()) for a in last])
    for a in names:
        ways: list[tuple[Place, ...]] = [(("start",),)] if a in first else []
        into = sorted({place[p] for p in pairs if p[1] == a})
        ways += [tuple(into)] if a in joins and into else [(p,) for p in into]
        out = {place[(a, y)] for y in after[a]} | ({(a,)} if a in last else set())
        net.transitions[a] = [Transition(w, tuple(sorted(out))) for w in ways]
    return net


@dataclass
class Replay:
    """One case on a net: tokens counted as its activities are done one after the other."""

    net: Net
    marking: Counter = field(default_factory=Counter)
    produced: int = 0
    consumed: int = 0
    missing: int = 0
    events: int = 0
    unknown: int = 0
    #: Identifies the activities so far.
    prefix: bytes = b""

    def __post_init__(self) -> None:
        self._put(self.net.start)

    def _put(self, places: tuple[Place, ...]) -> None:
        self.marking.update(places)
        self.produced += len(places)

    def _take(self, ways: list[Transition]) -> Transition:
        """Of the ways the one that lacks the fewest tokens, the first of several; what it lacks is counted as missing."""
        way = min(ways, key=lambda w: sum(not self.marking[p] for p in w.inputs))
        for p in way.inputs:
            if self.marking[p]:
                self.marking[p] -= 1
            else:
                self.missing += 1
        self.consumed += len(way.inputs)
        return way

    @property
    def fits(self) -> bool:
        return not self.missing and not self.unknown

    def enabled(self) -> set[str]:
        """Activities that have all their tokens."""
        return {a for a, ways in self.net.transitions.items() if any(all(self.marking[p] for p in w.inputs) for w in ways)}

    def do(self, activity: str | None) -> None:
        self.events += 1
        self.prefix = hashlib.blake2b(self.prefix + (activity or "").encode(), digest_size=16).digest()
        if activity not in self.net.transitions:
            self.unknown += 1
            return
        self._put(self._take(self.net.transitions[activity]).outputs)

    def end(self) -> int:
        """Ends the case: the tokens that remain."""
        self._take(self.net.ends)
        return sum(self.marking.values())


def model(flows: DataFrame) -> list[tuple[str, str]]:
    """(before, after) of one process's FLOW_TO edges (src, dst: `act:` and the activity); at most MAX_FLOWS."""
    act = lambda c: F.regexp_replace(c, "^act:", "")
    rows = flows.where("edge_type = 'FLOW_TO' and src is not null and dst is not null").select(act("src"), act("dst")).distinct().limit(MAX_FLOWS + 1).collect()
    if len(rows) > MAX_FLOWS:
        raise ValueError(f"a process of more than {MAX_FLOWS} flows is no definition")
    return [tuple(r) for r in rows]


def _cases(log: DataFrame) -> DataFrame:
    """Events by case and in order: cases are dealt over tasks, each task streams its own."""
    rows = log.where("case_id is not null").select(F.col("case_id").cast("string").alias("case_id"), "activity", "started_at", "event_id")
    return rows.repartition("case_id").sortWithinPartitions("case_id", "started_at", "event_id").select("case_id", "activity")


def _events(batches: Iterator[pa.RecordBatch], net: Net) -> Iterator[tuple[str, Replay, str | None, bool]]:
    """(case, its replay so far, next activity, False) for each event, then (case, replay, None, True) at its end."""
    case, run = None, Replay(net)
    for batch in batches:
        for c, activity in zip(batch.column("case_id").to_pylist(), batch.column("activity").to_pylist(), strict=True):
            if c != case:
                if case is not None:
                    yield case, run, None, True
                case, run = c, Replay(net)
            yield case, run, activity, False
            run.do(activity)
    if case is not None:
        yield case, run, None, True


_CASE = "case_id string, events long, unknown long, produced long, consumed long, missing long, remaining long"
_STEP = "prefix binary, activity string, fits boolean, n_enabled long"
_ROWS = 4096


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def replayed(log: DataFrame, net: Net) -> DataFrame:
    """Each case of log (case_id, activity, started_at, event_id) replayed on the net in order of started_at, event_id.

    Where an activity lacks tokens they count as missing and it is done all the same; activities outside the net count as
    unknown and move no token. Returns case_id, events, unknown, produced, consumed, missing, remaining and fitness, half of
    1 - missing / consumed and half of 1 - remaining / produced. Events without a case are left out. A case is one task's
    work, as its tokens depend on all before; the task holds one marking, not the case.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # end() takes the last tokens and so comes before the counts are read
        done = ((c, r.events, r.unknown, r.end(), r) for c, r, _, over in _events(batches, net) if over)
        made = ((c, n, u, r.produced, r.consumed, r.missing, left) for c, n, u, left, r in done)
        yield from _batches(made, [x.split()[0] for x in _CASE.split(", ")], [pa.string(), *[pa.int64()] * 6])

    return _cases(log).mapInArrow(rows, _CASE).withColumn("fitness", _fitness(F.col("missing"), F.col("consumed"), F.col("remaining"), F.col("produced")))


def _fitness(missing, consumed, remaining, produced):
    return F.round((1 - missing / consumed) / 2 + (1 - remaining / produced) / 2, 6)


def steps(log: DataFrame, net: Net) -> DataFrame:
    """Each event that stands behind a prefix which fits: prefix, activity, whether the net allows it there (fits), n_enabled."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = ((r.prefix, a, enabled) for _, r, a, over in _events(batches, net) if not over and r.fits for enabled in [r.enabled()])
        yield from _batches(((p, a, a in e, len(e)) for p, a, e in seen), [x.split()[0] for x in _STEP.split(", ")], [pa.binary(), pa.string(), pa.bool_(), pa.int64()])

    return _cases(log).mapInArrow(rows, _STEP)


def precision(log: DataFrame, net: Net) -> DataFrame:
    """One row, precision: of what the net allows behind the log's fitting prefixes, the share that the log does there.

    A prefix weighs as often as it occurs; 1 where the net never allows anything. Steps are counted by prefix and activity in
    tasks first, so the empty prefix, which every case has, is one row a task.
    """
    per = steps(log, net).groupBy("prefix", "n_enabled", "activity", "fits").agg(F.count("*").alias("n"))
    states = per.groupBy("prefix", "n_enabled").agg(F.sum("n").alias("w"), F.count_if("fits").alias("used"))
    share = F.try_divide(F.sum(F.col("w") * F.col("used")), F.sum(F.col("w") * F.col("n_enabled")))
    return states.agg(F.round(F.coalesce(share, F.lit(1.0)), 6).alias("precision"))


def generalization(log: DataFrame, net: Net) -> DataFrame:
    """One row, generalization: 1 less the mean over the net's activities of 1 / sqrt(times done), 1 for those never done."""
    known = log.sparkSession.createDataFrame([(a,) for a in sorted(net.transitions)], "activity string")
    done = log.where("case_id is not null").groupBy("activity").agg(F.count("*").alias("n"))
    each = F.broadcast(known).join(done, "activity", "left").select((1 / F.sqrt(F.coalesce("n", F.lit(1)))).alias("x"))
    return each.agg(F.round(F.coalesce(1 - F.avg("x"), F.lit(1.0)), 6).alias("generalization"))


def deviations(log: DataFrame, net: Net) -> DataFrame:
    """(activity, events): what is done outside the net."""
    known = log.sparkSession.createDataFrame([(a,) for a in sorted(net.transitions)], "activity string")
    return log.where("case_id is not null").groupBy("activity").agg(F.count("*").alias("events")).join(F.broadcast(known), "activity", "left_anti")


def conformance(log: DataFrame, net: Net) -> DataFrame:
    """One row for the whole log: cases, fitting cases, fitness over all tokens, precision, generalization, deviations (activities)."""
    total = replayed(log, net).agg(
        F.count("*").alias("cases"), F.count_if(F.expr("missing = 0 and remaining = 0 and unknown = 0")).alias("fitting"),
        F.coalesce(_fitness(F.sum("missing"), F.sum("consumed"), F.sum("remaining"), F.sum("produced")), F.lit(1.0)).alias("fitness"),
    )
    out = total.crossJoin(precision(log, net)).crossJoin(generalization(log, net))  # one row each
    return out.crossJoin(deviations(log, net).agg(F.count("*").alias("deviations")))
