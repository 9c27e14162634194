"""Operator instances that move between jobs as control rows say, in steps that are recorded.

An operator reads the parallel channels of its input; its instance ``i`` is channel ``i``. The
input opens a new epoch with every version of the control table, so a version says which job reads
a channel's rows of its epoch, or none while the instance is paused. A job runs all its instances
in one query. When its instances change, the query ends at the epoch's border and another
*stretch* of it begins from the state its channels have, whoever they were with.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from sluiceway.operators.control import topology_view
from sluiceway.session import exists
from sluiceway.streaming.runs import RUNNING, drain
from sluiceway.streaming.tables import put_batch

HAND, DRAIN = "hand", "drain"


@dataclass
class Stretch:
    """A job's query from one change of its instances to the next.

    ``unread`` has the first epoch to read for every channel, ``sources`` the stretch that has the
    channel's state.
    """

    job: str
    version: int
    unread: dict[int, int]
    sources: dict[int, "Stretch"] = field(default_factory=dict)
    last: int | None = None

    @property
    def name(self) -> str:
        return f"{self.job}-{self.version}"


@dataclass
class Step:
    kind: str
    stretch: Stretch

    def __str__(self) -> str:
        return f"{self.kind} {self.stretch.name} {sorted(self.stretch.unread)}"


@dataclass
class Movable:
    """What can move: ``build(rows, path, checkpoint, state)`` and ``state(path, start)``.

    The state that a query leaves below ``path``, with the part of ``start`` it didn't touch, has
    a column ``channel``; it is nothing if there never was a row.
    """

    build: Callable[[DataFrame, str, str, DataFrame | None], DataStreamWriter]
    state: Callable[[str, DataFrame | None], DataFrame | None]


def owners(log: DataFrame, operator: str, seq: int) -> dict[int, str]:
    """The job that runs each instance after control row ``seq``; paused ones are left out.

    Tables of control rows are named ``<job>-task-<operator>``. There is one row per instance.
    """
    view = topology_view(log.where(F.col("seq") <= seq))
    mine = view.where(F.col("operator").endswith(f"-task-{operator}") & (F.col("status") == RUNNING))
    found: dict[int, str] = {}
    for row in mine.select("operator", "instance").collect():
        if int(row.instance) in found:
            raise ValueError(f"instance {row.instance} of {operator} runs in two jobs")
        found[int(row.instance)] = row.operator.removesuffix(f"-task-{operator}")
    return found


def steps_of(versions: list[dict[int, str]]) -> tuple[list[Step], list[Stretch]]:
    """What has to be done for the versions of a control table, in order, and what runs then.

    A stretch ends (``drain``) before another takes its channels' state over (``hand``). Steps of later versions come after those of earlier ones, so a longer history only adds steps.
    Jobs whose instances stay the same are not interrupted.
    """
    steps: list[Step] = []
    running: dict[str, Stretch] = {}
    unread: dict[int, int] = {}
    latest: dict[int, Stretch] = {}
    for version, placed in enumerate(versions):
        wanted = {job: {c for c, j in placed.items() if j == job} for job in sorted(set(placed.values()))}
        for job in [j for j, s in running.items() if set(s.unread) != wanted.get(j)]:
            ended = running.pop(job)
            ended.last = version - 1
            unread |= dict.fromkeys(ended.unread, version)
            steps.append(Step(DRAIN, ended))
        for job in [j for j in wanted if j not in running]:
            mine = sorted(wanted[job])
            # An instance that has not run before has not read any epoch.
            begun = Stretch(job, version, {c: unread.get(c, 0) for c in mine}, {c: latest[c] for c in mine if c in latest})
            if begun.sources:
                steps.append(Step(HAND, begun))
            latest |= dict.fromkeys(mine, begun)
            running[job] = begun
    return steps, list(running.values())


def execute(spark: SparkSession, path: str, steps: list[Step], act: Callable[[Step], None]) -> None:
    """Do the steps that are not recorded below ``path`` yet, each at least once, in order.

    A step that was cut short is done again, so ``act`` has to come to the same when repeated.
    """
    for number, step in enumerate(steps):
        known = _recorded(spark, path, number)
        if known is None:
            act(step)
            put_batch(spark.createDataFrame([(str(step),)], "step string"), path, number)
        elif known != str(step):
            raise ValueError(f"step {number} was {known}, not {step}")


def _recorded(spark: SparkSession, path: str, number: int) -> str | None:
    if not exists(spark, f"{path}/batch={number}/_SUCCESS"):
        return None
    return spark.read.schema("step string").parquet(f"{path}/batch={number}").first().step


class Mover:
    """Carries out steps for one operator; everything it needs to go on lies below ``path``."""

    def __init__(self, spark: SparkSession, channel: str, schema: str, movable: Movable, path: str):
        self.spark, self.channel, self.movable, self.path = spark, channel, movable, path
        self.schema = f"{schema}, channel int, epoch int"
        self.newest = -1

    def follow(self, versions: list[dict[int, str]], act: Callable[[Step], None] | None = None) -> list[Stretch]:
        """Bring the jobs from wherever they are to the newest version; gives what runs then.

        What runs takes all rows up to the newest version's epoch. Rows of later epochs may be
        there already: they wait until their version is followed.
        """
        steps, running = steps_of(versions)
        self.newest = len(versions) - 1
        execute(self.spark, f"{self.path}/steps", steps, act or self.act)
        for stretch in running:
            self.run(stretch)
        return running

    def folder(self, stretch: Stretch) -> str:
        return f"{self.path}/{stretch.name}"

    def act(self, step: Step) -> None:
        self.run(step.stretch) if step.kind == DRAIN else self._hand(step.stretch)

    def run(self, stretch: Stretch) -> None:
        """A stretch's checkpoint knows what it has read: run again, it takes what is left."""
        folder = self.folder(stretch)
        drain(self.movable.build(self._input(stretch), folder, f"{folder}/checkpoint", self._start(stretch)))

    def _hand(self, stretch: Stretch) -> None:
        """Write the state of the stretch's channels, from the stretches that had them."""
        by_source: dict[str, tuple[Stretch, list[int]]] = {}
        for c, source in stretch.sources.items():
            by_source.setdefault(source.name, (source, []))[1].append(c)
        parts = []
        for source, channels in by_source.values():
            left = self.movable.state(self.folder(source), self._start(source))
            if left is not None:
                parts.append(left.where(F.col("channel").isin(channels)))
        if parts:
            reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(self._handed(stretch))

    def _handed(self, stretch: Stretch) -> str:
        return f"{self.folder(stretch)}/start"

    def _start(self, stretch: Stretch) -> DataFrame | None:
        here = stretch.sources and exists(self.spark, f"{self._handed(stretch)}/_SUCCESS")
        return self.spark.read.parquet(self._handed(stretch)) if here else None

    def _input(self, stretch: Stretch) -> DataFrame:
        """The stretch's channels and epochs; others are not listed, so none of their files counts as read."""
        first, last = min(stretch.unread.values()), self.newest if stretch.last is None else stretch.last
        channels, epochs = (",".join(map(str, x)) for x in (sorted(stretch.unread), range(first, last + 1)))
        rows = self.spark.readStream.schema(self.schema).option("basePath", self.channel)
        rows = rows.parquet(f"{self.channel}/channel={{{channels}}}/epoch={{{epochs}}}")
        by_first: dict[int, list[int]] = {}
        for c, epoch in stretch.unread.items():
            by_first.setdefault(epoch, []).append(c)
        taken = [F.col("channel").isin(cs) & (F.col("epoch") >= epoch) for epoch, cs in by_first.items()]
        return rows.where(reduce(lambda a, b: a | b, taken))
