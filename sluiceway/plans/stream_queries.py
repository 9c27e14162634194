"""Registered streaming queries.

Each one runs a real streaming query over the given tables to the end of the present input and
gives back what it wrote. Where state has to survive, the input arrives in two parts and the
query runs, stops and goes on between them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.functions.time import epoch_ms
from sluiceway.operators.channels import hash_channel
from sluiceway.operators.control import topology_view
from sluiceway.operators.counting import running_count
from sluiceway.operators.rows import debug_tap, tokenize, union_tagged
from sluiceway.operators.routing import route_by_table
from sluiceway.plans import batch_queries as batch
from sluiceway.plans.registry import query
from sluiceway.plans.tables import (
    HOUR_MS,
    WORDS_SQL,
    control_log,
    earlier_half,
    events,
    halfway,
    market,
    table,
)
from sluiceway.session import shared_dir, written_removed
from sluiceway.sources.channel import channel_read, channel_stream
from sluiceway.streaming import channels, corrections, counting, handover, metrics, moves, pauses, shared_count, sinks, state, user_state, windows
from sluiceway.streaming.channel_log import LogReader, channel_log_write
from sluiceway.streaming.control import changelog_state, changelog_stream
from sluiceway.streaming.routing import route_live_stream
from sluiceway.streaming.runs import PAUSED, RUNNING, Switchable, drain, with_batches, writer
from sluiceway.streaming.tables import ChangedRows, all_batches, latest_rows, put_batch, put_batches


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def in_two_parts(
    spark: SparkSession, df: DataFrame, first, step: Callable[[DataFrame], None]
) -> None:
    """Let the rows arrive in two parts and run ``step`` on the growing stream after each."""
    folder = shared_dir(spark, "arrivals")
    stream = spark.readStream.schema(df.schema)
    df.where(first).write.mode("append").parquet(folder)
    step(stream.parquet(folder))
    df.where(~first).write.mode("append").parquet(folder)
    step(stream.parquet(folder))


def in_any_order(spark: SparkSession, df: DataFrame, step: Callable[[DataFrame], None], parts: int = 5) -> None:
    """The same with ``parts`` parts to which rows are dealt by a hash, so early rows come late."""
    folder = shared_dir(spark, "arrivals")
    stream = spark.readStream.schema(df.schema)
    for part in range(parts):
        mine = F.pmod(F.xxhash64("event_id"), F.lit(parts)) == part
        df.where(mine).write.mode("append").parquet(folder)
        step(stream.parquet(folder))


def _half_of(spark, sf, name: str, column: str):
    top = table(spark, sf, name).agg(F.expr(f"(max({column}) + 1) div 2").alias("half"))
    return F.col(column) < top.scalar()


def _docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


@query(
    "stream_word_count",
    f"WITH {WORDS_SQL} SELECT word, count(*) AS cnt FROM words GROUP BY word",
)
def _(spark, sf):
    root = shared_dir(spark, "stream-word-count")

    def step(stream: DataFrame) -> None:
        words = tokenize(stream, "text")
        drain(counting.word_count_stream(words, f"{root}/out", f"{root}/checkpoint"))

    in_two_parts(spark, _docs(spark, sf), _half_of(spark, sf, "documents", "doc_id"), step)
    return latest_rows(spark, f"{root}/out", "word string, cnt long", ["word"])


@query("stream_running_count", batch.RUNNING_COUNT_SQL)
def _(spark, sf):
    root = shared_dir(spark, "stream-running-count")

    def step(stream: DataFrame) -> None:
        words = tokenize(stream, "text")
        order = ["doc_id", "pos"]
        drain(counting.running_count_stream(words, order, root, f"{root}/checkpoint"))

    in_two_parts(spark, _docs(spark, sf), _half_of(spark, sf, "documents", "doc_id"), step)
    out = all_batches(spark, f"{root}/out", "word string, doc_id long, pos long, cnt long")
    return out.select("word", "doc_id", "pos", "cnt")


_JOIN_COLUMNS = ({"event_id": "person_event"}, {"event_id": "auction_event", "value": "value"})


@query("stream_window_join", batch.WINDOW_JOIN_SQL)
def _(spark, sf):
    """Rows arrive in no order; a pair comes out when the later of its rows is there."""
    root = shared_dir(spark, "stream-window-join")
    ev = events(spark, sf).where("event_type in ('signup', 'purchase')")
    ev = ev.select("event_id", "user_id", "ms", "value", F.col("event_type").alias("kind"))

    def step(stream: DataFrame) -> None:
        drain(
            corrections.window_join_delta_stream(
                stream, ("signup", "purchase"), "user_id", "ms", HOUR_MS, _JOIN_COLUMNS, root,
                f"{root}/checkpoint", buckets=16,
            )
        )

    in_any_order(spark, ev, step)
    out = all_batches(spark, f"{root}/out", "user_id long, window_ms long, person_event long, auction_event long, value double")
    return out.select("user_id", "window_ms", "person_event", "auction_event", "value")


@query(
    "stream_tumbling_counts",
    f"""SELECT epoch_ms(ts) - epoch_ms(ts) % {HOUR_MS} AS window_ms, count(*) AS cnt
      FROM events GROUP BY 1""",
)
def _(spark, sf):
    """The changelog of the counts, which late rows correct, folded at the end."""
    root = shared_dir(spark, "stream-tumbling")

    def step(stream: DataFrame) -> None:
        drain(corrections.tumbling_counts_delta_stream(stream, "ms", HOUR_MS, root, f"{root}/checkpoint", buckets=16))

    in_any_order(spark, events(spark, sf).select("event_id", "ms"), step)
    return corrections.folded(spark, f"{root}/out", "window_ms long, cnt long")


@query("stream_anchored_window", batch.ANCHORED_SQL)
def _(spark, sf):
    root = shared_dir(spark, "stream-anchored")
    ev = events(spark, sf).select(
        "event_id", (F.col("user_id") % 2).cast("int").alias("ch"), "ms"
    )

    def step(stream: DataFrame) -> None:
        drain(
            windows.anchored_window_stream(
                stream, "ch", "ms", "event_id", HOUR_MS, root, f"{root}/checkpoint"
            )
        )

    in_two_parts(spark, ev, earlier_half(spark, sf), step)
    out = all_batches(
        spark, f"{root}/out", "event_id long, ch int, ms long, win long, is_closer boolean"
    )
    return out.select("event_id", "ch", "win", "is_closer")


_MARKET = "event_id long, user_id long, ms long, person_event long, kind string, auction_event long, value double, ch int"
_JOINED = "ch int, win long, user_id long, person_event long, auction_event long, value double"


def _market_join(root: str) -> Callable:
    def build(rows: DataFrame, checkpoint: str, start=None):
        rows = rows.select("event_id", "user_id", "ms", "kind", "value", "ch")
        return windows.window_join_anchored_stream(
            rows, ("person", "auction"), "ch", "user_id", "ms", "event_id", HOUR_MS,
            _JOIN_COLUMNS, root, checkpoint, start,
        )

    return build


@query("stream_window_join_anchored", batch.ANCHORED_JOIN_SQL)
def _(spark, sf):
    root = shared_dir(spark, "stream-anchored-join")
    build = _market_join(root)
    in_two_parts(
        spark,
        market(spark, sf),
        earlier_half(spark, sf),
        lambda stream: drain(build(stream, f"{root}/checkpoint")),
    )
    return all_batches(spark, f"{root}/out", _JOINED).select(
        "ch", "win", "user_id", "person_event", "auction_event", "value"
    )


@query("stream_changelog_view", batch.CHANGELOG_SQL)
def _(spark, sf):
    root = shared_dir(spark, "stream-changelog")

    def step(stream: DataFrame) -> None:
        drain(changelog_stream(stream, ["key"], f"{root}/view", f"{root}/checkpoint"))

    in_two_parts(spark, control_log(spark, sf), F.col("seq") < halfway(spark, sf), step)
    return changelog_state(spark, {"key": "long"}, f"{root}/view")


@query(
    "stream_route_by_table",
    """SELECT event_id, (user_id % 2)::INTEGER AS ch, (user_id % 2 = 1)::INTEGER AS channel_type
    FROM events""",
)
def _(spark, sf):
    root = shared_dir(spark, "stream-route")
    ev = table_stream(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 2).cast("int").alias("ch")
    )
    listed = table(spark, sf, "events").where("user_id % 2 = 1").select(F.lit(1).alias("channel"))
    routed = route_by_table(ev, listed.distinct(), 2)
    drain(writer(routed, f"{root}/checkpoint").format("parquet").option("path", f"{root}/out"))
    return spark.read.schema(routed.schema).parquet(f"{root}/out")


@query("stream_live_route_by_table", batch.LIVE_ROUTE_SQL)
def _(spark, sf):
    """The same while rows and control rows arrive, the table being carried between micro-batches."""
    root = shared_dir(spark, "stream-live-route")
    log = batch.live_log(spark, sf)
    step = lambda stream: drain(route_live_stream(stream, root, f"{root}/checkpoint"))
    in_two_parts(spark, log, F.col("seq") < halfway(spark, sf), step)
    out = all_batches(spark, f"{root}/out", "seq long, ch int, channel_type int, switched boolean, path int")
    return out.drop("batch").withColumnRenamed("seq", "event_id")


@query("stream_lines_source", "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def _(spark, sf):
    """The lines of all texts as a stream, until it is paused."""
    root = shared_dir(spark, "stream-lines")
    docs = table_stream(spark, sf, "documents")
    out = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    build = lambda: writer(out, f"{root}/checkpoint").format("parquet").option("path", f"{root}/out")
    Switchable(build).pause()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query(
    "stream_market_sources",
    f"""WITH {batch.PERSONS_SQL}, {batch.AUCTIONS_SQL}
    SELECT 'person' AS kind, id, id AS key, name, NULL::BIGINT AS reserve, ms FROM persons
    UNION ALL SELECT 'auction', id, seller, NULL, reserve, ms FROM auctions""",
)
def _(spark, sf):
    """Streams of persons (sign-ups with the customer's name) and auctions, merged."""
    root = shared_dir(spark, "stream-market")
    ev = table_stream(spark, sf, "events")
    ev = ev.withColumn("ms", epoch_ms(ev, "ts"))
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"))
    people = ev.where("event_type = 'signup'").join(customers, F.col("user_id") == F.col("c_custkey"))
    sold = ev.where("event_type = 'purchase'")
    both = union_tagged(
        {
            "person": people.select(F.col("user_id").alias("id"), F.col("user_id").alias("key"), "name", "ms"),
            "auction": sold.select(
                F.col("event_id").alias("id"), F.col("user_id").alias("key"),
                F.floor(F.col("value") * 100).cast("long").alias("reserve"), "ms",
            ),
        }
    )
    out = both.select("kind", "id", "key", "name", "reserve", "ms")
    build = lambda: writer(out, f"{root}/checkpoint").format("parquet").option("path", f"{root}/out")
    Switchable(build).pause()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


_EVENT = "event_id long, user_id long, event_type string, ch int"


def _park_events(spark, sf, root: str) -> None:
    """Two epochs of all events in two channels, written by one streaming query per epoch."""
    ev = table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", (F.col("user_id") % 2).cast("int").alias("ch")
    )
    first = F.col("event_id") < halfway(spark, sf)
    channels.append_to_channels(ev.where(first), f"{root}/channel", epoch=0)
    channels.append_to_channels(ev.where(~first), f"{root}/channel", epoch=1)


@query(
    "channel_buffer",
    "SELECT event_id, user_id, event_type, (user_id % 2)::INTEGER AS channel, 'in' AS stream FROM events",
)
def _(spark, sf):
    """Rows go through durable channels and come back whole."""
    root = shared_dir(spark, "channel-buffer")
    ev = table_stream(spark, sf, "events").select("event_id", "user_id", "event_type")
    ev = ev.withColumn("ch", (F.col("user_id") % 2).cast("int"))
    drain(channels.channel_write(ev, f"{root}/channel", f"{root}/write"))
    schema = f"{_EVENT}, channel int, epoch int"
    for c in (0, 1):
        back = channel_stream(spark, {"in": f"{root}/channel"}, schema, [c])
        out = writer(back, f"{root}/read-{c}").format("parquet").option("path", f"{root}/out-{c}")
        drain(out)
    full = f"{schema}, stream string"
    got = [spark.read.schema(full).parquet(f"{root}/out-{c}") for c in (0, 1)]
    out = got[0].unionByName(got[1])
    return out.select("event_id", "user_id", "event_type", "channel", "stream")


@query("channel_read", "SELECT event_id, 'in' AS stream FROM events WHERE user_id % 2 = 1")
def _(spark, sf):
    """One channel of a durable stream; the others are pruned."""
    root = shared_dir(spark, "channel-read")
    _park_events(spark, sf, root)
    return channel_read(spark, {"in": f"{root}/channel"}, [1]).select("event_id", "stream")


@query(
    "channel_log",
    """SELECT event_id, (user_id % 2)::INTEGER AS ch, event_type,
      row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id) - 1 AS position,
      row_number() OVER (PARTITION BY user_id % 2, event_type ORDER BY event_id) AS cnt FROM events""",
)
def _(spark, sf):
    """Events parked in an ordered log and counted on their way out, in micro-batches of a few blocks."""
    root = shared_dir(spark, "channel-log")
    ev = table(spark, sf, "events").select("event_id", "event_type", (F.col("user_id") % 2).cast("int").alias("ch"))

    def step(stream: DataFrame) -> None:
        drain(channel_log_write(stream, f"{root}/log", f"{root}/checkpoint", ["event_id"], block_rows=2_000))

    in_two_parts(spark, ev, F.col("event_id") < halfway(spark, sf), step)
    kept = ChangedRows(f"{root}/counts", ["word"], "word string, cnt long")

    def count(rows: DataFrame, numbers: range) -> None:
        with written_removed(spark):
            words = rows.withColumn("word", F.concat_ws("-", "ch", "event_type"))
            counted = running_count(words, ["number", "position"], start=kept.at(spark, numbers[0] - 1))
            put_batches(counted, f"{root}/out", "number")
            out = all_batches(spark, f"{root}/out", "word string, cnt long, batch int").where(F.col("batch") >= numbers[0])
            kept.put(out.groupBy("word").agg(F.max("cnt").alias("cnt")), numbers[-1])

    schema = "event_id long, event_type string, ch int"
    LogReader(spark, f"{root}/log", schema, f"{root}/progress", budget=4_000).drain(count, together=True)
    out = all_batches(spark, f"{root}/out", f"{schema}, position long, cnt long")
    return out.select("event_id", "ch", "event_type", "position", "cnt")


_TYPE_COUNTS_SQL = """
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS cnt FROM events
"""


@query("pause_resume", _TYPE_COUNTS_SQL)
def _(spark, sf):
    """Paused by a control row while rows keep arriving, then resumed."""
    root = shared_dir(spark, "pause-resume")
    ev = table(spark, sf, "events").select("event_id", "event_type")
    first = F.col("event_id") < halfway(spark, sf)
    folder = f"{root}/in"
    ev.where(first).write.parquet(folder)

    def build():
        stream = spark.readStream.schema(ev.schema).parquet(folder)
        words = stream.withColumnRenamed("event_type", "word")
        return counting.running_count_stream(words, ["event_id"], root, f"{root}/checkpoint")

    def status(value: str) -> DataFrame:
        log = [(1, "Counter", "instance-status-0", "put", value)]
        return topology_view(spark.createDataFrame(log, "seq long, tbl string, key string, op string, value string"))

    job = Switchable(build)
    job.follow(status(PAUSED), "Counter")
    ev.where(~first).write.mode("append").parquet(folder)
    job.follow(status(RUNNING), "Counter")
    job.pause()
    out = all_batches(spark, f"{root}/out", "word string, event_id long, cnt long")
    return out.select("event_id", F.col("word").alias("event_type"), "cnt")


@query("handover", _TYPE_COUNTS_SQL)
def _(spark, sf):
    """A second query takes over the running count in the middle of the events."""
    root = shared_dir(spark, "handover")
    _park_events(spark, sf, root)

    def operator(name: str) -> handover.Operator:
        def build(rows: DataFrame, checkpoint: str, start: DataFrame | None):
            words = rows.select("event_id", F.col("event_type").alias("word"))
            return counting.running_count_stream(
                words, ["event_id"], f"{root}/{name}", checkpoint, start
            )

        reached = lambda _: counting.counters(spark, f"{root}/{name}")
        return handover.Operator(f"{root}/{name}-checkpoint", build, reached)

    handover.handover(spark, f"{root}/channel", _EVENT, operator("a"), operator("b"), cut=1)
    schema = "word string, event_id long, cnt long"
    a, b = (all_batches(spark, f"{root}/{n}/out", schema) for n in "ab")
    return a.unionByName(b).select("event_id", F.col("word").alias("event_type"), "cnt")


def _moved_sql(moves: str) -> str:
    return f"""SELECT event_id, (user_id % 2)::INTEGER AS ch, event_type,
      CASE WHEN event_id >= (max(event_id) OVER () + 1) // 2 AND {moves} THEN 'second' ELSE 'first' END AS job,
      row_number() OVER (PARTITION BY user_id % 2, event_type ORDER BY event_id) AS cnt FROM events"""


def _moved(spark, sf, instances: list[int] | None) -> DataFrame:
    """Counts per channel and type, some channels going to a second job halfway."""
    root = shared_dir(spark, "moved")
    _park_events(spark, sf, root)

    def build(rows: DataFrame, path: str, checkpoint: str, start: DataFrame | None):
        words = rows.select("event_id", F.concat_ws("-", "channel", "event_type").alias("word"))
        return counting.running_count_stream(words, ["event_id"], path, checkpoint, start)

    def left(path: str, start: DataFrame | None) -> DataFrame:
        counts = counting.counters(spark, path, start)
        return counts and counts.withColumn("channel", F.split_part("word", F.lit("-"), F.lit(1)).cast("int"))

    table_of = "first-task-Counter"
    log = [(table_of, f"instance-status-{i}", "put", RUNNING) for i in (0, 1)]
    log += handover.handover_changes("first", "second", "Counter", {"events": 2}, "counts", instances)
    log = spark.createDataFrame(
        [(n, *row) for n, row in enumerate(log)], "seq long, tbl string, key string, op string, value string"
    )
    versions = [moves.owners(log, "Counter", seq) for seq in (1, log.count())]
    mover = moves.Mover(spark, f"{root}/channel", _EVENT, moves.Movable(build, left), f"{root}/jobs")
    before = moves.steps_of(versions[:1])[1]
    stretches = {s.name: s for s in [*before, *mover.follow(versions)]}
    outs = [
        all_batches(spark, f"{mover.folder(s)}/out", "word string, event_id long, cnt long").withColumn("job", F.lit(s.job))
        for s in stretches.values()
    ]
    word = [F.split_part("word", F.lit("-"), F.lit(n)) for n in (1, 2)]
    rows = reduce(DataFrame.unionByName, outs)
    return rows.select("event_id", word[0].cast("int").alias("ch"), word[1].alias("event_type"), "job", "cnt")


@query("handover_instance", _moved_sql("user_id % 2 = 1"))
def _(spark, sf):
    """One instance moves by its control rows; the other stays and goes on."""
    return _moved(spark, sf, [1])


@query("handover_bulk", _moved_sql("true"))
def _(spark, sf):
    """All instances move at once."""
    return _moved(spark, sf, None)


@query("handover_keyed_state", _TYPE_COUNTS_SQL)
def _(spark, sf):
    """The same with Spark's keyed state: read from the old query, given to the new one."""
    root = shared_dir(spark, "handover-state")
    _park_events(spark, sf, root)

    def build(rows: DataFrame, checkpoint: str, start: DataFrame | None):
        out = state.counting_state(rows.select("event_id", "event_type"), "event_type", "event_id", start=start)
        return writer(out, checkpoint).format("parquet").option("path", f"{checkpoint}-out")

    def operator(name: str) -> handover.Operator:
        return handover.Operator(f"{root}/{name}", build, lambda c: state.read_state(spark, c))

    handover.handover(spark, f"{root}/channel", _EVENT, operator("a"), operator("b"), cut=1)
    schema = "event_id long, event_type string, cnt long"
    a, b = (spark.read.schema(schema).parquet(f"{root}/{n}-out") for n in "ab")
    return a.unionByName(b)


@query("handover_window_join", batch.ANCHORED_JOIN_SQL)
def _(spark, sf):
    """The anchored join moves to a second query with its open windows."""
    root = shared_dir(spark, "handover-join")
    rows = market(spark, sf)
    first = earlier_half(spark, sf)
    channels.append_to_channels(rows.where(first), f"{root}/channel", epoch=0)
    channels.append_to_channels(rows.where(~first), f"{root}/channel", epoch=1)

    def operator(name: str) -> handover.Operator:
        left = lambda _: windows.window_state(spark, f"{root}/{name}")
        return handover.Operator(f"{root}/{name}-checkpoint", _market_join(f"{root}/{name}"), left)

    handover.handover(spark, f"{root}/channel", _MARKET, operator("a"), operator("b"), cut=1)
    a, b = (all_batches(spark, f"{root}/{n}/out", _JOINED) for n in "ab")
    return a.unionByName(b).select(
        "ch", "win", "user_id", "person_event", "auction_event", "value"
    )


@query("keyed_state", _TYPE_COUNTS_SQL)
def _(spark, sf):
    root = shared_dir(spark, "keyed-state")
    ev = table_stream(spark, sf, "events").select("event_id", "event_type")
    out = state.counting_state(ev, "event_type", "event_id")
    drain(writer(out, f"{root}/checkpoint").format("parquet").option("path", f"{root}/out"))
    return spark.read.schema("event_id long, event_type string, cnt long").parquet(f"{root}/out")


@query(
    "foreach_sink",
    "SELECT concat('[Sink (', user_id % 2 + 1, '/2)] Message: ', event_id, ',', event_type) AS line FROM events",
)
def _(spark, sf):
    """A user hook that renders and stores the rows it gets."""
    from sluiceway.functions.names import row_line, task_line

    root = shared_dir(spark, "foreach-sink")
    ev = table_stream(spark, sf, "events").select("event_id", "event_type", "user_id")

    def hook(rows: DataFrame, number: int) -> None:
        task = F.concat(F.lit("Sink ("), (F.col("user_id") % 2 + 1).cast("string"), F.lit("/2)"))
        line = task_line(task, row_line(F.col("event_id"), F.col("event_type")))
        put_batch(rows.select(line.alias("line")), f"{root}/out", number)

    drain(sinks.foreach_sink(ev, hook, f"{root}/checkpoint"))
    return all_batches(spark, f"{root}/out", "line string").select("line")


@query(
    "stream_hash_channel",
    f"SELECT event_id, abs({batch._LONG_HASH} % 4)::INTEGER AS ch FROM events",
)
def _(spark, sf):
    root = shared_dir(spark, "stream-hash-channel")
    ev = table_stream(spark, sf, "events").select("event_id", "user_id")
    out = ev.select("event_id", hash_channel(ev, "user_id", 4).alias("ch"))
    drain(writer(out, f"{root}/checkpoint").format("parquet").option("path", f"{root}/out"))
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query("discard_sink", "SELECT event_type, count(*) AS rows FROM events GROUP BY event_type")
def _(spark, sf):
    """Rows are thrown away; a tap before the sink has counted them by type."""
    root = shared_dir(spark, "discard-sink")
    ev = table_stream(spark, sf, "events").select("event_type")
    counts = counting.word_count_stream(ev.withColumnRenamed("event_type", "word"), f"{root}/out", f"{root}/tap")
    drain(sinks.discard_sink(ev, f"{root}/checkpoint"))
    drain(counts)
    seen = latest_rows(spark, f"{root}/out", "word string, cnt long", ["word"])
    return seen.select(F.col("word").alias("event_type"), F.col("cnt").alias("rows"))


@query("stream_row_pause", batch.ROW_PAUSE_SQL)
def _(spark, sf):
    """The same in five micro-batches, so pauses last over several of them."""
    root = shared_dir(spark, "stream-row-pause")
    ev = batch.pausable(spark, sf)
    top = table(spark, sf, "events").agg(F.max("event_id") + 1).scalar()
    folder = f"{root}/in"
    for part in range(5):
        ev.where(F.col("event_id") * 5 >= top * part).where(F.col("event_id") * 5 < top * (part + 1)).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(ev.schema).parquet(folder)
        drain(pauses.pausable_stream(stream, ["instance"], "event_id", "is_control", "status", root, f"{root}/checkpoint"))
    out = all_batches(spark, f"{root}/out", "event_id long, instance long, held boolean, release long, position long")
    return out.select("event_id", "instance", "held", "release", "position")


class CountPerUser(user_state.StateFunction):
    """A map from user to the number of events so far."""

    maps = {"seen": ("long", "long")}
    output = "event_id long, user_id long, cnt long"

    def process(self, key, rows, state):
        users = rows.groupby("user_id")
        before = state.entries("seen")
        for user, n in users.size().items():
            state.put_entry("seen", user, before.get(user, 0) + int(n))
        cnt = users.cumcount() + 1 + (rows["user_id"].map(before).fillna(0).astype("int64") if before else 0)
        return rows[["event_id", "user_id"]].assign(cnt=cnt)


class BundlesOfFour(user_state.StateFunction):
    """A list of ids that wait until there are four, and the number of bundles sent so far."""

    values = {"sent": "long"}
    lists = {"waiting": "long"}
    output = "bundle long, first_id long, last_id long, n long"

    def process(self, key, rows, state):
        import pandas as pd

        sent, ids = state.get("sent", 0), state.items("waiting") + rows["event_id"].tolist()
        full = len(ids) // 4
        state.put("sent", sent + full)
        state.put_items("waiting", ids[4 * full :])
        first, last = ids[: 4 * full : 4], ids[3 : 4 * full : 4]
        return pd.DataFrame({"bundle": range(sent, sent + full), "first_id": first, "last_id": last, "n": 4}, dtype="int64")


STATE_BLOCK = 2048


def _run_function(spark, sf, function: user_state.StateFunction, root: str) -> DataFrame:
    """The function over all events, which come in two parts; what it gave."""
    ev = table(spark, sf, "events").select("event_id", "event_type", "user_id")

    def step(stream: DataFrame) -> None:
        out = user_state.with_state(stream, "event_type", "event_id", function, STATE_BLOCK)
        drain(writer(out, f"{root}/checkpoint").format("parquet").option("path", f"{root}/out"))

    in_two_parts(spark, ev, F.col("event_id") < halfway(spark, sf), step)
    return spark.read.schema(f"event_type string, block long, {function.output}").parquet(f"{root}/out")


@query(
    "user_map_state",
    """SELECT event_id, event_type, user_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS cnt
    FROM events""",
)
def _(spark, sf):
    """Events of a type and user so far: a map per type and block, blocks added up from the map state."""
    root = shared_dir(spark, "user-map-state")
    out = _run_function(spark, sf, CountPerUser(), root)
    seen = user_state.kept_state(spark, f"{root}/checkpoint", "seen")
    sums = seen.withColumnsRenamed({"map_key": "user_id", "value": "cnt"})
    all_of_it = user_state.across_blocks(out, sums, ["event_type", "user_id"], "cnt")
    return all_of_it.select("event_id", "event_type", "user_id", "cnt")


@query(
    "user_list_state",
    f"""WITH r AS (
      SELECT event_type, event_id // {STATE_BLOCK} AS block, event_id,
        row_number() OVER (PARTITION BY event_type, event_id // {STATE_BLOCK} ORDER BY event_id) - 1 AS i
      FROM events)
    SELECT event_type, block, i // 4 AS bundle, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n
    FROM r GROUP BY event_type, block, i // 4""",
)
def _(spark, sf):
    """Events of a type in bundles of four per block; those that still wait come from the list state."""
    root = shared_dir(spark, "user-list-state")
    out = _run_function(spark, sf, BundlesOfFour(), root)
    waiting = user_state.kept_state(spark, f"{root}/checkpoint", "waiting").groupBy("event_type", "block")
    waiting = waiting.agg(F.min("value").alias("first_id"), F.max("value").alias("last_id"), F.count("value").alias("n"))
    sent = user_state.kept_state(spark, f"{root}/checkpoint", "sent").withColumnRenamed("value", "bundle")
    return out.unionByName(waiting.join(sent, ["event_type", "block"]))


@query("shared_count_live", batch.SHARED_COUNT_SQL)
def _(spark, sf):
    """Two jobs count into the same counters at the same time; both are stopped once and go on."""
    root = shared_dir(spark, "shared-count")
    docs = _docs(spark, sf)
    first = F.col("doc_id") < table(spark, sf, "documents").agg(F.expr("(max(doc_id) + 1) div 2")).scalar()
    jobs = ["even", "odd"]
    for part in (first, ~first):
        for number, job in enumerate(jobs):
            docs.where(part & (F.col("doc_id") % 2 == number)).write.mode("append").parquet(f"{root}/in-{job}")
        running = []
        for job in jobs:
            lines = spark.readStream.schema(docs.schema).parquet(f"{root}/in-{job}")
            counts = shared_count.shared_count_stream(tokenize(lines, "text"), f"{root}/counters", job, f"{root}/checkpoint-{job}")
            running.append(counts.trigger(availableNow=True).start())
        for started in running:
            started.awaitTermination()
    return shared_count.shared_totals(spark, f"{root}/counters", jobs)


@query(
    "stream_metrics",
    """WITH t AS (
      SELECT *, event_id * 5 // (SELECT max(event_id) + 1 FROM events) AS batch FROM events),
    m AS (
      SELECT batch, count(*) AS event_counter, count(*) FILTER (event_type = 'error') AS errors, max(event_id) AS newest
      FROM t GROUP BY batch)
    SELECT *, (sum(event_counter) OVER (ORDER BY batch))::BIGINT AS so_far FROM m""",
)
def _(spark, sf):
    """What a tap before a sink saw in each of five micro-batches, read back from the table of metrics."""
    root = shared_dir(spark, "stream-metrics")
    ev = table(spark, sf, "events").select("event_id", "event_type")
    top = table(spark, sf, "events").agg(F.max("event_id") + 1).scalar()
    with metrics.recorded(spark, f"{root}/metrics"):
        for part in range(5):
            ev.where(F.col("event_id") * 5 >= top * part).where(F.col("event_id") * 5 < top * (part + 1)).write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(ev.schema).parquet(f"{root}/in")
            tapped = debug_tap(stream, "sink", errors=F.count_if(F.col("event_type") == "error"), newest=F.max("event_id"))
            drain(sinks.discard_sink(tapped, f"{root}/checkpoint"))
    seen = metrics.recorded_metrics(spark, f"{root}/metrics").where("name = 'sink'").groupBy("batch")
    seen = seen.pivot("metric", ["rows", "errors", "newest"]).agg(F.first("value")).withColumnRenamed("rows", "event_counter")
    so_far = F.sum("event_counter").over(Window.orderBy("batch"))
    return seen.withColumn("so_far", so_far)
