"""Registered batch queries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F

from sluiceway.functions import names
from sluiceway.functions.numbers import seeded
from sluiceway.functions.time import now_ms
from sluiceway.model import PAUSED, RUNNING, StreamSpec
from sluiceway.operators import (
    admission,
    asof,
    anchored,
    channels,
    control,
    counting,
    joins,
    pauses,
    routing,
    rows,
    windows,
)
from sluiceway.operators.ordinal import running_ordinal
from sluiceway.plans.registry import query
from sluiceway.plans.tables import (
    CONTROL_LOG_SQL,
    EVENTS_SQL,
    HALF_SQL,
    HOUR_MS,
    WORDS_SQL,
    control_log,
    auctions,
    events,
    halfway,
    indexes,
    market,
    persons,
    purchases,
    sign_ups,
    table,
    topology_log,
    words,
)
from sluiceway.sources import generator
from sluiceway.sources.lines import LINES, lines

# --- text ---------------------------------------------------------------------------------


@query("tokenize", f"WITH {WORDS_SQL} SELECT doc_id, pos, word FROM words")
def _(spark, sf):
    return words(spark, sf)


@query("word_count", f"WITH {WORDS_SQL} SELECT word, count(*) AS cnt FROM words GROUP BY word")
def _(spark, sf):
    return counting.word_count(words(spark, sf))


RUNNING_COUNT_SQL = f"""
WITH {WORDS_SQL}
SELECT word, doc_id, pos, row_number() OVER (PARTITION BY word ORDER BY doc_id, pos) AS cnt
FROM words
"""


@query("running_count", RUNNING_COUNT_SQL)
def _(spark, sf):
    return counting.running_count(words(spark, sf), ["doc_id", "pos"]).select(
        "word", "doc_id", "pos", "cnt"
    )


SHARED_COUNT_SQL = f"WITH {WORDS_SQL} SELECT word, count(*) AS cnt FROM words GROUP BY word"


@query("shared_count", SHARED_COUNT_SQL)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    jobs = [rows.tokenize(docs.where(F.col("doc_id") % 2 == j), "text") for j in (0, 1)]
    return counting.shared_count(jobs)


def _line_pieces(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        pieces = pc.split_pattern(batch.column("text"), "\n")
        at = pc.list_parent_indices(pieces)
        yield pa.RecordBatch.from_arrays(
            [pc.take(batch.column("doc_id"), at), pc.list_flatten(pieces)], ["doc_id", "line"]
        )


@query("flat_map", "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return rows.flat_map(docs, _line_pieces, "doc_id long, line string")


@query(
    "flat_map_rows",
    """SELECT event_id, unnest(range(0, event_id % 3)) AS copy FROM events""",
)
def _(spark, sf):
    def copies(row: dict) -> list[dict] | None:
        i = int(row["event_id"])
        return [{"event_id": i, "copy": c} for c in range(i % 3)] if i % 3 else None

    ev = table(spark, sf, "events").select("event_id")
    return rows.flat_map_rows(ev, copies, "event_id long, copy long")


@query(
    "render_counts",
    f"WITH {WORDS_SQL} SELECT concat(word, ': ', count(*)) AS line FROM words GROUP BY word",
)
def _(spark, sf):
    counts = counting.word_count(words(spark, sf))
    return counts.select(names.count_line(F.col("word"), F.col("cnt")).alias("line"))


@query(
    "render_sink",
    f"""WITH {WORDS_SQL}, counts AS (SELECT word, count(*) AS cnt FROM words GROUP BY word)
    SELECT concat('[Sink (', length(word) % 2 + 1, '/2)] Message: ', word, ': ', cnt) AS line FROM counts""",
)
def _(spark, sf):
    """Lines as the sink prints them, prefixed by the task that prints."""
    counts = counting.word_count(words(spark, sf))
    number = (F.length("word") % 2 + 1).cast("string")
    task = F.concat(F.lit("Sink ("), number, F.lit("/2)"))
    line = names.task_line(task, names.count_line(F.col("word"), F.col("cnt")))
    return counts.select(line.alias("line"))


# --- sources ------------------------------------------------------------------------------

_LINE_ROWS = ", ".join(f"({i}, '{line.replace(chr(39), chr(39) * 2)}')" for i, line in enumerate(LINES))
LINES_SQL = f"""
  text_lines AS (
    SELECT event_id AS idx, line
    FROM events JOIN (VALUES {_LINE_ROWS}) AS t(i, line) ON event_id % {len(LINES)} = i)
"""


@query("lines_source", f"WITH {LINES_SQL} SELECT idx, line FROM text_lines")
def _(spark, sf):
    return lines(indexes(spark, sf))


@query(
    "lines_word_count",
    rf"""WITH {LINES_SQL},
    w AS (SELECT unnest(regexp_split_to_array(regexp_replace(lower(line), '\W+$', ''), '\W+')) AS word
          FROM text_lines)
    SELECT word, count(*) AS cnt FROM w GROUP BY word""",
)
def _(spark, sf):
    return counting.word_count(rows.tokenize(lines(indexes(spark, sf)), "line"))


@query(
    "generator_source",
    f"""SELECT event_id AS idx, event_id * event_id AS square, concat('row-', event_id) AS label
    FROM events WHERE event_id < {HALF_SQL}""",
)
def _(spark, sf):
    idx = F.col("idx")
    columns = {"square": idx * idx, "label": F.concat(F.lit("row-"), idx.cast("string"))}
    return generator.generate(indexes(spark, sf), columns, ends=idx >= halfway(spark, sf))


def _python_row(i: int) -> tuple | None:
    return (i * 3, "even" if i % 2 == 0 else "odd")


@query(
    "generator_function",
    """SELECT event_id AS idx, event_id * 3 AS tripled,
      CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM events""",
)
def _(spark, sf):
    return generator.generate_with(indexes(spark, sf), _python_row, "tripled long, parity string")


PERSONS_SQL = """
  persons AS (
    SELECT event_id, user_id AS id, c_name AS name, ts, epoch_us(ts) // 1000 AS ms
    FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'signup')
"""
AUCTIONS_SQL = """
  auctions AS (
    SELECT event_id AS id, user_id AS seller, floor(value * 100)::BIGINT AS reserve, ts, epoch_us(ts) // 1000 AS ms
    FROM events WHERE event_type = 'purchase')
"""


@query("person_source", f"WITH {PERSONS_SQL} SELECT id, name, ts FROM persons")
def _(spark, sf):
    """New persons: sign-ups with the customer's name."""
    return persons(spark, sf).select("id", "name", "ts")


@query("auction_source", f"WITH {AUCTIONS_SQL} SELECT id, seller, reserve, ts FROM auctions")
def _(spark, sf):
    """New auctions: purchases, with the value in cents as the reserve."""
    return auctions(spark, sf).select("id", "seller", "reserve", "ts")


@query("before_limit", f"SELECT event_id, event_type FROM events WHERE event_id < {HALF_SQL}")
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    return generator.before(ev, halfway(spark, sf), "event_id")


@query("resumable_source", f"SELECT event_id, event_type FROM events WHERE event_id >= {HALF_SQL}")
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    return generator.from_index(ev, halfway(spark, sf), "event_id")


SECONDS_SQL = """
  per_second AS (
    SELECT event_type, epoch_us(ts) // 1000000 * 1000 AS second, count(*) AS rate_counter
    FROM events GROUP BY 1, 2)
"""


@query("rate_limit", f"WITH {SECONDS_SQL} SELECT second, sum(rate_counter)::BIGINT AS rate_counter, sum(rate_counter) > 100 AS over FROM per_second GROUP BY second")
def _(spark, sf):
    """Seconds of event time with their number of events, and whether that is over 100."""
    per_second = counting.event_rates(events(spark, sf), [], "ms")
    return per_second.withColumn("over", F.col("rate_counter") > 100)


ADMITTED_SQL = f"""
WITH ev AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS ms FROM events),
q AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ms, event_id) - 1 AS i FROM ev),
t AS (SELECT *, i % 2 AS lane, i // 2 AS turn FROM q),
s AS (
  SELECT *, turn + max((ms // {HOUR_MS}) - turn) OVER (PARTITION BY event_type, lane ORDER BY turn) AS slot FROM t)
SELECT event_id, event_type, ms, greatest(ms, slot * {HOUR_MS})::BIGINT AS admitted FROM s
"""


@query("rate_limit_admitted", ADMITTED_SQL)
def _(spark, sf):
    """When a limit of two events per type and hour lets each event through."""
    ev = events(spark, sf).select("event_id", "event_type", "ms")
    return admission.admit(ev, ["event_type"], "ms", ["event_id"], rate=2, slot_ms=HOUR_MS)


@query(
    "event_counters",
    f"""WITH {SECONDS_SQL}
    SELECT event_type, second, rate_counter,
      (sum(rate_counter) OVER (PARTITION BY event_type ORDER BY second))::BIGINT AS event_counter
    FROM per_second""",
)
def _(spark, sf):
    return counting.event_counters(events(spark, sf), "event_type", "ms")


# --- rows ---------------------------------------------------------------------------------


@query(
    "key_by",
    "SELECT user_id AS key, event_id, value FROM events WHERE event_type = 'purchase'",
)
def _(spark, sf):
    keyed = rows.key_by(purchases(spark, sf), "user_id")
    return keyed.select("key", "event_id", "value")


ENVELOPE_SQL = """
  SELECT 'Orders' AS operator, (o_custkey % 4)::INTEGER AS instance, 4 AS parallelism,
    (o_orderkey % 3)::INTEGER AS dest, 0 AS channel_type,
    o_orderkey, o_custkey, o_orderstatus, o_totalprice
  FROM orders
"""


def _enveloped(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )
    return rows.envelope(
        orders, "Orders", 4, dest=F.col("o_orderkey") % 3, instance=F.col("o_custkey") % 4
    )


@query("envelope", ENVELOPE_SQL)
def _(spark, sf):
    return _enveloped(spark, sf).select("src.*", "dest", "channel_type", "data.*")


@query("unwrap", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, sf):
    return rows.unwrap(_enveloped(spark, sf))


@query(
    "union_all",
    """SELECT 'person' AS kind, user_id, NULL::DOUBLE AS value FROM events WHERE event_type = 'signup'
    UNION ALL SELECT 'auction', user_id, value FROM events WHERE event_type = 'purchase'""",
)
def _(spark, sf):
    return market(spark, sf).select("kind", "user_id", "value")


@query("dispatch_by_type", "SELECT user_id, value FROM events WHERE event_type = 'purchase'")
def _(spark, sf):
    return rows.dispatch(market(spark, sf), "auction", ["user_id", "value"])


@query(
    "multi_input",
    """SELECT event_id, user_id FROM events WHERE event_type IN ('signup', 'purchase', 'view')""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    inputs = [ev.where(F.col("event_type") == k) for k in ("signup", "purchase", "view")]
    return rows.merge_inputs(inputs).select("event_id", "user_id")


@query("data_events_only", "SELECT event_id, value FROM events WHERE event_type <> 'error'")
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value", "event_type")
    kind = F.when(F.col("event_type") == "error", "control").otherwise("data")
    return rows.data_events_only(ev.withColumn("event_class", kind)).select("event_id", "value")


@query("assert_channel", "SELECT event_id, (user_id % 4)::INTEGER AS dest FROM events")
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", (F.col("user_id") % 4).alias("dest"))
    return rows.assert_channel(channels.deliver(ev, 4, "dest"), "dest")


@query(
    "fifo_order",
    """SELECT event_id, ch, lag(event_id) OVER (PARTITION BY ch ORDER BY event_id) AS previous
    FROM (SELECT event_id, (user_id % 2)::INTEGER AS ch FROM events)""",
)
def _(spark, sf):
    """Order inside a channel, shown as each row's predecessor."""
    ev = table(spark, sf, "events").select("event_id", (F.col("user_id") % 2).cast("int").alias("ch"))
    return control.previous_in_channel(ev, "ch", "event_id", "event_id", "previous")


@query(
    "in_channel_order",
    """SELECT ch, event_id, row_number() OVER (PARTITION BY ch ORDER BY event_id) AS place
    FROM (SELECT event_id, (user_id % 2)::INTEGER AS ch FROM events)""",
)
def _(spark, sf):
    """Rows as a reader gets them channel by channel, with their places in the channel."""
    ev = table(spark, sf, "events").select((F.col("user_id") % 2).cast("int").alias("ch"), "event_id")
    placed = running_ordinal(ev, ["ch"], ["event_id"], "place")
    return rows.in_channel_order(placed, "ch", "event_id").select("ch", "event_id", "place")


@query(
    "wall_clock",
    "SELECT event_id, epoch_us(ts) // 1000 AS ms, true AS past FROM events",
)
def _(spark, sf):
    """Event time next to the wall clock: everything has happened before now."""
    ev = events(spark, sf)
    return ev.select("event_id", "ms", (F.col("ms") <= now_ms()).alias("past"))


# --- channels and routes ------------------------------------------------------------------


def _signed32_sql(expr: str) -> str:
    return (
        f"(CASE WHEN ({expr}) & 4294967295 >= 2147483648 "
        f"THEN (({expr}) & 4294967295) - 4294967296 ELSE ({expr}) & 4294967295 END)"
    )


def _string_hash_sql(column: str) -> str:
    codes = f"list_transform(string_split({column}, ''), lambda c: unicode(c)::BIGINT)"
    folded = f"list_reduce(list_prepend(0::BIGINT, {codes}), lambda a, c: (a * 31 + c) & 4294967295)"
    return f"(CASE WHEN {column} = '' THEN 0 ELSE {_signed32_sql(folded)} END)"


_LONG_HASH = _signed32_sql("xor(user_id, user_id >> 32)")


@query("hash_channel_long", f"SELECT event_id, abs({_LONG_HASH} % 7)::INTEGER AS ch FROM events")
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id")
    return ev.select("event_id", channels.hash_channel(ev, "user_id", 7).alias("ch"))


@query(
    "hash_channel_string",
    f"SELECT event_id, abs({_string_hash_sql('props')} % 7)::INTEGER AS ch FROM events",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "props")
    return ev.select("event_id", channels.hash_channel(ev, "props", 7).alias("ch"))


@query(
    "hash_channel_words",
    f"""WITH {WORDS_SQL}, counts AS (SELECT word, count(*) AS cnt FROM words GROUP BY word)
    SELECT word, cnt, abs({_string_hash_sql('word')} % 4)::INTEGER AS ch FROM counts""",
)
def _(spark, sf):
    counts = counting.word_count(words(spark, sf))
    return counts.withColumn("ch", channels.hash_channel(counts, "word", 4))


@query(
    "rebalance_channel",
    "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) % 3)::INTEGER AS ch FROM events",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts")
    return channels.rebalance_channel(ev, 3, ["ts", "event_id"]).select("event_id", "ch")


@query("rebalance_indexed", "SELECT event_id, ((event_id + 1) % 3)::INTEGER AS ch FROM events")
def _(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", channels.rebalance_indexed(F.col("event_id"), 3).alias("ch"))


@query("forward_channel", "SELECT event_id, ((user_id % 8) % 2)::INTEGER AS ch FROM events")
def _(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", channels.forward_channel(2, F.col("user_id") % 8).alias("ch"))


@query("direct_channel", "SELECT event_id, (user_id % 5)::INTEGER AS ch FROM events")
def _(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", channels.direct_channel(5, F.col("user_id") % 5).alias("ch"))


@query(
    "channel_for",
    f"""SELECT event_id, abs({_LONG_HASH} % 4)::INTEGER AS by_hash,
      (row_number() OVER (ORDER BY ts, event_id) % 3)::INTEGER AS by_turn,
      ((user_id % 6) % 4)::INTEGER AS by_instance, (user_id % 3)::INTEGER AS by_dest,
      (event_id % 5)::INTEGER AS by_rule
    FROM events""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", "ts", "user_id", (F.col("user_id") % 3).alias("dest")
    )
    ev = channels.channel_for(ev, StreamSpec(4, "hash", "user_id"), "by_hash")
    ev = channels.channel_for(ev, StreamSpec(3, "rebalance"), "by_turn", order=["ts", "event_id"])
    ev = channels.channel_for(ev, StreamSpec(4, "forward"), "by_instance", F.col("user_id") % 6)
    ev = channels.channel_for(ev, StreamSpec(3, "direct"), "by_dest")
    ev = channels.channel_for(ev, StreamSpec(5, "custom"), "by_rule", custom=F.col("event_id") % 5)
    return ev.select("event_id", "by_hash", "by_turn", "by_instance", "by_dest", "by_rule")


def _channelled(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "user_id", (F.col("user_id") % 2).cast("int").alias("ch")
    )


def _listed(spark, sf):
    """The channel table: channel 1, taken from the events."""
    return _channelled(spark, sf).where("ch = 1").select(F.col("ch").alias("channel")).distinct()


@query(
    "route_by_table",
    """SELECT event_id, (user_id % 2)::INTEGER AS ch, (user_id % 2 = 1)::INTEGER AS channel_type
    FROM events""",
)
def _(spark, sf):
    routed = routing.route_by_table(_channelled(spark, sf), _listed(spark, sf), 2)
    return routed.select("event_id", "ch", "channel_type")


@query(
    "hold_paused",
    """WITH last AS (SELECT user_id % 4 AS ch, max_by(event_type, event_id) AS status FROM events
      WHERE event_type IN ('signup', 'error') GROUP BY 1)
    SELECT event_id, (user_id % 4)::INTEGER AS ch, (l.status = 'error')::INTEGER AS channel_type
    FROM events JOIN last l ON user_id % 4 = l.ch""",
)
def _(spark, sf):
    """Rows for paused instances go to durable channels: a sign-up runs, an error pauses."""
    ev = table(spark, sf, "events").select(
        "event_id", "event_type", (F.col("user_id") % 4).cast("int").alias("ch")
    )
    log = ev.where(F.col("event_type").isin("signup", "error")).select(
        F.col("event_id").alias("seq"),
        F.lit("Counter").alias("tbl"),
        names.queue_name(F.lit("instance-status"), F.col("ch")).alias("key"),
        F.lit("put").alias("op"),
        F.when(F.col("event_type") == "error", "Paused").otherwise("Running").alias("value"),
    )
    paused = routing.paused_channels(control.topology_view(log), "Counter")
    return routing.route_by_table(ev, paused, 4).select("event_id", "ch", "channel_type")


@query(
    "channel_membership",
    """SELECT event_id, CASE WHEN user_id % 2 = 1 THEN 'listed' ELSE 'other' END AS part FROM events""",
)
def _(spark, sf):
    ev, listed = _channelled(spark, sf), _listed(spark, sf)
    inside = routing.channel_members(ev, listed, 2).select("event_id", F.lit("listed").alias("part"))
    outside = routing.channel_others(ev, listed, 2).select("event_id", F.lit("other").alias("part"))
    return inside.unionByName(outside)


@query(
    "retarget_stream",
    """SELECT event_id, stream, concat(stream, '-', ch) AS queue
    FROM (SELECT event_id, CASE WHEN user_id % 4 = 1 THEN 'second' ELSE 'first' END AS stream,
            CASE WHEN user_id % 4 = 1 THEN user_id % 8 % 3 ELSE user_id % 8 % 4 END AS ch
          FROM events)""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", "user_id", (F.col("user_id") % 8).cast("int").alias("ch")
    )
    routes = (
        ev.where(F.col("user_id") % 4 == 1)
        .select(F.lit("Counter").alias("operator"), F.lit(1).alias("instance"), F.lit("second").alias("stream"))
        .distinct()
    )
    out = routing.retarget_stream(
        ev, routes, "Counter", F.col("user_id") % 4, 4, "first", {"first": 4, "second": 3}
    )
    return out.select("event_id", "stream", "queue")


@query(
    "control_keys",
    r"""SELECT event_id, concat('instance-status-', user_id % 10) AS key,
      'instance-status' AS attribute, (user_id % 10)::INTEGER AS instance,
      concat('a', user_id % 10, ',b') AS ids, 2 AS n_ids FROM events""",
)
def _(spark, sf):
    ev = table(spark, sf, "events")
    number = (F.col("user_id") % 10).cast("string")
    key = names.queue_name(F.lit("instance-status"), number)
    ids = names.join_ids(F.array(F.concat(F.lit("a"), number), F.lit("b")))
    return ev.select(
        "event_id",
        key.alias("key"),
        names.key_attribute(key).alias("attribute"),
        names.key_instance(key).alias("instance"),
        ids.alias("ids"),
        F.size(names.split_ids(ids)).alias("n_ids"),
    )


# --- windows and joins --------------------------------------------------------------------


@query(
    "tumbling_counts",
    f"""WITH {EVENTS_SQL} SELECT ms - ms % {HOUR_MS} AS window_ms, count(*) AS cnt
    FROM ev GROUP BY 1""",
)
def _(spark, sf):
    return windows.tumbling_counts(events(spark, sf), "ms", HOUR_MS)


WINDOW_JOIN_SQL = f"""
WITH {EVENTS_SQL}
SELECT p.user_id, p.ms - p.ms % {HOUR_MS} AS window_ms, p.event_id AS person_event,
  a.event_id AS auction_event, a.value
FROM ev p JOIN ev a ON p.user_id = a.user_id AND p.ms // {HOUR_MS} = a.ms // {HOUR_MS}
WHERE p.event_type = 'signup' AND a.event_type = 'purchase'
"""


@query("window_join", WINDOW_JOIN_SQL)
def _(spark, sf):
    joined = joins.window_join(
        sign_ups(spark, sf).drop("event_id"),
        purchases(spark, sf).drop("event_id"),
        ("user_id", "user_id"),
        ("ms", "ms"),
        HOUR_MS,
    )
    return joined.select("user_id", "window_ms", "person_event", "auction_event", "value")


def anchored_sql(source: str, width_ms: int) -> str:
    """Tables ``e`` (ranked rows) and ``w`` (windows: first and closing rank) over ``source``.

    ``source`` selects event_id, ch, ms, ord and whatever else is needed, in arrival order ``ord``.
    """
    closing = f"""(SELECT min(x.rn) FROM e x
        WHERE x.ch = a.ch AND x.rn > a.rn AND x.ms >= a.ms + {width_ms})"""
    return f"""
  src AS ({source}),
  e AS (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY ord, event_id) AS rn FROM src),
  n AS (SELECT a.ch, a.rn, {closing} AS c_rn FROM e a),
  w AS (
    SELECT ch, 1::BIGINT AS win, rn AS a_rn, c_rn FROM n WHERE rn = 1
    UNION ALL
    SELECT n.ch, w.win + 1, n.rn, n.c_rn FROM w JOIN n ON n.ch = w.ch AND n.rn = w.c_rn + 1),
  placed AS (
    SELECT e.*, w.win, coalesce(e.rn = w.c_rn, false) AS is_closer, w.c_rn IS NOT NULL AS closed
    FROM e JOIN w ON e.ch = w.ch AND e.rn >= w.a_rn AND e.rn <= coalesce(w.c_rn, e.rn))
"""


_ALL_EVENTS = "SELECT event_id, (user_id % 2)::INTEGER AS ch, epoch_ms(ts) AS ms, epoch_ms(ts) AS ord FROM events"
ANCHORED_SQL = f"""
WITH RECURSIVE {anchored_sql(_ALL_EVENTS, HOUR_MS)}
SELECT event_id, ch, win, is_closer FROM placed
"""


@query("anchored_window", ANCHORED_SQL)
def _(spark, sf):
    ev = events(spark, sf).select(
        "event_id", (F.col("user_id") % 2).cast("int").alias("ch"), "ms"
    )
    placed = anchored.anchored_window(ev, "ch", "ms", "event_id", HOUR_MS)
    return placed.select("event_id", "ch", "win", "is_closer")


_LATE_EVENTS = """SELECT event_id, (user_id % 2)::INTEGER AS ch,
  epoch_ms(ts) - (event_id % 7) * 600000 AS ms, event_id AS ord FROM events"""


@query(
    "late_rows",
    f"""WITH RECURSIVE {anchored_sql(_LATE_EVENTS, HOUR_MS)}
    SELECT event_id, ch, win, is_closer FROM placed""",
)
def _(spark, sf):
    ev = events(spark, sf).select(
        "event_id",
        (F.col("user_id") % 2).cast("int").alias("ch"),
        (F.col("ms") - (F.col("event_id") % 7) * 600_000).alias("ms"),
    )
    placed = anchored.anchored_window_by_arrival(ev, "ch", "ms", "event_id", HOUR_MS)
    return placed.select("event_id", "ch", "win", "is_closer")


_MARKET_SQL = """SELECT event_id, user_id, event_type, value, (user_id % 2)::INTEGER AS ch,
  epoch_ms(ts) AS ms, epoch_ms(ts) AS ord FROM events WHERE event_type IN ('signup', 'purchase')"""
ANCHORED_JOIN_SQL = f"""
WITH RECURSIVE {anchored_sql(_MARKET_SQL, HOUR_MS)}
SELECT p.ch, p.win, p.user_id, p.event_id AS person_event, a.event_id AS auction_event, a.value
FROM placed p JOIN placed a ON p.ch = a.ch AND p.win = a.win AND p.user_id = a.user_id
WHERE p.event_type = 'signup' AND a.event_type = 'purchase'
  AND p.closed AND NOT p.is_closer AND NOT a.is_closer
"""


def anchored_join(spark, sf, rows_in=None, carry=None):
    return joins.window_join_anchored(
        market(spark, sf) if rows_in is None else rows_in,
        "person",
        "auction",
        "ch",
        "user_id",
        "ms",
        "event_id",
        HOUR_MS,
        {"event_id": "person_event"},
        {"event_id": "auction_event", "value": "value"},
        carry,
    ).select("ch", "win", "user_id", "person_event", "auction_event", "value")


@query("window_join_anchored", ANCHORED_JOIN_SQL)
def _(spark, sf):
    return anchored_join(spark, sf)


_PEOPLE_JOIN = f"""
WITH {PERSONS_SQL}, {AUCTIONS_SQL}
SELECT p.id, p.name, a.reserve FROM persons p JOIN auctions a
ON p.id = a.seller AND p.ms // {HOUR_MS} = a.ms // {HOUR_MS}
"""


def _people_join(spark, sf):
    people = persons(spark, sf).select("id", "name", "ms")
    sold = auctions(spark, sf).select("seller", "reserve", "ms")
    out = joins.window_join(people, sold, ("id", "seller"), ("ms", "ms"), HOUR_MS)
    return out.select("id", "name", "reserve")


@query("join_output", _PEOPLE_JOIN)
def _(spark, sf):
    """New persons who opened an auction in the same hour."""
    return _people_join(spark, sf)


@query(
    "render_join",
    f"WITH out AS ({_PEOPLE_JOIN}) SELECT concat_ws(',', id, name, reserve) AS line FROM out",
)
def _(spark, sf):
    line = names.row_line(F.col("id"), F.col("name"), F.col("reserve"))
    return _people_join(spark, sf).select(line.alias("line"))


@query(
    "new_sellers_anchored",
    f"""WITH RECURSIVE {PERSONS_SQL}, {AUCTIONS_SQL},
    {anchored_sql(f'''SELECT event_id, abs({_LONG_HASH.replace("user_id", "id")} % 2)::INTEGER AS ch, ms, ms AS ord, 'person' AS kind,
      id AS key, name, NULL::BIGINT AS reserve FROM persons
    UNION ALL SELECT id, abs({_LONG_HASH.replace("user_id", "seller")} % 2)::INTEGER, ms, ms, 'auction', seller, NULL, reserve
    FROM auctions''', HOUR_MS)}
    SELECT p.key AS id, p.name, a.reserve FROM placed p
    JOIN placed a ON p.ch = a.ch AND p.win = a.win AND p.key = a.key
    WHERE p.kind = 'person' AND a.kind = 'auction' AND p.closed AND NOT p.is_closer AND NOT a.is_closer""",
)
def _(spark, sf):
    """The whole second job: persons and auctions, one-hour anchored windows."""
    from sluiceway.plans.new_sellers import new_sellers

    return new_sellers(persons(spark, sf), auctions(spark, sf), 2, HOUR_MS)


@query(
    "key_equality",
    """SELECT a.event_id AS auction_event, a.user_id, c.c_custkey, c.c_name
    FROM events a JOIN customer c ON a.user_id = c.c_custkey WHERE a.event_type = 'purchase'""",
)
def _(spark, sf):
    left = purchases(spark, sf).select("event_id", "user_id")
    right = table(spark, sf, "customer").select("c_name", "c_custkey")
    out = joins.key_equality(left, right, 1, 1)
    return out.select(
        F.col("l0").alias("auction_event"),
        F.col("l1").alias("user_id"),
        F.col("r1").alias("c_custkey"),
        F.col("r0").alias("c_name"),
    )


# --- control tables -----------------------------------------------------------------------

CHANGELOG_SQL = f"""
WITH {CONTROL_LOG_SQL},
ends AS (SELECT key, max(seq) FILTER (op = 'put') AS p, max(seq) FILTER (op = 'remove') AS r
         FROM log GROUP BY key),
pick AS (
  SELECT e.key, CASE WHEN p > coalesce(r, -1) THEN p
    ELSE (SELECT min(seq) FROM log l WHERE l.key = e.key AND op = 'putIfAbsent' AND seq > coalesce(r, -1))
    END AS at FROM ends e)
SELECT pick.key, log.value FROM pick JOIN log ON log.key = pick.key AND log.seq = pick.at
"""


@query("changelog_view", CHANGELOG_SQL)
def _(spark, sf):
    return control.changelog_view(control_log(spark, sf), ["key"])


_TOPOLOGY_ATTRIBUTES = ", ".join(
    f"max(value) FILTER (attribute = '{a}') AS {c}" for a, c in control.ATTRIBUTES.items()
)


@query(
    "topology_view",
    f"""
WITH log AS (
  SELECT event_id AS seq, concat('op-', event_type) AS tbl,
    CASE WHEN event_id % 8 = 0 THEN 'parallelism' ELSE concat(
      (['parallelism', 'task-name', 'allocation-id', 'instance-status', 'input-stream',
        'output-stream', 'instance-output', 'instance-status'])[event_id % 8 + 1], '-', user_id % 4) END AS key,
    CASE WHEN event_id % 8 = 7 THEN 'remove'
         WHEN event_id % 8 IN (3, 4, 5) AND (event_id // 8) % 3 = 0 THEN 'putIfAbsent' ELSE 'put' END AS op,
    CASE WHEN event_id % 8 = 0 THEN (event_id % 16 + 1)::VARCHAR ELSE concat('v', event_id) END AS value
  FROM events),
ends AS (SELECT tbl, key, max(seq) FILTER (op = 'put') AS p, max(seq) FILTER (op = 'remove') AS r
         FROM log GROUP BY ALL),
pick AS (
  SELECT e.tbl, e.key, CASE WHEN p > coalesce(r, -1) THEN p
    ELSE (SELECT min(seq) FROM log l WHERE l.tbl = e.tbl AND l.key = e.key AND op = 'putIfAbsent'
            AND seq > coalesce(r, -1)) END AS at FROM ends e),
view AS (SELECT pick.tbl, pick.key, log.value FROM pick JOIN log ON log.seq = pick.at),
parts AS (SELECT tbl AS operator, value,
    CASE WHEN key = 'parallelism' THEN key ELSE regexp_extract(key, '^(.*)-([0-9]+)$', 1) END AS attribute,
    CASE WHEN key = 'parallelism' THEN NULL ELSE regexp_extract(key, '^(.*)-([0-9]+)$', 2)::INTEGER END AS instance
  FROM view)
SELECT p.operator, p.instance, w.parallelism, {_TOPOLOGY_ATTRIBUTES}
FROM parts p LEFT JOIN (SELECT operator, value::INTEGER AS parallelism FROM parts WHERE instance IS NULL) w
  ON p.operator = w.operator
WHERE p.instance IS NOT NULL GROUP BY p.operator, p.instance, w.parallelism
""",
)
def _(spark, sf):
    return control.topology_view(topology_log(spark, sf))


@query(
    "mode_switch_marker",
    """SELECT event_id FROM (
      SELECT event_id, value > 10 AS t, lag(value > 10) OVER (PARTITION BY user_id % 2 ORDER BY event_id) AS b
      FROM events) WHERE t <> b""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id",
        (F.col("user_id") % 2).cast("int").alias("ch"),
        (F.col("value") > 10).cast("int").alias("channel_type"),
    )
    return control.mode_switch_marker(ev, "ch", "event_id").select("event_id")


@query(
    "debug_tap",
    """SELECT event_id, (user_id % 4)::INTEGER AS ch FROM events
    WHERE user_id % 4 IN (SELECT user_id % 4 FROM events WHERE event_type = 'error'
      GROUP BY user_id % 4
      HAVING count(*) * 4 >= (SELECT count(*) FROM events WHERE event_type = 'error'))""",
)
def _(spark, sf):
    """Rows of the instances switched to logging: those with at least their share of errors."""
    ev = table(spark, sf, "events").select(
        "event_id", "event_type", (F.col("user_id") % 4).cast("int").alias("ch")
    )
    errors = ev.where("event_type = 'error'")
    share = errors.agg(F.count(F.lit(1)) / 4).scalar()
    switches = (
        errors.groupBy(F.col("ch").alias("instance"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("output", F.when(F.col("n") >= share, "with-log").otherwise("off"))
        .withColumn("operator", F.lit("Sink"))
    )
    tapped = rows.tap_rows(rows.debug_tap(ev, "sink_rows"), "Sink", F.col("ch"), 4, switches)
    return tapped.select("event_id", "ch")


LIVE_ROUTE_SQL = """
WITH t AS (
  SELECT event_id, (user_id % 8)::INTEGER AS ch, event_type,
    CASE event_type WHEN 'signup' THEN true WHEN 'error' THEN false END AS listed FROM events),
h AS (
  SELECT *, coalesce(last_value(listed IGNORE NULLS) OVER (PARTITION BY ch ORDER BY event_id), false)::INTEGER AS kind FROM t),
r AS (
  SELECT event_id, ch, kind, lag(kind) OVER (PARTITION BY ch ORDER BY event_id) AS before
  FROM h WHERE event_type NOT IN ('signup', 'error'))
SELECT event_id, ch, kind AS channel_type, coalesce(before <> kind, false) AS switched, coalesce(before, kind) AS path FROM r
"""


def live_log(spark, sf):
    """Rows and control rows in one order: sign-ups put their channel into the table, errors remove it."""
    op = F.when(F.col("event_type") == "signup", control.PUT).when(F.col("event_type") == "error", control.REMOVE)
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 8).cast("int").alias("ch"), op.alias("op"))


@query("live_route_by_table", LIVE_ROUTE_SQL)
def _(spark, sf):
    """Every row's way by the channel table as it stood when the row went by."""
    log = live_log(spark, sf)
    routed = asof.route_by_live_table(log.where("op is null").drop("op"), log.where("op is not null"))
    return routed.withColumnRenamed("seq", "event_id")


ROW_PAUSE_SQL = """
WITH ctl AS (
  SELECT event_id AS seq, user_id % 4 AS instance, CASE WHEN event_id % 3 = 0 THEN 'Paused' ELSE 'Running' END AS status
  FROM events WHERE event_type = 'error'),
known AS (
  SELECT e.event_id, e.user_id % 4 AS instance, coalesce(c.status = 'Paused', false) AS held
  FROM events e ASOF LEFT JOIN ctl c ON e.user_id % 4 = c.instance AND e.event_id >= c.seq
  WHERE e.event_type <> 'error'),
going AS (
  SELECT k.event_id, k.instance, k.held, CASE WHEN k.held THEN r.seq ELSE k.event_id END AS release
  FROM known k ASOF LEFT JOIN (SELECT * FROM ctl WHERE status = 'Running') r
    ON k.instance = r.instance AND k.event_id <= r.seq)
SELECT *, row_number() OVER (ORDER BY release, event_id) AS position FROM going WHERE release IS NOT NULL
"""


def pausable(spark, sf):
    """Events for four instances; errors are control rows that pause or resume their instance."""
    ev = table(spark, sf, "events")
    status = F.when(F.col("event_id") % 3 == 0, PAUSED).otherwise(RUNNING)
    return ev.select(
        "event_id", (F.col("user_id") % 4).alias("instance"), (F.col("event_type") == "error").alias("is_control"),
        F.when(F.col("event_type") == "error", status).alias("status"),
    )


@query("row_pause", ROW_PAUSE_SQL)
def _(spark, sf):
    """Rows of paused instances come out where the instance goes on, ahead of later rows."""
    ev = pausable(spark, sf)
    changes = ev.where("is_control").select("instance", "event_id", "status")
    data = ev.where("not is_control").select("event_id", "instance")
    return pauses.resequenced(pauses.hold_rows(data, changes, ["instance"], "event_id"), "event_id")


@query("seeded_values")
def _(spark, sf):
    """A reserve price and a category for every index, the same whenever they are asked for."""
    idx = indexes(spark, sf)
    return idx.select("idx", seeded(F.col("idx"), 1, 10_000).alias("reserve"), seeded(F.col("idx"), 2, 10).alias("category"))
