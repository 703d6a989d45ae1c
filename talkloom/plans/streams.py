"""Registered queries over streams, files and functions of the caller, with their SQL.

The rows of a stream arrive in several portions, one after another (runs.replayed);
the query is what the stream has given by the end."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from talkloom.operators import channels, echo, slots
from talkloom.operators import rows as R
from talkloom.plans import tables as B
from talkloom.plans.registry import query
from talkloom.sources import text, wav
from talkloom.streaming import live, recording
from talkloom.streaming.runs import finished, new_folder, replayed

# --- streams ------------------------------------------------------------------------


@query(
    f"WITH RECURSIVE {B.ROWS_SQL}, e AS (SELECT c.meeting_id, c.label, c.ord * 4.0 + 6 AS captured, r.st, r.en, r.txt FROM r c JOIN r USING (meeting_id, label) WHERE r.st < c.ord * 4.0 + 6 AND r.en > c.ord * 4.0 - 2 AND r.txt <> ''), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, label ORDER BY captured, st, en) AS k FROM e), "
    "u(meeting_id, label, k, settled, until) AS (SELECT meeting_id, label, CAST(0 AS BIGINT), false, CAST(0 AS DOUBLE) FROM (SELECT DISTINCT meeting_id, label FROM n) "
    "UNION ALL SELECT u.meeting_id, u.label, n.k, n.en <= greatest(0, n.captured - 1.5) AND n.en > u.until + 0.05, CASE WHEN n.en <= greatest(0, n.captured - 1.5) AND n.en > u.until + 0.05 THEN greatest(u.until, n.en) ELSE u.until END FROM u JOIN n ON n.meeting_id = u.meeting_id AND n.label = u.label AND n.k = u.k + 1), "
    "s AS (SELECT n.*, u.settled, max(u.until) OVER (PARTITION BY n.meeting_id, n.label, n.captured) AS until FROM n JOIN u USING (meeting_id, label, k)), "
    "o AS (SELECT meeting_id, label, captured, coalesce(string_agg(txt, chr(10) ORDER BY st, en) FILTER (WHERE en > until + 0.05), '') AS shown FROM s GROUP BY ALL), "
    "c AS (SELECT *, shown <> lag(shown, 1, '') OVER (PARTITION BY meeting_id, label ORDER BY captured) AS changed FROM o) "
    "SELECT meeting_id, label, st, en, txt, 'final' AS kind FROM s WHERE settled UNION ALL "
    "SELECT meeting_id, label, st, en, txt, 'provisional' FROM s JOIN c USING (meeting_id, label, captured) WHERE changed AND en > until + 0.05"
)
def streamed_captions(spark, sf):
    r = B.rows(spark, sf)
    looks = r.select("meeting_id", "label", (F.col("ord") * 4.0 + 6).alias("captured"))
    # every look at a channel recognises what its last eight seconds hold
    heard = looks.join(r.drop("ord"), ["meeting_id", "label"]).where("st < captured and en > captured - 8")
    heard = heard.select("meeting_id", "label", "captured", "st", "en", "txt")
    return replayed(heard, "captions", F.least(F.lit(4), F.floor((F.col("captured") - 6) / 4)), lambda s: live.live_captions(s, timeout=None))


_SHOWN = "CASE (conv_id + turn) % 4 WHEN 0 THEN 'status' WHEN 2 THEN 'result' ELSE 'hypothesis' END"


@query(
    f"WITH {B.SAID_TWICE_SQL}, e AS (SELECT conv_id AS meeting_id, turn AS ord, {_SHOWN} AS type, text, trim(coalesce(text, '')) <> '' AS said FROM d), "
    "x AS (SELECT *, last_value(CASE WHEN type = 'result' AND said THEN text END IGNORE NULLS) OVER w AS result, bool_or(type <> 'status' AND said) OVER w AS anything FROM e WINDOW w AS (PARTITION BY meeting_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "c AS (SELECT meeting_id, ord, CASE type WHEN 'status' THEN '...' ELSE text END AS txt, CASE type WHEN 'result' THEN 'final' WHEN 'hypothesis' THEN 'provisional' ELSE type END AS kind FROM x "
    "WHERE (type = 'result' AND said) OR (type = 'hypothesis' AND said AND text IS DISTINCT FROM result) OR (type = 'status' AND NOT coalesce(anything, false))) "
    f"SELECT meeting_id, '{R.MIC}' AS label, CAST(ord AS INTEGER) AS ord, txt, kind FROM c QUALIFY kind = 'final' OR txt IS DISTINCT FROM lag(txt) OVER (PARTITION BY meeting_id ORDER BY ord)"
)
def streamed_text(spark, sf):
    events = B.said_twice(spark, sf).select(F.col("conv_id").alias("meeting_id"), F.lit(R.MIC).alias("label"), F.col("turn").cast("int").alias("ord"), F.expr(_SHOWN).alias("type"), "text")
    return replayed(events, "shown", F.least(F.lit(4), F.floor(F.col("ord") / 2)), live.shown_text)


@query("WITH s AS (SELECT CAST(user_id AS VARCHAR) AS host, event_id AS moment, [event_type, 'm' || (event_id % 3)] AS m FROM events), p AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY host ORDER BY moment), CAST([] AS VARCHAR[])) AS b FROM s) SELECT host, moment, unnest(list_filter(m, lambda x: NOT list_contains(b, x))) AS member FROM p")
def streamed_members(spark, sf):
    snapshots = B.table(spark, sf, "events").selectExpr("cast(user_id as string) AS host", "event_id AS at", "array(event_type, concat('m', event_id % 3)) AS members")
    return replayed(snapshots, "members", F.least(F.lit(4), F.floor(F.col("at") / 180)), live.newly_running).withColumnRenamed("at", "moment")


#: Blocks arrive in order, but every seventh a portion late: that is late for good
#: where a later one of its key was taken before.
_ARRIVAL = "least(frame_ix // 180, 4) + CASE WHEN frame_ix % 7 = 0 THEN 1 ELSE 0 END"
_ON_TIME_SQL = (
    f"{B.BLOCKS_SQL}, v AS (SELECT *, {_ARRIVAL} AS arrival FROM b), "
    "i AS (SELECT * FROM v QUALIFY frame_ix > coalesce(max(frame_ix) OVER (PARTITION BY {key} ORDER BY arrival RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1))"
)


def _arrival():
    return F.expr(_ARRIVAL.replace("//", "div"))


@query(
    f"WITH {_ON_TIME_SQL.format(key='meeting_id, label')}, x AS (SELECT meeting_id, label, frame_ix, CAST(unnest(samples) AS FLOAT)::DOUBLE AS x, unnest([0, 1]) AS k FROM i), "
    "r AS (SELECT *, row_number() OVER w AS n, sqrt(avg(x * x) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS rms FROM x WINDOW w AS (PARTITION BY meeting_id, label ORDER BY frame_ix, k)) "
    "SELECT meeting_id, label, min(n) / 16.0::DOUBLE AS captured FROM r WHERE k = 1 AND n >= 0.15 * 16 AND rms >= 0.01 GROUP BY ALL"
)
def streamed_activity(spark, sf):
    return replayed(B.blocks(spark, sf), "activity", _arrival(), lambda s: recording.first_sound(s, rate=16))


@query(f"WITH {B.BLOCKS_SQL}, k AS (SELECT *, sum(len(samples)) OVER (PARTITION BY meeting_id, label ORDER BY frame_ix DESC) AS held, sum(len(samples)) OVER (PARTITION BY meeting_id, label) AS captured FROM b) "
       "SELECT meeting_id, label, CAST(any_value(captured) AS BIGINT) AS captured, CAST(max(held) AS BIGINT) AS held, min(frame_ix) AS oldest, max(frame_ix) AS newest FROM k WHERE held <= 30 GROUP BY meeting_id, label")
def streamed_buffer(spark, sf):
    states = replayed(B.blocks(spark, sf), "buffer", _arrival(), lambda s: recording.buffered(s, rate=1))
    last = states.groupBy("meeting_id", "label").agg(F.max_by(F.struct("captured", "held", "oldest", "newest"), "captured").alias("s"))
    return last.select("meeting_id", "label", "s.*")


def _loud_seconds(samples):
    """Stands in for a recogniser: a second at a time, four samples, heard where loud."""
    return [(k / 4, (k + 4) / 4, f"{(abs(samples[k : k + 4]) >= _LOUD).sum()} loud") for k in range(0, len(samples), 4) if (abs(samples[k : k + 4]) >= _LOUD).any()]


_LOUD = np.float32(0.05)


@query(
    f"WITH RECURSIVE {_ON_TIME_SQL.format(key='meeting_id')}, a AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, label ORDER BY frame_ix) AS nth FROM i), "
    # frames are taken once a later one has come; a look is due where five more samples are in the longest channel
    f"f AS (SELECT *, max(frame_ix) OVER (PARTITION BY meeting_id) AS newest, 2 * count(*) FILTER (WHERE label = '{R.MIC}') OVER o AS mic, 2 * count(*) FILTER (WHERE label = '{R.SYSTEM}') OVER o AS sys FROM i WINDOW o AS (PARTITION BY meeting_id ORDER BY frame_ix)), "
    "h AS (SELECT meeting_id, frame_ix AS look, mic, sys FROM (SELECT *, greatest(mic, sys) // 5 AS hop, lag(greatest(mic, sys) // 5, 1, 0) OVER (PARTITION BY meeting_id ORDER BY frame_ix) AS before FROM f) WHERE hop > before AND frame_ix < newest), "
    f"c AS (SELECT h.meeting_id, look, label, CASE label WHEN '{R.MIC}' THEN mic ELSE sys END AS captured, nth, samples FROM h JOIN a ON a.meeting_id = h.meeting_id AND a.frame_ix <= look), "
    "l AS (SELECT meeting_id, look, label, captured, sqrt(avg(x * x)) AS rms FROM (SELECT meeting_id, look, label, captured, CAST(unnest(samples) AS FLOAT)::DOUBLE AS x FROM c WHERE 2 * nth > captured - 12) GROUP BY ALL HAVING captured >= 0.8 * 4 AND sqrt(avg(x * x)) >= 0.001), "
    f"p AS (SELECT *, max(rms) FILTER (WHERE label = '{R.MIC}') OVER w AS m, max(rms) FILTER (WHERE label = '{R.SYSTEM}') OVER w AS s FROM l WINDOW w AS (PARTITION BY meeting_id, look)), "
    f"g AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, look ORDER BY label <> '{R.SYSTEM}', rms DESC) AS place FROM p WHERE m IS NULL OR s IS NULL OR CASE WHEN s >= m * 0.75 THEN label = '{R.SYSTEM}' WHEN m >= s * 1.6 THEN label = '{R.MIC}' ELSE true END), "
    "w AS (SELECT meeting_id, look, label, place, captured, flatten(list(samples ORDER BY nth)) AS x FROM g JOIN c USING (meeting_id, look, label, captured) WHERE 2 * nth > captured - 32 GROUP BY ALL), "
    "e AS (SELECT *, (captured - len(x)) / 4.0::DOUBLE AS begin, unnest(range(0, len(x), 4)) AS k FROM w), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, label ORDER BY look, st) AS j FROM (SELECT meeting_id, look, label, place, captured / 4.0::DOUBLE AS captured, begin + k / 4.0::DOUBLE AS st, begin + (k + 4) / 4.0::DOUBLE AS en, len(list_filter(x[k + 1:k + 4], lambda v: abs(CAST(v AS FLOAT)) >= CAST(0.05 AS FLOAT))) AS loud FROM e) WHERE loud > 0), "
    "u(meeting_id, label, j, settled, until) AS (SELECT meeting_id, label, CAST(0 AS BIGINT), false, CAST(0 AS DOUBLE) FROM (SELECT DISTINCT meeting_id, label FROM n) "
    "UNION ALL SELECT u.meeting_id, u.label, n.j, n.en <= greatest(0, n.captured - 1.5) AND n.en > u.until + 0.05, CASE WHEN n.en <= greatest(0, n.captured - 1.5) AND n.en > u.until + 0.05 THEN greatest(u.until, n.en) ELSE u.until END FROM u JOIN n ON n.meeting_id = u.meeting_id AND n.label = u.label AND n.j = u.j + 1), "
    "t AS (SELECT n.*, n.loud || ' loud' AS txt, u.settled, max(u.until) OVER (PARTITION BY n.meeting_id, n.label, n.look) AS until FROM n JOIN u USING (meeting_id, label, j)), "
    "q AS (SELECT g.meeting_id, g.look, coalesce(string_agg(t.label || ': ' || txt, chr(10) ORDER BY g.place, st) FILTER (WHERE en > until + 0.05), '') AS shown FROM g LEFT JOIN t USING (meeting_id, look, label) GROUP BY ALL), "
    "d AS (SELECT *, shown <> lag(shown, 1, '') OVER (PARTITION BY meeting_id ORDER BY look) AS changed FROM q) "
    "SELECT meeting_id, label, captured, st, en, txt, 'final' AS kind FROM t WHERE settled UNION ALL SELECT t.meeting_id, t.label, captured, st, en, txt, 'provisional' FROM t JOIN d ON d.meeting_id = t.meeting_id AND d.look = t.look WHERE changed AND en > until + 0.05"
)
def streamed_transcription(spark, sf):
    # samples in, captions out: looks every 5 samples at 4 a second, each over 8 seconds
    return replayed(B.blocks(spark, sf), "transcription", _arrival(), lambda s: recording.live_transcription(s, _loud_seconds, rate=4, slack=1))


#: Portions of six days; every fortieth event of the first six comes last, when its
#: windows are long closed.
_DAY = "CAST(epoch_us(ts) // 86400000000 - 19723 AS INTEGER)"


@query(
    f"WITH a AS (SELECT *, {_DAY} < 6 AND event_id % 40 = 0 AS late FROM events), "
    "e AS (SELECT epoch_us(ts) // 7200000000 - k AS tick, user_id AS meeting_id, event_type AS label, value / 100 AS x, max(epoch_us(ts)) OVER () AS newest FROM a, (VALUES (0), (1), (2)) v(k) WHERE NOT late) "
    "SELECT tick * 7200 AS start_s, meeting_id, label, round(sqrt(avg(x * x)), 6) AS rms FROM e WHERE (tick + 3) * 7200000000 <= newest - 3600000000 GROUP BY ALL"
)
def streamed_levels(spark, sf):
    blocks = B.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("meeting_id"), F.col("event_type").alias("label"), F.array(F.col("value") / 100).alias("samples"))
    day = F.floor(F.unix_micros("ts") / 86_400_000_000) - 19_723
    arrival = F.when((day < 6) & (F.col("event_id") % 40 == 0), 5).otherwise(F.least(F.lit(4), F.floor(day / 6)))
    levels = replayed(blocks, "levels", arrival, lambda s: live.windowed_levels(s, window="6 hours", slide="2 hours", delay="1 hour"))
    return levels.select(F.unix_seconds("start").alias("start_s"), "meeting_id", "label", F.round("rms", 6).alias("rms"))


@query(f"WITH {B.BLOCKS_SQL} SELECT meeting_id, label, frame_ix, samples[1] AS first_sample, samples[2] AS second_sample FROM b")
def spooled_blocks(spark, sf):
    kept = replayed(B.blocks(spark, sf), "spool", _arrival(), lambda stream: stream)
    return kept.select("meeting_id", "label", "frame_ix", F.get("samples", F.lit(0)).alias("first_sample"), F.get("samples", F.lit(1)).alias("second_sample"))


@query(f"WITH {B.BLOCKS_SQL} SELECT meeting_id, label, frame_ix FROM b QUALIFY sum(len(samples)) OVER (PARTITION BY meeting_id, label ORDER BY frame_ix DESC) <= 30")
def buffered_blocks(spark, sf):
    return live.ring(B.blocks(spark, sf), rate=1).select("meeting_id", "label", "frame_ix")


@query(
    "SELECT CASE WHEN role = 'user' THEN '{mic}' ELSE '{system}' END AS label, conv_id * 1000 + turn AS ts, kind, CASE kind WHEN 'error' THEN 'e' || turn WHEN 'status' THEN '...' ELSE trim(text) END AS txt "
    "FROM (SELECT *, CASE (conv_id + turn) % 5 WHEN 0 THEN 'status' WHEN 1 THEN 'provisional' WHEN 2 THEN 'error' ELSE 'final' END AS kind FROM conversations WHERE (conv_id * 3 + turn) % 7 <> 0) WHERE kind IN ('status', 'error') OR trim(coalesce(text, '')) <> ''".format(mic=R.MIC, system=R.SYSTEM)
)
def recogniser_streams(spark, sf):
    # the recogniser's lines, every seventh broken: those go, as they would in a live stream
    event = F.struct(F.expr("CASE (conv_id + turn) % 5 WHEN 0 THEN 'status' WHEN 1 THEN 'hypothesis' WHEN 2 THEN 'error' ELSE 'result' END").alias("type"), "text", F.concat(F.lit("e"), "turn").alias("error"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ts"))
    line = F.when(F.expr("(conv_id * 3 + turn) % 7 = 0"), "{broken").otherwise(F.to_json(event))
    said = B.table(spark, sf, "conversations").select("role", line.alias("value"))
    folders = []
    for mine in (F.col("role") == "user", ~F.col("role").eqNullSafe("user")):
        folders.append(new_folder(spark, "lines"))
        said.where(mine).select("value").write.text(folders[-1])
    both = text.two_sources(*[text.stream_events(spark, f) for f in folders])
    return finished(text.dispatched(both), "recognised").select("label", "ts", "kind", "txt")


# --- files --------------------------------------------------------------------------

_SIDE = "CASE WHEN event_type IN ('click', 'view') THEN 'mic' ELSE 'system' END"


@query(
    f"WITH b AS (SELECT user_id AS meeting_id, {_SIDE} AS label, unnest([value / (10 + 90 * (user_id % 4)), - value / (20 + 2000 * (user_id % 3))]) AS x FROM events) "
    "SELECT meeting_id, label, CAST(16000 AS INTEGER) AS rate, count(*) AS n, CAST(sum(trunc(least(32767, greatest(-32768, x * 32767)))) AS BIGINT) AS total FROM b GROUP BY ALL"
)
def wav_files(spark, sf):
    side = F.when(F.col("label") == R.MIC, "mic").otherwise("system")
    folder = new_folder(spark, "wav")
    wav.write_channels(B.blocks(spark, sf).withColumn("label", side), folder)
    if failed := wav.errors_of(folder):
        raise OSError(f"{len(failed)} channels were not written to {folder}: {failed}")
    name = F.regexp_extract("path", r"([^/]+)\.wav$", 1)
    read = spark.read.format("talkloom_wav").option("split", 1 << 20).load(folder)
    blocks = read.withColumn("meeting_id", F.substring_index(name, "_", 1).cast("long")).withColumn("label", F.substring_index(name, "_", -1))
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda s, x: s + (x * 32768).cast("long"))
    return blocks.groupBy("meeting_id", "label", "rate").agg(F.sum(F.size("samples")).cast("long").alias("n"), F.sum(total).alias("total"))


@query(
    "WITH o AS (SELECT o_orderkey AS k, o_orderpriority || ', ' || o_orderkey AS title, CASE o_orderkey % 4 WHEN 2 THEN o_orderdate ELSE o_orderdate + to_hours(CAST(o_orderkey % 24 - CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 9 END AS BIGINT)) END AS s FROM orders) "
    "SELECT title, CAST(epoch(s) AS BIGINT) AS start_s, CAST(epoch(s) AS BIGINT) + CASE WHEN k % 3 = 0 OR k % 4 = 2 THEN 3600 ELSE 7200 END AS end_s FROM o"
)
def calendar_files(spark, sf):
    hour = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=F.col("o_orderkey") % 24)
    stamp = lambda at: F.date_format(at, "yyyyMMdd'T'HHmmss")
    kind = F.col("o_orderkey") % 4
    form = lambda at: F.when(kind == 0, F.concat(F.lit(":"), stamp(at), F.lit("Z"))).when(kind == 1, F.concat(F.lit(";TZID=Tokyo Standard Time:"), stamp(at))).when(kind == 2, F.concat(F.lit(";VALUE=DATE:"), F.date_format("o_orderdate", "yyyyMMdd"))).otherwise(F.concat(F.lit(";TZID=Asia/Tokyo:"), stamp(at)))
    end = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("DTEND"), form(hour + F.expr("interval 2 hours")), F.lit("\r\n"))).otherwise("")
    file = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:"), "o_orderpriority", F.lit("\r\n \\, "), F.col("o_orderkey").cast("string"), F.lit("\r\nDTSTART"), form(hour), F.lit("\r\n"), end, F.lit("END:VEVENT\r\nEND:VCALENDAR\r\n"))
    texts = B.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), file.alias("text"))
    return text.ics_events(texts).select("title", F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"))


# --- channels and functions of the caller ---------------------------------------------


@query(
    f"WITH {B.BLOCKS_SQL}, w AS (SELECT meeting_id, label, flatten(list(samples ORDER BY frame_ix)) AS x FROM b GROUP BY ALL), t AS (SELECT meeting_id, label, len(x) / 10.0::DOUBLE AS seconds, unnest(x[-30:]) AS x FROM w) "
    "SELECT meeting_id, label, round(sqrt(avg(x * x)), 6) AS rms, seconds FROM t GROUP BY meeting_id, label, seconds HAVING seconds >= 0.8 AND sqrt(avg(x * x)) >= 0.001"
)
def channels_heard_lately(spark, sf):
    return channels.heard_lately(B.blocks(spark, sf), rate=10).select("meeting_id", "label", F.round("rms", 6).alias("rms"), "seconds")


@query(f"WITH {B.ROWS_SQL} SELECT meeting_id, ord, st, label, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY st, label, ord) AS INTEGER) AS place FROM r")
def rows_in_time_order(spark, sf):
    return R.in_time_order(B.rows(spark, sf)).select("meeting_id", "ord", "st", "label", "place")


@query(
    f"WITH {B.BLOCKS_SQL}, x AS (SELECT meeting_id, label, frame_ix, unnest(samples) AS x, unnest([0, 1]) AS k FROM b), p AS (SELECT meeting_id, label, CAST(x AS FLOAT)::DOUBLE AS x, row_number() OVER (PARTITION BY meeting_id, label ORDER BY frame_ix, k) - 1 AS t FROM x), "
    "n AS (SELECT meeting_id, min(c) AS n FROM (SELECT meeting_id, label, count(*) AS c FROM p GROUP BY ALL) GROUP BY meeting_id HAVING count(*) = 2), "
    "z AS (SELECT meeting_id, label, n, t, x - avg(x) OVER (PARTITION BY meeting_id, label) AS x FROM p JOIN n USING (meeting_id) WHERE t < n), "
    f"c AS (SELECT m.meeting_id, m.t - s.t AS lag, sum(m.x * s.x) AS x FROM z m JOIN z s ON s.meeting_id = m.meeting_id AND m.label = '{R.MIC}' AND s.label = '{R.SYSTEM}' AND m.t - s.t BETWEEN -20 AND 20 WHERE m.n >= 8 GROUP BY ALL), "
    "l AS (SELECT meeting_id, lag FROM c QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY abs(x) DESC, lag) = 1) SELECT meeting_id, CAST(n AS BIGINT) AS n, CAST(coalesce(lag, 0) AS INTEGER) AS lag FROM n LEFT JOIN l USING (meeting_id)"
)
def channel_delays(spark, sf):
    return echo.delays(B.blocks(spark, sf), max_lag=20, least=8, width=32)


@query()
def echo_cancelled(spark, sf):
    # frames of 16 samples, segments of 4 of them: tests hold the numbers against whole channels
    cleaned = echo.cancel_echo_blocks(B.blocks(spark, sf), frame=16, hop=4, max_lag=20, least=8, frames=4, lag_segment=64)
    square = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return cleaned.groupBy("meeting_id", "label").agg(F.sum(F.size("samples")).cast("long").alias("n"), F.round(F.sum(square), 4).alias("energy"))


def _whole(spark, sf):
    parts = F.array_sort(F.collect_list(F.struct("frame_ix", "samples")))
    return B.blocks(spark, sf).groupBy("meeting_id", "label").agg(F.flatten(F.transform(parts, lambda p: p["samples"])).alias("samples"))


@query(
    f"WITH {B.BLOCKS_SQL}, w AS (SELECT meeting_id, label, flatten(list(samples ORDER BY frame_ix)) AS x FROM b GROUP BY ALL), "
    "k AS (SELECT meeting_id, label, x, unnest(range(0, greatest(1, CAST(ceil((len(x) - 1) / 0.82::DOUBLE) AS BIGINT)))) AS k FROM w), "
    "p AS (SELECT meeting_id, label, k, CAST(floor(k * 0.82::DOUBLE) AS BIGINT) AS low, k * 0.82::DOUBLE - floor(k * 0.82::DOUBLE) AS part, x FROM k) "
    "SELECT meeting_id, label, k AS at, round(CAST(x[low + 1] * (1 - part) + coalesce(x[low + 2], x[low + 1]) * part AS FLOAT)::DOUBLE, 6) AS sample FROM p"
)
def pitch_shifted(spark, sf):
    shifted = _whole(spark, sf).select("meeting_id", "label", F.posexplode(channels.pitch_shifted(F.col("samples"))).alias("at", "sample"))
    return shifted.select("meeting_id", "label", F.col("at").cast("long").alias("at"), F.round(F.col("sample").cast("double"), 6).alias("sample"))


def _loud(samples):
    """Stands in for a recogniser: eight samples at a time, heard where loud."""
    return [(k / 16, (k + 8) / 16, " loud " if abs(samples[k : k + 8]).max() >= 0.05 else " ") for k in range(0, len(samples), 8)]


def _by_turns(samples):
    """Stands in for a speaker model: two take turns; short recordings are refused."""
    if len(samples) < 20:
        raise ValueError("too short")
    return [(k / 16, (k + 8) / 16, k // 8 % 2) for k in range(0, len(samples), 8)]


_CUT_SQL = f"WITH {B.BLOCKS_SQL}, w AS (SELECT meeting_id, label, flatten(list(samples ORDER BY frame_ix)) AS x FROM b GROUP BY ALL), p AS (SELECT meeting_id, label, len(x) AS n, unnest(range(0, len(x), 8)) AS k, x FROM w) "


@query(_CUT_SQL + ", h AS (SELECT meeting_id, label, k FROM p WHERE list_max(list_transform(x[k + 1:k + 8], lambda v: abs(v))) >= 0.05) SELECT meeting_id, label, CAST(row_number() OVER (PARTITION BY meeting_id, label ORDER BY k) - 1 AS INTEGER) AS ord, k / 16.0::DOUBLE AS st, (k + 8) / 16.0::DOUBLE AS en, 'loud' AS txt FROM h")
def transcribed_rows(spark, sf):
    return slots.transcribed(_whole(spark, sf), _loud)


@query(_CUT_SQL + "SELECT meeting_id, label, CAST(k // 8 AS INTEGER) AS turn_ord, k / 16.0::DOUBLE AS ts, (k + 8) / 16.0::DOUBLE AS te, CAST(k // 8 % 2 AS INTEGER) AS spk FROM p WHERE n >= 20")
def diarized_turns(spark, sf):
    return slots.diarized(_whole(spark, sf), _by_turns)
