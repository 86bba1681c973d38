"""The registered query of each operator, with its DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loomlog import model
from loomlog.functions import text as T
from loomlog.operators import filters, latest, lines, modules, order, render, series, signals, text_index
from loomlog.operators.filters import LogFilter
from loomlog.plans import pipeline, tables
from loomlog.sources import capture, session_log
from loomlog.sources.log_store import LogStore
from loomlog.sources.stream import stream_chunks
from loomlog.storage import mark, names_in, scratch
from loomlog.streaming.fan_out import FanOut, fan_out
from loomlog.streaming.registry import Registry
from loomlog.streaming.stateful import rolled_points, rolling_points_stream, staleness_stream, state_store

#: The log table in SQL; every oracle starts with it.
LOGS = """logs as (
  select event_id + 1 as seq, epoch_us(ts) * 1000 as timestamp_ns, concat('dev', cast(user_id % 7 as varchar)) as device, concat('app.', event_type) as module,
    case event_type when 'error' then 40 when 'purchase' then 30 when 'signup' then 20 when 'click' then 10 else 5 end as level,
    concat('cents=', cast(cast(round(value * 100) as bigint) as varchar), ', k=', regexp_extract(props, '[0-9]+', 0), ';') as message
  from events)"""
LETTER = "case level when 40 then 'E' when 30 then 'W' when 20 then 'I' when 10 then 'D' else 'T' end"
KV = """kv as (
  select seq, pos - 1 as kv_pos, timestamp_ns, level, 'kv' as device, concat(module, '.', lower(split_part(token, '=', 1))) as module,
    rtrim(substr(token, strpos(token, '=') + 1), ',;') as message
  from (select *, unnest(string_split(message, ' ')) as token, unnest(range(1, len(string_split(message, ' ')) + 1)) as pos from logs)
  where contains(token, '=') and split_part(token, '=', 1) <> '' and rtrim(substr(token, strpos(token, '=') + 1), ',;') <> '')"""
NUMBERS = r"list_transform(regexp_extract_all(message, '[-+]?\d*\.\d+(?:[eE][-+]?\d+)?|[-+]?\d+'), lambda x: cast(x as double))"
SERIES = f"""numbers as (select device, module, seq, timestamp_ns, {NUMBERS} as n from logs),
first as (select device, module, arg_min(len(n), seq) as channels from numbers where len(n) > 0 group by all),
series as (
  select device, module, seq, timestamp_ns, unnest(range(0, least(len(n), channels)))::int as channel, unnest(n[1:channels]) as value
  from numbers join first using (device, module) where len(n) > 0)"""
LATEST = "latest as (select device, module, max(seq) as seq, arg_max(timestamp_ns, seq) as timestamp_ns, arg_max(level, seq) as level, arg_max(message, seq) as message from logs group by device, module)"
KNOWN = """known as (
  select device, module, min(first_seq) as first_seq from (
    select device, unnest(['', 'app', module]) as module, seq as first_seq from logs) group by device, module)"""
FRAMES = """frames as (
  select event_id as frame_seq, epoch_us(ts) * 1000 as timestamp_ns, (256 + event_id % 3)::int as arbitration_id, events.user_id & 65535 as user_id, round(value * 100)::bigint & 4294967295 as cents,
    cast(regexp_extract(props, '[0-9]+', 0) as int) & 255 as k, events.user_id % 100 as neg from events),
hexed as (select *, lower(printf('%02X%02X%08X%02X%02X', user_id % 256, user_id // 256, cents, k, (256 - neg) % 256)) as hex from frames)"""

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None, *tables_sql: str):
    """Registers a function of (spark, sf_dir); its SQL is given the log table and ``tables_sql`` as CTEs."""

    def put(function):
        QUERIES[name] = (function, f"with {', '.join((LOGS, *tables_sql))} {sql}" if sql else None)
        return function

    return put


def _folder(spark: SparkSession) -> str:
    """A new folder that a stream can read before files drop into it."""
    path = scratch(spark, "dropped")
    mark(spark, f"{path}/_begun")
    return path


def _in_thirds(rows: DataFrame, path: str) -> int:
    """Writes rows as they are dealt, in six files at least, and returns how many of the files make three batches of a stream."""
    rows.write.option("maxRecordsPerFile", max(1, rows.count() // 6)).parquet(path)
    return max(1, -(-sum(x.startswith("part-") for x in names_in(rows.sparkSession, path)) // 3))


def _in_turn(parts: list[DataFrame], path: str, writer: DataStreamWriter) -> None:
    """Parts drop into the folder that a stream reads, and the stream takes each to its end, as one batch, before the next one drops: batches do not depend on the number of files."""
    for part in parts:
        part.write.mode("append").parquet(path)
        writer.trigger(availableNow=True).start().awaitTermination()


# sources and rows -------------------------------------------------------------------------------------------------------


@query("s3_read_log_text", "select seq, timestamp_ns, device, module, level, message from logs")
def _(spark, d):
    rows = model.with_ts(tables.logs(spark, d)).select("seq", render.session_line().alias("line"))
    return session_log.parse_session_lines(rows).where("_error is null").drop("_error")


@query("s1_read_raw_capture", """select cast(doc_id as varchar) as source, i as chunk_seq, doc_id * 1000000 + i as timestamp_ns, 1 as kind, substr(t, i * 64 + 1, 64) as piece, null::bigint as bad_offset
  from (select doc_id, t, unnest(range(0, (length(t) - 1) // 64 + 1)) as i from texts)
  union all select cast(doc_id as varchar), (length(t) - 1) // 64 + 1, null, null, null, strlen(t) + 16 * ((length(t) - 1) // 64 + 1) from texts""",
  "texts as (select doc_id, concat(coalesce(text, ''), chr(10)) as t from documents)")
def _(spark, d):
    out = capture.parse_captures(tables.captures(spark, d))
    return out.select("source", "chunk_seq", "timestamp_ns", "kind", F.col("payload").cast("string").alias("piece"), "bad_offset")


@query("s2_read_byte_file", """select cast(doc_id as varchar) as source, i as chunk_seq, 5 + i * 1000000000 // 48000 as timestamp_ns, substr(h, (i % n) * 128 + 1, 128) as hex
  from (select *, unnest(range(0, 2 * n)) as i from (select doc_id, h, (length(h) + 127) // 128 as n from (select doc_id, hex(encode(text)) as h from documents where text <> '')))""")  # fmt: skip
def _(spark, d):
    files = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("source"), F.encode("text", "UTF-8").alias("content"))
    return capture.cut_bytes(files, 64, 48_000, 5, 2).select("source", "chunk_seq", "timestamp_ns", F.hex("payload").alias("hex"))


@query("s5_records_to_logs", """select seq, timestamp_ns, 'rec' as device, case when level = 5 and seq % 2 = 0 then '_unknown' else module end as module,
  case when level = 5 and seq % 2 = 0 then 40 else level end as level, message from logs""")  # fmt: skip
def _(spark, d):
    records = tables.logs(spark, d).selectExpr("seq", "timestamp_ns as created_ns", "case when level = 5 and seq % 2 = 0 then 25 else level end as levelno", "upper(module) as name", "message as msg")
    return lines.route_errors(lines.records_to_logs(records, "Rec"))


@query("s6_rx_dump", """select frame_seq, timestamp_ns, 'bus' as device, '_reader.rx' as module, 5 as level,
  concat('ID: ', upper(lpad(to_hex(arbitration_id), 4, '0')), ' DLC: 8 DATA: ', upper(hex)) as message from hexed""", FRAMES)  # fmt: skip
def _(spark, d):
    return capture.rx_dump(tables.frames(spark, d), "bus")


@query("p1_split_lines", """select cast(doc_id as varchar) as source, i - 1 as line_no, parts[i] as line,
    doc_id * 1000000 + (list_sum(list_transform(parts[1:i], lambda x: length(x))) + i - 1)::bigint // 64 as timestamp_ns
  from numbered where parts[i] <> ''""", """texts as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
numbered as (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from texts)""")  # fmt: skip
def _(spark, d):
    return lines.split_lines(tables.chunks(spark, d)).select("source", "line_no", F.col("raw").cast("string").alias("line"), "timestamp_ns")


@query("p2_printable", r"select doc_id, regexp_replace(text, '[^\x20-\x7E\x1B]', '', 'g') as line from documents")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.decode(T.printable(F.encode("text", "UTF-8")), "UTF-8").alias("line"))


@query("p3_decode_bytes", r"select doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') as line from documents")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.decode_bytes(F.encode("text", "UTF-8"), "ascii", "ignore").alias("line"))


@query("p4_ansi_filter", "select seq, message as line from logs")
def _(spark, d):
    return tables.logs(spark, d).select("seq", T.ansi_filter(F.concat(F.lit("\x1b[1;31m"), "message", F.lit("\x1b[0m"))).alias("line"))


@query("p5_string_replace", "select seq, replace(message, ', ', ' | ') as line from logs")
def _(spark, d):
    return tables.logs(spark, d).select("seq", T.string_replace(F.col("message"), ", ", " | ").alias("line"))


@query("p6_whitespace_normalize", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as line from documents")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.whitespace_normalize(F.col("text")).alias("line"))


@query("p7_path_normalize", "select seq, concat('I (', seq, ') ', device, '_unit.', replace(module, 'app.', ''), ' ', message) as line from logs")
def _(spark, d):
    line = F.concat(F.lit("I  ("), F.col("seq").cast("string"), F.lit(")   ["), F.upper("device"), F.lit(" UNIT]: "), F.upper(F.replace("module", F.lit("app."))), F.lit(":  "), "message")
    return tables.logs(spark, d).select("seq", T.path_normalize(line, 2).alias("line"))


@query("p8_fixed_width_normalize", "select seq, concat(replace(module, 'app.', ''), '_', device, ': ', message) as line from logs")
def _(spark, d):
    head = F.rpad(F.concat(F.initcap(F.replace("module", F.lit("app."))), F.lit(" / "), "device"), 25, " ")
    return tables.logs(spark, d).select("seq", T.fixed_width_normalize(F.concat(head, F.lit("  "), "message")).alias("line"))


@query("p9_transform_steps", "select seq, concat('v', replace(message, ';', '')) as line from logs")
def _(spark, d):
    steps = [{"step": "printable"}, {"step": "decode", "encoding": "utf-8"}, {"step": "ansi_filter"}, {"step": "strip", "chars": "; "}, {"step": "regex_replace", "pattern": "^(c)", "replace": r"v\1"}]
    raw = F.encode(F.concat(F.lit("\x1b[1m  "), "message", F.lit("\t\r")), "UTF-8")
    return tables.logs(spark, d).select("seq", pipeline.transform_steps(raw, steps, "bytes").alias("line"))


@pipeline.register_step("first_words")
def first_words(text, n: int):
    """A user's step: the first n words."""
    return F.array_join(F.slice(F.split(text, " "), F.lit(1), F.lit(n)), " ")


@query("u1_register_step", "select seq, upper(array_to_string(string_split(message, ' ')[1:1], ' ')) as line from logs")
def _(spark, d):
    steps = [{"step": "First_Words", "n": 1}, {"step": "regex_replace", "pattern": "cents", "replace": "CENTS"}]
    return tables.logs(spark, d).select("seq", pipeline.transform_steps(F.col("message"), steps).alias("line"))


@query("p10_strip", "select seq, trim(message, ';ces') as line from logs")
def _(spark, d):
    return tables.logs(spark, d).select("seq", T.strip(F.col("message"), ";ces").alias("line"))


@query("p11_map_level", "select seq, case level when 5 then null when 10 then 10 when 20 then 20 when 30 then 30 when 40 then 40 end as level from logs")
def _(spark, d):
    text = F.element_at(F.create_map(*[F.lit(x) for x in (5, "<trc>", 10, "<dbg>", 20, "<inf>", 30, "<wrn>", 40, "<err>")]), F.col("level"))
    return tables.logs(spark, d).select("seq", T.map_level(text, "zephyr").alias("level"))


@query("p12_parse_line", "select seq, timestamp_ns // 1000000 * 1000000 as timestamp_ns, device, module, level, message from logs")
def _(spark, d):
    rows = tables.raw_lines(spark, d)
    return lines.parse_line(rows, F.col("device"), time_index=0, level_index=1, module_index=2, message_index=3).where("_error is null").drop("_error")


@query("p13_route_errors", f"""select seq, timestamp_ns, device, case when level = 40 then '_unknown' else module end as module, level,
  case when level = 40 then concat('? ', module, ': ', message) else message end as message from (select *, {LETTER} as l from logs)""")  # fmt: skip
def _(spark, d):
    rows = tables.raw_lines(spark, d).withColumn("line", F.regexp_replace(F.regexp_replace("line", r"^\S+ ", ""), "^E ", "? "))
    return lines.route_errors(lines.parse_line(rows, F.col("device"), level_index=0, module_index=1, message_index=2))


@query("p14_normalize_module", "select seq, lower(device) as device, case when level = 5 then null else module end as module from logs")
def _(spark, d):
    name = F.when(F.col("level") == 5, F.concat("module", F.lit(" x"))).otherwise(F.upper("module"))
    return tables.logs(spark, d).select("seq", T.normalize_device(F.upper("device")).alias("device"), T.normalize_module(name).alias("module"))


@query("p15_default_rows", f"""select seq, timestamp_ns, device, 'log' as module, 20 as level, concat('[', timestamp_ns // 1000000000, '.', lpad(cast((timestamp_ns // 1000000) % 1000 as varchar), 3, '0'), '] ', {LETTER}, ' ', module, ': ', message) as message from logs""")
def _(spark, d):
    return lines.default_rows(tables.raw_lines(spark, d), F.col("device"))


@query("p16_extract_key_values", "select * from kv", KV)
def _(spark, d):
    return lines.extract_key_values(tables.logs(spark, d), "kv")


@query("p17_extract_numbers", f"select seq, unnest(range(0, len(n)))::int as pos, unnest(n) as value from (select seq, {NUMBERS} as n from logs)")
def _(spark, d):
    return tables.logs(spark, d).select("seq", F.posexplode(T.extract_numbers(F.col("message"))).alias("pos", "value"))


# frames ----------------------------------------------------------------------------------------------------------------

_DECODED = """decoded as (
  select frame_seq, timestamp_ns, 'user' as signal, user_id::double as value, cast(user_id as varchar) as text from hexed where arbitration_id < 258
  union all select frame_seq, timestamp_ns, 'k', k, case k when 7 then 'seven' when 8 then 'eight' else cast(k as varchar) end from hexed where arbitration_id < 258
  union all select frame_seq, timestamp_ns, 'neg', case when neg = 0 then 0 else -neg end, cast(-neg as varchar) from hexed where arbitration_id < 258
  union all select frame_seq, timestamp_ns, 'cents', cents * cast(0.01 as double), null from hexed where arbitration_id < 258
  union all select frame_seq, timestamp_ns, 'unmapped', null, concat(upper(lpad(to_hex(arbitration_id), 4, '0')), ' | 8 | ', hex) from hexed where arbitration_id = 258)"""


@query("n1_decode_signals", "select frame_seq, timestamp_ns, signal, round(value, 6) as value from decoded where signal <> 'unmapped'", FRAMES, _DECODED)
def _(spark, d):
    out = signals.decode_signals(tables.frames(spark, d), tables.signal_dict(spark), "ignore")
    return out.select("frame_seq", "timestamp_ns", "signal", F.round("value", 6).alias("value"))


@query("n1_multiplexed", """select frame_seq, 'k' as signal, k::double as value from frames where arbitration_id = 256
  union all select frame_seq, 'low', user_id % 256 from frames where arbitration_id = 256 and k = 7
  union all select frame_seq, 'high', user_id // 256 from frames where arbitration_id = 256 and k = 8""", FRAMES)  # fmt: skip
def _(spark, d):
    return signals.decode_signals(tables.frames(spark, d), tables.switched_signals(spark), "ignore").select("frame_seq", "signal", "value")


@query("n2_unmapped_policy", "select frame_seq, timestamp_ns, signal, text from decoded where signal <> 'cents'", FRAMES, _DECODED)
def _(spark, d):
    return signals.decode_signals(tables.frames(spark, d), tables.signal_dict(spark)).where("signal <> 'cents'").select("frame_seq", "timestamp_ns", "signal", "text")


@query("n3_signals_to_logs", "select frame_seq, timestamp_ns, 'can' as device, case when signal = 'unmapped' then signal else concat('event.', signal) end as module, 20 as level, round(value, 6) as value from decoded", FRAMES, _DECODED)
def _(spark, d):
    decoded = signals.decode_signals(tables.frames(spark, d), tables.signal_dict(spark))
    return signals.signals_to_logs(decoded, "CAN", True).select("frame_seq", "timestamp_ns", "device", "module", "level", F.round("value", 6).alias("value"))


@query("n4_frames_to_logs", "select frame_seq, timestamp_ns, 'can' as device, 'bus' as module, 20 as level, concat(upper(lpad(to_hex(arbitration_id), 4, '0')), ' | 8 | ', hex) as message from hexed", FRAMES)
def _(spark, d):
    return signals.frames_to_logs(tables.frames(spark, d), "can")


# order -----------------------------------------------------------------------------------------------------------------


@query("o1_reorder", "select * from logs order by timestamp_ns, seq")
def _(spark, d):
    return order.reorder(tables.logs(spark, d))


@query("o2_merge_logs", "select timestamp_ns, device, module, level, message from logs union all select timestamp_ns, device, module, level, message from kv", KV)
def _(spark, d):
    logs = tables.logs(spark, d)
    columns = list(model.LOG_COLUMNS)
    return order.merge_logs(logs.select(columns), lines.extract_key_values(logs, "kv").select(columns))


@query("o3_assign_seq", """select row_number() over (order by timestamp_ns, seq, kv_pos) as seq, timestamp_ns, device, module, message
  from (select timestamp_ns, seq, -1 as kv_pos, device, module, message from logs union all select timestamp_ns, seq, kv_pos, device, module, message from kv)""", KV)  # fmt: skip
def _(spark, d):
    logs = tables.logs(spark, d)
    both = order.merge_logs(logs.withColumn("kv_pos", F.lit(-1)), lines.extract_key_values(logs, "kv"))
    return order.assign_seq(both, ("timestamp_ns", "seq", "kv_pos")).select("seq", "timestamp_ns", "device", "module", "message")


@query("o4_retain_last", "select * from logs where seq > (select max(seq) from logs) - 2500")
def _(spark, d):
    return order.retain_last(tables.logs(spark, d), 2500)


@query("o5_read_since", "select * from logs where seq > 4000")
def _(spark, d):
    return order.read_since(tables.logs(spark, d), 4000)


# filters ---------------------------------------------------------------------------------------------------------------


@query("f1_filter_level", "select * from logs where level >= 30")
def _(spark, d):
    return filters.filter_level(tables.logs(spark, d), "WARNING")


@query("f2_filter_device", "select * from logs where device = 'dev3'")
def _(spark, d):
    return filters.filter_device(tables.logs(spark, d), "dev3")


@query("f3_filter_module", "select * from logs where device = 'dev3' and module = 'app.click'")
def _(spark, d):
    return filters.filter_module(tables.logs(spark, d), "dev3.app.click")


@query("f4_filter_subtree", "select * from kv where module = 'app.click' or module like 'app.click.%'", KV)
def _(spark, d):
    return filters.filter_subtree(lines.extract_key_values(tables.logs(spark, d), "kv"), "kv.app.click")


@query("f5_filter_siblings", "select * from kv where module = 'app.click' or module like 'app.click.%'", KV)
def _(spark, d):
    return filters.filter_siblings(lines.extract_key_values(tables.logs(spark, d), "kv"), "kv.app.click.k")


_LIMIT = "case device when 'dev0' then case when module = 'app.click' then 5 else 100 end when 'dev1' then case when module = 'app.error' then 50 else 10 end when 'dev2' then 30 when 'dev3' then 100 else 10 end"


@query("f6_filter_module_levels", f"select * from logs where level >= {_LIMIT} and {_LIMIT} < 100")
def _(spark, d):
    return filters.filter_module_levels(tables.logs(spark, d), tables.overrides(spark), "DEBUG")


@query("f7_apply_filter", f"select * from logs where seq > 100 and level >= 10 and device = 'dev2' and {_LIMIT.replace('else 10', 'else 0')} <= level")
def _(spark, d):
    return filters.apply_filter(tables.logs(spark, d), LogFilter(module="dev2.app", children=True, level="DEBUG", overrides=tables.overrides(spark), after_seq=100))


@query("f8_search_modules", "select * from logs where (contains(module, 'click') and contains(device, 'dev1') or contains(module, 'err')) and not contains(device, 'dev4')")
def _(spark, d):
    return filters.search_modules(tables.logs(spark, d), "Click+DEV1 err - -dev4")


@query("f9_find_text", "select seq, line, strpos(lower(line), 'k=7;')::int as position from (select seq, concat(module, ' ', message) as line from logs) where contains(lower(line), 'k=7;')")
def _(spark, d):
    return filters.find_text(tables.logs(spark, d).select("seq", F.concat_ws(" ", "module", "message").alias("line")), "K=7;")


@query("f9_find_indexed", "select seq, line, strpos(lower(line), 'cents=49')::int as position from (select seq, concat(module, ' ', message) as line from logs) where contains(lower(line), 'cents=49')")
def _(spark, d):
    """The same search by a table of trigrams of blocks of ``seq``."""
    stored, index = (scratch(spark, x) for x in ("lines", "trigrams"))
    tables.logs(spark, d).select("seq", F.concat_ws(" ", "module", "message").alias("line")).repartitionByRange("seq").sortWithinPartitions("seq").write.parquet(stored)
    lines_ = spark.read.parquet(stored)
    text_index.write_trigrams(lines_, index, 64)
    return text_index.find_indexed(lines_, spark.read.parquet(index), "Cents=49", 64)


@query("f9_find_next", "select coalesce(min(seq) filter (seq > 500), min(seq)) as seq from logs where contains(message, 'k=42;')")
def _(spark, d):
    return filters.find_from(tables.logs(spark, d).withColumnRenamed("message", "line"), "k=42;", 500)


@query("f9_find_prev", "select coalesce(max(seq) filter (seq < 500), max(seq)) as seq from logs where contains(message, 'k=42;')")
def _(spark, d):
    return filters.find_from(tables.logs(spark, d).withColumnRenamed("message", "line"), "k=42;", 500, forward=False)


# latest values ---------------------------------------------------------------------------------------------------------


@query("a1_latest_by_module", "select * from latest", LATEST)
def _(spark, d):
    return latest.latest_by_module(tables.logs(spark, d))


@query("a2_telemetry_table", "select device, module, coalesce(message, '---') as value from known left join latest using (device, module)", LATEST, KNOWN)
def _(spark, d):
    logs = tables.logs(spark, d)
    return latest.telemetry_table(logs, modules.modules(logs))


@query("a3_sort_table", "select device, module, coalesce(message, '---') as value from known left join latest using (device, module) order by value desc, device, module", LATEST, KNOWN)
def _(spark, d):
    logs = tables.logs(spark, d)
    return latest.sort_table(latest.telemetry_table(logs, modules.modules(logs)), "value", True)


@query("a4_watch_latest", """select 'w' as watch, position, kind, label, value from (
  select 0 as position, 'section' as kind, 'Main' as label, null as value
  union all select 1, 'row', 'Clicks', (select arg_max(message, seq) from latest where device in ('dev0', 'dev1') and module = 'app.click')
  union all select 2, 'row', 'Mixed', (select arg_max(message, seq) from latest where device = 'dev2' and module = 'app.error')
  union all select 3, 'row', 'Empty', '---')""", LATEST)  # fmt: skip
def _(spark, d):
    return latest.watch_latest(tables.logs(spark, d), tables.watches(spark))


_CHANGES = "changes as (select * from (select *, lag(message) over (partition by device, module order by seq) as b from kv) where b is null or b <> message)"


@query("a5_value_changes", "select seq, kv_pos, device, module, message from changes", KV, _CHANGES)
def _(spark, d):
    kv = lines.extract_key_values(tables.logs(spark, d), "kv")
    return latest.value_changes(kv).select("seq", "kv_pos", "device", "module", "message")


@query("a5_last_change", "select device, module, max(seq) as seq, arg_max(timestamp_ns, seq) as timestamp_ns from changes group by device, module", KV, _CHANGES)
def _(spark, d):
    return latest.last_change(lines.extract_key_values(tables.logs(spark, d), "kv"))


@query("a6_staleness", """select device, module, newest_ns, coalesce((select max(timestamp_ns) from logs) - newest_ns > 30000000000, true) as stale
  from known left join (select device, module, max(timestamp_ns) as newest_ns from logs group by all) using (device, module)""", KNOWN)  # fmt: skip
def _(spark, d):
    logs = tables.logs(spark, d)
    as_of = logs.agg(F.max("timestamp_ns")).first()[0]
    return latest.staleness(logs, modules.modules(logs), as_of)


@query("a7_throughput", "select timestamp_ns // 60000000000 * 60 as start_s, count(*) as rows, sum(strlen(message))::bigint as bytes from logs group by all")
def _(spark, d):
    return latest.throughput(tables.logs(spark, d), seconds=60).select(F.unix_seconds("window_start").alias("start_s"), "rows", "bytes")


@query("a7_backlog", """select s as start_s, sum(sum(n)) over (order by s)::bigint as backlog from (
  select timestamp_ns // 3600000000000 * 3600 as s, 1 as n from logs union all select (timestamp_ns // 3600000000000 + 1) * 3600, -1 from logs) group by s""")  # fmt: skip
def _(spark, d):
    logs = tables.logs(spark, d)
    sent, received = (latest.throughput(x, seconds=3600) for x in (logs, logs.withColumn("timestamp_ns", F.col("timestamp_ns") + 3_600_000_000_000)))
    return latest.backlog(sent, received).select(F.unix_seconds("window_start").alias("start_s"), "backlog")


@query("a8_overload_periods", """select min(s) as start_s, max(s) as end_s, max(n) as peak, sum(n)::bigint as rows from runs group by g having max(n) > 12 or max(s) - min(s) >= 3""",
  """per as (select timestamp_ns // 600 // 1000000000 as s, count(*) as n from logs group by 1 having count(*) > 3),
runs as (select s, n, s - row_number() over (order by s) as g from per)""")  # fmt: skip
def _(spark, d):
    slow = tables.logs(spark, d).withColumn("timestamp_ns", F.expr("timestamp_ns div 600"))
    return latest.overload_periods(slow, 3, 3, 12)


@query("a6_staleness_stream", """select device, module, newest_ns, stale, at_ns from (
  select device, module, timestamp_ns as newest_ns, false as stale, timestamp_ns as at_ns from gaps where b is null or timestamp_ns - b > 30000000000
  union all select device, module, b, true, b + 30000000000 from gaps where timestamp_ns - b > 30000000000
  union all select device, module, max(timestamp_ns), true, max(timestamp_ns) + 30000000000 from logs group by device, module)""",
  "gaps as (select device, module, timestamp_ns, lag(timestamp_ns) over (partition by device, module order by timestamp_ns) as b from logs)")
def _(spark, d):
    """When modules turn stale and fresh again: log rows stream in by time, a tick an hour after the last one ends it."""
    dropped, out, state = _folder(spark), *(scratch(spark, x) for x in ("stale", "state"))
    logs = tables.logs(spark, d).select("device", "module", "timestamp_ns", F.lit(False).alias("is_tick"))
    low, high = logs.agg(F.min("timestamp_ns"), F.max("timestamp_ns")).first()
    parts = [logs.where(F.col("timestamp_ns").between(low + (high + 1 - low) * k // 3, low + (high + 1 - low) * (k + 1) // 3 - 1)) for k in range(3)]
    ticks = spark.createDataFrame([("", "", high + k * 3_600_000_000_000, True) for k in (1, 2)], logs.schema).coalesce(1)
    changes = staleness_stream(spark.readStream.schema(logs.schema).parquet(dropped))
    with state_store(spark):
        _in_turn([*parts, ticks], dropped, changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", state))
    return spark.read.schema(changes.schema).parquet(out)


# series ----------------------------------------------------------------------------------------------------------------


@query("t1_numeric_series", "select * from series where device in ('dev1', 'dev2') and module = 'app.click'", SERIES)
def _(spark, d):
    return series.numeric_series(tables.logs(spark, d), ["dev1.app.click", "dev2.app.click"])


@query("t2_channel_names", """select device, module, channel, case when n > 1 then concat(short, ' ', channel) else short end as name
  from (select device, module, channel, count(*) over (partition by device, module) as n, split_part(module, '.', -1) as short from (select distinct device, module, channel from series))""", SERIES)  # fmt: skip
def _(spark, d):
    return series.channel_names(series.numeric_series(tables.logs(spark, d)))


@query("t3_rolling_points", "select * from series qualify row_number() over (partition by device, module, channel order by seq desc) <= 20", SERIES)
def _(spark, d):
    return series.rolling_points(series.numeric_series(tables.logs(spark, d)), 20)


@query("t3_rolling_stream", "select * from series qualify row_number() over (partition by device, module, channel order by seq desc) <= 20", SERIES)
def _(spark, d):
    """The same as a stream of three parts by seq, whose points take slots in rings of twenty."""
    dropped, out, state = _folder(spark), *(scratch(spark, x) for x in ("points", "state"))
    logs = tables.logs(spark, d)
    last = logs.agg(F.max("seq")).first()[0]
    parts = [logs.where((F.col("seq") > last * k // 3) & (F.col("seq") <= last * (k + 1) // 3)) for k in range(3)]
    points = rolling_points_stream(spark.readStream.schema(logs.schema).parquet(dropped), 20)
    with state_store(spark):
        _in_turn(parts, dropped, points.writeStream.format("parquet").option("path", out).option("checkpointLocation", state))
    return rolled_points(spark.read.schema(points.schema).parquet(out))


@query("t4_parse_duration", """select seq, (case seq % 6 when 0 then (seq % 90) when 1 then 60 * (seq % 90) when 2 then 3600 * (seq % 90) when 3 then (seq % 90) when 4 then 30 * (2 * (seq % 90) + 1) end)::int as seconds from logs""")
def _(spark, d):
    text = F.expr("case seq % 6 when 0 then concat(seq % 90, 's') when 1 then concat(seq % 90, ' M') when 2 then concat(seq % 90, 'h') when 3 then string(seq % 90) when 4 then concat(seq % 90, '.5m') else 'x' end")
    return tables.logs(spark, d).select("seq", T.parse_duration(text).alias("seconds"))


@query("t5_view_window", "select * from series where timestamp_ns >= (select max(timestamp_ns) from series) - 86400000000000", SERIES)
def _(spark, d):
    return series.view_window(series.numeric_series(tables.logs(spark, d)), 86_400)


@query("t6_series_with_children", "select * from series where device = 'dev1'", SERIES)
def _(spark, d):
    return series.series_with_children(tables.logs(spark, d), "dev1.app")


@query("t7_series_to_wide", "select device, module, seq, timestamp_ns, max(value) filter (channel = 0) as c0, max(value) filter (channel = 1) as c1 from series group by all", SERIES)
def _(spark, d):
    return series.series_to_wide(series.numeric_series(tables.logs(spark, d)), [0, 1])


# devices and modules ---------------------------------------------------------------------------------------------------


@query("h1_devices", "select device, (row_number() over (order by min(seq), device) - 1)::int as device_id, min(seq) as first_seq from logs group by device")
def _(spark, d):
    return modules.devices(tables.logs(spark, d))


@query("h2_modules", """select device, module, case module when '' then null when 'app' then '' else 'app' end as parent, split_part(module, '.', -1) as short_name,
  case module when '' then 0 when 'app' then 1 else 2 end as depth, first_seq,
  (row_number() over (partition by device order by first_seq, case module when '' then 0 when 'app' then 1 else 2 end, module) - 1)::int as module_id from known""", KNOWN)  # fmt: skip
def _(spark, d):
    return modules.modules(tables.logs(spark, d)).drop("ancestors")


@query("h2_stable_ids", """select d.device_id, d.first_seq as device_seq, k.device, k.module, k.first_seq,
  (row_number() over (partition by k.device order by k.first_seq, case k.module when '' then 0 when 'app' then 1 else 2 end, k.module) - 1)::int as module_id
  from known k join (select device, (row_number() over (order by min(seq), device) - 1)::int as device_id, min(seq) as first_seq from logs group by device) d using (device)""", KNOWN)  # fmt: skip
def _(spark, d):
    """Devices and modules registered in three batches, the second one twice; the ids are those of one pass."""
    logs = tables.logs(spark, d)
    registry = Registry(spark, scratch(spark, "registry"))
    for batch_id, rows in ((0, logs.where("seq <= 5")), (1, logs.where("seq between 6 and 40")), (1, logs.where("seq between 6 and 40")), (2, logs.where("seq > 40"))):
        registry.add(rows, batch_id)
    return registry.modules().join(registry.devices().withColumnRenamed("first_seq", "device_seq"), "device").select("device_id", "device_seq", "device", "module", "first_seq", "module_id")


@query("h3_module_closure", "select device, unnest(case module when '' then [] when 'app' then [''] else ['', 'app'] end) as ancestor, module as descendant from known", KNOWN)
def _(spark, d):
    return modules.module_closure(modules.modules(tables.logs(spark, d)))


@query("h4_resolve_modules", "select concat(upper(device), '.', module) as identifier, device, module from known where module <> '' and device <> 'dev0'", KNOWN)
def _(spark, d):
    known = modules.modules(tables.logs(spark, d))
    wanted = known.where("module <> ''").select(F.concat(F.when(F.col("device") == "dev0", "none").otherwise(F.upper("device")), F.lit("."), "module").alias("identifier"))
    return modules.resolve_modules(spark, wanted, known)


@query("h5_module_tree", """select device, module, case module when '' then device when 'app' then '├── app' else concat('    ├── ', split_part(module, '.', -1)) end as label from known order by device, module""", KNOWN)
def _(spark, d):
    return modules.module_tree(modules.modules(tables.logs(spark, d)))


@query("h6_levels", """select device, short, count(*) as rows from logs join (values (5, 'T'), (10, 'D'), (20, 'I'), (30, 'W'), (40, 'E')) v(level, short) using (level) group by all""")
def _(spark, d):
    known = model.levels(spark)
    logs = tables.logs(spark, d)
    return logs.join(F.broadcast(known), logs["level"] == known["value"]).groupBy("device", "short").agg(F.count("*").alias("rows"))


# query entry points and sinks ------------------------------------------------------------------------------------------

_RENDERED = f"concat(strftime(make_timestamp(timestamp_ns // 1000), '%H:%M:%S'), '.', lpad(cast((timestamp_ns // 1000000) % 1000 as varchar), 3, '0'), ' ', device, ' ', {LETTER}, ' ', module, ': ', message)"


@query("q1_tail", "select * from (select * from logs where level >= 30 and device = 'dev2' order by seq desc limit 50) order by seq")
def _(spark, d):
    return render.tail(tables.logs(spark, d), LogFilter(device="dev2", level="WARNING"), 50)


@query("q1_newest", "select * from (select * from logs where level >= 30 and device = 'dev2' order by seq desc limit 50) order by seq")
def _(spark, d):
    """The same from a stored log, by range probing."""
    store = LogStore(spark, scratch(spark, "store"), ("timestamp_ns", "_seq"))
    store.append(tables.logs(spark, d).withColumnRenamed("seq", "_seq"), 0)
    return store.newest(LogFilter(device="dev2", level="WARNING"), 50).select("seq", "timestamp_ns", "device", "module", "level", "message")


@query("q2_render", f"select seq, {_RENDERED} as line from logs")
def _(spark, d):
    return render.render(tables.logs(spark, d))


@query("q3_render_console", f"select seq, concat(strftime(make_timestamp(timestamp_ns // 1000), '%H:%M:%S'), '.', lpad(cast((timestamp_ns // 1000000) % 1000 as varchar), 3, '0'), ' ', {LETTER}, ' ', device, ' ', module, ' ', chr(9), message) as line from logs where level >= 20")
def _(spark, d):
    return render.render_console(tables.logs(spark, d), "INFO")


@query("k1_session_log", f"select seq, concat(strftime(make_timestamp(timestamp_ns // 1000), '%Y-%m-%dT%H:%M:%S.%f'), 'Z ', {LETTER}, ' ', device, ' ', module, ': ', message) as line from logs")
def _(spark, d):
    return model.with_ts(tables.logs(spark, d)).select("seq", render.session_line().alias("line"))


@query("k1_s3_session_files", "select timestamp_ns, device, module, level, message from logs")
def _(spark, d):
    """Written as session files of about 100 kB and read back."""
    path = scratch(spark, "session")
    session_log.write_session_log(tables.logs(spark, d), path, 100_000)
    return session_log.read_log_text(spark, path).where("_error is null").drop("_error")


@query("k1_session_parts", """select timestamp_ns, device, module, level, concat(message, chr(10), '\\', seq, chr(13), '\\n') as message from logs""")
def _(spark, d):
    """Messages with line ends and backslashes, written by six small batches into parts of about 200 kB, one batch twice, and read back."""
    path = scratch(spark, "parts")
    logs = tables.logs(spark, d).withColumn("message", F.concat("message", F.lit("\n\\"), F.col("seq").cast("string"), F.lit("\r\\n")))
    parts = session_log.SessionParts(spark, path, 200_000)
    for batch_id in (0, 1, 2, 2, 3, 4, 5):
        parts.add(logs.where(F.col("seq") % 6 == batch_id), batch_id)
    parts.finish()
    return session_log.read_log_text(spark, f"{path}/parts").where("_error is null").drop("_error")


@query("k3_session_manifest", """select cast(doc_id as varchar) as source, length(t) // 64 + (length(t) % 64 > 0)::int as chunks, (strlen(t) - strlen(substr(t, (length(t) - 1) // 64 * 64 + 1))) // 1000 + 1 as parts, strlen(t) as total_bytes, doc_id * 1000000 as created_ns,
  doc_id * 1000000 + (length(t) - 1) // 64 as finished_ns, round(((length(t) - 1) // 64) / 1e9, 3) as duration_seconds from (select doc_id, concat(coalesce(text, ''), chr(10)) as t from documents)""")  # fmt: skip
def _(spark, d):
    return capture.session_manifest(tables.chunks(spark, d), 1_000)


@query("k2_write_raw_capture", """select cast(doc_id as varchar) as source, i as chunk_seq, doc_id * 1000000 + i as timestamp_ns, substr(t, i * 64 + 1, 64) as piece
  from (select doc_id, t, unnest(range(0, (length(t) - 1) // 64 + 1)) as i from (select doc_id, concat(coalesce(text, ''), chr(10)) as t from documents))""")  # fmt: skip
def _(spark, d):
    path = scratch(spark, "capture")
    capture.write_raw_capture(tables.chunks(spark, d), path)
    back = spark.read.schema(model.CHUNKS).parquet(path)
    return back.select("source", "chunk_seq", "timestamp_ns", F.col("payload").cast("string").alias("piece"))


@query("s4_o6_stream_fan_out", """select cast(doc_id as varchar) as source, length(t) // 64 + (length(t) % 64 > 0)::int as chunks, strlen(t) as total_bytes
  from (select doc_id, concat(coalesce(text, ''), chr(10)) as t from documents)""")  # fmt: skip
def _(spark, d):
    """Chunks dropped as files, streamed in small batches to two sinks; the sinks must agree."""
    dropped, store, counts, state = (scratch(spark, x) for x in ("dropped", "store", "counts", "state"))
    tables.chunks(spark, d).write.parquet(dropped)
    sinks = {
        "store": lambda batch, n: batch.write.mode("overwrite").parquet(f"{store}/batch={n}"),
        "counts": lambda batch, n: batch.groupBy("source").agg(F.count("*").alias("chunks")).write.mode("overwrite").parquet(f"{counts}/batch={n}"),
    }
    stream = stream_chunks(spark, {"path": dropped, "maxFilesPerTrigger": 4})
    stream.writeStream.foreachBatch(fan_out(sinks)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    sizes = spark.read.schema(model.CHUNKS).parquet(store).groupBy("source").agg(F.sum(F.octet_length("payload")).cast("long").alias("total_bytes"))
    return spark.read.schema("source string, chunks long").parquet(counts).groupBy("source").agg(F.sum("chunks").alias("chunks")).join(sizes, "source")


@query("o6_sinks_catch_up", """select cast(doc_id as varchar) as source, length(t) // 64 + (length(t) % 64 > 0)::int as steady, length(t) // 64 + (length(t) % 64 > 0)::int as shaky
  from (select doc_id, concat(coalesce(text, ''), chr(10)) as t from documents)""")  # fmt: skip
def _(spark, d):
    """Chunks streamed in small batches to two sinks, one of which fails twice; it catches up, and no batch is lost or doubled."""
    dropped, out, state = (scratch(spark, x) for x in ("dropped", "sinks", "state"))
    each = _in_thirds(tables.chunks(spark, d), dropped)
    failures = iter([0, 1])

    def put(name: str, batch: DataFrame, n: int) -> None:
        batch.groupBy("source").agg(F.count("*").alias("chunks")).write.parquet(f"{out}/{name}/batch={n}")  # a batch given twice would be an error

    def shaky(batch: DataFrame, n: int) -> None:
        if next(failures, None) is not None:
            raise OSError("not now")
        put("shaky", batch, n)

    sinks = FanOut({"shaky": shaky, "steady": lambda batch, n: put("steady", batch, n)}, f"{out}/ledger")
    stream = stream_chunks(spark, {"path": dropped, "maxFilesPerTrigger": each})
    stream.writeStream.foreachBatch(sinks).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    sinks.catch_up(spark)
    counts = [spark.read.schema("source string, chunks long").parquet(f"{out}/{x}").groupBy("source").agg(F.sum("chunks").alias(x)) for x in ("steady", "shaky")]
    return counts[0].join(counts[1], "source", "full")


@query("a1_latest_stream", "select * from latest", LATEST)
def _(spark, d):
    """The latest rows kept by a stream in update mode, its batches merged by seq."""
    dropped, out, state = (scratch(spark, x) for x in ("dropped", "latest", "state"))
    logs = tables.logs(spark, d)
    each = _in_thirds(logs, dropped)
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", each).parquet(dropped)
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    newest = latest.latest_by_module(stream)
    newest.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return latest.latest_by_module(spark.read.schema(newest.schema).parquet(out))


# pipelines -------------------------------------------------------------------------------------------------------------


@query("c1_build_pipeline", f"""select seq, timestamp_ns, device, case when level = 40 then '_unknown' else module end as module, level,
  case when level = 40 then concat('? ', module, ': ', message) else message end as message from (
    select seq, timestamp_ns, 'unit' as device, module, level, message from logs)""")  # fmt: skip
def _(spark, d):
    rows = tables.raw_lines(spark, d).withColumn("line", F.regexp_replace(F.regexp_replace("line", r"^\S+ ", ""), "^E ", "? "))
    chunks = rows.select(F.col("seq").cast("string").alias("source"), F.lit(0).cast("long").alias("chunk_seq"), "timestamp_ns", F.encode(F.concat(F.lit("\x1b[1m"), "line", F.lit("\r\n")), "UTF-8").alias("payload"))
    run = pipeline.build_pipeline({"type": "Serial_Default", "device": "Unit", "parse": {"level_index": 0, "module_index": 1, "message_index": 2}})
    return run(chunks).select(F.col("source").cast("long").alias("seq"), *model.LOG_COLUMNS)


@query("c1_stream_pipeline", """select timestamp_ns, 'unit' as device, case when level = 40 then '_unknown' else module end as module, level,
  case when level = 40 then concat('? ', module, ': ', message) else message end as message from logs""")  # fmt: skip
def _(spark, d):
    """Chunks dropped as files in three parts; lines run over chunks and batches; rows are numbered as they come."""
    dropped, out, state = _folder(spark), *(scratch(spark, x) for x in ("rows", "state"))
    chunks = tables.line_chunks(spark, d)
    late = chunks.agg(F.max("chunk_seq")).first()[0]
    part = F.col("chunk_seq") * 3 / (late + 1)
    run = pipeline.build_pipeline({"type": "Serial_Default", "device": "Unit", "parse": {"level_index": 0, "module_index": 1, "message_index": 2}})
    rows = run(stream_chunks(spark, {"path": dropped}))
    sink = order.seq_sink(out, ("timestamp_ns", "source", "line_no"))
    with state_store(spark):
        _in_turn([chunks.where((part >= k) & (part < k + 1)) for k in range(3)], dropped, rows.writeStream.foreachBatch(sink).option("checkpointLocation", state))
    return spark.read.schema("timestamp_ns long, device string, module string, level int, message string, seq long").parquet(f"{out}/rows").select(*model.LOG_COLUMNS)


@query("c2_run_topology", """select row_number() over (order by timestamp_ns, device, module, message) as seq, timestamp_ns, device, module, message from (
  select timestamp_ns, 'rec' as device, module, message from logs
  union all select timestamp_ns, device, module, message from kv)""", KV)  # fmt: skip
def _(spark, d):
    records = tables.logs(spark, d).selectExpr("timestamp_ns as created_ns", "level as levelno", "module as name", "message as msg")
    spec = {"main": {"type": "records", "device": "rec", "sources": ["in"]}, "values": {"type": "key_value", "device": "kv", "sources": ["main"]}}
    return pipeline.run_topology(spec, {"in": records}, ("timestamp_ns", "device", "module", "message")).select("seq", "timestamp_ns", "device", "module", "message")


@query("c2_stream_topology", """select row_number() over (order by timestamp_ns, device, module, message) as seq, timestamp_ns, device, module, message from (
  select timestamp_ns, 'rec' as device, module, message from logs
  union all select timestamp_ns, device, module, message from kv)""", KV)  # fmt: skip
def _(spark, d):
    """The same topology as one streaming query over records that drop in three parts by time."""
    dropped, out = _folder(spark), scratch(spark, "topology")
    records = tables.logs(spark, d).selectExpr("timestamp_ns as created_ns", "level as levelno", "module as name", "message as msg")
    low, high = records.agg(F.min("created_ns"), F.max("created_ns")).first()
    parts = [records.where(F.col("created_ns").between(low + (high + 1 - low) * k // 3, low + (high + 1 - low) * (k + 1) // 3 - 1)) for k in range(3)]
    stream = spark.readStream.schema(records.schema).parquet(dropped)
    spec = {"main": {"type": "records", "device": "rec", "sources": ["in"]}, "values": {"type": "key_value", "device": "kv", "sources": ["main"]}}
    _in_turn(parts, dropped, pipeline.start_topology(spec, {"in": stream}, out, ("timestamp_ns", "device", "module", "message")))
    return LogStore(spark, out).rows().select("seq", "timestamp_ns", "device", "module", "message")


def newest_by_module(spark, sf_dir: str) -> DataFrame:
    """The flagship: the latest row of each module among those at WARNING or above, the newest 50."""
    return latest.latest_by_module(filters.apply_filter(tables.logs(spark, sf_dir), LogFilter(level="WARNING"))).orderBy(F.desc("seq")).limit(50)


query("latest_warnings", "select device, module, max(seq) as seq, arg_max(timestamp_ns, seq) as timestamp_ns, arg_max(level, seq) as level, arg_max(message, seq) as message from logs where level >= 30 group by device, module order by seq desc limit 50")(newest_by_module)


def queries() -> dict[str, Callable]:
    return {name: function for name, (function, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
