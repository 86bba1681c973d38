"""From frames to signal rows, by a join with a signal dictionary.

Bits are numbered as in public CAN databases: bit b of byte k is 8k + b. A little-endian signal starts at its least significant
bit and goes up; a big-endian one starts at its most significant bit, goes down within a byte and on to the next.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions import text as T
from loomlog.functions.text import let
from loomlog.model import ERROR, INFO, UNKNOWN

SIGNALS = "frame_id int, msg_name string, signal string, start_bit int, bit_len int, little_endian boolean, signed boolean, factor double, offset double, choices map<bigint,string>, mux_value int"
#: A dictionary of more bytes is joined by shuffle instead of broadcast.
MOST_BROADCAST_BYTES = 32_000_000


def frame_text(id_col: str = "arbitration_id") -> Column:
    return F.concat(F.format_string("%04X | %d | ", F.col(id_col), F.col("dlc")), F.lower(F.hex("data")))


def _part(msb: Column, little: Column, size: Column) -> Column:
    """Up to 32 bits of ``data`` as a number. ``msb`` is the place of the lowest bit in little-endian order, else that of the highest in reading order."""
    digits = F.substring(F.hex("data"), 2 * F.floor(msb / 8).cast("int") + 1, F.lit(10))
    five = let(F.rpad(digits, 10, "0"), lambda d: F.when(little, F.concat(*[F.substring(d, k, 2) for k in range(9, 0, -2)])).otherwise(d))
    shift = F.when(little, msb % 8).otherwise(40 - msb % 8 - size).cast("int")
    # bits above the size are cut by shifting them out and back
    return F.call_function("shiftrightunsigned", F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.conv(five, 16, 10).cast("long"), shift), 64 - size), 64 - size)


def _raw(at: str = "") -> Column:
    """The 64 bits of a signal before scaling, with its sign; from its layout in the columns ``<at>start_bit`` and so on; null where the payload is too short.

    Signals of up to 64 bits that begin anywhere are read as two parts of 32 bits at most, so they may span nine bytes.
    """
    start, size, little, signed = (F.col(f"{at}{c}") for c in ("start_bit", "bit_len", "little_endian", "signed"))
    low_size = F.least(size, F.lit(32))
    reading = start - start % 8 + 7 - start % 8  # the highest bit of a big-endian signal, counted in reading order
    low = _part(F.when(little, start).otherwise(reading + size - low_size), little, low_size)
    high = _part(F.when(little, start + 32).otherwise(reading), little, size - 32)
    bits = F.when(size > 32, F.call_function("shiftleft", high, F.lit(32)).bitwiseOR(low)).otherwise(low)
    signed_ = lambda x: F.call_function("shiftright", F.call_function("shiftleft", x, 64 - size), 64 - size)
    return F.when(_fits(at) & (_last_byte(at) < F.octet_length("data")), F.when(signed, signed_(bits)).otherwise(bits))


def _fits(at: str = "") -> Column:
    """Whether a layout is one: 1 to 64 bits from bit 0 on."""
    return F.col(f"{at}bit_len").between(1, 64) & (F.col(f"{at}start_bit") >= 0)


def _exact(raw: Column) -> Column:
    """The number of 64 bits as a decimal; those of an unsigned signal of 64 bits have no sign."""
    wide = raw.cast("decimal(20,0)")
    return F.when((F.col("bit_len") == 64) & ~F.col("signed") & (raw < 0), wide + F.lit(Decimal(1 << 64))).otherwise(wide)


def _last_byte(at: str = "") -> Column:
    """The last byte a signal needs."""
    start, size = F.col(f"{at}start_bit"), F.col(f"{at}bit_len")
    little = F.floor((start + size - 1) / 8)
    big = F.floor(start / 8) + F.floor((7 - start % 8 + size - 1) / 8)
    return F.when(F.col(f"{at}little_endian"), little).otherwise(big)


def _entry_bytes(signal_dict: DataFrame) -> Column:
    """About what an entry takes in memory."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("msg_name", "signal")]
    return sum(texts, F.lit(160)) + F.coalesce(F.octet_length(F.array_join(F.map_values("choices"), "")) + 24 * F.size("choices"), F.lit(0))


def _with_switches(signal_dict: DataFrame) -> DataFrame:
    """The dictionary with the layout of each signal's multiplexer in ``_mux_*``: that of the message's signal named ``mux_signal``, or ``mux``."""
    name = F.coalesce("mux_signal", F.lit("mux")) if "mux_signal" in signal_dict.columns else F.lit("mux")
    layout = ("start_bit", "bit_len", "little_endian", "signed")
    switch = signal_dict.select(F.col("frame_id").alias("_f"), F.col("signal").alias("_s"), *[F.col(c).alias(f"_mux_{c}") for c in layout])
    own = signal_dict.withColumn("_name", F.when(F.col("mux_value").isNotNull(), name))
    return own.join(switch, (own["frame_id"] == switch["_f"]) & (own["_name"] == switch["_s"]), "left").drop("_f", "_s", "_name")


def decode_signals(frames: DataFrame, signal_dict: DataFrame, unmapped_policy: str = "report") -> DataFrame:
    """A row for each signal of each frame: the frame's columns, msg_name, signal, value, text, is_float, ``_error``.

    ``unmapped_policy`` says what becomes of frames without an entry: ``report`` (a row ``unmapped``), ``ignore`` (none), ``strict`` (an error
    row, see ``route_errors``). A payload too short and a layout of other than 1 to 64 bits give a row ``error``. Signals with ``mux_value`` count only where their multiplexer, the message's
    signal named by the dictionary's column ``mux_signal`` (without it, or where it is null, ``mux``), has that number.

    ``value`` is a double; ``text`` of whole factors and offsets is exact for all 64 bits, signed and unsigned (beyond 38 digits it falls back to the double).
    """
    if unmapped_policy not in ("report", "ignore", "strict"):
        raise ValueError(f"unknown policy {unmapped_policy!r}; known: report, ignore, strict")
    size, switched = signal_dict.agg(F.sum(_entry_bytes(signal_dict)), F.max(F.col("mux_value").isNotNull())).first()
    known = _with_switches(signal_dict) if switched else signal_dict
    known = F.broadcast(known) if (size or 0) <= MOST_BROADCAST_BYTES else known
    joined = frames.join(known, frames["arbitration_id"] == known["frame_id"], "inner" if unmapped_policy == "ignore" else "left")
    if switched:
        joined = joined.where(F.col("mux_value").isNull() | (_raw("_mux_") == F.col("mux_value")))
    bad = F.when(~_fits(), "bad layout").when(_last_byte() >= F.octet_length("data"), "payload too short")
    joined = joined.withColumns({"_bad": F.when(F.col("frame_id").isNotNull(), bad), "_raw": _raw()})
    unmapped, error, raw = F.col("frame_id").isNull(), F.col("_bad"), F.col("_raw")
    exact = _exact(raw)
    named = F.element_at("choices", F.when((F.col("bit_len") == 64) & ~F.col("signed") & (raw < 0), None).otherwise(raw))
    factor, offset = F.col("factor"), F.col("offset")
    linear = (factor == F.floor(factor)) & (offset == F.floor(offset))
    value = exact.cast("double") * factor + offset
    small = (F.col("bit_len") <= 32) & (F.abs(factor) < 1 << 19) & (F.abs(offset) < 1 << 51)  # doubles hold the result exactly
    scaled = F.try_add(F.try_multiply(exact, factor.try_cast("decimal(18,0)")), offset.try_cast("decimal(19,0)")).cast("string")
    whole = F.when(small, (raw * factor + offset).cast("long").cast("string")).otherwise(F.coalesce(scaled, F.format_string("%.0f", value)))
    plain = F.when(linear, whole).otherwise(F.format_string("%.3f", F.bround(value, 3)))
    text = F.when(unmapped, frame_text()).when(error.isNotNull(), F.concat(frame_text(), F.lit(" | Decoding error: "), error)).otherwise(F.coalesce(named, plain))
    signal = F.when(unmapped, "unmapped").when(error.isNotNull(), "error").otherwise(F.col("signal"))
    strict = unmapped if unmapped_policy == "strict" else F.lit(False)
    good = ~unmapped & error.isNull()
    return joined.select(
        *[frames[c] for c in frames.columns], F.coalesce("msg_name", F.lit("")).alias("msg_name"), signal.alias("signal"), F.when(good, value).alias("value"), text.alias("text"),
        (good & ~linear & named.isNull()).alias("is_float"), F.when(strict, text).alias("_error"),
    )


def signals_to_logs(signals: DataFrame, device: str, prepend_msg_name: bool = False) -> DataFrame:
    """INFO rows, one a signal, with the number beside the text (null for texts); ``_error`` where the signal is no module."""
    name = F.when((F.col("msg_name") != "") & F.lit(prepend_msg_name), F.concat("msg_name", F.lit("."), "signal")).otherwise(F.col("signal"))
    module = T.normalize_module(name)
    keep = [c for c in ("source", "frame_seq") if c in signals.columns]
    return signals.select(*keep, "timestamp_ns", F.lit(device.lower()).alias("device"), module.alias("module"), F.lit(INFO).alias("level"), F.col("text").alias("message"), "value", F.coalesce("_error", F.when(module.isNull(), F.col("text"))).alias("_error"))


def frames_to_logs(frames: DataFrame, device: str) -> DataFrame:
    """INFO rows of the module ``bus``, one a frame."""
    keep = [c for c in ("source", "frame_seq") if c in frames.columns]
    return frames.select(*keep, "timestamp_ns", F.lit(device.lower()).alias("device"), F.lit("bus").alias("module"), F.lit(INFO).alias("level"), frame_text().alias("message"))


def error_rows(signals: DataFrame, device: str) -> DataFrame:
    """ERROR rows of ``_unknown`` for signals with ``_error``."""
    return signals.where("_error is not null").select("timestamp_ns", F.lit(device.lower()).alias("device"), F.lit(UNKNOWN).alias("module"), F.lit(ERROR).alias("level"), F.col("_error").alias("message"))
