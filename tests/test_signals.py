"""Signals of all sizes against Python's whole numbers."""

import random

import pytest

from loomlog.operators import signals
from loomlog.operators.signals import SIGNALS

FRAMES = "frame_seq long, arbitration_id int, dlc int, data binary"


def place(data: bytearray, start: int, size: int, little: bool, bits: int) -> None:
    """Sets a signal bit by bit."""
    for k in range(size):
        if little:
            at = start + k
            bit = bits >> k & 1
        else:  # from the highest bit on, down within a byte and on to the next
            line = start // 8 * 8 + 7 - start % 8 + k
            at = line // 8 * 8 + 7 - line % 8
            bit = bits >> size - 1 - k & 1
        data[at // 8] |= bit << at % 8


def test_all_sizes_and_places(spark):
    rng = random.Random(1)
    frames, entries, want = [], [], {}
    for no, size in enumerate([*range(1, 65)] * 4):
        little, signed = no % 2 == 0, rng.random() < 0.5
        start = rng.randrange(40)
        bits = rng.choice([0, 1, (1 << size) - 1, 1 << size - 1, rng.getrandbits(size)])
        data = bytearray(16)
        place(data, start, size, little, bits)
        other = bytearray(b"\xff" * 16)
        place(mask := bytearray(16), start, size, little, (1 << size) - 1)
        filled = bytes(d | (o & ~m & 255) for d, o, m in zip(data, other, mask, strict=True))  # all bits around it are set
        number = bits - (1 << size) if signed and bits >> size - 1 else bits
        factor, offset = rng.choice([(1, 0), (1, 0), (3, -7), (-5, 10**12), (1000, 1)])
        entries.append((no, "m", "s", start, size, little, signed, float(factor), float(offset), None, None))
        frames.append((no, no, 16, filled))
        want[no] = (number, number * factor + offset)
    out = signals.decode_signals(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(entries, SIGNALS))
    got = {r["frame_seq"]: (r["text"], r["value"]) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: str(v[1]) for k, v in want.items()}
    assert all(v[1] == pytest.approx(float(want[k][1]), rel=1e-12) for k, v in got.items())


def test_layouts_that_do_not_fit_and_wide_choices(spark):
    rows = [
        (1, "m", "short", 60, 8, True, False, 1.0, 0.0, None, None), (1, "m", "none", 0, 0, True, False, 1.0, 0.0, None, None), (1, "m", "wide", 0, 65, True, False, 1.0, 0.0, None, None),
        (1, "m", "all", 0, 64, True, False, 1.0, 0.0, {-1: "not this"}, None), (1, "m", "same", 0, 64, True, True, 1.0, 0.0, {-1: "minus one"}, None), (1, "m", "part", 0, 64, False, False, 0.5, 0.0, None, None),
        (1, "m", "huge", 0, 64, True, False, 1e17, 0.0, None, None),
    ]
    frames = spark.createDataFrame([(0, 1, 8, b"\xff" * 8), (1, 2, 0, None)], FRAMES)
    got = [(r["frame_seq"], r["signal"], r["text"]) for r in signals.decode_signals(frames, spark.createDataFrame(rows, SIGNALS)).collect()]
    text = "0001 | 8 | ffffffffffffffff"
    assert (0, "all", str(2**64 - 1)) in got and (0, "same", "minus one") in got and (0, "huge", str((2**64 - 1) * 10**17)) in got
    assert {(0, "error", f"{text} | Decoding error: bad layout"), (0, "error", f"{text} | Decoding error: payload too short")} <= set(got)
    assert sum(x[0] == 0 for x in got) == 7 and not any(x[1] in ("none", "wide", "short") for x in got)
