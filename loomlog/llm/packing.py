"""Best-fit packing by minimum bin slack.

Only lengths matter to the choice of bins, and there are at most ``capacity`` different ones. So the heuristic
runs on the histogram of lengths, which has a bounded size whatever the corpus: each bin starts with the longest
length left, a bitset subset-sum over the lengths still available finds the fullest feasible rest, and that
combination is removed as many times as the histogram allows; a few slacks are tried and the best plan is kept. Pieces then find their place by their rank among
those of the same length, so no task ever holds all pieces, nor all of one length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.llm.base import materialize, named
from loomlog.llm.tokenizer import tokenizer

_PIECES = "_part int, doc_id {}, piece int, start long, length long, ids_crc32 long, _rank long"
_PLACED = "doc_id {}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


#: Slacks tried, in tokens; the plan with the fewest bins is taken.
SLACKS = (0, 1, 2, 4, 8, 16, 32, 64, 128)


def fullest(counts: dict[int, int], room: int, slack: int = 0) -> Counter:
    """Lengths, each at most as often as counted, that fill ``room`` to within ``slack`` of the fullest way there is.

    Bitset subset-sum: bit s of ``reach`` says that s can be filled by the lengths seen so far. Among the ways, long lengths go first, so
    that short ones, which fit anywhere, are left for later bins.
    """
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(x for x in counts if x <= room):
        steps.append((length, reach))
        left, take = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4, ... copies at once
            take = min(take, left)
            reach |= (reach << (length * take)) & full
            left -= take
            take *= 2
    high = reach.bit_length() - 1
    low, found = max(0, high - slack), Counter()
    for length, before in reversed(steps):
        for copies in range(min(counts[length], high // length), 0, -1):
            up, down = high - copies * length, max(0, low - copies * length)
            if before >> down & ((1 << (up - down + 1)) - 1):
                found[length], high, low = copies, up, down
                break
    return found


def bin_patterns(histogram: dict[int, int], capacity: int, slacks: tuple[int, ...] = SLACKS) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many bins repeat each; together they use the histogram up.

    Minimum bin slack, and its relaxed form (Fleszar and Hindi, 2002) with each of ``slacks``: the plan with the fewest bins wins.
    """
    return min((_plan(histogram, capacity, slack) for slack in slacks), key=lambda plan: sum(times for _, times in plan))


def _plan(histogram: dict[int, int], capacity: int, slack: int) -> list[tuple[dict[int, int], int]]:
    left = {length: n for length, n in histogram.items() if n > 0}
    patterns = []
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = fullest({x: n for x, n in left.items() if n}, capacity - longest, slack)
        left[longest] += 1
        pattern[longest] += 1
        times = min(left[x] // k for x, k in pattern.items())
        for x, k in pattern.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
        patterns.append((dict(pattern), times))
    return patterns


def _places(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, copies per bin, first bin, offset in the bin), sorted by the first two."""
    rows, used, first_bin = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            rows.append((length, used[length], pattern[length], first_bin, offset))
            used[length] += pattern[length] * times
            offset += pattern[length] * length
        first_bin += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


#: Bytes of text that a task turns into ids at once; bounds its memory beside the batch, not the result.
TEXT_BYTES = 2_000_000


def _by_bytes(batch: pa.RecordBatch, most: int = TEXT_BYTES):
    """The rows of a batch in runs of about ``most`` bytes of text, a longer text in one with its neighbours."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(upto // most)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def token_pieces(docs: DataFrame, id_col: str, text_col: str, max_tokens: int, end_id: int, tokenizer_path: str | None = None, special_text: bool = False) -> DataFrame:
    """A row per piece of each document, with its rank among the pieces of its length that one task made.

    A document is its ids and ``end_id``. One of more than ``max_tokens`` ids is cut so that all pieces but
    the first have just ``max_tokens``.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(max_tokens + 1, np.int64)
        for batch in (few for whole in batches for few in _by_bytes(whole)):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            out = []
            for row, ids in enumerate(tokenizer(tokenizer_path, special_text).encode(texts)):
                raw = ids.astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                n, start = len(raw) // 4, 0
                length = (n - 1) % max_tokens + 1
                for piece in range(-(-n // max_tokens)):
                    out.append((part, row, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), int(seen[length])))
                    seen[length] += 1
                    start, length = start + length, max_tokens
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            arrays[1] = batch.column(0).take(arrays[1])
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _PIECES.split(", ")])

    narrow = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text"))
    return narrow.mapInArrow(run, _PIECES.format(narrow.schema["_id"].dataType.simpleString()))


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 1024, end_id: int = 2, tokenizer_path: str | None = None, special_text: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``max_tokens`` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is one end token;
    an id may be of any type, a null id stays null; the text of a special token becomes its id unless ``special_text``; repeated rows are
    packed each for itself; other columns are not looked at; no rows give no rows. Among pieces of one length the order is by task and then as read, so ties need no rule.
    """
    pieces = materialize(token_pieces(docs, id_col, text_col, max_tokens, end_id, tokenizer_path, special_text), "pieces")
    counts = pieces.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_tokens rows
    places = _places(bin_patterns(histogram, max_tokens))
    key = (places[:, 0] << 44) + places[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            row = places[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
            since = rank - row[:, 1]
            sequence, offset = row[:, 3] + since // row[:, 2], row[:, 4] + since % row[:, 2] * length
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[x.split()[0] for x in _PLACED.split(", ")])

    ranked = pieces.join(first, ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    return ranked.drop("_part", "_before").mapInArrow(run, _PLACED.format(pieces.schema["doc_id"].dataType.simpleString()))
