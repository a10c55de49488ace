"""Packing by minimum bin slack: windows filled from a histogram of the lengths that remain.

1. Each document is encoded, ended with `end_id` and cut at multiples of the window; full windows
   are sequences of their own. The tails' lengths are all that packing needs.
2. The driver sees only the histogram of piece lengths (at most one row per length, whatever the
   corpus). For each pattern it takes the longest length left and finds, by a bitset subset-sum over
   the remaining counts, the multiset that fills the window closest to capacity; backtracking gives
   the count of each length. A pattern repeats as often as the counts allow, so their number depends
   on the window and not on the number of documents.
3. A piece has an ordinal among the pieces of its length: a running number within its task, counted
   while pieces are made, plus the total of the tasks before it. Ordinals fall into the pattern
   table's ranges, which give sequence and offset. No task sees all pieces of a length.

Edge cases: a null or empty text is one piece holding `end_id`; a null doc_id is kept; repeated rows
are packed each; an empty table returns none; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstat.llm.words import MAX_REMEMBERED, chunks, encoder
from panelstat.llm.worker import tidied
from panelstat.session import checkpoint

PIECE_FIELDS = [
    ("doc_id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("part", pa.int32()),
    ("nth", pa.int64()),
]
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"
PATTERN_SCHEMA = "length long, first long, last long, copies long, base long, shift long"


def _cut(tokenizer_path: str, window: int, end_id: int, remembered: int):
    def run(batches):
        own, end = encoder(tokenizer_path), end_id.to_bytes(4, "little")
        own.most, encode = remembered, own.encode
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, rows = batch.column("doc_id").to_pylist(), []
            documents = (one for some in chunks(texts) for one in encode(some))
            for doc_id, encoded in zip(ids, documents):
                encoded += end
                total = len(encoded) // 4
                for start in range(0, total, window):
                    piece = encoded[4 * start : 4 * (start + window)]
                    length = len(piece) // 4
                    rows.append((doc_id, start, length, zlib.crc32(piece), total, part, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*rows)) or [()] * len(PIECE_FIELDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, (_, kind) in zip(columns, PIECE_FIELDS)], [n for n, _ in PIECE_FIELDS]
            )

    return run


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """A multiset of the lengths left whose sum is as close below `room` as any; longer lengths first.

    Bit s of `reach` says that some multiset sums to s. Copies of a length enter in binary lots; the
    bits before each lot are kept to walk back from the best sum.
    """
    if room <= 0:
        return {}
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room and counts[n] > 0), reverse=True):
        left, lot = min(counts[length], room // length), 1
        while left:
            lot = min(lot, left)
            steps.append((length, lot, reach))
            reach |= (reach << (length * lot)) & mask
            left, lot = left - lot, lot * 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, lot, before in reversed(steps):
        if not before >> total & 1:
            total -= length * lot
            taken[length] = taken.get(length, 0) + lot
    return taken


def patterns(histogram: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """(copies of each length in a window, number of windows) until every piece is placed."""
    left, out = dict(histogram), []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fill(left, window - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((chosen, times))
    return out


def pattern_rows(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, copies, base, shift): ordinals first..last-1 of a length go to the sequences
    from `base` on, `copies` to each, starting at offset `shift`."""
    used: dict[int, int] = {}
    base, rows = 0, []
    for chosen, times in patterns(histogram, window):
        shift = 0
        for n, k in sorted(chosen.items(), reverse=True):
            first = used.get(n, 0)
            used[n] = first + k * times
            rows.append((n, first, used[n], k, base, shift))
            shift += n * k
        base += times
    return rows


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    remembered: int = MAX_REMEMBERED,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece. Runs jobs.

    `remembered` bounds the pieces of text whose ids a worker keeps, some 200 bytes each.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    # a written table: the ordinals of a task that ran twice must not mix
    pieces = checkpoint(texts.mapInArrow(tidied(_cut(tokenizer_path, window, end_id, remembered)), PIECE_SCHEMA))
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.createDataFrame(pattern_rows(histogram, window), PATTERN_SCHEMA)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    numbered = pieces.join(starts, ["part", "length"]).withColumn("ordinal", F.col("begin") + F.col("nth"))
    p, t = numbered.alias("p"), F.broadcast(table).alias("t")  # the table's size depends on the window alone
    rank = F.col("p.ordinal") - F.col("t.first")
    return p.join(
        t,
        (F.col("p.length") == F.col("t.length"))
        & (F.col("p.ordinal") >= F.col("t.first"))
        & (F.col("p.ordinal") < F.col("t.last")),
    ).select(
        "p.doc_id",
        "p.start",
        "p.length",
        "p.ids_crc32",
        "p.doc_tokens",
        (F.col("t.base") + F.floor(rank / F.col("t.copies"))).cast("long").alias("sequence_id"),
        (F.col("t.shift") + F.pmod(rank, F.col("t.copies")) * F.col("p.length")).cast("long").alias("offset"),
    )
