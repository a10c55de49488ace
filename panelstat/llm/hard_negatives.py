"""Hard negatives per (anchor, positive) by a secondary-sort shuffle.

A vector's components x count as floor(scale * x) in double precision; a score is the integer inner
product with the anchor. Higher scores come first, ties by smaller id. An anchor's positives are its
first `positives` other rows of the same label. Its negatives for a positive are the first `negatives`
rows of another label with low * positive score <= 100 * negative score <= high * positive score.

1. Rows are packed into blocks of about `BLOCK_BYTES` by a hash of the id, anchors likewise into groups;
   each block meets each group once, in a task that holds both and computes their scores.
2. Scores travel as packed keys (anchor, descending score, positive before negative, id) whose bytes
   sort in this order, through repartitionAndSortWithinPartitions by anchor. A block sends of each
   anchor's same-label rows the first `positives` alone: no other can be among the first of all blocks.
   The sorted stream gives the positives.
3. Blocks meet groups again, whose anchors now know their windows, and send each window's first
   `negatives` rows. The positives travel along. A streaming iterator over the sorted keys opens a window
   at each positive, emits negatives as they pass and drops a window that is full or passed; it holds an
   anchor's open windows, never its rows.

Edge cases: rows with a null label or id, a null vector or a null or non-finite component take no part;
of rows with equal ids the first by (label, vector) counts; vectors of unlike length have no score;
empty vectors score 0; an anchor without another row of its label, and a positive without a row in its
window, give no rows; a negative positive score has an empty window. Sums beyond the range of doubles
are exact in Python's integers, and scores beyond 64 bits stay at its limits. Empty tables return none;
other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstat.session import checkpoint

BLOCK_BYTES = 1 << 22
UNITS = 4  # meetings of a block with a group in a task
CHUNK_SCORES = 1 << 20
SIGN = 1 << 63
TOP = 2**63 - 1
EXACT = 2.0**53  # integers below are exact as doubles

PACKED = "place int, size int, ids binary, labels binary, codes binary, largest double"
KEYS = "key binary"
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def pack_key(anchor: int, score: int, negative: bool, row: int) -> bytes:
    """Bytes that sort by anchor, descending score, positives first, id."""
    return struct.pack(">QQ?Q", anchor + SIGN, TOP - score, negative, row + SIGN)


def unpack_key(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, row = struct.unpack(">QQ?Q", key)
    return anchor - SIGN, TOP - score, negative, row - SIGN


def _pack(scale: float):
    """Rows sorted by (place, id, label, vector) to matrices of one place and vector length each."""

    def matrix(place, rows):
        by_size: dict[int, list] = {}
        for row in rows:
            by_size.setdefault(len(row[2]), []).append(row)
        for size, some in by_size.items():
            codes = np.floor(scale * np.array([v for _, _, v in some], np.float64).reshape(len(some), size))
            yield (
                place, size, np.array([i for i, _, _ in some], np.int64).tobytes(),
                np.array([label for _, label, _ in some], np.int64).tobytes(), codes.tobytes(), float(np.abs(codes).max(initial=0)),
            )

    def batch_of(rows):
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
        names = [f.split(" ")[0] for f in PACKED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    def run(batches):
        at, held, last, n = None, [], None, 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("place", "id", "label"))
            for place, row, label, vector in zip(*columns, batch.column("vector")):
                if place != at or n * 8 > BLOCK_BYTES * 2:
                    if held:
                        yield batch_of(list(matrix(at, held)))
                    at, held, n = place, [], 0
                if row != last:
                    held.append((row, label, vector.values.to_numpy()))
                    n += len(vector.values) + 3
                last = row
        if held:
            yield batch_of(list(matrix(at, held)))

    return run


def _scores(some: np.ndarray, rows: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products of all pairs, exact; `bound` is on their absolute values."""
    if bound < EXACT:
        return (some @ rows.T).astype(np.int64)
    whole = [[[int(x) for x in v] for v in m] for m in (some, rows)]
    exact = [[min(TOP, max(-TOP - 1, sum(x * y for x, y in zip(a, b)))) for b in whole[1]] for a in whole[0]]
    return np.array(exact, np.int64).reshape(len(some), len(rows))


def _first(scores: np.ndarray, allowed: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each line's first `many` allowed scores, the highest, of equal ones the earlier columns."""
    lowest = np.iinfo(np.int64).min
    seen = np.where(allowed, scores, lowest)
    if seen.shape[1] > many:
        least = np.partition(seen, seen.shape[1] - many, axis=1)[:, -many]
        allowed = allowed & (seen >= least[:, None])
    line, column = np.nonzero(allowed)
    order = np.lexsort((column, ~seen[line, column], line))  # ~ turns the order of all 64-bit integers round
    line, column = line[order], column[order]
    begin = np.searchsorted(line, line)
    keep = np.arange(len(line)) - begin < many
    return line[keep], column[keep]


def _key_bytes(anchors: np.ndarray, scores: np.ndarray, negative: bool, rows: np.ndarray) -> pa.Array:
    """`pack_key` for many."""
    out = np.zeros((len(anchors), 25), np.uint8)
    flip = np.uint64(SIGN)

    def put(at: int, values: np.ndarray) -> None:
        out[:, at : at + 8] = values.astype(">u8").view(np.uint8).reshape(-1, 8)

    put(0, anchors.view(np.uint64) ^ flip)
    put(8, ~(scores.view(np.uint64) ^ flip))
    out[:, 16] = negative
    put(17, rows.view(np.uint64) ^ flip)
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(25), len(out), [None, pa.py_buffer(out.tobytes())])
    return fixed.cast(pa.binary())


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(row["codes"], np.float64).reshape(len(ids), row["size"])


def _windows(ids: np.ndarray, found: list[dict] | None, most: int) -> np.ndarray:
    """Lowest and highest negative score of each anchor's positives; empty where it has fewer."""
    out = np.tile(np.array([1, 0], np.int64), (len(ids), most, 1))
    line = {int(i): k for k, i in enumerate(ids)}
    for w in found or ():
        if w["anchor_id"] in line:  # a group's anchors can lie in several matrices
            out[line[w["anchor_id"]], w["nth"]] = w["floor"], w["ceiling"]
    return out


def _meet(positives: int, negatives: int, windows: bool):
    """Rows sorted by (block, group, size, side): anchors, then rows, to keys of each anchor's first rows,
    those of its label or those of its windows."""

    def found(anchors: dict, rows: dict):
        a_ids, a_labels, a_codes = _matrix(anchors)
        ids, labels, codes = _matrix(rows)
        bound = rows["largest"] * anchors["largest"] * max(rows["size"], 1)
        bounds = _windows(a_ids, anchors["windows"], positives) if windows else None
        step = max(1, (CHUNK_SCORES if bound < EXACT else 1 << 10) // max(1, len(ids)))
        for at in range(0, len(a_ids), step):
            part = slice(at, at + step)
            scores = _scores(a_codes[part], codes, bound)
            same = a_labels[part, None] == labels
            if windows:
                taken = np.zeros(scores.shape, bool)
                for k in range(positives):
                    inside = ~same & (scores >= bounds[part, k, 0, None]) & (scores <= bounds[part, k, 1, None])
                    taken[_first(scores, inside, negatives)] = True
                line, column = np.nonzero(taken)
            else:
                line, column = _first(scores, same & (a_ids[part, None] != ids), positives)
            yield _key_bytes(a_ids[part][line], scores[line, column], windows, ids[column])

    def run(batches):
        at, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                key = (row["block"], row["group"], row["size"])
                if key != at:
                    at, held = key, []
                if not row["side"]:
                    held.append(row)
                    continue
                for anchors in held:
                    for keys in found(anchors, row):
                        yield pa.RecordBatch.from_arrays([keys], ["key"])

    return run


def _meetings(blocks: DataFrame, groups: DataFrame, n_blocks: int, n_groups: int) -> DataFrame:
    """Each block with each group, in one stream per task."""

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    rows = blocks.withColumnRenamed("place", "block").withColumns({"group": every(n_groups), "side": F.lit(1)})
    anchors = groups.withColumnRenamed("place", "group").withColumns({"block": every(n_blocks), "side": F.lit(0)})
    both = anchors.unionByName(rows, allowMissingColumns=True)
    if "windows" not in both.columns:
        both = both.withColumn("windows", F.lit(None).cast("array<struct<anchor_id:long>>"))
    dealt = both.repartition(-(-n_blocks * n_groups // UNITS), "block", "group")
    return dealt.sortWithinPartitions("block", "group", "size", "side")


def _in_order(keys: DataFrame):
    """The keys by anchor, sorted, as an RDD; an anchor's keys lie in one partition."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = keys.rdd.map(lambda row: (bytes(row[0]), None))
    return pairs.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))


def first_positives(keys, positives: int, low: int, high: int):
    """Sorted keys of same-label rows to (anchor, positive, nth, score, lowest and highest negative score)."""
    at, n = None, 0
    for key, _ in keys:
        anchor, score, _, row = unpack_key(key)
        at, n = (anchor, n) if anchor == at else (anchor, 0)
        if n < positives:
            yield anchor, row, n, score, max(-(-low * score // 100), -TOP - 1), min(high * score // 100, TOP)
        n += 1


def emit_negatives(keys, positives: int, negatives: int, low: int, high: int):
    """Sorted keys to result rows. A positive opens a window; each negative goes to the windows it lies in;
    a window that is full, or whose floor has passed, is dropped."""
    at, opened, windows = None, 0, []
    for key, _ in keys:
        anchor, score, negative, row = unpack_key(key)
        if anchor != at:
            at, opened, windows = anchor, 0, []
        if not negative:
            if opened < positives:
                windows.append([row, score, 0])
                opened += 1
            continue
        left = []
        for window in windows:
            positive, of, n = window
            if low * of > 100 * score:
                continue
            if 100 * score <= high * of:
                window[2] = n + 1
                yield anchor, positive, n + 1, row, of, score
            if window[2] < negatives:
                left.append(window)
        windows = left


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); rank from 1 per positive.

    `anchors` is a condition on the columns of `vectors`. Runs jobs.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        vectors[id_col].cast("long").alias("id"),
        vectors[label_col].cast("long").alias("label"),
        F.transform(vectors[vector_col], lambda x: x.cast("double")).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    cells = F.sum((F.size("vector") + 3).cast("long"))
    all_cells, anchor_cells = rows.agg(cells, F.sum(F.when(F.col("anchor"), F.size("vector") + 3))).first()
    if not anchor_cells:
        return spark.createDataFrame([], SCHEMA)

    def packed(some: DataFrame, n: int) -> DataFrame:
        placed = some.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
        order = ("place", "id", "label", "vector")
        dealt = placed.select(*order).repartition(-(-n // UNITS), "place").sortWithinPartitions(*order)
        return checkpoint(dealt.mapInArrow(_pack(scale), PACKED))

    n_blocks, n_groups = (-(-8 * n // BLOCK_BYTES) for n in (all_cells, anchor_cells))
    # a row of equal id and another label or vector may come first, and is then the anchor
    ids = rows.where("anchor").select("id").distinct()
    blocks = packed(rows, n_blocks)
    groups = packed(rows.join(ids, "id", "left_semi"), n_groups)
    meet = _meet(positives, negatives, windows=False)
    keys = _meetings(blocks, groups, n_blocks, n_groups).mapInArrow(meet, KEYS)
    schema = "anchor_id long, positive_id long, nth int, score long, floor long, ceiling long"
    first = _in_order(keys).mapPartitions(lambda keys: first_positives(keys, positives, low, high))
    first = checkpoint(spark.createDataFrame(first, schema, verifySchema=False))
    window = F.struct("anchor_id", "nth", "floor", "ceiling")
    place = F.pmod(F.xxhash64("anchor_id"), F.lit(n_groups)).cast("int")
    windows = first.groupBy(place.alias("place")).agg(F.collect_list(window).alias("windows"))
    meet = _meet(positives, negatives, windows=True)
    known = _meetings(blocks, groups.join(windows, "place", "left"), n_blocks, n_groups)
    keys = known.mapInArrow(meet, KEYS).union(first.mapInArrow(_positive_keys, KEYS))
    found = _in_order(keys).mapPartitions(lambda keys: emit_negatives(keys, positives, negatives, low, high))
    return spark.createDataFrame(found, SCHEMA, verifySchema=False)


def _positive_keys(batches):
    for batch in batches:
        anchors, scores, rows = (batch.column(c).to_numpy() for c in ("anchor_id", "score", "positive_id"))
        yield pa.RecordBatch.from_arrays([_key_bytes(anchors, scores, False, rows)], ["key"])


# every pair of an anchor and another row; labels are moved on where the id is divisible by 7
ORACLE_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0
),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
),
ranked AS (
  SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM positive JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
