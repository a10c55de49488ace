"""Shards of nearly equal bytes by histogram sort, with DataFrame functions only.

Every row has a sort key of 63 bits: 47 bits of a digest of (doc_id, text), then 16 bits of a row
number, which separate repeated rows. Shard k ends where the bytes below a key come closest to
(k + 1) / shards of all bytes.

1. A table of (doc_id, size, crc, key) is written once; texts are not read again.
2. Each round counts, over all partitions, the exact bytes and rows in the cells between candidate
   boundaries: equal cells of the key range first, then equal cells of those cells that still hold
   an undecided boundary. The driver sees at most `2 ** bits` cells, later `2 ** bits` for each
   undecided boundary. A boundary is settled once it is within `tolerance` of its target or its cell
   holds one row.
3. The rows are exchanged once, by shard and sub-cell, and numbered. Sub-cells keep a shard's rows
   from meeting in one task; the rows before a sub-cell give its first slot.

Edge cases: a null text counts as empty and weighs `overhead` bytes; a null doc_id is a value like
others; repeated rows are spread as rows of their own; an empty table returns none; other columns
are ignored. Fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstat.session import checkpoint

KEY_BITS = 63
TIE_BITS = 16
SUB_CELL_ROWS = 50_000


def content_key(doc_id: Column, text: Column) -> Column:
    """47 bits that depend on the row's id and text alone."""
    said = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.shiftright(F.conv(F.substring(F.md5(said), 1, 12), 16, 10).cast("long"), 1)


def _cells(rows: DataFrame, low_bits: int, parents: list[int] | None, bits: int) -> dict[int, tuple[int, int]]:
    """Exact (bytes, rows) per cell of `2 ** low_bits` keys; only inside the given larger cells."""
    cell = F.shiftrightunsigned("key", low_bits)
    if parents is not None:
        wide = F.array(*[F.lit(p).cast("long") for p in parents])
        rows = rows.where(F.array_contains(wide, F.shiftrightunsigned("key", low_bits + bits)))
    counted = rows.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return {r.cell: (r.size, r.n) for r in counted.collect()}


def splitters(rows: DataFrame, shards: int, tolerance: float, bits: int = 12) -> list[int]:
    """shards - 1 keys: shard k holds the keys from splitter k - 1 up to splitter k."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    settled: dict[int, int] = {}
    # undecided boundary -> (its cell, bytes below that cell); one cell holds all keys at first
    open_: dict[int, tuple[int, int]] = {k: (0, 0) for k in range(1, shards)}
    level = KEY_BITS
    while open_ and total:
        step = min(bits, level)
        level -= step
        parents = sorted({cell for cell, _ in open_.values()})
        found = _cells(rows, level, None if level + step == KEY_BITS else parents, step)
        inside: dict[int, list[int]] = {p: [] for p in parents}
        for cell in sorted(found):
            inside[cell >> step].append(cell)
        sums = {p: list(accumulate(found[c][0] for c in cells)) for p, cells in inside.items()}
        still = {}
        for k, (parent, below) in open_.items():
            target, cells, upto = k * total / shards, inside[parent], sums[parent]
            at = next((i for i, s in enumerate(upto) if below + s >= target), len(cells) - 1)
            cell = cells[at]
            after = below + upto[at]
            before = after - found[cell][0]
            if min(target - before, after - target) <= slack or found[cell][1] == 1 or level == 0:
                settled[k] = (cell if target - before <= after - target else cell + 1) << level
            else:
                still[k] = (cell, before)
        open_ = still
    return [settled.get(k, 0) for k in range(1, shards)]


def shard(
    docs: DataFrame,
    shards: int = 40,
    tolerance: float = 0.001,
    overhead: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row. Runs jobs.

    `tolerance` is the share of a mean shard by which a boundary may miss its target; at 0 every
    boundary is the row boundary nearest to it.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = checkpoint(
        docs.select(
            docs[id_col].alias("doc_id"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            content_key(docs[id_col], docs[text_col]).alias("content"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    tie = F.pmod(F.xxhash64("row"), F.lit(1 << TIE_BITS))
    rows = rows.select(
        "doc_id", "size", "text_crc32", "row", (F.shiftleft("content", TIE_BITS) + tie).cast("long").alias("key")
    )
    bounds = F.array(*[F.lit(s).cast("long") for s in splitters(rows, shards, tolerance)])
    cell_bits = max(8, (rows.count() // SUB_CELL_ROWS).bit_length() + 1)
    placed = rows.withColumn("shard", F.size(F.filter(bounds, lambda s: s <= F.col("key")))).withColumn(
        "cell", F.shiftrightunsigned("key", KEY_BITS - cell_bits)
    )
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    )
    within = Window.partitionBy("shard", "cell").orderBy("key", "row")
    return placed.join(starts, ["shard", "cell"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("begin") + F.row_number().over(within) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


# cumulative bytes in key order; a boundary is the row boundary nearest to its target, the lower of two
ORACLE_SQL = """
WITH RECURSIVE steps AS (
  SELECT range AS i, range::UINTEGER AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
rows_ AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 12) AS BIGINT) >> 1
           AS key,
         xor(list_reduce(
           list_prepend(4294967295::UINTEGER,
             list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda b: CAST('0x' || b AS UINTEGER))),
           lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::UINTEGER)::BIGINT AS text_crc32
  FROM documents, crc
),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM rows_
),
near AS (
  SELECT *, upto - size AS below FROM summed
),
bounds AS (
  SELECT k, arg_min(pos, (abs(pos - k * total / 40.0), pos)) AS cut
  FROM (SELECT DISTINCT below AS pos, total FROM near UNION SELECT DISTINCT total, total FROM near), range(1, 40) r(k)
  GROUP BY k
),
placed AS (
  SELECT n.*, (SELECT count(*) FROM bounds b WHERE b.cut <= n.below) AS shard FROM near n
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""
