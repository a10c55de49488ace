"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Texts are equal when identical after lower-casing A-Z; null counts as empty.

1. Each input partition cuts a fingerprint of log2(rows) + 8 bits from the SHA-256 of every text,
   sorts the distinct ones and sends each owner (an equal range of fingerprints) its run as
   Golomb-Rice coded gaps: about ten bits and the logarithm of the number of partitions for a
   fingerprint, where the digest has 256.
2. An owner decodes the runs, finds fingerprints that several partitions hold, and answers each
   partition with a bitmap over its run. Owners get equal shares whatever the texts, as equal texts
   of a partition were sent once.
3. Rows marked by a bitmap, or repeated inside their own partition, are suspects; about one in 256
   of the others is a false one. Only suspects' texts are grouped, by digest and whole text, so equal
   means equal byte by byte; copies combine within tasks before the shuffle. All other rows are
   alone of their kind and never shuffle their texts.

Edge cases: a group's null doc_ids lose to others; where all are null, all its rows are marked kept;
repeated rows with the kept doc_id are each marked kept (`deduplicate` leaves one); an empty table
returns none; other columns are ignored by `exact_duplicates` and returned by `deduplicate`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstat.session import checkpoint

FALSE_SUSPECT_BITS = 8
OWNER_FINGERPRINTS = 1_000_000
MAX_BROADCAST_ROWS = 300_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROW_SCHEMA = (
    "doc_id long, digest binary, part int, owner int, place int, repeated boolean, n int, shift int, high binary, low binary"
)
ROW_TYPES = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
ROW_NAMES = [c.split()[0] for c in ROW_SCHEMA.split(", ")]


def normal(text: Column) -> Column:
    """Lower-cases A-Z only; null becomes empty. Texts of ASCII bytes alone take the faster function."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normal(text), 256))


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """(shift, unary quotients, packed remainders) of the gaps of sorted distinct values >= 0.

    The two parts of the codewords lie in streams of their own, so both ends work on arrays.
    """
    gaps = np.diff(values, prepend=np.int64(-1)) - 1
    mean = max(1.0, float(values[-1] + 1) / len(values))
    shift = max(0, int(math.log2(mean * math.log(2))) if mean > 2 else 0)
    stops = np.cumsum((gaps >> shift) + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1, np.uint8)
    unary[stops] = 1
    rest = (gaps[:, None] >> np.arange(shift)) & 1
    return shift, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8)).tobytes()


def golomb_decode(n: int, shift: int, high: bytes, low: bytes) -> np.ndarray:
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8)))[:n]
    quotients = np.diff(stops, prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(low, np.uint8))[: n * shift].reshape(n, shift).astype(np.int64)
    gaps = (quotients << shift) + (rest << np.arange(shift)).sum(axis=1, dtype=np.int64)
    return np.cumsum(gaps + 1) - 1


def _send(bits: int, owners: int):
    """Rows with their place in the run sent to an owner, then the coded runs."""
    width = -(-(1 << bits) // owners)

    def run(batches):
        part = TaskContext.get().partitionId()
        ids, digests = [], []
        for batch in batches:
            ids.append(batch.column("doc_id"))
            digests.append(batch.column("digest"))
        ids, digests = pa.chunked_array(ids, pa.int64()), pa.chunked_array(digests, pa.binary())
        if not len(ids):
            return
        whole = np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, 32)
        prints = (np.ascontiguousarray(whole[:, :8]).view(">u8").ravel() >> np.uint64(64 - bits)).astype(np.int64)
        known, place, times = np.unique(prints, return_inverse=True, return_counts=True)
        owner = known // width
        first = np.searchsorted(owner, np.arange(owners))
        n, empty = len(ids), pa.nulls(len(ids), pa.int32())
        nothing = pa.nulls(n, pa.binary())
        columns = [
            ids.combine_chunks(), digests.combine_chunks(), pa.array(np.full(n, part), pa.int32()),
            pa.array(owner[place], pa.int32()), pa.array(place - first[owner[place]], pa.int32()),
            pa.array(times[place] > 1), empty, empty, nothing, nothing,
        ]
        yield from pa.Table.from_arrays(columns, ROW_NAMES).to_batches(max_chunksize=10_000)
        sent = []
        for k in np.unique(owner):
            run_ = known[owner == k] - k * width
            sent.append((None, None, part, int(k), None, None, len(run_), *golomb_encode(run_)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*sent), ROW_TYPES)], ROW_NAMES)

    return run


def _answer(runs: pa.Table) -> pa.Table:
    """For each run of an owner, a bitmap of the fingerprints that another run holds too."""
    columns = [runs.column(c).to_pylist() for c in ("n", "shift", "high", "low")]
    decoded = [golomb_decode(*run) for run in zip(*columns)]
    values, counts = np.unique(np.concatenate(decoded), return_counts=True)
    shared, maps = values[counts > 1], []
    for prints in decoded:
        bits = np.packbits(np.isin(prints, shared), bitorder="little")
        maps.append(np.frombuffer(bits.tobytes().ljust(-(-len(bits) // 8) * 8, b"\0"), "<i8"))
    return pa.table(
        {"part": runs.column("part"), "owner": runs.column("owner"), "bitmap": pa.array(maps, pa.list_(pa.int64()))}
    )


def _small(side: DataFrame) -> DataFrame:
    """A side for joins on its digest: sent to all tasks if a count proves it small, else left to the optimizer."""
    return F.broadcast(side) if side.count() <= MAX_BROADCAST_ROWS else side


def _verdicts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, suspect) per row, and (digest, keep_id, group_size, n_keep) per suspect text."""
    spark = docs.sparkSession
    ids = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = ids.select(F.count(F.lit(1))).first()[0]
    bits = min(62, max(1, rows).bit_length() + FALSE_SUSPECT_BITS)
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // OWNER_FINGERPRINTS + 1)
    # written once: a row's place must stay that of the run its partition sent
    sent = checkpoint(ids.select("doc_id", digest(F.col("text")).alias("digest")).mapInArrow(_send(bits, owners), ROW_SCHEMA))
    runs = sent.where(F.col("n").isNotNull()).select("part", "owner", "n", "shift", "high", "low")
    answers = runs.groupBy("owner").applyInArrow(_answer, "part int, owner int, bitmap array<long>")
    word = F.element_at("bitmap", F.shiftright("place", 6) + 1)
    marked = checkpoint(
        sent.where(F.col("n").isNull())
        .join(answers, ["part", "owner"])
        .select(
            "doc_id",
            "digest",
            (F.col("repeated") | (F.bit_get(word, F.col("place").bitwiseAND(F.lit(63))) == 1)).alias("suspect"),
        )
    )
    suspects = checkpoint(marked.where("suspect").select("digest").distinct())
    texts = ids.select("doc_id", digest(F.col("text")).alias("digest"), normal(F.col("text")).alias("normal"))
    verified = (
        texts.join(_small(suspects), "digest", "left_semi")
        .groupBy("digest", "normal")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", "keep_id", "group_size")
    )
    return marked, checkpoint(verified)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row. Runs jobs."""
    marked, groups = _verdicts(docs, id_col, text_col)
    alone = marked.where(~F.col("suspect")).select(
        "doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    grouped = marked.where("suspect").join(groups, "digest").select("doc_id", "digest", "keep_id", "group_size")
    return alone.unionByName(grouped).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, key: Column, verdicts: DataFrame, id_col: str) -> DataFrame:
    """The rows of `docs` that stay under verdicts (key, keep_id, n_keep) on keys that lose rows.

    A key without verdict keeps all its rows, one with n_keep = 0 none; others keep the row with
    doc_id = keep_id, and one of them where n_keep rows have it. Any column names are safe.
    """
    names = [f"__c{i}" for i in range(len(docs.columns))]
    doc_id = F.col(names[docs.columns.index(id_col)]).cast("long")
    judged = (
        docs.select("*", key)
        .toDF(*names, "__key")
        .join(_small(verdicts.toDF("__key", "__keep", "__n")), "__key", "left")
        .where(F.col("__n").isNull() | ((F.col("__n") > 0) & doc_id.eqNullSafe(F.col("__keep"))))
    )
    single = judged.where(F.coalesce(F.col("__n"), F.lit(1)) == 1)
    one_of = judged.where(F.col("__n") > 1).dropDuplicates(["__key"])
    return single.unionByName(one_of).select(*names).toDF(*docs.columns)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with one row of each group of equal texts, that with the largest doc_id. Runs jobs."""
    marked, groups = _verdicts(docs, id_col, text_col)
    several = groups.where("group_size > 1")
    # how many rows of a group have the doc_id that stays
    kept = marked.where("suspect").join(several, "digest").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    verdicts = kept.groupBy("digest", "keep_id").agg(F.count(F.lit(1)).alias("n_keep"))
    return keep_rows(docs, digest(docs[text_col]), checkpoint(verdicts), id_col)


ORACLE_SQL = """
WITH folded AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM folded WINDOW w AS (PARTITION BY t)
"""
