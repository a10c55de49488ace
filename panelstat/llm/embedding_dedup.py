"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

Vectors of equal label link at a cosine of `least` or more. A filter is a direction; a vector passes
it if its cosine with the direction reaches `cap`. Directions are the products of `blocks` random
codes of `words` unit codewords each: one codeword per block of coordinates, all combinations, so a
few hundred stored codewords stand for tens of thousands of directions. List decoding finds all
directions a vector passes from its sorted block scores without testing every combination.

1. Equal (label, vector) rows are one node with a count; nodes are normalised in double precision.
2. Each node is listed under every filter it passes. A vector at cosine 0.93 to another passes a filter
   that the other passes with a probability above one half. A vector that passes fewer than `LEAST_FILTERS`
   lowers its own cap until it lists that many. The tests measure recall by brute force.
3. Nodes that share (label, filter) are compared in tasks that stream sorted buckets, first by bytes:
   each listing carries coordinates rounded to one byte and the exact norm of the rounding error, so
   that a bound on the error never drops a link. A large bucket is cut into blocks, and pairs of
   blocks are dealt to tasks of their own; every pair of a bucket is compared and none is emitted that
   the bound rules out.
4. Pairs that remain are confirmed once each by the cosine of the whole vectors in double precision.

Edge cases: null labels, null or empty vectors, null or non-finite components and zero vectors link
with nothing; vectors of unlike length link with nothing; a null vec_id links but names no component;
repeated rows count as further vectors; an empty table returns none; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstat.llm.components import components
from panelstat.session import checkpoint

BLOCKS = 2
WORDS = 160
CAP = 0.36  # of a filter direction in 64 dimensions: 2.9 standard deviations of a random vector's cosine
CAP_DIMENSIONS = 64
LEAST_FILTERS = 40
BUCKET_ROWS = 2_048
LIST_SCHEMA = "label long, size int, node long, filters array<int>, code binary, error double"
PAIR_SCHEMA = "a long, b long"


@functools.cache
def codebooks(dimensions: int) -> list[np.ndarray]:
    """Per block of coordinates, random unit codewords."""
    rng = np.random.default_rng(16 + dimensions)
    edges = np.linspace(0, dimensions, min(BLOCKS, dimensions) + 1).astype(int)
    books = []
    for a, b in zip(edges, edges[1:]):
        book = rng.standard_normal((WORDS, b - a))
        books.append(book / np.linalg.norm(book, axis=1, keepdims=True))
    return books


def decode(unit: np.ndarray, cap: float) -> np.ndarray:
    """Numbers of all filters whose direction has a cosine of at least `cap` with the unit vector.

    A direction is its codewords side by side over the root of their number. Blocks are joined one
    by one; a partial combination stays only if the best words of the later blocks can still lift it.
    """
    books = codebooks(len(unit))
    edges = np.cumsum([0] + [b.shape[1] for b in books])
    scores = [book @ unit[a:b] for book, a, b in zip(books, edges, edges[1:])]
    need = cap * np.sqrt(len(books))
    rest = np.append(np.cumsum([s.max() for s in scores][::-1])[::-1][1:], 0.0)
    number, total = np.zeros(1, np.int64), np.zeros(1)
    for score, later in zip(scores, rest):
        order = np.argsort(-score)
        falling = score[order]
        # words of this block that each partial combination can take, best first
        takes = np.searchsorted(-falling, -(need - later - total), side="right")
        which = np.repeat(np.arange(len(total)), takes)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(takes) - takes, takes)
        number, total = number[which] * WORDS + order[nth], total[which] + falling[nth]
    return np.sort(number).astype(np.int32)


def scaled_cap(dimensions: int) -> float:
    """The cap that keeps the share of random vectors a filter passes the same in other dimensions."""
    return min(0.95, CAP * np.sqrt(CAP_DIMENSIONS / dimensions))


def filters(unit: np.ndarray) -> np.ndarray:
    """All filters beyond the cap; a vector that lists few lowers its own cap step by step until it lists
    `LEAST_FILTERS`, or all there are."""
    cap, every = scaled_cap(len(unit)), WORDS ** len(codebooks(len(unit)))
    found = decode(unit, cap)
    while len(found) < min(LEAST_FILTERS, every):
        cap -= 0.02
        found = decode(unit, cap)
    return found


def _list(batches):
    for batch in batches:
        listed, codes, errors, sizes = [], [], [], []
        for vector in batch.column("vector").to_pylist():
            v = np.array(vector)
            unit = v / np.abs(v).max()
            unit /= np.linalg.norm(unit)
            found = filters(unit)
            step = np.abs(unit).max() / 127
            code = np.rint(unit / step).astype(np.int8)
            listed.append(found)
            codes.append(np.float32(step).tobytes() + code.tobytes())
            errors.append(float(np.linalg.norm(unit - code * np.float64(np.float32(step)))))
            sizes.append(len(unit))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("label"), pa.array(sizes, pa.int32()), batch.column("node"),
                pa.array(listed, pa.list_(pa.int32())), pa.array(codes, pa.binary()), pa.array(errors, pa.float64()),
            ],
            ["label", "size", "node", "filters", "code", "error"],
        )


def _possible(rows: list[tuple], least: float):
    """Pairs of a bucket, or of two of its blocks, that the rounded coordinates don't rule out."""
    node = np.array([r[0] for r in rows])
    side = np.array([r[1] for r in rows])  # 0: compared among themselves, 1 and 2: with each other
    raw = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
    step = np.ascontiguousarray(raw[:, :4]).view("<f4")
    unit = raw[:, 4:].view(np.int8).astype(np.float32) * step
    error = np.array([r[3] for r in rows])
    left = np.flatnonzero(side != 2)
    right = np.flatnonzero(side != 1)
    for at in range(0, len(left), 512):
        some = left[at : at + 512]
        bound = unit[some] @ unit[right].T + error[some, None] + error[right] + error[some, None] * error[right]
        i, j = np.nonzero(bound >= least - 1e-5)  # room for single precision sums
        a, b = node[some[i]], node[right[j]]
        keep = (a != b) if side[0] else (a < b)
        yield np.minimum(a, b)[keep], np.maximum(a, b)[keep]


def _pairs(least: float):
    """Rows sorted by bucket and block pair; emits the possible pairs of each."""

    def run(batches):
        held, key = [], None

        def done():
            if len(held) > 1:
                for a, b in _possible(held, least):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            names = ("label", "size", "filter", "i", "j", "node", "side", "code", "error")
            for label, size, filter_, i, j, *row in zip(*(batch.column(c).to_pylist() for c in names)):
                if (label, size, filter_, i, j) != key:
                    yield from done()
                    held, key = [], (label, size, filter_, i, j)
                held.append(tuple(row))
        yield from done()

    return run


def _candidates(listed: DataFrame, least: float) -> DataFrame:
    keys = ["label", "size", "filter"]
    rows = listed.select("label", "size", F.explode("filters").alias("filter"), "node")
    sizes = checkpoint(
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(*keys, F.ceil(F.col("n") / BUCKET_ROWS).alias("blocks"))
    )
    placed = (
        listed.select("label", "size", F.explode("filters").alias("filter"), "node", "code", "error")
        .join(sizes, keys)
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    )
    # a block meets each block once: as the lower or the higher of the pair, or by itself
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = met.select(
        *keys,
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "node",
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
        "code",
        "error",
    )
    order = [*keys, "i", "j"]
    return dealt.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(_pairs(least), PAIR_SCHEMA).distinct()


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows, scaled first so that squares neither overflow nor vanish."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def _cosines(batches):
    for batch in batches:
        va, vb = (batch.column(c) for c in ("va", "vb"))
        sizes, out = np.array(va.value_lengths().to_pylist(), int), np.empty(len(batch))
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            out[rows] = _cosine(*(x.take(pa.array(rows)).flatten().to_numpy().reshape(-1, size) for x in (va, vb)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], ["a", "b", "cosine"])


def links(nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a < b, of nodes (node, label, vector) at a cosine of `least` or more. Runs jobs."""
    listed = checkpoint(nodes.select("label", "node", "vector").mapInArrow(_list, LIST_SCHEMA))
    pairs = checkpoint(_candidates(listed, least))
    left, right = nodes.select(F.col("node").alias("a"), F.col("vector").alias("va")), nodes.select(
        F.col("node").alias("b"), F.col("vector").alias("vb")
    )
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb")
    return checkpoint(both.mapInArrow(_cosines, "a long, b long, cosine double").where(F.col("cosine") >= least).select("a", "b"))


def near_vectors(
    vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row, kept where vec_id = component_id. Runs jobs."""
    vector = F.transform(vectors[vector_col], lambda x: x.cast("double"))
    rows = vectors.select(
        vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("long").alias("label"), vector.alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    rows = checkpoint(rows.withColumn("usable", F.coalesce(usable, F.lit(False))))
    node = F.xxhash64("label", "vector")
    nodes = checkpoint(
        rows.where("usable")
        .groupBy(node.alias("node"))
        .agg(
            F.first("label").alias("label"),
            F.first("vector").alias("vector"),
            F.count(F.lit(1)).alias("n"),
            F.min("vec_id").alias("vec_id"),
        )
    )
    found = links(nodes, least)
    both = found.union(found.select("b", "a")).toDF("node", "other")
    weights = nodes.select(F.col("node").alias("other"), "n")
    degree = both.join(weights, "other").groupBy("node").agg(F.sum("n").alias("linked"))
    roots = components(found)
    grouped = nodes.select("node", "n", "vec_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = checkpoint(grouped.groupBy("root").agg(F.min("vec_id").alias("component_id")))
    named = checkpoint(
        grouped.join(smallest, "root")
        .join(degree, "node", "left")
        .select("node", "component_id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    )
    keyed = rows.select("vec_id", F.when(F.col("usable"), node).alias("node"))
    result = keyed.join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return result.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


# every pair of a label; components by the smallest vec_id reachable
ORACLE_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93
),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links,
       (SELECT min(b) FROM reach WHERE reach.a = e.vec_id) AS component_id,
       e.vec_id = (SELECT min(b) FROM reach WHERE reach.a = e.vec_id) AS kept
FROM embeddings e
"""
