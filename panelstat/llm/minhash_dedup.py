"""Near-duplicate documents by one-permutation MinHash with optimal densification.

Words are runs of characters other than space and control white space, A-Z lower-cased; a document's
set holds its distinct shingles of five words, or its whole word sequence if shorter. Documents link
when intersection over union of their sets is at least `percent` / 100.

1. One pass hashes each text's shingles. One permutation yields the whole signature: the hash range
   is cut into bins, each keeps its smallest hash, and an empty bin borrows from the bins that a
   universal hash of (bin, attempt) names, the first that is not empty (optimal densification).
2. Texts equal up to the case of A-Z are one node. Bands of `rows` bins are bucket keys. In each
   bucket the pairs (member, head) are candidates, the head being the member that has most company
   over all its buckets, which the original of many copies has.
3. Candidates are confirmed on full shingle sets of the whole texts. Large stars are cut into chunks
   that each get a copy of the head's text; a task streams its rows and holds one head.
4. Links become components. Buckets whose members lie in several components stay open: their members
   may resemble one another without resembling the head.
5. The members of open buckets are joined on prefixes: shingles stand in one order, rare ones first, and
   two similar sets must share one of their first few. A shingle that only one member has is left out, so
   private edits fill a member's prefix and members that resemble but do not link hardly meet. Sizes
   and places of the shared shingle rule out more. Pairs of different components that remain are
   confirmed on full sets. How rare a shingle is says a table of 2 ** SLOTS_LOG bytes over its hash;
   any order gives the same pairs, a poorer one only more candidates.
6. Links become components again, components take their smallest doc_id.

So every pair that shares a bucket is compared, ruled out by its prefixes, or of one component already;
candidates of a bucket are a star, not its pairs. With 32 bands of 4 bins a pair at similarity 0.75
shares no bucket with probability 5e-6 and less above; tests compare with brute force.

Node ids are 64-bit hashes of texts, shingles 64-bit hashes of words.

Edge cases: texts without words, empty or null have n_shingles 0 and link with nothing, not with each
other; a null doc_id takes part in links but never names a component: its component_id is null if no
member has one, and kept is false; repeated rows share a component; an empty table returns none;
other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstat.llm.components import components
from panelstat.llm.exact_dedup import keep_rows, normal
from panelstat.llm.worker import tidied
from panelstat.session import checkpoint

BINS_LOG = 7
BINS = 1 << BINS_LOG
MAX_WORDS = 100_000
MAX_BROADCAST_ROWS = 300_000
CHUNK = 128
SLOTS_LOG = 22
SLOT_RANGE = 1 << 16
PRIME = np.uint64(0x9E3779B97F4A7C15)
SALT = np.uint64(0xC2B2AE3D27D4EB4F)

SIGNED_SCHEMA = "doc_id long, node long, n_shingles long, buckets array<long>"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def _forget() -> None:
    _hashes.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; empty without words."""
    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII alone
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    total = np.full(len(h) - width + 1, np.uint64(width * int(SALT) % 2**64), np.uint64)
    for j in range(width):
        total = total * PRIME + h[j : len(h) - width + 1 + j]
    return np.unique(_mix(total))


@functools.cache
def _attempts(n: int = 4096) -> np.ndarray:
    """Row t: the bin that each bin asks at attempt t."""
    rng = np.random.default_rng(20170614)
    prime = (1 << 31) - 1
    a, b = rng.integers(1, prime, (n, 1)), rng.integers(0, prime, (n, 1))
    return ((a * np.arange(1, BINS + 1) + b) % prime % BINS).astype(np.intp)


_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS_LOG)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Smallest hash per bin, empty bins densified. `hashes` sorted and not empty."""
    first = np.searchsorted(hashes, _EDGES)
    full = np.append(first[1:], len(hashes)) > first
    if full.all():
        return hashes[first]
    source = np.arange(BINS)
    empty = np.flatnonzero(~full)
    for upto in (64, 4096):
        asked = _attempts()[:upto, empty]
        hit = full[asked]
        found = hit.any(axis=0)
        source[empty[found]] = asked[hit.argmax(axis=0), np.arange(len(empty))][found]
        empty = empty[~found]
        if not len(empty):
            break
    filled = np.flatnonzero(full)
    source[empty] = filled[np.searchsorted(filled, empty) % len(filled)]
    return hashes[first[source]]


def bucket_keys(hashes: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of `rows` bins; the band is part of the key."""
    bands = signature(hashes).reshape(-1, rows)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64) * SALT
    for j in range(rows):
        key = _mix(key * PRIME + bands[:, j])
    return key.view(np.int64)


def _sign(rows: int, width: int):
    def run(batches):
        for batch in batches:
            counts, keys = [], []
            for text in batch.column("text"):  # one text at a time: a batch of long ones is large
                s = shingles(text.as_py(), width)
                counts.append(len(s))
                keys.append(bucket_keys(s, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("node"), pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "node", "n_shingles", "buckets"],
            )

    return run


def _compare(percent: int, width: int):
    """Rows sorted by (head, chunk), each chunk's head text first; keeps the members that link to it."""

    def run(batches):
        at, held = None, None
        for batch in batches:
            a, b = [], []
            columns = [batch.column(c).to_pylist() for c in ("head", "chunk", "member")]
            for head, chunk, member, text in zip(*columns, batch.column("text")):
                own = shingles(text.as_py(), width)
                if member is None:
                    at, held = (head, chunk), own
                elif at == (head, chunk) and 100 * min(len(own), len(held)) >= percent * max(len(own), len(held)):
                    both = len(np.intersect1d(own, held, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(held) - both):
                        a.append(member)
                        b.append(head)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _small(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= MAX_BROADCAST_ROWS else side


def confirm(candidates: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The candidate pairs (member, head) whose full sets are similar enough, as links (a, b)."""
    candidates = checkpoint(candidates.distinct())
    needed = checkpoint(candidates.select("member").union(candidates.select("head")).distinct().toDF("node"))
    whole = checkpoint(
        texts.join(_small(needed), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    )
    stars = checkpoint(
        candidates.groupBy("head").agg(F.count(F.lit(1)).alias("n")).select("head", F.ceil(F.col("n") / CHUNK).alias("chunks"))
    )
    members = (
        candidates.join(stars, "head")
        .join(whole.withColumnRenamed("node", "member"), "member")
        .select("head", F.pmod(F.xxhash64("member"), "chunks").alias("chunk"), "member", "text")
    )
    heads = stars.join(whole.withColumnRenamed("node", "head"), "head").select(
        "head", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("member"), "text"
    )
    rows = members.unionByName(heads).repartition("head", "chunk")
    ordered = rows.sortWithinPartitions("head", "chunk", F.col("member").asc_nulls_first())
    return checkpoint(ordered.mapInArrow(tidied(_compare(percent, width)), "a long, b long"))


def _open_members(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component) of the members of buckets whose members are of several components."""
    roots = roots.withColumnRenamed("node", "member")
    rows = shared.select("bucket", "member").join(roots, "member", "left")
    rows = checkpoint(rows.select("bucket", "member", F.coalesce("root", "member").alias("component")))
    ends = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    several = checkpoint(ends.where("low <> high").select("bucket"))
    return rows.join(several, "bucket", "left_semi").select(F.col("member").alias("node"), "component").distinct()


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS_LOG)).astype(np.int64)


def _slot_counts(width: int):
    """How many of a task's texts have a shingle in each slot."""

    def run(batches):
        counts = np.zeros(1 << SLOTS_LOG, np.int32)
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(counts, _slots(shingles(text.as_py(), width)), 1)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots].astype(np.int64))], ["slot", "n"])

    return run


def _range_levels(key, table):
    """The counts of a range of slots, a byte each: 0 and 1 as they are, more on a logarithmic scale."""
    levels = np.zeros(SLOT_RANGE, np.uint8)
    counts = table.column("n").to_numpy()
    levels[table.column("slot").to_numpy() % SLOT_RANGE] = np.where(counts > 1, np.minimum(255, 4 * np.log2(counts) - 2), counts)
    return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "levels": pa.array([levels.tobytes()], pa.binary())})


def _levels(texts: DataFrame, width: int) -> np.ndarray:
    """How common shingles are among the texts, a byte for each of 2 ** SLOTS_LOG slots."""
    counts = texts.select("text").mapInArrow(tidied(_slot_counts(width)), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    ranges = counts.groupBy(F.floor(F.col("slot") / SLOT_RANGE).alias("at")).applyInArrow(_range_levels, "at long, levels binary")
    levels = np.zeros(1 << SLOTS_LOG, np.uint8)
    for at, some in ranges.collect():  # a byte a slot in all
        levels[at * SLOT_RANGE : (at + 1) * SLOT_RANGE] = np.frombuffer(bytes(some), np.uint8)
    return levels


def _prefixes(levels, percent: int, width: int):
    """The rarest shingles of each text, as many as a similar text of smaller or equal size must share one
    of, without those that no other text has."""

    def run(batches):
        for batch in batches:
            out = [], [], [], [], []
            for node, component, text in zip(batch.column("node").to_pylist(), batch.column("component").to_pylist(), batch.column("text")):
                own = shingles(text.as_py(), width)
                level = levels.value[_slots(own)]
                order = np.lexsort((own, level))[: len(own) + 1 + (-percent * len(own) // 100)]
                places = np.flatnonzero(level[order] > 1)
                tokens = own[order[places]].view(np.int64)
                for column, values in zip(out, (tokens, places, *(np.full(len(places), x, np.int64) for x in (node, component, len(own))))):
                    column.append(values)
            arrays = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out]
            yield pa.RecordBatch.from_arrays(arrays, ["token", "place", "node", "component", "size"])

    return run


def _prefix_pairs(rest: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (member, head) of different components among the nodes of `rest` that can be similar enough:
    they share one of their rarest shingles, and sizes and places leave room for the intersection."""
    spark = rest.sparkSession
    whole = texts.join(_small(rest), "node").groupBy("node", "component").agg(F.first("text").alias("text"))
    whole = checkpoint(whole)
    levels = spark.sparkContext.broadcast(_levels(whole, width))
    schema = "token long, place long, node long, component long, size long"
    tokens = checkpoint(whole.mapInArrow(tidied(_prefixes(levels, percent, width)), schema))
    a, b = tokens.alias("a"), tokens.alias("b")

    def least(sizes: Column) -> Column:
        return F.ceil(sizes * percent / (100 + percent))

    # the smaller of a pair needs to show less of itself
    shorter = b.where(F.col("place") < F.col("size") - least(F.col("size") * 2) + 1).alias("b")
    larger = (F.col("a.size") > F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.node") > F.col("b.node")))
    left = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))
    fits = (100 * F.col("b.size") >= percent * F.col("a.size")) & (left >= least(F.col("a.size") + F.col("b.size")))
    met = a.join(shorter, (F.col("a.token") == F.col("b.token")) & (F.col("a.component") != F.col("b.component")) & larger & fits)
    return met.select(F.col("a.node").alias("member"), F.col("b.node").alias("head")).distinct()


def _links(shared: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """(node, root) from the links of all pairs that share a bucket. `shared` has the buckets' members."""
    heads = checkpoint(
        shared.groupBy("bucket").agg(F.max(F.struct("company", "member")).alias("h")).select("bucket", F.col("h.member").alias("head"))
    )
    stars = shared.select("bucket", "member").join(heads, "bucket").where("member <> head")
    links = confirm(stars.select("member", "head"), texts, percent, width)
    roots = components(links)
    rest = checkpoint(_open_members(shared, roots))
    if rest.isEmpty():
        return roots
    return components(links.union(confirm(_prefix_pairs(rest, texts, percent, width), texts, percent, width)))


def _node(text: Column) -> Column:
    return F.xxhash64(F.md5(normal(text)))


def _grouped(docs: DataFrame, percent: int, width: int, rows: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n_shingles) per row, and (node, doc_id, root) per node with words; a node's doc_id is its smallest."""
    texts = docs.select(
        docs[id_col].cast("long").alias("doc_id"), _node(docs[text_col]).alias("node"), docs[text_col].alias("text")
    )
    signed = checkpoint(texts.mapInArrow(tidied(_sign(rows, width), _forget), SIGNED_SCHEMA))
    nodes = checkpoint(
        signed.where("n_shingles > 0").groupBy("node").agg(F.first("buckets").alias("buckets"), F.min("doc_id").alias("doc_id"))
    )
    placed = nodes.select(F.explode("buckets").alias("bucket"), F.col("node").alias("member"))
    sizes = checkpoint(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = checkpoint(placed.join(sizes, "bucket"))
    company = checkpoint(shared.groupBy("member").agg(F.sum("n").alias("company")))
    shared = checkpoint(shared.join(company, "member"))
    roots = _links(shared, texts.select("node", "text"), percent, width)
    grouped = nodes.select("node", "doc_id").join(roots, "node", "left")
    return signed, grouped.select("node", "doc_id", F.coalesce("root", "node").alias("root"))


def near_duplicates(
    docs: DataFrame,
    percent: int = 75,
    width: int = 5,
    rows: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row, kept where doc_id = component_id. Runs jobs."""
    signed, grouped = _grouped(docs, percent, width, rows, id_col, text_col)
    smallest = checkpoint(grouped.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    named = checkpoint(grouped.join(smallest, "root").select("node", "component_id"))
    found = signed.select("doc_id", "node", "n_shingles").join(named, "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def deduplicate(
    docs: DataFrame,
    percent: int = 75,
    width: int = 5,
    rows: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of `docs` with one row of each component, that of smallest doc_id (a null one only where
    the component has no other); rows without words all stay. Runs jobs."""
    signed, grouped = _grouped(docs, percent, width, rows, id_col, text_col)
    grouped = checkpoint(grouped)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")
    winners = checkpoint(grouped.groupBy("root").agg(F.min(order).alias("w")).select("root", "w.node", F.col("w.doc_id").alias("keep_id")))
    losers = grouped.select("node", "root").join(winners.select("root", F.col("node").alias("winner")), "root").where("node <> winner")
    lost = losers.select("node", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("n_keep"))
    # rows of a winning text, of which one stays
    rows_ = signed.where("n_shingles > 0").join(winners.select("node", "keep_id"), "node")
    equal = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    won = (
        rows_.groupBy("node", "keep_id")
        .agg(F.sum(equal.cast("long")).alias("n_keep"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("node", "keep_id", "n_keep")
    )
    return keep_rows(docs, _node(docs[text_col]), checkpoint(lost.union(won)), id_col)
