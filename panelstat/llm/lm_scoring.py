"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

The network predicts a word from `REACH` words on either side: h = tanh(sum of the position's
embeddings of the neighbours + bias), then walks a tree of LEVELS levels over the words in order of
their counts, with one softmax over a node's children a level; a node has about the cube root of
the vocabulary as children, so the work of a word hardly grows with the vocabulary. A document's score is the sum over its words of the log-probability of each word given both sides.

1. Words (A-Z lower-cased, split at white space, known by 64-bit hashes) are counted over the whole corpus, within tasks first.
   The most frequent become the vocabulary, which grows with the square root of the words counted. All
   others share hash buckets, and a word has that part of its bucket's probability which its count has
   of the bucket's. These parts stay a table, joined to the words of each text that it concerns.
   The texts are written once as ids of words; all later passes read these.
2. Training takes every word of every document as a target: a hash of document and position deals the
   positions to `mask_every` turns, one a round. In each round every task starts from the same weights
   and runs Adagrad over its own documents, in batches that grow from FIRST_BATCH to BATCH, each of which
   updates only the rows of the tables that it touches; the weights
   are averaged by the number of targets, in two steps so that no task gathers those of all tasks. A
   round also measures the loss of the weights it starts from on its targets in a part of the documents,
   which no round of the first cycle trained on before. Rounds go on until all turns were taken and the
   loss falls by less than SETTLED of the first loss. What is counted and averaged grows with the
   corpus; only the vocabulary and one set of weights, of the size of the vocabulary, reach the driver.
3. Scoring masks every word of every text in turn.

Edge cases: null, empty and blank texts have no words, score 0 and a null mean; a word's missing
neighbours at either end are a padding word; a text of any length is scored whole, in slices; a null
doc_id is kept; repeated rows score alike; words of equal count are ordered by their hashes; an
empty table returns none; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstat.llm.word_hashes import hashed_texts
from panelstat.session import checkpoint, shuffles_removed

CLASSES = 32
SIZE = CLASSES**2
LEVELS = 3
NO_CHILD = -1e4  # bias of a child that stands for no word: its share is zero, so it never moves
BUCKETS = 256
REACH = 2
HIDDEN = 16
OFFSETS = [d for d in range(-REACH, REACH + 1) if d]
PAD = SIZE  # a further row of the embeddings
FIRST_BATCH = 256
BATCH = 8_192
SETTLED = 0.01
MEASURED_EVERY = 16
SLICE = 16_384
BLOCK = 65_536
MAX_COUNTED = 2_000_000
LONG_RUN = 128
FEW_RUNS = 128
PIECE = 4_096
FAN_IN = 64


class Vocabulary(NamedTuple):
    """Sorted hashes of the most frequent words, their ranks, the root of the number of ids, the buckets of other words."""

    known: np.ndarray
    rank: np.ndarray
    classes: int = CLASSES
    buckets: int = BUCKETS

    @property
    def top(self) -> int:
        return self.classes**2 - self.buckets


def fan_outs(classes: int) -> list[int]:
    """Children of a node of each level of the tree over classes ** 2 ids; twice as many in the last, whose nodes have few words of a batch each."""
    fan = int(np.ceil((classes**2 / 2) ** (1 / LEVELS)))
    return [fan] * (LEVELS - 1) + [2 * fan]


def shapes(classes: int) -> dict[str, tuple[int, ...]]:
    fans = fan_outs(classes)
    out = {
        "embedding": (len(OFFSETS), classes**2 + 1, HIDDEN),  # the last row is that of the padding word
        "bias": (HIDDEN,),
    }
    for level in range(LEVELS):
        nodes = -(-(classes**2) // math.prod(fans[level:]))
        out[f"node{level}"] = (nodes, HIDDEN + 1, fans[level])  # the last row holds the children's biases
    return out


def classes_for(words: int) -> int:
    """Root of the number of ids, which is about the square root of the words counted; at least CLASSES."""
    return max(CLASSES, 8 * int(np.ceil(words**0.25 / 8)))


def to_ids(hashes: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Ids of hashed words: a vocabulary word's rank, else the number of these plus its bucket."""
    ids = vocabulary.top + (hashes % np.uint64(vocabulary.buckets)).astype(np.int32)
    known = vocabulary.known
    if len(known):
        # known hashes lie in order, so those that begin with the same bits follow one another
        bits = len(known).bit_length() + 2
        shift = np.uint64(64 - bits)
        alike = np.bincount((known >> shift).astype(np.intp), minlength=1 << bits)
        begin = (hashes >> shift).astype(np.intp)
        at, n = (np.cumsum(alike) - alike)[begin], alike[begin]
        some, step = np.flatnonzero(n), 0
        while len(some):
            hit = known[at[some] + step] == hashes[some]
            found = some[hit]
            ids[found] = vocabulary.rank[at[found] + step]
            step += 1
            some = some[~hit]
            some = some[n[some] > step]
    return ids


def _order(ids: np.ndarray, size: int) -> np.ndarray:
    """Stable order of ids up to `size`. Values of 16 bits are sorted by their digits, so wider ids go by halves."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    if size > np.iinfo(np.uint16).max:
        order = order[np.argsort((ids >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def start_weights(classes: int = CLASSES) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(4)
    out = {
        k: (0.1 * rng.standard_normal(s) if len(s) > 1 else np.zeros(s)).astype(np.float32)
        for k, s in shapes(classes).items()
    }
    for level in range(LEVELS):
        nodes, _, fan = out[f"node{level}"].shape
        # a child's first word
        first = np.arange(nodes * fan).reshape(nodes, fan) * math.prod(fan_outs(classes)[level + 1 :])
        out[f"node{level}"][:, HIDDEN] = np.where(first < classes**2, np.float32(0), np.float32(NO_CHILD))
    return out


class Block(NamedTuple):
    """Words of some texts, with REACH padding words before, between and after the texts."""

    padded: np.ndarray
    at: np.ndarray  # place of each word in `padded`
    doc: np.ndarray  # text of each word
    place: np.ndarray  # place of each word in its text

    def windows(self, some: np.ndarray | slice) -> np.ndarray:
        """Neighbour ids (one row per offset) of the given words."""
        at = self.at[some]
        return np.stack([self.padded[at + d] for d in OFFSETS])


def block(ids: np.ndarray, sizes: np.ndarray, pad: int = PAD) -> Block:
    """Of the texts whose ids follow one another in `ids`."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    every = np.arange(len(ids), dtype=np.int32)
    at = every + np.int32(REACH) * (doc + np.int32(1))
    padded = np.full(len(ids) + REACH * (len(sizes) + 1), pad, np.int32)
    padded[at] = ids
    return Block(padded, at, doc, every - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes))


def _hidden(w: dict, around: np.ndarray) -> np.ndarray:
    total = w["embedding"][0].take(around[0], axis=0)
    for j in range(1, len(OFFSETS)):
        total += w["embedding"][j].take(around[j], axis=0)
    total += w["bias"]
    h = np.ones((len(total), HIDDEN + 1), total.dtype)  # the last column takes the biases
    np.tanh(total, out=h[:, :HIDDEN])
    return h


def _powers(z: np.ndarray) -> np.ndarray:
    """Turns columns into their exponentials, the largest being one, and returns the sums."""
    z -= z.max(axis=0)
    np.exp(z, out=z)
    return z.sum(axis=0)


def _log_share(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log-softmax of each column at the chosen row."""
    z -= z.max(axis=0)
    out = z.reshape(-1).take(chosen)
    np.exp(z, out=z)
    return out - np.log(z.sum(axis=0))


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Places of a sorted array at which another value begins."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return np.flatnonzero(new)


def _walk(w: dict, h: np.ndarray, target: np.ndarray):
    """Per level, for rows sorted by target: scores of the children, a row for each child so that sums over the
    children run along the words; the places there of the children taken, the distinct nodes and their runs of rows."""
    fans = [w[f"node{level}"].shape[2] for level in range(LEVELS)]
    n = len(target)
    every = np.arange(n)
    for level, fan in enumerate(fans):
        child = target // math.prod(fans[level + 1 :])
        node = child // fan
        first = _firsts(node)
        found = node[first]
        runs = list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), n]))
        weights = w[f"node{level}"]
        if n < LONG_RUN * len(runs):
            z = np.empty((n, fan), h.dtype)
            for k, start, stop in runs:
                h[start:stop].dot(weights[k], z[start:stop])
            z = z.T.copy()
        else:
            z = np.empty((fan, n), h.dtype)
            for k, start, stop in runs:
                np.matmul(weights[k].T, h[start:stop].T, out=z[:, start:stop])
        yield level, z, (child - node * fan).astype(np.intp) * n + every, found, runs


def log_probabilities(w: dict, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each target id given its neighbours."""
    order = _order(target, w["embedding"].shape[1])
    target = target[order]
    total = np.zeros(len(target), w["bias"].dtype)
    for _, z, chosen, _, _ in _walk(w, _hidden(w, around.take(order, axis=1)), target):
        total += _log_share(z, chosen)
    out = np.empty_like(total)
    out[order] = total
    return out


def _sums(rows: np.ndarray, order: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows[order], the sums of the runs that begin at `first`, and the order of the runs in which they come.

    The longest runs come first, so those with an r-th row are a prefix, which takes all r-th rows at once;
    of the few runs longer than that the rest is summed run by run, two columns at once as complex numbers.
    """
    n = np.diff(first, append=len(order))
    by = _order(n.max() - n, int(n.max()))
    at, longer = first[by], (len(n) - np.cumsum(np.bincount(n))).tolist()
    out = rows.take(order[at], axis=0)
    r = 1
    while longer[r] > FEW_RUNS:
        out[: longer[r]] += rows.take(order[at[: longer[r]] + r], axis=0)
        r += 1
    if few := longer[r]:
        sizes = n[by[:few]] - r
        starts = np.cumsum(sizes) - sizes
        rest = rows.take(order[np.repeat(at[:few] + r - starts, sizes) + np.arange(sizes.sum())], axis=0)
        pairs = rest.view(np.result_type(rows.dtype, np.complex64))
        out[:few] += np.add.reduceat(pairs, starts, axis=0).view(rows.dtype)
    return out, by


def sparse_gradients(w: dict, around: np.ndarray, target: np.ndarray):
    """Of the mean negative log-probability: (name, index, values) of the rows that are not zero, each row once."""
    n = len(target)
    size = w["embedding"].shape[1]
    order = _order(target, size)
    around, target = around.take(order, axis=1), target[order]
    h = _hidden(w, around)
    back, part = np.zeros((n, HIDDEN), h.dtype), np.empty((n, HIDDEN), h.dtype)
    out = []
    for level, slope, chosen, found, runs in _walk(w, h, target):
        sums = _powers(slope)
        sums *= n
        slope /= sums
        slope.reshape(-1)[chosen] -= slope.dtype.type(1 / n)
        slope = slope.T.copy() if n < LONG_RUN * len(runs) else slope.T
        weights = w[f"node{level}"]
        turned = weights[:, :HIDDEN].transpose(0, 2, 1)
        grown = np.empty((len(found), *weights.shape[1:]), h.dtype)
        for i, (k, start, stop) in enumerate(runs):
            some = slope[start:stop]
            h[start:stop].T.dot(some, grown[i])
            some.dot(turned[k], part[start:stop])
        back += part
        out.append((f"node{level}", found, grown))
    inner = h[:, :HIDDEN]
    back -= back * inner * inner
    out.append(("bias", slice(None), np.ones(n, back.dtype) @ back))
    for j in range(len(OFFSETS)):
        order = _order(around[j], size)
        ids = around[j].take(order)
        first = _firsts(ids)
        sums, by = _sums(back, order, first)
        out.append(("embedding", (j, ids[first[by]]), sums))
    return out


def gradients(w: dict, around: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """`sparse_gradients` as whole tables."""
    out = {k: np.zeros_like(v) for k, v in w.items()}
    for k, at, values in sparse_gradients(w, around, target):
        out[k][at] = values
    return out


def _put(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """table[at] = rows, each row copied whole."""
    whole = np.dtype((np.void, rows[0].nbytes))
    table.reshape(len(table), -1).view(whole)[at, 0] = rows.reshape(len(rows), -1).view(whole)[:, 0]


class Held:
    """Windows and their targets, taken together once there are `batch` of them."""

    def __init__(self, batch: int):
        self.around: list[np.ndarray] = []
        self.target: list[np.ndarray] = []
        self.held, self.batch, self.seen = 0, batch, 0

    def add(self, around: np.ndarray, target: np.ndarray) -> None:
        self.around.append(around)
        self.target.append(target)
        self.held += len(target)
        if self.held >= self.batch:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        around, target = np.concatenate(self.around, axis=1), np.concatenate(self.target)
        self.around, self.target, self.held = [], [], 0
        self.take(around, target)
        self.seen += len(target)


class Loss(Held):
    """Sum of the negative log-probabilities of targets under given weights."""

    def __init__(self, weights: dict[str, np.ndarray]):
        super().__init__(SLICE)
        self.w, self.loss = weights, 0.0

    def take(self, around: np.ndarray, target: np.ndarray) -> None:
        self.loss -= float(log_probabilities(self.w, around, target).sum(dtype=np.float64))


class Trainer(Held):
    """Adagrad from given weights over masked windows, in batches across documents."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        super().__init__(FIRST_BATCH)
        self.w = {k: v.copy() for k, v in weights.items()}
        self.square = {k: np.full(v.shape, 1e-6, np.float32) for k, v in weights.items()}
        self.rate = rate

    def _update(self, k: str, rows, g: np.ndarray) -> None:
        w, square = self.w[k], self.square[k]
        if isinstance(rows, slice):
            w, square, g, rows = w[None], square[None], g[None], np.zeros(1, np.intp)
        elif isinstance(rows, tuple):
            j, rows = rows
            w, square = w[j], square[j]
        total = square.take(rows, axis=0)
        total += g * g
        _put(square, rows, total)
        g *= self.rate
        g /= np.sqrt(total, out=total)
        _put(w, rows, np.subtract(w.take(rows, axis=0), g, out=g))

    def take(self, around: np.ndarray, target: np.ndarray) -> None:
        at = 0
        while at < len(target):
            some = slice(at, at + self.batch)
            for k, rows, g in sparse_gradients(self.w, around[:, some], target[some]):
                self._update(k, rows, g)
            at += self.batch
            self.batch = min(BATCH, self.batch + self.batch // 4)


def masked(place: np.ndarray, seed: np.ndarray, turn: int, every: int) -> np.ndarray:
    """Targets of this round: words whose place, hashed with the seed of their text, deals them this turn, each one turn of a cycle."""
    x = place.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + seed
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.flatnonzero((x >> np.uint64(32)) * np.uint64(every) >> np.uint64(32) == turn % every)


def _count_words(batches):
    held = [np.empty(0, np.uint64)]
    size = 0

    def rows():
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    for batch in batches:
        for hashes in hashed_texts(batch.column("text")):
            held.append(hashes)
            size += len(hashes)
            if size > MAX_COUNTED:
                yield rows()
                held, size = [np.empty(0, np.uint64)], 0
    yield rows()


def vocabulary(docs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and a table (word, log_part) of all other words: the log of a word's part of its bucket."""
    counted = checkpoint(
        docs.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    )
    classes = classes_for(counted.agg(F.sum("n")).first()[0] or 0)
    buckets = 1 << ((classes**2 // 4).bit_length() - 1)
    top = counted.orderBy(F.desc("n"), "word").limit(classes**2 - buckets).toPandas()
    known = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    # the buckets are a power of two, so the low bits of a signed hash are those of the unsigned one
    low = F.col("word").bitwiseAND(F.lit(buckets - 1))
    last = (int(top["n"].iloc[-1]), int(top["word"].iloc[-1])) if len(top) else (0, 0)
    others = counted.where((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("word") > last[1]))).withColumn("bucket", low)
    totals = others.groupBy("bucket").agg(F.sum("n").alias("total"))
    parts = others.join(totals, "bucket").select("word", F.log(F.col("n") / F.col("total")).alias("log_part"))
    return Vocabulary(known[order], order.astype(np.int32), classes, buckets), checkpoint(parts)


def width(classes: int) -> int:
    """Bytes of an id in the written table."""
    return ((classes**2 - 1).bit_length() + 7) // 8


def _bytes(ids: np.ndarray, wide: int) -> bytes:
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide].tobytes()


def _together(texts):
    """Lists of hashed texts that follow one another, of about BLOCK words or of one longer text."""
    held, size = [], 0
    for hashes in texts:
        if held and size + len(hashes) > BLOCK:
            yield held
            held, size = [], 0
        held.append(hashes)
        size += len(hashes)
    if held:
        yield held


def _code(words: Vocabulary):
    wide = width(words.classes)

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, others = [], []
            for texts in _together(hashed_texts(batch.column("text"))):
                every = np.concatenate(texts)
                ends = np.cumsum([len(t) for t in texts[:-1]], dtype=np.intp)
                ids += np.split(to_ids(every, words), ends)
                others += [t[i >= words.top].view(np.int64) for t, i in zip(texts, ids[-len(texts) :])]
            rows, seeds = np.arange(row, row + len(ids)), [zlib.crc32(i.tobytes()) for i in ids]
            row += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column("doc_id"), pa.array(seeds, pa.int64()), pa.array([_bytes(i, wide) for i in ids], pa.binary()), pa.array(others, pa.list_(pa.int64()))],
                ["row", "doc_id", "seed", "ids", "others"],
            )

    return run


def coded(texts: DataFrame, words: Vocabulary) -> DataFrame:
    """A written table of the ids of each text's words, a hash of them, and the hashes of words outside the vocabulary."""
    return checkpoint(texts.mapInArrow(_code(words), "row long, doc_id long, seed long, ids binary, others array<long>"))


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the byte strings of a column, the first one's start before them, and the bytes."""
    column = column.cast(pa.large_binary())
    _, offsets, values = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return ends, np.frombuffer(values, np.uint8, int(ends[-1])) if values is not None else np.empty(0, np.uint8)


def _blocks(batch: pa.RecordBatch, classes: int):
    """(block, first row, row after the last) of runs of texts of at most BLOCK words, or of one longer text."""
    ends, values = _values(batch.column("ids"))
    wide = width(classes)
    ends = ends // wide
    # `values` starts with other rows' where the batch is a slice
    ids = np.zeros((len(values) // wide, 4), np.uint8)
    ids[:, :wide] = values.reshape(-1, wide)
    ids = ids.view("<u4").ravel()
    at = 0
    while at < len(batch):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, side="right")) - 1)
        yield block(ids[ends[at] : ends[upto]], np.diff(ends[at : upto + 1]), classes**2), at, upto
        at = upto


def _train(weights: dict, classes: int, turn: int, every: int, rate: float):
    def run(batches):
        trainer, ear = Trainer(weights, rate), Loss(weights)
        for batch in batches:
            seeds = batch.column("seed").to_numpy().astype(np.uint64)
            for texts, start, stop in _blocks(batch, classes):
                seed = seeds[start:stop]
                mixed = seed * np.uint64(0x9E3779B97F4A7C15)
                at = masked(texts.place, mixed[texts.doc], turn, every)
                heard = (seed % np.uint64(MEASURED_EVERY) == 0)[texts.doc[at]]
                for k in range(0, len(at), SLICE):
                    some = at[k : k + SLICE]
                    around, target = texts.windows(some), texts.padded[texts.at[some]]
                    trainer.add(around, target)
                    told = heard[k : k + SLICE]
                    ear.add(around[:, told], target[told])
        trainer.flush()
        ear.flush()
        if trainer.seen:
            flat = np.concatenate([v.ravel() for v in trainer.w.values()]) * np.float64(trainer.seen)
            # two more sums: the loss, and the targets it was measured on
            flat = np.concatenate([flat, [ear.loss, ear.seen]])
            part, seen = TaskContext.get().partitionId(), float(trainer.seen)
            pieces = [flat[i : i + PIECE] for i in range(0, len(flat), PIECE)]
            n = len(pieces)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()), pa.array([seen] * n), pa.array([_packed(p) for p in pieces], pa.binary())],
                ["piece", "part", "seen", "sums"],
            )

    return run


def _packed(sums: np.ndarray) -> bytes:
    return sums.astype("<f4").tobytes()


def _unpacked(sums: bytes) -> np.ndarray:
    return np.frombuffer(sums, "<f4").astype(np.float64)


def _add_up(rows: pa.Table) -> pa.Table:
    """The sum of one piece over some tasks."""
    sums = np.sum([_unpacked(s.as_py()) for s in rows["sums"]], axis=0)
    return pa.table(
        {
            "piece": rows["piece"].slice(0, 1),
            "part": pa.array([min(rows["part"].to_pylist())], pa.int32()),
            "seen": pa.array([float(sum(rows["seen"].to_pylist()))]),
            "sums": pa.array([_packed(sums)], pa.binary()),
        }
    )


SUM_SCHEMA = "piece int, part int, seen double, sums binary"


def train(texts: DataFrame, words: Vocabulary, rounds: int | None = None, mask_every: int = 4, rate: float = 0.05) -> dict[str, np.ndarray]:
    """Weights from coded texts after `rounds` rounds, or by default once every position was a target and the loss has settled.
    Runs a job per round; no round leaves its sums on the executors' disks."""
    with shuffles_removed(texts.sparkSession):
        return _train_rounds(texts, words, rounds, mask_every, rate)


def _train_rounds(texts: DataFrame, words: Vocabulary, rounds: int | None, mask_every: int, rate: float) -> dict[str, np.ndarray]:
    weights = start_weights(words.classes)
    losses: list[float] = []
    turn = 0
    while turn != rounds:
        sums = texts.select("seed", "ids").mapInArrow(_train(weights, words.classes, turn, mask_every, rate), SUM_SCHEMA)
        some = sums.groupBy("piece", F.floor(F.col("part") / FAN_IN)).applyInArrow(lambda key, t: _add_up(t), SUM_SCHEMA)
        rows = some.groupBy("piece").applyInArrow(_add_up, SUM_SCHEMA).collect()
        turn += 1
        if rows:
            rows.sort(key=lambda r: r.piece)
            flat = np.concatenate([_unpacked(r.sums) for r in rows])
            if flat[-1]:
                losses.append(flat[-2] / flat[-1])
            flat /= rows[0].seen
            at = 0
            for k, shape in shapes(words.classes).items():
                n = int(np.prod(shape))
                weights[k] = flat[at : at + n].reshape(shape).astype(np.float32)
                at += n
        elif not len(words.known):
            break
        # without a measured document all turns are taken once
        if rounds is None and turn >= mask_every and (len(losses) < 2 or losses[-2] - losses[-1] < SETTLED * losses[0]):
            break
    return weights


def _score(weights: dict, classes: int):
    def run(batches):
        for batch in batches:
            sums = np.zeros(len(batch))
            for texts, start, stop in _blocks(batch, classes):
                n = len(texts.at)
                logs = np.empty(n)
                for k in range(0, n, SLICE):
                    some = slice(k, k + SLICE)
                    logs[some] = log_probabilities(weights, texts.windows(some), texts.padded[texts.at[some]])
                sums[start:stop] = np.bincount(texts.doc, logs, stop - start)
            counts = np.diff(_values(batch.column("ids"))[0]) // width(classes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums)],
                ["row", "doc_id", "n_words", "score"],
            )

    return run


def score(docs: DataFrame, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, score, mean_score) per row: the summed log-probability and its mean per word.
    Runs the counting, coding and training jobs."""
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    words, parts = vocabulary(texts)
    written = coded(texts, words)
    weights = train(written, words, rounds)
    scored = written.select("row", "doc_id", "ids").mapInArrow(
        _score(weights, words.classes), "row long, doc_id long, n_words long, score double"
    )
    # a task's parts, each word once, go into a hash table, so that the far more numerous places of these words need no sort
    others = written.select("row", F.explode("others").alias("word"))
    shares = others.join(parts.hint("shuffle_hash"), "word").groupBy("row").agg(F.sum("log_part").alias("part"))
    scored = scored.join(shares, "row", "left").withColumn("score", F.col("score") + F.coalesce("part", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words"))
    return scored.select("doc_id", "n_words", "score", mean.alias("mean_score"))
