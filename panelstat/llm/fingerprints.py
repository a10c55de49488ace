"""Fingerprints of documents that don't depend on the order of their paragraphs, by a homomorphic multiset hash.

A text is the multiset of its paragraphs, the strings between line feeds; an empty text has one empty
paragraph. Each paragraph gives a wide vector, and a fingerprint is the sum of the vectors of all
paragraphs, lane by lane modulo a power of two:

* `EXACT` lanes modulo 2 ** 64, from a 512-bit digest of the paragraph. They tell multisets apart.
* `LANES` lanes modulo 2 ** 24. Each run of `WIDTH` words (shorter at the start of the paragraph) adds
  one or minus one to each, as the bits of its hash say. The lanes of two texts have about the inner
  product of the counts of their runs, which gives their likeness.

Sums commute, so texts with the same paragraphs in any order have equal fingerprints, and `update`
inserts and deletes paragraphs without the rest of the text. Equal texts have equal fingerprints.

`likeness` estimates common / (all runs of both, common ones once) with counts squared: 1 for equal
fingerprints, near 0 for texts without a common run; the standard error is about 0.06 or less.

Edited texts: documents stand in ascending order of (id, text), null ids first; after the last comes
the first. Each one's last half of code points is replaced by the first as many of the next document.
Its fingerprint is an update: the paragraphs that went are deleted, those that came are inserted.
Documents are dealt to tasks by ranges of ids whose borders are ids of the table, and a document on a
border is dealt to both sides, so a task streams its range and holds two documents at a time.

Edge cases: null and empty texts are empty documents; texts of any length are whole, in chunks of
`CHUNK` words; a repeated row is a document of its own, next to its copy; a null id gives a null
doc_id; rows of one id lie in one range; the only document is its own next; an empty table returns
none; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstat.llm.word_hashes import mix

EXACT = 8
LANES = 256
WIDTH = 3
CHUNK = 65_536
MAX_WORDS = 200_000
SALTS = np.arange(1, LANES // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xC2B2AE3D27D4EB4F)

SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _WordHashes()


def _pieces(paragraphs: Iterable[str]) -> Iterator[tuple[list[str], bool]]:
    """The words of each paragraph, in parts of `CHUNK` at most that each begin with the words that the
    runs before them need; and whether this is the first part."""
    for paragraph in paragraphs:
        words = paragraph.split()
        yield words[:CHUNK], True
        for at in range(CHUNK, len(words), CHUNK):
            yield words[at - WIDTH + 1 : at + CHUNK], False


def _runs(pieces: list[tuple[list[str], bool]]) -> np.ndarray:
    """Hashes of the runs that end at each word; a run doesn't reach beyond its paragraph."""
    words = [w for piece, _ in pieces for w in piece]
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    sizes = [len(piece) for piece, _ in pieces]
    of = np.repeat(np.arange(len(pieces)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    total = h.copy()
    for back in range(1, WIDTH):
        total *= STEP
        total[back:] += np.where(of[back:] == of[:-back], h[:-back], np.uint64(0))
    repeated = ~np.array([first for _, first in pieces], bool)[of] & (place < WIDTH - 1)
    return mix(total[~repeated])


def _signs(runs: np.ndarray) -> np.ndarray:
    """Sum over the runs of their vectors of ones and minus ones."""
    bits = mix(runs[:, None] ^ SALTS[None, :]).astype("<u8").view(np.uint8)
    ones = np.unpackbits(bits.reshape(len(runs), LANES // 8), axis=1).sum(axis=0, dtype=np.int64)
    return 2 * ones - len(runs)


class Fingerprint:
    """The lanes of a multiset of paragraphs; fingerprints add and subtract."""

    def __init__(self, exact: np.ndarray, lanes: np.ndarray):
        self.exact = exact
        self.lanes = (lanes + (1 << 23)) % (1 << 24) - (1 << 23)

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + other.exact, self.lanes + other.lanes)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact - other.exact, self.lanes - other.lanes)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and str(self) == str(other)

    def __str__(self) -> str:
        """Base 64 of the lanes: exact ones in 8 bytes each, the others in 3, little-endian."""
        small = (self.lanes % (1 << 24)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        return base64.b64encode(self.exact.astype("<u8").tobytes() + small.tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = np.frombuffer(base64.b64decode(text), np.uint8)
        wide = np.zeros((LANES, 4), np.uint8)
        wide[:, :3] = raw[8 * EXACT :].reshape(-1, 3)
        return cls(raw[: 8 * EXACT].view("<u8").astype(np.uint64), wide.view("<u4").reshape(-1).astype(np.int64))


def multiset(paragraphs: Iterable[str]) -> Fingerprint:
    """The fingerprint of some paragraphs, in any order."""
    paragraphs = list(paragraphs)
    digests = b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass")).digest() for p in paragraphs)
    exact = np.frombuffer(digests, "<u8").reshape(-1, EXACT).sum(axis=0, dtype=np.uint64)
    lanes, held, n = np.zeros(LANES, np.int64), [], 0
    for piece in _pieces(paragraphs):
        held.append(piece)
        n += len(piece[0])
        if n >= CHUNK:
            lanes += _signs(_runs(held))
            held, n = [], 0
    if n:
        lanes += _signs(_runs(held))
    return Fingerprint(exact, lanes)


def fingerprint(text: str | None) -> Fingerprint:
    return multiset((text or "").split("\n"))


def update(of: Fingerprint, deleted: Iterable[str], inserted: Iterable[str]) -> Fingerprint:
    """The fingerprint after some paragraphs went and others came."""
    return of - multiset(deleted) + multiset(inserted)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """From 0 to 1, by the lanes alone."""
    if a == b:
        return 1.0
    x, y = a.lanes.astype(np.float64), b.lanes.astype(np.float64)
    both = x @ y
    apart = x @ x + y @ y - both
    return float(min(1.0, max(0.0, both / apart))) if apart > 0 else 0.0


def edited(text: str, following: str) -> str:
    """The text with the last half of its code points replaced by the first as many of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _edited_fingerprint(text: str, new: str, of: Fingerprint) -> Fingerprint:
    """That of the edited text, by the paragraphs that differ."""
    before, after = Counter(text.split("\n")), Counter(new.split("\n"))
    return update(of, (before - after).elements(), (after - before).elements())


def _stream(batches):
    """Rows sorted by (bucket, peek, doc_id, text): each one's successor is the next row of the bucket."""
    bucket, held, peeked = None, None, False
    for batch in batches:
        out = []
        ids, buckets, peeks = (batch.column(c).to_pylist() for c in ("doc_id", "bucket", "peek"))
        for doc_id, at, peek, text in zip(ids, buckets, peeks, batch.column("text")):
            if at != bucket:
                bucket, held, peeked = at, None, False
            if peeked:
                continue  # only the first row beyond the bucket is its last one's successor
            text = text.as_py() or ""
            own = fingerprint(text)
            if held is not None:
                last_id, last, last_own = held
                new = edited(last, text)
                new_own = _edited_fingerprint(last, new, last_own)
                digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                near = (likeness(last_own, new_own), likeness(last_own, own))
                out.append((last_id, len(last), digest, str(last_own), str(new_own), *near))
            held, peeked = (doc_id, text, own), peek
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate(_TYPES)], names=_NAMES
        )


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _bucket(doc_id: Column, borders: list[int], width: int = 32) -> Column:
    """How many of the sorted borders are not above the id: first among every `width`th, then between."""
    every = F.lit(borders)
    firsts = F.lit(borders[::width])
    coarse = F.size(F.filter(firsts, lambda x: x <= doc_id))
    fine = F.size(F.filter(F.slice(every, (coarse - 1) * width + 1, width), lambda x: x <= doc_id))
    return F.when(doc_id.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * width + fine)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    Runs a job over the ids for the borders of the ranges, as many as there are shuffle partitions.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / ranges for k in range(1, ranges)] or [0.5]
    first, empty_ids, least = rows.agg(
        F.percentile_approx("doc_id", shares, max(10_000, 20 * ranges)),
        F.count_if(F.col("doc_id").isNull()),
        F.min("doc_id"),
    ).first()
    if empty_ids == 0 and least is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    # a border is the first id of its range; the least id lies in the first range
    borders = sorted({b for b in first or [] if b > least})
    own = _bucket(F.col("doc_id"), borders) if borders else F.lit(0)
    of_first = F.col("doc_id").isNull() if empty_ids else F.col("doc_id") == least
    on_border = F.col("doc_id").isin(borders) if borders else F.lit(False)
    place = F.struct(own.alias("bucket"), F.lit(False).alias("peek"))
    before = F.struct((own - 1).alias("bucket"), F.lit(True).alias("peek"))
    around = F.struct(F.lit(len(borders)).alias("bucket"), F.lit(True).alias("peek"))
    places = F.concat(
        F.array(place),
        F.when(on_border, F.array(before)).otherwise(F.array().cast("array<struct<bucket:int,peek:boolean>>")),
        F.when(of_first, F.array(around)).otherwise(F.array().cast("array<struct<bucket:int,peek:boolean>>")),
    )
    dealt = rows.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.bucket", "p.peek")
    order = ["bucket", "peek", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")]
    return dealt.repartitionById(len(borders) + 1, "bucket").sortWithinPartitions(*order).mapInArrow(_stream, SCHEMA)
