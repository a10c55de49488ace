"""Byte-level BPE by DuckDB queries inside Spark tasks.

Vocabularies are rank files (base64 token and rank a line); a token's id is its rank, and two
neighbours merge if their bytes together are a token, the lowest rank first, the leftmost of equals.

Encoding: each text is cut into words by the published pattern. A task gives the distinct words it has
not met to one recursive query: token-position rows start as bytes, join the merge table on (token,
next token), and each step contracts every word's leftmost pair of minimum rank, until no pair merges.
The recursion keeps all its steps' rows, so it runs at most `STEPS` of them at a time and goes on from
the last; long words cost more rounds, not more memory. Texts take the ids of their words.

Decoding: ids with their positions join the vocabulary, and an ordered aggregation puts each text's
bytes together. Decoding reads ids alone.

DuckDB has one thread and a memory limit per worker process. Words met are remembered within a bound.

Edge cases: null and empty texts have no ids and decode to no bytes; a null doc_id is kept; special
strings are ordinary text; an empty table returns none; repeated rows give repeated rows; other
columns are ignored. Ids the vocabulary lacks and null ids raise an error when decoded.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstat.llm.words import chunks, is_usual, splitter

# the published split pattern of the vocabularies, a fixed value
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

STEPS = 48
MAX_ROWS = 500_000  # token rows given to one recursion
MAX_WORDS = 1_000_000
CHUNK_CHARS = 2_000_000
MEMORY = "350MB"

# a word's best pair as one number: rank and position (ids below 2 ** 21, words below 4 TB)
POSITIONS = 1 << 42
MERGE_SQL = f"""
WITH RECURSIVE steps(word, pos, token, step) AS (
  SELECT word, pos, token, 0 FROM start
  UNION ALL
  SELECT s.word, s.pos, CASE WHEN s.pos = b.left_pos THEN b.merged ELSE s.token END, s.step + 1
  FROM steps s JOIN (
    SELECT word, min(best) // {POSITIONS} AS merged, min(best) % {POSITIONS} AS left_pos, arg_min(next_pos, best) AS right_pos
    FROM (
      SELECT p.word, m.merged::BIGINT * {POSITIONS} + p.pos AS best, p.next_pos
      FROM (
        SELECT word, pos, token, lead(token) OVER w AS next_token, lead(pos) OVER w AS next_pos
        FROM steps WHERE step < {STEPS} WINDOW w AS (PARTITION BY word ORDER BY pos)
      ) p JOIN merges m ON m.left_token = p.token AND m.right_token = p.next_token
    ) GROUP BY word
  ) b ON s.word = b.word
  WHERE s.pos <> b.right_pos
)
SELECT word, pos, token, step FROM steps
"""
DECODE_SQL = """
SELECT t.text, unhex(string_agg(v.bytes, '' ORDER BY t.pos)) AS bytes, count(*) AS n
FROM tokens t JOIN vocabulary v ON v.token = t.token GROUP BY t.text
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """One vocabulary in an in-process database, with the words met so far."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.bytes_ = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        merges = [
            (ranks[t[:i]], ranks[t[i:]], rank)
            for t, rank in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute(f"SET memory_limit = '{MEMORY}'")
        left, right, merged = (pa.array(c, pa.int32()) for c in zip(*merges)) if merges else [pa.array([], pa.int32())] * 3
        self._table("merges", pa.table({"left_token": left, "right_token": right, "merged": merged}))
        tokens = pa.table({"token": pa.array(ranks.values(), pa.int32()), "bytes": [t.hex() for t in ranks]})
        self._table("vocabulary", tokens)
        self.known: dict[str, bytes] = {}
        self.digits = [str(i) for i in range(max(ranks.values()) + 1)]
        self.pattern = regex.compile(PATTERN)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word: the recursion until no word merges any more."""
        done: dict[int, bytes] = {}
        sizes = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), sizes)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        token = self.bytes_[np.frombuffer(b"".join(words), np.uint8)]
        while len(word):
            self.db.register("start", pa.table({"word": word.astype(np.int32), "pos": pos.astype(np.int64), "token": token}))
            got = self.db.execute(MERGE_SQL).fetchnumpy()
            self.db.unregister("start")
            word, pos, token, step = (np.asarray(got[c]) for c in ("word", "pos", "token", "step"))
            last = np.zeros(len(words), step.dtype)
            np.maximum.at(last, word, step)
            rows = np.flatnonzero(step == last[word])
            rows = rows[np.lexsort((pos[rows], word[rows]))]
            word, pos, token = word[rows], pos[rows], token[rows].astype("<u4")
            at = np.flatnonzero(np.diff(word, prepend=-1))
            for a, b in zip(at, np.append(at[1:], len(word))):
                if last[word[a]] < STEPS:
                    done[int(word[a])] = token[a:b].tobytes()
            going = last[word] == STEPS
            word, pos, token = word[going], pos[going], token[going]
        return [done[i] for i in range(len(words))]

    def _learn(self, words: list[str]) -> None:
        held: list[str] = []
        rows = 0
        for w in sorted(words, key=len):
            held.append(w)
            rows += len(w.encode())
            if rows > MAX_ROWS:
                self.known.update(zip(held, self._merge([h.encode() for h in held])))
                held, rows = [], 0
        if held:
            self.known.update(zip(held, self._merge([h.encode() for h in held])))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = splitter()
        cut = [split.findall(t) if is_usual(t) else self.pattern.findall(t) for t in texts]
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        new = set().union(*cut).difference(self.known)  # looks the few new words up in the many known ones
        if new:
            self._learn(list(new))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4") for words in cut]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        sizes = np.array([len(i) for i in ids])
        text = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        pos = (np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        token = np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int64)
        self.db.register("tokens", pa.table({"text": text, "pos": pos, "token": token}))
        got = self.db.execute(DECODE_SQL).fetchall()
        self.db.unregister("tokens")
        out = [b""] * len(ids)
        for at, value, n in got:
            if n != sizes[at]:
                raise ValueError("an id is not in the vocabulary")
            out[at] = bytes(value)
        if len(got) != int((sizes > 0).sum()):
            raise ValueError("an id is not in the vocabulary")
        return out


@functools.cache
def codec(path: str) -> Codec:
    """One per worker process and vocabulary."""
    return Codec(path)


def _encode(path: str):
    def run(batches):
        encode = codec(path).encode
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            for part in chunks(texts, CHUNK_CHARS):
                ids = encode(part)
                some = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
                )

    return run


def _decode(path: str):
    def run(batches):
        decode = codec(path).decode
        for batch in batches:
            ids = [np.array([], np.int64) if i is None else np.asarray(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(decode(ids), pa.binary())], ["doc_id", "bytes"])

    return run


def _round_trip(path: str):
    """Digests of the ids, and of the bytes that the ids alone decode to."""

    def run(batches):
        both = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            for part in chunks(texts, CHUNK_CHARS):
                ids = both.encode(part)
                said = [hashlib.sha256(",".join(map(both.digits.__getitem__, i.tolist())).encode()).hexdigest() for i in ids]
                back = [hashlib.sha256(b).hexdigest() for b in both.decode(ids)]
                some = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array(said), pa.array(back)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) per row."""
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return texts.mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids)."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids"))
    return rows.mapInArrow(_decode(path), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row: `encode` then `decode` in one pass, so that
    neither ids nor bytes leave their task."""
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return texts.mapInArrow(
        _round_trip(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
