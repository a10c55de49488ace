"""Structure repair of conversations by iterative-deepening A*.

A conversation's rows stand in the order of (turn, role, text), nulls first. Faults, the first that
holds counts: blank (no character other than space and control white space), duplicate (role and text
seen earlier in the conversation), truncated (the last such character is not one of .!?).

A repair edits the rows so that the role initials read `(s?(ua)+)?`: Keep costs 0, Rerole to user or
assistant 3, Delete 4 (the only way with blank and duplicate rows), Insert of an empty user or
assistant row 3; a truncated row that stays costs 3 more. The result is the cheapest repair, of equally
cheap ones that whose edits' initials come first in ASCII order.

`search` finds it depth first in that order (D, I, K, R) under a bound on cost plus an admissible
estimate of the rest. A (row, state) that fails is remembered with the largest remaining cost it failed
at. Without success the bound rises by one; the first accepting path is the answer, because no bound
below has one and paths are tried in order. In every state only one role can come next, so the initials
name a repair in full. The estimate of the rest: what each row costs at least, and for disjoint pairs
of neighbours with roles that can't follow each other what an edit at the cheapest place adds.

Rows are sorted by ranges of (conv_id, turn), so that a conversation of any length is dealt to several
tasks, which cut it into pieces of `PIECE` rows at most. What was said before is found by a count over
digests. One pass streams light forms of the pieces from the end of each conversation and keeps, per
state, the cost of all that follows a piece; the next streams pieces from the start, searches each with
that cost at its end and hashes the repaired rows. Both hold one piece at a time; the digest of a
conversation's rows in order, and the length of its audit, bind the last pass to one task for each.

Edge cases: null roles and texts count as one space, null turns come first and don't count in gaps; a
null conv_id is a conversation; roles other than system, user and assistant go by their first
character; repeated rows are duplicates; a conversation of no rows costs nothing and has the hash of
the empty string; empty tables return none; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstat.session import checkpoint

PIECE = 128
PIECE_CHARS = 4_000_000

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}  # by the initial of the row before, "" at the start: the role that can be put next
ROLES = {"u": "user", "a": "assistant"}
FOLLOWS = ("su", "ua", "au")
STATES = ("", "s", "u", "a")
END = {"": 0, "s": 6, "u": 3, "a": 0}  # cost of the rows to insert after the last one
CLOSING = {"": "", "s": "II", "u": "I", "a": ""}

BLANK, DUPLICATE, TRUNCATED, SOUND = "b", "d", "t", "-"
WORD = r"[^\x20\x09-\x0D]"


def estimates(initials: str, faults: str) -> list[int]:
    """Least cost of the rows from each one on: an edit apart for each of the best disjoint bad pairs."""
    n = len(initials)
    rest = [0] * (n + 1)
    following = None  # the next row that is not bound to go
    after = [0] * (n + 1)  # best disjoint pairs among the rows from here on
    for i in range(n - 1, -1, -1):
        after[i] = after[i + 1]
        if faults[i] in (BLANK, DUPLICATE):
            rest[i] = rest[i + 1] + 4
            continue
        if following is not None and initials[i] + initials[following] not in FOLLOWS:
            # deleting a truncated row costs one more than keeping it
            apart = 1 if TRUNCATED in (faults[i], faults[following]) else 3
            after[i] = max(after[i], apart + after[following + 1])
        rest[i] = rest[i + 1] + (3 if faults[i] == TRUNCATED else 0)
        following = i
    return [r + a for r, a in zip(rest, after)]


def search(initials: str, faults: str, start: str = "", tail: dict[str, int] = END) -> tuple[int, str, str]:
    """(cost with that of the tail, edits' initials, state after the last row) of the cheapest repair of
    some rows that begins after a row with initial `start`; `tail` is the cost of all that follows."""
    n, low = len(initials), min(tail.values())
    least = [x + low for x in estimates(initials, faults)]
    failed: dict[tuple[int, str], int] = {}

    def steps(i: int, state: str):
        """Edits in ASCII order: initial, cost, next row, next state."""
        yield "D", 4, i + 1, state
        put = NEXT[state]
        yield "I", 3, i, put
        if faults[i] not in (BLANK, DUPLICATE):
            more = 3 if faults[i] == TRUNCATED else 0
            own = initials[i]
            if own == put or own == "s" and state == "":
                yield "K", more, i + 1, own
            yield "R", 3 + more, i + 1, put

    bound = least[0]
    while True:
        path: list[str] = []
        stack = [(0, start, 0, steps(0, start))]
        while stack:
            i, state, spent, choices = stack[-1]
            for edit, cost, j, new in choices:
                left = bound - spent - cost
                if j == n:
                    if tail[new] <= left:
                        return spent + cost + tail[new], "".join(path) + edit, new
                elif least[j] <= left and failed.get((j, new), -1) < left:
                    path.append(edit)
                    stack.append((j, new, spent + cost, steps(j, new)))
                    break
            else:
                stack.pop()
                if path:
                    path.pop()
                failed[i, state] = max(bound - spent, failed.get((i, state), -1))
        bound += 1


def repaired_rows(roles: list[str], texts: list[str], edits: str, state: str = "") -> list[str]:
    """The repaired rows as `role:text`, inserted ones with empty text."""
    out, i = [], 0
    for edit in edits:
        if edit in "IR":
            state = NEXT[state]
            out.append(f"{ROLES[state]}:{texts[i] if edit == 'R' else ''}")
        elif edit == "K":
            state = roles[i][:1]
            out.append(f"{roles[i]}:{texts[i]}")
        i += edit != "I"
    return out


# rows to pieces


_PIECE_FIELDS = (
    "part int, seq int, initials string, faults string, roles array<string>, texts array<string>, "
    "said array<binary>, first_turn long, last_turn long, turns long"
)
_PIECE_ARROW = [
    pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.binary()),
    pa.int64(), pa.int64(), pa.int64(),
]
_PIECE_NAMES = [f.split(" ")[0] for f in _PIECE_FIELDS.split(", ")]


def _pieces(batches):
    """Rows sorted by (conv_id, turn, role, text) to pieces of conversations, numbered in order."""
    part, seq = TaskContext.get().partitionId(), 0
    conv, rows, chars, kind = None, [], 0, None
    done: list[tuple] = []

    def close():
        nonlocal rows, chars, seq
        if rows:
            turns = [r[0] for r in rows if r[0] is not None]
            ends = (turns[0], turns[-1]) if turns else (None, None)
            initials = "".join(r[1][:1] or "?" for r in rows)
            lists = [[r[k] for r in rows] for k in (1, 2, 4)]
            done.append((conv, part, seq, initials, "".join(r[3] for r in rows), *lists, *ends, len(set(turns))))
            seq += 1
        rows, chars = [], 0

    def batch_of():
        columns = [pa.array([r[k] for r in done], t) for k, t in enumerate([kind, *_PIECE_ARROW])]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *_PIECE_NAMES])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "fault", "said")]
        for conv_id, turn, role, fault, said, text in zip(*columns, batch.column("text")):
            text = text.as_py()
            if conv_id != conv or len(rows) == PIECE or chars > PIECE_CHARS:
                close()
                conv = conv_id
            rows.append((turn, role, text, fault, said))
            chars += len(text)
        if done:
            yield batch_of()
    close()
    if done:
        yield batch_of()


def _repeats(pieces: DataFrame) -> DataFrame:
    """Per piece with any, the places of rows whose role and text its conversation has in an earlier row."""
    rows = pieces.select("conv_id", "part", "seq", F.posexplode("said").alias("at", "said"))
    place = F.struct("part", "seq", "at")
    first = rows.groupBy("conv_id", "said").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first")
    found = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s"))).where(place > F.col("first"))
    return found.groupBy("conv_id", "part", "seq").agg(F.collect_list("at").alias("again"))


def _marked(faults: str, again: list[int] | None) -> str:
    """Faults with rows that repeat earlier ones, where these are not blank."""
    if not again:
        return faults
    repeats = set(again)
    return "".join(DUPLICATE if k in repeats and f != BLANK else f for k, f in enumerate(faults))


def _tails(batches):
    """Pieces sorted from the end of each conversation, what is known about each before it: for all but
    the last, cost by state of what follows."""
    conv, later, again = None, None, None
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "part", "seq", "note", "again", "initials", "faults")]
        for conv_id, part, seq, note, repeats, initials, faults in zip(*columns):
            if note:
                again = repeats
                continue
            if later is None or conv_id != conv:
                conv, tail = conv_id, END
            else:
                tail = {state: search(*later[:2], state, later[2])[0] for state in STATES}
                out.append((conv_id, part, seq, [tail[s] for s in STATES]))
            later, again = (initials, _marked(faults, again), tail), None
        kinds = [batch.schema.field("conv_id").type, pa.int32(), pa.int32(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["conv_id", "part", "seq", "tail"])


_RESULT_FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT_NAMES = [f.split(" ")[0] for f in _RESULT_FIELDS.split(", ")]
_RESULT_ARROW = [pa.int64()] * 6 + [pa.string()] * 2


class _Repair:
    """A conversation, piece by piece."""

    def __init__(self):
        self.state, self.last, self.digest, self.rows = "", "", hashlib.sha256(), 0
        self.faults = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
        self.illegal = self.cost = self.turns = 0
        self.first_turn = self.last_turn = None
        self.audit: list[str] = []

    def _write(self, lines: list[str]) -> None:
        for line in lines:
            self.digest.update(("\n" * bool(self.rows) + line).encode("utf-8", "surrogatepass"))
            self.rows += 1

    def add(self, initials, faults, roles, texts, first_turn, last_turn, turns, tail) -> None:
        tail = END if tail is None else dict(zip(STATES, tail))
        cost, edits, state = search(initials, faults, self.state, tail)
        self.cost += cost - tail[state]
        self.audit.append(edits)
        self._write(repaired_rows(roles, texts, edits, self.state))
        self.state = state
        for fault in self.faults:
            self.faults[fault] += faults.count(fault)
        joined = self.last + initials
        self.illegal += sum(joined[k : k + 2] not in FOLLOWS for k in range(len(joined) - 1))
        self.last = initials[-1]
        if turns:
            self.turns += turns - (self.last_turn == first_turn)
            self.first_turn = first_turn if self.first_turn is None else self.first_turn
            self.last_turn = last_turn

    def result(self) -> tuple:
        closing = CLOSING[self.state]
        self._write(repaired_rows([], [""], closing, self.state))
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        counts = [self.faults[f] for f in (BLANK, DUPLICATE, TRUNCATED)]
        return (gaps, *counts, self.illegal, self.cost + END[self.state], "".join(self.audit) + closing, self.digest.hexdigest())


def _repairs(batches):
    """Pieces sorted from the start of each conversation, what is known about each before it, to repairs."""
    conv, repair, kind, known = None, None, None, {}
    fields = ("initials", "faults", "roles", "texts", "first_turn", "last_turn", "turns")

    def batch_of(rows):
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate([kind, *_RESULT_ARROW])]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *_RESULT_NAMES])

    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        notes, ids = batch.column("note").to_pylist(), batch.column("conv_id").to_pylist()
        for k, (conv_id, note) in enumerate(zip(ids, notes)):
            if note:
                known |= {c: v for c in ("again", "tail") if (v := batch.column(c)[k].as_py()) is not None}
                continue
            if repair is None or conv_id != conv:
                if repair is not None:
                    out.append((conv, *repair.result()))
                conv, repair = conv_id, _Repair()
            initials, faults, *rest = (batch.column(c)[k].as_py() for c in fields)
            repair.add(initials, _marked(faults, known.get("again")), *rest, known.get("tail"))
            known = {}
        yield batch_of(out)
    if repair is not None:
        yield batch_of([(conv, *repair.result())])


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return conversations.select(
        conversations[conv_col].alias("conv_id"),
        conversations[turn_col].cast("long").alias("turn"),
        F.coalesce(conversations[role_col].cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(conversations[text_col].cast("string"), F.lit(" ")).alias("text"),
    )


def repair(
    conversations: DataFrame,
    originals: DataFrame | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    `originals` may name conversations, in its column of the same name, that have no rows left. Runs jobs.
    """
    rows = _turns(conversations, conv_col, turn_col, role_col, text_col)
    kind = rows.schema["conv_id"].dataType.simpleString()
    last = F.regexp_extract("text", rf"({WORD})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    said = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    ordered = rows.withColumns({"fault": fault, "said": said}).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    pieces = checkpoint(ordered.mapInArrow(_pieces, f"conv_id {kind}, {_PIECE_FIELDS}")).withColumn("note", F.lit(False))
    repeats = checkpoint(_repeats(pieces)).withColumn("note", F.lit(True))

    def dealt(frames: list[DataFrame], *way) -> DataFrame:
        """All that belongs to a conversation in one stream, notes on a piece before it."""
        both = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        return both.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *way, F.desc("note"))

    light = pieces.select("conv_id", "part", "seq", "initials", "faults", "note")
    back = dealt([light, repeats], F.desc("part"), F.desc("seq"))
    tails = back.mapInArrow(_tails, f"conv_id {kind}, part int, seq int, tail array<long>")
    tails = checkpoint(tails).withColumn("note", F.lit(True))
    found = dealt([pieces.drop("said"), repeats, tails], "part", "seq").mapInArrow(_repairs, f"conv_id {kind}, {_RESULT_FIELDS}")
    if originals is None:
        return found
    names = originals.select(originals[conv_col].alias("c")).distinct()
    every = names.join(found, names["c"].eqNullSafe(found["conv_id"]), "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in _RESULT_NAMES[:6]}
    nothing = hashlib.sha256().hexdigest()
    return every.select(
        F.col("c").alias("conv_id"),
        *(v.alias(c) for c, v in zero.items()),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


def damage(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, turn, role, text) with faults by the checksum of `conv_id:turn` modulo 20: 0 drops a row,
    1 empties its text, 2 takes out its .!?, 3 repeats it, 4 makes it the user's. Nulls: one space."""
    rows = _turns(conversations, conv_col, turn_col, role_col, text_col)

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        rows.where(kind != 0)
        .withColumns({"text": text, "role": F.when(kind == 4, "user").otherwise(F.col("role")), "time": F.explode(times)})
        .drop("time")
    )
