"""Hard negatives, conversation repair and order-free fingerprints against brute force."""

import hashlib
import heapq
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelstat.llm import conversation_repair as repairing
from panelstat.llm import fingerprints as prints
from panelstat.llm import hard_negatives as mining

# op11

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(given, anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    good = {}
    for i, v, label in given:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v32 = tuple(float(np.float32(x)) for x in v)
            good[i] = min(good.get(i, (label, v32)), (label, v32))
    rows = {i: (label, [math.floor(scale * x) for x in v]) for i, (label, v) in good.items()}
    out = []
    for a, (label, v) in rows.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in rows.items() if i != a and len(w) == len(v))
        for s, p, other in [x for x in scored if x[2] == label][:positives]:
            found = [(-t, i) for t, i, o in scored if o != label and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, k, i, -s, t) for k, (t, i) in enumerate(found[:negatives], 1)]
    return sorted(out)


def mined(spark, given, **how):
    frame = spark.createDataFrame(given, VECTORS).repartition(3)
    return sorted(map(tuple, mining.hard_negatives(frame, frame["vec_id"] % 10 == 0, **how).collect()))


def test_keys_sort_as_the_scores_do():
    rows = [(a, s, n, i) for a in (-5, 0, 7) for s in (-(2**63), -1, 0, 9, 2**63 - 1) for n in (False, True) for i in (-3, 0, 8)]
    packed = [mining.pack_key(*r) for r in rows]
    assert [mining.unpack_key(k) for k in packed] == rows
    assert [r for _, r in sorted(zip(packed, rows))] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))
    a, s, i = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 3))
    for negative in (False, True):
        assert mining._key_bytes(a, s, negative, i).to_pylist() == [mining.pack_key(x, y, negative, z) for x, y, _, z in rows]


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    given = [(i, list(map(float, v)), int(label)) for i, (v, label) in enumerate(zip(rng.standard_normal((300, 8)) * 0.3, rng.integers(0, 4, 300)))]
    given += [(1000 + i, given[10][1], i % 2) for i in range(60)]  # ties
    expected = brute_negatives(given, lambda i: i % 10 == 0)
    assert expected and mined(spark, given) == expected
    monkeypatch.setattr(mining, "BLOCK_BYTES", 4_000)  # many blocks and groups; workers read their own constants
    assert mined(spark, given) == expected
    assert mined(spark, given, positives=2, negatives=3, low=10, high=100) == brute_negatives(given, lambda i: i % 10 == 0, 2, 3, 10, 100)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    given = [
        (0, [0.5, 0.5], 1), (1, [0.5, 0.25], 1), (2, [0.25, 0.2], 2), (3, [0.25, None], 2), (4, [nan, 0.1], 2), (5, [inf, 0.1], 2),
        (6, None, 2), (7, [0.3, 0.1], None), (None, [0.3, 0.1], 2), (8, [0.3], 2), (9, [], 2), (10, [], 2), (20, [], 2), (11, [0.3, 0.1], 2),
        (11, [0.3, 0.1], 2), (12, [0.2, 0.1], 3), (12, [0.2, 0.1], 2), (30, [-0.5, -0.5], 1), (40, [0.0, 0.0], 7), (41, [0.0, 0.0], 7),
        (50, [1e19, 1e19], 8), (51, [1e19, 1e18], 8), (52, [1.0, 1.0], 9), (60, [5e6, 5e6], 10), (61, [5e6, 5e6], 10), (62, [1e6, 4e6], 11),
    ]
    found, expected = mined(spark, given), brute_negatives(given, lambda i: i % 10 == 0)
    top = 2**63 - 1
    # scores beyond 64 bits stay at the limit
    assert [r for r in found if r[4] < top] == [r for r in expected if r[4] <= top and r[5] <= top]
    assert any(r[0] == 60 and r[4] > 2**53 for r in found) and any(r[0] == 40 for r in found)
    empty = spark.createDataFrame([], VECTORS)
    assert mining.hard_negatives(empty, empty["vec_id"] % 10 == 0).collect() == []
    clash = spark.createDataFrame(given[:3], VECTORS).selectExpr("*", "1 AS id", "2 AS place", "3 AS block", "4 AS vector", "5 AS anchor")
    assert len(mining.hard_negatives(clash, clash["vec_id"] == 0).collect()) == len(brute_negatives(given[:3], lambda i: i == 0))


# op12

ROWS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: text.replace(".", "").replace("!", "").replace("?", "")}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(initials, faults):
    """Uniform-cost search over (cost, edits), which yields the first of the cheapest in ASCII order."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(initials) and state in ("", "a"):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        put = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        heapq.heappush(heap, (cost + 3, audit + "I", i, put))
        if i < len(initials):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if faults[i] in "t-":
                more = 3 * (faults[i] == "t")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, put))
                if initials[i] == put or (initials[i] == "s" and state == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, initials[i]))
    raise AssertionError


def brute_repair(rows, originals):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv in set(originals) | set(convs):
        own = sorted(convs[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), ""
        for _, role, text in own:
            core = text.strip(SPACE)
            faults += "b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "-"
            seen.add((role, text))
        initials = "".join(r[1][:1] or "?" for r in own)
        turns = {r[0] for r in own} - {None}
        cost, audit = cheapest(initials, faults)
        lines, i, state = [], 0, ""
        for e in audit:
            if e in "IR":
                state = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
                lines.append({"u": "user", "a": "assistant"}[state] + ":" + (own[i][2] if e == "R" else ""))
            elif e == "K":
                state = initials[i]
                lines.append(f"{own[i][1]}:{own[i][2]}")
            i += e != "I"
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest))
    return Counter(out)


def random_rows(rng, convs, most):
    texts = ["Yes.", "No!", "and then", "", " \n", "Why?", "Fine. ", "more \t", None, "x" * 3000, "Ünï!", " "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = []
    for conv in range(convs):
        turns = [rng.choice([None, t, t, t, t + 1]) for t in range(rng.randint(1, most))]
        rows += [(conv if conv else None, t, rng.choice(roles), rng.choice(texts)) for t in turns]
    return rows


def test_search_matches_uniform_cost_search():
    rng = random.Random(5)
    for _ in range(1500):
        n = rng.randint(1, 9)
        initials, faults = "".join(rng.choices("suaut", k=n)), "".join(rng.choices("--tbd", k=n))
        cost, audit, state = repairing.search(initials, faults)
        assert (cost, audit + repairing.CLOSING[state]) == cheapest(initials, faults)


def test_search_finds_the_least_by_enumeration():
    """Every edit string up to a length is tried outright."""
    rng, costs = random.Random(6), {"D": 4, "I": 3, "K": 0, "R": 3}

    def run(audit, initials, faults):
        i, state, cost = 0, "", 0
        for e in audit:
            if e != "I" and i == len(initials):
                return None
            cost += costs[e]
            if e in "KR":
                if faults[i] in "bd":
                    return None
                cost += 3 * (faults[i] == "t")
            if e in "IR" or e == "K" and not (initials[i] == "s" and state == ""):
                put = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
                if e == "K" and initials[i] != put:
                    return None
                state = put
            elif e == "K":
                state = "s"
            i += e != "I"
        return (cost, audit) if i == len(initials) and state in ("", "a") else None

    for _ in range(12):
        n = rng.randint(1, 3)
        initials, faults = "".join(rng.choices("suat", k=n)), "".join(rng.choices("-tb", k=n))
        every = [run("".join(x), initials, faults) for k in range(0, n + 4) for x in itertools.product("DIKR", repeat=k)]
        cost, audit, state = repairing.search(initials, faults)
        assert (cost, audit + repairing.CLOSING[state]) == min(x for x in every if x)


def test_repair_matches_brute_force(spark):
    rows = random_rows(random.Random(7), 120, 9)
    rows += [(500, k, "user", f"Row {k}{'.' * (k % 3)}") for k in range(700)]  # several pieces
    rows += [(501, None, "assistant", "Same.")] * 300 + [(502, k, "au"[k % 2], "More.") for k in range(400)]
    rows += [(502, 900, "user", "More.")] * 2
    frame = spark.createDataFrame(rows, ROWS).repartition(5).selectExpr("*", "1 AS part", "2 AS seq", "'x' AS fault", "3 AS note")
    originals = spark.createDataFrame([(c,) for c in [None, 7, 900, 901, 901]], "conv_id long")
    found = Counter(map(tuple, repairing.repair(frame, originals).where("conv_id in (900, 901, 7) or conv_id is null").collect()))
    expected = brute_repair(rows, [None, 900, 901])
    assert found == Counter({r: 1 for r in expected if r[0] in (None, 7, 900, 901)})
    assert Counter(map(tuple, repairing.repair(frame).collect())) == brute_repair(rows, [])
    assert {r["audit"] for r in repairing.repair(frame, originals).where("conv_id >= 900").collect()} == {""}
    assert repairing.repair(spark.createDataFrame([], ROWS)).collect() == []


def test_damage_and_the_query(spark, sf):
    from panelstat.llm import queries

    rows = random_rows(random.Random(8), 60, 9)
    found = Counter(map(tuple, repairing.damage(spark.createDataFrame(rows, ROWS)).collect()))
    assert found == Counter(damaged(rows)) and len(damaged(rows)) != len(rows)
    rows = [tuple(r) for r in queries.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    expected = brute_repair(damaged(rows), [r[0] for r in rows])
    assert Counter(map(tuple, queries.op12_conversation_repair(spark, sf).collect())) == expected


# op13


def runs(text):
    found = Counter()
    for paragraph in (text or "").split("\n"):
        words = paragraph.split()
        found.update(tuple(words[max(0, k - prints.WIDTH + 1) : k + 1]) for k in range(len(words)))
    return found


def true_likeness(a, b):
    x, y = runs(a), runs(b)
    both = sum(x[k] * y[k] for k in x)
    apart = sum(v * v for v in x.values()) + sum(v * v for v in y.values()) - both
    return both / apart if apart else 0.0


def test_fingerprints_ignore_order_and_take_updates(monkeypatch):
    rng = random.Random(9)
    paragraphs = [" ".join(rng.choices("abcdefghij", k=rng.randint(0, 30))) for _ in range(60)]
    own = prints.fingerprint("\n".join(paragraphs))
    mixed = rng.sample(paragraphs, len(paragraphs))
    assert prints.fingerprint("\n".join(mixed)) == own == prints.Fingerprint.parse(str(own))
    assert prints.fingerprint("\n".join(paragraphs[1:])) != own
    assert prints.update(own, paragraphs[5:20], ["new one"]) == prints.multiset(paragraphs[:5] + paragraphs[20:] + ["new one"])
    assert prints.multiset(paragraphs[:30]) + prints.multiset(paragraphs[30:]) == own
    assert prints.fingerprint(None) == prints.fingerprint("") != prints.fingerprint("\n")
    # chunks don't show
    monkeypatch.setattr(prints, "CHUNK", 7)
    assert prints.fingerprint("\n".join(paragraphs)) == own


def signs_of(run):
    """The vector of one run, by single steps on Python integers."""

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    total = 0
    for back in range(prints.WIDTH):  # a power for each place that the run may have
        word = prints._hashes[run[-1 - back]] if back < len(run) else 0
        total = word if back == 0 else (total * int(prints.STEP) + word) % 2**64
    words = [mix(mix(total) ^ int(salt)) for salt in prints.SALTS]
    return [1 if word >> (8 * byte + 7 - bit) & 1 else -1 for word in words for byte in range(8) for bit in range(8)]


def test_lanes_are_sums_of_signs_of_runs():
    text = "one two three four\n\ntwo one\nfive"
    total = sum(np.array(signs_of(run)) for run in runs(text).elements())
    assert (prints.fingerprint(text).lanes == total).all()


def test_likeness_is_near_the_true_one():
    rng = random.Random(10)
    vocabulary = [f"w{k}" for k in range(3000)]
    for share in (0, 0.3, 0.6, 0.9):
        a = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(60)]
        b = a[: int(60 * share)] + [" ".join(rng.choices(vocabulary, k=12)) for _ in range(60 - int(60 * share))]
        a, b = "\n".join(a), "\n".join(b)
        assert abs(prints.likeness(prints.fingerprint(a), prints.fingerprint(b)) - true_likeness(a, b)) < 0.2
    assert prints.likeness(prints.fingerprint("a b"), prints.fingerprint("a b")) == 1.0
    assert prints.likeness(prints.fingerprint(""), prints.fingerprint("\n")) == 0.0


def brute_prints(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    out = []
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        new = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        own, other, after = (prints.fingerprint(x) for x in (text, new, following))
        digest = hashlib.sha256(new.encode()).hexdigest()
        out.append((i, len(text), digest, str(own), str(other), prints.likeness(own, other), prints.likeness(own, after)))
    return Counter(out)


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_fingerprints_match_brute_force(spark, docs, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        rows += [(20 + k, "\n".join(f"line {k} {j % 5} with some words" for j in range(k))) for k in range(40)]
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).selectExpr("*", "1 AS bucket", "2 AS peek")
        assert Counter(map(tuple, prints.fingerprints(frame).collect())) == brute_prints(rows)
        plain = [r for r in rows if r[0] is not None]
        frame = spark.createDataFrame(plain, "doc_id long, text string")
        assert Counter(map(tuple, prints.fingerprints(frame).collect())) == brute_prints(plain)
        for some in (rows[:1], [(None, "alone")], [(None, "a b"), (None, "c d")], []):
            frame = spark.createDataFrame(some, "doc_id long, text string")
            assert Counter(map(tuple, prints.fingerprints(frame).collect())) == brute_prints(some)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
