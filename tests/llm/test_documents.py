"""Operators on documents against brute force on a small fixture, and on empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelstat.llm import byte_bpe, exact_dedup, lm_scoring, minhash_dedup, packing, sharding, token_counts, words
from panelstat.llm.queries import RANKS, TOKENIZER
from panelstat.llm.word_hashes import hashed_texts
from tests.llm.conftest import BASE, LONG, ROWS
from tests.oracle import compare

TEXTS = [t or "" for _, t in ROWS]


def fold(text):
    return (text or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.UPPER.lower()))


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def library_ids(text):
    return Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["op2_sharding", "op5_exact_dedup", "op7_embedding_dedup"])
def test_matches_sql(spark, sf, name):
    from panelstat.llm.queries import QUERIES

    fn, sql = QUERIES[name]
    ok, message = compare(fn(spark, sf), sql, sf)
    assert ok, message


# op1


def test_token_counts_follow_the_library_and_fill_the_cache(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    expected = Counter((i, len((t or "").encode()), len(library_ids(t or "")), len(library_ids(t or "")) > 512) for i, t in ROWS)
    assert Counter(rows(token_counts.token_counts(docs, TOKENIZER, cache))) == expected
    stored = token_counts.read_cache(spark, cache).count()
    assert stored == len(set(TEXTS))
    assert Counter(rows(token_counts.token_counts(docs, TOKENIZER, cache))) == expected
    assert token_counts.read_cache(spark, cache).count() == stored  # nothing was a miss


def test_stored_counts_are_used_and_versions_kept_apart(spark, docs, tmp_path):
    cache, version = str(tmp_path / "cache"), words.file_digest(TOKENIZER)
    known = [(hashlib.sha256(b"two words").digest(), 77, version), (hashlib.sha256(b"Two  words").digest(), 88, "another")]
    spark.createDataFrame(known, token_counts.CACHE_SCHEMA).write.partitionBy("tokenizer").parquet(cache)
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, TOKENIZER, cache).collect()}
    assert counts[7] == 77
    assert counts[8] == len(library_ids("Two  words"))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_go_whole_through_their_library(name):
    path = public_tokenizers.path(name)
    got = [np.frombuffer(i, "<u4").tolist() for i in words.encoder(path).encode(TEXTS[:8])]
    if name.endswith(".json"):
        assert got == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in TEXTS[:8]]
    else:
        import sentencepiece

        assert got == sentencepiece.SentencePieceProcessor(model_file=path).encode(TEXTS[:8])


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_pieces_give_the_ids_of_whole_texts(text):
    assert np.frombuffer(words.encoder(TOKENIZER).encode([text])[0], "<u4").tolist() == library_ids(text)


# op2


def test_shards_are_near_equal_whole_and_gapless(docs):
    found = sharding.shard(docs, shards=3, tolerance=0.0).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS
    )
    slots, sizes = defaultdict(list), Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in found)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(3)) <= 2 * largest


def test_shards_split_a_hot_repeated_row(spark):
    same = spark.range(4_000).selectExpr("cast(1 as long) doc_id", "'same text' text")
    sizes = {r.shard: r["count"] for r in sharding.shard(same, shards=4).groupBy("shard").count().collect()}
    assert len(sizes) == 4 and max(sizes.values()) - min(sizes.values()) < 40


# op3


def brute_components(pairs, percent=75):
    sets = {}
    for k, (_, t) in enumerate(pairs):
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        sets[k] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            smallest[find(k)] = min(i, smallest.get(find(k), i))
    return [(i, len(sets[k]), smallest.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(pairs)]


def test_near_duplicates_match_brute_force(docs):
    expected = Counter((i, n, c, i is not None and i == c) for i, n, c in brute_components(ROWS))
    assert Counter(rows(minhash_dedup.near_duplicates(docs))) == expected


def test_near_duplicates_of_graded_copies(spark):
    """Chains of copies with more and more changes, around the threshold."""
    rng = np.random.default_rng(3)
    pairs = []
    for group in range(6):
        base = [f"w{rng.integers(5_000)}" for _ in range(120)]
        for k in range(9):
            text = list(base)
            for at in rng.choice(120, k, replace=False):
                text[at] = f"c{rng.integers(5_000)}"
            pairs.append((100 * group + k, " ".join(text)))
    found = minhash_dedup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string"))
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found.collect()} == set(brute_components(pairs))


def changed(rng, base, k):
    text = list(base)
    for at in rng.choice(len(base), k, replace=False):
        text[at] = f"c{rng.integers(10**9)}"
    return text


def test_near_duplicates_of_a_hub_with_many_spokes(spark):
    """Copies that link to their original only, beside ones too far from it to link to anything."""
    rng = np.random.default_rng(11)
    hub = [f"w{k}" for k in range(400)]
    texts = [hub] + [changed(rng, hub, 8) for _ in range(2_200)] + [changed(rng, hub, 16) for _ in range(60)]
    pairs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = [set(zip(*(t[j:] for j in range(5)))) for t in texts]
    similar = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    assert all(similar(sets[0], s) for s in sets[1:2_201])
    expected = dict.fromkeys(range(2_201), 0)
    for k in range(2_201, len(sets)):
        assert not any(similar(sets[k], s) for j, s in enumerate(sets) if j != k)
        expected[k] = k
    found = minhash_dedup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == expected


def test_near_duplicates_in_buckets_of_many_components(spark):
    """Texts from one template that link in twos only: no head of a bucket takes in the others."""
    rng = np.random.default_rng(12)
    template, pairs = [f"w{k}" for k in range(300)], []
    for k in range(250):
        text = changed(rng, template, 9)
        pairs += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(changed(rng, text, 4)))]
    expected = brute_components(pairs)
    assert len({c for _, _, c in expected}) > 100
    found = minhash_dedup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string"))
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found.collect()} == set(expected)


def test_prefixes_meet_for_all_similar_pairs(spark):
    """Sets of unlike sizes around the threshold; pairs of one component don't meet."""
    rng, texts = np.random.default_rng(13), []
    for _ in range(25):
        base = [f"w{rng.integers(300)}" for _ in range(rng.integers(6, 90))]
        texts += [base] + [changed(rng, base, int(rng.integers(0, 4)))[: max(5, len(base) - int(rng.integers(0, 12)))] for _ in range(5)]
    texts = list({" ".join(t): t for t in texts}.values())
    sets = [set(zip(*(t[j:] for j in range(5)))) for t in texts]
    expected = {
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and i % 3 != j % 3
    }
    rest = spark.createDataFrame([(k, k % 3) for k in range(len(texts))], "node long, component long")
    whole = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "node long, text string")
    found = {(max(r), min(r)) for r in minhash_dedup._prefix_pairs(rest, whole, 75, 5).collect()}
    assert len(expected) > 60 and expected <= found
    assert all(i % 3 != j % 3 for i, j in found) and len(found) < 4 * len(expected)


def test_near_deduplication_keeps_one_of_each_component(docs):
    kept = minhash_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    components = brute_components(ROWS)
    empty = Counter((i, t) for (i, t), (_, n, _) in zip(ROWS, components) if n == 0)
    named = Counter()
    for (i, t), (_, n, c) in zip(ROWS, components):
        if n and (i == c) and not named[(i, t)]:
            named[(i, t)] = 1
    assert got == empty + named


def test_signatures_agree_as_often_as_sets_overlap():
    rng, k = np.random.default_rng(1), 0
    a = np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:340], rng.integers(0, 2**64, 60, dtype=np.uint64)]))
    for salt in range(20):
        x, y = (np.sort(minhash_dedup._mix(s ^ np.uint64(salt))) for s in (a, b))
        k += (minhash_dedup.signature(x) == minhash_dedup.signature(y)).mean() / 20
    assert abs(k - 340 / 460) < 0.05
    one = minhash_dedup.signature(a[:1])
    assert (one == a[0]).all()


# op4


def test_word_hashes_cut_as_bytes_do():
    import pyarrow as pa

    found = list(hashed_texts(pa.array([t for _, t in ROWS] + [LONG * 60])))
    expected = [t.encode().lower().split() for t in [*TEXTS, LONG * 60]]
    assert [len(f) for f in found] == [len(e) for e in expected]
    seen = {}
    for f, e in zip(found, expected):
        for h, w in zip(f.tolist(), e):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(0, 256, int(n), dtype=np.uint8)) for n in rng.integers(0, 90, 300)] + [b"A" * 500 + b" b", None, b"", b"x\tY \x0b" * 200]
    whole = list(hashed_texts(pa.array(texts, pa.binary())))
    monkeypatch.setattr("panelstat.llm.word_hashes.CHUNK_BYTES", 64)
    for a, b, t in zip(whole, hashed_texts(pa.array(texts, pa.binary())), texts, strict=True):
        assert (a == b).all() and len(a) == len((t or b"").split())


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in lm_scoring.start_weights().items()}
    around, target = rng.integers(0, lm_scoring.SIZE, (4, 40)), rng.integers(0, lm_scoring.SIZE, 40)
    got = lm_scoring.gradients(w, around, target)
    for k in w:
        at = np.unravel_index(np.argmax(np.abs(got[k])), got[k].shape)
        loss = []
        for step in (1e-3, -1e-3):
            w[k][at] += step
            loss.append(-lm_scoring.log_probabilities(w, around, target).astype(np.float64).mean())
            w[k][at] -= step
        assert abs((loss[0] - loss[1]) / 2e-3 - got[k][at]) < 2e-3


def test_updates_are_those_of_whole_tables():
    """Rows that a batch does not touch stay, whatever the number of ids does to the tree."""
    rng = np.random.default_rng(1)
    for classes in (2, 7, lm_scoring.CLASSES):
        start, size = lm_scoring.start_weights(classes), classes**2
        around, target = rng.integers(0, size + 1, (4, 200)), rng.integers(0, size, 200)
        trainer = lm_scoring.Trainer(start, 0.05)
        trainer.add(around, target)
        trainer.flush()
        for k, g in lm_scoring.gradients(start, around, target).items():
            assert np.allclose(trainer.w[k], start[k] - 0.05 * g / np.sqrt(1e-6 + g * g), atol=1e-5)
        every = np.arange(size)
        total = np.exp(lm_scoring.log_probabilities(trainer.w, np.repeat(around[:, :1], size, axis=1), every)).sum()
        assert abs(total - 1) < 1e-3


def test_scores_are_those_of_each_word_by_its_window(spark):
    """Brute force, word by word and without blocks, over texts of all lengths, repeated rows and clashing columns."""
    import pyarrow as pa

    texts = ["", None, " ", "a", "a b", "c a b a " * 40_000, "x y z", "x y z", "b " * 7]
    docs = spark.createDataFrame([(i, t, 0, 0, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, row int, ids int, seed int, others int")
    vocabulary, _ = lm_scoring.vocabulary(docs)
    weights = lm_scoring.train(lm_scoring.coded(docs, vocabulary), vocabulary, 2)
    scored = lm_scoring.coded(docs, vocabulary).mapInArrow(
        lm_scoring._score(weights, vocabulary.classes), "row long, doc_id long, n_words long, score double"
    )
    got = {r.doc_id: r for r in scored.collect()}
    for i, hashes in enumerate(hashed_texts(pa.array(texts))):
        ids = lm_scoring.to_ids(hashes, vocabulary)
        padded = [lm_scoring.PAD] * 2 + ids.tolist() + [lm_scoring.PAD] * 2
        seen, total = {}, 0.0
        for k, word in enumerate(ids.tolist()):
            window = (*padded[k : k + 2], *padded[k + 3 : k + 5], word)
            if window not in seen:
                seen[window] = lm_scoring.log_probabilities(weights, np.array(window[:4])[:, None], np.array([word]))[0]
            total += float(seen[window])
        assert got[i].n_words == len(ids) and abs(got[i].score - total) <= 1e-4 * max(1, abs(total))
    assert got[6].score == got[7].score


def test_sums_and_orders_of_ids_are_those_of_brute_force():
    rng = np.random.default_rng(2)
    for size, n in ((5, 1), (5, 3_000), (300, 4_000), (90_000, 2_000), (90_000, 1)):
        ids = np.minimum(rng.integers(0, size, n), rng.integers(0, size, n)).astype(np.int32)
        order = lm_scoring._order(ids, size)
        assert (order == np.argsort(ids, kind="stable")).all()
        for kind in (np.float32, np.float64):
            rows = rng.standard_normal((n, lm_scoring.HIDDEN)).astype(kind)
            first = lm_scoring._firsts(ids[order])
            got, by = lm_scoring._sums(rows, order, first)
            expected = np.zeros((size, lm_scoring.HIDDEN))
            np.add.at(expected, ids, rows)
            found = ids[order][first[by]]
            assert sorted(found.tolist()) == np.unique(ids).tolist()
            assert got.dtype == kind and np.allclose(got, expected[found], atol=1e-3)


def test_shares_are_those_of_plain_softmax():
    """In batches beyond and below the length of runs at which the products are laid out otherwise, and of scores far apart."""
    rng = np.random.default_rng(3)
    w = {k: v.astype(np.float64) for k, v in lm_scoring.start_weights(9).items()}
    w["node2"][:, :-1] *= 3_000
    for n in (1, 40, 8_000):
        around, target = rng.integers(0, 82, (4, n)), rng.integers(0, 81, n)
        got = lm_scoring.log_probabilities(w, around, target)
        h = np.ones((n, lm_scoring.HIDDEN + 1))
        h[:, :-1] = np.tanh(sum(w["embedding"][j][around[j]] for j in range(4)) + w["bias"])
        fans, expected = lm_scoring.fan_outs(9), np.zeros(n)
        for level in range(lm_scoring.LEVELS):
            child = target // int(np.prod(fans[level + 1 :]))
            z = np.einsum("ij,ijk->ik", h, w[f"node{level}"][child // fans[level]])
            z -= z.max(axis=1, keepdims=True)
            expected += z[np.arange(n), child % fans[level]] - np.log(np.exp(z).sum(axis=1))
        assert np.allclose(got, expected)


def test_ids_of_words_that_begin_alike():
    known = np.unique(np.concatenate([np.arange(40, dtype=np.uint64) + np.uint64(7 << 60), np.array([0, 1, 2**63, 2**64 - 1], np.uint64)]))
    words = lm_scoring.Vocabulary(known, np.random.default_rng(4).permutation(len(known)).astype(np.int32), 32, 1024 - len(known))
    hashes = np.concatenate([known, known + np.uint64(1), np.arange(9, dtype=np.uint64) << np.uint64(60)])
    ranks = dict(zip(known.tolist(), words.rank.tolist()))
    assert lm_scoring.to_ids(hashes, words).tolist() == [ranks.get(h, words.top + h % words.buckets) for h in hashes.tolist()]
    empty = lm_scoring.Vocabulary(known[:0], words.rank[:0], 32, 1024)
    assert lm_scoring.to_ids(hashes, empty).tolist() == [h % 1024 for h in hashes.tolist()]


def test_training_and_shares_neither_sort_words_nor_leave_shuffles(spark, monkeypatch):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen, shapes = spark.conf.get(key, None), [], lm_scoring.shapes
    monkeypatch.setattr(lm_scoring, "shapes", lambda classes: seen.append(spark.conf.get(key, None)) or shapes(classes))
    docs = spark.createDataFrame([(i, f"a b {i} c") for i in range(50)], "doc_id long, text string")
    scored = lm_scoring.score(docs, rounds=1)
    assert "true" in seen and spark.conf.get(key, None) == before
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan


def test_probabilities_sum_to_one():
    w, around = lm_scoring.start_weights(), np.array([[1], [2], [3], [lm_scoring.PAD]])
    every = np.arange(lm_scoring.SIZE)
    total = np.exp(lm_scoring.log_probabilities(w, np.repeat(around, len(every), axis=1), every)).sum()
    assert abs(total - 1) < 1e-3


def test_scores_prefer_text_in_order(spark):
    import random

    random.seed(5)
    chain = {f"a{i}": [f"a{(i * 7 + d) % 60}" for d in (1, 2)] for i in range(60)}
    texts = []
    for _ in range(600):
        w = [f"a{random.randrange(60)}"]
        while len(w) < 60:
            w.append(random.choice(chain[w[-1]]))
        texts.append(w)
    pairs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i, t in enumerate(texts[:40]):
        shuffled = list(t)
        random.shuffle(shuffled)
        pairs.append((1_000 + i, " ".join(shuffled)))
    pairs += [(2_000, None), (2_001, " "), (None, "a1")]
    got = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(pairs, "doc_id long, text string"), rounds=6).collect()}
    assert len(got) == len(pairs)
    better = sum(got[i].mean_score > got[1_000 + i].mean_score for i in range(40))
    assert better >= 38
    assert (got[2_000].n_words, got[2_000].score, got[2_000].mean_score) == (0, 0.0, None)


def test_every_position_is_a_target_in_each_cycle():
    for n in (0, 1, 1_000):
        seed = np.full(n, 77, np.uint64)
        taken = np.concatenate([lm_scoring.masked(np.arange(n), seed, turn, 4) for turn in range(4, 8)])
        assert sorted(taken.tolist()) == list(range(n))


def test_default_training_prefers_text_in_order(spark):
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(600):
        at = [int(rng.integers(60))]
        while len(at) < 60:
            at.append(int((at[-1] * 7 + rng.integers(1, 3)) % 60))
        texts.append([f"a{k}" for k in at])
    pairs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    pairs += [(1_000 + i, " ".join(rng.permutation(t))) for i, t in enumerate(texts[:40])]
    got = {r.doc_id: r.mean_score for r in lm_scoring.score(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert sum(got[i] > got[1_000 + i] for i in range(40)) >= 38


def test_vocabulary_grows_and_other_words_have_their_part_of_a_bucket(spark):
    """Words outside the vocabulary are told apart by their counts."""
    assert lm_scoring.classes_for(10**5) == lm_scoring.CLASSES and lm_scoring.classes_for(10**8) > 3 * lm_scoring.CLASSES
    top = " ".join(f"t{k}" for k in range(lm_scoring.SIZE - lm_scoring.BUCKETS))
    texts = [top] * 50 + [" ".join(f"r{k}" for k in range(600))] * 20 + [" ".join(f"g{k}" for k in range(3_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words, parts = lm_scoring.vocabulary(docs)
    assert len(words.known) == words.top == lm_scoring.SIZE - lm_scoring.BUCKETS
    got = {r.word: r.log_part for r in parts.collect()}
    assert len(got) == 3_600
    total = np.zeros(words.buckets)
    for w, log_part in got.items():
        total[w % words.buckets] += np.exp(log_part)
    assert np.allclose(total, 1)
    import pyarrow as pa

    r, g = (next(hashed_texts(pa.array([texts[k]]))).view(np.int64).tolist() for k in (50, 70))
    a, b = next((a, b) for a in r for b in g if a % words.buckets == b % words.buckets)
    assert abs(got[a] - got[b] - np.log(20)) < 1e-9
    names = {h: t for h, t in zip(r + g, texts[50].split() + texts[70].split())}
    more = docs.union(spark.createDataFrame([(100, names[a]), (101, names[b])], "doc_id long, text string"))
    scores = {x.doc_id: x.score for x in lm_scoring.score(more).where("doc_id >= 100").collect()}
    assert abs(scores[100] - scores[101] - np.log(21 / 2)) < 1e-5


# op5


def test_exact_duplicates_match_brute_force(docs):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[fold(t)].append(i)
    expected = Counter()
    for i, t in ROWS:
        ids = [x for x in groups[fold(t)] if x is not None]
        keep = max(ids) if ids else None
        expected[(i, keep, len(groups[fold(t)]), i == keep, hashlib.sha256(fold(t).encode()).hexdigest())] += 1
    assert Counter(rows(exact_dedup.exact_duplicates(docs))) == expected


def test_exact_deduplication_leaves_one_row_of_a_text(docs):
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    texts = [fold(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({fold(t) for t in TEXTS})
    assert {r.doc_id for r in kept.collect()} >= {2, 6, 9, 10, 13}


@given(st.sets(st.integers(0, 2**40), min_size=1, max_size=300))
@settings(max_examples=100, deadline=None)
def test_golomb_round_trip(values):
    values = np.array(sorted(values), np.int64)
    assert (exact_dedup.golomb_decode(len(values), *exact_dedup.golomb_encode(values)) == values).all()


# op8


def test_byte_bpe_merges_far_beyond_two_mebibytes():
    codec = byte_bpe.codec(RANKS)
    word = b" international"
    near = codec._merge([word])[0]
    for start in (0, 1 << 21, (1 << 31) + 5):
        token = pa.array(codec.bytes_[np.frombuffer(word, np.uint8)])
        pos = pa.array(np.arange(start, start + len(word)))
        codec.db.register("start", pa.table({"word": pa.array([0] * len(word), pa.int32()), "pos": pos, "token": token}))
        got = codec.db.execute(byte_bpe.MERGE_SQL + " ORDER BY step DESC, pos").fetchall()
        codec.db.unregister("start")
        last = [t for _, _, t, step in got if step == got[0][3]]
        assert np.array(last, "<u4").tobytes() == near


def test_byte_bpe_matches_the_library_and_decodes(docs):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    expected = Counter()
    for i, t in ROWS:
        ids = library.encode_ordinary(t or "")
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected[(i, len(ids), sha, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(rows(byte_bpe.round_trip(docs, RANKS))) == expected
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS)
    assert Counter(rows(back)) == Counter((i, (t or "").encode()) for i, t in ROWS)


@given(st.text(max_size=40))
@settings(max_examples=100, deadline=None)
def test_byte_bpe_of_any_text(text):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    codec = byte_bpe.codec(RANKS)
    ids = codec.encode([text])
    assert ids[0].tolist() == library.encode_ordinary(text)
    assert codec.decode(ids) == [text.encode()]


def test_decoding_refuses_unknown_ids():
    with pytest.raises(ValueError):
        byte_bpe.codec(RANKS).decode([np.array([1, 10**6])])


# op10


def test_packing_places_every_id_once(docs):
    found = packing.pack(docs, TOKENIZER, window=64).collect()
    pieces = Counter()
    for i, t in ROWS:
        ids = [*library_ids(t or ""), 1]
        for start in range(0, len(ids), 64):
            part = np.array(ids[start : start + 64], "<u4")
            pieces[(i, start, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == pieces
    filled = defaultdict(list)
    for r in found:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(filled) == list(range(len(filled)))


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=8), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_fill_is_as_close_as_any(counts, room):
    reach = {0}
    for n, k in counts.items():
        reach = {s + j * n for s in reach for j in range(k + 1) if s + j * n <= room}
    chosen = packing.fill(counts, room)
    assert sum(n * k for n, k in chosen.items()) == max(reach)
    assert all(0 < k <= counts[n] for n, k in chosen.items())


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=30))
@settings(max_examples=50, deadline=None)
def test_patterns_use_every_piece(histogram):
    used = Counter()
    for chosen, times in packing.patterns(histogram, 64):
        assert sum(n * k for n, k in chosen.items()) <= 64
        for n, k in chosen.items():
            used[n] += k * times
    assert used == Counter(histogram)


# all of them


def test_empty_tables_give_no_rows(no_docs, tmp_path):
    assert token_counts.token_counts(no_docs, TOKENIZER, str(tmp_path / "c")).count() == 0
    assert sharding.shard(no_docs).count() == 0
    assert minhash_dedup.near_duplicates(no_docs).count() == 0
    assert minhash_dedup.deduplicate(no_docs).count() == 0
    assert lm_scoring.score(no_docs).count() == 0
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    assert exact_dedup.deduplicate(no_docs).count() == 0
    assert byte_bpe.round_trip(no_docs, RANKS).count() == 0
    assert packing.pack(no_docs, TOKENIZER).count() == 0


def test_a_text_of_one_long_word(spark):
    one = spark.createDataFrame([(1, "ab" * 20_000), (2, BASE)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in byte_bpe.round_trip(one, RANKS).collect()}[1] > 0
