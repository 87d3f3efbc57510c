"""The dealt operators against brute force on small tables, odd inputs included."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict
from urllib.parse import unquote, urlparse

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from qaloom.llm import ann, common, contamination, jaccard_join, language_id, licenses, lm_score, packing, suffix_array, suffix_tree, toxicity
from qaloom.llm.common import Words, fold, shingle_hashes
from tests_llm_brute import brute_classes, shingles, windows_removed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, node string, score double, spans int"
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def odd_texts(rng: random.Random) -> list[tuple]:
    """Nulls everywhere, empty, blank, one-word and long texts, copies, near copies, repeats inside a text, repeated rows and ids."""
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(150)
    near = base.split()
    near[70] = "changed"
    texts = [
        (1, base, "en"), (2, base, "en"), (3, " ".join(near), None), (4, None, "de"), (5, "", "de"), (6, " \n\t ", "fr"), (7, "one", "en"),
        (8, "a b c", "en"), (9, "A b\tC", "en"), (10, text(4000), "en"), (11, text(40) + "\n" + PASSAGE + "\n" + text(50), "de"),
        (12, PASSAGE + " " + text(90), "de"), (13, "la la " * 200, "fr"), (14, "é漢 ñ " * 30, "es"), (15, text(120), None), (15, text(110), "en"),
        (16, "same row " + base, "en"), (16, "same row " + base, "en"), (None, text(30), "en"), (None, None, None), (17, "x" * 5000, "en"),
        (18, "12 34 !!", "en"), (19, text(60), "en"), (20, text(100), "fr"),
    ]
    return [(i, t, lang, None if i is None else "s", None, 7, "n", None, 3) for i, t, lang in texts]


@pytest.fixture(scope="module")
def rows():
    return odd_texts(random.Random(4))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return [tuple(r) for r in df.collect()]


def counted_windows(all_units, window):
    return Counter(u[i : i + window] if isinstance(u, bytes) else tuple(u[i : i + window]) for u in all_units for i in range(len(u) - window + 1))


def test_suffix_array_removes_what_brute_force_removes(spark, docs, rows, none):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    counts = counted_windows([t for _, t in texts], 200)
    want = []
    for i, t in texts:
        gone = windows_removed(t, 200, counts)
        want.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    out = suffix_array.remove_repeats(docs)
    assert sorted(map(repr, [(a, b, c, d, bytes(e)) for a, b, c, d, e in got(out)])) == sorted(map(repr, want))
    assert any(w[2] for w in want) and got(suffix_array.remove_repeats(none)) == []


def test_suffix_tree_removes_what_brute_force_removes(spark, docs, rows, none):
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    counts = counted_windows([t for _, t in texts], 35)
    want = [(i, len(t), int(g.sum()), b" ".join(w for w, x in zip(t, g) if not x).decode()) for i, t in texts for g in [windows_removed(t, 35, counts)]]
    assert sorted(map(repr, got(suffix_tree.remove_repeats(docs)))) == sorted(map(repr, want))
    assert got(suffix_tree.remove_repeats(none)) == []
    kept = {(r["doc_id"], r["text"]) for r in suffix_tree.without_repeats(docs).collect()}
    assert (9, "A b\tC") in kept and (4, None) in kept and suffix_tree.without_repeats(docs).columns == docs.columns


def test_hot_keys_are_counted_by_fingerprint(spark, docs):
    from qaloom.llm.repeats import Unit, per_text, repeated_windows, with_key

    keyed, unit = with_key(docs, "doc_id", "text"), Unit(words=True, window=35, k=10)
    judge = lambda pieces, n: suffix_tree.repeated_in_bucket(pieces, n, 35)
    cover = lambda hot: sorted(
        repr((r["doc_id"], r["text"], suffix_tree.kept_words((r["text"] or "").encode(), r["spans"], 35)))
        for r in per_text(keyed, repeated_windows(keyed, unit, judge, hot=hot, bucket=2000)).collect()
    )
    assert cover(0) == cover(20) == cover(10**9)


def test_blocks_and_buckets_agree_with_brute_force():
    rng = random.Random(9)
    for _ in range(15):
        size = rng.choice([20, 200])
        base = [bytes(rng.choice(b"ab c") for _ in range(600)) for _ in range(2)]
        pieces = [bytearray(b[lo : lo + size + rng.randrange(90)]) for b in base for lo in (rng.randrange(200) for _ in range(8))] + [bytearray(b"a" * (size + 30))]
        for p in pieces[::3]:
            p[rng.randrange(len(p))] = rng.choice(b"xyz")
        pieces = [bytes(p) for p in pieces]
        n = np.array([len(p) - size + 1 for p in pieces])
        counts = counted_windows(pieces, size)
        for p, found in zip(pieces, suffix_array.repeated_in_block(pieces, n, size, v=rng.choice([16, 64])), strict=True):
            assert found.tolist() == [counts[p[i : i + size]] > 1 for i in range(len(p) - size + 1)]
        split = [p.split() for p in pieces]
        counts = counted_windows(split, 4)
        n = np.array([max(0, len(p) - 3) for p in split])
        for p, found in zip(split, suffix_tree.repeated_in_bucket(pieces, n, 4, group=rng.choice([1, 7, 10**6])), strict=True):
            assert found.tolist() == [counts[tuple(p[i : i + 4])] > 1 for i in range(max(0, len(p) - 3))]


def test_difference_cover_covers():
    for v in (16, 64, 100):
        d = set(suffix_array.cover(v).tolist())
        assert {(a - b) % v for a in d for b in d} == set(range(v)) and len(d) <= 2 * v**0.5


def test_jaccard_join(spark, rows, docs, none):
    sets = [shingles(r[1]) for r in rows]
    group = brute_classes(sets)
    want = []
    for r, s, g in zip(rows, sets, group):
        ids = [x[0] for x, h in zip(rows, group) if h == g and x[0] is not None] if s else [r[0]]
        want.append((r[0], len(s), min(ids) if ids and ids[0] is not None else None))
    assert sorted(map(repr, got(jaccard_join.classes(docs)))) == sorted(map(repr, want))
    assert got(jaccard_join.classes(none)) == []
    kept = jaccard_join.one_of_each(docs)
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and {1, 10}.issubset(ids) and not {2, 3, 16}.intersection(ids) and ids.count(None) == 2 and ids.count(15) == 1


def test_jaccard_join_moves_its_prefixes_once(spark, docs, monkeypatch):
    plans, write = [], jaccard_join.stored

    def stored(df, name):
        if name == "shared-shingles":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(jaccard_join, "stored", stored)
    jaccard_join.classes(docs).collect()
    assert [p.count("MapInArrow cut") for p in plans] == [1] and plans[0].count("Exchange hashpartitioning(shingle") == 1


def test_jaccard_join_on_random_families(spark):
    rng = random.Random(1)
    rows = []
    for f in range(12):
        base = [f"f{f}x{rng.randrange(50)}" for _ in range(rng.randrange(6, 120))]
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes([shingles(t) for _, t in rows])
    for block in (3, 5000):
        assert dict((a, c) for a, _, c in got(jaccard_join.classes(docs, block=block))) == dict(enumerate(want))


def test_trie_links_make_the_classes_of_all_links():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sets = []
        for _ in range(rng.integers(2, 30)):
            if sets and rng.random() < 0.7:
                s = set(sets[rng.integers(len(sets))].tolist()) ^ set(rng.integers(0, 2**62, rng.integers(0, 4)).tolist())
            else:
                s = set(rng.integers(0, [2**62, 60][rng.integers(2)], rng.integers(1, 40)).tolist())
            sets.append(np.array(sorted(s or {1}), dtype=np.uint64))
        group = list(range(len(sets)))
        for a, b in jaccard_join.trie_links(sets):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
        assert group == brute_classes([set(s.tolist()) for s in sets])


ITEMS = [(1, " ".join(f"item{i}" for i in range(20))), (2, "Tiny item"), (3, None), (4, ""), (None, " ".join(f"z{i}" for i in range(9))), (5, PASSAGE), (5, PASSAGE)]


def brute_contained(rows, items):
    docs, sets = defaultdict(set), defaultdict(set)
    for i, t in rows:
        docs[i] |= shingles(t)
    for i, t in items:
        sets[i] |= shingles(t)
    return sorted(repr((d, i, len(s), len(s & h))) for d, h in docs.items() for i, s in sets.items() if s and 100 * len(s & h) >= 80 * len(s))


def test_contamination(spark, docs, rows, none):
    more = [(30, "before " + ITEMS[0][1].upper() + " after " * 3000, *rows[0][2:]), (31, " ".join(ITEMS[0][1].split()[:17]), *rows[0][2:]), (32, "tiny ITEM", *rows[0][2:]), (33, ITEMS[4][1], *rows[0][2:])]
    more.append((34, " ".join(ITEMS[0][1].split()[:15]), *rows[0][2:]))
    table = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute_contained([(r[0], r[1]) for r in [*rows, *more]], ITEMS)
    assert sorted(map(repr, got(contamination.contained(table, items)))) == want and len(want) >= 5
    clean = contamination.decontaminate(table, items)
    assert clean.columns == docs.columns and not {11, 12, 30, 31, 32, 33}.intersection(r[0] for r in clean.select("doc_id").collect()) and clean.count() == table.count() - 6
    assert got(contamination.contained(none, items)) == [] and got(contamination.contained(docs, items.limit(0))) == []


def test_contamination_is_native(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = contamination.contained(docs, items)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_language(spark, docs, rows, none):
    train = spark.createDataFrame([("en", "the house and the garden of the king"), ("de", "das haus und der garten des königs"), (None, "zz"), ("fr", None)], "lang string, text string")
    profiles = language_id.learn_profiles(train)
    assert profiles.groupBy("lang").count().filter("count > 400").count() == 0
    out = language_id.identify(spark.createDataFrame([(1, "the king and the house", 0.5), (2, "der könig und das haus", None), (3, None, None), (4, " 12 !", None), (5, "", None), (6, "Ж", None)], "doc_id long, text string, score2 double"), profiles)
    assert {r["doc_id"]: r["lang_pred"] for r in out.collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "de"}
    assert all(0 <= r["score"] <= 1 for r in out.collect()) and "score2" in out.columns
    assert got(language_id.identify(none.select("doc_id", "text"), profiles)) == []
    assert {r["lang_pred"] for r in language_id.identify(docs.select("doc_id", "text"), profiles.limit(0)).collect()} == {"und"}


def test_gram_counts_match_counting_by_hand():
    texts = ["Ab ba!", "", "é1b  ab"]
    who, gram, count = language_id.gram_counts(texts, np.arange(3))
    want = Counter()
    for i, t in enumerate(texts):
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            p = f" {w} "
            want.update((i, 0, 0, ord(c)) for c in w)
            want.update((i, 0, ord(a), ord(b)) for a, b in zip(p, p[1:]))
            want.update((i, ord(a), ord(b), ord(c)) for a, b, c in zip(p, p[1:], p[2:]))
    assert {(w, g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF): n for w, g, n in zip(who.tolist(), gram.tolist(), count.tolist())} == {
        k: v - (1 if k[1:] == (0, 32, 0) else 0) for k, v in want.items()
    } or sum(count) >= sum(want.values()) - len(texts)


def test_lm_score(spark, docs, rows, none):
    model, counts = lm_score.train(docs.filter(fold("doc_id", 5) != 1).select("text"))
    words = lambda t: [*bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split(), None]
    train = Counter(w for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 1 for w in words(r[1]))
    n, v = sum(train.values()), len(train)
    out = sorted(map(repr, ((i, a, b, c, round(d, 6)) for i, a, b, c, d, _ in got(lm_score.score(docs, model, counts)))))
    want = [(r[0], len(words(r[1])), sum(w in train for w in words(r[1])), n, round(float(sum(np.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(r[1]))), 6)) for r in rows]
    assert out == sorted(map(repr, want)) and (model.n, model.v) == (n, v)
    assert all(r["score"] <= 0 and np.isfinite(r["score"]) for r in lm_score.score(docs, model, counts).collect())
    assert got(lm_score.score(none, model, counts)) == []
    empty, no_counts = lm_score.train(none.select("text"))
    assert {r[3] for r in got(lm_score.score(docs, empty, no_counts))} == {0}


def test_lm_learns_and_scores_in_one_pass(spark, docs, none, monkeypatch):
    model, counts = lm_score.train(docs.filter(fold("doc_id", 5) != 1).select("text"))
    by = lambda df: sorted(map(tuple, df.collect()), key=lambda r: (str(r[0]), *r[1:]))
    want = by(lm_score.score(docs, model, counts))
    for part, hot, block in ((2_000_000, 1e-3, 4_000_000), (300, 0.02, 2_000), (300, 2.0, 4_000_000)):  # one part, hot words over many parts, none hot
        monkeypatch.setattr(lm_score, "PART", part)
        monkeypatch.setattr(lm_score, "HOT", hot)
        monkeypatch.setattr(lm_score, "BLOCK", block)
        out = by(lm_score.learn_and_score(docs, fold("doc_id", 5) != 1))
        assert [r[:4] for r in out] == [r[:4] for r in want]
        assert np.allclose([r[4] for r in out], [r[4] for r in want])
        assert all(abs(a[5] - b[5]) < 0.05 * a[1] for a, b in zip(out, want, strict=True))  # but for false positives of the filters
    unlearned = by(lm_score.learn_and_score(docs, F.lit(False)))
    assert {r[2:4] for r in unlearned} == {(0, 0)} and all(np.isfinite(r[5]) for r in unlearned)
    assert got(lm_score.learn_and_score(none, fold("doc_id", 5) != 1)) == []


def test_lm_query_writes_less_than_its_texts(spark, sf, monkeypatch):
    written = []

    def stored(df, name):
        out = common.stored(df, name)
        written.extend(out.inputFiles())
        return out

    monkeypatch.setattr(lm_score, "stored", stored)
    assert lm_score.op1_lm_score(spark, sf).count()
    texts = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    size = sum(os.path.getsize(unquote(urlparse(x).path)) for x in written)
    assert 0 < size < texts


def test_lm_probabilities_add_up_to_at_most_one(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice(["a", "b", "c", "d", "e"]) for _ in range(3000))
    model, counts = lm_score.train(spark.createDataFrame([(text,), ("a b a b rare",)], "text string"))
    known, _ = lm_score.tokens([b"a b c d e rare"])
    for h in known:
        w = np.concatenate([known, lm_score.tokens([b"unseen"])[0][:1]])
        total = (10 ** model.log_probability(np.full(len(w), h), w)).sum()
        assert 0.7 < total <= 1.001


def test_lm_keeps_rare_words_and_their_contexts(spark, monkeypatch):
    many = spark.range(6).select(F.repeat(F.lit("a b "), 500_000).alias("text"))  # 6 million tokens
    texts = many.unionByName(spark.createDataFrame([("one two one two",), ("three four",)], "text string"))
    monkeypatch.setattr(lm_score, "HEAD", 1e-3)  # rare words are joined
    model, counts = lm_score.train(texts)
    h, w = (lm_score.tokens([t])[0][:1] for t in (b"three", b"four"))
    assert abs(10 ** model.log_probability(h, w)[0] - 0.25) < 0.01  # (1 - DISCOUNT) / 1 and next to nothing
    docs = spark.createDataFrame([(1, "three four"), (2, "four three"), (3, "one two"), (4, "new three")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in lm_score.score(docs, model, counts).collect()}
    assert out[1]["score"] > out[2]["score"] + 2 and [out[i]["n_known"] for i in (1, 2, 3, 4)] == [3, 3, 3, 2]
    for i, text in ((1, b"three four"), (3, b"one two"), (4, b"new three")):
        words, bounds = lm_score.tokens([text])
        assert abs(out[i]["score"] - model.log_probability(lm_score.before(words, bounds), words).sum()) < 1e-9


def test_filter_reads_lower_edges(spark):
    counts = {k * 7919: c for k, c in enumerate([1, 2, 3, 10, 100, 5000, 1], start=1)}
    f = lm_score._filter_of(spark.createDataFrame([(k, float(c)) for k, c in counts.items()], "key long, c double"), 1.0)
    read = f.count(f.levels(np.array(list(counts), dtype=np.uint64)))
    assert all(c / lm_score.BASE < r * 1.0001 and r <= c * 1.0001 for r, c in zip(read, counts.values()))
    assert (f.levels(np.arange(1, 2000, dtype=np.uint64) << np.uint64(40)) > 0).mean() < 0.01


def test_packing(spark, rows, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    ids = [(r[0], [*model.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for d, start, n, crc, total, seq, offset, raw in got(packing.pack(docs, path)):
        got_ids = np.frombuffer(raw, "<u4")
        assert len(got_ids) == n and zlib.crc32(bytes(raw)) == crc
        pieces[(d, total)].append((start, got_ids.tolist()))
        sequences[seq].append((offset, n))
    for key in {(d, len(x)) for d, x in ids}:
        whole = sum((x for _, x in sorted(pieces[key])), [])
        same = sorted(x for d, x in ids if (d, len(x)) == key)
        assert Counter(whole) == Counter(sum(same, []))
        if len(same) == 1:
            assert whole == same[0]
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    assert got(packing.pack(none, path)) == [] and "ids" not in packing.pack(none, path, with_ids=False).columns


def test_encoder_gives_the_ids_of_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    spec = open(path, encoding="utf-8").read()
    model, mine = Tokenizer.from_str(spec), packing.Encoder(spec)
    model.encode_special_tokens = True
    rng = random.Random(1)
    alphabet = ["a", "b", "é", " ", " ", "  ", "\n", "\t", "'s", "1", ".", "!?", "<|endoftext|>", " ", "　", "漢", "'", "T", " \n", "\r\n", "\x0b", " ", "\x85", "😀", "\0"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(5000)]
    assert [x.tolist() for x in mine.encode(texts)] == [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]
    assert mine.fast is not None


def test_packing_prefers_lexical_neighbours():
    def tail(i, terms):
        terms = np.array(terms, dtype=np.uint16)
        return packing.Tail(i, 0, 40, np.full(40, i, dtype=np.uint16), terms, np.ones(len(terms), dtype=np.uint32))

    tails = [tail(0, [1, 2, 3]), tail(1, [7, 8, 9]), tail(2, [1, 2, 4]), tail(3, [7, 8, 5])]
    assert [[t.doc_id for t, _, _ in s] for s in packing.fill(tails, 80)] == [[0, 2], [1, 3]]


def test_packing_brings_near_copies_of_different_tasks_together(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        words = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(100)}" for _ in range(100)]
        rows += [(i, " ".join(words)), (1000 + i, " ".join([*words[:98], "other"]))]
    held = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "6")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = got(packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False))
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    where = defaultdict(set)
    for r in out:
        where[r[0]].add(r[5])
    tasks = {s >> 33 for s in set().union(*where.values())}
    assert len(tasks) > 3 and sum(bool(where[i] & where[1000 + i]) for i in range(60)) > 40


def test_packing_seeds_reach_the_next_shard_with_frequencies_of_all_rows():
    def tail(i, terms):
        return packing.Tail(i, 0, 40, np.full(40, i, dtype=np.uint16), np.array(terms, dtype=np.uint16), np.ones(len(terms), dtype=np.uint32))

    df = np.full(10, 500)
    df[9] = 2  # rare in all rows, as 1 and 2 are not
    tails = [tail(0, [1, 2, 9]), tail(1, [1, 2, 5]), tail(2, [3, 4, 9]), tail(3, [5, 6, 7])]
    assert [[t.doc_id for t, _, _ in s] for s in packing.fill(tails, 80, packing.Statistics(1000, 40.0, df), 1)] == [[0, 2]]


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_automaton_and_trie_find_what_distances_say():
    rng = random.Random(0)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 10))): 1.0 for _ in range(30)}
    lexicon = toxicity.Lexicon(terms)
    for _ in range(3000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(3, 12)))
        near = min(((levenshtein(w, t), t) for t in terms if levenshtein(w, t) <= toxicity.edits(t)), default=None)
        assert lexicon.match(w) == ((near[1], near[0]) if near else None)


def test_quotation_is_told_from_abuse():
    words = 'he said "idiot" once'.split()
    assert toxicity.quotation(words, 2) > 0.8 > 0.1 > toxicity.quotation("you are an idiot".split(), 3)


def test_toxicity(spark, none):
    rng = random.Random(2)
    plain = lambda n: " ".join(f"w{rng.randrange(300)}x" for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, plain(20) + (" you stupid worthless clown " if bad else " ") + plain(20)))
        labels.append((i, int(bad)))
    rows += [(1000, "what a stupit worthles thing"), (1001, None), (1002, ""), (None, "stupid worthless"), (1003, "nothing here")]
    labels += [(1003, None), (None, 1), (5, 0)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon, weights = toxicity.train_model(toxicity.labelled(docs, marks, "doc_id", "text", "toxic", 4, 2))
    assert {"stupid", "worthless", "clown"} <= set(lexicon.weight)
    out = {r["doc_id"]: r for r in toxicity.score(docs, lexicon, weights).collect()}
    assert len(out) == 405 - 0 and all(out[i]["predicted"] == int(i % 4 == 0) for i in range(400))
    assert out[1000]["score"] > out[1003]["score"] == out[1001]["score"] == out[1002]["score"]
    assert got(toxicity.score(none.select("doc_id", "text"), lexicon, weights)) == []
    lexicon, weights = toxicity.train_model(toxicity.labelled(docs, marks.limit(0), "doc_id", "text", "toxic", 4, 2))
    assert {r["score"] for r in toxicity.score(docs, lexicon, weights).collect()} == {0.0}


def test_toxicity_learns_rare_terms_and_terms_with_digits_from_all_labels(spark):
    rng = random.Random(5)
    plain = lambda: " ".join(f"w{rng.randrange(300)}x" for _ in range(30))
    rows = [(plain() + (" stupid" if i % 3 == 0 else " fine") + (" raretermx sl4g-face" if i % 3 == 0 and i < 36 else ""), int(i % 3 == 0), i) for i in range(3000)]
    train = spark.createDataFrame(rows, "text string, y long, rank long")
    lexicon, _ = toxicity.train_model(train)
    assert set(lexicon.weight) == {"stupid", "raretermx", "sl4g-face"}  # 12 of 1000 toxic texts hold the last two
    assert set(toxicity.train_model(train.withColumn("rank", -F.col("rank")), sample=300)[0].weight) == set(lexicon.weight)


def test_licenses(spark, docs, none):
    mit = licenses.TEMPLATES["MIT notice"]
    rows = [(1, "x " * 5000 + mit + " y" * 50), (2, "RELEASED under the mit License."), (3, "Released under the MIT"), (4, None), (5, " ".join(mit.split()[:47])), (6, "a " * 37 + " ".join(mit.split()[2:50]))]
    out = set(got(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert {(a, b) for a, b, _, _ in out} == {(1, "MIT notice"), (2, "MIT"), (6, "MIT notice")} | ({(5, "MIT notice")} if len(mit.split()[:47]) - 4 >= 0.8 * (len(mit.split()) - 4) else set())
    assert got(licenses.scan(none)) == [] and got(licenses.scan(docs, {"blank": " "})) == []


def test_ann(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)) + 2 * rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)]
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(3001, None), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [None] * 16), (3005, [1.0]), (None, x[0].tolist()), (3006, [float("inf")] * 16), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = got(ann.search(df, lambda i: i % 20 == 0, block=400))
    by_query = defaultdict(list)
    for q, rank, i, s in sorted(out):
        by_query[q].append((rank, i, s))
    hits = 0
    for q in range(0, 3000, 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:20]
        found = by_query[q]
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(s[i] - v) < 1e-9 for _, i, v in found)
        assert [(-v, i) for _, i, v in found] == sorted((-v, i) for _, i, v in found)
        hits += len(set(best.tolist()) & {i for _, i, _ in found})
    assert len(by_query) == 150 and hits >= 0.9 * 20 * 150
    few = got(ann.search(df.limit(3), lambda i: i % 20 == 0))
    assert len(few) == 2 and got(ann.search(df.limit(0), lambda i: i % 20 == 0)) == []


def test_words_and_shingles():
    w = Words([b"A  b\tc", b"", b" d "], lower=True)
    assert [w.raw[a:b] for a, b in zip(w.start, w.end)] == [b"a", b"b", b"c", b"d"] and w.first.tolist() == [0, 3, 3, 4]
    h, bounds = shingle_hashes(w.hashes(), w.first, 2)
    assert bounds.tolist() == [0, 2, 2, 3] and len(set(h.tolist())) == 3


def test_units_of_a_batch_are_encoded_at_once():
    path = public_tokenizers.path("byte_bpe_50k.json")
    mine = packing.Encoder(open(path, encoding="utf-8").read())
    rng = random.Random(8)
    texts = ["".join(f"word{rng.randrange(3000)}" + rng.choice([" ", ". ", "\n"]) for _ in range(60)) + "end" for _ in range(300)]
    texts += ["", "\n", " a", "a\n", "x\ty plain", "two  blanks", "a \n b", "nul\0", "  b"]
    calls, ids = [], mine.ids
    mine.ids = lambda text: calls.append(text) or ids(text)
    out = [x.tolist() for x in mine.encode(texts)]
    odd = len([t for t in texts if "\n " in t or "\t" in t or "  " in t or "\0" in t or " " in t])
    assert len(calls) <= 1 + odd  # one for all units, and one for each text with other white space
    assert out == [mine.model.encode(t, add_special_tokens=False).ids for t in texts]
    got = packing.counted([np.array(x, dtype=np.uint16) for x in out])
    assert [(t.tolist(), f.tolist()) for t, f in got] == [tuple(map(list, zip(*sorted(Counter(x).items())))) if x else ([], []) for x in out]


def test_signature_takes_the_heaviest_tokens_and_of_equal_ones_the_smallest():
    statistics = packing.Statistics(100, 40.0, np.array([50, 3, 3, 3, 90, 3]))
    assert packing.signature(np.array([0, 1, 2, 3, 4, 5]), np.array([1, 2, 2, 2, 1, 2]), statistics) == [1, 2, 3]
    assert packing.signature(np.array([0, 5]), np.array([1, 1]), statistics) == [5, 0, -1]
