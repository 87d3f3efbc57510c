"""Collocations, alignment of tokenizers and sharding against brute force on small tables, odd inputs included."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from qaloom.llm import alignment, collocations, sharding
from qaloom.llm.common import numbered

SCHEMA = "doc_id long, text string, lang string, source string, shard string, row_number int, n_a long, phrase string, pair string, block int"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def some_rows():
    rng = random.Random(8)
    words = ["New", "York", "the", "of", "city", "a", "x-y", "été", "漢字", "b\x01", "b", "I'm", "<|endoftext|>", "▁", "…"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", "\n", "\t", ". "]) for _ in range(n))
    base = "new york city " * 15
    texts = [
        (1, base, "en"), (2, base, "en"), (3, base.upper(), None), (4, None, "en"), (5, "", "en"), (6, " \t\r\n ,.", "en"), (7, "one", "fr"),
        (8, "a a a a a a a a a a a a a a", "en"), (9, text(4000), "und"), (10, text(300), "en"), (11, text(300), "fr"), (12, text(2500), None),
        (None, text(60), "en"), (None, None, None), (13, "same row", "en"), (13, "same row", "en"), (14, "x" * 4000, "en"), (15, "  two  blanks  ", "en"),
        (16, "<s> </s> <unk> <0x41>", "de"), (17, "emoji \U0001f9ff tail \x00 nul �", "de"), (15, text(40), "de"), (18, "99 12,5 % 1e9", "de"),
    ]
    return [(i, t, lang, None, "s", 3, None, "p", None, 1) for i, t, lang in texts]


@pytest.fixture(scope="module")
def rows():
    return some_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, want):
    got = [tuple(r) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# ---- phrases


def brute_phrases(rows, longest=3, least=10, top=2000, covered=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for r in rows:
        lang = r[2] if r[2] is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (r[1] or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    kept = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    found = []
    for (lang, *w), a in kept.items():
        longer = [b for (m, *v), b in kept.items() if m == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if not any(100 * b >= covered * a for b in longer):
            score, _, l, r = min((10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
            found.append((lang, " ".join(w), a, l, r, n[lang], score))
    out = []
    for lang in sorted({x[0] for x in found}):
        ranked = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(lang, i, *x[1:]) for i, x in enumerate(ranked[:top], 1)]
    return out


@pytest.mark.parametrize(("shard", "longest", "least", "top", "each"), [(4_000_000, 3, 10, 2000, 10**6), (500, 3, 10, 2000, 300), (1, 4, 2, 50, 1000), (2000, 2, 1, 2000, 10**6)])
def test_collocations(docs, rows, monkeypatch, shard, longest, least, top, each):
    monkeypatch.setattr(collocations, "PER_LIST", each)
    want = brute_phrases(rows, longest, least, top)
    same(collocations.mine(docs, longest=longest, min_count=least, top=top, shard_bytes=shard), want)
    assert len(want) > 20


def test_collocations_of_nothing(spark, none):
    same(collocations.mine(none), [])
    same(collocations.mine(spark.createDataFrame([(1, None, "en"), (2, "a b", "en")], "doc_id long, text string, lang string")), [])
    with pytest.raises(ValueError, match="longest"):
        collocations.mine(none, longest=1)


def test_index_extends_both_ways():
    rng = np.random.default_rng(5)
    for kinds, longest in ((3, 5), (30, 3), (2, 6)):
        s = np.append(rng.integers(0, kinds, 400), 0)
        want = Counter(tuple(s[i : i + k].tolist()) for k in range(2, longest + 1) for i in range(len(s) - k + 1) if all(s[i : i + k]))
        got = Counter()
        for words, n in collocations.phrases(s, kinds, longest):
            got.update({tuple(w): c for w, c in zip(words.tolist(), n.tolist(), strict=True)})
        assert got == want
        two = {w for w in want if len(w) == 2 and want[w] > 3}
        known, got = {2: np.array(sorted(two)).reshape(-1, 2)}, {}
        for words, n in collocations.phrases(s, kinds, 3, known):
            got |= {tuple(w): c for w, c in zip(words.tolist(), n.tolist(), strict=True)}
        assert got == {w: c for w, c in want.items() if len(w) == 2 or (len(w) == 3 and w[:2] in two and w[1:] in two)}
    # more kinds than fit into one key
    s = np.append(rng.integers(1, 40, 200) * 10**6, 0)
    assert sum(n.sum() for _, n in collocations.phrases(s, 4 * 10**7, 3)) == 199 + 198


# ---- alignment


def brute_alignment(rows):
    tk, sp = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tk.encode_special_tokens = True
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    names = {i: k for k, i in tk.get_vocab().items()}
    count, texts = Counter(), []
    for r in rows:
        whole = (" " + (r[1] or "")).encode()
        a, b = (tk.encode(whole.decode(), add_special_tokens=False).ids, sp.encode(r[1])) if r[1] else ([], [])
        a = [(i, bytes(letters[c] for c in names[i])) for i in a]
        b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i, p in zip(b, map(sp.id_to_piece, b), strict=True)]
        if not r[1] or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            texts.append(None)
            continue
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        groups, lo = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append([[i for (i, _), e in zip(side, end, strict=True) if lo < e <= cut] for side, end in zip((a, b), ends, strict=True)])
            lo = cut
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        count.update(links.keys())
        texts.append((len(a), len(b), groups, links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    for r, t in zip(rows, texts, strict=True):
        if t is None:
            yield (r[0], 0, 0, 0, 0, 0, 0, "")
        else:
            said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in t[2])
            links = t[3]
            yield (
                r[0], t[0], t[1], len(t[2]), links.total(), sum(n for k, n in links.items() if count[k] == best[k[0]]),
                sum(n * count[k] for k, n in links.items()), hashlib.sha256(said.encode()).hexdigest(),
            )


@pytest.mark.parametrize(("chunk", "block", "part"), [(1_000_000, 8_000_000, 4_000_000), (300, 3000, 50), (1, 1, 1)])
def test_alignment(docs, rows, monkeypatch, chunk, block, part):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "SLICE", part)
    want = list(brute_alignment(rows))
    same(alignment.align(docs, BPE, PIECES), want)
    assert sum(not w[1] for w in want) > 4 and any(w[4] > w[3] for w in want)


def test_alignment_of_nothing(none, docs):
    same(alignment.align(none, BPE, PIECES), [])
    nulls = docs.withColumn("text", F.lit(None).cast("string"))
    assert {tuple(r)[1:] for r in alignment.align(nulls, BPE, PIECES).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_overlaps_are_the_tokens_that_share_a_byte(spark):
    text = "An unbelievable café costs 1234567 Übergrößen\n\tend"
    t = alignment.Tokenizers((open(BPE, "rb").read(), open(PIECES, "rb").read()))
    got = alignment.overlaps(spark.createDataFrame([(5, "x"), (7, text)], "doc_id long, text string"), BPE, PIECES).filter("doc_id = 7").collect()
    a, b = t.first(" " + text).tolist(), t.second([text])[0]
    spans = [list(zip(np.cumsum([0, *n[:-1]]).tolist(), np.cumsum(n).tolist(), strict=True)) for n in ([len(t.a[i]) for i in a], [len(t.b[i]) for i in b])]
    want = {(i, j, a[i], b[j]) for i, p in enumerate(spans[0]) for j, q in enumerate(spans[1]) if max(p[0], q[0]) < min(p[1], q[1])}
    assert {(r["i"], r["j"], r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    assert sorted({r["group"] for r in got}) == list(range(max(r["group"] for r in got) + 1))


# ---- sharding


@pytest.mark.parametrize("n", [1, 2, 3, 10, 16, 17, 1000, 4097])
def test_places_are_a_permutation_and_its_inverse(n):
    row = np.arange(n)
    place = sharding.place_of(row, n, seed=n)
    assert sorted(place.tolist()) == row.tolist()
    assert sharding.row_of(place % 8, place // 8, n, seed=n).tolist() == row.tolist()
    with pytest.raises(ValueError, match="slot"):
        sharding.row_of(np.array([n % 8]), np.array([n // 8]), n)


def test_places_of_large_tables_are_mixed():
    n = 10**13 + 7
    row = np.arange(n - 20_000, n)
    place = sharding.place_of(row, n)
    assert len(set(place.tolist())) == 20_000 and 0 <= place.min() and place.max() < n
    assert sharding.row_of(place % 8, place // 8, n).tolist() == row.tolist()
    assert abs(place.mean() / n - 0.5) < 0.01 and np.abs(np.bincount(place % 8) / 2500 - 1).max() < 0.1
    assert (sharding.place_of(row, n, seed=1) != place).mean() > 0.99


def test_sharding(docs, rows, none):
    got = sharding.shard_documents(docs).collect()
    raw = [(r[1] or "").encode() for r in rows]
    want = [(r[0], len(t) + 1, zlib.crc32(t), "rows", None) for r, t in zip(rows, raw, strict=True)]
    assert sorted(map(repr, [(r[0], r[1], r[2], r[3], r["grown_shard"]) for r in got])) == sorted(map(repr, want))
    order = sorted(((r[0] is not None, r[0] or 0, zlib.crc32(t), len(t) + 1) for r, t in zip(rows, raw, strict=True)))
    for r in got:
        assert order[r["row_number"]] == (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"])
        place = int(sharding.place_of(np.array([r["row_number"]]), len(rows))[0])
        assert (r["shard"], r["slot"]) == (place % 8, place // 8)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(n)) for k, n in counts.items())
    again = sharding.shard_documents(docs.repartition(7).withColumn("more", F.lit(1))).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got)) and sharding.shard_documents(none).collect() == []


def test_many_equal_rows_are_numbered_in_many_tasks(spark):
    same_row = spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit("x").alias("t"))
    rows, n = numbered(same_row, ["doc_id", "t"], "at")
    assert n == 4000 and sorted(r["at"] for r in rows.collect()) == list(range(4000))
    assert max(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()) < 2000

def test_shards_are_written_in_order_of_their_slots(spark, docs, rows, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), ["doc_id", "text"], shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    columns = [c for c in docs.columns if c != "shard"]
    assert sorted(map(repr, map(tuple, back.select(*columns).collect()))) == sorted(map(repr, map(tuple, docs.select(*columns).collect())))
    for k in range(3):
        files = sorted((tmp_path / "out" / f"shard={k}").glob("*.parquet"))
        slots = [r["slot"] for f in files for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(len(slots))) and len(slots) >= len(rows) // 3


# ---- registered queries


@pytest.mark.parametrize("name", ["op11_collocations", "op12_tokenizer_alignment", "op13_sharding"])
def test_registered_query(spark, sf, name):
    from qaloom.llm.queries import QUERIES

    out = QUERIES[name](spark, sf)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    if name == "op11_collocations":
        same(out, brute_phrases(rows))
        assert out.schema.simpleString() == "struct<lang:string,rank:bigint,phrase:string,a:bigint,l:bigint,r:bigint,n:bigint,score:bigint>"
    elif name == "op12_tokenizer_alignment":
        same(out, brute_alignment(rows))
        assert [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"]
    else:
        assert sorted(r["doc_id"] for r in out.collect()) == sorted(r[0] for r in rows)
        assert dict(out.dtypes) | {"slot": "bigint", "shard": "int", "grown_shard": "int", "size": "bigint", "text_crc32": "bigint", "law": "string"} == dict(out.dtypes)
