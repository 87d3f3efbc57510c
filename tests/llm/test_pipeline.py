"""The corpus pipeline against its stages done by hand."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests_llm_brute import brute_classes, shingles, windows_removed

ITEM = " ".join(f"question{c}" for c in "abcdefghijklmnop")


def rows():
    rng = random.Random(8)
    words = [a + b for a in ("ka", "lo", "mi", "ter", "san") for b in ("den", "fo", "gir", "hul", "jam", "ko")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, base = text(50), text(120)
    near = base.split()
    near[60] = "other"
    texts = [base, base, " ".join(near), text(40) + " " + shared + "\n" + text(30), shared + " " + text(60), text(20) + " " + ITEM, None, "", "12 34", text(1500), "short one", text(80)]
    return [(i, t, "en" if i % 3 else None, None, None, i * 2, "x") for i, t in enumerate(texts)] + [(None, text(70), "en", "s", 1, 0, None)]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long, score int, doc string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def expected():
    docs = [(r[0], r[1]) for r in rows() if r[1] and any(c.isalpha() for c in r[1])]
    group = brute_classes([shingles(t) for _, t in docs])
    firsts = {}
    for (i, t), g in zip(docs, group):
        if i is not None and (g not in firsts or i < firsts[g][0]):
            firsts[g] = (i, t)
    docs = [*firsts.values(), *[(i, t) for i, t in docs if i is None]]
    split = [t.encode().split() for _, t in docs]
    counts = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    out = []
    for (i, t), w in zip(docs, split):
        gone = windows_removed(w, 35, counts)
        out.append((i, b" ".join(x for x, g in zip(w, gone) if not g).decode() if gone.any() else t))
    item = shingles(ITEM)
    return [(i, t) for i, t in out if 100 * len(item & shingles(t)) < 80 * len(item)]


def test_pipeline(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "passages", "benchmark", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == columns
    want = expected()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in docs.collect()))) == sorted(map(repr, want))
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = Counter()
    for r in corpus_pipeline.run(spark, folder).collect():
        size[r.doc_id] += r.length
    assert size == {i: len(model.encode(t, add_special_tokens=False).ids) + 1 for i, t in want}


def test_pipeline_without_rows(spark, folder, tmp_path):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, folder).count() == 0 and stage(spark, empty, folder).columns == empty.columns
    assert corpus_pipeline.STAGES[-1][1](spark, empty, folder).count() == 0
