"""Cases that earlier versions lost."""

import numpy as np

from qaloom.llm import jaccard_join, language_id, toxicity


def test_a_repeated_id_keeps_its_own_text_and_not_the_copy(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a, 1), (15, a, 2), (15, b, 3), (15, b, 4), (20, c, 6), (None, a, 7), (30, None, 8), (30, None, 9), (31, "", 10)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n int").repartition(4)
    got = sorted(map(repr, map(tuple, jaccard_join.one_of_each(docs).select("doc_id", "text").collect())))
    want = [(3, a), (15, b), (20, c), (None, a), (30, None), (31, "")]
    assert got == sorted(map(repr, want))
    again = jaccard_join.one_of_each(docs.repartition(2)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, jaccard_join.one_of_each(docs).collect()))


def test_columns_of_the_results_own_names_are_replaced(spark):
    rows = [(i, t, "en" if i % 2 else "fr", 0.5, "old", 9) for i, t in enumerate(["the house and the tree", "la maison et le pain", "the cat", "le chat", "12", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, predicted int")
    found = language_id.identify(docs, language_id.learn_profiles(docs))
    assert found.columns == ["doc_id", "text", "lang", "predicted", "lang_pred", "score"]
    assert {r.doc_id: r.lang_pred for r in found.collect()}[4] == "und"
    lexicon, _ = toxicity.train_model(spark.createDataFrame([("bad words", 1, 1), ("good words", 0, 2)], "text string, y long, rank long"))
    rated = toxicity.score(docs, lexicon, np.zeros(toxicity.FEATURES + 1))
    assert rated.columns == ["doc_id", "text", "lang", "lang_pred", "score", "predicted"]
    assert {(r.score, r.predicted) for r in rated.collect()} == {(0.5, 1)}


def test_toxicity_learns_the_same_where_texts_stay_in_place(spark):
    insults = ["you stupid fool", "what a stupid idiot you are", "stupid people like you"]
    rows = [(i, f"{insults[i % 3]} number{i}" if i % 4 == 0 else f"a calm sentence about weather number{i}") for i in range(400)]
    rows += [(400 + i, "one and the same copied text") for i in range(60)] + [(500, None), (501, ""), (502, "without a label")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0 and i < 400)) for i, _ in rows if i != 502] + [(7, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    lexicon, weights = toxicity.train_on(docs, marks, "doc_id", "text", "toxic", 4, 2)
    plain, plain_weights = toxicity.train_model(toxicity.labelled(docs, marks, "doc_id", "text", "toxic", 4, 2))
    assert "stupid" in lexicon.weight and lexicon.weight == plain.weight
    assert np.allclose(weights, plain_weights)
    again = docs.unionByName(docs.filter("doc_id = 4"))
    assert toxicity.train_on(again, marks, "doc_id", "text", "toxic", 4, 2)[0].weight == lexicon.weight
    for few in (marks.limit(0), marks.filter("toxic = 0")):
        bare, flat = toxicity.train_on(docs, few, "doc_id", "text", "toxic", 4, 2)
        assert bare.weight == {} and {r["score"] for r in toxicity.score(docs, bare, flat).collect()} == {0.0}
    assert toxicity.train_on(docs.limit(0), marks, "doc_id", "text", "toxic", 4, 2)[0].weight == {}


def test_texts_of_the_shingle_join_move_at_every_size(spark, capsys):
    docs = spark.createDataFrame([(i, " ".join(f"w{j + i // 2}" for j in range(60))) for i in range(20)], "doc_id long, text string")
    nodes = jaccard_join.node_table(docs, "doc_id", "text")
    capsys.readouterr()
    jaccard_join.linked_nodes(docs, nodes, "text", "doc_id").explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
