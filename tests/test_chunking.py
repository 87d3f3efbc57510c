from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from qaloom.operators.chunking import chunk_counts, chunk_documents


def plain(text, max_words=200, sep="\n\n"):
    """The rule in plain Python: returns the list of chunks."""
    out, cur = [], []
    for p in (x.strip() for x in text.split(sep)):
        if not p:
            continue
        if cur and len(" ".join(cur).split()) + len(p.split()) > max_words:
            out.append(" ".join(cur))
            cur = []
        cur.append(p)
    return out + [" ".join(cur)] if cur else out or [""]


CASES = [
    "First paragraph.\n\nSecond one here.\n\nThird.", "", "  \n\n \t ", "w " * 250, "w " * 200, "\n\n\na b\n\n\n\nc",
    "\u00a0x\u00a0\n\n\u3000y", "a\r\n\r\nb", ("w " * 120 + "\n\n") * 5, "w " * 150 + "\n\n" + "v " * 50 + "\n\nu", "x\n\n" + "w " * 300 + "\n\ny",
]


def run(spark, texts, max_words=200, sep="\n\n"):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = chunk_documents(df, "id", "text", max_words, sep).orderBy("id", "chunk_index").collect()
    got = [[] for _ in texts]
    for r in rows:
        assert r.chunk_index == len(got[r.id]) and r.n_words == len(r.text.split())
        got[r.id].append(r.text)
    return got


def test_known_cases(spark):
    assert run(spark, CASES) == [plain(c) for c in CASES]


def test_three_paragraphs_make_one_chunk(spark):
    assert len(run(spark, CASES[:1])[0]) == 1


def test_null_text_counts_as_empty(spark):
    df = spark.createDataFrame([(1, None)], "id int, text string")
    assert chunk_documents(df, "id", "text").first().text == ""


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b c", " ", "\n\n", "d\u2003e", "\n", "f" * 9]), max_size=40).map("".join), min_size=1, max_size=20))
def test_random_texts(spark, texts):
    assert run(spark, texts, 6) == [plain(t, 6) for t in texts]


def test_counts_match_chunks_and_nothing_shuffles(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "id int, text string")
    got = {r.id: r.chunks for r in chunk_counts(df, "id", "text").collect()}
    assert got == {i: len(plain(c)) for i, c in enumerate(CASES)}
    plan = chunk_documents(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_many_paragraphs(spark):
    text = "\n\n".join(f"p{i} x" for i in range(20_000))
    got = run(spark, [text])[0]
    assert got == plain(text) and len(got) == 200
