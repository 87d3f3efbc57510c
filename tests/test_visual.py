import numpy as np
import pytest
from pyspark.sql import functions as F

from qaloom.functions.images import resize_bilinear, ssim_score, to_gray
from qaloom.operators import visual


def windows(a, b, win=7, rng=255.0):
    """Direct sliding windows."""
    out = []
    for y in range(a.shape[0] - win + 1):
        for x in range(a.shape[1] - win + 1):
            p, q = a[y:y + win, x:x + win].ravel(), b[y:y + win, x:x + win].ravel()
            c = np.cov(p, q, ddof=1)
            c1, c2 = (0.01 * rng) ** 2, (0.03 * rng) ** 2
            out.append((2 * p.mean() * q.mean() + c1) * (2 * c[0, 1] + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (c[0, 0] + c[1, 1] + c2)))
    return float(np.mean(out))


def test_score_against_direct_windows():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (20, 24)).astype(float), rng.integers(0, 256, (20, 24)).astype(float)
    assert ssim_score(a, b) == pytest.approx(windows(a, b), abs=1e-10)
    assert ssim_score(a, a) == pytest.approx(1.0)
    assert ssim_score(a[:6], b[:6]) is None


def test_both_forms_agree(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 256, (9, 11)), rng.integers(0, 256, (9, 11))
    img = "struct<h:int,w:int,channels:int,px:array<int>>"
    tup = lambda m: (9, 11, 1, [int(v) for v in m.ravel()])
    small = (3, 3, 1, [1] * 9)
    pairs = spark.createDataFrame([(1, tup(a), tup(b)), (2, tup(a), tup(a)), (3, small, small)], f"image_id int, cur {img}, ref {img}")
    got = {r.image_id: r.score for r in visual.ssim_images(pairs).collect()}
    want = windows(a.astype(float), b.astype(float))
    assert got[1] == pytest.approx(want, abs=1e-9) and got[2] == pytest.approx(1.0) and got[3] is None
    px = spark.createDataFrame([(1, y, x, int(a[y, x]), int(b[y, x])) for y in range(9) for x in range(11)], "image_id int, y int, x int, p int, q int")
    assert visual.ssim_pixels(px).first().score == pytest.approx(want, abs=1e-9)


def test_resize_and_gray():
    img = np.arange(12.0).reshape(3, 4)
    assert (resize_bilinear(img, 3, 4) == img).all()
    assert resize_bilinear(np.full((5, 7), 9.0), 3, 2).tolist() == [[9, 9]] * 3
    assert to_gray([255, 0, 0, 0, 255, 0, 0, 0, 255, 10, 10, 10], 2, 2, 3).tolist() == [[29, 150], [76, 10]]


def test_size_mismatch_is_resized_to_the_reference(spark):
    img = "struct<h:int,w:int,channels:int,px:array<int>>"
    cur, ref = (16, 16, 3, [100] * 768), (8, 8, 1, [100] * 64)
    df = spark.createDataFrame([(1, cur, ref)], f"image_id int, cur {img}, ref {img}")
    assert visual.ssim_images(df).first().score == pytest.approx(1.0)


def test_pixels_as_bytes(spark):
    img = "struct<h:int,w:int,channels:int,px:binary>"
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 256, (12, 10, 3)).astype(np.uint8) for _ in range(2))
    df = spark.createDataFrame([(1, (12, 10, 3, bytearray(a.tobytes())), (12, 10, 3, bytearray(b.tobytes())))], f"image_id int, cur {img}, ref {img}")
    want = ssim_score(to_gray(a.ravel(), 12, 10, 3), to_gray(b.ravel(), 12, 10, 3))
    assert visual.ssim_images(df).first().score == pytest.approx(want)


@pytest.mark.parametrize("diff,want", [
    (0.99, ("no_change", False, "info", False)), (1.0, ("minor_change", True, "info", False)), (2.0, ("minor_change", True, "info", False)),
    (2.01, ("minor_change", True, "info", True)), (4.99, ("minor_change", True, "info", True)), (5.0, ("significant_change", True, "warning", True)),
    (None, (None, None, None, None)),
])
def test_verdicts(spark, diff, want):
    df = spark.createDataFrame([(None if diff is None else 1 - diff / 100,)], "score double")
    r = visual.verdict(df).first()
    assert r.difference_percent == diff and (r.verdict, r.needs_review, r.diff_severity, r.ask_model) == want


def test_baselines(spark):
    rows = [(1, "t", "p", "https://h.com/a"), (2, "t", "p", "https://h.com/b"), (3, "t", "p", "https://h.com:81/a"), (4, "u", "p", "https://h.com/a")]
    c = visual.with_host(spark.createDataFrame(rows, "capture_id int, tenant_id string, project_id string, url string"))
    old = spark.createDataFrame([("u", "p", "h.com", 99)], "tenant_id string, project_id string, host string, baseline_id int")
    assert {r.capture_id for r in visual.new_baselines(c, old, ["capture_id"]).collect()} == {1, 3}
    found, first = visual.split_baseline(c, old, ["capture_id"])
    assert [(r.capture_id, r.baseline_id) for r in found.collect()] == [(4, 99)]
    assert {r.capture_id for r in first.collect()} == {1, 2, 3}
    key = c.select(visual.baseline_key(F.col("tenant_id"), F.col("project_id"), F.col("host")).alias("k"))
    assert "t/p/baselines/h.com:81.png" in {r.k for r in key.collect()}


def test_candidates(spark):
    df = spark.createDataFrame([(1, "k"), (2, ""), (3, None)], "run_id int, screenshot_s3_path string")
    assert [r.run_id for r in visual.visual_candidates(df).collect()] == [1]


def test_python_rounding(spark):
    import random

    from qaloom.functions.numbers import py_round

    rng = random.Random(5)
    xs = [2.675, 0.125, 0.375, 1.005, 0.005, 2.5, 99.995, 0.0, 4.995, 1.115, -0.125, -2.675, 5.000000000000004, 1.015, 8.345]
    xs += [rng.randint(0, 20000) / 200 for _ in range(300)] + [rng.uniform(0, 200) for _ in range(300)] + [rng.randint(-999, 99999) / 1000 for _ in range(300)]
    got = [r.r for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(py_round(F.col("x")).alias("r")).collect()]
    assert got == [round(x, 2) for x in xs]
    assert spark.createDataFrame([(None,)], "x double").select(py_round(F.col("x"))).first()[0] is None


def test_review_answers_and_unreadable_baselines(spark):
    d = spark.createDataFrame([(1, 1, "u", 0.9), (2, 1, "v", 0.999)], "run_id int, attempt int, page string, score double")
    ask = visual.visual_requests(visual.verdict(d)).collect()
    assert [(r.run_id, r.temperature, r.max_tokens) for r in ask] == [(1, 0.3, 100)] and "URL: u\nVisual Difference: 10.0%\n" in ask[0].prompt
    ans = spark.createDataFrame([(1, 1, "real_bug")], "run_id int, attempt int, answer string")
    assert {r.run_id: r.ai_analysis for r in visual.with_review(visual.verdict(d), ans).collect()} == {1: "real_bug", 2: None}
    c = spark.createDataFrame([(1, None), (2, "timeout")], "id int, baseline_error string")
    good, bad = visual.readable(c)
    assert [r.id for r in good.collect()] == [1] and [r.id for r in bad.collect()] == [2]
