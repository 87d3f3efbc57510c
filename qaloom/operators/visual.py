"""Screenshots: candidates, baselines, structural similarity, verdicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from qaloom.functions import templates as t
from qaloom.functions.images import resized_gray, ssim_score
from qaloom.functions.numbers import py_round
from qaloom.functions.text import blank, host_key, key_path, render
from qaloom.operators.skew import first_n, lookup_join

BASELINE_KEY = ["tenant_id", "project_id", "host"]


def visual_candidates(results: DataFrame) -> DataFrame:
    return results.filter(~blank(F.col("screenshot_s3_path")))


def baseline_key(tenant: Column, project: Column, host: Column) -> Column:
    return key_path(tenant, project, "baselines", F.concat(host, F.lit(".png")))


def with_host(captures: DataFrame, url: str = "url") -> DataFrame:
    """Baselines are per host: pages of one host share one."""
    return captures.withColumn("host", host_key(F.col(url)))


def first_baselines(captures: DataFrame, order: list[str], key: list[str] | None = None) -> DataFrame:
    """The first capture per key. Narrow columns should come in; images join later by capture id."""
    return first_n(captures, key or BASELINE_KEY, order)


def new_baselines(captures: DataFrame, existing: DataFrame, order: list[str], key: list[str] | None = None) -> DataFrame:
    """First captures for keys that have no baseline yet; existing baselines are never replaced. The first capture
    per key is taken before the anti join, so the join is one row per key on both sides."""
    key = key or BASELINE_KEY
    return first_baselines(captures, order, key).join(existing.select(*key), key, "left_anti")


def readable(captures: DataFrame, error: str = "baseline_error") -> tuple[DataFrame, DataFrame]:
    """(usable, rejects): where the baseline store failed other than by 'not found' nothing is compared or saved."""
    return captures.filter(F.col(error).isNull()), captures.filter(F.col(error).isNotNull())


def split_baseline(
    captures: DataFrame, baselines: DataFrame, row_id: list[str], key: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(to compare, first runs). baselines: key columns and baseline_id, one row per key. Captures of a hot host
    are spread over several tasks."""
    key = key or BASELINE_KEY
    joined = lookup_join(captures, baselines.select(*key, "baseline_id"), key, row_id)
    return joined.filter("baseline_id is not null"), joined.filter("baseline_id is null").drop("baseline_id")


# --- structural similarity ---------------------------------------------------------------------------------------


def ssim_images(pairs: DataFrame, win: int = 7, data_range: float = 255.0) -> DataFrame:
    """Score whole images. pairs: image_id, cur and ref, each struct<h int, w int, channels int, px array<int> or
    binary> (row-major; channels 3 is blue-green-red, 1 is gray). The current image is resized to the reference when
    shapes differ; images under `win` pixels get null. One pair is one row; Spark limits Arrow batches by bytes as well as
    rows, so big screenshots come a few at a time."""

    @F.pandas_udf("double")
    def score(cur: pd.DataFrame, ref: pd.DataFrame) -> pd.Series:
        out = []
        for c, r in zip(cur.itertuples(index=False), ref.itertuples(index=False)):
            a, b = resized_gray(c.px, c.h, c.w, c.channels, r.h, r.w), resized_gray(r.px, r.h, r.w, r.channels, r.h, r.w)
            out.append(ssim_score(a, b, win, data_range))
        return pd.Series(out, dtype="float64")

    return pairs.withColumn("score", score("cur", "ref"))


def gray_pixels(images: DataFrame, h: int, w: int) -> DataFrame:
    """Gray images resized to h x w as rows: image_id, y, x, v. images: image_id, img (struct as above)."""

    @F.pandas_udf("array<int>")
    def convert(img: pd.DataFrame) -> pd.Series:
        return pd.Series(
            [resized_gray(i.px, i.h, i.w, i.channels, h, w).astype(np.int32).ravel() for i in img.itertuples(index=False)]
        )

    return (
        images.select("image_id", F.posexplode(convert("img")).alias("i", "v"))
        .select("image_id", F.expr(f"i div {w}").cast("int").alias("y"), (F.col("i") % w).cast("int").alias("x"), "v")
    )


def ssim_pixels(pixels: DataFrame, win: int = 7, data_range: float = 255.0) -> DataFrame:
    """The same score from a pixel table (image_id, y, x, p, q) by two passes of window sums, rows then columns.

    Partitions are single image rows and columns, so no task sees more than one line of an image at a time. Use
    `ssim_images` for big screenshots; this form fits pixel data that already is a table.
    """
    half = win // 2
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    n = float(win * win)
    cov = n / (n - 1.0)
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    terms = {"sp": p, "sq": q, "spp": p * p, "sqq": q * q, "spq": p * q}
    along_x = W.partitionBy("image_id", "y").orderBy("x").rowsBetween(-half, half)
    along_y = W.partitionBy("image_id", "x").orderBy("y").rowsBetween(-half, half)
    all_x, all_y = W.partitionBy("image_id", "y"), W.partitionBy("image_id", "x")
    rows = pixels.select(
        "image_id", "y", "x", F.max("x").over(all_x).alias("mx"),
        *[F.sum(e).over(along_x).alias(k) for k, e in terms.items()],
    ).filter((F.col("x") >= half) & (F.col("x") <= F.col("mx") - half))
    boxes = rows.select(
        "image_id", "y", F.max("y").over(all_y).alias("my"),
        *[(F.sum(k).over(along_y) / n).alias(k) for k in terms],
    ).filter((F.col("y") >= half) & (F.col("y") <= F.col("my") - half))
    ux, uy = F.col("sp"), F.col("sq")
    vx, vy, vxy = cov * (F.col("spp") - ux * ux), cov * (F.col("sqq") - uy * uy), cov * (F.col("spq") - ux * uy)
    s = ((2 * ux * uy + c1) * (2 * vxy + c2)) / ((ux * ux + uy * uy + c1) * (vx + vy + c2))
    return boxes.groupBy("image_id").agg(F.avg(s).alias("score"))


# --- verdicts ----------------------------------------------------------------------------------------------------

# fixed values: limits in percent
NO_CHANGE_BELOW = 1.0
MINOR_BELOW = 5.0
ASK_ABOVE = 2.0


def difference_percent(score: Column) -> Column:
    return py_round((F.lit(1.0) - score) * 100, 2)


def verdict(diffs: DataFrame, score: str = "score") -> DataFrame:
    """Add difference_percent, verdict, needs_review, diff_severity and ask_model; all null where nothing was compared."""
    d = F.col("difference_percent")
    return diffs.withColumn("difference_percent", difference_percent(F.col(score))).withColumns({
        "verdict": F.when(d < NO_CHANGE_BELOW, "no_change").when(d < MINOR_BELOW, "minor_change")
        .when(d.isNotNull(), "significant_change"),
        "needs_review": d >= NO_CHANGE_BELOW,
        "diff_severity": F.when(d < MINOR_BELOW, "info").when(d.isNotNull(), "warning"),
        "ask_model": (d >= NO_CHANGE_BELOW) & (d > ASK_ABOVE),
    })


REVIEW_TEMPERATURE = 0.3
REVIEW_MAX_TOKENS = 100


def visual_requests(diffs: DataFrame) -> DataFrame:
    """Requests for an external reviewer, for differences above the limit. diffs: page, difference_percent, ask_model."""
    prompt = render(t.VISUAL_PROMPT, page_url=F.col("page"), difference_percent=F.col("difference_percent"))
    return diffs.filter("ask_model").withColumns({
        "prompt": prompt, "temperature": F.lit(REVIEW_TEMPERATURE), "max_tokens": F.lit(REVIEW_MAX_TOKENS),
    })


def with_review(diffs: DataFrame, answers: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Join the reviewer's answers as ai_analysis; diffs that were not asked about, or whose call failed, keep null."""
    key = key or ["run_id", "attempt"]
    found = diffs.join(answers.select(*key, F.col("answer").alias("ai_analysis")), key, "left")
    return found.withColumn("ai_analysis", F.when(F.col("ask_model"), F.col("ai_analysis"))) if "ask_model" in diffs.columns else found
