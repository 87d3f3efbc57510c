"""Language identification by rank-order profiles (out-of-place distance between ranked n-gram lists).

A profile is a language's `PROFILE` most frequent letter n-grams (1 to 3 characters, words padded with one blank, case
folded), in order. A text is ranked the same way; for each of its grams the distance to a language is the difference of
ranks, or `PROFILE` where the language lacks the gram. The language of the least sum wins, ties go to the smaller name.

Defined results: a text that is null or has no letter is `und` with score 0; with no training rows every text is `und`;
null languages are not learned; repeated rows count as often as they occur; ties of counts go to the smaller gram; other
columns of the input are neither read nor clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from qaloom.llm.common import chunks, giving_back

PROFILE = 400
CHUNK = 500_000  # characters whose grams are counted at once
UNDETERMINED = "und"
_BLANK = 32


def gram_counts(texts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, gram, count), sorted by owner; texts with the same owner are counted together. A gram is up to three
    code points in 63 bits."""
    low = [t.lower() for t in texts]
    joined = " " + " ".join(low) + " "
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    present = np.flatnonzero(np.bincount(cp))
    letters = np.array([c for c in present if chr(c).isalpha()], dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    if not len(letters):
        return none, none, none
    ids = np.zeros(present[-1] + 1, dtype=np.int64)
    ids[letters] = np.arange(1, len(letters) + 1)
    x = ids[cp]
    whose = np.repeat(owner, np.fromiter((len(t) + 1 for t in low), dtype=np.int64, count=len(low)))
    whose = np.concatenate([owner[:1], whose])
    keep = x > 0
    keep[1:] |= x[:-1] > 0  # one break after each word
    keep[0] = True
    x, whose = x[keep], whose[keep]
    size = len(letters) + 1
    total = size + size**2 + size**3
    is_letter = x > 0
    one = whose[is_letter] * total + x[is_letter]
    two = np.where(is_letter[:-1], whose[:-1], whose[1:]) * total + size + x[:-1] * size + x[1:]
    two = two[is_letter[:-1] | is_letter[1:]]
    middle = is_letter[1:-1]
    three = (whose[1:-1] * total + size + size**2 + (x[:-2] * size + x[1:-1]) * size + x[2:])[middle]
    keys, counts = np.unique(np.concatenate([one, two, three]), return_counts=True)
    who, rest = keys // total, keys % total
    chars = np.concatenate([[_BLANK], letters])
    gram = np.where(
        rest < size,
        chars[rest % size],
        np.where(
            rest < size + size**2,
            (chars[(rest - size) // size % size] << 21) | chars[(rest - size) % size],
            (chars[(rest - size - size**2) // size**2 % size] << 42)
            | (chars[(rest - size - size**2) // size % size] << 21)
            | chars[(rest - size - size**2) % size],
        ),
    )
    order = np.lexsort((gram, who))
    return who[order], gram[order], counts[order]


def ranked(who: np.ndarray, count: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of each owner's `top` most frequent grams and their ranks from 0 (ties keep the order given)."""
    order = np.lexsort((-count, who))
    starts = np.flatnonzero(np.diff(who, prepend=-1))
    rank = np.arange(len(who)) - np.repeat(starts, np.diff(np.append(starts, len(who))))
    keep = rank < top
    return order[keep], rank[keep]


def learn_profiles(train: DataFrame, lang: str = "lang", text: str = "text", top: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): each language's most frequent grams over all rows of `train`.

    Tasks count their own rows first, so the shuffle carries distinct grams per task and not texts.
    """

    @giving_back
    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names: list[str] = []
        index: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            who, gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((gram, who))
            who, gram, n = who[order], gram[order], n[order]
            new = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(gram, prepend=-1) != 0))
            return who[new], gram[new], np.add.reduceat(n, new) if len(new) else n

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for x in langs:
                if x not in index:
                    index[x] = len(names)
                    names.append(x)
            whose = np.fromiter((index[x] for x in langs), dtype=np.int64, count=len(langs))
            for lo, hi in chunks([len(t) for t in texts], CHUNK):
                held.append(gram_counts(texts[lo:hi], whose[lo:hi]))
                if sum(len(h[0]) for h in held) > 1_000_000:
                    held[:] = [merged()]
        if held:
            who, gram, n = merged()
            for lo in range(0, len(who), 50_000):
                part = slice(lo, lo + 50_000)
                yield pa.record_batch([pa.array([names[i] for i in who[part]], pa.string()), pa.array(gram[part]), pa.array(n[part])], names=["lang", "gram", "n"])

    rows = train.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank - 1).filter(F.col("rank") < top).select("lang", "gram", "rank")


class Profiles:
    """Profiles as a table of ranks: one row for each known gram, one column for each language.

    Holds at most languages x `top` numbers; `learn_profiles` has cut every language to `top` grams.
    """

    def __init__(self, rows: list[tuple[str, int, int]], top: int = PROFILE):
        self.top = top
        self.names = sorted({r[0] for r in rows})
        column = {n: i for i, n in enumerate(self.names)}
        self.grams = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, dtype=np.int64)
        for name, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), column[name]] = rank

    def classify(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names = [UNDETERMINED] * len(texts)
        score = np.zeros(len(texts))
        who, gram, count = gram_counts(texts, np.arange(len(texts)))
        if not len(who) or not self.names:
            return names, score
        at, rank = ranked(who, count, self.top)
        who, gram = who[at], gram[at]
        found = np.searchsorted(self.grams, gram)
        found[(found == len(self.grams)) | (self.grams[np.minimum(found, len(self.grams) - 1)] != gram)] = len(self.grams)
        known = self.ranks[found]
        apart = np.where(known < 0, self.top, np.abs(known - rank[:, None]))
        starts = np.flatnonzero(np.diff(who, prepend=-1))
        total = np.add.reduceat(apart, starts, axis=0)
        size = np.diff(np.append(starts, len(who)))
        best = np.argmin(total, axis=1)
        near = 1.0 - total[np.arange(len(best)), best] / (size * self.top)
        for i, b, s in zip(who[starts], best, near, strict=True):
            names[i], score[i] = self.names[b], s
        return names, score


def identify(docs: DataFrame, profiles: DataFrame, text: str = "text", keep: dict[str, Column] | None = None, top: int = PROFILE) -> DataFrame:
    """`keep` columns with `lang_pred` and `score` (1 - distance / largest distance) for every row of `docs`."""
    model = Profiles([tuple(r) for r in profiles.select("lang", "gram", "rank").collect()], top)
    keep = keep or {c: F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")}
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("__text"))

    @giving_back
    def classify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            names, scores = [], []
            for lo, hi in chunks([len(t) for t in texts], CHUNK):
                n, s = model.classify(texts[lo:hi])
                names += n
                scores.append(s)
            columns = batch.columns[:-1] + [pa.array(names, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))]
            yield pa.record_batch(columns, names=batch.schema.names[:-1] + ["lang_pred", "score"])

    schema = rows.drop("__text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return rows.mapInArrow(classify, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned on the folds other than 2 of 4."""
    from qaloom.llm.common import fold
    from qaloom.session import table

    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.filter(fold("doc_id", 4) != 2))
    return identify(docs, profiles, keep={"doc_id": F.col("doc_id"), "held_out": fold("doc_id", 4) == 2})


QUERIES = {"op4_language_id": op4_language_id}
