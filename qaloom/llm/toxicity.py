"""Toxicity scores from a learned lexicon, matched with Levenshtein automata, and the context of what matches.

1. Lexicon. Words that labelled texts of class 1 hold far more often than others (documents counted, equal texts once): their odds
   are `LEAST_ODDS` or more, and a likelihood-ratio test lets about one word in by chance, however many words there are.
2. Matching. The terms form a trie. A word's Levenshtein automaton is walked along the trie, so one walk finds all terms within
   one edit (two for terms of `LONG` letters or more, none for terms under four); the automata of many words walk together, level
   by level. A word and a term that is near become the same string when each drops as many letters as there may be edits; these
   strings are compared by 64-bit hashes, and a walk leaves subtrees without a term that the word shares one with.
3. Context. Every match looks at `SPAN` words on either side. Quotation marks around the match and reporting words raise its
   quotation score, words of address lower it. Matches add their abuse share and their quotation share to separate features.
4. A logistic regression over these features gives the score.

The lexicon is counted over all labelled rows and has every word that passes, digits and inner signs included. The regression is
fitted on about `SAMPLE` labelled rows, those with the smallest hashes of their id; all texts are scored whole.

Defined results: null and empty texts score what a text without matches scores; without labelled rows of both classes the score
is the share of class 1 (0 without labels); null labels or ids are not learned from; several labels of one id count as their
rounded mean; an id with several texts enters the regression with one of them; repeated rows are scored one by one; an empty table gives no rows; other columns are neither read nor clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from qaloom.llm.common import chunks, fold, mix, powers, stored

SAMPLE = 20_000
LEAST_TEXTS = 5
LEAST_ODDS = 8.0
LONG = 8
SPAN = 6
THRESHOLD = 0.3
CACHE = 500_000
LETTERS = 61  # longest word whose automaton fits 64 bits
FRONT = 20_000  # words that are walked together
QUOTES = "\"'‘’“”«»„`"
REPORTING = frozenset("said says say called calls call wrote writes quoted quote quotes term word words phrase slur insult told claimed alleged dit disait sagte nannte dijo".split())
ADDRESS = frozenset("you your youre u ur yourself du dich dein tu te toi vous usted eres".split())
_EDGE = re.compile(r"^\W+|[\W_]+$")


def edits(term: str) -> int:
    return 2 if len(term) >= LONG else 1 if len(term) >= 4 else 0


def code_points(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """The lengths of the words and the places of those that have it."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        yield size, np.flatnonzero(sizes == size)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def drop_hashes(letters: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Hashes of words of one length and of all they become by dropping up to `limit` letters (2 at most), one array for each choice."""
    n, size = letters.shape
    values = mix(letters.astype(np.uint64) + np.uint64(_BASE)) * powers(_BASE, size)
    upto = np.zeros((size + 1, n), dtype=np.uint64)  # sums of the letters before each place
    np.cumsum(values.T, axis=0, out=upto[1:])
    whole = upto[size]
    yield whole
    once, twice = upto * _INVERSE, upto * _INVERSE * _INVERSE  # letters behind a dropped one move to the place before
    for i in range(size if limit else 0):
        first = upto[i] - once[i + 1]
        yield first + once[size]
        for j in range(i + 1, size if limit > 1 else 0):
            yield first + once[j] - twice[j + 1] + twice[size]


class Hashes:
    """64-bit hashes and a number for each; a table of bits keeps most others from being searched."""

    def __init__(self, values: np.ndarray, numbers: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.values, self.numbers = values[order], numbers[order]
        bits = max(10, int(16 * len(values)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[self.values * _SPREAD >> self.shift] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `values` and the numbers of equal hashes."""
        at = np.flatnonzero(self.table[values * _SPREAD >> self.shift])
        lo = np.searchsorted(self.values, values[at])
        at, lo = at[(same := self.values[np.minimum(lo, len(self.values) - 1)] == values[at])], lo[same]
        times = np.searchsorted(self.values, values[at], side="right") - lo
        return np.repeat(at, times), self.numbers[np.arange(times.sum()) + np.repeat(lo - (np.cumsum(times) - times), times)]


class Automaton:
    """The words within two edits of `word`. A state holds three sets of positions of the word as bits: those reached with no, at
    most one and at most two edits; a step moves all positions at once."""

    def __init__(self, word: str):
        self.end = 1 << len(word)
        self.all = 2 * self.end - 1
        self.places: dict[str, int] = {}
        for i, c in enumerate(word):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def start(self) -> tuple[int, int, int]:
        return 1, 3 & self.all, 7 & self.all

    def step(self, state: tuple[int, int, int], letter: str) -> tuple[int, int, int]:
        """Equal letters move on; an edit stays (the term has one letter more), moves on (another letter) or skips a letter of the word."""
        same = self.places.get(letter, 0)
        none, one, two = state
        x = (none & same) << 1
        y = ((one & same) << 1 | none | (none | x) << 1) & self.all
        return x, y, ((two & same) << 1 | one | (one | y) << 1) & self.all

    def accepts(self, state: tuple[int, int, int]) -> int | None:
        """Edits of a match that ends here."""
        return next((e for e, at in enumerate(state) if at & self.end), None)


class Lexicon:
    """The terms as a trie, and what tells most words at once that no term is near them."""

    def __init__(self, terms: dict[str, float]):
        self.weight = terms
        self.terms = sorted(terms)
        self.edits = np.array([edits(t) for t in self.terms], dtype=np.int64)
        self.size = np.array([len(t) for t in self.terms], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.trie: list[dict[str, int]] = [{}]
        about: list[list[int]] = [[0, 0, 0, -1]]  # letters, fewest and most, and edits of the terms below; the term that ends here
        path: list[int] = []  # the nodes of each term, term after term
        for rank, t in enumerate(self.terms):
            at, d = 0, edits(t)
            for c in t:
                if c not in self.trie[at]:
                    self.trie[at][c] = len(self.trie)
                    self.trie.append({})
                    about.append([len(t), len(t), d, -1])
                at = self.trie[at][c]
                least, most, limit, ends = about[at]
                about[at] = [min(least, len(t)), max(most, len(t)), max(limit, d), ends]
                path.append(at)
            about[at][3] = rank
        self.about, self.path = np.array(about, dtype=np.int64), np.array(path, dtype=np.int64)
        codes = np.array([ord(c) for t in self.terms for c in t], dtype=np.uint32)
        self.alphabet = np.unique(codes)
        self.letter = np.zeros(len(self.trie), dtype=np.int64)  # that leads to each node
        self.letter[self.path] = np.searchsorted(self.alphabet, codes)
        self.dropped: dict[int, Hashes] = {}  # what terms become by dropping letters, by their edits
        self.sizes: dict[int, set[int]] = {}
        for d in (1, 2):
            ranks = np.flatnonzero(self.edits == d)
            if len(ranks):
                of = [self.terms[i] for i in ranks.tolist()]
                hashes = [(h, ranks[at]) for _, at in by_length(of) for h in drop_hashes(code_points([of[i] for i in at.tolist()]), d)]
                self.dropped[d] = Hashes(np.concatenate([h for h, _ in hashes]), np.concatenate([r for _, r in hashes]))
                self.sizes[d] = {n for t in of for n in range(len(t) - d, len(t) + d + 1)}

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of words, in order, and terms (numbers) that may be within their edits; those that are, are among them: words d
        edits apart have a common string after dropping d letters each."""
        pairs = [np.zeros(0, dtype=np.int64)]
        for size, at in by_length(words):
            held = [d for d in (1, 2) if size and size in self.sizes.get(d, ())]
            codes = code_points([words[i] for i in at.tolist()]) if held else None
            for d in held:
                for h in drop_hashes(codes, d):
                    found, ranks = self.dropped[d].find(h)
                    if len(found):
                        pairs.append(at[found] * len(self.terms) + ranks)
        both = np.unique(np.concatenate(pairs))
        return np.divmod(both, max(1, len(self.terms)))

    def walk(self, words: list[str], word: np.ndarray, rank: np.ndarray) -> list[tuple[str, int] | None]:
        """The nearest terms of words of up to `LETTERS` letters, of the pairs (word, rank) in order. All automata go down the trie
        together, level by level; one leaves a subtree that has none of its terms, or when no position is left."""
        n, size = len(words), np.fromiter(map(len, words), np.int64, len(words))
        letters = np.zeros((n, len(self.alphabet) + 1), dtype=np.uint64)  # places of each letter of the alphabet in each word, as bits
        for length, rows in by_length(words):
            codes = code_points([words[i] for i in rows.tolist()])
            at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
            at = np.where(self.alphabet[at] == codes, at, len(self.alphabet))
            for i in range(length):
                letters[rows, at[:, i]] |= np.uint64(1 << i)
        one_bit = np.uint64(1)
        end = one_bit << size.astype(np.uint64)
        every = (end << one_bit) - one_bit
        none_found = 3 * len(self.terms)
        best = np.full(n, none_found, dtype=np.int64)
        at, depth = word, 0  # where each pair's state is; it starts at the root, one state for each word
        states = [np.full(n, 1, dtype=np.uint64), every & np.uint64(3), every & np.uint64(7)]
        while len(word):
            node = self.path[self.start[rank] + depth]
            new = np.append(True, (word[1:] != word[:-1]) | (node[1:] != node[:-1]))  # pairs on one way share a state
            first = np.flatnonzero(new)
            none, one, two = (s[at[first]] for s in states)
            same, all_of = letters[word[first], self.letter[node[first]]], every[word[first]]
            # equal letters move on; an edit stays (the term has one letter more), moves on (another letter) or skips a letter of the word
            x = (none & same) << one_bit
            y = ((one & same) << one_bit | none | (none | x) << one_bit) & all_of
            z = ((two & same) << one_bit | one | (one | y) << one_bit) & all_of
            states, at, depth = [x, y, z], np.cumsum(new) - 1, depth + 1
            ended = self.size[rank] == depth
            for e, state in enumerate(states):
                got = np.flatnonzero(ended & (state[at] & end[word] > 0) & (self.edits[rank] >= e))
                np.minimum.at(best, word[got], e * len(self.terms) + rank[got])
            on = np.flatnonzero(~ended & (z[at] > 0))
            word, rank, at = word[on], rank[on], at[on]
        return [None if b == none_found else (self.terms[b % len(self.terms)], b // len(self.terms)) for b in best.tolist()]

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term (ties: the first in the alphabet) and its number of edits."""
        return self.match_all([_EDGE.sub("", word)])[0]

    def match_all(self, words: list[str]) -> list[tuple[str, int] | None]:
        """`match` for words without signs at their ends."""
        out: list[tuple[str, int] | None] = [(w, 0) if w in self.weight else None for w in words]
        left = [i for i, found in enumerate(out) if found is None]
        word, rank = self.near([words[i] for i in left])
        near, word = np.unique(word, return_inverse=True)
        left = [left[i] for i in near.tolist()]
        short = np.array([len(words[i]) <= LETTERS for i in left], dtype=bool)
        for i in np.flatnonzero(~short).tolist():
            out[left[i]] = self.match_long(words[left[i]])
        rank, word = rank[short[word]], (np.cumsum(short) - 1)[word[short[word]]]
        left = [i for i, s in zip(left, short.tolist(), strict=True) if s]
        for lo in range(0, len(left), FRONT):
            a, z = np.searchsorted(word, [lo, lo + FRONT])
            for i, found in zip(left[lo : lo + FRONT], self.walk([words[i] for i in left[lo : lo + FRONT]], word[a:z] - lo, rank[a:z]), strict=True):
                out[i] = found
        return out

    def match_long(self, word: str) -> tuple[str, int] | None:
        """The nearest term of a word of any length, by an automaton of its own."""
        best: tuple[int, int] | None = None
        size, automaton = len(word), Automaton(word)
        todo = [(0, automaton.start())]
        while todo:
            at, state = todo.pop()
            for letter, child in self.trie[at].items():
                least, most, limit, rank = self.about[child].tolist()
                if least - limit <= size <= most + limit:
                    after = automaton.step(state, letter)
                    e = automaton.accepts(after) if rank >= 0 else None
                    if e is not None and e <= self.edits[rank] and (best is None or (e, rank) < best):
                        best = (e, rank)
                    if after[limit]:
                        todo.append((child, after))
        return (self.terms[best[1]], best[0]) if best else None


def bare_word(word: str) -> str:
    """The word without signs at its ends; letters and digits are no signs."""
    return word if word and word[0].isalnum() and word[-1].isalnum() else _EDGE.sub("", word)


class Matches(dict):
    """Matches of words, each looked up once, many at a time."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.signs = lexicon, Signs()

    def learn(self, words: set[str]) -> None:
        """Look up the words that are not known yet."""
        if len(self) > CACHE:
            self.clear()
        new = [w for w in words if w not in self]
        bare = [bare_word(w) for w in new]
        missing = list({b for b in bare if b not in self})
        self.update(zip(missing, self.lexicon.match_all(missing), strict=True))
        self.update((w, self[b]) for w, b in zip(new, bare, strict=True))


OPENS, CLOSES, REPORTS, ADDRESSES = 1, 2, 4, 8


class Signs(dict):
    """What a word says about the matches near it, each word looked up once."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        bare, end = bare_word(word), word.rstrip(".,;:!?")
        found = self[word] = (
            OPENS * (word[0] in QUOTES) | CLOSES * (end != "" and end[-1] in QUOTES) | REPORTS * (bare in REPORTING) | ADDRESSES * (bare in ADDRESS)
        )
        return found


def quotation(words: list[str], at: int, signs: Signs | None = None) -> float:
    """0 (abuse) to 1 (quotation): how far the words around a match speak of it rather than use it."""
    signs = Signs() if signs is None else signs
    before = after = signs[words[at]]
    for w in words[max(0, at - SPAN) : at]:
        before |= signs[w]
    for w in words[at + 1 : at + SPAN + 1]:
        after |= signs[w]
    value = 0.6 * bool(before & OPENS and after & CLOSES) + 0.3 * bool((before | after) & REPORTS) - 0.3 * bool((before | after) & ADDRESSES)
    return min(1.0, max(0.0, value))


FEATURES = 6


def features(words: list[str], matches: Matches) -> list[float]:
    hits = [i for i, found in enumerate(map(matches.__getitem__, words)) if found is not None]
    abuse = quoted = edited = weight = 0.0
    for i in hits:
        term, e = matches[words[i]]
        q = quotation(words, i, matches.signs)
        share = 1.0 if e == 0 else 0.0
        abuse += (1.0 - q) * share
        quoted += q
        edited += (1.0 - q) * (1.0 - share)
        weight += (1.0 - q) * matches.lexicon.weight[term] / (1 + e)
    return [np.log1p(abuse), float(abuse >= 1), np.log1p(edited), np.log1p(quoted), np.log1p(weight), np.log1p(1000 * (abuse + edited) / (len(words) + 50))]


def all_features(texts: list[str | None], matches: Matches) -> list[list[float]]:
    out = []
    for lo, hi in chunks([len(t or "") for t in texts]):
        words = [(t or "").lower().split() for t in texts[lo:hi]]
        matches.learn(set().union(*words))
        out += [features(w, matches) for w in words]
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression with an intercept, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        change = np.linalg.solve(hessian, gradient)
        w -= change
        if np.abs(change).max() < 1e-8:
            break
    return w


class Stripped(dict):
    """Words without signs at their ends, each looked up once."""

    def __missing__(self, word: str) -> str:
        if len(self) > CACHE:
            self.clear()
        found = self[word] = bare_word(word)
        return found


def learn_lexicon(texts: DataFrame, marks: DataFrame) -> dict[str, float]:
    """Terms and the logarithms of their odds from (t, text) and (t, y), t being a text's hash, once in `marks`; only words that pass
    the test are collected. No text is shuffled: each becomes its set of words, compressed, and copies shrink before they move."""

    def word_sets(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        stripped = Stripped()
        for b in batches:
            sets = [{stripped[w] for w in set((t or "").lower().split())} - {""} for t in b.column(1).to_pylist()]
            packs = [zlib.compress(" ".join(sorted(s)).encode("utf-8", "surrogatepass"), 1) for s in sets]
            yield pa.record_batch([b.column(0), pa.array(packs, pa.binary())], names=["t", "words"])

    def words(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        for b in batches:
            found: dict[str, list[int]] = {}
            for s, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in zlib.decompress(s).decode("utf-8", "surrogatepass").split(" "):
                    if w:
                        found.setdefault(w, [0, 0])[1 - y] += 1
            a, c = zip(*found.values(), strict=True) if found else ((), ())
            yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["word", "a", "b"])

    n1, n = (v or 0 for v in marks.agg(F.sum("y"), F.count(F.lit(1))).first())
    if not n1 or n1 == n:
        return {}
    odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n - n1 + 1.0))
    once = texts.mapInArrow(word_sets, "t long, words binary").groupBy("t").agg(F.first("words").alias("words")).join(marks, "t")
    counts = once.select("words", "y").mapInArrow(words, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = stored(counts.filter(F.col("a") >= LEAST_TEXTS), "toxic-words")
    a, b, m, m1 = F.col("a"), F.col("b"), F.col("a") + F.col("b"), float(n1) / n
    # twice the log-likelihood ratio of the word's own share of class 1 against that of all texts, and of the texts without the word
    rest_a, rest = n1 - a, n - m
    term = lambda k, of, share: F.when(k > 0, k * F.log(k / (of * share))).otherwise(0.0)
    ratio = 2 * (term(a, m, m1) + term(b, m, 1 - m1) + term(rest_a, rest, m1) + term(rest - rest_a, rest, 1 - m1))
    least = 2 * float(np.log(max(2, counts.count())))
    return {r["word"]: r["odds"] for r in counts.filter(ratio >= least).withColumn("odds", odds).filter(F.col("odds") >= float(np.log(LEAST_ODDS))).collect()}


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, folds: int, out_fold: int) -> DataFrame:
    """(text, y, rank) of all labelled documents outside the held-out fold; the rank is a hash of the id."""
    chosen = (
        labels.filter(F.col(label).isNotNull() & (fold(doc_id, folds) != out_fold))
        .groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.round(F.avg(label)).cast("long").alias("y"))
    )
    rows = docs.filter(fold(doc_id, folds) != out_fold).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.join(chosen, "id").select("text", "y", F.xxhash64("id").alias("rank"))


def described(lexicon: Lexicon):
    """A function over batches whose last column is text: it becomes its features, `x`."""

    def describe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matches = Matches(lexicon)
        for b in batches:
            x = pa.array(all_features(b.column(b.num_columns - 1).to_pylist(), matches), pa.list_(pa.float64()))
            yield pa.record_batch([*b.columns[:-1], x], names=[*b.schema.names[:-1], "x"])

    return describe


def weights_of(rows: DataFrame) -> np.ndarray:
    """The regression of (y, x), about `SAMPLE` rows of FEATURES numbers, or what gives the share of class 1 where there is one class."""
    got = rows.select("y", "x").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, FEATURES)
    y = np.array(got.column("y").to_pylist(), dtype=np.float64)
    if len(set(y.tolist())) < 2:
        share = y.mean() if len(y) else 0.0
        return np.array([0.0] * FEATURES + [np.inf if share else -np.inf])
    return fit_logistic(x, y)


def train_model(train: DataFrame, sample: int = SAMPLE) -> tuple[Lexicon, np.ndarray]:
    """The lexicon of all rows of (text, y, rank) and the regression of those with the `sample` smallest ranks."""
    train = stored(train, "labelled")
    texts = train.select(F.xxhash64("text").alias("t"), "text")
    marks = stored(train.groupBy(F.xxhash64("text").alias("t")).agg(F.max("y").alias("y")), "marks")
    lexicon = Lexicon(learn_lexicon(texts, marks))
    last = train.select("rank").orderBy("rank").limit(sample).agg(F.max("rank")).first()[0]
    some = train.filter(F.col("rank") <= F.lit(last)).select("y", "text")
    return lexicon, weights_of(some.mapInArrow(described(lexicon), "y long, x array<double>"))


def train_on(
    docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, folds: int, out_fold: int, sample: int = SAMPLE
) -> tuple[Lexicon, np.ndarray]:
    """What `train_model` learns from `labelled`, where labels are a table of their own and texts stay where they are.

    Labels meet the ids and text hashes of documents only. The regression takes the `sample` ids with the smallest hashes, one text of
    each, so the list that is broadcast has at most `sample` rows of numbers.
    """
    kept = fold(doc_id, folds) != out_fold
    chosen = (
        labels.filter(F.col(label).isNotNull() & kept)
        .groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.round(F.avg(label)).cast("long").alias("y"))
    )
    rows = docs.filter(kept).select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    keys = stored(rows.select("id", "t"), "text-keys")
    known = stored(keys.distinct().join(chosen, "id"), "labelled-keys")
    marks = stored(known.groupBy("t").agg(F.max("y").alias("y")), "marks")
    lexicon = Lexicon(learn_lexicon(rows.select("t", "text"), marks))
    some = known.groupBy("id").agg(F.min("t").alias("t"), F.first("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    near = rows.join(F.broadcast(stored(some, "sample-keys")), ["id", "t"]).select("id", "y", "text")
    return lexicon, weights_of(near.mapInArrow(described(lexicon), "id long, y long, x array<double>").dropDuplicates(["id"]))


def score(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray, text: str = "text", keep: list | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """`keep` columns with `score` and `predicted` for every row of `docs`."""
    rows = docs.select(*(keep or [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]), F.col(text).alias("__text"))

    def rate(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matches = Matches(lexicon)
        for b in batches:
            x = np.array(all_features(b.column(b.num_columns - 1).to_pylist(), matches), dtype=np.float64).reshape(-1, FEATURES)
            z = x @ weights[:-1] + weights[-1]
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-z))
            yield pa.record_batch([*b.columns[:-1], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*b.schema.names[:-1], "score", "predicted"])

    schema = rows.drop("__text").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return rows.mapInArrow(rate, schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned outside fold 2 of 4."""
    from qaloom.session import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon, weights = train_on(docs, labels, "doc_id", "text", "toxic", 4, 2)
    return score(docs, lexicon, weights, keep=[F.col("doc_id"), F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")])


QUERIES = {"op7_toxicity": op7_toxicity}
