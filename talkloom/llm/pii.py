"""Operator 3: personal data by candidate generation and gradient boosting.

Fixed patterns with checks (the base) always count. Beyond them, generators of
high recall propose overlapping spans: addresses and numbers in other spellings.
Boosted trees score each candidate by its format and its context, thresholds
calibrated on held-out rows decide, and of overlapping winners the best stays.

No table labels personal data, so the corpus teaches itself: base spans of all
documents are spelt in other ways where they stand, which gives right candidates in
real contexts; numbers and words of the same documents, and spans whose checks were
broken, give wrong ones. Equal ones are counted in Spark, and weigh as often.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import stored, tidy

#: The kinds, in the order of results.
KINDS = ("email", "ip", "card", "phone")
#: Words before candidates are told apart by a hash with so many values, and scores
#: for the thresholds in so many steps: what is counted over all then stays small.
CUES, STEPS = 1 << 16, 10_000
#: Precision on held-out rows that a kind's threshold must reach.
PRECISION = 0.95
#: Boosted trees and their depth.
ROUNDS, DEPTH = 15, 5
#: Rows handled together in a task.
ROWS_AT_ONCE = 256
SEED = 11


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    base: bool
    score: float


# --- the base -----------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run is taken whole, so that a long one is read once
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a digit string holds."""
    odd = [int(c) for c in digits[-1::-2]]
    even = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def _emails(text: str):
    """Leftmost matches of local part, @ and dotted domain, in linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """The fixed patterns with their checks, by kind and then start."""
    out = [Span("email", a, b, True, 1.0) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append(Span("ip", *m.span(), True, 1.0))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(Span("card", *m.span(), True, 1.0))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(Span("phone", *m.span(), True, 1.0))
    return out


# --- candidates -----------------------------------------------------------------

#: Other spellings of @ and of the dot in a domain.
_AT = re.compile(r"[\x20]?[\[({][\x20]?at[\x20]?[\])}][\x20]?|(?<!\s)\x20at\x20(?!\s)", re.I)
_SPELT_DOMAIN = re.compile(r"[a-z0-9-]++(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)[a-z0-9-]++)+", re.I)
_HEX = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])")
#: Marks that may stand between the digit groups of one number, three at most, and
#: groups that one number may have.
_BETWEEN, _MARKS, _GROUPS = " ./()[]-", 3, 8
_BEFORE = re.compile(r"([^\W\d_]+)[\W_]*$")
FEATURES = ("kind", "chars", "digits", "letters", "groups", "first", "last", "longest", "luhn", "bytes", "zero", "plus", "spaces", "dots", "dashes", "slashes", "parens", "brackets", "colons", "run_before", "run_after", "letter_before", "letter_after")


class Candidates(NamedTuple):
    """kind, start and end, and the features, of proposals beyond the base."""

    spans: np.ndarray
    features: np.ndarray

    def take(self, rows: np.ndarray) -> Candidates:
        return Candidates(self.spans[rows], self.features[rows])


def _words(text: str) -> list[tuple[int, int, int]]:
    """Spelt addresses and long hexadecimal ones."""
    out, free = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _SPELT_DOMAIN.match(text, m.end()) if start < m.start() else None
        free = m.end()
        if found:
            out.append((0, start, found.end()))
    return out + [(1, *m.span()) for m in _HEX.finditer(text)] if ":" in text else out


def _described(text: str, kind: int, start: int, end: int) -> list[float]:
    inner = text[start:end]
    n = Counter(inner)
    parts = [len(p) for p in re.split(r"[^0-9A-Za-z]+", inner) if p] or [0]
    digits = sum(n[c] for c in "0123456789")
    letter = lambda k: float(0 <= k < len(text) and text[k].isalpha())
    return [kind, len(inner), digits, sum(c.isalpha() for c in inner), len(parts), parts[0], parts[-1], max(parts), 0, 0, inner[0] == "0", 0, n[" "], n["."], n["-"], n["/"], n["("] + n[")"], n["["] + n["]"] + n["{"], n[":"], 0, 0, letter(start - 1), letter(end)]


def _numbers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Windows of successive digit groups that may be a card, a phone number or an
    address: every one that has a fitting number of digits, in linear time."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(code)
    digit = (code >= 48) & (code <= 57)
    padded = np.concatenate([[False], digit, [False]])
    starts, ends = np.flatnonzero(digit & ~padded[:-2]), np.flatnonzero(digit & ~padded[2:]) + 1
    size, g = ends - starts, len(starts)
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    marks = {c: upto(code == ord(c)) for c in _BETWEEN}
    other = upto(~(digit | np.isin(code, [ord(c) for c in _BETWEEN])))
    linked = (starts[1:] - ends[:-1] <= _MARKS) & (other[starts[1:]] == other[ends[:-1]])
    chain = upto(~linked)
    first = upto(size)
    d = code[digit].astype(np.int64) - 48
    twice, even = np.where(d > 4, 2 * d - 9, 2 * d), np.arange(len(d)) % 2 == 0
    sums = (upto(np.where(even, d, twice)), upto(np.where(even, twice, d)))
    short = np.where(size <= 3, 0, 1)
    small = size <= 3
    value = np.full(g, 999)
    value[small] = [int(text[a:b]) for a, b in zip(starts[small].tolist(), ends[small].tolist(), strict=True)]
    is_alpha = lambda k: np.array([0 <= x < n and text[x].isalpha() for x in k.tolist()], float)
    spans, rows = [], []
    for w in range(1, min(_GROUPS, g) + 1):
        i = np.flatnonzero(chain[w - 1 :] == chain[: g - w + 1])
        j = i + w - 1
        total = first[j + 1] - first[i]
        kinds = [(2, (total >= 13) & (total <= 19)), (3, (total >= 8) & (total <= 15))]
        if w == 4:
            kinds.append((1, upto(short)[j + 1] == upto(short)[i]))
        for kind, good in kinds:
            a, b = i[good], j[good]
            if not len(a):
                continue
            start, end = starts[a], ends[b]
            opened = (start > 0) & (code[np.maximum(start - 1, 0)] == ord("("))
            start = start - opened
            right = np.where((first[b + 1] - 1) % 2 == 0, sums[0][first[b + 1]] - sums[0][first[a]], sums[1][first[b + 1]] - sums[1][first[a]])
            windows = np.stack([size[a + k] for k in range(w)])
            inside = lambda c: marks[c][end] - marks[c][start]  # noqa: B023, E731
            before = np.maximum(start - 1, 0)
            columns = [
                np.full(len(a), kind), end - start, total[good], np.zeros(len(a)), np.full(len(a), w), size[a], size[b], windows.max(0), right % 10 == 0,
                np.stack([value[a + k] for k in range(w)]).max(0) <= 255, code[starts[a]] == 48, (start > 0) & (code[before] == ord("+")),
                inside(" "), inside("."), inside("-"), inside("/"), inside("(") + inside(")"), inside("[") + inside("]"), np.zeros(len(a)),
                np.concatenate([[False], linked])[a], np.concatenate([linked, [False]])[b], is_alpha(start - 1), is_alpha(end),
            ]
            spans.append(np.stack([np.full(len(a), kind), start, end], 1))
            rows.append(np.stack(columns, 1).astype(float))
    return (np.concatenate(spans), np.concatenate(rows)) if spans else _NONE


_NONE = np.zeros((0, 3), np.int64), np.zeros((0, len(FEATURES)))


def candidates(text: str) -> Candidates:
    """Overlapping proposals beyond the base."""
    spans, rows = _numbers(text) if _DIGIT.search(text) else _NONE
    if spelt := _words(text):
        spans = np.concatenate([spans, np.array(spelt)])
        rows = np.concatenate([rows, np.array([_described(text, *s) for s in spelt], float)])
    return Candidates(spans, rows)


def word_before(text: str, start: int) -> str:
    """The word before a span, lower case; empty if none is near."""
    found = _BEFORE.search(text, max(0, start - 24), start)
    return found[1].lower() if found else ""


class Stretches:
    """Disjoint stretches of a text; whether a span touches one."""

    def __init__(self, spans: list[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a), self.ends.append(b)

    def touch(self, a: int, b: int) -> bool:
        k = bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a), self.ends.insert(k, b)

    def free_of(self, spans: np.ndarray) -> np.ndarray:
        """Which rows (kind, start, end) touch none."""
        k = np.searchsorted(self.ends, spans[:, 1], "right")
        return np.append(self.starts, np.iinfo(np.int64).max)[k] >= spans[:, 2]


def _best(found: Candidates, score: np.ndarray, rows: np.ndarray) -> list[int]:
    """Of these candidates, those that overlap no better one."""
    taken, out = Stretches(), []
    for k in rows[np.lexsort((-found.spans[rows, 2], found.spans[rows, 1], -score[rows]))].tolist():
        _, a, b = found.spans[k].tolist()
        if not taken.touch(a, b):
            taken.add(a, b)
            out.append(k)
    return out


# --- training -------------------------------------------------------------------


def _spellings(kind: str, text: str) -> list[str]:
    """A base span in other spellings."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "email":
        local, domain = text.split("@")
        return [local + at + domain.replace(".", dot) for at, dot in [(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" (at) ", ".")]]
    if kind == "ip":
        return [mark.join(text.split(".")) for mark in ["[.]", " . ", "(.)", "-"]]
    if kind == "card":
        return [mark.join(digits[k : k + 4] for k in range(0, len(digits), 4)) for mark in [".", "/", " - "]]
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00 {digits[:-10]} {a} {b} {c}", f"({a}) {b} {c}"]


def _respelt(kind: str, text: str, rng: random.Random) -> str:
    """A base span in another spelling."""
    return rng.choice(_spellings(kind, text))


def _broken(kind: str, text: str, rng: random.Random) -> str:
    """Something in the form of a respelt span that is none."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        return rng.choice([" at ", " at the "]).join(text.split("@")[0] for _ in range(2))
    if kind == "ip":
        parts = text.split(".")
        parts[rng.randrange(4)] = str(rng.randint(256, 999))
        return _respelt("ip", ".".join(parts), rng)
    digits = re.sub("[^0-9]", "", text)
    if kind == "card":
        at = rng.randrange(len(digits))
        return _respelt("card", digits[:at] + str((int(digits[at]) + rng.randint(1, 9)) % 10) + digits[at + 1 :], rng)
    year, month, day = f"20{d(2)}", f"{rng.randint(1, 12):02d}", f"{rng.randint(1, 28):02d}"
    return rng.choice([f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{d(5)} {d(5)}", f"{d(2)}-{d(6)}-{d(2)}", f"{day}/{month}/{year} {d(2)}", f"{d(4)}-{d(4)}", f"{d(1)}.{d(3)}.{d(3)}.{d(3)}"])


def _items(text: str, seed: int):
    """(text, candidates in it, which are right): for each base span in all spellings and
    broken, where it stands; last, all else that the text holds."""
    rng = random.Random(seed)
    base = base_spans(text)
    for s in base:
        left, right = text[max(0, s.start - 80) : s.start], text[s.end : s.end + 40]
        spelt = _spellings(s.kind, text[s.start : s.end])
        # a broken one for every two right ones
        for item, good in [*((item, True) for item in spelt), *((_broken(s.kind, text[s.start : s.end], rng), False) for _ in spelt[::2])]:
            made, a, b = left + item + right, len(left), len(left) + len(item)
            found = candidates(made)
            found = found.take(Stretches([(x.start, x.end) for x in base_spans(made)]).free_of(found.spans))
            found = found.take((found.spans[:, 1] < b) & (found.spans[:, 2] > a))
            yield made, found, good & (found.spans == [KINDS.index(s.kind), a, b]).all(1)
    found = candidates(text)
    found = found.take(Stretches([(x.start, x.end) for x in base]).free_of(found.spans))
    yield text, found, np.zeros(len(found.spans), bool)


def _words_before(text: str, found: Candidates) -> list[str]:
    starts, at = np.unique(found.spans[:, 1], return_inverse=True)
    words = [word_before(text, a) for a in starts.tolist()]
    return [words[k] for k in at]


def training_rows(text: str, seed: int) -> list[tuple[bool, str, list[float]]]:
    """(right, word before, features) of all candidates of _items()."""
    return [row for made, found, right in _items(text, seed) for row in zip(right.tolist(), _words_before(made, found), found.features.tolist(), strict=True)]


def _cue(word: str) -> int:
    """The number of a word before; -1 if there is none."""
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % CUES if word else -1


class Model(NamedTuple):
    """Boosted trees as arrays (tree x node; feature -1 at leaves), their weights,
    what a word before speaks for a kind, and the score a kind is accepted from."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weights: np.ndarray
    cues: dict[tuple[int, int], float]
    accept: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        tree, rows = np.arange(len(self.weights))[None, :], np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.weights)), np.int64)
        for _ in range(DEPTH):
            f = self.feature[tree, at]
            lower = x[rows, np.maximum(f, 0)] <= self.threshold[tree, at]
            at = np.where(f < 0, at, np.where(lower, self.left[tree, at], self.right[tree, at]))
        return 1 / (1 + np.exp(-2 * (self.value[tree, at] @ self.weights)))

    def with_cues(self, features: np.ndarray, words: list[str]) -> np.ndarray:
        cue = [self.cues.get((int(k), _cue(w)), 0.0) for k, w in zip(features[:, 0], words, strict=True)]
        return np.hstack([features, np.array(cue, float).reshape(-1, 1)])


#: Accepts nothing: what a corpus without base spans teaches.
NOTHING = Model(np.full((1, 1), -1), np.zeros((1, 1)), np.zeros((1, 1), int), np.zeros((1, 1), int), np.zeros((1, 1)), np.ones(1), {}, (2.0,) * len(KINDS))


def _cues(train: DataFrame) -> dict[tuple[int, int], float]:
    """Log-odds of a word before right candidates of a kind, against wrong ones."""
    rows = train.groupBy(F.col("features")[0].alias("kind"), "cue", "right").agg(F.sum("n").alias("n")).collect()
    seen, n = Counter(), Counter()
    for r in rows:  # at most 8 * (CUES + 1)
        n[r["kind"], r["right"]] += r["n"]
        if r["cue"] >= 0:
            seen[r["kind"], r["cue"], r["right"]] = r["n"]
    odds = lambda k, w, y: np.log((seen[k, w, y] + 1.0) / (n[k, y] + 20.0))
    return {(k, w): float(odds(k, w, True) - odds(k, w, False)) for k, w in {(k, w) for k, w, _ in seen} if seen[k, w, True] + seen[k, w, False] >= 5}


def accepted_from(scores: np.ndarray, right: np.ndarray, precision: float = PRECISION, each: np.ndarray | None = None) -> float:
    """The least score from which candidates reach the precision, ties all in; 2
    where none does. `each`: how many candidates a score stands for, of which `right`
    are right."""
    levels, at = np.unique(-scores, return_inverse=True)
    n, good = np.cumsum(np.bincount(at, weights=each)), np.cumsum(np.bincount(at, weights=right))
    fine = np.flatnonzero((good >= precision * n) & (-levels >= 0.5))
    return float(-levels[fine[-1]]) if len(fine) else 2.0


def hashed(documents: DataFrame, text: str = "text") -> DataFrame:
    """`text` of the documents that have a digit or an @, and h, its hash."""
    return documents.select(F.col(text).cast("string").alias("text")).where(F.col("text").rlike(r"[0-9@]")).withColumn("h", F.xxhash64(F.lit(SEED), "text"))


def _slices(batches):
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(lo, ROWS_AT_ONCE)
            yield list(zip(batch.column("text").to_pylist(), batch.column("h").to_pylist(), strict=True))


def training_table(texts: DataFrame) -> DataFrame:
    """right, cue, features and n: how many candidates of all hashed() texts are so. Of
    equal texts one counts."""
    schema = pa.schema([("h", pa.int64()), ("k", pa.int32()), ("right", pa.bool_()), ("cue", pa.int32()), ("features", pa.list_(pa.int32()))])

    def run(batches):
        for rows in _slices(batches):
            made = [(h, k, right, _cue(word), [int(v) for v in x]) for t, h in rows for k, (right, word, x) in enumerate(training_rows(t, h))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*made, strict=True)) or [()] * 5, schema, strict=True)], schema=schema)

    rows = texts.mapInArrow(tidy(run), "h long, k int, right boolean, cue int, features array<int>")
    return rows.distinct().groupBy("right", "cue", "features").agg(F.count("*").alias("n"))


def taken_steps(texts: DataFrame, model: Model) -> DataFrame:
    """kind, step of score, n and right: how many candidates of all hashed() texts would
    be taken, no better one overlapping them, and how many of these are right. Of equal
    texts one counts."""
    schema = pa.schema([("h", pa.int64()), ("k", pa.int32()), ("kind", pa.int32()), ("step", pa.int32()), ("right", pa.bool_())])

    def run(batches):
        for rows in _slices(batches):
            out = []
            for t, h in rows:
                taken = []
                for made, found, right in _items(t, h):
                    if len(found.spans):
                        score = model.score(model.with_cues(found.features, _words_before(made, found)))
                        taken += [(int(found.spans[i, 0]), int(score[i] * STEPS), bool(right[i])) for i in _best(found, score, np.flatnonzero(score >= 0.5))]
                out += [(h, k, *row) for k, row in enumerate(taken)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * 5, schema, strict=True)], schema=schema)

    rows = texts.mapInArrow(tidy(run), "h long, k int, kind int, step int, right boolean")
    return rows.distinct().groupBy("kind", "step").agg(F.count("*").alias("n"), F.count_if("right").alias("right"))


def fit(documents: DataFrame, text: str = "text") -> Model:
    """Fits the trees with Spark ML on one half of the documents, and the thresholds on
    the other. A corpus without base spans to respell gives NOTHING."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    spark = documents.sparkSession
    texts = hashed(documents, text)
    train = stored(training_table(texts.where("h & 1 = 0")), "pii-training")
    if {r["right"] for r in train.select("right").distinct().collect()} != {False, True}:
        return NOTHING
    model = NOTHING._replace(cues=_cues(train))
    cues = spark.createDataFrame([(*k, v) for k, v in sorted(model.cues.items())], "kind int, cue int, odds double")
    cued = train.join(F.broadcast(cues), (F.col("features")[0] == cues["kind"]) & (train["cue"] == cues["cue"]), "left")
    x = F.concat(F.col("features").cast("array<double>"), F.array(F.coalesce("odds", F.lit(0.0)))).alias("x")
    # rare words have no odds of their own, so that fewer rows differ
    cued = stored(cued.select("right", x, "n").groupBy("right", "x").agg(F.sum("n").alias("n")).sortWithinPartitions("right", "x"), "pii-rows")
    # most candidates are wrong: right ones weigh as much as wrong ones in all
    n = {r["right"]: r["n"] for r in cued.groupBy("right").agg(F.sum("n").alias("n")).collect()}
    weight = F.col("n") * F.when(F.col("right"), F.lit(max(1.0, n[False] / n[True]))).otherwise(1.0)
    frame = cued.select(F.col("right").cast("double").alias("label"), array_to_vector("x").alias("features"), weight.alias("weight"))
    trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, seed=SEED, weightCol="weight").fit(frame)

    def walk(node, out: list) -> int:
        at = len(out)
        out.append([-1, 0.0, 0, 0, node.prediction()])
        if node.getClass().getSimpleName() != "LeafNode":
            split = node.split()
            out[at][:2] = split.featureIndex(), split.threshold()
            out[at][2], out[at][3] = walk(node.leftChild(), out), walk(node.rightChild(), out)
        return at

    nodes = []
    for tree in trees.trees:
        walk(tree._call_java("rootNode"), out := [])
        nodes.append(out)
    table = np.zeros((len(nodes), max(map(len, nodes)), 5))
    for k, out in enumerate(nodes):
        table[k, : len(out)] = out
    whole = lambda c: table[:, :, c].astype(np.int64)
    model = model._replace(feature=whole(0), threshold=table[:, :, 1], left=whole(2), right=whole(3), value=table[:, :, 4], weights=np.array(trees.treeWeights))
    # at most 4 * (STEPS + 1) rows
    steps = taken_steps(texts.where("h & 1 = 1"), model).collect()
    if not steps:
        return NOTHING
    found = np.array([(r["kind"], r["step"], r["right"], r["n"]) for r in steps], np.int64)
    of = lambda k: found[found[:, 0] == k]
    return model._replace(accept=tuple(accepted_from(of(k)[:, 1] / STEPS, of(k)[:, 2], each=of(k)[:, 3]) if len(of(k)) else 2.0 for k in range(len(KINDS))))


# --- the operator ---------------------------------------------------------------


def find_spans(text: str, model: Model) -> list[Span]:
    """Base spans, and accepted candidates that overlap none of them and no better
    candidate (of equal ones the first and longest); by kind and then start."""
    base = base_spans(text)
    found = candidates(text)
    if len(found.spans):
        found = found.take(Stretches([(s.start, s.end) for s in base]).free_of(found.spans))
    if not len(found.spans):
        return base
    score = model.score(model.with_cues(found.features, _words_before(text, found) if model.cues else [""] * len(found.spans)))
    best = _best(found, score, np.flatnonzero(score >= np.array(model.accept)[found.spans[:, 0]]))
    extra = [Span(KINDS[found.spans[k, 0]], int(found.spans[k, 1]), int(found.spans[k, 2]), False, float(score[k])) for k in best]
    return sorted(base + extra, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each covered stretch replaced by its first kind in brackets."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done : s.start], f"[{s.kind.upper()}]"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean,score:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))


def redact_personal_data(documents: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """The rows of `documents` with personal data in `text` redacted, and `pii_spans`,
    what was found: kind, start and end (code points of the given text, end
    exclusive), whether by a base pattern, score. Without a model, one is fitted on
    the documents themselves.

    A null text stays null and has no spans. Whole texts are read; time grows with
    their length. Repeated rows and ties each give their own result; other columns
    pass as they are, one named pii_spans is replaced. An empty table gives an empty
    result."""
    documents = documents.drop("pii_spans")
    model = fit(documents, text) if model is None else model
    schema = documents.withColumn(text, F.col(text).cast("string")).withColumn("pii_spans", F.lit(None).cast(SPANS)).schema

    def run(batches):
        for whole in batches:
            at = whole.schema.get_field_index(text)
            for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(lo, ROWS_AT_ONCE)
                texts, spans = batch.column(at).to_pylist(), []
                for k, x in enumerate(texts):
                    found = find_spans(x, model) if x else []
                    spans.append([s._asdict() for s in found])
                    if found:
                        texts[k] = redact(x, found)
                columns = list(batch.columns)
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, _SPAN_TYPE)], [*batch.schema.names, "pii_spans"])

    return documents.withColumn(text, F.col(text).cast("string")).mapInArrow(tidy(run), schema)
