"""Toxicity: a subsequence string-kernel support vector machine on Nystroem landmarks.

K(x, z) of two words counts their common subsequences of three letters, each weighted by DECAY to the
power of the letters it skips, within a span of five: letters that are put in between weaken a match
but don't break it.  The kernel of words is the normalised one, (K(x, z) / sqrt(K(x, x) K(z, z)))^POWER,
positive semidefinite as a power of such; that of texts is its sum over all pairs of their words.

Nystroem: with W the kernel matrix of the landmarks, a word is W^(-1/2) (k(x, z_1), ..., k(x, z_m))
and a text the sum over its words.  Values of less than LEAST before the power, which is what unrelated
words reach, count as 0 in a word's vector; W keeps them, and so stays positive semidefinite. The features
are thus close to those of the kernel's Nystroem map, not equal to them.  A linear SVM with squared hinge loss is trained on these features and the text's
length; its margin is turned into a probability on rows it hasn't seen.

Landmarks are taken from the words, and parts of words, that occur in LEAST_COUNT toxic labelled documents
(or LEAST_SHARE of them where that is fewer) and are LEAST_ODDS times likelier there; of those by pivoted Cholesky
steps: the next is the one of the most weight that those before it explain the least.  They are drawn
from words of 2 to 38 letters; longer runs are scored but give no landmarks.

Words: a mark for the start and then the runs of letters between white space, with a mark for the end after two or three letters
(else a short landmark would match all words that begin so); other characters within a word are left out, case
and the accents of Latin letters are folded, digits that stand for letters are read as such, and single letters that follow
each other (``i d i o t``) make one word.  Letters that aren't Latin share OTHERS codes, so that some of them
pass for each other.  Most words can't reach LEAST for
any landmark, which a bound shows for all words of a batch at once; only the others are compared with the landmarks, so
nothing is lost by it.  Texts are read CHARS_AT_ONCE characters at a time, cut between words.

Null and empty texts have no words and get the score of a text without any match.  Repeated rows get
equal scores, null ids are scored, further columns pass through.  Without labelled rows of both
kinds, or without any landmark, every score is 0.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm import labelled
from passagework.llm.common import batch_rows, discard, materialise

#: Documents that are learnt from, at most, and landmarks.
SAMPLE, LANDMARKS = 8_000, 128
DECAY, SPAN, POWER, LEAST, RIDGE = 0.7, 5, 3, 0.5, 1e-3
#: Landmarks are in so many toxic documents at least (or that share of them, if fewer), and so many times likelier in those.
LEAST_COUNT, LEAST_SHARE, LEAST_ODDS, CANDIDATES = 5, 0.02, 6.0, 2_560
PART_LENGTHS = (4, 5, 6)
CHARS_AT_ONCE, WORDS_AT_ONCE, REMEMBER = 1_000_000, 2_000, 200_000
#: Latin letters are 1-26, others 27-59; START stands before the first letter of each word, END after the last of a short one.
OTHERS, SPACE, STOP, START, END = 33, 60, 61, 62, 63
STEPS = [(j, k, DECAY ** (k - 2)) for k in range(2, SPAN) for j in range(1, k)]


def _code(c: int) -> int:
    """Code of a character: 0 left out, a letter, SPACE or STOP."""
    x = chr(c)
    if x in ".!?\n":
        return STOP
    if x.isspace():
        return SPACE
    if x in "013457":
        return ord("oi?eas?t"[int(x)]) - 96
    if not x.isalpha():
        return 0
    base = unicodedata.normalize("NFKD", x).lower()[:1] if c < 0x250 or 0xFF00 <= c < 0xFF60 else ""
    return ord(base) - 96 if "a" <= base <= "z" else 27 + ord(x.casefold()[0]) % OTHERS


FOLD = np.array([_code(c) for c in range(0x10000)], np.uint8)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts in one array with their marks, START of each word, and its text.

    A full stop within a word (``i.d.i.o.t``) is left out like other marks; single letters are
    joined within a sentence only, which ends at a stop before white space or at a line end.
    """
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(x) + 1 for x in texts])
    codes = FOLD[np.minimum(raw, 0xFFFF)]
    beyond = np.flatnonzero(raw > 0xFFFF)
    if len(beyond):
        kinds, which = np.unique(raw[beyond], return_inverse=True)
        codes[beyond] = np.array([_code(c) for c in kinds.tolist()], np.uint8)[which]
    after = np.append(codes[1:], STOP)
    codes[(codes == STOP) & (raw != 10) & (after != SPACE) & (after != STOP)] = 0
    doc_at = np.repeat(np.arange(len(texts)), lengths)
    keep = codes > 0
    codes, doc_at = codes[keep], doc_at[keep]
    gap = codes >= SPACE
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sentence = np.cumsum(codes == STOP)[starts] if len(starts) else starts
    single = ends - starts == 1
    joined = np.zeros(len(starts), bool)
    joined[1:] = single[1:] & single[:-1] & (sentence[1:] == sentence[:-1]) & (starts[1:] - starts[:-1] == 2)
    first = ~joined
    letters = codes[~gap]
    begin = (np.cumsum(ends - starts) - (ends - starts))[first]
    size = np.diff(np.append(begin, len(letters)))
    short = (size == 2) | (size == 3)
    closed = (begin + size)[short]
    letters = np.insert(letters, np.concatenate([closed, begin]), np.repeat(np.array([END, START], np.uint8), [len(closed), len(begin)]))
    return letters, begin + np.arange(len(begin)) + np.cumsum(short) - short, doc_at[starts][first]


def profiles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, subsequence and weight, in order; a subsequence comes once a word."""
    letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    sizes = np.array([len(w) for w in words])
    ends = np.repeat(np.cumsum(sizes), sizes)
    whose, at = np.repeat(np.arange(len(words)), sizes), np.arange(len(letters))
    keys, weights = [], []
    for j, k, w in STEPS:
        i = at[at + k < ends]
        keys.append(whose[i] << 18 | letters[i] << 12 | letters[i + j] << 6 | letters[i + k])
        weights.append(np.full(len(i), w))
    keys, which = np.unique(np.concatenate(keys), return_inverse=True)
    return keys >> 18, keys & (1 << 18) - 1, np.bincount(which, np.concatenate(weights), len(keys))


class Landmarks:
    """Compares words with the landmarks."""

    def __init__(self, marks: list[bytes]):
        self.marks = marks
        self.seen: dict[bytes, tuple[np.ndarray, np.ndarray] | None] = {}
        whose, subs, weights = profiles(marks)
        norms = np.sqrt(np.bincount(whose, weights**2, len(marks)))
        kinds, row = np.unique(subs, return_inverse=True)
        self.table = np.zeros((len(kinds) + 1, len(marks)), np.float32)
        self.table[row + 1, whose] = weights / norms[whose]
        self.place = np.zeros(1 << 18, np.int32)
        self.place[kinds] = np.arange(1, len(kinds) + 1)
        self.bound = self.table.max(axis=1)[self.place]
        # the least that K(x, x) can be, by length of the word
        self.least_norm = np.sqrt([sum(w * w * max(0, n - k) for _, k, w in STEPS) for n in range(4096)])

    def __getstate__(self) -> list[bytes]:
        return self.marks

    def __setstate__(self, marks: list[bytes]) -> None:
        self.__init__(marks)

    def kernel(self, words: list[bytes]) -> np.ndarray:
        """The normalised kernel of each word with each landmark, before the power."""
        out = np.zeros((len(words), len(self.marks)), np.float32)
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            whose, subs, weights = profiles(part)
            norms = np.sqrt(np.bincount(whose, weights**2, len(part)))
            row = self.place[subs]
            hit = row > 0
            whose, products = whose[hit], self.table[row[hit]] * weights[hit, None].astype(np.float32)
            if len(whose):
                first = np.flatnonzero(np.append(True, whose[1:] != whose[:-1]))
                out[at + whose[first]] = np.add.reduceat(products, first) / norms[whose[first], None]
        return np.minimum(out, 1)

    def learn(self, words: list[bytes]) -> None:
        """Remember the values of new words that count, by landmark."""
        for word, row in zip(words, self.kernel(words), strict=True):
            which = np.flatnonzero(row >= LEAST)
            self.seen[word] = (which, row[which].astype(float) ** POWER) if len(which) else None

    def near(self, letters: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The words that could reach LEAST for some landmark."""
        n = len(letters)
        padded = np.concatenate([letters, np.zeros(SPAN, np.uint8)]).astype(np.int32)
        first, mass = padded[:n] << 12, np.zeros(n, np.float32)
        for j, k, w in STEPS:
            mass += self.bound.take(first | padded[j : n + j] << 6 | padded[k : n + k]) * np.float32(w)
        sizes = np.diff(np.append(begin, n))
        return np.flatnonzero(np.add.reduceat(mass, begin) >= LEAST * self.least_norm[np.minimum(sizes, 4095)] - 1e-4)

    def sums(self, texts: list[str]) -> np.ndarray:
        """Of each text the kernel with each landmark, summed over its words."""
        out = np.zeros((len(texts), len(self.marks)))
        letters, begin, doc = tokens(texts)
        if not len(begin):
            return out
        near = self.near(letters, begin)
        ends, data = np.append(begin[1:], len(letters)), letters.tobytes()
        words = [data[a:b] for a, b in zip(begin[near].tolist(), ends[near].tolist(), strict=True)]
        if len(self.seen) > REMEMBER:
            self.seen.clear()
        self.learn(list(set(words).difference(self.seen)))
        found = [(t, hit) for t, word in zip(doc[near].tolist(), words, strict=True) if (hit := self.seen[word]) is not None]
        if found:
            rows = np.repeat([t for t, _ in found], [len(hit[0]) for _, hit in found])
            np.add.at(out, (rows, np.concatenate([hit[0] for _, hit in found])), np.concatenate([hit[1] for _, hit in found]))
        return out


def pieces(text: str) -> list[str]:
    """The text in parts of about CHARS_AT_ONCE characters, cut after a line or sentence where there
    is one, else after white space."""
    out = []
    while len(text) > CHARS_AT_ONCE:
        low = CHARS_AT_ONCE // 2
        cut = max(text.rfind("\n", low, CHARS_AT_ONCE), text.rfind(". ", low, CHARS_AT_ONCE))
        cut = cut if cut >= 0 else text.rfind(" ", low, CHARS_AT_ONCE)
        cut = cut + 1 if cut >= 0 else CHARS_AT_ONCE
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


class Model:
    def __init__(self, marks: list[bytes]):
        self.landmarks = Landmarks(marks)
        gram = np.minimum(self.landmarks.kernel(marks).astype(float), 1) ** POWER
        self.gram = (gram + gram.T) / 2  # equal up to rounding
        values, vectors = np.linalg.eigh(self.gram)
        self.whiten = vectors @ np.diag((np.maximum(values, 0) + RIDGE) ** -0.5) @ vectors.T
        self.weights = np.zeros(len(marks) + 2)
        self.slope, self.shift = 1.0, 0.0

    def bags(self, texts: list[str]) -> np.ndarray:
        """Of each text the sums of its words' kernels with the landmarks, and its length."""
        out = np.zeros((len(texts), len(self.landmarks.marks) + 1))
        held: list[tuple[int, str]] = []
        size = 0
        for i, piece in [(i, p) for i, x in enumerate(texts) for p in pieces(x)] + [(-1, "")]:
            if held and (i < 0 or size + len(piece) > CHARS_AT_ONCE):
                np.add.at(out[:, :-1], [t for t, _ in held], self.landmarks.sums([p for _, p in held]))
                held, size = [], 0
            held.append((i, piece))
            size += len(piece)
        out[:, -1] = [np.log1p(0.1 * len(x) ** 0.25) for x in texts]
        return out

    def features(self, bags: np.ndarray) -> np.ndarray:
        return np.column_stack([bags[:, :-1] @ self.whiten, bags[:, -1]])

    def margin(self, bags: np.ndarray) -> np.ndarray:
        return self.features(bags) @ self.weights[:-1] + self.weights[-1]

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(self.bags(texts)) + self.shift, -40, 40)))


def pivots(parts: list[bytes], weights: np.ndarray, most: int) -> list[bytes]:
    """Landmarks by pivoted incomplete Cholesky: each time the part whose weight times what the ones
    before leave of its kernel with itself is the largest."""
    whose, subs, _ = profiles(parts) if parts else (np.zeros(0, int),) * 3
    some = np.unique(whose)  # parts without any subsequence are like nothing
    parts, weights = [parts[i] for i in some.tolist()], weights[some] if len(parts) else weights
    most = min(most, len(parts))
    left, factor, chosen = np.ones(len(parts)), np.zeros((len(parts), most)), []
    for t in range(most):
        gain = weights * left
        gain[chosen] = -1
        i = int(np.argmax(gain))
        if left[i] < 1e-3:
            break
        column = Landmarks([parts[i]]).kernel(parts)[:, 0].astype(float) ** POWER
        factor[:, t] = (column - factor[:, :t] @ factor[i, :t]) / np.sqrt(left[i])
        left = np.maximum(left - factor[:, t] ** 2, 0)
        chosen.append(i)
    return [parts[i] for i in chosen]


def svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Weights and constant of a linear SVM with squared hinge loss, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    keep = np.ones(x.shape[1])
    keep[-1] = 1e-3
    for _ in range(30):
        slack = 1 - y * (x @ w)
        on = slack > 0
        grad = keep * w - 2 * cost * x[on].T @ (share[on] * y[on] * slack[on])
        step = np.linalg.solve(np.diag(keep) + 2 * cost * (x[on].T * share[on]) @ x[on], grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(toxic) over margins, by penalised Newton steps (slope at least 0)."""
    x, w = np.column_stack([margin, np.ones(len(margin))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag([1e-2, 1e-6]), x.T @ (p - y) + np.array([1e-2, 0]) * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, calibrate: Column, label: str = "toxic", sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model | None:
    """``allowed`` and ``calibrate`` are conditions on the id, as in the quality classifier."""
    batch_rows(docs.sparkSession)
    chosen = labelled.sample(docs, labels, label, allowed, sample, doc_id, text).select("text", (F.col("label") > 0).alias("label"), F.coalesce(calibrate, F.lit(False)).alias("late"))
    seen = materialise(chosen, "toxicity-sample")
    sizes = {r["label"]: r["n"] for r in seen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter[bytes] = Counter()
        clean: Counter[bytes] = Counter()
        for batch in batches:
            letters, begin, doc = tokens(batch.column("text").to_pylist())
            data, ends = letters.tobytes(), np.append(begin[1:], len(letters)).tolist()
            label = batch.column("label").to_pylist()
            for d, word in {(d, data[a:b]) for a, b, d in zip(begin.tolist(), ends, doc.tolist(), strict=True) if 3 < b - a < 40}:
                (toxic if label[d] else clean)[word] += 1
        every = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array([toxic[w] for w in every], pa.int64()), pa.array([clean[w] for w in every], pa.int64())], ["word", "toxic", "clean"])

    by_word = seen.where(~F.col("late")).mapInArrow(words, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    size = F.length("word")

    def cut(n: int) -> Column:
        whole = F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.substring(F.col("word"), at, F.lit(n)))
        return F.when(size >= n, whole).otherwise(F.array().cast("array<binary>"))

    part = F.explode(F.array_distinct(F.concat(F.array("word"), *map(cut, PART_LENGTHS)))).alias("part")
    by_part = by_word.select(part, "toxic", "clean").groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = (F.col("toxic") + 0.5) / (sizes[True] + 1) / ((F.col("clean") + 0.5) / (sizes[False] + 1))
    told = by_part.where((F.col("toxic") >= min(LEAST_COUNT, LEAST_SHARE * sizes[True])) & (odds >= LEAST_ODDS)).withColumn("weight", F.col("toxic") * F.log(odds))
    rows = told.orderBy(F.desc("weight"), F.desc(F.length("part")), "part").limit(CANDIDATES).collect()
    marks = pivots([bytes(r["part"]) for r in rows], np.array([r["weight"] for r in rows]), LANDMARKS)
    if not marks:
        return None
    model = Model(marks)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.bags(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("late"), pa.array(list(found), pa.list_(pa.float64()))], ["label", "late", "x"])

    rows = seen.mapInArrow(bags, "label boolean, late boolean, x array<double>").collect()  # at most ``sample`` rows
    x, y, late = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["late"] for r in rows])
    early = ~late if len(set(y[~late])) == 2 else np.ones(len(y), bool)
    late = late if len(set(y[late])) == 2 else np.ones(len(y), bool)
    model.weights = svm(model.features(x[early]), np.where(y[early], 1.0, -1.0))
    model.slope, model.shift = logistic(model.margin(x[late]), y[late].astype(float))
    model.landmarks.seen.clear()
    discard(seen)
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``: how likely toxic it is, 0 to 1."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    batch_rows(docs.sparkSession)
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*(f for f in docs.schema if f.name in kept), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score([x or "" for x in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, out])

    return docs.select(*kept).mapInArrow(run, schema)
