"""URL filter: rules first, else gradient-boosted trees on lexical features.  All of it is column
expressions: parsing, rules, features and the trees, which are compiled to nested CASE expressions.

The trees are fitted on the driver to a bounded list of labelled URLs (``FIT_ROWS`` at most, those
of the smallest hash), whose features are computed by the same expressions.  Features: lengths,
depths, digit shares, hyphens, entropy of the host, parameters, and the block rates of the last one
and two host labels among the labelled URLs.

A null url or one without ``://`` has an empty host and path, fits no rule and is judged by the
trees like any other.  Repeated rows get equal verdicts; further columns are kept; an empty table
gives an empty result.  Without labelled URLs everything that no rule blocks is allowed.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.common import ascii_lower

FIT_ROWS = 20_000
TREES, DEPTH, RATE, LEAF = 24, 3, 0.3, 5
THRESHOLD = 0.5
#: Rules up to this number become one expression; more are joined.
INLINE_RULES = 200
FEATURES = ("url_len", "host_len", "host_depth", "path_len", "path_depth", "digits", "host_digits", "hyphens", "longest", "entropy", "params", "values", "last_rate", "two_rate")


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits a character; 0 of an empty text."""
    chars, total = F.split(text, ""), F.length(text).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)))
    return F.when(F.length(text) > 0, F.aggregate(counts, F.lit(0.0), lambda s, n: s - n / total * F.log2(n / total))).otherwise(0.0)


def rate(key: Column, rates: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in sorted(rates.items(), reverse=True):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def features(url: Column, host: Column, path: Column, rates: tuple[dict[str, float], dict[str, float], float]) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    labels = F.split(host, r"\.")
    longest = F.array_max(F.transform(labels, F.length))
    found = [
        F.length(text), F.length(host), F.size(labels), F.length(path), count_of(path, "/"), digits / F.greatest(F.length(text), F.lit(1)),
        F.length(F.regexp_replace(host, "[^0-9]", "")) / F.greatest(F.length(host), F.lit(1)), count_of(host, "-"), longest, entropy(host),
        F.when(query != "", count_of(query, "&") + 1).otherwise(0), count_of(query, "="),
        rate(F.substring_index(host, ".", -1), rates[0], rates[2]), rate(F.substring_index(host, ".", -2), rates[1], rates[2]),
    ]
    return {name: c.cast("double") for name, c in zip(FEATURES, found, strict=True)}


@dataclass
class Tree:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def column(self, cols: list[Column]) -> Column:
        if self.low is None:
            return F.lit(float(self.value))
        return F.when(cols[self.feature] <= self.cut, self.low.column(cols)).otherwise(self.high.column(cols))

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.low.apply(x), self.high.apply(x))


@dataclass
class Model:
    base: float
    trees: list[Tree]
    rates: tuple[dict[str, float], dict[str, float], float] = field(default_factory=lambda: ({}, {}, 0.0))

    def column(self, cols: list[Column]) -> Column:
        """Probability of label 1 (block)."""
        margin = F.lit(self.base)
        for tree in self.trees:
            margin = margin + tree.column(cols)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> Tree:
    """A regression tree on gradients; its leaves take a damped Newton step."""
    leaf = Tree(RATE * float(grad.sum() / (hess.sum() + 1.0)))
    best = (1e-6, -1, 0.0)
    if depth and len(x) >= 2 * LEAF:
        whole = grad.sum() ** 2 / (hess.sum() + 1.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, g, h = x[order, f], np.cumsum(grad[order])[:-1], np.cumsum(hess[order])[:-1]
            gain = g**2 / (h + 1.0) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1.0) - whole
            n = np.arange(1, len(v))
            gain[(v[1:] == v[:-1]) | (n < LEAF) | (len(v) - n < LEAF)] = -1
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), f, float((v[i] + v[i + 1]) / 2))
    if best[1] < 0:
        return leaf
    side = x[:, best[1]] <= best[2]
    return Tree(0.0, best[1], best[2], grow(x[side], grad[side], hess[side], depth - 1), grow(x[~side], grad[~side], hess[~side], depth - 1))


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list[Tree]]:
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(x, y - p, p * (1 - p), DEPTH)
        margin = margin + tree.apply(x)
        trees.append(tree)
    return base, trees


def smoothed(keys: list[str], y: np.ndarray, share: float) -> dict[str, float]:
    held: dict[str, list[float]] = {}
    for k, v in zip(keys, y.tolist(), strict=True):
        held.setdefault(k, []).append(v)
    return {k: (sum(v) + 5 * share) / (len(v) + 5) for k, v in held.items() if len(v) >= 5}


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model of ``labelled`` (url, label: 1 is block)."""
    known = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull()).select("url", F.col("label").cast("double").alias("label")).orderBy(F.xxhash64("url"), "url").limit(rows)
    host, path = parse(F.col("url"))
    ends = known.select("label", F.substring_index(host, ".", -1).alias("last"), F.substring_index(host, ".", -2).alias("two")).collect()
    if not ends:
        return Model(-10.0, [])
    y = np.array([r["label"] for r in ends])
    share = float(y.mean())
    rates = (smoothed([r["last"] for r in ends], y, share), smoothed([r["two"] for r in ends], y, share), share)
    cols = features(F.col("url"), host, path, rates)
    seen = known.select("label", *[c.alias(n) for n, c in cols.items()]).collect()
    x, y = np.array([[r[n] for n in FEATURES] for r in seen], float), np.array([r["label"] for r in seen])
    return Model(*boost(x, y), rates)


def matching(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))


def with_rules(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``df`` (with host and path) and the longest rule that fits, and its verdict; rules are
    (verdict, host, path)."""
    host, path = F.col("host"), F.col("path")
    if len(rules) <= INLINE_RULES:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):  # the last WHEN that is put on is tried first
            fits = matching(host, path, h, p)
            rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
        return df.withColumns({"rule": rule, "ruled": verdict})
    table = df.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(h).alias("end"), F.lit(p).alias("start"), F.lit(v).alias("ruled")) for v, h, p in rules])).alias("r")).select("r.*")
    asked = df.select("host", "path").distinct()
    parts = F.split(host, r"\.")
    ends = asked.withColumn("end", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))))
    met = ends.join(table, "end").where(F.startswith("path", "start")).withColumn("rule", F.concat("end", "start"))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), "rule", "ruled")).alias("b")).select("host", "path", "b.rule", "b.ruled")
    return df.join(best, ["host", "path"], "left")


def judge(df: DataFrame, rules: list[tuple[str, str, str]], model: Model, url: str = "url") -> DataFrame:
    """``df`` with host, path, rule, verdict and the trees' ``score``."""
    host, path = parse(F.col(url))
    kept = df.drop("host", "path", "rule", "ruled", "verdict", "score")
    ruled = with_rules(kept.withColumns({"host": host, "path": path}), rules)
    cols = features(F.col(url), F.col("host"), F.col("path"), model.rates)
    scored = ruled.withColumns({f"_{n}": c for n, c in cols.items()}).withColumn("score", model.column([F.col(f"_{n}") for n in FEATURES]))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).drop("ruled", *[f"_{n}" for n in FEATURES])


#: Words of which the labelled list is made: what is sold by spam, and what plain sites are about.
SOLD = "discount bonus lucky vip payday replica jackpot coin promo diet outlet coupon viagra poker hookup winner".split()
SELLS = "store offers deal click cash zone hub shop now 24 777 best4you online-sale xxl direct promo".split()
ABOUT = "garden library weather river market school music history travel science kitchen letters harbour museum orchard bridge".split()
GOES = "club society house notes guide archive times review works post".split()
PATHS = "about news article blog help docs contact team story archive".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A list of labelled URLs made by rule, without any table: ``made_urls``."""
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(v).alias("label")) for u, v in made_urls()])).alias("r")).select("r.*")


def made_urls(each: int = 600, seed: int = 5) -> list[tuple[str, int]]:
    """``each`` URLs of either label.  Those to block string what is sold and how together with hyphens
    and digits, on cheap suffixes more often, with tracking parameters; plain ones are a word or two,
    now and then hyphenated, with ordinary paths.  Either may have any suffix, path and query."""
    draw = random.Random(seed)
    rows: list[tuple[str, int]] = []
    for label in (1, 0):
        for _ in range(each):
            if label:
                name = draw.choice(("-", "-", "-", "")).join((draw.choice(SOLD), draw.choice(SELLS))) + draw.choice(("", "", "", str(draw.randrange(10, 9999))))
                host = draw.choice(("www.", "", "m.", "go.", "")) + name + "." + draw.choice(("com", "net", "org", "info", "xyz", "top", "click", "biz"))
            else:
                name = draw.choice((draw.choice(ABOUT), draw.choice(ABOUT) + draw.choice(GOES), draw.choice(ABOUT) + draw.choice(("", "", "", "-")) + draw.choice(GOES)))
                host = draw.choice(("www.", "", "m.", "blog.", "en.")) + name + "." + draw.choice(("com", "net", "org", "com", "org", "info", "edu"))
            path = "/" + "/".join(draw.choice((draw.choice(PATHS), str(draw.randrange(30_000)), draw.choice(("en", "de", "fr", "es")))) for _ in range(draw.randrange(4)))
            names = ("id", "page", "q", "lang") if not label else ("aff", "ref", "utm_source", "clickid", "page")
            query = "&".join(f"{draw.choice(names)}={draw.randrange(10 ** draw.randrange(1, 8 if label else 3))}" for _ in range(draw.choice((0, 0, 1, 2, 4) if label else (0, 0, 0, 1, 2))))
            rows.append((f"http{draw.choice(('', 's'))}://{host}{path}{draw.choice(('', '', '.html', '/'))}{'?' + query if query else ''}{draw.choice(('', '', '', '#top'))}", label))
    return rows
