"""Near-duplicates by an inverted join of MinHash coordinates, confirmed on full shingle sets.

1. A text becomes its set of word shingles (64-bit hashes).  Texts with equal sets are one class;
   everything below is about classes.
2. A class gets COORDS MinHash values.  A value at its coordinate is a *token*; two sets of
   similarity s agree in about ``s * COORDS`` tokens.  Pairs that agree in fewer than ``agree`` of
   them are no candidates: for 0.8 and 64 coordinates 34 is more than five deviations below the
   mean (a miss in about 10^-8 of linked pairs).
3. Prefix: classes order their tokens by rarity.  Two that agree in ``agree`` tokens share one of
   their ``COORDS - agree + 1`` rarest, so only those are posted, and tokens of one class need not
   be posted at all.  Tokens that thousands share (common passages) come last and are skipped.
4. Posting lists: within a token, each class is paired with the WINDOW before it in order of size.
   For lists of up to WINDOW + 1 that is every pair.  Longer lists are dealt out in salted
   parts, where a class meets its FEW predecessors and the smallest classes of about its size.
5. Candidate pairs count their collisions on whole signatures; of each class the best pair is
   confirmed first, on full sets, and connected components are formed; then those remaining pairs
   that still lie between two components.
6. Closing: longer lists that still hold several components may hide links between them.  Among the
   classes of such lists this is an exact prefix-filtered join of full sets: only shingles that two
   components share count, each set's are ordered by rarity, and two sets meet where both could reach
   the threshold if the shingle at hand were among the first that they share, and if of each of BUCKETS
   parts of all shingles they shared as many as the poorer one has.  Prefixes are longer by up to EXTRA
   places, as long as these are rare too, and two sets must then meet in as many places more: sets
   that share a phrase, but not several, are no candidates.  A class whose shared shingles
   are too few for any partner meets nobody, so pages that have a passage in common but not enough
   else cost their size, not its square.  Long lists are joined in blocks of like size whose bounds
   are compared first.  Candidates are confirmed on full sets, best ones first, as in 5.  So no link
   between different texts is lost.

Rows without words, or without text, are linked with nothing; a row with a null id has the
component that its text is linked into (null if no row there has an id), and links others as well.
Repeated rows share a class.  An empty table gives an empty result; further columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm import shingles
from passagework.llm.common import batch_rows, discard, materialise, shuffle_partitions, text_print
from passagework.llm.components import components

COORDS = 64
WINDOW, PART = 8, 256
#: In lists of more than LONG classes FEW predecessors are enough: the closing step looks at the rest.
LONG, FEW = 64, 2
#: Parts that a set's shingles are counted in, to bound what two sets have in common.
BUCKETS = 16
PARTS = [f"p{i}" for i in range(BUCKETS)]
#: Places by which a prefix may be longer than it must be; they hold shingles of RARE sets at most, or no more than the last one that it needs.
EXTRA, RARE = 15, 64
#: Shingles of more than HOT sets are met by broadcast (there are few of them), the others by a shuffle.
HOT = 20_000
#: Ids of confirmed candidates are broadcast up to this number (8 bytes each).
MAX_BROADCAST = 500_000
_draw = np.random.default_rng(77)
_A, _B = (_draw.integers(0, 2**31, COORDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
_PLACE = np.arange(COORDS, dtype=np.int64) << 32


def signature(hashes: np.ndarray) -> np.ndarray:
    """A token for each coordinate: its number and the least value there."""
    least = np.full(COORDS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        low, high = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
        values = _A[:, None] * low
        values += _B[:, None] * high
        np.minimum(least, values.min(axis=1), out=least)
    return _PLACE | least.astype(np.int64)


def signatures(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """doc, hash of the text, number of shingles, class and tokens of each row (no tokens without words)."""
    batch_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, tokens = [], [], []
            for hashes in shingles.shingle_sets(batch.column("text").to_pylist(), words):
                sizes.append(len(hashes))
                keys.append(shingles.set_key(hashes))
                tokens.append(signature(hashes) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("print"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["doc", "print", "n", "cls", "sig"])

    return docs.select(F.col(doc_id).cast("long").alias("doc"), text_print(F.col(text)).alias("print"), F.col(text).alias("text")).mapInArrow(run, "doc long, print long, n long, cls long, sig array<long>")


def near(n: Column | str, m: Column | str, percent: int) -> Column:
    """Sizes of two sets that can be as similar as ``percent``."""
    n, m = (F.col(x) if isinstance(x, str) else x for x in (n, m))
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def postings(classes: DataFrame, agree: int) -> DataFrame:
    """cls, n, token, df: the tokens of each class' prefix that other classes share."""
    tokens = classes.select("cls", "n", F.explode("sig").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    each = tokens.join(shared, "token").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))
    room = F.lit(COORDS - agree + 1) - (F.lit(COORDS) - F.size("own"))
    kept = each.where(room > 0).select("cls", "n", F.explode(F.slice("own", F.lit(1), room)).alias("t"))
    return kept.select("cls", "n", "t.token", "t.df")


def neighbours(posted: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes (a < b) that stand near each other in a posting list."""
    salt = F.when(F.col("df") > PART, F.pmod(F.xxhash64("cls"), F.ceil(F.col("df") / PART))).otherwise(F.lit(0))
    part = Window.partitionBy("token", "salt")
    order = part.orderBy("n", "cls").rowsBetween(-WINDOW, -1)
    entry = F.struct(F.col("cls").alias("other"), F.col("n").alias("m"))
    before = posted.withColumn("salt", salt).withColumn("before", F.collect_list(entry).over(order))
    hubs = []
    for shift in (0.0, 0.5):  # sizes within the threshold's ratio of each other, in two ways
        like = F.floor(F.log("n") / np.log(100 / percent) + shift)
        hub = F.min(F.struct(F.col("n").alias("m"), F.col("cls").alias("other"))).over(Window.partitionBy("token", "salt", "like"))
        before = before.withColumn("like", like).withColumn(f"hub{len(hubs)}", hub)
        hubs.append(F.struct(f"hub{len(hubs)}.other", f"hub{len(hubs)}.m"))
    few = F.concat(F.filter("before", lambda x, i: i >= F.size("before") - FEW), F.array(*hubs))
    held = F.when(F.col("df") > LONG, few).otherwise(F.col("before"))
    pairs = before.select("cls", "n", F.explode(held).alias("o")).where(near("n", F.col("o.m"), percent))
    return pairs.select(F.least("cls", "o.other").alias("a"), F.greatest("cls", "o.other").alias("b")).where("a <> b").distinct()


def collisions(pairs: DataFrame, classes: DataFrame, agree: int) -> DataFrame:
    own = classes.select("cls", "sig")
    left = pairs.join(own.select(F.col("cls").alias("a"), F.col("sig").alias("sa")), "a")
    both = left.join(own.select(F.col("cls").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("hits")).where(F.col("hits") >= agree)


def full_sets(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """cls, n and the bytes of the sorted set, for the classes of ``chosen`` (cls, doc, print): found by
    id, or by the hash of the text where no row of a class has an id."""
    held = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    rows = held.join(small(chosen.where("doc is not null").select("cls", "doc")), "doc").select("cls", "text")
    nameless = materialise(chosen.where("doc is null").select("cls", "print"), "nameless")
    if not nameless.isEmpty():
        unnamed = held.where("doc is null").select(text_print(F.col("text")).alias("print"), "text")
        rows = rows.unionAll(unnamed.join(small(nameless), "print").dropDuplicates(["print"]).select("cls", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"cls": [], "n": [], "bytes": []}
            for cls, hashes in zip(batch.column("cls").to_pylist(), shingles.shingle_sets(batch.column("text").to_pylist(), words), strict=True):
                if shingles.set_key(hashes) == cls:  # an id may stand for several texts
                    out["cls"].append(cls)
                    out["n"].append(len(hashes))
                    out["bytes"].append(hashes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["cls"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["bytes"], pa.binary())], list(out))

    return rows.select("cls", "text").mapInArrow(run, "cls long, n long, bytes binary").dropDuplicates(["cls"])


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def linked(common: int, n: int, m: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are as similar as ``percent``.

    One side's set travels with each pair, the other's goes once to where its pairs are; pairs come
    to their ``a`` in parts of PART, so that one hot class is dealt out.
    """
    spread = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PART)))
    own = spread.select("a", "part").distinct().join(sets.select(F.col("cls").alias("a"), "bytes"), "a").withColumn("b", F.lit(None).cast("long"))
    others = spread.join(sets.select(F.col("cls").alias("b"), "bytes"), "b")
    rows = own.select("a", "part", "b", "bytes").unionAll(others.select("a", "part", "b", "bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, part, b, data in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "bytes")), strict=True):
                hashes = np.frombuffer(data, np.uint64)
                if b is None:
                    key, held = (a, part), hashes
                elif key == (a, part) and linked(overlap(held, hashes), len(held), len(hashes), percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def best_pairs(pairs: DataFrame) -> DataFrame:
    """Of each class the pair with the most collisions."""
    ends = pairs.select("a", "b", "hits", F.explode(F.array("a", "b")).alias("cls"))
    best = ends.groupBy("cls").agg(F.max(F.struct("hits", "a", "b")).alias("p"))
    return best.select("p.a", "p.b").distinct()


def between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Those pairs whose ends have different components."""
    a, b = (comp.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    apart = pairs.join(a, "a", "left").join(b, "b", "left")
    return apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has MAX_BROADCAST rows at most (of a few numbers each)."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST else table


def shingle_rows(sets: DataFrame) -> DataFrame:
    """cls, comp, n, shingle: a row for each member of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch.column("bytes").to_pylist()], np.int64)
            members = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.int64)
            for at in range(0, len(members), 1_000_000):  # a few long sets may make a large batch
                owner = np.repeat(np.arange(len(sizes)), sizes)[at : at + 1_000_000]
                cols = [pa.array(batch.column(c).to_numpy()[owner]) for c in ("cls", "comp", "n")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(members[at : at + 1_000_000])], ["cls", "comp", "n", "shingle"])

    return sets.select("cls", "comp", "n", "bytes").mapInArrow(run, "cls long, comp long, n long, shingle long")


def reachable(cap: Column, other: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether two sets of ``n`` and ``m`` that share ``cap`` and ``other`` at most can be linked."""
    return F.least(cap, other) * (100 + percent) >= (n + m) * percent


def prefix_entries(rows: DataFrame, percent: int) -> DataFrame:
    """shingle, cls, comp, n, extra, cap, p0 ... of the places that count: ``cap`` is how much two sets could
    share if that were the first shingle they share, p0 ... how many shared shingles fall to each of BUCKETS
    parts (plain columns: what many pairs are compared by must stay a small method).

    Only shingles of at least two components count, rarest first; a place counts while its ``cap`` is
    enough for the smallest possible partner, and ``extra`` places more.  If two linked sets share k
    shingles, the i-th of them in this order stands no later than k - i places before the end, so
    with prefixes longer by e both hold the first e + 1 that they share.
    """
    held = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    shared = materialise(held.where("low <> high").select("shingle", "df"), "shared")
    often = max(HOT, rows.count() // MAX_BROADCAST)
    hot = shared.where(F.col("df") > often)  # at most MAX_BROADCAST rows, as a set has each shingle once
    met = rows.join(F.broadcast(hot), "shingle").unionByName(rows.join(F.broadcast(hot), "shingle", "left_anti").join(shared.where(F.col("df") <= often), "shingle"))
    in_part = [F.count(F.when(F.pmod(F.col("shingle"), F.lit(BUCKETS)) == i, 1)).cast("int").alias(c) for i, c in enumerate(PARTS)]
    own = met.groupBy("cls", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("own"), F.count(F.lit(1)).alias("common"), *in_part)
    places = F.col("common") - F.ceil(F.col("n") * percent / 100) + 1
    own = own.withColumn("places", places.cast("int")).where("places > 0")
    last = F.greatest(F.lit(RARE), F.get("own", F.col("places") - 1)["df"])
    own = own.withColumn("extra", F.size(F.filter(F.slice("own", F.col("places") + 1, EXTRA), lambda x: x["df"] <= last)))
    kept = own.select("cls", "comp", "n", "extra", "common", *PARTS, F.posexplode(F.slice("own", F.lit(1), F.col("places") + F.col("extra"))).alias("at", "s"))
    return kept.select("s.shingle", "cls", "comp", "n", "extra", (F.col("common") - F.col("at")).alias("cap"), *PARTS)


def entry_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """a, b, hits (how much they could share): pairs of different components that meet in an entry, and
    in as many more as both their prefixes are longer by."""
    sized = entries.withColumn("size", F.floor(F.log("n") * 50))  # sizes within a fiftieth
    held = sized.groupBy("shingle", "size").agg(F.count(F.lit(1)).alias("held"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    held = materialise(held, "lists")
    mixed = held.groupBy("shingle").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("shingle")
    listed = sized.join(small(materialise(held.join(mixed, "shingle").select("shingle", "size", "held"), "mixed")), ["shingle", "size"])
    blocked = listed.withColumn("salt", F.pmod(F.xxhash64("cls"), F.ceil(F.col("held") / PART)))
    block = ["shingle", "size", "salt"]
    bounds = blocked.groupBy(*block).agg(F.min("n").alias("least"), F.max(F.col("cap") + F.col("extra")).alias("most"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    a, b = (bounds.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in bounds.columns[1:]]) for x in "ab")
    ordered = F.struct("size_a", "salt_a") <= F.struct("size_b", "salt_b")
    apart = ~((F.col("low_a") == F.col("high_b")) & (F.col("low_b") == F.col("high_a")))
    meeting = a.join(b, "shingle").where(ordered & apart & reachable(F.col("most_a"), F.col("most_b"), F.col("least_a"), F.col("least_b"), percent))
    meeting = meeting.select(*["shingle", "size_a", "salt_a", "size_b", "salt_b"])
    left, right = (blocked.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("size", "salt", "cls", "comp", "n", "extra", "cap", *PARTS)]) for x in "ab")
    # few bytes but many comparisons: a number of partitions of its own, which isn't made smaller
    ours = meeting.join(left, ["shingle", "size_a", "salt_a"]).repartition(shuffle_partitions(entries.sparkSession), "shingle", "size_b", "salt_b")
    met = ours.join(right, ["shingle", "size_b", "salt_b"])
    most = reduce(Column.__add__, [F.least(f"{c}_a", f"{c}_b") for c in PARTS])
    sizes = (F.col("n_a") + F.col("n_b")) * percent
    more = F.least("extra_a", "extra_b")
    once = (F.col("size_a") != F.col("size_b")) | (F.col("salt_a") != F.col("salt_b")) | (F.col("cls_a") < F.col("cls_b"))  # a block with itself
    within = reachable(F.col("cap_a") + more, F.col("cap_b") + more, F.col("n_a"), F.col("n_b"), percent)
    met = met.where(once & (F.col("comp_a") != F.col("comp_b")) & within & (most * (100 + percent) >= sizes))
    pair = met.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b"), most.alias("hits"), more.alias("more"))
    counted = pair.groupBy("a", "b").agg(F.max("hits").alias("hits"), F.max("more").alias("more"), F.count(F.lit(1)).alias("met"))
    return counted.where(F.col("met") > F.col("more")).select("a", "b", "hits")


def closing(posted: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """a, b, hits: the pairs that could be links which long posting lists still hide between two
    components; None if there is no such list."""
    long = posted.where(F.col("df") > WINDOW + 1).select("cls", "token")
    placed = long.join(comp.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    mixed = placed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
    mixed = materialise(mixed, "mixed")
    if mixed.isEmpty():
        return None
    open_ = placed.join(small(mixed), "token", "left_semi").select("cls", "comp").distinct()
    rows = materialise(shingle_rows(open_.join(sets, "cls")), "shingles")
    entries = materialise(prefix_entries(rows, percent), "entries")
    discard(mixed, rows)
    found = materialise(entry_pairs(entries, percent), "closing")
    discard(entries)
    return found


def joined(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after ``links`` (a, b) are added: only they are walked, between the components at hand."""
    if comp is None:
        return materialise(components(links), "components")
    a, b = (comp.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    new = materialise(components(ends), "merged")
    moved = comp.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    out = materialise(moved.unionByName(new.join(comp.select("node"), "node", "left_anti").select("node", "comp")), "components")
    discard(new, comp)
    return out


def settle(pairs: DataFrame, comp: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame:
    """Components after ``pairs`` (a, b, hits) are confirmed: the best of each class first, then those
    that still lie between two components."""
    first = materialise(best_pairs(pairs), "first")
    links = materialise(confirm(first, sets, percent), "links-1")
    comp = joined(comp, links)
    rest = between(pairs.join(first, ["a", "b"], "left_anti").select("a", "b"), comp)
    more = materialise(confirm(rest, sets, percent), "links-2")
    comp = joined(comp, more)
    discard(first, links, more)
    return comp


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, agree: int | None = None, prints: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of each row (see above).

    ``prints`` adds print and component_print, the hashes of the row's text and of the one text that
    stands for its component: an id may be repeated with different texts.

    ``agree`` is the least number of collisions of a candidate; by default it lies five deviations
    below the mean for sets of similarity ``percent``.
    """
    s = percent / 100
    agree = agree or max(1, int(COORDS * s - 5.4 * (COORDS * s * (1 - s)) ** 0.5))
    rows = materialise(signatures(docs, doc_id, text, words), "signatures")
    classes = rows.where("n > 0").groupBy("cls", "n").agg(F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "print"))).alias("least"), F.min("print").alias("print"), F.first("sig").alias("sig")).withColumn("doc", F.col("least.doc"))
    classes = materialise(classes, "classes")
    posted = materialise(postings(classes, agree), "postings")
    pairs = materialise(collisions(neighbours(posted, percent), classes, agree), "candidates")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionAll(posted.where(F.col("df") > WINDOW + 1).select("cls")).distinct()
    chosen = materialise(classes.select("cls", "doc", "print").join(asked, "cls", "left_semi"), "chosen")
    sets = materialise(full_sets(docs, chosen, doc_id, text, words), "sets")
    comp = settle(pairs, None, sets, percent)
    more = closing(posted, comp, sets, percent)
    if more is not None and not more.isEmpty():
        comp = settle(more, comp, sets, percent)
    discard(posted, pairs, chosen, sets, *([more] if more is not None else []))
    named = classes.select("cls", "least").join(comp.select(F.col("node").alias("cls"), "comp"), "cls")
    least = named.groupBy("comp").agg(F.min("least").alias("component"))
    placed = named.join(least, "comp").select("cls", "component").unionAll(
        classes.join(comp.select(F.col("node").alias("cls")), "cls", "left_anti").select("cls", F.col("least").alias("component"))
    )
    out = rows.join(placed, "cls", "left").select(
        F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component.doc")).otherwise(F.col("doc")).alias("component_id"),
        *([F.col("print"), F.when(F.col("n") > 0, F.col("component.print")).otherwise(F.col("print")).alias("component_print")] if prints else [])
    )
    return out
