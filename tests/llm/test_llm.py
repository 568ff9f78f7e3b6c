"""The ten operators on small tables: brute force, round trips, and the awkward cases (nulls, empty and
very long texts, ties and repeated rows, empty tables, further columns with clashing names)."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.llm import bpe_tree, components, decontaminate, neardup, phrases, quality, sstable, toxicity, urls, warc, wrappers
from passagework.llm.queries_clean import RULES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, score string, ids string, cls int, part int, label int"
CLASH = ("s", "i", 1, 2, 3)

WORDS = [f"w{i}x" for i in range(400)]


def prose(seed: int, n: int = 80) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *CLASH) for i, t in rows], DOCS).repartition(3)


def awkward(spark):
    long = prose(1, 30_000)
    return docs(spark, [(1, prose(2)), (2, None), (3, ""), (4, long), (5, prose(2)), (5, prose(2)), (None, "null id"), (6, "日本語" * 50 + "x"), (7, "a" * 5000), (8, " \n\t ")])


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 4 ------------------------------------------------------------------------------------------

ALPHABET = [*"aab '’.,1\n\t  é日本🎉lls", "'s", "'ll", "   ", "\r\n", "\x1c", "　", "\xa0"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join), st.integers(1, 9))
def test_bpe_tree_is_the_library(text, leaf):
    encoder, table = bpe_tree.load(RANKS, public_tokenizers.PATTERN)
    ids = bpe_tree.encode_tree(text, encoder.encode_to_numpy, leaf)
    assert ids.tolist() == encoder.encode_ordinary(text)
    assert bpe_tree.decode_tree(ids, table, leaf) == text.encode()


def test_bpe_frames(spark):
    encoder, _ = bpe_tree.load(RANKS, public_tokenizers.PATTERN)
    df = awkward(spark)
    coded = bpe_tree.encode(df, RANKS, public_tokenizers.PATTERN, leaf=64)
    assert "ids" in coded.columns and "cls" in coded.columns and coded.count() == df.count()
    back = bpe_tree.decode(coded, RANKS, public_tokenizers.PATTERN, leaf=64)
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in back.collect():
        assert r["ids"] == encoder.encode_ordinary(texts[r["doc_id"]]) and bytes(r["decoded"]).decode() == texts[r["doc_id"]]
    assert bpe_tree.encode(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


# --- 10 -----------------------------------------------------------------------------------------


def test_token_shards(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    df = awkward(spark).unionAll(docs(spark, [(9, "a<|endoftext|>b½ ‏ x"), (-4, "minus"), (20, "one"), (20, "two"), (None, None), (40, "x" * 300)]))
    shards = sstable.write(df, f"file://{tmp_path}/s", TOKENIZER, 2, shards=3)
    rows = sstable.read(spark, shards).orderBy("start").collect()
    expected = [(r["doc_id"], r["text"] or "") for r in df.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(F.col("doc_id").asc_nulls_first(), "tie", "text").collect()]
    at = 0
    assert len(rows) == len(expected)
    for r, (i, text) in zip(rows, expected, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (i, at, len(ids), ids)
        at += len(ids)
    reader = next(x for x in (sstable.ShardReader(p) for _, p, _, _ in shards) if x.get(6) is not None)
    assert reader.get(6).tolist() == [*library.encode("日本語" * 50 + "x", add_special_tokens=False).ids, 2]
    assert reader.get(123456) is None
    assert sstable.read(spark, sstable.write(empty(spark), f"file://{tmp_path}/e", TOKENIZER, 2)).count() == 0


def test_shard_lookups_and_damage(tmp_path):
    writer = sstable.ShardWriter(f"file://{tmp_path}/x.sst")
    held = {i * 3: np.arange(i % 50 + 1, dtype=np.uint32) + (70_000 if i % 7 == 0 else 0) for i in range(5000)}
    for i, ids in held.items():
        writer.add(i, 0, ids)
    writer.close()
    reader = sstable.ShardReader(f"file://{tmp_path}/x.sst")
    assert len(reader.blocks) > 1
    assert all(reader.get(i).tolist() == ids.tolist() for i, ids in held.items())
    assert sum(reader.may_hold(i * 3 + 1) for i in range(5000)) < 200
    at = 0
    for i, ids in held.items():
        assert reader.find(i)[0] == at
        at += len(ids)
    assert reader.find(-1) is None and reader.find(10**9) is None
    raw = bytearray((tmp_path / "x.sst").read_bytes())
    raw[20] ^= 1
    (tmp_path / "y.sst").write_bytes(raw)
    with pytest.raises(ValueError):
        list(sstable.ShardReader(f"file://{tmp_path}/y.sst").scan())


# --- 5 and 8 ------------------------------------------------------------------------------------


def labelled_docs(spark, spoil, n=1200):
    """Every fifth document is spoilt by ``spoil``; labels say which."""
    rows, labels = [], []
    for i in range(n):
        text = prose(i, 60)
        bad = i % 5 == 0
        rows.append((i, spoil(text, i) if bad else text))
        labels.append((i, int(not bad), int(bad)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def part(folds, n):
    from passagework.llm.labelled import fold

    return fold(F.col("doc_id"), folds) == n


def test_quality_held_out(spark):
    df, labels = labelled_docs(spark, lambda t, i: "### ".join(t.split()) if i % 2 else t.upper() + "!!")
    model = quality.fit(df, labels, ~part(5, 0), part(5, 1))
    scored = quality.score(df, model).join(labels, "doc_id").where(part(5, 0))
    assert dict(scored.dtypes)["score"] == "double"
    right = scored.where((F.col("score") >= 0.3) == (F.col("quality") == 1)).count()
    assert right >= 0.97 * scored.count()
    assert scored.where("score < 0 or score > 1").count() == 0
    scores = [r["score"] for r in quality.score(awkward(spark), model).collect()]
    assert len(scores) == 10 and all(0 <= s <= 1 for s in scores)
    assert quality.score(empty(spark), model).count() == 0
    assert quality.fit(empty(spark), labels, F.lit(True), F.lit(False)) is None
    assert {r["score"] for r in quality.score(df, None).select("score").distinct().collect()} == {0.5}


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert np.interp([1, 2, 3, 4, 5], x, y).tolist() == [0, 0.5, 0.5, 1, 1]
    for values, labels in (([1.0, 1, 2], [0.0, 1, 1]), ([1.0, 2, 1], [1.0, 1, 0])):  # ties, in either order
        x, y = quality.isotonic(np.array(values), np.array(labels))
        assert np.interp([1, 2], x, y).tolist() == [0.5, 1]


def test_quality_statistics_by_parts(monkeypatch):
    import pyarrow as pa

    texts = pa.array([prose(i, 5 + i) for i in range(40)] + [None, "", prose(1, 3000), "é日本"])
    whole = quality.statistics(texts)
    monkeypatch.setattr(quality, "BYTES_AT_ONCE", 300)
    assert np.array_equal(quality.statistics(texts), whole) and np.array_equal(quality.statistics(texts.slice(3, 7)), whole[3:10])
    assert quality.statistics(texts.slice(0, 0)).shape == (0, quality.N_STATS)


INSULTS = ["blockhead", "nincompoop", "dunderpate"]


def insult(text, i):
    words = text.split()
    word = INSULTS[i % 3]
    words.insert(7, {0: word, 1: ".".join(word), 2: " ".join(word), 3: word[:4] + "x" + word[4:]}[(i // 5) % 4] if i > 300 else word)
    return " ".join(words)


def test_toxicity_held_out(spark):
    df, labels = labelled_docs(spark, insult)
    model = toxicity.fit(df, labels, ~part(4, 2), part(4, 1))
    scored = toxicity.score(df, model).join(labels, "doc_id").where(part(4, 2))
    right = scored.where((F.col("score") >= 0.3) == (F.col("toxic") == 1)).count()
    assert right >= 0.97 * scored.count()
    gapped = model.score(["b.l.o.c.k.h.e.a.d", "you b l o c k h e a d", "bl0ckhead", "BLOCKHEAD!", "blocxkhead", "a quiet day"])
    assert (gapped[:5] >= 0.3).all() and gapped[5] < 0.3
    assert toxicity.score(awkward(spark), model).count() == 10
    assert toxicity.score(empty(spark), model).count() == 0
    assert toxicity.fit(empty(spark), labels, F.lit(True), F.lit(False)) is None


def test_toxicity_learns_short_and_rare_insults(spark):
    rare = [a + b + c + d + a + "q" for a in "vzxj" for b in "ou" for c in "kw" for d in "yiu"][:40]

    def spoil(text, i):
        words = text.split()
        words.insert(7, "zq" if i % 3 == 0 else "vux" if i % 3 == 1 else rare[(i // 15) % 40])
        return " ".join(words)

    df, labels = labelled_docs(spark, spoil, 6000)
    model = toxicity.fit(df, labels, ~part(4, 2), part(4, 1))
    assert {len(m) for m in model.landmarks.marks} >= {4, 5}
    scored = toxicity.score(df, model).join(labels, "doc_id").where(part(4, 2) & (F.col("toxic") == 1))
    missed = scored.where(F.col("score") < 0.3).groupBy((F.col("doc_id") % 3).alias("kind")).count().collect()
    assert not missed, missed
    plain = model.score(["a quiet day by the sea", "zqarter and vuxed"])
    assert (plain < 0.3).all()


def slow_kernel(x: bytes, z: bytes) -> float:
    """Common subsequences of three letters, by the definition."""

    def weights(word):
        found: dict[tuple, float] = {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + toxicity.SPAN)):
                    u = word[i], word[j], word[k]
                    found[u] = found.get(u, 0) + toxicity.DECAY ** (k - i - 2)
        return found

    a, b = weights(x), weights(z)
    norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
    return sum(v * b.get(u, 0) for u, v in a.items()) / norm if norm else 0.0


def test_toxicity_kernel_and_bound():
    marks = [bytes([toxicity.START, *(ord(c) - 96 for c in w)]) for w in [*INSULTS, "head", "dunder"]]
    model = toxicity.Model(marks)
    assert np.allclose(model.gram, [[slow_kernel(a, b) ** toxicity.POWER for b in marks] for a in marks], atol=1e-5)
    assert np.linalg.eigvalsh(model.gram).min() >= -1e-6 and (model.gram == model.gram.T).all()
    for text in [insult(prose(i, 40), i) for i in range(300, 360)]:
        letters, begin, _ = toxicity.tokens([text])
        data, ends = letters.tobytes(), [*begin[1:].tolist(), len(letters)]
        rows = np.array([[slow_kernel(data[a:b], m) for m in marks] for a, b in zip(begin.tolist(), ends, strict=True)])
        assert np.allclose(model.landmarks.sums([text])[0], np.where(rows >= toxicity.LEAST, rows**toxicity.POWER, 0).sum(axis=0), atol=1e-4)


def test_toxicity_reads_long_texts_in_pieces(monkeypatch):
    model = toxicity.Model([bytes([toxicity.START, *(ord(c) - 96 for c in w)]) for w in INSULTS])
    text = ". ".join(insult(prose(i, 40), i) for i in range(300, 340))
    whole = model.bags([text, "", text + text, "no"])
    monkeypatch.setattr(toxicity, "CHARS_AT_ONCE", 500)
    assert "".join(toxicity.pieces(text)) == text and max(map(len, toxicity.pieces(text))) <= 500
    assert np.allclose(model.bags([text, "", text + text, "no"]), whole)


def test_toxicity_other_scripts_are_no_latin():
    model = toxicity.Model([bytes([toxicity.START, *(ord(c) - 96 for c in w)]) for w in INSULTS])
    draw = random.Random(2)
    for low, high in ((0x430, 0x450), (0x3B1, 0x3CA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x20000, 0x2A6D0)):
        texts = [" ".join("".join(chr(draw.randrange(low, high)) for _ in range(8)) for _ in range(200))]
        assert not model.landmarks.sums(texts).any()


# --- 6 ------------------------------------------------------------------------------------------

GAP = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def slow_hits(text, items, window):
    w = GAP.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        v = GAP.findall((t or "").translate(LOWER))
        for g in [v[i : i + window] for i in range(max(1, len(v) - window + 1))] if v else []:
            for at in range(len(w) - len(g) + 1):
                if w[at : at + len(g)] == g:
                    hit.update(range(at, at + len(g)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize(("extra", "bound"), [([], 100_000), ([(50, "Lonely")], 100_000), ([], 7)])
def test_decontamination(spark, extra, bound):
    items = [(1, prose(1, 25)), (2, prose(2, 10)), (3, prose(3, 4)), (4, None), (5, ""), (6, prose(1, 25)), (10, "É ö Straße " * 4), *extra]
    rows = [(1, f"x {prose(1, 25)} y"), (2, prose(2, 10).upper().replace(" ", "-")), (3, f"{prose(3, 4)} {prose(3, 4)}"), (4, None), (5, ""), (6, prose(1, 25)[:-1]), (6, prose(99)), (7, "É ö Straße, É ö Straße, É ö Straße; É"), (8, "lonely LONELY"), (9, prose(7, 3000) + " " + prose(1, 25)), (9, prose(7, 3000) + " " + prose(1, 25)), (None, prose(2, 10))]
    df = docs(spark, rows)
    found = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), max_broadcast=bound)
    expected = sorted((str(i), *slow_hits(t, items, 10)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in found.collect()) == expected


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in decontaminate.decontaminate(docs(spark, [(1, "a b")]), none).collect()] == [0]
    assert decontaminate.decontaminate(empty(spark), none).count() == 0


# --- 7 ------------------------------------------------------------------------------------------


def test_phrases_are_local():
    text = prose(5, 400)
    whole = phrases.sketches([text])[0]
    for shifted in ("q" + text, "another start " + text, text + " and an end"):
        assert phrases.likeness(whole, phrases.sketches([shifted])[0]) > 0.85
    assert phrases.likeness(whole, phrases.sketches([prose(6, 400)])[0]) < 0.3
    alone = [phrases.sketches([t])[0] for t in ("", "a", "aaaa", text, "日本")]
    for a, b in zip(alone, phrases.sketches(["", "a", "aaaa", text, "日本"]), strict=True):
        assert a.tolist() == b.tolist()
    assert (phrases.from_text(phrases.to_text(whole)) == whole).all()


def slow_sketch(text: str) -> list[int]:
    """The parse written out, a symbol at a time."""
    top = 2**64

    def mix(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * m % top
        return x ^ x >> 33

    p = [int(x) for x in phrases._P]
    names, seen = [mix((ord(c) * p[0] + p[1]) % top) for c in text], set()
    for level in range(1, phrases.LEVELS + 1 if text else 0):
        folded: list[list[int]] = []
        for x in names:
            if folded and folded[-1][0] == x:
                folded[-1][1] += 1
            else:
                folded.append([x, 1])
        names = [mix((x * p[3] + n) % top) if n > 1 else x for x, n in folded]
        labels = names
        for _ in range(phrases.ROUNDS):
            tossed = []
            for i, x in enumerate(labels):
                differ = x ^ labels[i - 1] if i else 1
                low = (differ & -differ).bit_length() - 1 if differ else 0
                tossed.append(2 * low + (x >> low & 1))
            labels = tossed
        cuts = [i for i in range(len(names)) if i == 0 or (labels[i] < labels[i - 1] and (i + 1 == len(names) or labels[i] <= labels[i + 1]))]
        made = []
        for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True):
            total = sum(mix(names[i]) * ((p[i - a & 1] + ((i - a) << 32) * p[2]) % top | 1) for i in range(a, b)) % top
            made.append(mix((total + b - a) % top))
        names = made
        if level >= phrases.LOWEST:
            seen.update(names)
    return sorted(seen)[: phrases.KEEP]


def test_parse_by_brute_force():
    texts = [prose(1, 300), "", "a", "aaaaaaa", "ab" * 40, "日本語" * 30, "mississippi" * 9, prose(2, 3), "x" * 500 + prose(3, 50)]
    assert [x.tolist() for x in phrases.sketches(texts)] == [slow_sketch(t) for t in texts]


def test_likeness_estimates_the_common_share():
    errors = []
    for seed in range(40):
        words = prose(seed, 400).split()
        other = words[: 10 * (seed % 40)] + prose(900 + seed, 400).split()[10 * (seed % 40) :]
        full = []
        for text in (" ".join(words), " ".join(other)):
            keep, phrases.KEEP = phrases.KEEP, 10**9
            full.append(set(phrases.sketches([text])[0].tolist()))
            phrases.KEEP = keep
        true = len(full[0] & full[1]) / len(full[0] | full[1])
        errors.append(phrases.likeness(*phrases.sketches([" ".join(words), " ".join(other)])) - true)
    assert max(map(abs, errors)) < 0.2 and abs(sum(errors)) / len(errors) < 0.02


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_next_document(spark, parts):
    rows = [(i * 3 % 31, prose(i, 5 + i)) for i in range(31)]
    rows += [(40, None), (41, ""), (42, prose(3, 3000)), (43, "abc")]
    found = {r["doc_id"]: r for r in phrases.with_next(docs(spark, rows), parts).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(found) == len(rows)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        changed = phrases.edited(text, after)
        own, new, other = phrases.sketches([text, changed, after])
        r = found[i]
        assert (r["n_chars"], r["edited"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), changed, phrases.to_text(own), phrases.to_text(new))
        assert (r["near_edited"], r["near_next"]) == (phrases.likeness(own, new), phrases.likeness(own, other))
    assert phrases.with_next(empty(spark), parts).count() == 0
    assert phrases.with_next(awkward(spark), parts).count() == 10


# --- 9 ------------------------------------------------------------------------------------------


def slow_components(rows, words, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(s), least[root(k)] if s else i) for k, (i, s) in enumerate(sets))


def near_rows():
    draw, rows = random.Random(4), []
    for base in range(12):
        words = prose(base, 60 + 10 * base).split()
        for _ in range(draw.choice([1, 2, 6, 40]) if base else 120):
            copy = list(words)
            for _ in range(draw.choice([0, 0, 1, 2, 3, 4])):
                copy[draw.randrange(len(copy))] = f"z{draw.random()}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "one two"), (1004, "ONE  two"), (1005, "one"), (1006, prose(3, 20_000)), (1007, prose(3, 20_000) + " end")]
    return rows


@pytest.mark.parametrize(("words", "window"), [(4, 8), (5, 8), (4, 1)])
def test_near_duplicates(spark, monkeypatch, words, window):
    monkeypatch.setattr(neardup, "WINDOW", window)
    monkeypatch.setattr(neardup, "PART", 16)
    monkeypatch.setattr(neardup, "LONG", 12)
    monkeypatch.setattr(neardup, "HOT", 10)
    rows = near_rows()
    found = neardup.near_duplicates(docs(spark, rows), words=words, percent=80)
    assert sorted(map(tuple, found.collect())) == slow_components(rows, words, 80)


def test_common_passages_cost_no_square(spark, monkeypatch):
    made = []
    real = neardup.entry_pairs
    monkeypatch.setattr(neardup, "entry_pairs", lambda e, p: made.append(real(e, p)) or made[-1])
    common = [f"c{i}" for i in range(70)]
    rows = [(i, " ".join([*common, *(f"o{i}x{k}" for k in range(12))])) for i in range(200)]  # alike by 0.74
    rows += [(1000 + i, " ".join([*common, *(f"p{i}x{k}" for k in range(i % 20))])) for i in range(200)]
    found = neardup.near_duplicates(docs(spark, rows), words=1)
    assert sorted(map(tuple, found.collect())) == slow_components(rows, 1, 80)


def test_prefix_entries_lose_no_link(spark):
    draw = random.Random(8)
    sets = []
    for cls in range(120):
        base = [10_000 * (cls % 6) + k for k in range(40)]
        own = {draw.choice(base) for _ in range(60)} | {draw.randrange(10**9) for _ in range(draw.randrange(12))} | set(range(20 * (cls % 2)))
        sets.append((cls, cls % 50, len(own), sorted(own)))
    rows = spark.createDataFrame([(c, g, n, x) for c, g, n, own in sets for x in own], "cls long, comp long, n long, shingle long")
    found = {(r["a"], r["b"]) for r in neardup.entry_pairs(neardup.prefix_entries(rows, 80), 80).collect()}
    linked = {(a[0], b[0]) for a in sets for b in sets if a[0] < b[0] and a[1] != b[1] and 100 * len(set(a[3]) & set(b[3])) >= 80 * len(set(a[3]) | set(b[3]))}
    assert linked and linked <= found


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0
    found = neardup.near_duplicates(docs(spark, [(5, prose(1)), (5, prose(1)), (3, prose(1)), (None, prose(1)), (None, prose(2)), (7, prose(9)), (7, prose(8))]))
    assert sorted(((r["doc_id"], r["component_id"]) for r in found.collect()), key=str) == sorted([(5, 3), (5, 3), (3, 3), (None, 3), (None, None), (7, 7), (7, 7)], key=str)


def test_components(spark):
    draw = random.Random(1)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent: dict[int, int] = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    expected = {x: root(x) for a, b in links if a != b for x in (a, b)}
    df = spark.createDataFrame([*links, *links[:50], (None, 1), (1, None)], "a long, b long")
    assert {r["node"]: r["comp"] for r in components.components(df).collect()} == expected
    hot, components.HOT = components.HOT, 3  # most nodes are met by broadcast
    assert {r["node"]: r["comp"] for r in components.components(df).collect()} == expected
    components.HOT = hot
    assert components.components(df.limit(0)).count() == 0


# --- 1, 2 and 3 ---------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, score int, text int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", 1, 2) for r in rows], PAGES)


def test_url_rules_and_trees(spark):
    cases = [
        ("http://a.COM/en/1", "a.com", "/en/1", "com/en/", "block"),
        ("https://x.example.com/en/77?q=1", "x.example.com", "/en/77", "example.com/en/7", "allow"),
        ("https://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("http://a.net/de/8", "a.net", "/de/8", "net/de/", "allow"),
        ("http://example.net/de/80#x", "example.net", "/de/80", "example.net/de/8", "block"),
        ("http://a.org?x=/es/", "a.org", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("ftp://É.Org/es/://x", "É.org", "/es/://x", "org/es/", "block"),
        ("https://lucky-jackpot-777.biz/fr/1?aff=12345", "lucky-jackpot-777.biz", "/fr/1", None, "block"),
        ("https://garden.example.org/fr/12", "garden.example.org", "/fr/12", None, "allow"),
        ("https://garden.example.org/fr/12", "garden.example.org", "/fr/12", None, "allow"),
        ("://", "", "", None, None),
        ("http://h.example/" + "a/" * 20_000, "h.example", "/" + "a/" * 20_000, None, None),
    ]
    model = urls.fit(urls.labelled_urls(spark))
    df = pages(spark, [(i, c[0], None) for i, c in enumerate(cases)])
    assert urls.judge(pages(spark, [(None, "http://a.com/en/", None)]), RULES, model).first()["verdict"] == "block"
    for rules in (RULES, [*RULES, *(("block", f"h{i}.invalid", "/") for i in range(urls.INLINE_RULES))]):
        found = {r["page_id"]: r for r in urls.judge(df, rules, model).collect()}
        for i, (_, host, path, rule, verdict) in enumerate(cases):
            r = found[i]
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] == verdict or (verdict is None and r["verdict"] in ("allow", "block"))
    assert urls.judge(df.limit(0), RULES, model).count() == 0
    nothing = urls.fit(spark.createDataFrame([], "url string, label int"))
    assert urls.judge(df, [], nothing).where("verdict <> 'allow'").count() == 0


def test_url_trees_held_out(spark):
    rows = urls.made_urls()
    random.Random(1).shuffle(rows)
    half = len(rows) // 2
    model = urls.fit(spark.createDataFrame(rows[:half], "url string, label int"))
    judged = urls.judge(spark.createDataFrame(rows[half:], "url string, label int"), [], model)
    wrong = judged.where((F.col("verdict") == "block") != (F.col("label") == 1)).count()
    assert wrong <= 0.1 * half


def test_entropy(spark):
    import math

    for text in ("", "a", "aab", "abc.def-0", "日本日"):
        n = len(text)
        expected = -sum(text.count(c) / n * math.log2(text.count(c) / n) for c in set(text)) if n else 0
        assert spark.range(1).select(urls.entropy(F.lit(text))).first()[0] == pytest.approx(expected)


def test_tree_columns_agree(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, len(urls.FEATURES)))
    y = (x[:, 0] + x[:, 3] > 0).astype(float)
    base, trees = urls.boost(x, y)
    margin = base + sum(t.apply(x) for t in trees)
    assert ((margin > 0) == (y > 0)).mean() > 0.9
    df = spark.createDataFrame(x.tolist(), ", ".join(f"c{i} double" for i in range(x.shape[1])))
    got = [r[0] for r in df.select(urls.Model(base, trees).column([F.col(f"c{i}") for i in range(x.shape[1])])).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-margin)))


ARTICLE = "<article><h1>Head &amp; tail</h1><p><b>One</b><i>two</i><br>three<p>four&nbsp; five</article>"
PAGE = "<!DOCTYPE html><html><head><title>T</title><script>x='</p>'</script></head><body><nav><ul><li>menu</ul></nav><div class='ad'>buy</div>{}<section id=comments><p>reader</section><footer>foot</footer>"


def test_main_text(spark):
    loose = "<body><div class=top>Site name</div><div><h2>Story {0}</h2><p>Body of {0}.</p><p>More of {0}.</p></div><div>Always the same</div><aside>side</aside></body>"
    rows = [(1, "http://a.x/1", PAGE.format(ARTICLE)), (2, "http://a.x/2", None), (3, None, ""), (4, "http://a.x/1", PAGE.format(ARTICLE))]
    rows += [(10 + i, f"http://b.x/{i}", loose.format(i)) for i in range(4)]
    rows += [(20, "http://c.x", "<p>cut off <b>bold</b> <a href='x"), (21, "http://d.x", "plain text only"), (22, "http://e.x", "<main>" + "<p>long line</p>" * 5000 + "</main>")]
    found = {r["page_id"]: r["text"] for r in wrappers.main_texts(pages(spark, rows)).collect()}
    assert found[1] == found[4] == "Head & tail Onetwo three four five"
    assert found[2] == found[3] == ""
    for i in range(4):
        assert found[10 + i] == f"Story {i} Body of {i}. More of {i}."
    assert found[20] == "cut off bold" and found[21] == "plain text only" and found[22] == " ".join(["long line"] * 5000)
    assert wrappers.main_texts(pages(spark, rows).limit(0)).count() == 0


def test_main_text_wrapper_decides_within_articles(spark):
    shell = "<body><nav>menu</nav><div>Page {0}</div><article><h1>{1}</h1><div>Read it in the app</div><p>{2}</p><div>All rights reserved</div></article>"
    rows = [(i, f"http://a.x/{i}", shell.format(i, f"Head {i}", f"Body {i}.")) for i in range(4)]
    rows += [(10 + i, f"http://b.x/{i}", shell.format(i, "Same", "Same body.")) for i in range(4)]  # nothing in the article varies
    rows += [(20 + i, f"http://c.x/{i}", shell.format(i, f"Head {i}", f"Body {i}.")) for i in range(2)]  # too few pages
    found = {r["page_id"]: r["text"] for r in wrappers.main_texts(pages(spark, rows)).collect()}
    for i in range(4):
        assert found[i] == f"Head {i} Body {i}."
        assert found[10 + i] == "Same Read it in the app Same body. All rights reserved"
    assert found[20] == "Head 0 Read it in the app Body 0. All rights reserved"


def test_patterns_fold_and_align():
    first = wrappers.fold(wrappers.tree("<div><ul><li>a<li>b<li>c</ul><h2>x</h2><p>1</p><h2>y</h2><p>2</p></div>"))
    second = wrappers.fold(wrappers.tree("<div><ul><li>z</ul><hr><h2>x</h2><p>3</p></div>"))
    div = wrappers.merge(first, second)[0]
    kinds = [(wrappers.key(x), x[2], x[3]) for x in div[4]]
    assert kinds[0] == ("ul", False, False) and div[4][0][4][0][3] is True
    assert ("hr", True, False) in kinds and ("(h2 p)", False, True) in kinds
    again = wrappers.merge(first, first)
    assert [(wrappers.key(x), x[2], x[3]) for x in again[0][4]] == [(wrappers.key(x), x[2], x[3]) for x in first[0][4]]
    assert wrappers.links_of(again)[0] == 2 * wrappers.links_of(first)[0]


def test_wrapper_decides_what_is_read(spark):
    page = PAGE.format(ARTICLE)
    items = wrappers.tree(page)
    assert wrappers.extract(items, wrappers.labelled(wrappers.fold(items), 1)) == "Head & tail Onetwo three four five"
    assert wrappers.extract(items, []) == ""


def test_links_are_navigation_outside_articles(spark):
    menu = "<div><a href=1>one</a></div><div><a href=2>two</a></div><div><a href=3>three</a></div>"
    rows = [(i, f"http://a.x/{i}", f"<body><section>{menu}</section><div><h2>Story {i}</h2><p>Body <a href=x>{i}</a> text.</p></div></body>") for i in range(2)]
    rows += [(10, "http://b.x/", f"<article><h1>Links</h1>{menu}</article>")]
    found = {r["page_id"]: r["text"] for r in wrappers.main_texts(pages(spark, rows)).collect()}
    assert found == {0: "Story 0 Body 0 text.", 1: "Story 1 Body 1 text.", 10: "Links one two three"}


def test_stray_brackets_and_quotes_lose_no_text():
    def text(page):
        items = wrappers.tree(page)
        return wrappers.extract(items, wrappers.labelled(wrappers.fold(items), 1))

    assert text("<article><p>1 < 2 and 3 <4, a<b and<p>next</article>") == "1 < 2 and 3 <4, a<b and next"
    assert text('<article><p title="x>kept</p><p>also</p></article>') == "kept also"
    assert text("<article><p title='it>kept</p><p>also &lt;i&gt; &amp;amp;</p></article>") == "kept also <i> &amp;"
    assert text("<article><p>ends <b>here</b> <a href='x") == "ends here"


BLOCKS = st.deferred(lambda: st.one_of(
    st.sampled_from(["one", "two words", "<b>bold</b> text", "a <a href=x>link</a>"]).map("<p>{}</p>".format),
    st.tuples(st.sampled_from(["div", "div class=ad", "section", "ul", "nav", "article", "div id=x"]), st.lists(BLOCKS, max_size=4)).map(lambda t: f"<{t[0]}>{''.join(t[1])}</{t[0].split()[0]}>"),
    st.sampled_from(["<ul><li>a<li>b<li>c</ul>", "<h2>h</h2><p>p</p><h2>i</h2><p>q</p>", "<hr>", "plain"]),
))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(BLOCKS, max_size=4).map("".join), min_size=1, max_size=5))
def test_every_page_of_a_host_has_slots_for_all_it_holds(pages_):
    """No text is lost for want of a slot: with nothing out and no template, all texts come back."""
    trees = [wrappers.tree(p) for p in pages_]
    wrapper = wrappers.fold(trees[0])
    for t in trees[1:]:
        wrapper = wrappers.merge(wrapper, wrappers.fold(t))

    def opened(slots):
        for s in slots:
            s.out, s.links, s.template, s.main = False, False, None, False
            opened(s.inner)
        return slots

    def texts(items):
        return [y for x in items for y in ([x[1]] if x[0] == "t" else texts(x[4]))]

    slots = opened(wrappers.labelled(wrapper, 1))
    is_main, wrappers.is_main = wrappers.is_main, lambda name: False
    try:
        for t in trees:
            assert wrappers.extract(t, slots) == " ".join(texts(t))
    finally:
        wrappers.is_main = is_main


def test_warc(spark, tmp_path, monkeypatch):
    big = "x" * 999 + "é"
    rows = [(1, "http://a/1 2", big), (2, None, big), (3, "u", "small"), (4, "v", "small"), (5, "w", None), (6, "x", ""), (7, "http://a/\r\nX: y", big), (None, "n", big), (8, "y", "y" * 999), (9, "y", "y" * 999)]
    df = pages(spark, rows).repartition(3)
    found = warc.write_and_read(df)
    got = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect()}
    expected = set()
    for i, _, t in rows:
        data = (t or "").encode()
        again = t == big and i != 7
        expected.add((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 7 if again else None))
    assert got == expected and found.count() == len(rows)
    assert [bytes(r["payload"]) for r in found.where("page_id = 7").collect()] == [big.encode()]
    assert warc.write_and_read(df.limit(0)).count() == 0
    monkeypatch.setattr(warc, "MAX_BROADCAST", 0)  # the shuffled join
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.write_and_read(df).collect()} == expected


def test_warc_reader_finds_damage():
    good = warc.record(1, "http://x/", b"payload", None)
    data = warc.gzip_member(good) + warc.gzip_member(warc.record(2, None, b"payload", 1))
    for size in (1, 7, 1 << 16):
        read = list(warc.read_records(data[i : i + size] for i in range(0, len(data), size)))
        assert [warc.parse(*r)[0] for r in read] == [1, 2] and warc.parse(*read[1])[5] == 1
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records([data[:-9]]))
    large = warc.record(3, "http://x/", random.Random(1).randbytes(400_000) + bytes(3_000_000), None)
    assert [len(b) for _, b in warc.read_records([warc.gzip_member(large), warc.gzip_member(good)])][0] > 3_400_000
    bomb, taken = good.replace(b"payload", b"payload" + bytes(50_000_000)), []
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records(taken.append(1) or bytes([x]) for x in warc.gzip_member(bomb)))
    assert len(taken) < 2_000  # given up long before its end
    for old, new in ((b"payload", b"pAyload"), (b"Content-Length: 8", b"Content-Length: 9")):
        assert old in good
        with pytest.raises(warc.DamagedArchive):
            list(warc.read_records([warc.gzip_member(good.replace(old, new, 1))]))
    forged = good.replace(base64.b32encode(hashlib.sha1(b"payload").digest()), base64.b32encode(hashlib.sha1(b"other").digest()), 1)
    with pytest.raises((warc.DamagedArchive, zlib.error)):
        [warc.parse(*r) for r in warc.read_records([warc.gzip_member(forged)])]
