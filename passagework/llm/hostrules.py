"""Quality rules of documents and of their hosts.

Each document is held against four rules (``RULES``).  How often the documents of a host fail a rule
is shrunk towards the rate of all documents by a beta prior that is fitted to the hosts themselves
(method of moments: what the hosts' rates vary by beyond chance gives the strength of the prior), so
that a host of three documents is hardly judged by them and one of a million by little else.  The
shrunk rate of a rule at a host has one of three consequences for its documents:

* below ``TRUST`` the failures count as false alarms and are waived;
* from ``TRUST`` on the rule is enforced: documents that fail it go;
* from ``REJECT`` on the host is given up: all its documents go.

Documents that fail a base rule (too short, or too repetitive) go whatever their host.

Null and empty texts have no words and are too short.  Documents without a host are judged by the
rate of all documents.  Repeated rows count and are judged each by itself, null ids like others;
further columns don't matter, whatever their names; an empty table gives an empty result.  Texts are
read whole; a text of more than ``PIECE`` bytes is taken apart piece by piece.

The texts are read once: their counts are written to the shared folder, hosts are aggregated from
there (combined before the shuffle, so a hot host is a row a task), and the verdicts are joined back
by host and salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import materialise

#: Shrunk rates from which a rule is enforced at a host, and from which the host is given up.
TRUST, REJECT = 0.01, 0.8
#: Documents that the prior counts for at least and at most.
WEAKEST, STRONGEST = 2.0, 10_000.0
#: Parts into which the documents of one host are dealt for the join with its verdict.
SALTS = 16
#: Words in a window that must not be repeated.
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Bytes of a text that are split into words at once.
PIECE = 4_000_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def RULES() -> dict[str, Column]:
    """Each rule's failure, by the counts of a document."""
    n = F.col("n_words")
    return {
        "short": n < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }


#: Rules that a document must pass whatever its host.
BASE = ("short", "repeats")


def word_pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, split PIECE bytes at a time at white space (space and \\t to \\r)."""
    at = 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data) and data[to] not in b" \t\n\x0b\x0c\r":
            to += 1
        yield data[at:to].split()
        at = to


def repeated(data: bytes, window: int = WINDOW) -> tuple[int, int]:
    """Words of a text, and those that stand in a run of ``window`` words that occurs at least twice.

    Runs are compared by 64-bit hashes first; only those whose hash recurs are compared as words.
    """
    parts = [np.fromiter(map(hash, words), np.int64, len(words)) for words in word_pieces(data)]
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    n = len(hashes)
    runs = n - window + 1
    if runs < 2:
        return n, 0
    mixed = np.zeros(runs, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + runs].view(np.uint64)
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return n, 0
    suspects = np.flatnonzero(np.isin(mixed, twice))
    wanted = np.zeros(n, bool)
    for k in range(window):
        wanted[suspects + k] = True
    words: dict[int, bytes] = {}
    at = 0
    for piece in word_pieces(data):
        words.update((at + i, piece[i]) for i in np.flatnonzero(wanted[at : at + len(piece)]).tolist())
        at += len(piece)
    seen: dict[tuple[bytes, ...], int] = {}
    inside = np.zeros(n + 1, np.int64)
    for i in suspects.tolist():
        first = seen.setdefault(tuple(words[i + k] for k in range(window)), i)
        if first != i:
            for start in (first, i):
                inside[start] += 1
                inside[min(start + window, n)] -= 1
    return n, int((np.cumsum(inside[:n]) > 0).sum())


def count(text: str) -> tuple[int, ...]:
    """COUNTS of one text."""
    n_words, n_repeat = repeated(text.encode())
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return n_words, chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), n_repeat


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and COUNTS of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([count(x.as_py() or "") for x in batch.column("text")], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *(pa.array(found[:, i]) for i in range(len(COUNTS)))], ["doc_id", "host", *COUNTS])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, host string, {', '.join(f'{c} long' for c in COUNTS)}")


def host_rates(counted: DataFrame) -> DataFrame:
    """host, n, and of each rule f_<rule> (failures) and r_<rule> (shrunk rate), one row a host.

    Documents without a host count in the overall rates only: their row (null) has those.
    """
    rules = RULES()
    hosts = counted.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(fails, F.lit(False)).cast("long")).alias(f"f_{r}") for r, fails in rules.items()])
    named = F.col("host").isNotNull()
    overall = hosts.agg(  # one row
        F.sum("n").alias("all_n"), F.sum(F.when(named, F.col("n"))).alias("own_n"), F.sum(F.when(named, F.col("n").cast("double") * F.col("n"))).alias("own_n2"), F.count("host").alias("hosts"),
        *[x for r in rules for x in (
            F.sum(f"f_{r}").alias(f"all_{r}"), F.sum(F.when(named, F.col(f"f_{r}"))).alias(f"own_{r}"),
            F.sum(F.when(named, F.col(f"f_{r}").cast("double") * F.col(f"f_{r}") / F.col("n"))).alias(f"square_{r}"))],
    )
    held = hosts.crossJoin(F.broadcast(overall))
    for r in rules:
        mean = F.col(f"all_{r}") / F.col("all_n")
        own = F.col(f"own_{r}") / F.col("own_n")
        chance = own * (1 - own)
        beyond = F.col(f"square_{r}") - own * F.col(f"own_{r}") - (F.col("hosts") - 1) * chance
        room = F.col("own_n") - F.col("own_n2") / F.col("own_n")
        varies = F.when(room > 0, beyond / room)
        strength = F.when(varies > 0, F.least(F.greatest(chance / varies - 1, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(STRONGEST)
        shrunk = (F.col(f"f_{r}") + mean * strength) / (F.col("n") + strength)
        held = held.withColumn(f"r_{r}", F.when(named, shrunk).otherwise(mean))
    return held.select("host", "n", *[c for r in rules for c in (f"f_{r}", f"r_{r}")])


def verdicts(rates: DataFrame) -> DataFrame:
    """host, rejected (the host is given up) and enforced (rules that its documents must pass)."""
    rules = list(RULES())
    rejected = F.greatest(*[F.col(f"r_{r}") for r in rules]) >= REJECT
    enforced = F.filter(F.array(*[F.when(F.col(f"r_{r}") >= TRUST, F.lit(r)) for r in rules]), lambda x: x.isNotNull())
    return rates.select("host", rejected.alias("rejected"), enforced.alias("enforced"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, COUNTS, base_failed, failed (names of the rules), rejected, enforced and kept."""
    counted = materialise(counts(docs, doc_id, text, host), "rule-counts")
    found = verdicts(host_rates(counted)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # rows of one host are dealt by what they are, whole repeats of a row by chance of their place
    dealt = counted.withColumn("salt", F.pmod(F.xxhash64("doc_id", *COUNTS, F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    on = dealt["host"].eqNullSafe(found["host"]) & (dealt["salt"] == found["salt"])
    met = dealt.join(found, on, "left").select(dealt["doc_id"], dealt["host"], *COUNTS, "rejected", "enforced")
    rules = RULES()
    base = rules[BASE[0]] | rules[BASE[1]]
    failed = F.filter(F.array(*[F.when(fails, F.lit(r)) for r, fails in rules.items()]), lambda x: x.isNotNull())
    out = met.withColumn("base_failed", base).withColumn("failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("rejected") & ~F.arrays_overlap("failed", "enforced"))
