"""HTML extraction by union-free regular expressions inferred from pages of the same host.

A page becomes a tree of blocks: elements carry a signature (tag and words of class, id and role),
inline markup is dissolved into text slots.  A *pattern* is a union-free regular expression over
such items: a text slot (constant or variable), an element with a pattern inside, or a group of
items, each of them once, optional or repeated.

* Within a page, neighbours of equal signature and like content fold into one repeated item, and
  tandem repeats of up to four items into a repeated group.
* Two patterns are merged by aligning their item sequences (longest common runs of keys); what has
  no partner becomes optional, text that differs becomes a variable slot, elements merge inside.

A host's wrapper is the merge of all its pages: those of a task merge first, then hosts' partial
wrappers in MERGE_PARTS salted parts, then those.  Only the wrapper of a host, whose size depends on the variety
of its markup, is ever held, never its pages.  Partial wrappers are merged in the order of their text, so a
table dealt to the same partitions gives the same wrapper; dealt otherwise, alignments (and with them which
slots count as constant) may differ where several are equally long.

The wrapper says what is read.  Each of its slots is labelled once a host: as part of a region that isn't
the article's (navigation, headers, footers, sidebars, notices, adverts, forms, comments: by the names in its
signature, or, outside article and main elements, because what it holds on all pages is mostly link text in
several slots), as main (inside an article or main element) or as plain; and as the template's where it is
the same constant on all pages of a host (MIN_PAGES at least) whose other slots vary.  A page is then aligned with the
wrapper: its texts are those of main slots, or of plain ones where it has no article or main
element; a constant only counts where the page has that text, a list of links only where it is one
there.  What has no slot isn't read: a page that took part in the inference has one for all it holds.

Character references are decoded; a ``<`` that begins no tag is text, as is a tag that the next one interrupts; a tag whose
quotes don't match ends at its first ``>``, one that the page's end cuts off is left out.  Null and empty html gives an empty text; a null or unparsable url
is a host of its own name ''.  Repeated pages get equal texts; null ids and further columns are kept; an empty
table gives an empty result.  Cut-off and mis-nested markup is read as far as it goes.
"""

from __future__ import annotations

import difflib
import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.common import batch_rows, materialise
from passagework.llm.urls import parse as parse_url

MIN_PAGES, MERGE_PARTS = 3, 256
#: A region of several slots with so much link text is navigation.
LINK_SHARE, LINK_SLOTS = 0.8, 3
#: Hosts whose partial wrappers a task holds.
HOSTS_AT_ONCE = 2_000
#: Wrappers are broadcast up to so many bytes of JSON, else joined by host.
MAX_BROADCAST_BYTES = 8_000_000

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video".split())
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
OUT_TAGS = frozenset("head nav header footer aside form button select dialog menu fieldset".split())
#: Words of class, id or role that mark a region as not the article's.
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
MAIN_TAGS, MAIN_WORDS = frozenset(("article", "main")), frozenset(("main", "article"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|(?P<text>[^<]+|<(?![a-zA-Z/!?]))",
    re.S,
)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(\bhidden\b)", re.S)
WORD = re.compile(r"[a-z]+")
#: A tag whose quotes don't match.
LOOSE = re.compile(r"<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/<>]*)(?P<rest>[^<>]*)>")

# An item is ["t", constant or None, optional, repeated, characters, those in links, slots] or
# ["e", signature, optional, repeated, items] or ["g", "", optional, repeated, items].


def signature(tag: str, rest: str) -> tuple[str, bool]:
    """Tag and sorted words of class, id and role; whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    if rest.strip(" /"):
        for name, value, bare in ATTRIBUTE.findall(rest):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                words.update(WORD.findall(value))
            hidden = hidden or bool(bare) or (name == "style" and "display:none" in value.replace(" ", "")) or (name == "aria-hidden" and value == "true")
    return ".".join([tag, *sorted(words)]), hidden


def tree(page: str) -> list:
    """The page's items: texts as ["t", text, ...], elements nested, inline markup dissolved."""
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]
    buffer: list[str] = []
    linked, link = 0, False

    def flush() -> None:
        nonlocal linked, link
        if buffer:
            raw = "".join(buffer)
            text = " ".join(entities.unescape(raw).split())
            if text:
                stack[-1][1].append(["t", text, False, False, len(text), len(text) * linked // len(raw), 1])
            buffer.clear()
        linked, link = 0, False

    at, end = 0, len(page)
    while at < end:
        found = TOKEN.match(page, at) or LOOSE.match(page, at)
        if not found:  # a tag that never ends: cut off with the page, or no tag at all
            if page.find("<", at + 1) < 0:
                break
            buffer.append("&lt;")
            at += 1
            continue
        at = found.end()
        kinds = found.groupdict()
        if kinds.get("text"):
            buffer.append(kinds["text"])
            linked += len(kinds["text"]) if link else 0
            continue
        tag = (kinds["tag"] or "").lower()
        if not tag:
            continue
        rest = kinds["rest"] or ""
        if kinds["close"]:
            if tag in INLINE:
                link = link and tag != "a"
                continue
            flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
            continue
        if tag in RAW and not rest.endswith("/"):
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            if tag not in INLINE:
                flush()
            continue
        if tag in INLINE:
            if tag == "br":
                buffer.append(" ")
            elif rest and signature(tag, rest)[1]:
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else at
            link = link or tag == "a"
            continue
        flush()
        shut = CLOSES_ITSELF.get(tag, ())
        while len(stack) > 1 and stack[-1][0] in shut or (len(stack) > 1 and stack[-1][0] == "p"):
            stack.pop()
        name, hidden = signature(tag, rest)
        item = ["e", name, False, False, []]
        if not hidden:
            stack[-1][1].append(item)
        if tag not in VOID and not rest.endswith("/"):
            stack.append((tag, item[4]))
    flush()
    return root


# --- patterns -----------------------------------------------------------------------------------


def key(item: list) -> str:
    return item[1] if item[0] == "e" else "#" if item[0] == "t" else "(" + " ".join(map(key, item[4])) + ")"


def alike(a: list, b: list) -> bool:
    """Whether neighbours repeat each other: equal keys, and inside mostly the same kinds of items."""
    if a[0] == "t" or key(a) != key(b):
        return False
    inner, other = set(map(key, a[4])), set(map(key, b[4]))
    return 2 * len(inner & other) >= len(inner | other)


def merge_items(a: list, b: list) -> list:
    """One item for two of equal key."""
    optional, repeated = a[2] or b[2], a[3] or b[3]
    if a[0] == "t":
        return ["t", a[1] if a[1] == b[1] else None, optional, repeated, a[4] + b[4], a[5] + b[5], a[6] + b[6]]
    return [a[0], a[1], optional, repeated, merge(a[4], b[4])]


def fold(items: list) -> list:
    """Equal neighbours and tandem repeats become repeated items."""
    out: list = []
    for item in items:
        if item[0] != "t":
            item = [*item[:4], fold(item[4])]
        if out and alike(out[-1], item):
            out[-1] = merge_items(out[-1], item)
            out[-1][3] = True
        else:
            out.append(item)
    for period in (2, 3, 4):
        at, kept = 0, []
        keys = [key(x) for x in out]
        while at < len(out):
            times = 1
            while keys[at : at + period] == keys[at + times * period : at + (times + 1) * period] and len(keys) >= at + (times + 1) * period:
                times += 1
            if times > 1:
                inner = out[at : at + period]
                for n in range(1, times):
                    inner = [merge_items(x, y) for x, y in zip(inner, out[at + n * period : at + (n + 1) * period], strict=True)]
                kept.append(["g", "", False, True, inner])
                at += times * period
            else:
                kept.append(out[at])
                at += 1
        out = kept
    return out


def absorb(items: list, other: list) -> list:
    """``items`` with each run that is one turn of a group of ``other`` made that group."""
    for group in (x for x in other if x[0] == "g"):
        inner, at, out = [key(x) for x in group[4]], 0, []
        while at < len(items):
            run = items[at : at + len(inner)]
            if [key(x) for x in run] == inner:
                out.append(["g", "", False, False, run])
                at += len(inner)
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def merge(a: list, b: list) -> list:
    """The pattern of both sequences."""
    a, b = absorb(a, b), absorb(b, a)
    ka, kb = [key(x) for x in a], [key(x) for x in b]
    if ka == kb:
        return refold([merge_items(x, y) for x, y in zip(a, b, strict=True)])
    out: list = []
    for op, i, j, m, n in difflib.SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        if op == "equal":
            out += [merge_items(x, y) for x, y in zip(a[i:j], b[m:n], strict=True)]
        else:
            out += [[x[0], x[1], True, *x[3:]] for x in (*a[i:j], *b[m:n])]
    return refold(out)


def refold(items: list) -> list:
    """After a merge: neighbours of equal key become one repeated item."""
    out: list = []
    for item in items:
        if out and (out[-1][3] or item[3]) and alike(out[-1], item):
            optional = out[-1][2] and item[2]
            out[-1] = merge_items(out[-1], item)
            out[-1][2], out[-1][3] = optional, True
        else:
            out.append(item)
    return out


# --- extraction ---------------------------------------------------------------------------------


def outside(name: str, within: bool) -> bool:
    """Whether a signature marks a region that isn't the article's; ``within``: inside the article,
    where a header is the article's own."""
    tag, *words = name.split(".")
    if tag in MAIN_TAGS:
        return False
    if within and (tag == "header" or "header" in words):
        return tag != "header" and bool(OUT_WORDS.intersection(words))
    return tag in OUT_TAGS or "header" in words or bool(OUT_WORDS.intersection(words))


def is_main(name: str) -> bool:
    tag, *words = name.split(".")
    return tag in MAIN_TAGS or (bool(MAIN_WORDS.intersection(words)) and tag in ("div", "section", "td"))


def varies(items: list, within: bool = False) -> bool:
    """Whether any slot that may be content differs between pages (a repeated one may differ within
    a page, which says nothing)."""
    return any(not x[3] and ((x[1] is None) if x[0] == "t" else (x[0] == "g" or not outside(x[1], within)) and varies(x[4], within)) for x in items)


def main_varies(items: list) -> bool:
    """Whether any slot within an article or main element differs between pages."""
    return any(
        x[0] != "t" and not x[3] and (main_varies(x[4]) if x[0] == "g" else not outside(x[1], False) and (varies(x[4], True) if is_main(x[1]) else main_varies(x[4])))
        for x in items
    )


def links_of(items: list) -> tuple[int, int, int]:
    """Characters, those in links, and slots of a pattern or page."""
    total = [0, 0, 0]
    for x in items:
        for i, n in enumerate(x[4:7] if x[0] == "t" else links_of(x[4])):
            total[i] += n
    return total[0], total[1], total[2]


def mostly_links(items: list) -> bool:
    chars, linked, slots = links_of(items)
    return slots >= LINK_SLOTS and linked >= LINK_SHARE * chars


@dataclass(slots=True)
class Slot:
    """A labelled item of a wrapper; groups are dissolved."""

    key: str
    out: bool = False
    main: bool = False
    links: bool = False
    repeated: bool = False
    template: str | None = None
    inner: list[Slot] = field(default_factory=list)


def labelled(wrapper: list, pages: int) -> list[Slot]:
    """The wrapper's items as slots that say what is read."""
    template = {within: pages >= MIN_PAGES and test(wrapper) for within, test in ((False, varies), (True, main_varies))}

    def walk(items: list, within: bool) -> list[Slot]:
        slots: list[Slot] = []
        for x in items:
            if x[0] == "g":
                slots += walk(x[4], within)
            elif x[0] == "t":
                slots.append(Slot("#", main=within, template=x[1] if template[within] and not x[2] and not x[3] else None))
            else:
                main = within or is_main(x[1])
                slots.append(Slot(x[1], outside(x[1], within), main, not main and mostly_links(x[4]), x[3], None, walk(x[4], main)))
        return slots

    return walk(wrapper, False)


def covers(slots: list[Slot], items: list) -> bool:
    """Whether ``slots`` have a place for all that ``items`` hold."""
    return all(any(s.key == key(x) and (x[0] == "t" or covers(s.inner, x[4])) for s in slots) for x in items)


def place(item: list, slots: list[Slot], at: int) -> int:
    """The slot of an item: the first from ``at`` on, else from the start, that has its key and room
    for what it holds; -1 if no slot has its key."""
    k = key(item)
    found = [i for i in (*range(at, len(slots)), *range(min(at, len(slots)))) if slots[i].key == k]
    if len(found) > 1 and item[0] != "t":
        return next((i for i in found if covers(slots[i].inner, item[4])), found[0])
    return found[0] if found else -1


def extract(page: list, slots: list[Slot]) -> str:
    """The page's main text, by the host's labelled wrapper."""
    plain: list[str] = []
    main: list[str] = []
    has_main = False

    def walk(items: list, slots: list[Slot]) -> None:
        nonlocal has_main
        at = 0
        for item in items:
            found = place(item, slots, at)
            if found < 0:
                continue
            slot = slots[found]
            at = found if slot.repeated else found + 1
            if item[0] == "t":
                if slot.template != item[1]:
                    (main if slot.main else plain).append(item[1])
            elif not slot.out and not (slot.links and mostly_links(item[4])):
                has_main = has_main or is_main(slot.key)
                walk(item[4], slot.inner)

    walk(page, slots)
    return " ".join(main if has_main else plain)


# --- Spark --------------------------------------------------------------------------------------


@lru_cache(maxsize=512)
def load(wrapper: str, pages: int) -> list[Slot]:
    return labelled(json.loads(wrapper), pages)


def infer(pages: DataFrame) -> DataFrame:
    """host, pages, wrapper (JSON) of ``pages`` (host, html)."""

    def packed(held: dict[str, tuple[int, list]]) -> pa.RecordBatch:
        texts = [json.dumps(w, ensure_ascii=False) for _, w in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array(texts, pa.string())], ["host", "pages", "wrapper"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, list]] = {}
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                found = fold(tree(page or ""))
                n, known = held.get(host, (0, found))
                held[host] = n + 1, merge(known, found)
            if len(held) > HOSTS_AT_ONCE:
                yield packed(held)
                held = {}
        yield packed(held)

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        wrapper = None
        for text in sorted(rows["wrapper"]):
            wrapper = json.loads(text) if wrapper is None else merge(wrapper, json.loads(text))
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "pages": [int(rows["pages"].sum())], "wrapper": [json.dumps(wrapper, ensure_ascii=False)]})

    schema = "host string, pages long, wrapper string"
    parts = pages.select("host", "html").mapInArrow(partial, schema).withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(MERGE_PARTS)))
    return parts.groupBy("host", "part").applyInPandas(whole, schema).groupBy("host").applyInPandas(whole, schema)


def main_texts(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the column ``out``, the main text, in place of ``html``."""
    spark = pages.sparkSession
    batch_rows(spark)
    host = parse_url(F.col(url))[0]
    kept = [c for c in pages.columns if c not in (html, out)]
    wrappers = materialise(infer(pages.select(host.alias("host"), F.col(html).alias("html"))), "wrappers")
    size = wrappers.agg(F.sum(F.octet_length("wrapper")).alias("n")).first()["n"] or 0
    wrappers = wrappers.select(F.col("host").alias("_pw_host"), F.struct("pages", "wrapper").alias("_pw_wrapper"))
    wrappers = F.broadcast(wrappers) if size <= MAX_BROADCAST_BYTES else wrappers
    met = pages.select(*kept, F.col(html).alias("_pw_html"), host.alias("_pw_host")).join(wrappers, "_pw_host", "left").drop("_pw_host")
    schema = T.StructType([*(f for f in pages.schema if f.name in kept), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, found in zip(batch.column("_pw_html").to_pylist(), batch.column("_pw_wrapper").to_pylist(), strict=True):
                texts.append(extract(tree(page or ""), load(found["wrapper"], found["pages"]) if found else []))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, out])

    return met.mapInArrow(run, schema)
