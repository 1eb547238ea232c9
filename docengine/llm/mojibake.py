"""Restoring text that was decoded with the wrong encoding.

Method: best-first graph search. A state is a passage (a sentence or line); an edge
re-encodes it with one single-byte charset and decodes the bytes as UTF-8 or as another
single-byte charset, or unescapes HTML entities. Visited states are held in a hash set.
The queue is ordered by a character-plausibility cost: the surprisal of each non-ASCII
character in its context, from counts over all documents, plus a price for each edge. The
cheapest reachable text wins if it beats the passage as it stands by MARGIN.

Scale: one pass counts contexts (each task sends at most 4 * TABLE counts, however many
documents it reads), a second repairs; nothing else is shuffled. The plausibility table
has a fixed size, 4 MB; letters of scripts without case count as one class in contexts, so
that these scripts take a few places for each character and not one for each triple, and a
table of which more than half is in use warns. A search opens at most MAX_STATES states of
at most DEPTH edges; a document in which one came to that bound is marked ``unfinished``
and has the best text seen up to then. A passage is searched if a character stands in an uncommon context, if it
decodes as UTF-8 in part, or if one single-byte edge makes it cheaper by MARGIN: the counts
hold the garbled rows too, so that what is often garbled in one way stands in common contexts.
"""

from __future__ import annotations

import html
import heapq
import math
import re
import warnings
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE = 1 << 18
EDGE, MARGIN, SLACK, COMMON = 1.0, 2.0, 2.0, 6.5
MAX_STATES, DEPTH = 5000, 4
CHARSETS = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "latin-1", "iso8859-2", "iso8859-15", "cp1254")
_TO_SINGLE = ("cp1252", "mac_roman", "cp437", "cp850")
_PASSAGE = re.compile(r"[^\n]*?[.!?][\"'”’)]*(?:\s+|$)|[^\n]+\n?|\n")
_ODD = re.compile(r"[^\x00-\x7f]")
_ODD_RUN = re.compile(r"[^\x00-\x7f]+")
_ODD_RUNS = re.compile(r"[^\x00-\x7f]{2,}")
_UTF8 = re.compile(r"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_LOST = re.compile(r"[�\x80-\x84\x86-\x9f]")


@cache
def _byte_of(charset: str) -> dict[int, str]:
    """str.translate table from the charset's characters to the byte of each as Latin-1;
    bytes that a Windows charset leaves open stand for themselves."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(charset)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(ord(c), chr(b))
    return out


@cache
def _recode(source: str, target: str) -> dict[int, str]:
    """str.translate table: encode as ``source``, decode as ``target``."""
    out = {}
    for c, b in _byte_of(source).items():
        try:
            out[c] = b.encode("latin-1").decode(target)
        except UnicodeDecodeError:
            out[c] = "�"
    return out


def _as_utf8(text: str, charset: str) -> str:
    """Decode as UTF-8 whatever is valid UTF-8 once encoded with ``charset``."""
    table = _byte_of(charset)

    def run(m: re.Match) -> str:
        s = m.group()
        raw = "".join(table.get(ord(c), "\x00") for c in s)
        out, at = [], 0
        for u in _UTF8.finditer(raw):
            try:
                good = u.group().encode("latin-1").decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += [s[at : u.start()], good]
            at = u.end()
        return "".join([*out, s[at:]])

    return _ODD_RUN.sub(run, text)


@cache
def _singles() -> list[dict[int, str]]:
    """The single-byte edges."""
    return [_recode(source, target) for source in CHARSETS[:6] for target in _TO_SINGLE if target != source]


def neighbours(text: str) -> Iterator[list[str]]:
    """Texts one edge away, in groups: first those that decode as UTF-8 (or lose HTML
    entities), which hardly happens by chance, then those of another single-byte charset."""
    group = []
    if "&" in text and (plain := html.unescape(text)) != text:
        group.append(plain)
    group += [other for charset in CHARSETS if (other := _as_utf8(text, charset)) != text]
    yield group
    odd = set(map(ord, _ODD.findall(text)))
    group = []
    for source in CHARSETS[:6]:
        if not odd & _byte_of(source).keys():
            continue
        for target in _TO_SINGLE:
            if target != source and (other := text.translate(_recode(source, target))) != text and "�" not in other:
                group.append(other)
    yield group


def _class(c: str) -> str:
    return "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else " " if c.isspace() else "x" if c.isalpha() else c


def _slots(before: str, c: str, after: str) -> tuple[int, ...]:
    """Places of a character's narrow context (its neighbours, letter case folded) and of
    its wide one (their classes, case kept) in the table, two for each: a collision would
    have to strike both."""
    near = lambda x: "0" if x.isdigit() else " " if x.isspace() else "x" if x.isalpha() and x.lower() == x.upper() else x.lower()
    narrow = xxhash.xxh64_intdigest(f"{near(before)}\t{c.lower()}\t{near(after)}")
    wide = xxhash.xxh64_intdigest(f"{_class(before)}\t{c}\t{_class(after)}\t")
    return narrow % TABLE, TABLE + (narrow >> 32) % TABLE, 2 * TABLE + wide % TABLE, 3 * TABLE + (wide >> 32) % TABLE


def contexts(text: str) -> Iterator[tuple[str, str, str]]:
    for m in _ODD.finditer(text):
        i = m.start()
        yield text[i - 1] if i else "\n", m.group(), text[i + 1] if i + 1 < len(text) else "\n"


class Plausibility:
    """Surprisal of characters in their contexts, from a count table."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.float32)
        self.total = max(1.0, float(counts[:TABLE].sum()))
        self.known: dict[tuple[str, str, str], float] = {}
        self.gained: dict[tuple[str, str, str], np.ndarray] = {}
        self.decodes: dict[str, bool] = {}
        self.unfinished = False  # whether a search since this was last reset came to its bound

    def load(self) -> float:
        """Share of the table's places in use, in the fullest of its four parts."""
        return max(np.count_nonzero(self.counts[i * TABLE : (i + 1) * TABLE]) for i in range(4)) / TABLE

    def of(self, context: tuple[str, str, str]) -> float:
        if (cost := self.known.get(context)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            before, c, after = context
            a, b, x, y = self.counts[list(_slots(*context))].tolist()
            cost = math.log(self.total) - 0.5 * math.log((min(a, b) + 0.05) * (min(x, y) + 0.05))
            if c == "�" or "\x80" <= c <= "\x9f" or c == "\xad":
                cost += 8
            elif before.isdigit() and after.isdigit() and c.lower() != c.upper():
                cost += 10  # a letter within a number
            # a frame character in a word
            elif (before.isalpha() or after.isalpha()) and ("─" <= c <= "▟"):
                cost += 4
            self.known[context] = cost
        return cost

    def gains(self, context: tuple[str, str, str]) -> np.ndarray:
        """What each single-byte edge takes off the cost of a character in its context."""
        if (out := self.gained.get(context)) is None:
            if len(self.gained) > 50_000:
                self.gained.clear()
            cost, text = self.of(context), "".join(context)
            out = np.zeros(len(_singles()))
            for i, table in enumerate(_singles()):
                b, c, a = text.translate(table)
                if (b + c + a) != text:
                    out[i] = -math.inf if "�" in b + c + a else cost - (0 if c.isascii() else self.of((b, c, a)))
            self.gained[context] = out
        return out

    def decodable(self, text: str) -> bool:
        """Whether any of it is UTF-8 once encoded with a charset."""
        for run in _ODD_RUNS.findall(text):
            if (yes := self.decodes.get(run)) is None:
                if len(self.decodes) > 200_000:
                    self.decodes.clear()
                yes = self.decodes[run] = any(_as_utf8(run, charset) != run for charset in CHARSETS)
            if yes:
                return True
        return False

    def doubtful(self, text: str) -> bool:
        """Whether any character stands in an uncommon context or an edge may help."""
        all_ = list(contexts(text))
        if any(self.of(c) > COMMON for c in all_) or self.decodable(text):
            return True
        return bool(all_) and float(sum(map(self.gains, all_)).max()) > MARGIN + EDGE

    def cost(self, text: str) -> float:
        return sum(map(self.of, contexts(text)))


def restore(passage: str, model: Plausibility) -> str:
    """The cheapest text that the search reaches from a passage. A state whose characters
    all stand in common contexts is a goal. Single-byte edges are tried only from states
    that no UTF-8 edge makes cheaper."""
    start = model.cost(passage)
    queue = [(start, 0, passage)]
    seen = {xxhash.xxh64_intdigest(passage)}
    best, best_cost = passage, start
    opened = 0
    while queue:
        cost, depth, text = heapq.heappop(queue)
        if depth and not model.doubtful(text):
            break
        if depth == DEPTH:
            model.unfinished = True
            continue
        if (opened := opened + 1) > MAX_STATES:
            model.unfinished = True
            break
        for group in neighbours(text):
            cheaper = False
            for other in group:
                if (h := xxhash.xxh64_intdigest(other)) in seen:
                    continue
                seen.add(h)
                c = model.cost(other) + EDGE * (depth + 1)
                cheaper |= c < cost - MARGIN
                if c < best_cost:
                    best, best_cost = other, c
                if c < cost + SLACK:
                    heapq.heappush(queue, (c, depth + 1, other))
            if cheaper:
                break
    return best if best_cost < start - MARGIN else passage


def repair(text: str, model: Plausibility) -> tuple[str, bool]:
    """The restored text, and whether characters of it are lost for good."""
    out = []
    for m in _PASSAGE.finditer(text):
        p = m.group()
        if not p.isascii() and model.doubtful(p):
            p = restore(p, model)
        # what was garbled before it was escaped; plain text behind entities stays as it is
        plain = p
        for _ in range(3):
            if "&" in plain and len(_ODD.findall(plain := html.unescape(plain))) > len(_ODD.findall(p)):
                break
        else:
            plain = p
        if plain != p and model.doubtful(plain) and (other := restore(plain, model)) != plain:
            p = other
        out.append(p)
    fixed = "".join(out)
    return fixed, _LOST.search(fixed) is not None


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(4 * TABLE, dtype=np.int64)
    slots: dict[tuple[str, str, str], tuple[int, ...]] = {}
    for pdf in batches:
        for text in pdf["text"]:
            if text is None or text.isascii():
                continue
            for c in set(contexts(text)):  # once a document, so that one long text counts no more than others
                if c not in slots:
                    if len(slots) > 200_000:
                        slots.clear()
                    slots[c] = _slots(*c)
                for slot in slots[c]:
                    total[slot] += 1
    at = np.flatnonzero(total)
    yield pd.DataFrame({"slot": at, "n": total[at]})


def plausibility(docs: DataFrame) -> Plausibility:
    """Context counts over all documents; at most 4 * TABLE rows come to the driver."""
    counts = np.zeros(4 * TABLE, dtype=np.float32)
    got = docs.select("text").mapInPandas(_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    for slot, n in got.toLocalIterator():
        counts[slot] = n
    model = Plausibility(counts)
    if model.load() > 0.5:
        warnings.warn(f"{model.load():.0%} of the context table is in use; enlarge TABLE", stacklevel=2)
    return model


def garbled_documents(docs: DataFrame) -> DataFrame:
    """Documents with wrongly decoded text: ``doc_id, restored, lost, unfinished``.

    ``restored`` is the text with every passage that could be restored; ``lost`` says that
    characters are missing from it for good (replacement or control characters are left);
    ``unfinished`` that a search came to its bound of states or edges.
    Sound, null and empty texts and ASCII texts that hide no garbled ones in entities give no rows; repeated rows give repeated rows;
    other columns of docs are ignored.
    """
    model = plausibility(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if text is None or (text.isascii() and "&" not in text):
                    continue
                model.unfinished = False
                fixed, lost = repair(text, model)
                if lost or fixed != text:
                    out.append((doc, fixed, lost, model.unfinished))
            yield pd.DataFrame(out, columns=["doc_id", "restored", "lost", "unfinished"])

    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # a nullable long comes to pandas as a float
    return named.mapInPandas(run, "doc_id string, restored string, lost boolean, unfinished boolean").withColumn("doc_id", F.col("doc_id").cast("long"))
