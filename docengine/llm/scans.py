"""Repairing text from scanned pages: running lines, broken words, misread characters.

Method. Words are counted over all pages. The frequent ones form a vocabulary trie, and
the Levenshtein automaton of every other distinct word is intersected with it
(``automaton``), which gives all words within two edits: insertions, deletions,
substitutions, swaps and the scanners' usual misreadings, one or two characters for one or
two. Candidates are weighed as in a noisy channel: by how often they occur, over 12 for each
misreading and over GENERIC times as much for any other edit, since scanners misread in few
ways. A word that occurs fewer than RATIO * GENERIC times can't outweigh any other by an
unusual edit; such words of the vocabulary are sought by the usual misreadings only
(``Trie``), and so are the candidates of words with signs or figures in them. A word is misread if a candidate outweighs it by RATIO. Where several
do, or one by an edit that is no usual misreading, each place of the word is ranked by its
context: the weight times the counts of the candidate's pairs with the word to the left and
to the right, over all pages; an unusual edit needs such a pair. Blanks inside words are
found the same way: the joined word is frequent, the pair of pieces is not. A word that is
not frequent enough for that, as the names of one file, is sought among the words of its own
file: those of the same confusion class, within two misreadings, and FILE_RATIO times as
frequent there. A running line recurs, up to misreadings, at the edge of several pages of
its file, or has the form of such lines in other files; a page-number line shows the page's
own number. Up to EDGE lines at either edge of a page are looked at. What is left is
reflowed into paragraphs.

Scale: pages are never gathered by file. Word counts, edge lines and suspicious words are
small derived tables that are grouped and joined by key; each distinct suspicious word is
looked up once. Only the vocabulary travels to the tasks; a word must make up VOCABULARY
of all words to be in it, so it has at most 1 / VOCABULARY entries. The pairs to be counted
travel as a table of PAIR_BITS places; where they are more, more pairs are counted
than asked for. Words for which nothing can be meant are left out while reading, by two such tables. The words of a file are not broadcast; they are joined by file and
confusion class.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.automaton import Automata
from docengine.session import checkpoint

EDGE = 4
VOCABULARY, COMMON = 2e-6, 2e-5
RATIO, SPLIT_RATIO, FILE_RATIO = 20, 20, 3
GENERIC = 100  # how much rarer an edit is that is no usual misreading
PAIR_BITS = 1 << 22
LINKS = ("and", "or", "to")  # after a suspended hyphen ("short- and") unless they complete a word
HYPHENS = "-¬­‐"
# What scanners read (left) for what is printed (right).
MISREAD = (
    ("c", "e"), ("f", "t"), ("@", "a"), ("!", "i"), ("ri", "n"), ("l", "i"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("cl", "d"), ("q", "g"), ("ii", "u"),
    ("rn", "m"), ("m", "rn"), ("y", "v"), ("li", "h"), ("6", "b"), ("8", "b"), ("vv", "w"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("i", "l"), ("e", "c"), ("t", "f"), ("g", "q"),
    ("d", "cl"), ("h", "li"), ("n", "ri"), ("u", "ii"), ("v", "y"), ("b", "6"), ("w", "vv"), ("|", "l"), ("$", "s"), ("9", "g"),
)
_DIGIT_FOR = str.maketrans({"l": "1", "I": "1", "i": "1", "!": "1", "|": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "Z": "2", "b": "6", "q": "9"})
_FOLD_PAIRS = (("ﬁ", "fi"), ("ﬂ", "fl"), ("cl", "d"), ("rn", "m"), ("ri", "n"), ("ii", "u"), ("li", "h"), ("vv", "w"))
_FOLD = str.maketrans({"c": "e", "f": "e", "t": "e", "q": "g", "y": "v", "0": "o", "1": "i", "l": "i", "!": "i", "|": "i", "@": "a", "5": "s", "6": "b", "8": "b", " ": None, "\t": None})
_AS_I = str.maketrans("l1!|", "iiii")
_ALIKE = dict(zip("cftl1!|@q9y05$68", "eeeiiiiaggvossbb", strict=True))
_AS_TWO = {"m": "rri", "n": "ri", "d": "ei", "h": "ii", "u": "ii", "w": "vv", "ﬁ": "ei", "ﬂ": "ei"}
_SINGLE = str.maketrans(_ALIKE)
_PUNCT = "([{<\"'“”‘’„«».,;:)]}>%*_`"
_NUMBER = re.compile(r"[$€£]?-?\d{1,3}(?:,\d{3})+(?:\.\d+)?[x%]?|[$€£]?-?\d+(?:\.\d+)?[x%]?|\d{4}-\d\d-\d\d|\d{1,2}/\d{1,2}/\d{2,4}|\d+(?:st|nd|rd|th)")
_CODE = re.compile(r"(?:FY|[A-Z]{1,4}-?)\d+|\d+[A-Z]?")
_HALF_NUMBER = re.compile(r"[$€£]?\d{1,3}(?:,\d{3})*,?\d{0,2}")
_PAGE = re.compile(r"(?:[\[\-]\s*)?(?:p[a@]?[gq]?[ec]?\.?\s+|p\.\s*)?([0-9lIiOoSsBbZqvx!|]{1,8})(?:\s+[o0][ft]\s+\S+|\s*\|\s*\S+)?(?:\s*[\]\-])?", re.I)
_FIGURES, _NAMES, _WIDE = re.compile(r"\d+"), re.compile(r"\b(?:N|[A-Z][a-z@!015]\w*)(?: (?:N\b|[A-Z][a-z@!015]\w*))*"), re.compile(r"\s{3,}")
_ROMAN = (("x", 10), ("ix", 9), ("v", 5), ("iv", 4), ("i", 1))


def fold(line: str) -> str:
    """The line without blanks and case, misreadable characters made equal."""
    line = line.lower()
    for a, b in _FOLD_PAIRS:
        line = line.replace(a, b)
    return line.translate(_FOLD)


def template(line: str) -> str:
    """The form of a line: digits as 0, capitalized words as N."""
    return _NAMES.sub("N", _FIGURES.sub("0", " ".join(line.split())))


def _roman(n: int) -> str:
    n, out = n, "l" * (n // 50)
    n %= 50
    for mark, value in (("xl", 40), *_ROMAN):
        while n >= value:
            out += mark
            n -= value
    return out


def shows_page(text: str, page_no: int) -> bool:
    """Whether a text is the number of its page, in figures or small Roman numerals."""
    m = _PAGE.fullmatch(text.strip())
    if not m:
        return False
    n = m.group(1)
    if n.lower().translate(_AS_I) == _roman(page_no).translate(_AS_I):
        return True
    figures = n.translate(_DIGIT_FOR)
    return figures.isascii() and figures.isdigit() and int(figures) == page_no


def running_part(line: str, page_no: int) -> tuple[str, bool]:
    """A line without its page number, and whether it shows one."""
    line = line.strip()
    if len(line) > 60 and "   " not in line and "\t" not in line:  # text
        return line, False
    if shows_page(line, page_no):
        return "", True
    parts = _WIDE.split(line)
    if len(parts) > 1 and shows_page(parts[-1], page_no):
        return "   ".join(parts[:-1]), True
    if len(parts) > 1 and shows_page(parts[0], page_no):
        return "   ".join(parts[1:]), True
    return line, False


def class_of(word: str) -> str:
    """``confusion_class`` of a word in lower case. Texts of ASCII are translated fast to single
    characters only, so those that become two are replaced after that."""
    word = word.translate(_SINGLE)
    for c, two in _AS_TWO.items():
        word = word.replace(c, two)
    return word


def _hash(text: str) -> int | None:
    """Hash of a form or template as a signed number; none of an empty one."""
    h = xxhash.xxh64_intdigest(text)
    return (h - (1 << 64) if h >> 63 else h) if text else None


def _edges(doc: str, page: int, lines: list[str], known: dict[str, tuple]) -> Iterator[tuple]:
    """``known`` holds the hashes of lines met before, since running lines recur."""
    for zone, down in (("top", range(len(lines))), ("end", range(len(lines) - 1, -1, -1))):
        for k, i in enumerate(islice((i for i in down if lines[i] and not lines[i].isspace()), EDGE)):
            base, number = running_part(lines[i], page)
            number = number and (not base or len(base) < 60)
            form, kind = None, None
            if k < EDGE - 1:
                if (told := known.get(base)) is None:
                    if len(known) > 100_000:
                        known.clear()
                    told = known[base] = (_hash(fold(base)), _hash(template(base)))
                form, kind = told
            yield doc, page, zone, k, i, form, kind, number, lines[i].split(None, 1)[0] if zone == "top" else None


_SEEN = "doc_id string, page_no int, zone string, k int, line_no int, form long, template long, number boolean, first string, word string, n long, key long"


def edge_lines(edges: DataFrame) -> DataFrame:
    """The first and last EDGE non-blank lines of every page with ``furniture``."""
    size = edges.where("zone = 'top' and k = 0").groupBy("doc_id").agg(F.count_distinct("page_no").alias("pages"))
    named = edges.where("form is not null")
    # one shuffle: pages count once for each form of a file
    named = named.select("doc_id", "zone", "form", "page_no", "template").repartition("doc_id", "zone", "form")
    forms = named.groupBy("doc_id", "zone", "form", "page_no").agg(F.min("template").alias("template")).groupBy("doc_id", "zone", "form").agg(F.count("*").alias("n"), F.min("template").alias("template"))
    often = (F.col("n") >= 2) & (F.col("n") >= 0.3 * F.col("pages"))
    forms = forms.join(size, "doc_id").withColumn("often", often)
    share = forms.groupBy("zone", "template").agg((F.sum(F.when(F.col("often"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share")).where("share >= 0.4")
    docs = forms.where("often").groupBy("zone", "template").agg(F.count_distinct("doc_id").alias("docs"))
    known = share.join(docs, ["zone", "template"])
    told = forms.join(known, ["zone", "template"], "left")
    told = told.where(
        (F.col("often") & (F.col("share").isNotNull() | ((F.col("n") >= 4) & (F.col("n") >= 0.8 * F.col("pages"))))) | ((F.col("share") >= 0.5) & (F.col("docs") >= 4))
    ).withColumn("runs", F.lit(True))
    marked = edges.drop("template").join(told.select("doc_id", "zone", "form", "runs"), ["doc_id", "zone", "form"], "left").withColumn(
        "is", F.coalesce("runs", F.lit(False)) | F.col("number")
    )
    # a heading may stand above the running line, so that furniture need not begin at the very edge
    return marked.withColumn("furniture", F.col("is") & (F.col("k") < EDGE - 1)).select("doc_id", "page_no", "zone", "k", "line_no", "furniture", "first")


def broken_word(line: str) -> str:
    """The broken last word of a line that ends in a hyphen, without the hyphen."""
    s = line.rstrip()
    if len(s) < 2 or s[-1] not in HYPHENS or not s[-2].isalpha():
        return ""
    return s[:-1].split()[-1].lstrip(_PUNCT)


class Numbers(dict):
    """token -> number in order of appearance, starting anew after LIMIT tokens."""

    LIMIT = 1 << 19

    def __init__(self):
        self.tokens: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self.tokens)
        self.tokens.append(token)
        return n

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
            self.tokens.clear()
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))


class Flat:
    """The tokens of a batch of pages one after another. Of each non-blank line: its row, its
    number, whether its last word is broken, and the place of its first token (the total at
    the end); of each token its line and whether it is a piece of a word broken over lines."""

    MARK = "\x00"  # between lines

    def __init__(self, texts: list, numbers: Numbers):
        lines = [x or "" for text in texts for x in text]
        whole = f" {self.MARK} ".join(lines)
        if whole.count(self.MARK) > len(lines):
            whole = f" {self.MARK} ".join(x.replace(self.MARK, " ") for x in lines)
        tokens = whole.split()
        at = numbers.of(tokens)
        marks = at == numbers[self.MARK]
        self.of, self.at = numbers.tokens, at[~marks]
        of = np.cumsum(marks)[~marks]
        self.first = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
        some = of[self.first[:-1]]
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        self.row = np.repeat(np.arange(len(texts)), counts)[some]
        self.number = some - (np.cumsum(counts) - counts)[self.row]
        last = self.first[1:] - 1
        self.broken = np.array([self.of[n][-1] in HYPHENS for n in self.at[last].tolist()], dtype=bool)
        for k in np.flatnonzero(self.broken).tolist():
            self.broken[k] = bool(broken_word(lines[some[k]]))
        self.line = np.repeat(np.arange(len(some)), np.diff(self.first))
        self.piece = np.zeros(len(self.at), dtype=bool)
        if len(some):
            self.piece[last[self.broken]] = True
            for k in np.flatnonzero(self.broken[:-1] & (self.row[:-1] == self.row[1:])) + 1:
                self.piece[self.first[k]] |= self.token(self.first[k])[0].islower()

    def token(self, i: int) -> str:
        return self.of[self.at[i]]


def _cores(token: str) -> list[str]:
    core = token.strip(_PUNCT).lower()
    if core.isalpha():
        return [core] if len(core) > 1 else []
    return [x for x in core.split("-") if len(x) > 1 and x.isalpha()] if "-" in core else []


def _arrow(values: pa.Array) -> pd.Series:
    """A column that need not be turned from Python's objects."""
    return pd.Series(pd.arrays.ArrowExtensionArray(values))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edge lines of each page (``zone`` set) and the words of each file in a batch."""
    names = [c.split()[0] for c in _SEEN.split(", ")]
    numbers, cores = Numbers(), Numbers()
    parts: dict[str, list[int]] = {}
    known: dict[str, tuple] = {}
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    types = dict(zip(names, (kinds[c.split()[1]] for c in _SEEN.split(", ")), strict=True))
    for pdf in batches:
        texts = [[x or "" for x in lines] for lines in pdf["raw_lines"]]
        edges = [e for doc, page, lines in zip(pdf["doc_id"], pdf["page_no"], texts, strict=True) for e in _edges(doc, page, lines, known)]
        nothing = lambda some, n: {c: _arrow(pa.nulls(n, types[c])) for c in some}
        yield pd.DataFrame(edges, columns=names[:9], dtype=object).assign(**nothing(names[9:], len(edges)))
        flat = Flat(texts, numbers)
        at = flat.at
        file, docs = pd.factorize(pdf["doc_id"])
        width = max(1, len(numbers.tokens))
        pair, n = np.unique((file[flat.row[flat.line]] * width + at)[~flat.piece], return_counts=True)
        if len(cores) > cores.LIMIT:
            cores, parts = Numbers(), {}
        of = {}
        for t in np.unique(pair % width).tolist():
            token = numbers.tokens[t]
            if (some := parts.get(token)) is None:
                some = parts[token] = [cores[c] for c in _cores(token)]
            of[t] = some
        held = [of[t] for t in (pair % width).tolist()]
        times = np.fromiter(map(len, held), np.int64, len(held))
        core = np.fromiter(chain.from_iterable(held), np.int64, times.sum())
        width = max(1, len(cores.tokens))
        both, back = np.unique(np.repeat(pair // max(1, len(numbers.tokens)), times) * width + core, return_inverse=True)
        count = np.bincount(back, weights=np.repeat(n, times), minlength=len(both)).astype(np.int64)
        each, place = np.unique(both % width, return_inverse=True)
        words = [cores.tokens[c] for c in each.tolist()]
        key = np.fromiter((xxhash.xxh64_intdigest(class_of(w), 42) for w in words), np.uint64, len(words)).view(np.int64)  # as Spark's xxhash64
        told = {"doc_id": _arrow(pa.array(docs.to_numpy(dtype=object), pa.string()).take(pa.array(both // width))), "word": _arrow(pa.array(words, pa.string()).take(pa.array(place))), "n": count, "key": key[place]}
        yield pd.DataFrame(told | nothing(names[1:9], len(both)))[names]


def confusion_class(word: Column) -> Column:
    """A key that no misreading changes: every character that may be misread as two becomes
    those two, and the single ones that are misread for each other become one."""
    out = F.translate(F.lower(word), "".join(_ALIKE), "".join(_ALIKE.values()))
    for c, two in _AS_TWO.items():
        out = F.replace(out, F.lit(c), F.lit(two))
    return out


class Trie:
    """Vocabulary trie and its intersection with a word's misreading automaton."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        self.rules: dict[str, list[tuple[str, str]]] = {}
        for seen, meant in MISREAD:
            self.rules.setdefault(seen[0], []).append((seen, meant))

    def candidates(self, word: str, edits: int = 2) -> dict[str, int]:
        """All vocabulary words from which at most ``edits`` misreadings lead to ``word``."""
        found: dict[str, int] = {}
        stack = [(self.root, 0, 0)]
        while stack:
            node, i, cost = stack.pop()
            if i == len(word):
                if (w := node.get("")) is not None and cost < found.get(w, 99):
                    found[w] = cost
                continue
            if (down := node.get(word[i])) is not None:
                stack.append((down, i + 1, cost))
            if cost < edits:
                for seen, meant in self.rules.get(word[i], ()):
                    if word.startswith(seen, i):
                        at = node
                        for c in meant:
                            if (at := at.get(c)) is None:
                                break
                        else:
                            stack.append((at, i + len(seen), cost + 1))
        found.pop(word, None)
        return found


def misread_number(core: str) -> str | None:
    """The number meant by a core that has letters in the place of figures."""
    if core.isalpha() or not any(c.isdigit() for c in core) or _NUMBER.fullmatch(core) or _CODE.fullmatch(core):
        return None
    fixed = core.translate(_DIGIT_FOR)
    return fixed if fixed != core and _NUMBER.fullmatch(fixed) and sum(c.isdigit() for c in core) >= 2 else None


def _odd(core: str) -> bool:
    """Letters with figures or signs among them, as no word has."""
    if core.isalpha():
        return False
    letters = sum(c.isalpha() for c in core)
    odd = sum(c in "015689@!|$" for c in core)
    return letters >= 3 and 0 < odd <= 2 and letters + odd == len(core) and not _CODE.fullmatch(core)


_MARKS = "doc_id string, page_no int, line_no int, kind string, word string, left string, right string, joined long"


def _place(h: int) -> int:
    """Place of a hash in a table of PAIR_BITS, as Spark's pmod of the signed one."""
    return (h - (1 << 64) if h >> 63 else h) % PAIR_BITS


def _touched(vocabulary: dict[str, int]):
    """Places of the words that have any candidate in the vocabulary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, automata = Trie(vocabulary), Automata([w for w, n in vocabulary.items() if n >= RATIO * GENERIC], MISREAD)
        for pdf in batches:
            words = pdf["word"].tolist()
            some = [w for w, near in zip(words, automata.candidates(words), strict=True) if near or trie.candidates(w)]
            yield pd.DataFrame({"place": np.unique(np.array([_place(xxhash.xxh64_intdigest(w)) for w in some], dtype=np.int64))})

    return run


def _bits(places: DataFrame) -> np.ndarray:
    """Places as packed bits."""
    bits = np.zeros(PAIR_BITS, dtype=bool)
    for (place,) in places.distinct().toLocalIterator():
        bits[place] = True
    return np.packbits(bits)


def _at(bits: np.ndarray, place: int) -> bool:
    return bool(bits[place >> 3] >> (7 - (place & 7)) & 1)


def _suspects(vocabulary: dict[str, int], common: int, dubious: set[str], touched: np.ndarray, rivals: np.ndarray):
    """Broken words, and words and pairs that may be misread: kinds ``break``, ``number``,
    ``word`` and ``pair``. ``dubious`` are common words that a file may have for others. Of
    words those are given for which something may be meant: a part has a candidate in the
    vocabulary (``touched``) or shares its confusion class with another word of its file
    (``rivals``), or figures stand among its letters. Both are tables of places, so that a
    few other words are given too."""

    tries: list = []  # made in the task

    def hopeful(part: str) -> bool:
        """Whether a part with signs, which is not counted as a word, has any candidate."""
        if not tries:
            tries.append(Trie(vocabulary))
        return bool(tries[0].candidates(part))

    def class_place(doc: str, part: str) -> int:
        key = xxhash.xxh64_intdigest(class_of(part), 42)
        return _place(xxhash.xxh64_intdigest(key.to_bytes(8, "little"), xxhash.xxh64_intdigest(doc, 42)))  # as Spark's xxhash64 of both

    def known(core: str) -> bool:
        low = core.lower()
        n = vocabulary.get(low, 0)
        if dubious and not dubious.isdisjoint(low.split("-")):
            return False
        return n >= common or (len(low) < 2) or ("-" in low and all(len(p) < 2 or vocabulary.get(p, 0) >= common or not p.isalpha() and not _odd(p) for p in low.split("-")))

    head_of: dict[str, int] = {}  # proper beginnings and ends of vocabulary words, numbered
    tail_of: dict[str, int] = {}
    splits: dict[int, int] = {}
    for w, n in vocabulary.items():
        for i in range(1, len(w)) if len(w) >= 4 else ():
            splits[head_of.setdefault(w[:i], len(head_of)) << 32 | tail_of.setdefault(w[i:], len(tail_of))] = n
    ways = np.array(sorted(splits), dtype=np.int64)

    def judged(token: str) -> tuple[str, str, int, int, bool, bool]:
        """Kind and text of a suspicion, the numbers of the token as the beginning and as the
        end of a word (-1: none), whether it may be the first or the second half of a number."""
        core = token.strip(_PUNCT)
        kind, text = "", ""
        head, tail = token.lstrip(_PUNCT), token.rstrip(_PUNCT)
        if core and not core.islower() and _NUMBER.fullmatch(core):  # sound
            pass
        elif core and not known(core):
            if (fixed := misread_number(core)) is not None:
                kind, text = "number", fixed
            elif core.isalpha() or (any(map(str.isalpha, core)) and not _CODE.fullmatch(core) and not _NUMBER.fullmatch(core)):
                kind, text = "word", core
                parts = [p for p in core.lower().split("-") if len(p) > 1]
                if not (_odd(core) or any(_odd(p) or (_at(touched, _place(xxhash.xxh64_intdigest(p))) if p.isalpha() else hopeful(p)) for p in parts)):
                    kind = "rare"
        half = head[-1:] in "0123456789," and "," in head and _HALF_NUMBER.fullmatch(head) is not None and not _NUMBER.fullmatch(head)
        return kind, text, head_of.get(head.lower(), -1) if core and head[-1:].isalpha() else -1, tail_of.get(tail.lower(), -1) if core and tail[:1].isalpha() else -1, half and bool(core), tail[:1].isdigit() and bool(core)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = Numbers()
        verdicts: list[tuple] = []
        asked: dict[tuple[str, str], bool] = {}
        for pdf in batches:
            flat = Flat(pdf["raw_lines"].tolist(), numbers)
            at, token = flat.at, flat.token
            if len(verdicts) > len(numbers.tokens):
                verdicts = []
            verdicts += [judged(t) for t in numbers.tokens[len(verdicts) :]]
            docs, pages, lines = pdf["doc_id"].tolist(), pdf["page_no"].tolist(), pdf["raw_lines"].tolist()
            odd = np.array([v[0] != "" for v in verdicts])
            head, tail, half, figure = map(np.array, list(zip(*verdicts, strict=True))[2:] or [[]] * 4)
            out: list[tuple] = []
            core = lambda i: token(i).strip(_PUNCT)
            where = lambda k: (docs[flat.row[k]], pages[flat.row[k]], int(flat.number[k]))
            first, line = flat.first, flat.line
            for i in np.flatnonzero(odd[at] & ~flat.piece).tolist() if len(at) else ():
                kind, text = verdicts[at[i]][:2]
                k = line[i]
                if kind == "rare":
                    here = (docs[flat.row[k]], text)
                    if (yes := asked.get(here)) is None:
                        if len(asked) > 500_000:
                            asked.clear()
                        yes = asked[here] = any(_at(rivals, class_place(here[0], p)) for p in text.lower().split("-") if len(p) > 1)
                    if not yes:
                        continue
                    kind = "word"
                if kind == "number":
                    out.append((*where(k), kind, core(i), text, "", 0))
                else:
                    out.append((*where(k), kind, text, core(i - 1).lower() if i > first[k] else "", core(i + 1).lower() if i + 1 < first[k + 1] else "", 0))
            follows = (line[1:] == line[:-1]) & ~flat.piece[1:]
            a, b = at[:-1], at[1:]
            way = np.where(follows & (head[a] >= 0) & (tail[b] >= 0), head[a] << 32 | tail[b], -1) if len(at) else np.zeros(0, np.int64)
            hit = np.flatnonzero(way >= 0)
            for i in hit[np.isin(way[hit], ways)].tolist():
                left, right = token(i).lstrip(_PUNCT), token(i + 1).rstrip(_PUNCT)
                out.append((*where(line[i]), "pair", left + right, left.lower(), right.lower(), splits[int(way[i])]))
            for i in np.flatnonzero(follows & half[a] & figure[b]).tolist() if len(at) else ():
                left, right = token(i).lstrip(_PUNCT), token(i + 1).rstrip(_PUNCT)
                if _NUMBER.fullmatch(left + right) and (left[0] in "$€£" or left[-1] != ","):
                    out.append((*where(line[i]), "number", f"{left} {right}", left + right, "", 0))
            for k in np.flatnonzero(flat.broken).tolist():
                part = broken_word(lines[flat.row[k]][flat.number[k]])
                below = [j for j in range(k + 1, min(k + 1 + EDGE, len(flat.row))) if flat.row[j] == flat.row[k]]
                nxt = "\t".join(f"{flat.number[j]} {core(first[j])}" for j in below)
                out.append((*where(k), "break", part, nxt, ",".join(w for w in LINKS if (part + w).lower() in vocabulary), 0))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _MARKS.split(", ")])

    return run


_LOOKED = "word string, meant string, told boolean, options array<struct<c string, weight double, generic boolean>>"


def _looked_up(vocabulary: dict[str, int], common: int):
    """For each suspicious word its meaning where one candidate alone is good enough, or the
    options among which its places are to be ranked. A common word has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a word too rare to outweigh any other by an unusual edit need not be sought by one
        trie, automata = Trie(vocabulary), Automata([w for w, n in vocabulary.items() if n >= RATIO * GENERIC], MISREAD)

        def asked(part: str) -> bool:
            n = vocabulary.get(part, 0)
            return len(part) >= 3 and n < common and (not n or part.isalpha())

        for pdf in batches:
            lows = sorted({p for w in pdf["word"] for p in w.lower().split("-") if asked(p)})
            near = dict(zip(lows, automata.candidates(lows), strict=True))
            out = []
            for word, n in pdf[["word", "n"]].itertuples(index=False):
                told, parts, options = False, [], []
                alone = "-" not in word
                for part in word.split("-"):
                    low = part.lower()
                    if low not in near:
                        parts.append(part)
                        continue
                    own = max(vocabulary.get(low, 0), n if alone else 0)
                    usual = trie.candidates(low)
                    good = [(vocabulary[c] / 12.0**k, c, False) for c, k in usual.items() if not low.isalpha() or vocabulary[c] >= RATIO * own]
                    if alone and not good and low.isalpha():  # a word must be long enough for an unusual edit to say anything
                        good = [(vocabulary[c] / (12.0 * GENERIC) ** k, c, True) for c, k in near[low].items() if c not in usual and len(low) >= 3 * k + 2 and vocabulary[c] >= RATIO * GENERIC**k * max(1, own)]
                    good.sort(reverse=True)
                    if alone:
                        options = good
                    parts.append((good[0][1].capitalize() if part[:1].isupper() else good[0][1]) if good and not good[0][2] else part)
                    told |= bool(good) and not good[0][2]
                meant = "-".join(parts) if told else None
                told |= _odd(word) or any(_odd(p) for p in word.split("-"))
                ranked = [{"c": c.capitalize() if word[:1].isupper() else c, "weight": x, "generic": g} for x, c, g in options] if len(options) > 1 or any(g for _, _, g in options) else None
                if told or ranked:
                    out.append((word, meant, told, ranked))
            yield pd.DataFrame(out, columns=["word", "meant", "told", "options"])

    return run


def _pair_hash(a: Column, b: Column) -> Column:
    return F.pmod(F.xxhash64(F.concat_ws("\t", a, b)), F.lit(PAIR_BITS)).cast("int")


def _pairs(candidates: set[str], bits: np.ndarray):
    """Counts of neighbouring words of a line of which one is a candidate, as far as asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, core = Numbers(), Numbers()
        of: list[int] = []
        for pdf in batches:
            flat = Flat(pdf["raw_lines"].tolist(), numbers)
            at = flat.at
            if len(of) > len(numbers.tokens):
                of, core = [], Numbers()
            of += [core[t.strip(_PUNCT).lower()] for t in numbers.tokens[len(of) :]]
            word = np.array(of, dtype=np.int64)[at]
            asked = np.array([c in candidates for c in core.tokens], dtype=bool)
            full = np.array([c != "" for c in core.tokens], dtype=bool)
            a, b = word[:-1], word[1:]
            keep = (flat.line[1:] == flat.line[:-1]) & (asked[a] | asked[b]) & full[a] & full[b] if len(word) else np.zeros(0, bool)
            pair, n = np.unique(a[keep] << 32 | b[keep], return_counts=True)
            out = []
            for p, m in zip(pair.tolist(), n.tolist(), strict=True):
                x, y = core.tokens[p >> 32], core.tokens[p & 0xFFFFFFFF]
                if bits[_place(xxhash.xxh64_intdigest(f"{x}\t{y}", 42))]:
                    out.append((x, y, m))
            yield pd.DataFrame(out, columns=["a", "b", "n"])

    return run


def in_context(places: DataFrame, pages: DataFrame) -> DataFrame:
    """The best option at each place. places: ``left, right, options`` and other columns, which
    stay; ``meant`` is null where only unusual edits are left and no pair speaks for one."""
    some = places.withColumn("place", F.xxhash64(*places.drop("options").columns)).withColumn("o", F.explode("options")).withColumn("c", F.lower("o.c"))
    asked = some.select(F.explode(F.array(F.struct(F.col("left").alias("a"), F.col("c").alias("b")), F.struct(F.col("c").alias("a"), F.col("right").alias("b")))).alias("p")).select("p.*").where("a <> '' and b <> ''").distinct()
    asked = checkpoint(asked.withColumn("bit", _pair_hash(F.col("a"), F.col("b"))))
    bits = np.zeros(PAIR_BITS, dtype=bool)
    for (bit,) in asked.select("bit").distinct().toLocalIterator():
        bits[bit] = True
    candidates = {c for (c,) in some.select("c").distinct().toLocalIterator()}  # words of the vocabulary
    counts = pages.select("raw_lines").mapInPandas(_pairs(candidates, bits), "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).join(asked.select("a", "b"), ["a", "b"], "left_semi")
    counts = checkpoint(counts)
    with_left = some.join(counts.select(F.col("a").alias("left"), F.col("b").alias("c"), F.col("n").alias("before")), ["left", "c"], "left")
    both = with_left.join(counts.select(F.col("a").alias("c"), F.col("b").alias("right"), F.col("n").alias("after")), ["c", "right"], "left")
    before, after = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    score = F.when(~F.col("o.generic") | (before + after > 0), F.log("o.weight") + F.log1p(before) + F.log1p(after))
    best = F.max(F.when(score.isNotNull(), F.struct(score.alias("score"), F.col("o.c").alias("c"))))
    keep = [c for c in places.columns if c != "options"]
    return both.groupBy("place", *keep).agg(best.getField("c").alias("meant")).drop("place")


def _in_file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each part of a suspicious word its best candidate of the file, if there is one."""
    for pdf in batches:
        out = []
        for doc, word, base, at, part, own, others in pdf[["doc_id", "word", "base", "at", "part", "own", "others"]].itertuples(index=False):
            counts = {o["word"]: o["n"] for o in others}
            if found := Trie(counts).candidates(part.lower()):
                best = max(found, key=lambda c: (counts[c] / 12.0 ** found[c], c))
                out.append((doc, word, base, at, part.lower(), own, best))
        yield pd.DataFrame(out, columns=["doc_id", "word", "base", "at", "low", "own", "best"])


def meant_in_file(asked: DataFrame, file_words: DataFrame, counts: DataFrame) -> DataFrame:
    """``doc_id, word, here`` from ``doc_id, word, meant`` for the words of which a part that
    the vocabulary leaves as it is stands for another word of its file. Most of a word's
    occurrences must lie in files that have the other one so often, or it is a word itself."""
    part = F.posexplode(F.arrays_zip(F.split("word", "-").alias("was"), F.split(F.coalesce("meant", "word"), "-").alias("now"))).alias("at", "p")
    left = asked.select("doc_id", "word", F.coalesce("meant", "word").alias("base"), part).where("lower(p.was) = lower(p.now) and length(p.was) >= 3").select("doc_id", "word", "base", "at", F.col("p.was").alias("part"))
    least = F.expr(f"if(part rlike '^\\\\p{{L}}+$', {FILE_RATIO} * greatest(own, 1L), 1L)")
    some = left.withColumn("class", F.xxhash64("doc_id", F.xxhash64(confusion_class(F.col("part"))))).hint("shuffle_hash").join(file_words.select("class", F.struct(F.col("word"), "n").alias("w")), "class")
    own = F.coalesce(F.max(F.when(F.col("w.word") == F.lower("part"), F.col("w.n"))), F.lit(0)).cast("long")
    some = some.groupBy("doc_id", "word", "base", "at", "part").agg(own.alias("own"), F.collect_list("w").alias("all"), F.max("w.n").alias("top")).withColumn("least", least).where("top >= least")
    some = some.withColumn("others", F.expr("filter(all, x -> x.word <> lower(part) and x.n >= least)")).where("size(others) > 0").select("doc_id", "word", "base", "at", "part", "own", "others")
    best = checkpoint(some.mapInPandas(_in_file, "doc_id string, word string, base string, at int, low string, own long, best string"))
    there = best.select("doc_id", "low", "own").distinct().groupBy("low").agg(F.sum("own").alias("there"))
    sure = there.join(counts.withColumnRenamed("word", "low"), "low", "left").where("n is null or 2 * there >= n").select("low")
    told = best.join(sure, "low").groupBy("doc_id", "word", "base").agg(F.map_from_entries(F.collect_list(F.struct("at", "best"))).alias("new"))
    here = F.expr("transform(split(base, '-'), (x, i) -> if(substring(x, 1, 1) rlike '\\\\p{Lu}' and new[i] is not null, initcap(new[i]), coalesce(new[i], x)))")
    return told.select("doc_id", "word", F.concat_ws("-", here).alias("here"))


def marks(pages: DataFrame) -> DataFrame:
    """Everything that is wrong with the lines: ``doc_id, page_no, line_no, kind, word,
    meant``. ``kind`` is ``furniture``, ``hyphen`` or ``ocr``; of an ocr mark ``word`` is
    what stands there and ``meant`` what was printed (null if no word of the vocabulary
    fits); of a hyphen mark ``word`` is the first piece and ``meant`` the whole word.

    Pages with null or empty ``raw_lines``, null ``doc_id`` or ``page_no`` give no marks;
    repeated rows count once; other columns are ignored. A line that ends a file's last
    page is never broken.
    """
    return _marks_and_rests(pages)[0].distinct()


def marked_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, line_no, kind`` of the ``marks``, each once."""
    return _marks_and_rests(pages)[0].select("doc_id", "page_no", "line_no", "kind").distinct()


def _marks_and_rests(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The marks, some more than once, and in the same form what joins words broken over pages: ``over`` the first
    word of the next page for the line that it ends, ``rest`` that word for its own line, and
    ``fix`` what a misread one means for the line that it begins in."""
    pages = pages.select("doc_id", "page_no", "raw_lines").where("doc_id is not null and page_no is not null and size(raw_lines) > 0")
    seen = checkpoint(pages.mapInPandas(_read, _SEEN))
    words = seen.where("zone is null").select(F.xxhash64("doc_id", "key").alias("class"), "word", "n")
    counts = checkpoint(words.groupBy("word").agg(F.sum("n").alias("n")))
    # class: file and confusion class; only words that share theirs with another can be meant for each other
    # one shuffle: by class for both
    file_words = words.repartition("class").groupBy("class", "word").agg(F.sum("n").alias("n")).withColumn("of", F.count("*").over(Window.partitionBy("class")))
    file_words = checkpoint(file_words.where("of > 1").drop("of"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(3, VOCABULARY * total)
    vocabulary = {r["word"]: r["n"] for r in counts.where(F.col("n") >= least).toLocalIterator()}
    common = max(4 * least, COMMON * total)
    alike: Counter[str] = Counter()
    for word, n in vocabulary.items():
        alike[class_of(word)] += n
    # common words of whose occurrences half may lie in files that have others FILE_RATIO times as often
    dubious = {w for w, n in vocabulary.items() if n >= common and len(w) >= 3 and 2 * (alike[class_of(w)] - n) >= FILE_RATIO * n}

    edges = checkpoint(edge_lines(seen.where("zone is not null").drop("word", "n", "key")))
    furniture = edges.where("furniture").select("doc_id", "page_no", "line_no").distinct()
    touched = _bits(counts.where(F.col("n") < common).mapInPandas(_touched(vocabulary), "place long"))
    rivals = _bits(file_words.select(F.pmod("class", F.lit(PAIR_BITS)).alias("place")))
    suspects = checkpoint(pages.mapInPandas(_suspects(vocabulary, common, dubious, touched, rivals), _MARKS).join(furniture, ["doc_id", "page_no", "line_no"], "left_anti"))

    # a broken word goes on in the next text line of the page or in the first one of the next page
    breaks = suspects.where("kind = 'break'")
    follow = breaks.select("doc_id", "page_no", "line_no", "word", "right", F.posexplode_outer(F.filter(F.split("left", "\t"), lambda x: x != "")).alias("k", "next"))
    follow = follow.withColumn("next_line", F.split("next", " ")[0].cast("int")).withColumn("next_word", F.split("next", " ")[1])
    gone = furniture.withColumnRenamed("line_no", "next_line").withColumn("gone", F.lit(1))
    here = (
        follow.join(gone, ["doc_id", "page_no", "next_line"], "left")
        .groupBy("doc_id", "page_no", "line_no", "word", "right")
        .agg(F.min(F.when(F.col("next_line").isNotNull() & F.col("gone").isNull(), F.struct("k", "next_word", "next_line"))).alias("next"))
    )
    top = edges.where("zone = 'top' and not furniture").groupBy("doc_id", (F.col("page_no") - 1).alias("page_no")).agg(F.min(F.struct("k", "first", "line_no")).alias("over_page"))
    joined = here.join(top, ["doc_id", "page_no"], "left").select(
        "doc_id", "page_no", "line_no", "word", "right", F.coalesce("next.next_word", "over_page.first").alias("next_word"), F.coalesce("next.next_line", "over_page.line_no").alias("line_2"), F.when(F.col("next").isNull(), F.col("page_no") + 1).otherwise(F.col("page_no")).alias("page_2")
    )
    suspended = F.col("next_word").isin(*LINKS) & ~F.array_contains(F.split("right", ","), F.col("next_word"))
    lower = F.col("next_word").rlike("^[\\p{Ll}0-9!@]") & ~suspended
    joined = checkpoint(joined.where(lower & (F.col("next_word") != "")))
    hyphen = joined.select("doc_id", "page_no", "line_no", F.lit("hyphen").alias("kind"), "word", F.concat("word", F.regexp_replace("next_word", "[.,;:)]+$", "")).alias("meant"))

    whole = joined.select("doc_id", "page_no", "line_no", F.concat("word", F.btrim("next_word", F.lit(_PUNCT))).alias("word"), F.lit("").alias("left"), F.lit("").alias("right"), F.length("word").alias("cut"), "line_2", "page_2")
    words = suspects.where("kind = 'word'").select("doc_id", "page_no", "line_no", "word", "left", "right", F.lit(-1).alias("cut"), F.lit(-1).alias("line_2"), F.col("page_no").alias("page_2")).unionByName(whole)
    asked = words.groupBy("word").agg(F.count("*").alias("n"))
    meant = checkpoint(asked.mapInPandas(_looked_up(vocabulary, common), _LOOKED))
    here = checkpoint(meant_in_file(words.select("doc_id", "word").distinct().join(meant.select("word", "meant"), "word", "left"), file_words, counts))
    one = words.join(meant.where("options is null").select("word", "meant", "told"), "word", "left").drop("left", "right")
    several = meant.where("options is not null")
    if several.limit(1).count():
        places = words.join(several.select("word", "options", "told"), "word")
        several_words = several.select("word")
        one = one.join(several_words, "word", "left_anti").unionByName(in_context(places, pages).select(*one.columns))
    words = one.join(here, ["doc_id", "word"], "left").withColumn("meant", F.coalesce("here", "meant")).where("told or meant is not null")
    # a word broken over lines is misread in the line where it first differs from what was meant
    same = F.expr("aggregate(sequence(1, least(length(word), length(meant))), 0, (a, i) -> if(a = i - 1 and lower(substring(word, i, 1)) = lower(substring(meant, i, 1)), i, a))")
    later = (F.col("cut") >= 0) & (same >= F.col("cut"))
    line, page = F.when(later, F.col("line_2")).otherwise(F.col("line_no")), F.when(later, F.col("page_2")).otherwise(F.col("page_no"))
    ocr = words.where("cut < 0 or meant is not null").select("doc_id", page.alias("page_no"), line.alias("line_no"), F.lit("ocr").alias("kind"), "word", "meant")
    numbers = suspects.where("kind = 'number'").select("doc_id", "page_no", "line_no", F.lit("ocr").alias("kind"), "word", F.col("left").alias("meant"))
    pair = suspects.where("kind = 'pair'")
    rare = pair.groupBy("left", "right").agg(F.count("*").alias("n"), F.max("joined").alias("joined")).where(F.col("joined") >= SPLIT_RATIO * F.col("n")).select("left", "right")
    split = pair.join(rare, ["left", "right"]).select("doc_id", "page_no", "line_no", F.lit("ocr").alias("kind"), F.concat_ws(" ", "left", "right").alias("word"), F.col("word").alias("meant"))

    lines = furniture.select("doc_id", "page_no", "line_no", F.lit("furniture").alias("kind"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("meant"))
    moved = ocr.join(furniture, ["doc_id", "page_no", "line_no"], "left_anti")
    every = lines.unionByName(hyphen).unionByName(moved).unionByName(numbers).unionByName(split)
    turned = joined.where("page_2 <> page_no")
    over = turned.select("doc_id", "page_no", "line_no", F.lit("over").alias("kind"), "word", F.col("next_word").alias("meant"))
    rest = turned.select("doc_id", F.col("page_2").alias("page_no"), F.col("line_2").alias("line_no"), F.lit("rest").alias("kind"), F.col("next_word").alias("word"), F.lit(None).cast("string").alias("meant"))
    fix = words.where("cut >= 0 and page_2 <> page_no and meant is not null").select("doc_id", "page_no", "line_no", F.lit("fix").alias("kind"), "word", "meant")
    return every, over.unionByName(rest).unionByName(fix).distinct()


def _paragraphs(lines: list[str]) -> list[str]:
    out: list[list[str]] = []
    fresh = True
    for line in lines:
        text = " ".join(line.split())
        if not text:
            fresh = True
            continue
        item = bool(re.match(r"[-*•] |\d+[.)] ", text))
        row = bool(re.search(r"\S\s{3,}\S", line))
        if row:
            text = line.strip()
        start = fresh or item or row or line.startswith("   ")
        if start or not out:
            out.append([text])
        else:
            out[-1].append(text)
        heading = start and len(text) < 60 and not item and text[-1] not in ".,;:-" and text[:1].isupper() and all(w[:1].isupper() or w in ("and", "of", "the", "for", "to") for w in text.split())
        fresh = row or heading
    return [" ".join(x) for x in out]


_REPAIR = "array<struct<repair_type string, location array<int>, reason string, original string, repaired string>>"


def _reflow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, page, lines, told in pdf[["doc_id", "page_no", "raw_lines", "told"]].itertuples(index=False):
            lines = [x or "" for x in (lines if lines is not None else [])]
            repairs = []
            gone, broken, over, turned, rests = set(), {}, {}, {}, {}
            for m in sorted(told if told is not None else [], key=lambda m: (m["line_no"], m["kind"], m["word"] or "", m["meant"] or "")):
                i, kind, word, meant = m["line_no"], m["kind"], m["word"], m["meant"]
                if i >= len(lines):
                    continue
                if kind == "furniture":
                    gone.add(i)
                    repairs.append(("section_repair", [i, i], "removed page furniture", lines[i], ""))
                elif kind == "hyphen":
                    broken[i] = meant
                elif kind == "over":
                    turned[i] = meant
                elif kind == "rest":
                    rests[i] = word
                elif kind == "fix":
                    over[word.lower()] = (word, meant)
                elif kind == "ocr" and meant and re.search(re.escape(word), lines[i], re.I):
                    new = re.sub(re.escape(word), lambda _, x=meant: x, lines[i], count=1, flags=re.I)
                    repairs.append(("section_repair", [i, i], "misread characters", word, meant))
                    lines[i] = new
                elif kind == "ocr" and meant:  # a word broken over two lines
                    over[word.lower()] = (word, meant)
            text = [i for i in range(len(lines)) if i not in gone]
            for at, i in enumerate(text):
                if i not in broken:
                    continue
                nxt = next((j for j in text[at + 1 :] if lines[j].strip()), None)
                piece = lines[i].rstrip()[:-1]
                own = lines[i].rstrip()[-1] == "-" and broken[i] is not None and "-" in broken[i]
                if nxt is not None:
                    first, _, lines[nxt] = lines[nxt].strip().partition(" ")
                elif i in turned:  # it goes on in the next page
                    first = turned[i]
                else:
                    continue
                to = nxt if nxt is not None else i
                whole = piece + ("-" if own else "") + first
                last = whole.split()[-1].strip(_PUNCT)
                if last.lower() in over:
                    word, meant = over[last.lower()]
                    whole = whole[: whole.rindex(last)] + meant + whole[whole.rindex(last) + len(last) :]
                    repairs.append(("section_repair", [i, to], "misread characters", word, meant))
                repairs.append(("section_repair", [i, to], "joined a broken word", lines[i].split()[-1], whole.split()[-1]))
                lines[i] = whole
            for i, word in rests.items():
                first, _, after = lines[i].strip().partition(" ")
                if first == word:
                    lines[i] = after
                    repairs.append(("section_repair", [i, i], "joined a broken word to the page before", first, ""))
            out.append((doc, page, "\n\n".join(_paragraphs([lines[i] for i in text])), [dict(zip(("repair_type", "location", "reason", "original", "repaired"), x, strict=True)) for x in repairs]))
        yield pd.DataFrame(out, columns=["doc_id", "page_no", "content", "repair_applied"])


def repaired_pages(pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, content, repair_applied``: the pages' lines without furniture,
    with broken words joined, misread words replaced and paragraphs reflowed.

    One row per page with lines; of repeated rows one stands. A word broken over a page
    break ends its first page.
    """
    told = DataFrame.unionByName(*_marks_and_rests(pages))  # repeated ones fall away in the set
    each = told.groupBy("doc_id", "page_no").agg(F.collect_set(F.struct("line_no", "kind", "word", "meant")).alias("told"))
    once = pages.select("doc_id", "page_no", "raw_lines").where("doc_id is not null and page_no is not null and size(raw_lines) > 0").groupBy("doc_id", "page_no").agg(F.max("raw_lines").alias("raw_lines"))
    return once.join(each, ["doc_id", "page_no"], "left").mapInPandas(_reflow, f"doc_id string, page_no int, content string, repair_applied {_REPAIR}")
