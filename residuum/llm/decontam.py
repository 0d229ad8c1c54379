"""Benchmark decontamination through templates.

Texts become templates: numbers (digits or number words), units after numbers and names (runs of capitalised words) turn into
typed placeholders, everything else into lower-case words without signs. A capitalised word that opens a sentence may be a name or
not, and a copy may be in other case: items and documents are read with names within sentences, without names and with all of
them replaced. Windows of five template words are hash-joined with those of the benchmark items. A document is contaminated by an
item if at least 0.8 of the item's windows occur close together in it, either with the same values in all slots (``copy``), or
with other values that replace each value of the item by one value throughout (``reparameterised``): slots that change
at random are a coincidence of form, and items of fewer than ``LEAST_FORM`` windows have too little form to tell. Values are
compared along one alignment of the two, as a window that an item repeats also meets its other occurrences.

The join has two steps. Window hashes travel to the scan, which emits a row for each document and item that share enough of them:
it looks items up by their rarest windows alone (so many that one must be there), so a window of all items costs nothing. The
rows then meet the items' windows themselves in a broadcast join, and the alignment decides. Texts aren't shuffled. What is broadcast
is bounded: a benchmark of more than ``MOST_WINDOWS`` windows or ``MOST_BYTES`` is taken in slices of its items, each against all documents.

Defined cases. Null and empty texts match nothing, nor do template windows with fewer than three plain words; an item without any
other (short, or dense in numbers) is matched by its words as they are, in windows of up to five. An item of fewer than
``LEAST_RAW`` words only matches a document of just those words. Null ids of documents are reported as null; dropping goes by row (id and
text), so rows without an id or with a shared one are judged by their own text. Repeated rows count once. Empty tables:
empty result. Extra columns pass through ``drop_contaminated``.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.llm.common import released, slices, stash

WINDOW = 5
LEAST_PLAIN = 3
SIMILARITY = 0.8
LEAST_FORM, LEAST_RAW = 4, 4
MOST_WINDOWS, MOST_BYTES = 500_000, 64_000_000
#: Pieces of text that a task remembers, and bytes that it reads at a time.
MOST_KNOWN, BYTES = 1_000_000, 2_000_000
#: Placeholders; no word is written so. And what stands between documents.
NUMBER, UNIT, NAME, BETWEEN = "<number>", "<unit>", "<name>", "\x02"
#: Readings of a text: names within sentences replaced; no name replaced; all capitalised words replaced; words as they are, numbers too.
INSIDE, NO_NAMES, ALL_NAMES, RAW = 0, 1, 2, 3
#: Units that may follow a number.
UNITS = "% mm cm m km in ft yd mi mg g kg t lb oz ml l kl gal ms s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds liter liters litre litres percent dollar dollars cent cents euro euros degree degrees watt watts volt volts".split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
#: Numbers, words, and signs between sentences; signs within them (comma, apostrophe, hyphen) are left out.
_TOKENS = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|%|[^\w\s,'’%-]+|\n")
_CAPITALISED = re.compile(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+")
#: What a token may be; its code is this plus its hash, which leaves the low bits free.
WORD, CAPITALISED, DIGITS, NUMBER_WORD, UNIT_WORD, CAPITALISED_UNIT, BREAK = range(7)
KIND, HASH = np.uint64(7), ~np.uint64(7)
_FACTOR = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) & ~7 | 8  # never 0, which stands for a word that no item has


_LISTED = dict.fromkeys(NUMBER_WORDS, NUMBER_WORD) | dict.fromkeys(UNITS, UNIT_WORD)


def token_kind(token: str) -> int:
    kind = _LISTED.get(token.lower())
    if kind == NUMBER_WORD:
        return kind
    if token[0].isalpha():
        capitalised = _CAPITALISED.fullmatch(token)
        return (CAPITALISED_UNIT if kind else CAPITALISED) if capitalised else kind or WORD
    return kind or (DIGITS if token[0].isdecimal() else BREAK)


class Codes(dict):
    """Codes of the tokens of texts. Arrow splits texts at white space, which no token spans; each different piece is read once.

    Words that no item has (not in ``known``, where given) hash to 0. The mapping is of pieces to their numbers.
    """

    def __init__(self, known: frozenset[str] | None = None):
        self.words = known
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat, self.begins = array("Q", [WORD]), array("q", [0, 1])
        self[BETWEEN] = 0

    def __missing__(self, piece: str) -> int:
        flat, known = self.flat, self.words
        if piece.isalpha() and piece.islower() and piece not in _LISTED:
            flat.append(word_hash(piece) if known is None or piece in known else 0)
        else:
            for token in _TOKENS.findall(piece):
                lower = token.lower()
                flat.append(token_kind(token) | (word_hash(lower) if known is None or lower in known else 0))
        self.begins.append(len(flat))
        self[piece] = n = len(self)
        return n

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all tokens and where each text ends; a foreign word and a break are added to each, so that no window spans two."""
        if len(self) > MOST_KNOWN:
            self.forget()
        ended = pc.binary_join_element_wise(pc.replace_substring(texts, "\n", " ; "), f" {BETWEEN} ;", "")
        parts = pc.utf8_split_whitespace(ended)
        pieces = parts.flatten().dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces.dictionary)], pieces.dictionary), "\x1f")[0].as_py().split("\x1f")  # one long text is faster than many short ones
        if len(distinct) != len(pieces.dictionary):
            distinct = pieces.dictionary.to_pylist()
        at = np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))[pieces.indices.to_numpy()]
        begins, flat = np.frombuffer(self.begins, np.int64), np.frombuffer(self.flat, np.uint64)
        sizes = begins[at + 1] - begins[at]
        ends = np.cumsum(sizes)
        counts = pc.list_value_length(parts).to_numpy()
        return flat[np.repeat(begins[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends[np.cumsum(counts, dtype=np.int64) - 1]


@dataclass(frozen=True)
class Template:
    """Template words: their hashes, whether each is a slot, where each begins in ``words`` (one more entry at the end), and the tokens that are words."""

    hashes: np.ndarray
    slot: np.ndarray
    begin: np.ndarray
    words: np.ndarray

    def window_hashes(self, size: int) -> np.ndarray:
        """Hash of each window of ``size``; 0 where a word is foreign or too few are plain."""
        n = len(self.hashes) - size + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        own, total = np.ones(n, bool), np.zeros(n, np.uint64)
        for k in range(size):
            own &= self.hashes[k : k + n] != 0
            total += self.hashes[k : k + n] * _FACTOR[k]
        slots = np.r_[0, np.cumsum(self.slot)]
        own &= slots[size:] - slots[:-size] <= WINDOW - LEAST_PLAIN
        return np.where(own, total | np.uint64(1), np.uint64(0))

    def window(self, tokens: list[str], place: int, size: int, skipped: int = 0) -> tuple[str, list[str]]:
        """Words of the window and the values in its slots; ``tokens`` begin after the ``skipped`` first."""
        out, values = [], []
        for j in range(place, place + size):
            said = " ".join(tokens[k - skipped].lower() for k in self.words[self.begin[j] : self.begin[j + 1]])
            if self.slot[j]:
                values.append(said)
                said = next(p for p in (NUMBER, UNIT, NAME) if word_hash(p) == int(self.hashes[j]))
            out.append(said)
        return " ".join(out), values


def template(codes: np.ndarray, reading: int) -> Template:
    """One reading of a sequence of tokens."""
    kind = codes & KIND
    words = np.flatnonzero(kind != BREAK)
    kind, hashes = kind[words], codes[words] & HASH
    opens = np.diff(words, prepend=-2) > 1
    follows = lambda x: np.r_[False, x[:-1]] & ~opens
    if reading == RAW:
        return Template(hashes, np.zeros(len(words), bool), np.arange(len(words) + 1), words)
    number = (kind == DIGITS) | (kind == NUMBER_WORD)
    unit = ((kind == UNIT_WORD) | (kind == CAPITALISED_UNIT)) & follows(number)
    name = ((kind == CAPITALISED) | (kind == CAPITALISED_UNIT)) & ~unit
    name &= (reading == ALL_NAMES) | (reading == INSIDE) & ~opens
    spelt = kind == NUMBER_WORD
    begin = np.flatnonzero(~(name & follows(name) | spelt & follows(spelt)))  # a run of names, or of number words, is one slot
    hashes = np.where(name, word_hash(NAME), np.where(number, word_hash(NUMBER), np.where(unit, word_hash(UNIT), hashes))).astype(np.uint64)
    return Template(hashes[begin], (name | number | unit)[begin], np.r_[begin, len(words)], words)


_WINDOW = pa.struct([("place", pa.int32()), ("window", pa.string()), ("slots", pa.list_(pa.string()))])
WINDOWS = "windows array<struct<place:int,window:string,slots:array<string>>>"


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, variant, size, windows``: each item's windows of each reading that differs; ``RAW`` ones, of ``size`` words, for items without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, seen = _TOKENS.findall(text), []
                coded = codes.of(pa.array([text]))[0][:-2]
                for variant in (INSIDE, NO_NAMES, ALL_NAMES, RAW):
                    read = template(coded, variant)
                    size = WINDOW if variant != RAW else min(WINDOW, len(read.hashes))
                    found = [(int(p), *read.window(tokens, p, size)) for p in np.flatnonzero(read.window_hashes(size))] if size else []
                    if found and found not in seen and (variant != RAW or not seen):
                        seen.append(found)
                        rows.append((i, variant, size, [dict(zip(("place", "window", "slots"), x)) for x in found]))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.list_(_WINDOW)))], names=["item", "variant", "size", "windows"])

    texts = items.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"item long, variant int, size int, {WINDOWS}")


@dataclass
class Index:
    """The items of one reading and size: ``hashes`` of their windows, sorted; each item's places in it, and how many it may miss; the items that list a window among their rarest."""

    hashes: np.ndarray
    items: list[tuple[int, np.ndarray, int]]
    rarest: dict[int, list[int]]

    def candidates(self, met: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Items (and their places) of which enough windows are among ``met``."""
        for k in sorted({k for m in met.tolist() for k in self.rarest.get(m, ())}):
            item, own, miss = self.items[k]
            if np.isin(own, met).sum() >= len(own) - miss:
                yield item, own


def indexes(rows: list[tuple[int, int, int, list[str]]], similarity: float) -> dict[tuple[int, int], Index]:
    """``rows``: item, variant, size, windows."""
    by: dict[tuple[int, int], list[tuple[int, np.ndarray, int]]] = defaultdict(list)
    for item, variant, size, windows in rows:
        hashes = [np.uint64(sum(word_hash(w) * int(f) for w, f in zip(words.split(" "), _FACTOR)) & (1 << 64) - 1 | 1) for words in windows]
        by[variant, size].append((item, np.unique(np.array(hashes, np.uint64)), int(len(windows) * (1 - similarity) + 1e-9)))
    out = {}
    for key, items in by.items():
        hashes, often = np.unique(np.concatenate([h for _, h, _ in items]), return_counts=True)
        placed = [(item, np.searchsorted(hashes, h), miss) for item, h, miss in items]
        rarest = defaultdict(list)
        for k, (_, own, miss) in enumerate(placed):
            for m in own[np.argsort(often[own], kind="stable")][: miss + 1].tolist():  # of so many, one is in every match
                rarest[m].append(k)
        out[key] = Index(hashes, placed, dict(rarest))
    return out


def matches(docs: DataFrame, items: list[tuple[int, int, int, list[str]]], id_col: str, text_col: str, similarity: float) -> DataFrame:
    """``id, key, item, variant, words, windows``: rows and items that may share enough windows, with the row's windows that the item has (by hash); ``key``: hash of the text."""
    known = frozenset(w for *_, windows in items for words in windows for w in words.split(" "))
    shared = docs.sparkSession.sparkContext.broadcast((known, indexes(items, similarity)))  # bounded by MOST_WINDOWS and MOST_BYTES

    def scan(batch: pa.RecordBatch, codes: Codes, found: dict[tuple[int, int], Index]) -> Iterator[tuple]:
        ids, keys, texts = batch.columns
        coded, ends = codes.of(texts)
        reads = {variant: template(coded, variant) for variant, _ in found}
        for (variant, size), index in found.items():
            read = reads[variant]
            hashes = read.window_hashes(size)
            at = np.flatnonzero(hashes)
            place = np.minimum(np.searchsorted(index.hashes, hashes[at]), len(index.hashes) - 1)
            same = index.hashes[place] == hashes[at]
            at, place = at[same], place[same]
            owner = np.searchsorted(ends, read.words[read.begin[at]], "right")
            last = np.searchsorted(read.words[read.begin[:-1]], ends - 2)  # place of each document's end among the template's words
            for d in np.unique(owner).tolist():
                mine, tokens = owner == d, None
                first = int(last[d - 1]) + 1 if d else 0
                for item, own in index.candidates(np.unique(place[mine])):
                    hits = at[mine][np.isin(place[mine], own)].tolist()
                    tokens = tokens or _TOKENS.findall(texts[d].as_py())
                    windows = [dict(zip(("place", "window", "slots"), (p - first, *read.window(tokens, p, size, int(ends[d - 1]) if d else 0)))) for p in hits]
                    yield ids[d].as_py(), keys[d].as_py(), item, variant, int(last[d]) - first, windows

    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(_WINDOW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = shared.value
        codes = Codes(known)
        for batch in released(batches):
            for some in slices(batch, 2, 10_000, BYTES):
                if rows := list(scan(some, codes, found)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["id", "key", "item", "variant", "words", "windows"])

    texts = docs.filter(F.col(text_col).isNotNull())
    return texts.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, f"id long, key long, item long, variant int, words int, {WINDOWS}")


def judge(own: list[dict], met: list[dict], similarity: float = SIMILARITY) -> tuple[str | None, float]:
    """(kind, share of the item's windows) of the best alignment between an item's windows and a document's."""
    where: dict[str, list[dict]] = defaultdict(list)
    for x in met:
        where[x["window"]].append(x)
    # a copy lies within twice the item's length: two sets of bands of offsets, shifted by half, so that one band holds it whole;
    # and each exact offset alone, as copies side by side share a band
    width = 2 * len(own) + 2 * WINDOW
    bands: dict[tuple[int, int], list[tuple[int, int, list[str], list[str]]]] = defaultdict(list)
    for x in own:
        for y in where.get(x["window"], ()):
            offset = y["place"] - x["place"]
            for band in ((0, offset // width), (1, (offset + width // 2) // width), (2, offset)):
                bands[band].append((x["place"], offset, x["slots"], y["slots"]))
    best: tuple[str | None, float] = (None, 0.0)
    for pairs in bands.values():
        alike = len({p for p, *_ in pairs})
        if alike < similarity * len(own) - 1e-9:
            continue
        often = Counter(offset for _, offset, *_ in pairs)
        main = min(often, key=lambda o: (-often[o], o))
        aligned = {}  # of a place's hits, the one nearest the band's main offset
        for place, offset, old, new in sorted(pairs, key=lambda x: (abs(x[1] - main), x[1])):
            aligned.setdefault(place, (old, new))
        equal = {place for place, _, old, new in pairs if old == new}
        said = {pair for old, new in aligned.values() for pair in zip(old, new)}
        agreed = len(said) == len({old for old, _ in said})
        kind = "copy" if len(equal) >= similarity * len(own) - 1e-9 else "reparameterised" if agreed and len(own) >= LEAST_FORM else None
        if kind:
            best = min(best, (kind, alike / len(own)), key=lambda x: (x[0] or "~", -x[1]))
    return best


def _contaminated(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    rows = [(r["item"], r["variant"], r["size"], r["w"]) for r in items.select("item", "variant", "size", F.col("windows.window").alias("w")).collect()]  # at most MOST_WINDOWS
    met = matches(docs, rows, id_col, text_col, similarity)
    own = items.select("item", "variant", "size", F.col("windows").alias("own"))
    met = met.join(F.broadcast(own), ["item", "variant"]).filter(f"size >= {LEAST_RAW} OR words = size").select("id", "key", "item", "own", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(x, y, similarity) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            kinds, shares = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(kinds, pa.string()), pa.array(shares, pa.float64())], names=["id", "key", "item", "kind", "contained"])

    judged = met.mapInArrow(run, "id long, key long, item long, kind string, contained double").filter("kind IS NOT NULL")
    return judged.groupBy("id", "key", "item").agg(F.min("kind").alias("kind"), F.max("contained").alias("contained"))


def found(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, most_windows: int = MOST_WINDOWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``id, key, item, kind, contained`` of each row and item that it holds; ``key`` is ``xxhash64`` of the text."""
    windows = stash(item_windows(items, item_col, item_text_col), "item-windows")
    said = F.aggregate("windows", F.lit(0).cast("long"), lambda n, x: n + F.length(x["window"]) + F.length(F.array_join(x["slots"], " ")) + 24)
    n, size = windows.agg(F.coalesce(F.sum(F.size("windows")), F.lit(0)), F.coalesce(F.sum(said), F.lit(0))).first()
    slices = max(1, -(-n // most_windows), -(-size // most_bytes))
    parts = [_contaminated(docs, windows.filter(F.pmod(F.xxhash64("item"), F.lit(slices)) == k), id_col, text_col, similarity) for k in range(slices)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, kind, contained`` of each pair of a document and an item that it holds; options as of ``found``."""
    pairs = found(docs, items, **options).groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))
    return pairs.agg(F.min("kind").alias("kind"), F.max("contained").alias("contained"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    leaks = found(docs, items, id_col, text_col, **options).select(F.col("id").alias("__id"), F.col("key").alias("__key")).distinct()
    leaks = stash(leaks, "contaminated")
    return docs.join(leaks, docs[id_col].cast("long").eqNullSafe(leaks["__id"]) & (F.xxhash64(docs[text_col]) == leaks["__key"]), "left_anti")
