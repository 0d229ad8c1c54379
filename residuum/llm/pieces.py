"""Encoding and decoding with a SentencePiece BPE model by vectorised merge rounds.

A batch of texts becomes one flat byte array, each text with the space that the model puts before it. It is cut where a run of
spaces begins, and only the batch's different words (Arrow finds them) are merged. Those lie in flat numpy arrays of symbols, cut further
where no piece of the vocabulary holds the two characters side by side, as no merge can cross such a place. In a round every segment finds its
least pair rank, all its pairs of that rank are merged at once from the left, and the arrays are compacted; segments without a
pair leave, until none is left. A merge may make a pair of a still smaller rank (the vocabulary has words that were learnt by another way): where
one of several merges of a segment would, only the leftmost is done, so that the result is that of one merge at a time.

Characters outside the vocabulary become their bytes. Decoding gathers the pieces' bytes from one flat table, drops the space that was put
before the text, and gives U+FFFD for each byte that is no UTF-8, as the library does.

Models: BPE with byte fallback that leaves texts as they are but for the space before them, without pieces of the user; others are refused.
Defined cases. Null and empty texts: the end id alone, which decodes to an empty text. U+2581 in a text decodes as a space, since the model
writes spaces so. Control names in a text (``</s>``) are ordinary text. Very long texts and words are encoded whole. Repeated rows and null ids:
each its own row. Empty table: empty result. Other columns pass through; one named like a result is replaced.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.llm.common import slices

#: The character that stands for a space.
SPACE = "▁"
#: The most texts and bytes of text that are encoded at a time, and ids that are decoded at a time; a longer text is worked on alone.
BATCH_ROWS, BATCH_BYTES, BATCH_IDS = 5_000, 3_000_000, 250_000
NONE = np.iinfo(np.int32).max

codecs.register_error("residuum-each", lambda e: ("�", e.start + 1))


class PairTable:
    """Pairs of numbers -> a number, in an open-addressed table that whole arrays are looked up in."""

    def __init__(self, left: list[int], right: list[int], value: list[int]):
        self.bits = max(8, int(8 * len(value)).bit_length())
        self.keys, self.values = np.full((1 << self.bits) + 64, -1, np.int64), np.full((1 << self.bits) + 64, NONE, np.int32)
        for key, slot, v in zip(*(x.tolist() for x in self._slots(np.array(left, np.int64), np.array(right, np.int64))), value):
            while self.keys[slot] >= 0:
                slot += 1
            self.keys[slot], self.values[slot] = key, v

    def _slots(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 32 | right
        return key, (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Values of the pairs, ``NONE`` where there is none. Negative symbols are in no pair."""
        key, slot = self._slots(left, right)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        off = np.flatnonzero((found != key) & (found >= 0))
        while len(off):
            slot[off] += 1
            found = self.keys[slot[off]]
            same = found == key[off]
            out[off[same]] = self.values[slot[off[same]]]
            off = off[~same & (found >= 0)]
        return out


class PieceModel:
    """The tables of a model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        probe = "  a  ﬁ́ \t"
        if library.normalize(probe) != (" " + probe).replace(" ", SPACE):
            raise ValueError(f"{path}: only models that leave texts as they are, but for a space before them, are supported")
        ids = range(library.vocab_size())
        byte = {i: int(library.id_to_piece(i)[3:-1], 16) for i in ids if library.is_byte(i)}
        normal = {library.id_to_piece(i): i for i in ids if not (i in byte or library.is_control(i) or library.is_unknown(i))}
        scores = {i: library.get_score(i) for i in normal.values()}
        if len(byte) != 256 or any(library.is_unused(i) for i in ids) or any(s > 0 or s % 1 for s in scores.values()):
            raise ValueError(f"{path}: only BPE models with byte fallback and without unused pieces are supported")
        self.byte_ids = np.zeros(256, np.int32)
        for i, b in byte.items():
            self.byte_ids[b] = i
        by_score = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: Piece id -> rank of its score; equal scores share one.
        self.rank = np.full(len(ids) + 1, NONE, np.int32)
        for i, s in scores.items():
            self.rank[i] = by_score[s]
        left, right, made = [], [], []
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                if (a := normal.get(piece[:k])) is not None and (b := normal.get(piece[k:])) is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
        self.pairs = PairTable(left, right, made)
        chars = {c: i for c, i in normal.items() if len(c) == 1}
        beside = sorted({(chars[p[k]], chars[p[k + 1]]) for p in normal for k in range(len(p) - 1) if p[k] in chars and p[k + 1] in chars})
        self.beside = PairTable([a for a, _ in beside], [b for _, b in beside], [0] * len(beside))
        #: Code point -> symbol: the id of its piece, or below 0 for one that the vocabulary lacks.
        self.symbol = -1 - np.arange(0x110000, dtype=np.int32)
        for c, i in chars.items():
            self.symbol[ord(c)] = i
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]
        unknown = " ⁇ ".encode()
        surface = [bytes([byte[i]]) if i in byte else b"" if library.is_control(i) else unknown if library.is_unknown(i) else library.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.concatenate(([0], np.cumsum([len(x) for x in surface])))
        #: Whether a piece that opens a text loses its first space; whether it shows nothing.
        self.opens = np.zeros(len(ids), bool)
        self.opens[[i for p, i in normal.items() if p[0] == SPACE]] = True
        self.hidden = np.array([not x for x in surface])

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and starts of segments after all merges."""
        n = len(starts)
        number = np.repeat(np.arange(n), np.diff(starts, append=len(symbols)))
        done_symbols, done_number = [], []
        if len(symbols):
            last = np.append(number[1:] != number[:-1], True)
            pair = np.where(last, NONE, self.pairs.get(symbols, np.append(symbols[1:], 0)))
        else:
            pair = np.zeros(0, np.int32)
        while len(symbols):
            rank = self.rank[np.minimum(pair, len(self.rank) - 1)]  # the last entry is NONE
            starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            sizes = np.diff(starts, append=len(symbols))
            least = np.minimum.reduceat(rank, starts)
            live = np.repeat(least != NONE, sizes)
            if not live.all():
                done_symbols.append(symbols[~live])
                done_number.append(number[~live])
                symbols, number, pair, rank = symbols[live], number[live], pair[live], rank[live]
                sizes, least = sizes[least != NONE], least[least != NONE]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            # of pairs that overlap, every other one from the left
            fresh = np.append(True, np.diff(at) != 1)
            at = at[(np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 0]
            at = at[self._together(symbols, number, pair, at)]
            symbols[at] = pair[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # their places after compaction
            symbols, number, pair = symbols[keep], number[keep], pair[keep]
            near = np.concatenate((at, at[at > 0] - 1))
            near_next = np.minimum(near + 1, len(symbols) - 1)
            same = (number[near] == number[near_next]) & (near_next > near)
            pair[near] = np.where(same, self.pairs.get(symbols[near], symbols[near_next]), NONE)
        symbols, number = np.concatenate(done_symbols or [symbols]), np.concatenate(done_number or [number])
        order = np.argsort(number, kind="stable")
        return symbols[order], np.concatenate(([0], np.cumsum(np.bincount(number, minlength=n))))

    def _together(self, symbols: np.ndarray, number: np.ndarray, pair: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the merges can be done in one round: all of a segment's, or its leftmost where one of them makes a pair that goes before the rest."""
        own = number[at]
        first = np.append(True, own[1:] != own[:-1])
        if first.all():
            return first
        made, end = pair[at], len(symbols) - 1
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, end)
        joined = np.append(False, (at[1:] - at[:-1] == 2) & ~first[1:])  # the neighbour to the left is merged as well
        left = np.where(joined, np.append(0, made[:-1]), symbols[before])
        left = self.pairs.get(left, made)
        right = self.pairs.get(made, symbols[after])
        top = len(self.rank) - 1
        sooner = ((number[before] == own) & (at > 0) & (self.rank[np.minimum(left, top)] <= self.rank[made])) | ((number[after] == own) & (at + 2 <= end) & (self.rank[np.minimum(right, top)] <= self.rank[made]))
        segment = np.cumsum(first) - 1
        return first | (np.bincount(segment, sooner)[segment] == 0)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, flat, and where each word's begin."""
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_py()
        code = np.frombuffer(data.encode("utf-32-le"), np.uint32)
        symbols = self.symbol[code]
        cut = np.ones(len(symbols), bool)
        if len(symbols) > 1:
            cut[1:] = self.beside.get(symbols[:-1], symbols[1:]) == NONE
            cut[ends[:-1][ends[:-1] < len(symbols)]] = True
        merged, starts = self.merge(symbols.copy(), np.flatnonzero(cut))
        # a segment belongs to the word that its first character is in
        word = np.searchsorted(ends, np.flatnonzero(cut), "right")
        counts = np.bincount(word, np.diff(starts), minlength=len(words)).astype(np.int64)
        lost = np.flatnonzero(merged < 0)
        if not len(lost):
            return merged, np.concatenate(([0], np.cumsum(counts)))
        raw = [chr(-1 - c).encode() for c in merged[lost].tolist()]
        sizes = np.ones(len(merged), np.int64)
        sizes[lost] = [len(x) for x in raw]
        ids = np.repeat(merged, sizes)
        ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        of = np.repeat(np.arange(len(words)), counts)
        return ids, np.concatenate(([0], np.cumsum(np.bincount(of, sizes, minlength=len(words)).astype(np.int64))))

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, each closed by ``end``, and offsets."""
        led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(texts, "").cast(pa.large_string()), pa.scalar("", pa.large_string()))
        full = np.flatnonzero(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
        led = led.take(pa.array(full))  # an empty text has no space before it
        counts = np.zeros(len(texts), np.int64)
        flat = np.zeros(0, np.int32)
        if len(full):
            offsets, data = np.frombuffer(led.buffers()[1], np.int64)[led.offset : led.offset + len(led) + 1], led.buffers()[2]
            raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
            # the last byte of U+2581 hinders a cut as a space does, since the two may be one piece
            starts = raw == 32
            starts[1:] &= (raw[:-1] != 32) & (raw[:-1] != SPACE.encode()[-1])
            begin = offsets[:-1] - offsets[0]
            starts[begin] = True
            at = np.flatnonzero(starts)
            words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(raw))), pa.py_buffer(raw)).dictionary_encode()
            ids, first = self.words(words.dictionary.cast(pa.string()))
            index = words.indices.to_numpy()
            sizes = np.diff(first)[index]
            to = np.concatenate(([0], np.cumsum(sizes)))
            flat = ids[np.repeat(first[index] - to[:-1], sizes) + np.arange(to[-1])]
            edges = to[np.searchsorted(at, np.append(begin, len(raw)))]
            counts[full] = np.diff(edges)
        offsets = np.concatenate(([0], np.cumsum(counts)))
        if end is None:
            return flat, offsets
        return np.insert(flat, offsets[1:], end), offsets + np.arange(len(offsets))

    def decode(self, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of ids."""
        sizes = np.diff(self.surface_at)[flat]
        to = np.concatenate(([0], np.cumsum(sizes)))
        raw = self.surface[np.repeat(self.surface_at[flat] - to[:-1], sizes) + np.arange(to[-1])].tobytes()
        shown = np.flatnonzero(~self.hidden[flat])
        first = np.searchsorted(shown, offsets[:-1])
        first = np.where(first < len(shown), shown[np.minimum(first, len(shown) - 1)] if len(shown) else 0, len(flat))
        strip = np.array([f < e and bool(self.opens[flat[f]]) for f, e in zip(first, offsets[1:])], bool)
        begin, end = to[offsets[:-1]] + strip, to[offsets[1:]]
        # bytes on the two sides of an id that shows nothing make no character together
        apart = to[np.flatnonzero(self.hidden[flat])]
        cuts = zip(np.searchsorted(apart, begin, "right").tolist(), np.searchsorted(apart, end).tolist())
        text = lambda a, b: raw[a:b].decode("utf-8", "residuum-each")
        return [text(a, b) if i >= j else "".join(text(*x) for x in pairwise([a, *apart[i:j].tolist(), b])) for a, b, (i, j) in zip(begin.tolist(), end.tolist(), cuts)]


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """The tables, once a worker."""
    return PieceModel(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids", end: int | None = 2) -> DataFrame:
    """``docs`` with ``out``: the ids of each whole text, closed by ``end`` (none if null). Every task needs the model file at ``path``."""
    docs = docs.drop(out) if out != text_col else docs
    names = [c for c in docs.columns if c != text_col]
    put = docs.select(F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*put.schema.fields[1:], T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, BATCH_ROWS, BATCH_BYTES):
                flat, offsets = model(path).encode(part.column(0), end)
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], ids], names=[*names, out])

    return put.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``: the text of the ids (null: empty)."""
    encoded = encoded.drop(out) if out != ids_col else encoded
    names = [c for c in encoded.columns if c != ids_col]
    put = encoded.select(F.coalesce(F.col(f"`{ids_col}`").cast("array<int>"), F.array().cast("array<int>")).alias("__ids"), *[F.col(f"`{c}`") for c in names])
    kept = [] if out == ids_col else [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*put.schema.fields[1:], *kept, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto, at = batch.column(0).offsets.to_numpy(), 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(upto, upto[at] + BATCH_IDS, "right")) - 1)
                part, at = batch.slice(at, stop - at), stop
                lists = part.column(0)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                texts = model(path).decode(lists.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0])
                columns = [*part.columns[1:], *([lists] if kept else []), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return put.mapInArrow(run, schema)
