"""Token ids as canonical length-limited Huffman codes in independent blocks.

1. Texts are range-partitioned by id and tokenized; ids are stored once, in blocks of whole documents, and each task counts its
   own. A text is cut at single spaces and line ends that stand between other characters, where a byte-level pre-tokenizer
   always cuts too, so that a piece met before costs a table look-up instead of an encoding.
2. Token counts of the whole corpus (one row a token id) give the code: package-merge, lengths of at most ``LIMIT`` bits.
3. Blocks are coded one by one, without a shuffle: the codes, the bit offset of every ``EVERY``-th token (checkpoints), and per
   document its id and length. A block needs only the code book, so blocks decode anywhere, and all its checkpoints at once.

The format is a folder: ``codes`` (token, bits) and ``blocks`` (part, block, start, ids, lengths, checkpoints, payload), both
Parquet, so that Spark's committer makes a lost task harmless and any store that Spark can read will do.
Defined cases. Null and empty texts: only the end id. Null ids sort first. Repeated ids: in the fixed order of
their texts' hash.
Empty table: an empty folder that reads back as no rows. Extra columns are not stored.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residuum.llm.common import discard, new_path, slices

LIMIT = 20
#: The longest code that the 32-bit writer takes.
MOST_LIMIT = 25
#: Bytes of text that a range is meant to hold, and that are tokenized at a time.
RANGE_BYTES, BATCH_BYTES = 16_000_000, 64_000_000
EVERY = 256
BLOCK_TOKENS = 1 << 18
#: Pieces that a worker remembers; about 150 bytes each.
MOST_PIECES = 700_000


#: ASCII signs, as in string.punctuation.
SIGNS = string.punctuation
#: Marks where a text is cut.
CUT = "\x00"
#: A text that has this (in RE2) is cut by ``BETWEEN`` alone: white space that isn't single, or isn't a space or a line end, or the mark.
ODD = r"^[ \n]|[ \n]$|[ \n][ \n]|[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BETWEEN = re.compile(r"(?<=\S)(?= \S)")


def _byte_chars() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary: itself if printable, else from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


class PieceTokenizer:
    """``tokenizers`` over pieces of text, each different piece encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        #: Whether a run of letters is a unit whose bytes go to the library's model as they are.
        self.plain = not made["normalizer"] and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        self.new: list[str] = []
        self.count, self.known, self.numbers = 0, {}, _Numbers(self)
        self.flat, self.used = np.empty(1 << 16, self.dtype), 0
        self.starts, self.lengths = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def encode(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """Ids of each text and ``end``. Arrow cuts the texts and finds the batch's different pieces; only those are looked up."""
        if self.count > MOST_PIECES:
            self.forget()
        odd = pc.match_substring_regex(texts, ODD)
        cut = pc.replace_substring(pc.replace_substring(pc.if_else(odd, "", texts), " ", f"{CUT} "), "\n", f"{CUT}\n{CUT}")
        parts = pc.split_pattern(cut, CUT)
        pieces = parts.flatten().dictionary_encode()
        different = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces.dictionary)], pieces.dictionary), CUT)[0].as_py()  # one long text is faster than many short ones
        at = self._look_up(different.split(CUT))[pieces.indices.to_numpy()]
        odd_at = {int(k): self._look_up(BETWEEN.split(texts[int(k)].as_py())) for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False))}
        self._learn()
        out = self._ids(at, np.cumsum(pc.list_value_length(parts).to_numpy()), end)
        for k, own in odd_at.items():
            out[k] = self._ids(own, np.array([len(own)]), end)[0]
        return out

    def _look_up(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))

    def _ids(self, at: np.ndarray, ends: np.ndarray, end: int) -> list[np.ndarray]:
        """Ids of the pieces ``at``, cut where texts end."""
        lengths = self.lengths[at]
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.flat[np.repeat(self.starts[at] - offsets[:-1], lengths) + np.arange(offsets[-1])]
        cuts = offsets[ends]
        return [np.append(ids[a:b], self.dtype(end)) for a, b in zip([0, *cuts[:-1]], cuts)]

    def _letters(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit that is not cut further, by the library's model."""
        if unit not in self.known:
            written = unit.replace(" ", BYTE_CHARS[32]) if unit.isascii() else unit.encode().decode("latin-1").translate(BYTE_CHARS)
            self.known[unit] = tuple([t.id for t in self.model.tokenize(written)])
        return self.known[unit]

    def _simple(self, piece: str) -> tuple[int, ...] | None:
        """Ids of letters with or without signs after them: two units at most, as no white space or digit is near."""
        core = piece.rstrip(SIGNS)
        if self.plain and core.removeprefix(" ").isalpha():
            return self._letters(core) + (self._letters(piece[len(core) :]) if len(core) < len(piece) else ())
        return None

    def _learn(self) -> None:
        if not self.new:
            return
        found = [self._simple(x) for x in self.new]
        hard = [k for k, x in enumerate(found) if x is None]
        for k, x in zip(hard, self.tokenizer.encode_batch([self.new[k] for k in hard], add_special_tokens=False)):
            found[k] = x.ids
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), self.dtype, int(lengths.sum()))
        self.flat = _room(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts, self.lengths = _room(self.starts, self.count), _room(self.lengths, self.count)
        a = self.count - len(found)
        self.lengths[a : self.count] = lengths
        self.starts[a : self.count] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.new = []


class _Numbers(dict):
    """Piece -> its number; a piece not met before gets the next number and is put down for encoding."""

    def __init__(self, owner: PieceTokenizer):
        self.owner = owner

    def __missing__(self, piece: str) -> int:
        number = self[piece] = self.owner.count
        self.owner.count += 1
        self.owner.new.append(piece)
        return number


def _room(array: np.ndarray, least: int) -> np.ndarray:
    if least <= len(array):
        return array
    return np.concatenate((array, np.empty(max(least, 2 * len(array)) - len(array), array.dtype)))


_TOKENIZERS: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    """One a worker, as workers outlive tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = PieceTokenizer(path)
    return _TOKENIZERS[path]


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); ``counts`` are positive."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit into codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    packages, is_leaf = np.empty(0), []
    for _ in range(limit):
        merged = np.concatenate((leaves, packages))
        by = np.argsort(merged, kind="stable")
        is_leaf.append(by < n)
        merged = merged[by]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(is_leaf):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code of the symbols that have a length; also its decoding table."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        by = np.lexsort((symbols, lengths))
        self.symbols, self.bits = symbols[by], lengths[by].astype(np.int64)
        self.width = int(self.bits.max()) if len(by) else 1
        span = np.left_shift(1, self.width - self.bits)
        first = np.cumsum(span) - span
        self.codes = first >> (self.width - self.bits)
        top = int(symbols.max()) + 1 if len(by) else 1
        self.code_of, self.bits_of = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code_of[self.symbols], self.bits_of[self.symbols] = self.codes, self.bits
        self._span = span

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit offset of each id."""
        bits = self.bits_of[ids]
        at = np.cumsum(bits) - bits
        n_bits = int(at[-1] + bits[-1]) if len(ids) else 0
        value = self.code_of[ids] << (32 - bits - (at & 7)).astype(np.uint64)
        byte, size = at >> 3, (n_bits + 7) // 8
        out = np.zeros(size + 4)
        for k in range(4):
            out += np.bincount(byte + k, weights=((value >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64), minlength=size + 4)
        return out[:size].astype(np.uint8).tobytes(), at

    def table(self) -> np.ndarray:
        """By the next ``width`` bits: the symbol, shifted by six bits, and the length of its code below."""
        out = np.ones(1 << self.width, np.int64)
        out[: int(self._span.sum())] = np.repeat(self.symbols << 6 | self.bits, self._span)
        return out

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int, every: int, table: np.ndarray) -> np.ndarray:
        """All checkpoints advance together, one token a step."""
        bytes_ = np.frombuffer(payload + bytes(every * self.width // 8 + 8), np.uint8).astype(np.int64)
        window = (bytes_[:-3] << 24) | (bytes_[1:-2] << 16) | (bytes_[2:-1] << 8) | bytes_[3:]
        at, steps = np.array(checkpoints, np.int64), min(every, n)
        out = np.empty((steps, len(at)), np.int64)
        shift, mask = 32 - self.width, (1 << self.width) - 1
        for k in range(steps):
            out[k] = table[(window[at >> 3] >> (shift - (at & 7))) & mask]
            at += out[k] & 63
        return (out >> 6).T.reshape(-1)[:n]


def tokenize(docs: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of token ids, in ranges of the id: ``part, block, start, n, ids, lengths, raw`` (``start`` within the range, ``raw`` little-endian);
    ``part`` rises with the id. A task's last row has no ``raw`` but the ``symbols`` that it has met and their ``counts``."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, tally = tokenizer(path), TaskContext.get().partitionId(), np.zeros(1, np.int64)
        block, start, ids, parts, held = 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            raw = np.concatenate(parts)
            return _one_row(_RAW, part, block, start, held, ids, [len(x) for x in parts], raw.astype(raw.dtype.newbyteorder("<")).tobytes(), None, None)

        for batch in batches:
            for some in slices(batch, 1, 1024, BATCH_BYTES):
                for id_, found in zip(some.column(0).to_pylist(), tok.encode(some.column(1), end)):
                    if parts and held + len(found) > BLOCK_TOKENS:
                        tally = _added(tally, parts)
                        yield flush()
                        block, start, ids, parts, held = block + 1, start + held, [], [], 0
                    ids.append(id_)
                    parts.append(found)
                    held += len(found)
        if parts:
            tally = _added(tally, parts)
            yield flush()
            symbols = np.flatnonzero(tally)
            yield _one_row(_RAW, part, None, None, None, None, None, None, symbols, tally[symbols])

    # as many ranges as the texts' size asks for; rows that share an id are told apart by their texts, so that they can be split
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ranged = texts.repartitionByRange(max(1, -(-size // RANGE_BYTES)), *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, RAW_SCHEMA)


def _added(tally: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """Counts by token id, those of ``parts`` added."""
    found = np.bincount(np.concatenate(parts), minlength=len(tally))
    found[: len(tally)] += tally
    return found


def _one_row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def _width(path: str) -> str:
    return "<u2" if tokenizer(path).dtype == np.uint16 else "<u4"


def count_ids(tokens: DataFrame) -> DataFrame:
    """``token, n`` over all documents, from what each task has counted; tallies that are read together are added up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for symbols, counts in zip(batch.column(0), batch.column(1)):
                at, n = symbols.values.to_numpy(), counts.values.to_numpy()
                if at[-1] >= len(total):
                    total = np.concatenate((total, np.zeros(at[-1] + 1 - len(total), np.int64)))
                total[at] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["token", "n"])

    tallies = tokens.filter(F.col("raw").isNull()).select("symbols", "counts")
    return tallies.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, end: int, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """Tokenize ``docs`` and write the folder ``out`` in ascending order of id."""
    if limit > MOST_LIMIT:
        raise ValueError(f"codes have at most {MOST_LIMIT} bits")
    spark, width = docs.sparkSession, _width(tokenizer_path)
    path = new_path(spark, "token-ids")
    tokenize(docs, tokenizer_path, end, id_col, text_col).write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(RAW_SCHEMA).parquet(path)
    counted = sorted((r["token"], r["n"]) for r in count_ids(tokens).collect())  # one row a token id
    symbols, counts = (np.array(x, np.int64) for x in (zip(*counted) if counted else ((), ())))
    lengths = code_lengths(counts, limit)
    spark.createDataFrame([(int(a), int(b)) for a, b in zip(symbols, lengths)], "token long, bits int").coalesce(1).write.parquet(f"{out}/codes")
    blocks = tokens.filter(F.col("raw").isNotNull())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = {r["part"]: r["first"] for r in blocks.groupBy("part").agg(F.sum("n").alias("s")).select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("first")).collect()}  # one row a range
    code = Code(symbols, lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, block, start, ids, sizes, raw = (batch.column(c)[k] for c in range(6))
                payload, at = code.encode(np.frombuffer(raw.as_buffer(), width).astype(np.int64))
                yield _one_row(_BLOCK, part.as_py(), block.as_py(), first[part.as_py()] + start.as_py(), ids.as_py(), sizes.as_py(), at[::EVERY], payload)

    coded = blocks.select("part", "block", "start", "ids", "lengths", "raw").mapInArrow(run, BLOCK_SCHEMA)
    coded.write.option("compression", "none").parquet(f"{out}/blocks")
    discard(spark, path)


_RAW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("raw", pa.binary()), ("symbols", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
RAW_SCHEMA = "part int, block int, start long, n long, ids array<long>, lengths array<long>, raw binary, symbols array<long>, counts array<long>"
_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())])
BLOCK_SCHEMA = "part int, block int, start long, ids array<long>, lengths array<long>, checkpoints array<long>, payload binary"


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``id, start, n, ids`` (little-endian unsigned 32-bit) of every document in the folder."""
    book = spark.read.parquet(f"{folder}/codes").collect()  # one row a token id
    code = Code(np.array([r["token"] for r in book], np.int64), np.array([r["bits"] for r in book], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = code.table()
        for batch in batches:
            for start, ids, sizes, checkpoints, payload in zip(*(batch.column(k).to_pylist() for k in range(5))):
                ends = np.cumsum(sizes)
                found = code.decode(payload, checkpoints, int(ends[-1]), EVERY, table).astype("<u4")
                begins = ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start + begins, pa.int64()), pa.array(sizes, pa.int64()), pa.array([found[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())], names=["id", "start", "n", "ids"])

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    return blocks.select("start", "ids", "lengths", "checkpoints", "payload").mapInArrow(run, "id long, start long, n long, ids binary")


def digests(tokens: DataFrame) -> DataFrame:
    """``id, start, n, ids_crc32`` of ``read_tokens``."""
    return tokens.select("id", "start", "n", F.crc32("ids").alias("ids_crc32"))
