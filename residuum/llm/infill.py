"""Fill-in-the-middle: texts are cut into prefix, middle and suffix at token ranks found by a scan of events.

Tokens are runs of ASCII letters and single other characters. One Aho-Corasick automaton holds every ASCII character that ends a run of letters
(all but the letters themselves) and the sentinels, so its matches are the events at which counting changes; a character beyond ASCII is read as
one that stands for it. A gap between two events is a run of letters: one token if it isn't empty, none if it is. Token counts up to each
event follow by arithmetic from the events' places, and the place of the r-th token by a binary search in these counts; letters are never looked at.

Long texts are scanned in stretches, of which only the count at their start and their last event are kept; a stretch that holds a cut is scanned
once more. So the memory is bounded whatever the text.

The three parts are taken by DataFrame functions, and so is the text rebuilt from output and form. A draw from the SHA-256 of seed and id
chooses the cuts and the form, so that reruns agree.

Defined cases. Null text: empty. Empty text, one with a sentinel in it, or one that the rate leaves out: plain. A null id is drawn as the
empty string. Very long texts are read whole. Repeated rows: same answer. Empty table: empty result. Other columns pass through; those named
like a result are replaced.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are transformed, and of those per cent with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Characters that are scanned at a time.
STRETCH = 1 << 20
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


@lru_cache(maxsize=2)
def automaton(sentinels: tuple[str, ...]):
    """Events: 0 for an ASCII character other than a letter, 1 for a sentinel."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for c in map(chr, range(128)):
        if not c.isalpha():
            out.add_word(c, 0)
    for s in sentinels:
        out.add_word(s, 1)
    out.make_automaton()
    return out


class Events:
    """Token counts of one text from its events."""

    def __init__(self, text: str, sentinels: tuple[str, ...], stretch: int = STRETCH):
        self.scan = automaton(sentinels)
        self.most = max(map(len, sentinels)) - 1
        self.text = text.encode("ascii", "replace").decode("ascii")  # a character beyond ASCII becomes a question mark
        self.size, self.stretch = len(text), stretch
        self.marked, self.last = False, None
        #: Tokens that have ended before a stretch, and the place after the last event before it.
        self.before: list[tuple[int, int]] = []
        tokens, place = 0, 0
        for begin in range(0, max(1, self.size), stretch):
            self.before.append((tokens, place))
            at, counts, marked = self._events(begin, tokens, place)
            self.marked |= marked
            if len(at):
                tokens, place = int(counts[-1]), int(at[-1]) + 1
            self.last = (begin, at, counts)
        #: All tokens: those up to the last event, and the run of letters after it.
        self.n = tokens + (place < self.size)

    def _events(self, begin: int, tokens: int, place: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """Places of the events of a stretch, tokens up to and with each, and whether a sentinel ends in it."""
        end = min(self.size, begin + self.stretch)
        found = np.fromiter(chain.from_iterable(self.scan.iter(self.text, max(0, begin - self.most), end)), np.int64)
        at, kind = found[::2], found[1::2]
        marked = bool(kind.any())
        at = at[(kind == 0) & (at >= begin)]
        gaps = np.diff(at, prepend=place - 1) > 1
        return at, tokens + np.arange(1, len(at) + 1) + np.cumsum(gaps), marked

    def place(self, rank: int) -> int:
        """Where the first ``rank`` tokens end."""
        if rank == 0 or rank == self.n:
            return 0 if rank == 0 else self.size
        k = int(np.searchsorted([t for t, _ in self.before], rank)) - 1
        begin, at, counts = self.last
        if begin != k * self.stretch:
            begin = k * self.stretch
            at, counts, _ = self._events(begin, *self.before[k])
        i = int(np.searchsorted(counts, rank))
        # the count rises by two where the gap before the event is a token as well
        if i < len(at):
            return int(at[i]) + (int(counts[i]) == rank)
        return self._gap_end(k)

    def _gap_end(self, k: int) -> int:
        """The token asked for is a run of letters that ends in a later stretch: at its first event."""
        for later in range(k + 1, len(self.before)):
            at, _, _ = self._events(later * self.stretch, *self.before[later])
            if len(at):
                return int(at[0])
        return self.size


def cuts(texts: pa.Array, first: pa.Array, second: pa.Array, sentinels: tuple[str, ...] = (PREFIX, SUFFIX, MIDDLE), stretch: int = STRETCH) -> pa.StructArray:
    """Per text: tokens, whether it has a sentinel, and the places of the cuts that two draws give."""
    rows = []
    for text, a, b in zip(texts, first.to_pylist(), second.to_pylist()):
        events = Events(text.as_py() or "", sentinels, stretch)
        a, b = sorted((a % (events.n + 1), b % (events.n + 1)))
        rows.append((events.n, events.marked, events.place(a), events.place(b)))
    columns = zip(*rows) if rows else ((),) * 4
    types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64())
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["n", "marked", "a", "b"])


def draws(id_: Column, seed: str | int = 1) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str | int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with ``n`` (tokens), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``."""

    @F.arrow_udf("struct<n:long,marked:boolean,a:long,b:long>")
    def found(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        return cuts(texts, first, second)

    names = [F.col(f"`{c}`") for c in docs.columns if c not in RESULTS]
    text = F.coalesce(F.col("__text"), F.lit(""))
    put = docs.select(*names, F.col(f"`{text_col}`").alias("__text"), F.array(*draws(F.col(f"`{id_col}`"), seed)).alias("__h"))
    put = put.withColumn("__cut", found(text, F.col("__h")[0], F.col("__h")[1]))
    plain = (text == "") | F.col("__cut.marked") | (F.col("__h")[2] % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("__h")[3] % 100 < suffix_first, "spm").otherwise("psm")
    a, b = F.col("__cut.a").cast("int"), F.col("__cut.b").cast("int")
    prefix, middle, suffix = F.substr(text, F.lit(1), a), F.substr(text, a + 1, b - a), F.substr(text, b + 1)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    shown = F.when(form == "plain", text).when(form == "psm", psm).otherwise(spm)
    keep = F.when(form != "plain", F.col("__cut.a")), F.when(form != "plain", F.col("__cut.b") - F.col("__cut.a"))
    return put.select(*names, F.col("__cut.n").alias("n"), form.alias("form"), keep[0].alias("prefix_chars"), keep[1].alias("middle_chars"), shown.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone: no part has a sentinel, so each sentinel's first place is its own."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    one = F.substr(body, F.lit(1), F.instr(body, second) - 1)
    rest = F.substr(body, F.instr(body, second) + len(PREFIX))
    two = F.substr(rest, F.lit(1), F.instr(rest, F.lit(MIDDLE)) - 1)
    middle = F.substr(rest, F.instr(rest, F.lit(MIDDLE)) + len(MIDDLE))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
