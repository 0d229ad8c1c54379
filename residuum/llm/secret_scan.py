"""Secret scans: fixed patterns, and a battery of randomness tests on long tokens, with DataFrame functions only.

Patterns give the base spans (assign, access, hex). The method adds spans of kind ``random``: every run of 16 or more characters of
an encoding alphabet, a letter among them, is a candidate. Its encoding (hex of one or both cases, also with separators, which don't
count; base32, base36, base58, base62, base64, or letters alone) is inferred from the characters in it. Three tests compare it with
written text:

* chi-squared: how far the shares of vowels, common consonants, other letters, capitals (where both cases occur) and digits are from
  those of a uniform draw from the encoding's alphabet;
* runs: how often the class of character (lower, upper, digit, sign) changes;
* serial correlation: of neighbours' places in the alphabet (lag 1).

Each yields a deviate under the hypothesis "written text", whose parameters (shares of characters; mean and spread of the rate of
changes and of the correlation) are counted over those candidates of the whole corpus that have the shape of words, run together or
joined by signs, for encodings of one case and of two apart. The three are summed with weights (Stouffer), each weighing as much as a uniform
draw from the encoding would deviate by it on average; the sum is scaled by the mean squares and products of the deviates over
the same candidates, as the tests depend on each other.
False discoveries are controlled by a weighted Benjamini-Hochberg step over all candidates, with weights by length that have mean
1 over the candidates: a short token has little evidence, so it gets a smaller share of the error budget. A discovery must also be compatible with a
uniform draw itself, by its shares and by chi-squared over single characters, which a repeated or padded token fails, and mustn't be words among short numbers.

p-values are counted in bins of a tenth of a decade, so the step reads one small table whatever the corpus.
Defined cases. Null text: empty, no spans. Very long texts and tokens are scanned whole; spans are put together in time that is linear in
their number. Repeated rows: same spans. Empty table: empty result. Ids may be null or repeated; nothing joins on them. Extra columns pass
through, but a column ``spans`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.llm.common import let, running_sums, stash

#: Kind, pattern, group to measure, least length of that group. Fixed by contract; in the order of the kinds.
BASE = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: The same spans, found faster: a run that is too short can't hide a longer one for these two.
FAST = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"(?<![0-9a-f])[0-9a-f]{16,}"}
#: A text without any of these (in lower case, or as they are) has no span of the kind; plain search is cheaper than a pattern.
NEEDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("AKIA",)}
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
Q = 0.01
SPAN = "struct<start:bigint,kind:int,stop:bigint>"
#: Shares of the error budget by length of the candidate, before they are scaled to mean 1: under 20, under 24, under 32, longer.
WEIGHTS = ((20, 0.1), (24, 0.25), (32, 0.75), (1 << 30, 2.0))
#: Encodings: pattern of the characters, then how many vowels, common consonants, other letters or signs, capitals and digits the alphabet
#: has. The first that fits counts. The first ``FOLDED_CODES`` are of one case (or of hex) and read without case.
ENCODINGS = (
    ("^[0-9a-f]+$|^[0-9A-F]+$", (2, 2, 2, 0, 10)),
    ("^[0-9a-fA-F]+$", (4, 4, 4, 0, 10)),
    ("^[a-z]+$|^[A-Z]+$", (5, 9, 12, 0, 0)),
    ("^[A-Z2-7]+$", (5, 9, 12, 0, 6)),
    ("^[a-z0-9]+$|^[A-Z0-9]+$", (5, 9, 12, 0, 10)),
    ("^[A-Za-z]+$", (5, 9, 12, 26, 0)),
    ("^[1-9A-HJ-NP-Za-km-z]+$", (5, 8, 12, 24, 9)),
    ("^[A-Za-z0-9]+$", (5, 9, 12, 26, 10)),
    ("", (5, 9, 14, 26, 10)),
)
FOLDED_CODES = 5
KINDS_OF_CHARACTERS = 5
ONE_CASE_HEX, HEX = 0, 1
VOWELS, COMMON = "aeiou", "tnshrdlcm"
#: Order of the characters of one-case encodings (folded) and of the others.
FOLDED = "0123456789abcdefghijklmnopqrstuvwxyz"
ORDER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Shape of words, run together or joined by signs. And of words of three letters or more among short numbers, as in names of parts
#: and versions: these would pass for draws from an encoding, and a draw of 20 characters looks so in 3 of 100 cases at most.
WRITTEN = "^(?:[-_/+=]*(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}))+[-_/+=0-9]*$"
NUMBERED = "^(?:[-_/+=]*(?:[A-Z]?[a-z]{3,}|[0-9]{1,4}))+[-_/+=]*$"
#: Least length of a candidate without padding and, in hex, separators.
LEAST_CORE = 12
#: What is taken for written text before any is seen, at the weight of ``PRIOR`` tokens of 20 characters, for encodings of one case and of two:
#: shares of the five kinds of characters; mean and variance between tokens of the rate of changes; mean and variance of the correlation's size.
PRIOR = 20
SHARES = ((0.36, 0.44, 0.18, 0.0, 0.02), (0.31, 0.39, 0.2, 0.08, 0.02))
CHANGES, SERIAL = ((0.03, 0.002), (0.2, 0.01)), ((0.2, 0.03), (0.2, 0.03))
#: Largest chi-squared of the shares that a discovery may have (0.001 of four degrees of freedom), and largest excess over single characters in deviations.
MOST_CHI, MOST_EXCESS = 18.5, 4.0
BIN = 10
LOWEST = 300


def spans_of(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, may: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, kind, stop) in code points; matches whose group is short are dropped.

    Splitting at the pattern gives the gaps, extracting it gives the matches; their lengths add up to places.
    """

    def lengths(of: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(of)), lambda x: F.length(x).cast("bigint"))

    def place(size: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        stop = running_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(size)), size, lambda x, y: x + y))
        parts = F.arrays_zip(stop.alias("stop"), size.alias("size"), (lengths(group) if group else size).alias("part"))
        span = lambda x: F.struct((x["stop"] - x["size"]).alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("stop")).cast(SPAN)
        return F.transform(F.filter(parts, lambda x: x["part"] >= least), span)

    return F.when(text.rlike(pattern) if may is None else may & text.rlike(pattern), let(lengths(0), place)).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> list[Column]:
    def may(kind: str) -> Column | None:
        found = [F.contains(F.lower(text) if kind == "assign" else text, F.lit(x)) for x in NEEDS.get(kind, ())]
        return reduce(or_, found) if found else None

    return [spans_of(text, FAST.get(kind, pattern), k, group, least, may(kind)) for k, (kind, pattern, group, least) in enumerate(BASE)]


def _z_to_tenths(z: Column) -> Column:
    """-10 log10 of the upper tail of a normal deviate, by the asymptotic series of the tail for z over 1; 0 to 3000."""
    x = F.greatest(z, F.lit(1.0))
    tail = -(x * x / 2 + F.log(x) + F.lit(0.9189385332046727)) + F.log1p(-1 / (x * x + 2.5))
    return F.when(z > 1, F.least(F.lit(float(BIN * LOWEST)), -BIN * tail / F.log(F.lit(10.0)))).otherwise(0.0)


def with_statistics(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``s``: n; alphabet (counts of the kinds of characters in the inferred one); cells (counts in the token); cased; changes (of class);
    squares (sum of the squared counts of its characters); serial (correlation of neighbours' places); written, numbered (its shape)."""
    core, low, n, code, token = (F.col(c) for c in ("__core", "__low", "__n", "__code", "token"))
    first = F.lit(len(ENCODINGS) - 1)
    for k, (pattern, _) in reversed([*enumerate(ENCODINGS)][:-1]):
        first = F.when(core.rlike(pattern), k).otherwise(first)
    rows = tokens.withColumn("__core", _core(token)).withColumns({"__n": F.length(core).cast("double"), "__low": F.lower(core)}).withColumn("__code", first)
    folded, cased = code < FOLDED_CODES, code >= FOLDED_CODES
    place = lambda c: F.instr(F.when(folded, FOLDED).otherwise(ORDER), c).cast("double")
    repeats = lambda x: F.aggregate(F.array_distinct(F.split(x, "")), F.lit(0.0), lambda t, c: t + F.pow(n - F.length(F.replace(x, c, F.lit(""))), F.lit(2)))
    rows = rows.withColumns({"__p": F.transform(F.split(F.when(folded, low).otherwise(F.translate(core, "-_", "+/")), ""), place), "__squares": repeats(core), "__folded": F.when(code == HEX, repeats(low))})
    # lag-1 correlation, 1 where all places are the same
    p = F.col("__p")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    before, after = F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1)
    rows = rows.withColumns({"__s": total(p), "__q": total(F.transform(p, lambda x: x * x)), "__c": total(F.zip_with(before, after, lambda x, y: x * y)), "__ends": F.get(p, 0) + F.element_at(p, -1)})
    mean = F.col("__s") / n
    spread = F.col("__q") - n * mean * mean
    serial = F.when(spread > 0, (F.col("__c") - mean * (2 * F.col("__s") - F.col("__ends")) + (n - 1) * mean * mean) / spread).otherwise(1.0)
    # hex of both cases is 22 even characters or 16 even digits in chance case: the one that fits better
    excess = lambda size, squares: (size * squares / n - n - (size - 1)) / F.sqrt(F.lit(2.0 * (size - 1)))
    fold = F.coalesce(excess(16, F.col("__folded")) < excess(22, F.col("__squares")), F.lit(False))
    count = lambda characters: (n - F.length(F.translate(F.when(cased, core).otherwise(low), characters, ""))).cast("double")
    counted = {"__v": count(VOWELS), "__m": count(COMMON), "__u": count(ORDER[:26]), "__d": count(FOLDED[:10])}
    rows = rows.withColumns({"__serial": serial, "__fold": fold} | counted)
    vowels, common, capitals, digits = (F.col(c) for c in counted)
    alphabet = F.get(F.array(*[F.array(*[F.lit(float(v)) for v in a]) for _, a in ENCODINGS]), F.when(F.col("__fold"), ONE_CASE_HEX).otherwise(code))
    runs = F.regexp_count(core, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"))
    s = F.struct(
        n.alias("n"), alphabet.alias("alphabet"), F.array(vowels, common, n - vowels - common - capitals - digits, capitals, digits).alias("cells"), cased.alias("cased"),
        (runs - 1).cast("double").alias("changes"), F.when(F.col("__fold"), F.col("__folded")).otherwise(F.col("__squares")).alias("squares"), F.col("__serial").alias("serial"), token.rlike(WRITTEN).alias("written"), (token.rlike("[0-9]") & token.rlike(NUMBERED)).alias("numbered"),
    )
    return rows.select(*tokens.columns, s.alias("s"))


def _core(token: Column) -> Column:
    """Without padding or, in hex, separators."""
    hexed = token.rlike("^[0-9a-fA-F]+(?:[-_][0-9a-fA-F]+)*$")
    return F.when(hexed, F.translate(token, "-_", "")).otherwise(F.regexp_replace(token, "=+$", ""))


def _candidate(token: Column) -> Column:
    """Whether a run is tested; numbers aren't, as digits alone say nothing of a key."""
    return token.rlike("[A-Za-z]") & (F.length(_core(token)) >= LEAST_CORE)


@dataclass(frozen=True)
class Written:
    """Written text, as counted: shares of the kinds of characters; mean and variance of the rate of changes between tokens and of the
    correlation's size; mean squares of the three deviates and mean products of the first and second, first and third, second and third."""

    shares: tuple[float, ...]
    changes: tuple[float, float]
    serial: tuple[float, float]
    squares: tuple[float, float, float] = (1.0, 1.0, 1.0)
    products: tuple[float, float, float] = (0.0, 0.0, 0.0)


@dataclass(frozen=True)
class Null:
    """Written text in encodings of one case and of two; mean of the weights."""

    written: tuple[Written, Written]
    weight: float = 1.0


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def with_deviates(stats: DataFrame, null: Null) -> DataFrame:
    """``stats`` with z0, z1, z2 (deviates of the tests, large where unlike written text and like a uniform draw), w0, w1, w2 (their means for a uniform draw) and chi, size."""
    s, n, size = F.col("s"), F.col("s.n"), F.col("size")
    kinds = range(KINDS_OF_CHARACTERS)
    either = lambda of: F.when(s["cased"], of(null.written[1])).otherwise(of(null.written[0]))
    over = lambda x, e: F.when(e > 0, x / e).otherwise(0.0)
    rows = stats.withColumn("size", _sum(F.get(s["alphabet"], k) for k in kinds))
    rows = rows.withColumns({f"__e{k}": F.get(s["alphabet"], k) / size for k in kinds} | {f"__p{k}": either(lambda w, k=k: F.lit(w.shares[k])) for k in kinds})
    e, p, c = [F.col(f"__e{k}") for k in kinds], [F.col(f"__p{k}") for k in kinds], [F.get(s["cells"], k) for k in kinds]
    rows = rows.withColumns({
        "chi": _sum(F.when(a > 0, (x - n * a) * (x - n * a) / (n * a)).otherwise(0.0) for x, a in zip(c, e)),
        "__mean": n * _sum(over((b - a) * (b - a), a) for a, b in zip(e, p)) + _sum(over(b * (1 - b), a) for a, b in zip(e, p)),
        "__tilt": _sum(b * over(b - a, a) for a, b in zip(e, p)),
        "__bend": _sum(b * over(b - a, a) * over(b - a, a) for a, b in zip(e, p)),
        "__rate": either(lambda w: F.lit(w.changes[0])), "__between": either(lambda w: F.lit(w.changes[1])), "__usual": either(lambda w: F.lit(w.serial[0])), "__spread": either(lambda w: F.lit(w.serial[1])),
    })
    mean, tilt, rate, usual = (F.col(x) for x in ("__mean", "__tilt", "__rate", "__usual"))
    alphabet = [F.get(s["alphabet"], k) for k in kinds]
    lower = alphabet[0] + alphabet[1] + alphabet[2]
    drawn = 1 - (lower * lower + alphabet[3] * alphabet[3] + alphabet[4] * alphabet[4]) / (size * size)  # rate of changes of a uniform draw
    variances = 4 * n * (F.col("__bend") - tilt * tilt) + 2 * (KINDS_OF_CHARACTERS - 1), F.col("__between") + rate * (1 - rate) / (n - 1), F.col("__spread")
    rows = rows.withColumns({f"__d{k}": F.sqrt(v * either(lambda w, k=k: F.lit(w.squares[k]))) for k, v in enumerate(variances)} | {"__drawn": drawn})
    d = [F.col(f"__d{k}") for k in range(3)]
    zs = -1 * (F.col("chi") - mean) / d[0], (s["changes"] / (n - 1) - rate) / d[1], -1 * (F.abs(s["serial"]) - usual) / d[2]
    ws = -1 * (F.lit(KINDS_OF_CHARACTERS - 1.0) - mean) / d[0], (F.col("__drawn") - rate) / d[1], -1 * (0.8 / F.sqrt(n) - usual) / d[2]
    return rows.select(*[F.col(x) for x in stats.columns], "chi", "size", *[x.alias(f"z{k}") for k, x in enumerate(zs)], *[x.alias(f"w{k}") for k, x in enumerate(ws)])


def with_bin(stats: DataFrame, null: Null) -> DataFrame:
    """``stats`` with ``bin``: that of the combined p-value (tenths of a decade, weighted by length), less than 0 where uniformity is refused or the shape is that of words and numbers.

    Deviates are added with weights, scaled to variance 1 under written text.
    """
    s, n, size = F.col("s"), F.col("s.n"), F.col("size")
    either = lambda of: F.when(s["cased"], of(null.written[1])).otherwise(of(null.written[0]))
    rows = with_deviates(stats, null).withColumns({f"__w{k}": F.greatest(F.lit(0.05), F.col(f"w{k}")) for k in range(3)})
    z, w = [F.col(f"z{k}") for k in range(3)], [F.col(f"__w{k}") for k in range(3)]
    product = [2 * w[a] * w[b] * either(lambda p, k=k: F.lit(p.products[k])) for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2)))]
    rows = rows.withColumn("__z", _sum(a * b for a, b in zip(w, z)) / F.sqrt(_sum([a * a for a in w] + product)))
    uniform = (F.col("chi") <= MOST_CHI) & (size * s["squares"] / n - n <= (size - 1) + MOST_EXCESS * F.sqrt(2 * (size - 1)))
    bin_ = F.floor(_z_to_tenths(F.col("__z")) + BIN * F.log10(_weight(n) / null.weight))
    return rows.select(*[F.col(x) for x in stats.columns], F.when(uniform & ~s["numbered"], F.greatest(F.lit(0), bin_.cast("int"))).otherwise(-1).alias("bin"))


def _weight(n: Column) -> Column:
    weight = F.lit(WEIGHTS[-1][1])
    for least, w in reversed(WEIGHTS[:-1]):
        weight = F.when(n < least, w).otherwise(weight)
    return weight


def candidates(docs: DataFrame, text: Column) -> DataFrame:
    """``h, g, start, stop, token`` of every candidate; h and g tell texts apart."""
    spans, tokens = spans_of(text, CANDIDATE, len(BASE)), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    found = docs.filter(text.rlike(CANDIDATE)).select(*_hashes(text), F.explode(F.arrays_zip(spans.alias("span"), tokens.alias("token"))).alias("c"))
    return found.select("h", "g", "c.span.start", "c.span.stop", "c.token").filter(_candidate(F.col("token")))


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")]


def discoveries(stats: DataFrame) -> DataFrame:
    """The rows of ``stats`` (column ``s``; all candidates) that are discoveries, by what written text among them looks like."""
    s = F.col("s")
    n, rate, size = s["n"], s["changes"] / (s["n"] - 1), F.abs(s["serial"])
    names = {"k": F.lit(1.0), "n": n, "m": n - 1, "x": s["changes"], "r": rate, "rr": rate * rate, "i": 1 / (n - 1), "z": size, "zz": size * size} | {f"c{k}": F.get(s["cells"], k) for k in range(KINDS_OF_CHARACTERS)}
    # grouped, not filtered: a filter under many computed columns takes the optimizer long
    kinds = [s["cased"].alias("cased"), s["written"].alias("written")]
    counts = stats.groupBy(*kinds).agg(*[F.sum(x).alias(k) for k, x in names.items()], F.sum(_weight(n)).alias("weight")).collect()  # four rows
    totals = {r["cased"]: r for r in counts if r["written"]}

    def counted(cased: bool) -> Written:
        t = totals.get(cased) or dict.fromkeys(names, 0.0)
        many, chars = PRIOR + t["k"], PRIOR * 20.0
        shares = tuple((chars * SHARES[cased][k] + t[f"c{k}"]) / (chars + t["n"]) for k in range(KINDS_OF_CHARACTERS))
        change = (chars * CHANGES[cased][0] + t["x"]) / (chars + t["m"])
        between = max(0.0, t["rr"] - 2 * change * t["r"] + t["k"] * change * change - change * (1 - change) * t["i"])
        serial = (PRIOR * SERIAL[cased][0] + t["z"]) / many
        spread = PRIOR * SERIAL[cased][1] + t["zz"] - 2 * serial * t["z"] + t["k"] * serial * serial
        return Written(shares, (change, (PRIOR * CHANGES[cased][1] + between) / many), (serial, spread / many))

    first = Null((counted(False), counted(True)))
    z = [F.col(f"z{k}") for k in range(3)]
    pairs = [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]
    moments = {r["cased"]: r for r in with_deviates(stats, first).groupBy(*kinds).agg(F.count(F.lit(1)).alias("k"), *[F.sum(z[a] * z[b]).alias(f"z{a}{b}") for a, b in pairs]).collect() if r["written"]}

    def dependent(cased: bool) -> Written:
        t, w = moments.get(cased), first.written[cased]
        if t is None:
            return w
        mean = {(a, b): ((PRIOR if a == b else 0.0) + t[f"z{a}{b}"]) / (PRIOR + t["k"]) for a, b in pairs}
        squares = tuple(mean[k, k] for k in range(3))
        return Written(w.shares, w.changes, w.serial, squares, tuple(max(0.0, mean[a, b] / (squares[a] * squares[b]) ** 0.5) for a, b in pairs[3:]))

    weight = sum(r["weight"] for r in counts) / (sum(r["k"] for r in counts) or 1.0)
    null = Null((dependent(False), dependent(True)), weight or 1.0)
    binned = stash(with_bin(stats, null).drop("s"), "secret-bins")
    bins = binned.groupBy(F.greatest("bin", F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    ranked = bins.withColumn("found", F.sum("k").over(Window.orderBy(F.desc("bin")))).withColumn("all", F.sum("k").over(Window.partitionBy(F.lit(0))))  # one row a bin
    cut = ranked.filter((F.col("bin") > 0) & (F.pow(F.lit(10.0), -F.col("bin") / BIN) <= Q * F.col("found") / F.col("all"))).agg(F.min("bin")).first()[0]
    return binned.filter(F.col("bin") >= (BIN * LOWEST * 2 if cut is None else cut)).drop("bin")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: (start, kind, stop) by start, then kind; kinds as in ``KINDS``. Two passes over the texts; discoveries come back by a hash of the text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    stats = stash(with_statistics(candidates(docs, text)).drop("token"), "secret-candidates")
    span = F.struct("start", F.lit(len(BASE)).alias("kind"), "stop").cast(SPAN)
    more = discoveries(stats).select("h", "g", span.alias("span")).distinct().groupBy("h", "g").agg(F.collect_list("span").alias("__more"))  # those of one text
    kept = [c for c in docs.columns if c != "spans"]
    based = docs.select(*[F.col(f"`{c}`") for c in kept], F.concat(*base_spans(text)).alias("__base"), *[c.alias(f"__{n}") for c, n in zip(_hashes(text), "hg")])
    found = based.join(more, (F.col("__h") == F.col("h")) & (F.col("__g") == F.col("g")), "left")
    return found.select(*[F.col(f"`{c}`") for c in kept], F.array_sort(F.concat("__base", F.coalesce("__more", F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
