"""Quality rules as a short-circuit cascade, with DataFrame functions only.

A rule is a condition on facts of the whole text (counts of words, letters, ...) that rejects a document. A fact is worked out
when the first rule needs it and kept for later ones; a rule that rejects ends the cascade, so facts that only later rules need
are never worked out. On a sample each fact's cost in seconds (least of three runs) and each text's verdict by every rule
are measured. The order is greedy: next comes the rule that rejects most of the sample's remaining texts per second of the facts that it
still needs. The order changes the cost alone, never the verdict.

Defined cases. Null and empty texts have no words and fail ``few_words``. Repeated rows are judged alike. An empty table
gives an empty result in the given order of rules. Extra columns pass through, but those named like a result (``rejected_by``, and
in ``measure`` the counts) are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm.common import SPACES, WORD, let, stash

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows of the sample that the order of rules is taken from.
SAMPLE_ROWS = 2_000


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def left_of(text: Column, removed: str) -> Column:
    """Characters left when what the pattern matches is taken out."""
    return F.length(F.regexp_replace(text, removed, ""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more in ``tokens``.

    Windows are told apart by a 64-bit hash that is chained over their words. Texts whose hashes are all different, which is
    most of them, end there; else hashes are sorted with their places, equal neighbours give the places of repeated
    windows, and the places, sorted, give the words that they cover: n log n in the length of the text.
    """

    def covered(places: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(places) - 1)
        add = F.aggregate(F.when(F.size(places) > 1, steps).otherwise(F.array().cast("array<int>")), F.lit(0), lambda n, k: n + F.least(F.lit(window), F.get(places, k) - F.get(places, k - 1)))
        return F.when(F.size(places) > 0, add + window).otherwise(0)

    def places(pairs: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(pairs, j)["h"] == F.get(pairs, k)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.array_sort(F.transform(twice, lambda j: F.get(pairs, j)["i"]))

    def from_hashes(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(pairs, places), covered)).otherwise(0)

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - window)
        return F.when(F.size(w) > window, let(F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])), from_hashes)).otherwise(0)

    return let(tokens, of)


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def duplicate_lines(kept_lines: Column) -> Column:
    """Lines equal to an earlier one."""
    return let(kept_lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def symbols(text: Column) -> Column:
    return left_of(text, f"[^{SYMBOLS}]+")


Facts = dict[str, Column]
#: How a line of a list begins, and how one that is cut off ends.
BULLET, ELLIPSIS = r"^[\x20\t]*[-*•‣▪]", r"(?:\.\.\.|…)[\x20\t\r]*$"
#: How each fact comes from the text and the facts that it depends on.
FACTS: dict[str, Callable[[Column, Facts], Column]] = {
    "words": lambda t, f: words(t),
    "n_words": lambda t, f: F.size(f["words"]),
    "word_chars": lambda t, f: left_of(t, SPACES),
    "n_symbols": lambda t, f: symbols(t),
    "n_lines": lambda t, f: F.size(f["lines"]),
    "lines": lambda t, f: lines(t),
    "n_dup_lines": lambda t, f: duplicate_lines(f["lines"]),
    "n_repeat_words": lambda t, f: repeated_words(f["words"]),
    "letters": lambda t, f: F.length(t) - left_of(t, r"\p{L}+"),
    "capitals": lambda t, f: F.regexp_count(t, F.lit(r"\p{Lu}")),
    "n_bullets": lambda t, f: F.size(F.filter(f["lines"], lambda x: x.rlike(BULLET))),
    "n_ellipses": lambda t, f: F.size(F.filter(f["lines"], lambda x: x.rlike(ELLIPSIS))),
    "exclamations": lambda t, f: F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))),
}
DEPENDS = {"n_words": "words", "n_repeat_words": "words", "n_lines": "lines", "n_dup_lines": "lines", "n_bullets": "lines", "n_ellipses": "lines"}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_facts(text: Column, known: Facts, names: Sequence[str], body: Callable[[Facts], Column]) -> Column:
    """``body`` of the known facts and ``names``; each missing one is worked out once, here."""
    missing = [n for n in names if n not in known]
    deeper = {DEPENDS[n] for n in missing if n in DEPENDS} - set(known)
    if deeper:
        return with_facts(text, known, sorted(deeper), lambda k: with_facts(text, k, missing, body))
    if not missing:
        return body(known)
    found = F.struct(*[FACTS[n](text, known).alias(n) for n in missing])
    return let(found, lambda s: body(known | {n: s[n] for n in missing}))


@dataclass(frozen=True)
class Rule:
    """``rejects(facts)``: a condition on the facts in ``needs``."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Facts], Column]


#: Thresholds are parameters of the corpus, in whole percents or ratios.
RULES = (
    Rule("few_words", ("n_words",), lambda f: f["n_words"] < 10),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda f: 100 * f["n_repeat_words"] > 20 * f["n_words"]),
    Rule("symbols", ("n_symbols", "n_words"), lambda f: 10 * f["n_symbols"] > f["n_words"]),
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda f: 100 * f["n_dup_lines"] > 40 * f["n_lines"]),
    Rule("bullets", ("n_bullets", "n_lines"), lambda f: (f["n_lines"] >= 3) & (100 * f["n_bullets"] > 90 * f["n_lines"])),
    Rule("cut_lines", ("n_ellipses", "n_lines"), lambda f: (f["n_lines"] >= 3) & (100 * f["n_ellipses"] > 30 * f["n_lines"])),
    Rule("shouting", ("capitals", "letters"), lambda f: 2 * f["capitals"] > f["letters"]),
    Rule("exclaiming", ("exclamations", "n_words"), lambda f: 2 * f["exclamations"] > f["n_words"]),
    Rule("word_length", ("word_chars", "n_words"), lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 15 * f["n_words"])),
    Rule("few_letters", ("letters", "word_chars"), lambda f: 10 * f["letters"] < 3 * f["word_chars"]),
)


def _all_needs(rule: Rule) -> set[str]:
    return set(rule.needs) | {DEPENDS[n] for n in rule.needs if n in DEPENDS}


def greedy_order(cascade: Sequence[Rule], seconds: dict[str, float], verdicts: dict[int, int], known: Sequence[str] = ()) -> list[Rule]:
    """Rules by rejections per second, one after another; ``verdicts``: texts by which rules (bits) reject them."""
    left, order, have, rest = dict(verdicts), [], set(known), list(range(len(cascade)))
    while rest:
        cost = lambda k: max(1e-4, sum(seconds.get(n, 0.0) for n in _all_needs(cascade[k]) - have))
        best = max(rest, key=lambda k: (sum(n for bits, n in left.items() if bits >> k & 1) / cost(k), -cost(k), -k))
        rest.remove(best)
        order.append(cascade[best])
        have |= _all_needs(cascade[best])
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
    return order


def seconds_of(sample: DataFrame, conditions: Sequence[Column], repeats: int = 3) -> list[float]:
    """Seconds that each condition takes on the sample, the least of some runs: one job a run, in which every row notes the time after each condition."""
    tick = F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    ticks = [tick.alias("t0"), *[F.when(c, tick).otherwise(tick + 1).alias(f"t{k + 1}") for k, c in enumerate(conditions)]]
    sums = [F.sum(F.col(f"t{k + 1}") - F.col(f"t{k}")) for k in range(len(conditions))]
    runs = [[x or 0 for x in sample.select(*ticks).agg(*sums).first()] for _ in range(repeats)]  # one row
    return [min(x) / 1e9 for x in zip(*runs)]


def cheapest_first(docs: DataFrame, text_col: str, cascade: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, known: Sequence[str] = ()) -> list[Rule]:
    """The rules in greedy order on a sample of whole texts; facts in ``known`` cost nothing, as they are there anyway."""
    total = docs.count()
    if not total:
        return list(cascade)
    sample = docs.select(whole(F.col(text_col)).alias("text")).sample(min(1.0, 1.2 * sample_rows / total), seed=5).limit(sample_rows)
    sample, text = stash(sample, "quality-sample"), F.col("text")

    names = sorted({n for r in cascade for n in _all_needs(r)}, key=lambda n: n in DEPENDS)
    alone = seconds_of(sample, [with_facts(text, {}, (n,), lambda f, n=n: F.hash(f[n]) == 0 if n not in ("words", "lines") else F.size(f[n]) < 0) for n in names])
    costs: dict[str, float] = {}
    for name, took in zip(names, alone):
        costs[name] = max(0.0, took - costs.get(DEPENDS.get(name), 0.0))
    needs = sorted({n for r in cascade for n in r.needs})
    bits = with_facts(text, {}, needs, lambda f: sum((F.when(r.rejects(f), 1 << k).otherwise(0) for k, r in enumerate(cascade)), F.lit(0)))
    verdicts = {r["bits"]: r["n"] for r in sample.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return greedy_order(cascade, costs, verdicts, known)


def rejected_by(cascade: Sequence[Rule], text: Column, known: Facts | None = None) -> Column:
    """Name of the first rule that rejects, else null; what only later rules need isn't worked out."""
    if not cascade:
        return F.lit(None).cast("string")
    rule, rest = cascade[0], cascade[1:]
    return with_facts(text, known or {}, rule.needs, lambda f: F.when(rule.rejects(f), F.lit(rule.name)).otherwise(rejected_by(rest, text, f)))


def judge(docs: DataFrame, text_col: str = "text", cascade: Sequence[Rule] | None = None) -> DataFrame:
    """``docs`` with ``rejected_by``: the rule that rejects the document, null if it is kept."""
    cascade = cheapest_first(docs, text_col) if cascade is None else cascade
    return docs.withColumn("rejected_by", rejected_by(cascade, whole(F.col(text_col))))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that a rule rejects."""
    return docs.filter(rejected_by(cheapest_first(docs, text_col), whole(F.col(text_col))).isNull())


def measure(docs: DataFrame, text_col: str = "text", cascade: Sequence[Rule] = ()) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and, by ``cascade`` (which uses these), rejected_by."""
    text = whole(F.col(text_col))

    def of(f: Facts) -> Column:
        return F.struct(*[f[n].cast("long").alias(n) for n in MEASURES], rejected_by(cascade, text, f).alias("rejected_by"))

    kept = [c for c in docs.columns if c not in (*MEASURES, "rejected_by")]
    return docs.withColumn("__facts", with_facts(text, {}, MEASURES, of)).select(*[f"`{c}`" for c in kept], "__facts.*")
