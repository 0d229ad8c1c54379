"""Conversation structure repair by a dynamic programme over the turns that are retained.

A conversation should be an optional system turn and then user and assistant turns in alternation, ended by the assistant, or nothing. Turns are
kept, get the role of user or assistant, are deleted (blank ones and repeats always), and empty turns are inserted; the cheapest edits are wanted, and of
equally cheap ones those whose audit string (K, R, D, I) is least.

The programme runs over retained turns, kept or reroled, from the end of a conversation to its start. Between one retained turn and the next all
are deleted: prefix sums of deletion costs price that gap, and a running minimum a role (of prefix sum, own cost and what follows) stands for all
turns that could be next, so that a turn costs a few comparisons. The two roles alone say what has to be inserted in the gap. Ties: an audit has its D
first, then its I, so of two audits the one whose next retained turn is later is less; at the same turn, the one that inserts more; then K before R.

Rows are brought down to numbers before they move: repeats of a row are counted, its text is a 128-bit hash, and only the plan's result meets the texts
again. Turns are range-sorted over all conversations. A range solves the conversations within it. Of a conversation that reaches
over several ranges, each range gives what it makes of every role that may follow (4 x 4 costs) and the driver joins these, a few numbers a range; so neither its
length nor its share of all rows matters.

Defined cases. Null role or text: one space (so unknown, and blank). A role counts by its first character; one but s, u, a can't be kept, nor can a system turn that isn't the
first retained. Turns are ordered by turn (null first), then role, then the text's hash, so ties and repeated rows have a fixed place. A null
conversation id is a conversation. Very long texts are hashed whole. Empty table: empty result. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.llm.common import WORD, stash

REROLE, DELETE, INSERT, UNENDED = 3, 4, 3, 3
#: What follows a place: a retained system, user or assistant turn, or none.
SYSTEM, USER, ASSISTANT, END = range(4)
START = 3  # as what came before
FAR = 1 << 62
#: Turns inserted between a retained turn and the next, by what came before and what follows; None: not allowed.
BETWEEN = [
    [None, "", "u", "ua"],
    [None, "a", "", "a"],
    [None, "", "u", ""],
    ["", "", "u", ""],
]
#: Where ``monotonically_increasing_id`` puts the number of the range.
RANGE_BITS = 33
#: Bits of a row's facts.
BLANK, REPEAT, TRUNCATED = 1, 2, 4
ROLES = {"u": "user", "a": "assistant"}

#: For each of the four that may follow: its cost, and the place of the turn (END is beyond all).
Ahead = tuple[list[int], list[int]]
NOTHING: Ahead = ([FAR, FAR, FAR, 0], [FAR] * 4)


def own_costs(initial: str, facts: int) -> tuple[int, int, int] | None:
    """Costs of retaining a turn as system, user, assistant; None where it has to go."""
    if facts & (BLANK | REPEAT):
        return None
    more = UNENDED if facts & TRUNCATED else 0
    return (more if initial == "s" else FAR, more if initial == "u" else more + REROLE, more if initial == "a" else more + REROLE)


def choose(before: int, cost: list[int], place: list[int]) -> tuple[int, int]:
    """The cheapest that follows ``before`` and its cost, ties by audit."""
    best = None
    for follows, between in enumerate(BETWEEN[before]):
        if between is not None and cost[follows] < FAR:
            key = (cost[follows] + INSERT * len(between), -place[follows], -len(between), follows)
            best = key if best is None or key < best else best
    return (END, FAR) if best is None else (best[3], best[0])


def sweep(rows: list[tuple], ahead: Ahead) -> tuple[Ahead, list]:
    """From the last of ``rows`` (at, initial, facts, copies) to the first, given what is ahead of them: the same for their start, and per row what each retained role chooses."""
    deleted = DELETE * sum(r[3] for r in rows)  # the prefix sum of deletions up to and with a row
    least = [c + deleted if c < FAR else FAR for c in ahead[0]]
    place, chosen = list(ahead[1]), [None] * len(rows)
    for k in range(len(rows) - 1, -1, -1):
        at, initial, facts, copies = rows[k]
        costs = own_costs(initial, facts)
        since = deleted - DELETE * copies
        if costs is not None:
            picks, retained = [None] * 3, []
            for role in (SYSTEM, USER, ASSISTANT):
                if costs[role] < FAR:
                    follows, cost = choose(role, least, place)
                    # copies of the row after the first are deleted as repeats
                    cost = since + costs[role] + DELETE * (copies - 1) + cost - deleted if cost < FAR else FAR
                    if cost < least[role]:
                        retained.append((role, cost))
                        picks[role] = follows
            for role, cost in retained:
                least[role], place[role] = cost, at
            chosen[k] = picks
        deleted = since
    return (least, place), chosen


def walk(chosen: list, before: int, follows: int) -> Iterator[tuple[int, int, int, int]]:
    """From the first row on, which are retained: (row, role, what came before, what follows)."""
    for k, picks in enumerate(chosen):
        if follows != END and picks is not None and picks[follows] is not None:
            yield k, follows, before, picks[follows]
            before, follows = follows, picks[follows]


@dataclass
class Border:
    """What a range knows of a conversation that reaches beyond it: what is ahead, what came before, the last row before it, and whether it is the last range."""

    ahead: Ahead = NOTHING
    before: int = START
    follows: int | None = None
    initial: str | None = None
    turn: int | None = None
    first: bool = True
    last: bool = True


RESULT = "at long, edit string, role string, lead string, tail string, illegal long, cost long, fresh boolean"


def edits(rows: list[tuple], turns: list[int | None], border: Border) -> Iterator[tuple]:
    """The columns of ``RESULT`` for each row of a conversation, or of its part in a range."""
    (least, place), chosen = sweep(rows, border.ahead)
    follows = choose(START, least, place)[0] if border.follows is None else border.follows
    kept = {k: (role, BETWEEN[before][role], after) for k, role, before, after in walk(chosen, border.before, follows)}
    # what ends the conversation comes after its last row
    before, after = border.before, follows
    if kept:
        before, _, after = kept[max(kept)]
    initial, turn, known = border.initial, border.turn, not border.first
    for k, (at, own, facts, copies) in enumerate(rows):
        role, lead = kept[k][:2] if k in kept else (None, "")
        edit = "D" if role is None else "K" if own == "sua"[role] else "R"
        tail = BETWEEN[before][END] if border.last and k == len(rows) - 1 and after == END else ""
        illegal = (copies - 1) + (known and (initial or "") + own not in ("su", "ua", "au"))
        cost = DELETE * (copies - (role is not None)) + INSERT * (len(lead) + len(tail))
        if role is not None:
            cost += own_costs(own, facts)[role]
        yield at, edit, None if role is None or edit == "K" else ROLES["sua"[role]], lead, tail, illegal, cost, not known or turn != turns[k]
        initial, turn, known = own, turns[k], True


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple], list]]:
    """(conversation, range), rows and turns of each part; ``batches`` (conv, range, at, initial, facts, copies, turn) in order."""
    key, rows, turns = None, [], []
    for batch in batches:
        for conv, part, at, initial, facts, copies, turn in zip(*(c.to_pylist() for c in batch.columns)):
            if (conv, part) != key:
                if rows:
                    yield key, rows, turns
                key, rows, turns = (conv, part), [], []
            rows.append((at, initial, facts, copies))
            turns.append(turn)
    if rows:
        yield key, rows, turns


def _table(rows: Iterator[tuple], names: str, types: tuple, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names.split())
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names.split())


def _matrix(rows: list[tuple]) -> tuple[list[list[int]], list[list[int]]]:
    """Cost and place of the next retained turn for each that follows (rows) and each that is ahead (columns); a place of ``FAR``: none in here."""
    made = [sweep(rows, ([0 if q == p else FAR for q in range(4)], [FAR] * 4))[0] for p in range(4)]
    return [[m[0][q] for m in made] for q in range(4)], [[m[1][q] for m in made] for q in range(4)]


def _earlier(matrix: tuple[list[list[int]], list[list[int]]], ahead: Ahead) -> Ahead:
    """What is ahead of a part, from what is ahead of its end."""
    cost, place = [], []
    for q in range(4):
        options = [(matrix[0][q][p] + ahead[0][p], -(ahead[1][q] if p == q and matrix[1][q][p] == FAR else matrix[1][q][p])) for p in range(4) if matrix[0][q][p] < FAR and ahead[0][p] < FAR]
        best = min(options, default=(FAR, -FAR))
        cost.append(best[0])
        place.append(-best[1])
    return cost, place


def _borders(spark: SparkSession, ordered: DataFrame) -> dict[tuple, Border]:
    """Borders of the conversations that reach over ranges: at most two numbers of ranges; found from the first and last row of each range."""
    edges = ordered.groupBy("range").agg(F.min_by(F.struct("conv"), "at").alias("first"), F.max_by(F.struct("conv"), "at").alias("last")).orderBy("range").collect()  # one row a range
    split = {a["last"]["conv"] for a, b in zip(edges, edges[1:]) if a["last"]["conv"] == b["first"]["conv"]}
    if not split:
        return {}
    names = spark.createDataFrame([(c,) for c in split], "conv string")
    parts = ordered.join(F.broadcast(names), ordered["conv"].eqNullSafe(names["conv"]), "left_semi").repartition("conv", "range").sortWithinPartitions("conv", "range", "at")
    parts = parts.select("conv", "range", "at", "initial", "facts", "copies", "turn")
    lists = pa.list_(pa.list_(pa.int64()))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((*key, *_matrix(rows), rows[-1][1], turns[-1]) for key, rows, turns in _grouped(batches))
        yield from _table(found, "conv range costs places initial turn", (pa.string(), pa.int64(), lists, lists, pa.string(), pa.int64()))

    told: dict = {}
    for r in parts.mapInArrow(matrices, "conv string, range long, costs array<array<long>>, places array<array<long>>, initial string, turn long").collect():  # at most two rows a range
        told.setdefault(r["conv"], {})[r["range"]] = r
    out = {}
    for conv, ranges in told.items():
        order, ahead = sorted(ranges), NOTHING
        for n in reversed(range(len(order))):
            r = ranges[order[n]]
            out[conv, order[n]] = Border(ahead, first=n == 0, last=n == len(order) - 1)
            if n:
                out[conv, order[n]].initial, out[conv, order[n]].turn = ranges[order[n - 1]]["initial"], ranges[order[n - 1]]["turn"]
            ahead = _earlier((r["costs"], r["places"]), ahead)
        out[conv, order[0]].follows = choose(START, *ahead)[0]

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for key, rows, _ in _grouped(batches):
                _, chosen = sweep(rows, out[key].ahead)
                ends = []
                for q in range(4):
                    last = (-1, q)
                    for _, role, _, after in walk(chosen, START, q):
                        last = (role, after)
                    ends.append(list(last))
                yield *key, ends

        yield from _table(each(), "conv range ends", (pa.string(), pa.int64(), lists))

    ends = {(r["conv"], r["range"]): r["ends"] for r in parts.mapInArrow(passages, "conv string, range long, ends array<array<long>>").collect()}
    for conv, ranges in told.items():
        order = sorted(ranges)
        for here, later in zip(order, order[1:]):
            border = out[conv, here]
            role, after = ends[conv, here][border.follows]
            out[conv, later].before, out[conv, later].follows = (border.before if role < 0 else role), after
    return out


def key_of(conv: Column, turn: Column, role: Column, text: Column) -> Column:
    """What tells rows apart: a row with equal ones is a repeat."""
    return F.struct(conv.alias("conv"), turn.cast("long").alias("turn"), role.alias("role"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))


def read(conversations: DataFrame, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """``key, text``: rows by what tells them apart. Nulls are one space."""
    conv, turn, role, text = (F.col(f"`{n}`") for n in names)
    role, text = F.coalesce(role, F.lit(" ")), F.coalesce(text, F.lit(" "))
    return conversations.select(key_of(conv, turn, role, text).alias("key"), text.alias("text"))


def plan(turns: DataFrame) -> DataFrame:
    """``key, at, copies, facts`` and the columns of ``RESULT`` for each different row of ``read``'s.

    ``at`` rises in the order of the turns; ``edit`` is that of the first copy, the others are deleted; ``lead`` and ``tail`` are the initials of turns inserted before and
    after it; ``fresh``: the first of its turn number.
    """
    spark = turns.sparkSession
    blank = ~F.col("text").rlike(WORD)
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    counted = turns.select("key", F.when(blank, BLANK).when(~ended, TRUNCATED).otherwise(0).alias("facts")).groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("facts").alias("facts"))
    # a role and text of an earlier turn; conversations with many turns are spread by their texts
    said = F.struct(*[F.col("key")[c].alias(c) for c in ("conv", "role", "h", "g")])
    order = F.struct(F.col("key.turn").isNotNull().alias("known"), F.col("key.turn").alias("turn"))
    counted = counted.withColumn("said", said).withColumn("order", order)
    first = counted.groupBy("said").agg(F.min("order").alias("earliest"))
    seen = counted.join(first, "said").withColumn("facts", F.col("facts") + F.when(F.col("earliest") < F.col("order"), REPEAT).otherwise(0))
    keys = [F.col(f"key.{c}").asc_nulls_first() for c in ("conv", "turn", "role", "h", "g")]
    ranged = seen.select("key", "copies", "facts").repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ordered = stash(ranged, "repair-order").withColumn("range", F.shiftright("at", RANGE_BITS))
    light = ordered.select("range", "at", "facts", "copies", F.col("key.conv").cast("string").alias("conv"), F.col("key.turn").alias("turn"), F.substring("key.role", 1, 1).alias("initial"))
    borders = _borders(spark, light)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for key, rows, turns_ in _grouped(batches) for row in edits(rows, turns_, borders.get(key) or Border()))
        types = (pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.bool_())
        yield from _table(found, " ".join(c.split()[0] for c in RESULT.split(", ")), types)

    parts = light.select("conv", "range", "at", "initial", "facts", "copies", "turn").repartition("conv", "range").sortWithinPartitions("conv", "range", "at")
    return ordered.drop("range").join(parts.mapInArrow(solve, RESULT), "at")


def counts() -> list[Column]:
    """Aggregates of ``plan``'s rows that describe a conversation."""
    turn, facts = F.col("key.turn"), F.col("facts")
    blank, repeat = facts.bitwiseAND(BLANK) > 0, facts.bitwiseAND(REPEAT) > 0
    zero = F.lit(0).cast("long")
    count = lambda c: F.coalesce(F.sum(c).cast("long"), zero)
    return [
        F.coalesce(F.max(turn) - F.min(turn) + 1 - count(F.when(F.col("fresh") & turn.isNotNull(), 1)), zero).alias("gaps"),
        count(F.when(blank, F.col("copies"))).alias("blank"),
        count(F.when(~blank, F.col("copies") - F.when(repeat, 0).otherwise(1))).alias("duplicate"),
        count(F.when(facts == TRUNCATED, 1)).alias("truncated"),
        count(F.col("illegal")).alias("illegal"),
        count(F.col("cost")).alias("cost"),
    ]


def audit() -> Column:
    """The edits of a row of ``plan``, its copies and what is inserted beside it."""
    times = lambda s, n: F.repeat(F.lit(s), n.cast("int"))
    return F.concat(times("I", F.length("lead")), F.col("edit"), times("D", F.col("copies") - 1), times("I", F.length("tail")))


def _inserted(initials: Column) -> Column:
    return F.transform(F.filter(F.split(initials, ""), lambda c: c != ""), lambda c: F.struct(F.when(c == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))


def attach(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """``planned`` with ``turns``: the repaired turns (role, text) that a row stands for, with those inserted beside it."""
    texts = turns.groupBy("key").agg(F.first("text").alias("text"))
    own = F.array(F.struct(F.coalesce("role", "key.role").alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    shown = F.concat(_inserted(F.col("lead")), F.when(F.col("edit") == "D", F.filter(own, lambda t: F.lit(False))).otherwise(own), _inserted(F.col("tail")))
    return planned.join(texts, "key").withColumn("turns", shown).drop("text")


def repair(conversations: DataFrame, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """``conv, place, role, text``: the repaired conversations, turn by turn; ``place`` rises within a conversation and may have gaps."""
    turns = read(conversations, names)
    rows = attach(turns, plan(turns)).select(F.col("key.conv").alias("conv"), "at", F.posexplode("turns").alias("k", "t"))
    return rows.select("conv", (F.col("at") * 4 + F.col("k")).alias("place"), "t.role", "t.text")
