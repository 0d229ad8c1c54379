"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens give each turn the furthest end of a span that would begin with it: the largest sum within the room that a window has for
new turns (its budget less the system turn and the history; the first window has no history). These pointers are followed from a conversation's first turn by doubling, so that a
conversation of n spans needs log n joins and no sequential packing. Every window shows the system turn, then as
many turns before its span as fit into the history budget, then the span. The loss mask covers assistant texts of the span
alone, so a repeated target is masked. Sums are searched in steps of the room: a sum and the largest one below it lie in one step or in two neighbours.

Turns are sorted once, with their texts; windows are planned on token counts alone; texts are attached to the plan in one join and
gathered by window.

Turns are written ``<|turn|>role\\ntext<|end|>``. Control strings of this and common other templates inside a text get a backslash
after their first bracket, and one more if they have some, which is undone exactly. In roles, % and line ends are
percent-encoded.

Defined cases. Null role or text: empty. Turns are ordered by turn (null first), then role, then text, so that ties and
repeated rows have a fixed place. A null conversation id is a conversation. A turn longer than the room: a window of its own,
over budget and whole. Only a system turn: one window. Empty table: empty result. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.llm.common import n_words, stash

BUDGET = 512
HISTORY = 128
#: Tokens that the marks of a turn count as.
MARKS = 3
#: Where ``monotonically_increasing_id`` puts the number of the range.
RANGE_BITS = 33
TURN, END = "<|turn|>", "<|end|>"
CONTROL = r"(\|(?:turn|end)\|>|/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _sums(told: DataFrame, budget: int, history: int) -> DataFrame:
    """``conv, at, system, from, to`` (prefix sums without the system turn) and ``room`` of each turn, without its text.

    ``told``: turns with ``at``, a number that rises in the order of the turns and names their range in its upper bits. Sums run over all
    turns of all conversations at once, range by range, less what comes before the conversation, so that a conversation of any length is spread
    over tasks.
    """
    rows = told.select("conv", "at", "tokens", (F.col("role") == "system").alias("opens"), F.shiftright("at", RANGE_BITS).alias("range"))
    sums = rows.groupBy("range").agg(F.sum("tokens").alias("sum"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("earlier"))  # one row a range
    within = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(offsets), "range").withColumn("sum", F.col("earlier") + F.sum("tokens").over(within))
    first = rows.groupBy("conv").agg(F.min(F.struct("at", "sum", "opens", "tokens")).alias("first")).select(F.col("conv").alias("c"), "first")
    rows = rows.join(first, rows["conv"].eqNullSafe(first["c"]))
    before = F.col("first.sum") - F.when(F.col("first.opens"), 0).otherwise(F.col("first.tokens"))
    to = F.col("sum") - before
    system = F.col("first.opens") & (F.col("at") == F.col("first.at"))
    room = F.greatest(F.lit(1), budget - history - F.when(F.col("first.opens"), F.col("first.tokens")).otherwise(0)).cast("long")
    rows = rows.select("conv", "at", system.alias("system"), F.when(system, to).otherwise(to - F.col("tokens")).alias("from"), to.alias("to"), room.alias("room"))
    return rows


def _asof(points: DataFrame, keys: DataFrame, value: str, out: str) -> DataFrame:
    """``points`` (conv, room, p, ...) with ``out``: the largest ``value`` of ``keys`` (conv, room, value) that is at most p and in p's step of the room or the one before."""
    step = lambda c: F.floor(F.col(c) / F.col("room"))
    known = keys.select("conv", "room", value).distinct()
    tops = known.groupBy("conv", step(value).alias("__before")).agg(F.max(value).alias("__top")).select(F.col("conv").alias("__c"), (F.col("__before") + 1).alias("__before"), "__top")
    names = points.columns
    events = points.withColumns({"__step": step("p"), "__v": F.col("p"), "__k": F.lit(1), "__has": F.lit(None).cast("long")})
    own = known.select("conv", "room", F.col(value).alias("__has"), step(value).alias("__step"), F.col(value).alias("__v"), F.lit(0).alias("__k"))
    events = events.unionByName(own, allowMissingColumns=True)
    w = Window.partitionBy("conv", "__step").orderBy("__v", "__k").rowsBetween(Window.unboundedPreceding, 0)  # a step holds as many turns as the budget
    found = events.withColumn("__last", F.last("__has", ignorenulls=True).over(w)).filter("__k = 1")
    found = found.join(tops, found["conv"].eqNullSafe(tops["__c"]) & (found["__step"] == tops["__before"]), "left")
    return found.select(*names, F.coalesce("__last", "__top").alias(out))


def _starts(turns: DataFrame, history: int) -> DataFrame:
    """``conv, room, start``: where spans begin, in tokens; ``turns``: conv, from, to, room."""
    total = turns.groupBy("conv", "room").agg(F.max("to").alias("total"), F.max(F.when(F.col("to") <= F.col("room") + history, F.col("to"))).alias("first"))
    total = stash(total, "chat-totals")
    long = total.filter(F.col("total") > F.col("room") + history)
    reached = total.select("conv", "room", F.lit(0).cast("long").alias("start"))
    spans = long.agg(F.max(2 * F.col("total") / F.col("room") + 2)).first()[0]  # more than any conversation has
    if not spans:
        return reached
    several = turns.join(long.select(F.col("conv").alias("c"), "total", "first"), turns["conv"].eqNullSafe(F.col("c"))).drop("c")
    points = several.select("conv", "room", "from", "to", "total", "first", (F.col("from") + F.col("room")).alias("p"))
    ahead = _asof(points, several, "to", "end").groupBy("conv", "room", "from").agg(F.max(F.greatest("to", F.coalesce("end", "to"))).alias("end"), F.max("to").alias("own"), F.max("first").alias("first"), F.max("total").alias("total"))
    end = F.when(F.col("from") == 0, F.greatest("own", F.coalesce("first", "own"))).otherwise(F.col("end"))
    jumps = stash(ahead.withColumn("end", end).filter(F.col("end") < F.col("total")).select("conv", F.col("from").alias("a"), F.col("end").alias("b")), "chat-jumps")
    reached = stash(reached, "chat-starts")
    for _ in range(int(spans).bit_length()):
        step = jumps.select(F.col("conv").alias("c"), "a", "b")
        on = reached["conv"].eqNullSafe(step["c"]) & (reached["start"] == step["a"])
        reached = stash(reached.unionByName(reached.join(step, on).select("conv", "room", F.col("b").alias("start"))), "chat-starts")
        twice = step.select("c", F.col("a").alias("m"), F.col("b").alias("z"))
        jumps = stash(jumps.join(twice, jumps["conv"].eqNullSafe(twice["c"]) & (jumps["b"] == twice["m"])).select("conv", "a", F.col("z").alias("b")), "chat-jumps")
        if jumps.isEmpty():
            break
    return reached


def planned(told: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conv, span, at, fresh``: which turns each window shows, and whether as new ones; no texts."""
    rows = stash(_sums(told, budget, history), "chat-sums")
    turns = rows.filter("NOT system").drop("system")
    starts = _starts(turns, history)
    # a span is named by where it begins; turns without tokens go with what follows them
    placed = _asof(turns.withColumn("p", F.col("from")), starts, "start", "span").drop("p", "room")
    turns = stash(placed.withColumn("span", F.coalesce("span", F.lit(0).cast("long"))), "chat-plan")
    spans = turns.groupBy("conv", "span").agg(F.min("from").alias("begin"))
    own = turns.select("conv", "span", "at", F.lit(True).alias("fresh"))
    # a turn is history of the spans that begin within the history budget after it: an equality on steps of that width
    step = max(1, history)
    past = turns.filter(F.col("to") - F.col("from") <= history).withColumn("step", F.explode(F.sequence(F.floor(F.col("to") / step), F.floor((F.col("from") + history) / step))))
    stepped = spans.select(F.col("conv").alias("c"), F.col("span").alias("s"), "begin", F.floor(F.col("begin") / step).alias("b"))
    past = past.join(stepped, past["conv"].eqNullSafe(stepped["c"]) & (past["step"] == stepped["b"]) & (F.col("begin") >= F.col("to")) & (F.col("begin") <= F.col("from") + history))
    past = past.select("conv", F.col("s").alias("span"), "at", F.lit(False).alias("fresh"))
    systems = rows.filter("system").select("conv", "at")
    started = spans.select(F.col("conv").alias("c"), "span", "begin")
    lead = systems.join(started, systems["conv"].eqNullSafe(started["c"]), "left")
    lead = lead.select("conv", F.coalesce("span", F.lit(0)).alias("span"), "at", (F.coalesce("begin", F.lit(0)) == 0).alias("fresh"))
    return own.unionByName(past).unionByName(lead)


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Column | None = None, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """``conv, window, lead, formatted, loss``: windows by number (gaps may occur); the first ``lead`` turns of one are repeats;
    ``loss`` has (start, length) in code points of what is to be learnt."""
    conv, turn, role, text = names
    turns = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", n_words(F.col("text")) + MARKS if tokens is None else tokens)
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    told = stash(turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "chat-turns")
    shown = planned(told, budget, history).join(told.select("at", "role", "text"), "at")
    body = F.struct("at", "fresh", (F.col("role") == "assistant").alias("learn"), F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    windows = shown.groupBy("conv", "span").agg(F.array_sort(F.collect_list(body)).alias("turns"))  # as many as the budget holds
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def mask(acc: Column, t: Column) -> Column:
        begin, size = acc["at"] + F.length(t["head"]), F.length(t["body"])
        loss = F.when(t["learn"] & t["fresh"], F.concat(acc["loss"], F.array(F.struct(begin.alias("start"), size.alias("length"))))).otherwise(acc["loss"])
        return F.struct((begin + size + len(END)).alias("at"), loss.alias("loss"))

    return windows.select(
        "conv",
        F.col("span").alias("window"),
        F.size(F.filter("turns", lambda t: ~t["fresh"])).alias("lead"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", start, mask, lambda acc: acc["loss"]).alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """``conv, window, turns, learnt, formatted``: the new turns (role, text) of each window and the texts under its mask, from the output alone."""
    parts = F.split(F.col("formatted"), END.replace("|", r"\|"), -1)
    after = lambda x: F.substr(x, F.lit(len(TURN) + 1))
    split = lambda x: F.struct(unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substr(x, F.instr(x, "\n") + 1)).alias("text"))
    new = F.slice(F.transform(parts, after), F.col("lead") + 1, F.size(parts) - 1 - F.col("lead"))
    learnt = F.transform("loss", lambda x: unescape(F.substr(F.col("formatted"), x["start"] + 1, x["length"])))
    return windows.select("conv", "window", F.transform(new, split).alias("turns"), learnt.alias("learnt"), "formatted")
