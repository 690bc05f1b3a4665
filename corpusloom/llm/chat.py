"""Chat formatting in windows of a token budget.

Every turn is ``<|im_start|>role, newline, text<|im_end|>, newline``; strings that a
template could take for control strings are escaped inside texts and roles, so the turns
can be read back exactly. Running sums of turn tokens choose turn-aligned spans: each
window has new turns, and before them the conversation's leading system turn and as much
repeated history as the budget leaves (``history`` tokens and 4 turns at most). Loss is
on the texts of a window's new assistant turns; repeated targets are masked, so each
assistant text is trained on once.

A turn longer than ``history`` stands in a window of its own; only a turn (with its
system turn) that is longer than the budget makes a window exceed it, as turns are never
cut. A conversation is cut into slices of 128 turn numbers, and a window's new turns are
of one slice, so one conversation with most of the rows is spread over tasks. A slice is
sent the system turn and the last 4 turns of the slice before it, and the number of windows
before it, which is counted ahead. Texts are dealt once, by slice: windows are made where
their turns lie. Only those of several slices are read twice.

Turns are ordered by turn, role and text, nulls first. Null texts and roles are empty;
turns of a null conversation form one conversation. Repeated rows are turns of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.frames import union_by

from .common import written
from .packing import _tokenizer, default_tokenizer

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common templates; none holds a backslash.
CONTROL = (BEGIN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>")
BUDGET, HISTORY, HISTORY_TURNS, TURN_COST = 2048, 512, 4, 4
SLICE = 128
#: Columns that name a conversation (lost: it has no id), a slice of it, and a turn.
CONV = ["lost", "conv"]
SLICED = [*CONV, "slice"]
TURN = [*SLICED, "turn", "role", "text"]
#: Rows of a slice, in this order: notes (that other slices come before it, how many windows
#: they have, that others follow), the leading system turn and the last turns of slices before
#: it, its own turns.
SLICE_INFO, LEAD, PAST, OWN = range(4)
COMES_LATER, WINDOWS_BEFORE, GOES_ON = range(3)


def escaped(text: Column) -> Column:
    """Backslashes are doubled, and a backslash goes after each control string's first character."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        out = F.replace(out, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _with_tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            n = [len(ids) + TURN_COST for ids in tokenizer.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "tokens"])

    return run


def _count(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")


def _windows(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """rows of slices with the window that each turn is new in, and what later windows need.

    rows are turns of a slice (kind OWN) and what other slices send it (SLICE_INFO, LEAD, PAST).
    """
    order = W.partitionBy(*SLICED).orderBy("kind", "at", "turn", "role", "text")
    before, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    total = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0).cast("long"))
    own = F.col("kind") == OWN
    rows = rows.withColumns({"later": F.max((F.col("kind") == SLICE_INFO) & (F.col("at") == COMES_LATER)).over(upto), "owns": total(_count(own), before)})
    opens = own & (F.col("owns") == 0) & ~F.col("later") & (F.col("role") == "system")
    rows = rows.withColumn("lead", opens | (F.col("kind") == LEAD))
    fresh = own & ~F.col("lead")
    big = fresh & (F.col("tokens") > history)
    rows = rows.withColumns({
        "place": F.row_number().over(order),
        "system": F.coalesce(F.max(F.when(F.col("lead"), F.col("tokens"))).over(upto), F.lit(0).cast("long")),
        "sum": total(F.when(~F.col("lead"), F.col("tokens")), before),
        "small": total(F.when(fresh & ~big, F.col("tokens")), before),
        "bigs": total(_count(big), before),
    })
    room = F.greatest(F.lit(budget - history) - F.col("system"), F.lit(history))
    part = F.when(big | F.col("lead"), F.lit(0).cast("long")).otherwise(F.floor(F.col("small") / room))
    rows = rows.withColumn("span", F.when(own, F.struct((2 * F.col("bigs") + _count(big)).alias("bigs"), part.alias("part"))))
    rows = rows.withColumn("starts", own & ~F.lag("span").over(order).eqNullSafe(F.col("span")))
    return rows.withColumn("window", total(_count(F.col("starts")), upto) - 1)


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer_path: str | None = None) -> DataFrame:
    """Windows: conv_id, window, context_turns, n_turns, tokens, formatted, loss, and
    lost, conv and slice, by which the rows are dealt, and only.

    window counts from 0; context_turns is the number of leading turns that repeat
    others; loss is an array of (start, length) in code points of formatted, from 1;
    only tells that a slice holds its whole conversation.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    conv = F.col("conv_id").cast("long")
    turns = conversations.select(conv.isNull().alias("lost"), F.coalesce(conv, F.lit(0).cast("long")).alias("conv"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    turns = turns.withColumn("slice", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 62)).cast("long"))).select(*TURN)
    counted = lambda df: df.mapInArrow(_with_tokens(tokenizer_path or default_tokenizer()), "lost boolean, conv long, slice long, turn long, role string, text string, tokens long")

    # conversations of several slices: what a slice must know of others
    along = W.partitionBy(*CONV).orderBy("slice")
    slices = turns.groupBy(*SLICED).agg(F.count("*").alias("n"))
    slices = slices.select(*SLICED, F.lag("slice").over(along).alias("before"), F.lead("slice").over(along).alias("after"))
    slices = written(slices.where("before is not null or after is not null"), "slices")
    long = written(counted(turns.join(slices.where("before is null").select(*CONV), CONV, "left_semi").select(*TURN)), "long-turns")
    inside = W.partitionBy(*SLICED)
    placed = long.withColumns({
        "ahead": F.row_number().over(inside.orderBy("turn", "role", "text")),
        "back": F.row_number().over(inside.orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))),
    }).where(f"ahead = 1 or back <= {HISTORY_TURNS}").join(slices, SLICED)
    leads = (F.col("ahead") == 1) & F.col("before").isNull() & (F.col("role") == "system")
    sent = lambda kind, at: [F.lit(kind).alias("kind"), at.cast("int").alias("at"), "turn", "role", "text", "tokens"]
    lead = placed.where(leads).drop("slice").join(slices.where("before is not null").select(*SLICED), CONV).select(*SLICED, *sent(LEAD, F.lit(0)))
    past = placed.where(~leads & (F.col("back") <= HISTORY_TURNS) & F.col("after").isNotNull()).select(*CONV, F.col("after").alias("slice"), *sent(PAST, -F.col("back")))
    nothing = [F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("tokens")]
    at = F.when(F.col("before").isNull(), F.lit(GOES_ON)).otherwise(F.lit(COMES_LATER)).alias("at")
    info = slices.select(*SLICED, F.lit(SLICE_INFO).alias("kind"), at, *nothing)
    given = written(info.unionByName(lead).unionByName(past), "given")
    # windows of earlier slices
    own = lambda df: df.select(*SLICED, *sent(OWN, F.lit(0)))
    numbers = _windows(union_by(SLICED, own(long), given), budget, history).groupBy(*SLICED).agg(F.sum(_count(F.col("starts"))).alias("n"))
    earlier = F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1))
    numbers = numbers.select(*SLICED, earlier.alias("base")).where("base > 0")

    base = numbers.select(*SLICED, F.lit(SLICE_INFO).alias("kind"), F.lit(WINDOWS_BEFORE).alias("at"), *nothing, "base")
    none = F.lit(None).cast("long").alias("base")
    rows = _windows(union_by(SLICED, own(counted(turns)).select("*", none), given.select("*", none), base), budget, history)
    order = W.partitionBy(*SLICED).orderBy("kind", "at", "turn", "role", "text")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({
        "only": ~F.max(F.col("kind") == SLICE_INFO).over(upto),
        "window": F.col("window") + F.coalesce(F.max("base").over(upto), F.lit(0)),
        "system_text": F.max(F.when(F.col("lead"), F.col("text"))).over(upto),
    })
    # a turn goes to its own window and, as history, to windows that start soon after it
    step = lambda window, new, gap: F.struct(window.alias("window"), F.lit(new).alias("new"), gap.cast("long").alias("gap"))
    after = {f"after{j}": F.lead(F.struct("starts", "window", "sum"), j).over(order) for j in range(1, HISTORY_TURNS + 1)}
    may_repeat = (F.col("kind") >= PAST) & ~F.col("lead")
    goals = [F.when(F.col("kind") == OWN, step(F.col("window"), True, F.lit(0)))]
    goals += [F.when(may_repeat & F.col(f"{a}.starts"), step(F.col(f"{a}.window"), False, F.col(f"{a}.sum") - F.col("sum"))) for a in after]
    given_lead = F.when(F.col("starts") & ~F.col("lead"), F.col("system_text"))
    rows = rows.withColumns(after).withColumn("given_lead", given_lead).withColumn("goal", F.explode(F.filter(F.array(*goals), lambda g: g.isNotNull())))

    head = lambda role: F.concat(F.lit(BEGIN), F.replace(escaped(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    new = F.col("goal.new")
    part = F.struct("place", head(F.col("role")).alias("head"), escaped(F.col("text")).alias("body"), new.alias("new"), (new & (F.col("role") == "assistant")).alias("loss"), "tokens", "goal.gap")
    fresh = F.coalesce(F.sum(F.when(new & ~F.col("lead"), F.col("tokens"))), F.lit(0))
    packed = rows.groupBy(*SLICED, F.col("goal.window").alias("window")).agg(F.collect_list(part).alias("parts"), F.max(F.when(new, F.col("given_lead"))).alias("given_lead"), F.max("system").alias("system"), F.max("only").alias("only"), fresh.alias("fresh"))
    free = F.least(F.lit(history), budget - F.col("system") - F.col("fresh"))
    repeated = F.struct(F.lit(0).alias("place"), head(F.lit("system")).alias("head"), escaped(F.col("given_lead")).alias("body"), F.lit(False).alias("new"), F.lit(False).alias("loss"), F.col("system").alias("tokens"), F.lit(0).cast("long").alias("gap"))
    kept = F.array_sort(F.filter("parts", lambda p: p["new"] | (p["gap"] <= F.col("free"))))
    packed = packed.withColumn("free", free).withColumn("parts", F.when(F.col("given_lead").isNull(), kept).otherwise(F.concat(F.array(repeated), kept)))

    whole = F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))))
    empty = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def mask(s: Column, p: Column) -> Column:
        at, size = s["at"] + F.length(p["head"]), F.length(p["body"])
        found = F.struct(at.cast("long").alias("start"), size.cast("long").alias("length"))
        return F.struct((at + size + len(END) + 1).cast("long").alias("at"), F.when(p["loss"], F.concat(s["spans"], F.array(found))).otherwise(s["spans"]).alias("spans"))

    return packed.select(
        F.when(~F.col("lost"), F.col("conv")).alias("conv_id"), *SLICED, "window",
        F.size(F.filter("parts", lambda p: ~p["new"])).cast("long").alias("context_turns"), F.size(F.filter("parts", lambda p: p["new"])).cast("long").alias("n_turns"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("tokens"),
        whole.alias("formatted"), F.aggregate("parts", empty, mask)["spans"].alias("loss"), "only",
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a window."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        inside = F.substr(p, F.lit(len(BEGIN) + 1))
        role = F.regexp_extract(inside, r"(?s)^((?:[^\\\n]|\\.)*+)\n", 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(inside, F.length(role) + 2)).alias("text"))

    return F.transform(pieces, turn)


def digest(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows hold, read back from the formatted texts."""
    turns = read_turns(F.col("formatted"))
    new = F.slice(turns, F.col("context_turns").cast("int") + 1, F.greatest(F.col("n_turns").cast("int"), F.lit(0)))
    told = F.concat_ws("", F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")))))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    # a conversation that is one slice is hashed where its windows lie
    brief = lambda c: F.when(F.col("only"), sha(F.col(c))).otherwise(F.col(c)).alias(c)
    joined = lambda c: F.concat_ws("", F.transform("parts", lambda p: p[c])).alias(c)
    read = windows.select("conv_id", *SLICED, "window", "n_turns", "only", F.struct("window", told.alias("told"), loss.alias("masked")).alias("part"), F.length("formatted").cast("long").alias("chars"))
    slices = read.groupBy(*SLICED).agg(F.array_sort(F.collect_list("part")).alias("parts"), *[F.max(c).alias(c) for c in ("conv_id", "only", "window")], *[F.sum(c).alias(c) for c in ("n_turns", "chars")])
    slices = slices.select("conv_id", "window", "n_turns", "only", "chars", joined("told"), joined("masked"))
    sent = slices.select("conv_id", "n_turns", "only", "chars", F.length("masked").cast("long").alias("loss_chars"), F.struct("window", brief("told"), brief("masked")).alias("part"))
    sums = [F.sum(c).alias(c) for c in ("n_turns", "loss_chars", "chars")]
    gathered = sent.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.max("only").alias("only"), *sums)
    whole = lambda c: F.when(F.col("only"), joined(c)).otherwise(sha(joined(c)))
    return gathered.select("conv_id", "n_turns", whole("told").alias("turns_sha256"), "loss_chars", whole("masked").alias("loss_sha256"), F.col("chars").alias("formatted_chars"))
