"""Chat formatting in budgeted windows.

Built-in functions only. Prefix sums of turn tokens cut a conversation in spans of whole
turns: a turn belongs to the budget interval that it lies in, and one that straddles two
intervals is a window of its own, so a window is within the budget unless a single turn
is longer than that. Windows after the first repeat the leading system turn and the turns
that end the stretch before, up to a limit of tokens; repeated turns are not targets.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles each ``<|`` gets a
backslash (``<\\|``, and ``<\\|`` becomes ``<\\\\|``), so a formatted text holds control
strings only where the template put them, and the change can be undone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, text_or_empty

BUDGET = 1024
HISTORY = 128
#: Least budget of new turns, however long the system turn.
LEAST_BODY = 256
#: Tokens that the markers and the role of a turn count as.
OVERHEAD = 5
#: Turn numbers that one step of the prefix sums spans.
STRIDE = 512
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def escaped_role(c: Column) -> Column:
    return escaped(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(c: Column) -> Column:
    return F.replace(F.replace(unescaped(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def token_count(text: Column) -> Column:
    """Runs of letters and digits, and single other marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys in which nulls are equal; the keys of ``a`` stay."""
    b = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    return a.join(b, reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"__{k}"]) for k in keys)), how).drop(*(f"__{k}" for k in keys))


def turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, pos, role, text, tokens, through): in order of turn, role, text; through: tokens up to and with this turn.

    Sums run inside strides of turn numbers and then over strides, so that one long
    conversation doesn't meet in a single task.
    """
    text = text_or_empty(text_col)
    base = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text_or_empty(role_col).alias("role"), text.alias("text"), (token_count(text) + OVERHEAD).cast("long").alias("tokens"))
    base = base.withColumn("stride", F.floor(F.col("turn") / STRIDE))
    inside = W.partitionBy("conv", "stride").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    dealt = base.withColumns({"pos": F.count(F.lit(1)).over(inside), "through": F.sum("tokens").over(inside)})
    before = W.partitionBy("conv").orderBy("stride").rowsBetween(W.unboundedPreceding, -1)
    sums = base.groupBy("conv", "stride").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    sums = sums.select("conv", "stride", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t"))
    out = _same(dealt, sums, ["conv", "stride"])
    return out.select("conv", (F.col("pos") + F.col("n") - 1).alias("pos"), "role", "text", "tokens", (F.col("through") + F.col("t")).alias("through"))


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, window, n_context, tokens, text, loss_spans): formatted windows in order.

    n_context: how many turns at the head are repeated. loss_spans: (begin, end) in code
    points of ``text``: texts of new assistant turns. Null roles and texts are empty; rows
    with a null conversation are one conversation, and null turns come first. Repeated
    rows are turns of their own. An empty table gives no windows.
    """
    t = saved(turns(rows, conv_col, turn_col, role_col, text_col))
    lead = (F.col("pos") == 0) & (F.col("role") == "system")
    heads = t.where("pos <= 1").groupBy("conv").agg(F.max(F.when(lead, F.col("tokens"))).alias("sys"), F.max(F.when(lead, F.col("text"))).alias("sys_text"), F.max(F.when(F.col("pos") == 1, F.col("tokens"))).alias("second"))
    heads = heads.withColumn("room", F.greatest(F.lit(budget - history) - F.coalesce("sys", F.lit(0)), F.lit(LEAST_BODY)))
    rows = _same(t, heads.drop("sys_text"), ["conv"])
    through = F.col("through") - F.coalesce("sys", F.lit(0))
    rows = rows.withColumns({"lead": lead, "end": through, "begin": through - F.when(lead, 0).otherwise(F.col("tokens"))})
    first, last = F.floor(F.col("begin") / F.col("room")), F.floor((F.col("end") - 1) / F.col("room"))
    window = F.when(F.col("lead"), F.when(F.col("second") > F.col("room"), 1).otherwise(0)).otherwise(2 * first + F.when(first != last, 1).otherwise(0))
    body = saved(rows.select("conv", "pos", "role", "text", "tokens", "lead", "begin", "end", window.cast("long").alias("window")))

    spans = body.where("not lead").groupBy("conv", "window").agg(F.min("begin").alias("at"), F.min("pos").alias("head"))
    # Turns that lie in the last ``history`` tokens before a window; both sides are cut in
    # stretches of that many tokens, so a key holds few rows.
    stretch = F.explode(F.array(F.floor(F.col("at") / history), F.floor(F.col("at") / history) - 1))
    wanted = spans.where("at > 0").select("conv", "window", "at", stretch.alias("stretch"))
    past = body.where("not lead").select("conv", "pos", "role", "text", "tokens", "begin", "end", F.floor(F.col("begin") / history).alias("stretch"))
    repeated = _same(past, wanted, ["conv", "stretch"]).where((F.col("end") <= F.col("at")) & (F.col("begin") >= F.col("at") - history))
    system = _same(spans.where("at > 0"), heads.where("sys is not null"), ["conv"]).select("conv", F.lit(0).cast("long").alias("pos"), F.lit("system").alias("role"), F.col("sys_text").alias("text"), F.col("sys").alias("tokens"), "window", F.lit(1).alias("context"))
    columns = ["conv", "pos", "role", "text", "tokens", "window"]
    every = body.select(*columns, F.lit(0).alias("context")).union(repeated.select(*columns, F.lit(1).alias("context"))).union(system)
    parts = every.groupBy("conv", "window").agg(F.sort_array(F.collect_list(F.struct("pos", "context", "role", "text"))).alias("p"), F.sum("context").alias("n_context"), F.sum("tokens").alias("tokens"))

    made = F.transform("p", lambda x: F.struct(F.concat(F.lit(OPEN), escaped_role(x["role"]), F.lit("\n")).alias("head"), escaped(x["text"]).alias("body"), ((x["context"] == 0) & (x["role"] == "assistant")).alias("target")))
    parts = parts.withColumn("m", made)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct((end + len(CLOSE)).alias("at"), F.when(x["target"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    text = F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    return parts.select(F.col("conv").alias(conv_col), "window", F.col("n_context").cast("int").alias("n_context"), "tokens", text.alias("text"), F.aggregate("m", start, step, lambda a: a["spans"]).alias("loss_spans"))


def parsed(formatted: DataFrame) -> DataFrame:
    """``windows`` rows with ``turns``, (role, text) read back from the formatted text, and ``loss``, the text under the mask."""
    every = F.split("text", r"<\|im_start\|>")
    parts = F.slice(every, F.lit(2), F.size(every) - 1)

    def turn(x: Column) -> Column:
        at = F.instr(x, "\n")
        return F.struct(unescaped_role(F.substr(x, F.lit(1), at - 1)).alias("role"), unescaped(F.substr(x, at + 1, F.length(x) - at - len(CLOSE))).alias("text"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("text"), s["begin"] + 1, s["end"] - s["begin"]))), "")
    return formatted.withColumns({"turns": F.transform(parts, turn), "loss": loss})
