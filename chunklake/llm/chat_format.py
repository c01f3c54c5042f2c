"""Preference formatting: the longest common turn prefix of two conversations is the prompt.

Turns are structs ``(role, text)``. The common prefix is rendered once; the rest of each
conversation becomes a completion with a mask, given as spans of code points that are trained on
(the texts of assistant turns with their end marks). Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed marks of the rendered form.
ROLE_OPEN, ROLE_CLOSE, TURN_END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def common_turns(a: Column, b: Column) -> Column:
    """Number of equal leading turns (null-safe on role and text)."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.transform(F.arrays_zip(F.slice(a, F.lit(1), shorter).alias("a"), F.slice(b, F.lit(1), shorter).alias("b")), lambda t: t["a"].eqNullSafe(t["b"]))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(shorter).cast("int")


def head(turn: Column) -> Column:
    return F.concat(F.lit(ROLE_OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(ROLE_CLOSE))


def body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(TURN_END))


def render(turns: Column) -> Column:
    """All turns in the marked form; no turns: the empty text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), body(t))), "")


def trained_spans(turns: Column) -> Column:
    """``array<struct<start,end>>`` of code points in ``render(turns)`` that count in the loss."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.char_length(head(t))
        end = begin + F.char_length(body(t))
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED_ROLE, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """``pairs``: an id and ``chosen`` and ``rejected``, arrays of ``struct<role,text>``.

    Gives ``id, n_prompt_turns, prompt`` and, for each side, ``*_completion`` and ``*_spans``. A null
    conversation counts as one without turns; null roles and texts are rendered empty; equal
    conversations give empty completions; further columns are left out; pairs are never dropped.
    """
    none = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    side = {k: F.coalesce(F.transform(F.col(k), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), none) for k in ("chosen", "rejected")}
    p = pairs.select(F.col(id_col), *(v.alias(k) for k, v in side.items())).withColumn("n", common_turns(F.col("chosen"), F.col("rejected")))
    tail = {k: F.slice(F.col(k), F.col("n") + 1, F.greatest(F.size(k) - F.col("n"), F.lit(0))) for k in side}
    p = p.withColumns({f"{k}_tail": v for k, v in tail.items()})
    return p.select(
        id_col,
        F.col("n").alias("n_prompt_turns"),
        render(F.slice(F.col("chosen"), F.lit(1), F.col("n"))).alias("prompt"),
        *(f(F.col(f"{k}_tail")).alias(f"{k}_{name}") for k in side for name, f in (("completion", render), ("spans", trained_spans))),
    )


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from single conversations: ``pair_id, chosen, rejected`` for every conversation.

    Chosen is the conversation itself. Rejected is what stands before its last assistant turn,
    followed by the last assistant turn of its partner, the conversation whose id differs in the
    lowest bit. Without a partner, or one without such a turn, rejected ends before the reply. A
    conversation without an assistant turn keeps all turns on both sides and the partner's reply is
    added. Turns sort by number, role and text, nulls first; rows without a conversation id belong to none.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.shiftright("conv_id", 1).alias("block"), F.col("conv_id").bitwiseAND(1).alias("odd"), "turn", "role", "text")
    block = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("odd", "turn", "role", "text"))).alias("all"))
    both = block.select("block", F.filter("all", lambda t: t["odd"] == 0).alias("c0"), F.filter("all", lambda t: t["odd"] == 1).alias("c1"))
    side = lambda k: F.struct((F.shiftleft("block", 1) + k).cast("bigint").alias("pair_id"), F.col(f"c{k}").alias("own"), F.col(f"c{1 - k}").alias("other"))
    one = both.select(F.explode(F.array(side(0), side(1))).alias("s")).select("s.*").where(F.size("own") > 0)
    replies = lambda c: F.transform(c, lambda t, i: F.when(t["role"] == TRAINED_ROLE, i + 1))
    one = one.withColumns({"last": F.array_max(replies(F.col("own"))), "reply": F.array_max(replies(F.col("other")))})
    plain = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    before = F.slice(F.col("own"), F.lit(1), F.coalesce(F.col("last") - 1, F.size("own")))
    reply = F.when(F.col("reply").isNull(), F.slice(F.col("other"), F.lit(1), F.lit(0))).otherwise(F.slice(F.col("other"), F.coalesce(F.col("reply"), F.lit(1)), F.lit(1)))
    return one.select("pair_id", plain(F.col("own")).alias("chosen"), plain(F.concat(before, reply)).alias("rejected"))
