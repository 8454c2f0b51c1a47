"""Chat-style guard models: requests as columns, answers parsed; the transport is a callable."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardsieve.functions.text import guard_prompt, parse_guard_codes, parse_guard_labels
from wardsieve.sources.scorers import apply_scorer


def messages(user: Column | str, assistant: Column | str) -> Column:
    """array of (role, content): the user's message, and the assistant's if there is one."""
    user, assistant = (F.col(c) if isinstance(c, str) else c for c in (user, assistant))
    one = F.array(F.struct(F.lit("user").alias("role"), user.alias("content")))
    return F.when(F.coalesce(assistant, F.lit("")) == "", one).otherwise(F.concat(one, F.array(F.struct(F.lit("assistant").alias("role"), assistant.alias("content")))))


def label_payload(user: Column | str, assistant: Column | str, model: str, *, max_tokens: int = 128) -> Column:
    """JSON request of a label-style guard: messages as they are, deterministic sampling."""
    return F.to_json(F.struct(F.lit(model).alias("model"), messages(user, assistant).alias("messages"), F.lit(0.0).alias("temperature"), F.lit(max_tokens).alias("max_tokens")))


def code_payload(user: Column | str, assistant: Column | str, model: str) -> Column:
    """JSON request of a code-style guard: one prompt that holds the conversation."""
    prompt = F.array(F.struct(F.lit("user").alias("role"), guard_prompt(user, assistant, F.lit(model)).alias("content")))
    options = F.struct(F.lit(0.0).alias("temperature"), F.lit(100).alias("num_predict"))
    return F.to_json(F.struct(F.lit(model).alias("model"), prompt.alias("messages"), F.lit(False).alias("stream"), options.alias("options")))


def following(rows: DataFrame, group: str, order: list[str], span: Column, columns: list[str]) -> DataFrame:
    """``rows`` with ``next``: the named columns of the following row of its group, null for the
    last.

    ``span`` cuts the order into stretches, such as hours of a time. Rows are sorted within a
    stretch of a group, and only stretches' first rows within a group, so a group that holds a
    third of all rows is never in one task.
    """
    nxt = F.struct(*columns)
    cut = rows.withColumn("__span", span)
    w = Window.partitionBy(group, "__span").orderBy(*order)
    inside = cut.withColumns({"next": F.lead(nxt).over(w), "__last": F.lead(F.lit(True)).over(w).isNull()})
    firsts = cut.groupBy(group, "__span").agg(F.min(F.struct(*order, nxt.alias("__row"))).alias("f"))
    after = firsts.select(group, "__span", F.lead("f.__row").over(Window.partitionBy(group).orderBy("__span")).alias("__after"))
    joined = inside.join(after, (inside[group] == after[group]) & inside["__span"].eqNullSafe(after["__span"]), "left").drop(after[group]).drop(after["__span"])
    return joined.withColumn("next", F.when(F.col("__last"), F.col("__after")).otherwise(F.col("next"))).drop("__span", "__last", "__after")


def conversation_pairs(turns: DataFrame, span: int = 1_000) -> DataFrame:
    """(conv_id, turn, user, assistant): each user turn with the assistant's next one, if it is
    the very next; from turns (conv_id, turn, role, text). ``span`` turns are sorted in one task."""
    seen = following(turns.select("conv_id", "turn", "role", "text"), "conv_id", ["turn"], F.floor(F.col("turn") / span), ["role", "text"])
    return seen.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user"), F.when(F.col("next.role") == "assistant", F.col("next.text")).alias("assistant"))


def moderate(rows: DataFrame, key: str, user: str, assistant: str, model: str, send: Callable[[Sequence[str]], Sequence[str]], *, style: str = "labels") -> DataFrame:
    """(key, verdict, error): answers of ``send`` to JSON requests, parsed. ``send`` is given
    batches of requests and returns the answers' contents."""
    body = label_payload(user, assistant, model) if style == "labels" else code_payload(user, assistant, model)
    answers = apply_scorer(rows.select(key, body.alias("__body")), key, "__body", send)
    parsed = parse_guard_labels("result") if style == "labels" else parse_guard_codes("result")
    return answers.select(key, F.when(F.col("error").isNull(), parsed).alias("verdict"), "error")


def model_names(answer: str, list_key: str, name_key: str) -> list[str]:
    """Names in a model list, such as {"data": [{"id": ...}]} or {"models": [{"name": ...}]}."""
    import json

    return [m[name_key] for m in json.loads(answer).get(list_key, [])]
