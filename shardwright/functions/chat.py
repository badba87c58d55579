"""Chat templates (F1, F2) as JVM expressions over ``array<struct<role,content>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two chat templates.
# Training template, one turn:  <|im_start|>{role}:\n {content}<|im_end|>\n
# Inference template, one turn: <|im_start|>{role}\n{content}<|im_end|>\n
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
DEFAULT_SYSTEM = "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n"
GENERATION_PROMPT = "<|im_start|>assistant\n"

CHAT_TYPE = "array<struct<role:string,content:string>>"


def turn(role, content) -> Column:
    """One chat turn struct."""
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.cast("string").alias("role"), content.cast("string").alias("content"))


def render_train(chat: Column | str) -> Column:
    """Training template; turns joined with no separator. A null role or
    content prints as ``None``, as string substitution of a null does."""
    chat = F.col(chat) if isinstance(chat, str) else chat
    return F.array_join(F.transform(chat, lambda m: F.concat(
        F.lit(IM_START), F.coalesce(m["role"], F.lit("None")), F.lit(":\n "),
        F.coalesce(m["content"], F.lit("None")), F.lit(IM_END + "\n"))), "")


def render_infer(chat: Column | str, add_generation_prompt: bool = False) -> Column:
    """Inference template: a default system turn when the first role is not
    ``system``, then the turns, then optionally the assistant prompt."""
    chat = F.col(chat) if isinstance(chat, str) else chat
    first_role = F.get(chat, 0)["role"]
    head = F.when((F.size(chat) > 0) & ~first_role.eqNullSafe(F.lit("system")),
                  F.lit(DEFAULT_SYSTEM)).otherwise(F.lit(""))
    body = F.array_join(F.transform(chat, lambda m: F.concat(
        F.lit(IM_START), F.coalesce(m["role"], F.lit("")), F.lit("\n"),
        F.coalesce(m["content"], F.lit("")), F.lit(IM_END + "\n"))), "")
    tail = F.lit(GENERATION_PROMPT if add_generation_prompt else "")
    return F.concat(head, body, tail)
