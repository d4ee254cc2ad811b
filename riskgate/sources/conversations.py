"""Question/answer pairs from a stored conversation table.

A user turn followed by an assistant turn is one pair. The pairing is an
equi-join on (conv_id, turn) = (conv_id, next turn - 1): both sides are hashed
on the pair of keys, so one very long conversation is spread over many tasks
(a window partitioned by conversation would put it in one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgate.functions import text as T


def qa_pairs(conversations: DataFrame, user_role: str = "user",
             assistant_role: str = "assistant", conv: str = "conv_id",
             turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, question, answer_turn, answer, prompt) per adjacent pair."""
    q = (conversations.filter(F.col(role) == user_role)
         .select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                 F.col(text).alias("question")))
    a = (conversations.filter(F.col(role) == assistant_role)
         .select(F.col(conv).alias("conv_id"), (F.col(turn) - 1).alias("turn"),
                 F.col(turn).alias("answer_turn"), F.col(text).alias("answer")))
    return (q.join(a, ["conv_id", "turn"], "inner")
             .withColumn("prompt", T.prompt_text("question", "answer")))
