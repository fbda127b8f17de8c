"""Conversation state: a fold over a conversation's ordered turns, batch or streaming."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_TURNS = 20
_NAME = re.compile(r"\b[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'-]+(?: [A-Z][A-Za-zÀ-ÖØ-öø-ÿ'-]+){1,3}")
# Role words that the memory keeps holders of.
ROLES = ("prime minister", "president", "director", "professor", "minister", "ceo")


def fold(turns: list[tuple[int, str, str]]) -> dict:
    """State after the last ``MOST_TURNS`` turns: names in order of first use, and for each role word the name that stood nearest behind it last."""
    names: dict[str, None] = {}
    roles: dict[str, str] = {}
    last = ""
    for _, role, text in sorted(turns, key=lambda t: t[0])[-MOST_TURNS:]:
        last = role or ""
        for m in _NAME.finditer(text or ""):
            names.setdefault(m[0])
        for word in ROLES:
            for m in re.finditer(rf"(?i)\b{word}\b", text or ""):
                after = _NAME.search(text, m.end())
                if after and after.start() - m.end() <= 40:
                    roles[word] = after[0]
    return {"last_role": last, "entities": "; ".join(names), "roles": "; ".join(f"{k}={v}" for k, v in sorted(roles.items()))}


def state(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turns``, ``last_role``, ``entities``, ``roles``, a row per conversation; rows with a null conv_id are one conversation.

    The last ``MOST_TURNS`` turns of each are picked in the JVM (a limit within each task comes before the shuffle), so that
    a fold sees no more rows than that however long the conversation is. A null turn comes before all others; ties are taken
    in the order of role and text. Null texts name nothing. Other columns are not read.
    """
    latest = Window.partitionBy("conv_id").orderBy(F.desc_nulls_last("turn"), F.desc_nulls_last("role"), F.desc_nulls_last("text"))
    rows = conversations.select("conv_id", "turn", "role", "text")
    last = rows.withColumn("nth", F.row_number().over(latest)).where(F.col("nth") <= MOST_TURNS)
    folded = last.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("nth")).alias("at"), "role", "text"))).alias("told"))
    counts = rows.groupBy("conv_id").agg(F.count("*").cast("int").alias("turns")).withColumnRenamed("conv_id", "of")
    joined = folded.join(counts, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "turns", "told")

    def run(batches):
        for b in batches:
            got = [fold([(x["at"], x["role"], x["text"]) for x in t]) for t in b.column("told").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turns"), *(pa.array([g[k] for g in got], pa.string()) for k in ("last_role", "entities", "roles"))], names=["conv_id", "turns", "last_role", "entities", "roles"])

    return joined.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, turns int, last_role string, entities string, roles string")


def resolved(question: str, roles: dict[str, str]) -> str:
    """A question with role references ("the president") replaced by the remembered holder, the longest role first."""
    for word in sorted(roles, key=len, reverse=True):
        question = re.sub(rf"(?i)\bthe {re.escape(word)}\b", roles[word], question)
    return question
