"""Dialogues of several parties, rendered once from the view of every speaker.

Native: only DataFrame functions. A dialogue of any length is a row per message and
perspective with its place in the rendered text, so no row, task or array holds a
whole dialogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..storage import stored
from .common import join_counted

# Turns of one dialogue that one task adds up.
BLOCK = 256
END = "<|end|>\n"


def rotate_perspectives(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    narrators: tuple[str, ...] = ("system",),
) -> DataFrame:
    """One row per dialogue, perspective and message.

    For every speaker who is not a narrator, the dialogue is rendered with that
    speaker as ``assistant`` and every other one as ``user`` with a name; narrators
    keep the role ``system`` in each rendering and are no perspective. Joining
    ``rendered`` in the order of ``position`` gives the text of a rendering, in which
    the row's part is the code points [start_char, end_char). ``trained`` marks the
    perspective's own messages; of those, [mask_start, mask_end) is the message
    with its end mark but without its heading. Both are null for other rows.

    A null speaker is named ``unknown``; a null text is empty. Messages are ordered by
    turn (nulls first), then speaker and text; repeated rows stay. A null dialogue id
    is a dialogue of its own. Dialogues of narrators alone have no perspective and
    no rows. Other columns are ignored.
    """
    rows = turns.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("message"),
    )
    rows = rows.withColumn("__block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    narrator = F.col("speaker").isin(*narrators)
    own = F.col("speaker") == F.col("perspective")
    role = F.when(narrator, "system").when(own, "assistant").otherwise("user")
    heading = F.concat(
        F.lit("<|"), role, F.when(role == "user", F.concat(F.lit(" name="), "speaker")).otherwise(""), F.lit("|>\n")
    )
    # A row for each dialogue and speaker, the input reduced before it moves.
    views = stored(
        rows.where(~narrator).select("conv_id", F.col("speaker").alias("perspective")).distinct(), "perspectives"
    )
    # What each block of turns holds, added up per speaker first, and so all earlier blocks.
    key = ["conv_id", "perspective"]
    said = rows.groupBy("conv_id", "__block", "speaker").agg(
        F.count(F.lit(1)).alias("__rows"), F.sum(F.length("message")).alias("__chars")
    )
    blocks = (
        join_counted(said, views, ["conv_id"], "inner", limit=0)
        .withColumn("__chars", F.col("__chars") + F.col("__rows") * (F.length(heading) + len(END)))
        .groupBy(*key, "__block")
        .agg(F.sum("__rows").alias("__rows"), F.sum("__chars").alias("__chars"))
    )
    earlier = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(
        *key,
        "__block",
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__rows"),
        F.coalesce(F.sum("__chars").over(earlier), F.lit(0)).alias("__chars"),
    ).where("__rows > 0")
    spread = (
        join_counted(rows, views, ["conv_id"], "inner", limit=0)
        .withColumns({"role": role, "__head": heading, "trained": own})
        .withColumn("rendered", F.concat("__head", "message", F.lit(END)))
        .withColumn("__length", F.length("rendered"))
    )
    # Places inside a block of turns.
    inside = Window.partitionBy(*key, "__block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "message")
    placed = spread.withColumns(
        {
            "__row": F.row_number().over(inside) - 1,
            "__end": F.sum("__length").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    # Only dialogues longer than a block have a partner here.
    placed = join_counted(placed, stored(before, "blocks"), [*key, "__block"])
    end = F.coalesce("__chars", F.lit(0)) + F.col("__end")
    return placed.select(
        "conv_id",
        "perspective",
        (F.coalesce("__rows", F.lit(0)) + F.col("__row")).cast("bigint").alias("position"),
        "turn",
        "speaker",
        "role",
        "rendered",
        (end - F.col("__length")).cast("bigint").alias("start_char"),
        end.cast("bigint").alias("end_char"),
        "trained",
        F.when(F.col("trained"), end - F.col("__length") + F.length("__head")).cast("bigint").alias("mask_start"),
        F.when(F.col("trained"), end - 1).cast("bigint").alias("mask_end"),
    )
