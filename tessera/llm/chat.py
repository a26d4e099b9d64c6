"""Multi-party perspective rotation of dialogues: one rendering for every participant.

From a participant's perspective its own turns are the assistant's, all other participants are named users, and turns of
``system`` speakers stay as they are.  The loss mask covers the participant's own words and the mark that ends its turn.

A rendering is

    <|im_start|>assistant\\n{text}<|im_end|>\\n
    <|im_start|>user name={speaker}\\n{text}<|im_end|>\\n
    <|im_start|>system\\n{text}<|im_end|>\\n

and ``mask`` lists start:end of the masked spans in code points, end exclusive, comma-joined.  A control mark written in a
text or a name (``<|``) is broken with a space (``< |``), so a text cannot open a turn; line ends in a name become spaces, so
a name cannot leave its header line.

Turns are numbered and measured as rows; a dialogue's rows meet only in the final rendering, which is one value anyway.

Defined results: turns are ordered by turn, speaker and text, nulls first; a null text is empty; a null speaker is the
participant ``unknown``; repeated rows are repeated turns; a dialogue of system turns alone has no perspective; rows with
a null dialogue id belong to no dialogue and give nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def perspectives(turns: DataFrame, dialogue: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: tuple[str, ...] = ("system",)) -> DataFrame:
    """(conv_id, perspective, n_turns, n_masked, mask, rendered), one row for each dialogue and participant."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    rows = turns.where(F.col(dialogue).isNotNull()).select(
        F.col(dialogue).alias("d"), F.col(turn).alias("n"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("s"), F.coalesce(F.col(text), F.lit("")).alias("x")
    )
    order = Window.partitionBy("d").orderBy("n", "s", "x")
    rows = rows.withColumn("i", F.row_number().over(order))
    who = rows.where(~F.col("s").isin(*system)).select("d", F.col("s").alias("p")).distinct()
    own = F.col("s") == F.col("p")
    head = F.when(F.col("s").isin(*system), F.lit("<|im_start|>system\n")).when(own, F.lit("<|im_start|>assistant\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), safe(F.translate("s", "\n\r", "  ")), F.lit("\n")))
    seen = rows.join(who, "d").select("d", "p", "i", own.alias("own"), head.alias("head"), F.concat(safe(F.col("x")), F.lit("<|im_end|>")).alias("body"))
    before = Window.partitionBy("d", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + 1
    placed = seen.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("own"), F.concat_ws(":", F.col("start").cast("string"), (F.col("start") + F.length("body")).cast("string")))
    whole = placed.select("d", "p", F.struct("i", F.concat("head", "body", F.lit("\n")).alias("t"), span.alias("m")).alias("r"), "own")
    out = whole.groupBy("d", "p").agg(F.sort_array(F.collect_list("r")).alias("rs"), F.count("*").alias("n_turns"), F.count_if("own").alias("n_masked"))
    return out.select(F.col("d").alias(dialogue), F.col("p").alias("perspective"), "n_turns", "n_masked", F.array_join("rs.m", ",").alias("mask"), F.array_join("rs.t", "").alias("rendered"))
