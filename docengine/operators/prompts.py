"""Prompts put together from ordered parts within a budget of characters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import text as T

#: Room that is left for the note of a cut text.
NOTE = 80


@dataclass(frozen=True)
class Budget:
    """Most characters of a document, of instructions, of the description of the output, and of a whole prompt."""

    document: int = 80_000
    instructions: int = 8_000
    output: int = 2_000
    total: int = 100_000

    def fits(self, size: Column) -> Column:
        return size <= self.total


def cut(text: Column, cap: Column) -> Column:
    """A text of no more than cap and NOTE characters: beyond cap it ends at the last blank line within, else at cap, and a note
    says how much is shown."""
    head = F.substring(text, F.lit(1), cap.cast("int"))
    at = T.last_index(head, "\n\n") - 1
    kept = F.when(at > 0, F.substring(head, F.lit(1), at.cast("int"))).otherwise(head)
    note = F.concat(F.lit("\n\n_[showing first "), F.length(kept).cast("string"), F.lit(" of "), F.length(text).cast("string"), F.lit(" chars]_\n"))
    return F.when(F.length(text) <= cap, text).otherwise(F.concat(kept, note))


def dealt(parts: DataFrame, group: tuple[str, ...], room: int, budget: Budget) -> DataFrame:
    """The parts (group, pos, name, text) of each group that have room, in order of pos and name: each within the budget of a
    document, the one on the border cut to what is left, those after it left out. Sizes are summed without the texts, which
    are joined to the few that stay."""
    key = (*group, "pos", "name")
    size = F.least(F.length("text"), F.lit(budget.document + NOTE)).cast("long")
    before = F.sum("size").over(Window.partitionBy(*group).orderBy("pos", "name")) - F.col("size")
    placed = parts.select(*key, size.alias("size")).withColumn("left", F.lit(room) - before).filter(F.col("left") > NOTE)
    kept = parts.join(placed, list(key))
    cap = F.when(F.col("size") <= F.col("left"), F.lit(budget.document)).otherwise(F.least(F.lit(budget.document), F.col("left") - NOTE))
    return kept.select(*key, cut(F.col("text"), cap).alias("text"))


def assembled(requests: DataFrame, parts: DataFrame, group: tuple[str, ...], budget: Budget = Budget()) -> DataFrame:
    """One prompt for each of requests (group, instructions, output): its instructions, the texts of its parts in order under
    their names, and what the reply has to look like; never longer than the budget. A request without parts has none between."""
    limited = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    room = budget.total - budget.instructions - budget.output - 2 * len("\n\n")
    marked = parts.withColumn("text", F.concat(F.lit("## "), F.col("name"), F.lit("\n"), F.col("text"), F.lit("\n")))
    texts = dealt(marked, group, room, budget).groupBy(*group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name", "text"))), lambda x: x["text"]), "").alias("texts"), F.count("*").cast("int").alias("n_parts"))
    out = requests.join(texts, list(group), "left")
    prompt = F.concat_ws("\n\n", limited(F.col("instructions"), budget.instructions), F.coalesce("texts", F.lit("")), limited(F.col("output"), budget.output))
    return out.select(*group, F.coalesce("n_parts", F.lit(0)).alias("n_parts"), prompt.alias("prompt"))
