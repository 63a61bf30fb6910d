"""Chat formatting: a finite-state machine over roles checks the order of turns, and a declarative template turns each
conversation into text segments with a loss flag. Everything stays in DataFrame operations on the JVM.

Control strings inside roles and texts are escaped so that they can be read back: a backslash becomes backslash e, and
every control string has backslash x put after its first character. Reading back splits at the control strings.

Defined cases: a null role or text counts as empty; turns are ordered by turn, then role, then text, null turns first;
rows that repeat are turns of their own; null conversation ids make one conversation; roles that the machine does not
know are formatted without loss and make the order invalid. Extra columns are ignored, an empty table gives no rows.
A conversation becomes one record, so its own turns, and no others, meet in one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, the roles whose texts carry loss, and the roles that may follow each ("" is the start)."""

    open: str = "<s>[INST] "
    middle: str = " [/INST] "
    close: str = "</s>"
    control: tuple[str, ...] = ("</s>", "<s>", "[/INST]", "[INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: tuple[str, ...] = ("assistant", "user")


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for c in template.control:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\x{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\x"), F.lit("")), F.lit("\\e"), F.lit("\\"))


def _order(turns: Column, template: Template) -> Column:
    """The machine's state after all turns: the last role, or "invalid" from the first turn that may not come."""
    allowed = F.create_map(*(F.lit(f"{a}\0{b}") if i == 0 else F.lit(b) for a, bs in template.follows.items() for b in bs for i in (0, 1)))
    step = lambda state, t: F.coalesce(F.element_at(allowed, F.concat(state, F.lit("\0"), t["role"])), F.lit("invalid"))
    return F.aggregate(turns, F.lit(""), step)


def format_conversations(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, valid, segments (text, loss) and formatted of every conversation, from conv_id, turn, role and text."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        made = ((F.concat(F.lit(template.open), escape(t["role"], template), F.lit(template.middle)), F.lit(False)), (escape(t["text"], template), t["role"].isin(*template.loss_roles)), (F.lit(template.close), F.lit(False)))
        return F.array(*(F.struct(x.alias("text"), loss.alias("loss")) for x, loss in made))

    out = convs.select("conv_id", _order(F.col("turns"), template).isin(*template.final).alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s["text"])))


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, the turns (role, text) read from the formatted text, and the text under the loss mask, read from the
    segments. An escaped text holds no control string, so the splits fall between turns alone."""
    pieces = F.filter(F.split("formatted", "\\Q" + template.close + "\\E"), lambda x: x != "")

    def turn(x: Column) -> Column:
        cut = F.instr(x, template.middle.strip()) - 1
        role = F.substring(x, F.lit(len(template.open) + 1), cut - len(template.open) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(x, cut + len(template.middle), F.length(x))).alias("text"))

    loss = F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])))
    return formatted.select("conv_id", "valid", F.transform(pieces, turn).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digest(back: DataFrame) -> DataFrame:
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "valid",
    )
