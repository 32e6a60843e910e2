"""Chat formatting with a grammar round trip, in DataFrame functions alone.

Grammar: ``conversation = turn*``, ``turn = "<|im_start|>" role "\\n" text "<|im_end|>\\n"``.
A conversation is rendered as it is and parsed again by a deterministic parser; where the
recovered turns are not the source's, the conflicting content is escaped and the result is
parsed and compared again. Escaping adds one backslash inside every ``<|``, ``<\\|``,
``<\\\\|`` ... of a text, so that ``<|`` is left to the template; the parser takes one away.
In a role a line end becomes the control string ``<|nl|>``. Escaping is one to one, so the
second comparison cannot fail; if it did, the query would stop with an error.

The loss mask stands beside the text as runs over its code points: for each turn, how many
to skip and how many to learn from (the text of assistant turns).

Defined results: turns follow ``turn``, then role and text; null roles and texts are empty;
a null turn number comes first; repeated rows are repeated turns; very long texts stay whole
(a conversation has to fit into one string, so 2 GB end it with an error); rows without a
conversation id form one conversation with a null id; extra columns are ignored; an empty
table gives an empty result. One conversation is one row of the output, so it is gathered
whole by definition; nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def render(turns: Column, escaped: bool) -> Column:
    """One string of an array of (role, text)."""
    one = (lambda t: turn_text(escape_role(t["role"]), escape(t["text"]))) if escaped else (lambda t: turn_text(t["role"], t["text"]))
    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """The array of (role, text) that a string spells. Control strings end and begin turns
    wherever they stand; what is no turn of the grammar gets a null role."""
    parts = F.split(formatted, r"<\|im_end\|>", -1)
    head = len(START)

    def turn(part: Column, k: Column) -> Column:
        own = F.when(k == 0, part).otherwise(F.substr(part, F.lit(2)))
        body = F.substr(own, F.lit(head + 1))
        role = F.substring_index(body, "\n", 1)
        known = ((k == 0) | F.startswith(part, F.lit("\n"))) & F.startswith(own, F.lit(START)) & (F.instr(body, "\n") > 0) & (F.instr(body, START) == 0)
        return F.struct(
            F.when(known, unescape_role(role)).alias("role"),
            F.when(known, unescape(F.substr(body, F.length(role) + 2))).otherwise(part).alias("text"),
        )

    none = F.array().cast("array<struct<role:string,text:string>>")
    rest = F.element_at(parts, -1)
    tail = F.when(rest == "\n", none).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("role"), rest.alias("text"))))
    return F.when(formatted == "", none).otherwise(F.concat(F.transform(F.slice(parts, 1, F.size(parts) - 1), turn), tail))


def formatted(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, escaped, turns, loss_mask): one row per conversation. ``turns``
    is what the parser recovers; ``loss_mask`` is an array of (skip, learn)."""
    clean = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    grouped = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("sorted"))
    source = grouped.select("conv_id", F.transform("sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    plain = source.withColumn("formatted", render(F.col("source"), False))
    conflict = ~parse(F.col("formatted")).eqNullSafe(F.col("source"))
    chosen = plain.withColumn("escaped", conflict).withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), True)).otherwise(F.col("formatted")))
    read = chosen.withColumn("turns", parse(F.col("formatted")))
    read = read.withColumn("formatted", F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("formatted")).otherwise(F.raise_error(F.lit("the parsed turns are not the source's"))))

    def run(t: Column) -> Column:
        shown_role = F.when(F.col("escaped"), escape_role(t["role"])).otherwise(t["role"])
        shown = F.when(F.col("escaped"), escape(t["text"])).otherwise(t["text"])
        learn, size = F.when(t["role"] == "assistant", F.length(shown)).otherwise(0), F.length(shown)
        before, after = F.length(shown_role) + len(START) + 1, len(END)
        return F.array(F.struct(before.alias("skip"), learn.alias("learn")), F.struct((size - learn + after).alias("skip"), F.lit(0).alias("learn")))

    return read.withColumn("loss_mask", F.flatten(F.transform("turns", run))).select("conv_id", "formatted", "escaped", "turns", "loss_mask")


def digests(chats: DataFrame) -> DataFrame:
    """The digest columns of ``formatted`` chats: turns as recovered, and the learned text as
    ``loss_mask`` cuts it out of ``formatted``."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("runs"))

    def cut(done: Column, run: Column) -> Column:
        at = done["at"] + run["skip"]
        own = F.substr(F.col("formatted"), at, run["learn"])
        return F.struct((at + run["learn"]).alias("at"), F.when(run["learn"] > 0, F.array_append(done["runs"], own)).otherwise(done["runs"]).alias("runs"))

    runs = F.aggregate("loss_mask", start, cut, lambda done: done["runs"])
    loss = F.array_join(F.transform(runs, lambda r: F.when(F.col("escaped"), unescape(r)).otherwise(r)), "")
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
