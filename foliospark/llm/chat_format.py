"""Operator 2, chat formatting by grammar round trip (DataFrame functions only).

Grammar of a formatted conversation:

    conversation = turn*
    turn         = "<s>" role ( "[INST]" text | "[INST%]" escaped ) "[/INST]</s>"

Role names are always escaped.  Texts are first rendered as they are; a deterministic parser
(split at turn ends, then at the first opening; a text ends at any control string) recovers each
turn from its own rendering, and a turn that differs
from its source is rendered escaped: %, <, [ become %25, %3C, %5B, which leaves no control
string.  The whole conversation is then parsed and compared too; one that still differs is escaped
throughout, which always is the same.  The result is checked again and a difference is an error.

Defined results: null role or text: empty.  Turns of one conversation stand in order of turn
(null first), then role and text; repeated rows are separate turns.  Null conv_id: one
conversation of its own.  Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, OPEN, OPEN_ESCAPED, END = "<s>", "[INST]", "[INST%]", "[/INST]</s>"
LEARNED = "assistant"  # the role under the loss mask
CONTROL = r"(?s)(?:</?s>|\[/?INST%?\])"  # no text runs past one of these


def escape(c: Column) -> Column:
    for raw, code in (("%", "%25"), ("<", "%3C"), ("[", "%5B")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for raw, code in (("[", "%5B"), ("<", "%3C"), ("%", "%25")):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def render(turns: Column, escaped: Column) -> Column:
    """Formatted pieces of turns (structs with role and text); escaped: one flag per turn."""

    def piece(t: Column, flag: Column) -> Column:
        body = F.when(flag, F.concat(F.lit(OPEN_ESCAPED), escape(t["text"]))).otherwise(F.concat(F.lit(OPEN), t["text"]))
        return F.concat(F.lit(BEGIN), escape(t["role"]), body, F.lit(END))

    return F.zip_with(turns, escaped, piece)


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation: structs role, text (unescaped), head, size in code points.

    head counts what stands before the text, size the text as formatted.
    """
    pieces = F.split(formatted, r"\[/INST\]</s>")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        plain, coded = F.locate(OPEN, p), F.locate(OPEN_ESCAPED, p)
        is_coded = (coded > 0) & ((plain == 0) | (coded < plain))
        at = F.when(is_coded, coded).otherwise(plain)
        head = at - 1 + F.when(is_coded, len(OPEN_ESCAPED)).otherwise(len(OPEN))
        body = F.regexp_replace(F.substr(p, head + 1), CONTROL + ".*", "")
        return F.struct(
            unescape(F.substr(p, F.lit(len(BEGIN) + 1), at - len(BEGIN) - 1)).alias("role"),
            F.when(is_coded, unescape(body)).otherwise(body).alias("text"),
            head.cast("long").alias("head"),
            F.char_length(body).cast("long").alias("size"),
        )

    return F.transform(pieces, turn)


def _differs(turns: Column, found: Column) -> Column:
    """A flag per turn: not recovered as it is.  Arrays are zipped, never looked up inside a
    lambda, as an expression in a lambda is evaluated again for every element."""
    same = lambda t, f: f.isNotNull() & f["role"].eqNullSafe(t["role"]) & f["text"].eqNullSafe(t["text"])
    return F.slice(F.zip_with(turns, found, lambda t, f: ~same(t, f)), F.lit(1), F.size(turns))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, escaped_turns) for rows(conv_id, turn, role, text)."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.array(F.col("t"))
    alone = rows.select("conv_id", turn.alias("t")).withColumn("shown", render(own, F.array(F.lit(False)))[0])
    alone = alone.withColumn("found", parse(F.col("shown"))).withColumn("bad", F.coalesce((F.size("found") != 1) | _differs(own, F.col("found"))[0], F.lit(True)))
    piece = F.struct("t.turn", "t.role", "t.text", "bad")
    chats = alone.select("conv_id", piece.alias("p")).groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("turns"))
    # array_sort puts a null turn first within structs
    turns, yes = F.col("turns"), lambda x: x
    chats = chats.withColumn("first", F.array_join(render(turns, F.transform(turns, lambda p: p["bad"])), ""))
    wrong = F.exists(_differs(turns, parse(F.col("first"))), yes)
    chats = chats.withColumn("flags", F.transform(turns, lambda p: p["bad"])).withColumn("wrong", wrong)
    throughout = F.array_join(render(turns, F.transform(turns, lambda p: F.lit(True))), "")
    chats = chats.withColumn("formatted", F.when(F.col("wrong"), throughout).otherwise(F.col("first")))
    same = ~F.col("wrong") | ~F.exists(_differs(turns, parse(F.col("formatted"))), yes)
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a formatted conversation does not parse back")).cast("string"))
    escaped = F.when(F.col("wrong"), F.size(turns)).otherwise(F.size(F.filter("flags", yes)))
    return chats.select("conv_id", checked.alias("formatted"), escaped.alias("escaped_turns"))


def loss_spans(formatted: Column) -> Column:
    """Half-open code-point ranges of the formatted text that the loss covers, in order."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(done: Column, t: Column) -> Column:
        first = done["at"] + t["head"]
        own = F.struct(first.alias("start"), (first + t["size"]).alias("end"))
        spans = F.when(t["role"] == LEARNED, F.concat(done["spans"], F.array(own))).otherwise(done["spans"])
        return F.struct((first + t["size"] + len(END)).alias("at"), spans.alias("spans"))

    return F.aggregate(parse(formatted), start, step, lambda done: done["spans"])


def digest(chats: DataFrame) -> DataFrame:
    """Counts and digests read back from the formatted text alone."""
    turns = chats.select("conv_id", "formatted", "escaped_turns", parse(F.col("formatted")).alias("turns"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == LEARNED), lambda t: t["text"]), "")
    turns = turns.withColumn("loss", loss)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(F.array_join(said, "")).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        sha(F.col("loss")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.col("escaped_turns").cast("long").alias("escaped_turns"),
    )
