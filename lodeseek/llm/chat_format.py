r"""Chat formatting by grammar round trip [native].

A conversation becomes one string. Grammar, in order of the turns:

    turn := "<s>[" TAG FLAG "] " BODY " [/" TAG "]</s>"
    TAG  := "INST" (user) | "ASST" (assistant) | "SYS" (system) | "ROLE:" escaped role
    FLAG := "" (BODY is the text) | "~" (BODY is the escaped text)

The parser is deterministic: leftmost, shortest match. A turn is first rendered as it is and reparsed; if it holds a
control string or the parser does not give back exactly that turn, the control strings in it are escaped and it is
reparsed; if that does not suffice either, every "<" and "[" is. Escapes: "\" -> "\s", "<" -> "\l", "[" -> "\b". As every rendered turn reparses to exactly itself,
so does their concatenation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAMMAR = r"(?s)<s>\[(INST|ASST|SYS|ROLE:[^\]~]*)(~?)\] (.*?) \[/\1\]</s>"
#: What starts a control string.
CONTROL_LT, CONTROL_BR = r"<(?=/?s>)", r"\[(?=/?(?:INST|ASST|SYS|ROLE:))"


def _all(c: Column, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(GRAMMAR), F.lit(group))


def _escape_control(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\s"))
    return F.regexp_replace(F.regexp_replace(c, CONTROL_LT, r"\\l"), CONTROL_BR, r"\\b")


def _escape_every(c: Column) -> Column:
    for a, b in (("\\", "\\s"), ("<", "\\l"), ("[", "\\b")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _unescape(c: Column) -> Column:
    for a, b in (("\\l", "<"), ("\\b", "["), ("\\s", "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _tag(role: Column) -> Column:
    other = _escape_every(role)
    for a, b in (("]", "\\c"), ("~", "\\t")):
        other = F.replace(other, F.lit(a), F.lit(b))
    return (
        F.when(role == "user", "INST").when(role == "assistant", "ASST").when(role == "system", "SYS").otherwise(F.concat(F.lit("ROLE:"), other))
    )


def _role(tag: Column) -> Column:
    other = F.substring(tag, 6, 2**31 - 1)
    for a, b in (("\\t", "~"), ("\\c", "]")):
        other = F.replace(other, F.lit(a), F.lit(b))
    return F.when(tag == "INST", "user").when(tag == "ASST", "assistant").when(tag == "SYS", "system").otherwise(_unescape(other))


def _render(tag: Column, flag: str, body: Column) -> Column:
    return F.concat(F.lit("<s>["), tag, F.lit(f"{flag}] "), body, F.lit(" [/"), tag, F.lit("]</s>"))


def format_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> the same rows with `body`, `escaped` and `rendered`. Null role or text: empty."""
    base = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("tag", _tag(F.col("role")))
    plain, one, two = F.col("text"), _escape_control(F.col("text")), _escape_every(F.col("text"))
    same = lambda r, b: (F.size(_all(r, 3)) == 1) & (_all(r, 3)[0] == b) & (_all(r, 0)[0] == r)
    control = plain.rlike(f"{CONTROL_LT}|{CONTROL_BR}")
    base = base.withColumn(
        "level",
        F.when(~control & same(_render(F.col("tag"), "", plain), plain), 0)
        .when(same(_render(F.col("tag"), "~", one), one) & (_unescape(one) == plain), 1)
        .otherwise(2),
    )
    body = F.when(F.col("level") == 0, plain).when(F.col("level") == 1, one).otherwise(two)
    rendered = F.when(F.col("level") == 0, _render(F.col("tag"), "", F.col("body"))).otherwise(_render(F.col("tag"), "~", F.col("body")))
    return base.withColumn("body", body).withColumn("rendered", rendered)


def format_conversations(rows: DataFrame) -> DataFrame:
    """Conversations as training strings: (conv_id, formatted, loss_spans array<struct<start,end>>).

    rows: (conv_id, turn, role, text), further columns are ignored. Turns stand by turn, then role, then text, nulls
    first; repeated rows are repeated turns; rows without conv_id form one conversation. A loss span covers an
    assistant's body in code points, end exclusive. One conversation is one row of output and so must fit in memory.
    No rows: no conversations.
    """
    turns = format_turns(rows)
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("rendered").cast("long")).over(w), F.lit(0))
    opening = F.length("tag") + F.when(F.col("level") == 0, 6).otherwise(7)
    turns = turns.withColumn("start", at + opening).withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    span = F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("end"))
    got = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "rendered"))).alias("r"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("loss_spans"),
    )
    return got.select("conv_id", F.array_join(F.transform("r", lambda x: x["rendered"]), "").alias("formatted"), "loss_spans")


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """Adds `turns` array<struct<role,text>>, read back from `formatted` by the grammar alone."""
    f = F.col("formatted")
    z = F.arrays_zip(_all(f, 1).alias("t"), _all(f, 2).alias("f"), _all(f, 3).alias("b"))
    read = F.transform(z, lambda x: F.struct(_role(x["t"]).alias("role"), F.when(x["f"] == "~", _unescape(x["b"])).otherwise(x["b"]).alias("text")))
    return formatted.withColumn("turns", read)


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted strings hold, read back from them and from their loss spans."""
    parsed = parse_conversations(formatted)
    f = F.col("formatted")
    # the two characters before a body end its tag: "~]" marks an escaped one
    body = lambda s: F.substring(f, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    marked = lambda s: F.substring(f, (s["start"] - 2).cast("int"), F.lit(3)) == "~] "
    lost = F.array_join(F.transform("loss_spans", lambda s: F.when(marked(s), _unescape(body(s))).otherwise(body(s))), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.withColumn("loss", lost).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
