"""Chat formatting: budgeted, turn-aligned windows over conversations, with a loss mask.

A turn is written as its opening mark, its escaped text and its closing mark. Escaping doubles each backslash and
puts one after the first character of every control string, so that no control string is left in a text; reading
back takes the character after each backslash.

Prefix sums of turn tokens cut a conversation: a turn belongs to window ``before // fresh``. A window begins with
the system turn (if the conversation begins with one), then repeats the turns that began in the last ``history``
tokens before its own range, then holds its own turns. Only the assistant texts among its own turns are under the
loss mask, so each is a target once. A window thus holds at most the system turn, ``history`` and ``fresh`` tokens,
and what the last turn of either kind has over; a turn is never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Prefix, materialise

#: Role, opening mark, closing mark. Other roles are written inside their opening mark.
MARKS = [("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>")]
OTHER = ("<<ROLE:", "::>>", "<</ROLE>>")
CONTROL = [x for _, a, b in MARKS for x in (a, b)] + list(OTHER)
#: One written turn.
TURN = "(?s)" + "|".join([f"\\Q{a}\\E.*?\\Q{b}\\E" for _, a, b in MARKS] + [f"\\Q{OTHER[0]}\\E.*?\\Q{OTHER[2]}\\E"])


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, which: int, other: Column) -> Column:
    out = other
    for mark in reversed(MARKS):
        out = F.when(role == mark[0], F.lit(mark[which])).otherwise(out)
    return out


def format_conversations(rows: DataFrame, fresh: int = 512, history: int = 128) -> DataFrame:
    """Windows of all conversations in ``rows`` (conv_id, turn, role, text; more columns are left out).

    Returns conv_id, window (gaps where one turn covers several), text, ``context`` (how many turns at the start
    are repeated) and ``loss`` (array of [start, end) in code points of ``text``).

    A turn counts a token for each four code points, begun, and four for its marks. Turns go by (turn, role,
    text hash), nulls first; equal rows stay separate turns. Null texts and roles are empty. Null conv_ids form
    one conversation. No rows: no windows. Needs 0 <= history <= fresh.
    """
    if not 0 <= history <= fresh:
        raise ValueError("history must be from 0 to fresh")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.select(
        "conv_id", "turn", role.alias("role"), escape(text).alias("body"), F.xxhash64(text).alias("hash"), F.lit(1).cast("long").alias("one")
    ).withColumn("tokens", F.floor((F.length("body") + 3) / 4).cast("long") + 4)
    placed = Prefix(turns, ["conv_id"], ["turn", "role", "hash"], ["tokens", "one"], "turns").sums()
    k = F.floor(F.col("before_tokens") / fresh).cast("long")
    opening = _by_role(F.col("role"), 1, F.concat(F.lit(OTHER[0]), escape(F.col("role")), F.lit(OTHER[1])))
    turn = placed.select(
        "conv_id", F.col("before_one").alias("at"), (F.col("role") == "assistant").alias("target"),
        opening.alias("open"), "body", _by_role(F.col("role"), 2, F.lit(OTHER[2])).alias("close"), k.alias("k"),
        ((F.col("before_one") == 0) & (F.col("role") == "system")).alias("is_system"),
        ((k + 1) * fresh - F.col("before_tokens") <= history).alias("again"),
    )
    turn = materialise(turn, "turns")  # read twice below
    own = F.struct(F.col("k").alias("window"), F.lit(True).alias("own"))
    next_ = F.struct((F.col("k") + 1).alias("window"), F.lit(False).alias("own"))
    copies = turn.select("*", F.explode(F.when(F.col("again") & ~F.col("is_system"), F.array(own, next_)).otherwise(F.array(own))).alias("in_"))
    part = F.struct("at", "in_.own", "target", "open", "body", "close")
    windows = (
        copies.groupBy("conv_id", F.col("in_.window").alias("window"))  # at most fresh + history tokens and two turns
        .agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("in_.own").alias("any"))
        .filter("any")
    )
    system = turn.filter("is_system").select(
        F.col("conv_id").alias("_c"), F.array(F.struct("at", F.lit(False).alias("own"), "target", "open", "body", "close")).alias("_s")
    )
    windows = windows.join(system, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    windows = windows.withColumn("parts", F.when((F.col("window") > 0) & F.col("_s").isNotNull(), F.concat("_s", "parts")).otherwise(F.col("parts")))
    written = lambda p: F.concat(p["open"], p["body"], p["close"])
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<array<int>>").alias("loss"))

    def add(acc: Column, p: Column) -> Column:
        body = acc["end"] + F.length(p["open"])
        span = F.array(F.array(body, body + F.length(p["body"])))
        return F.struct(
            (acc["end"] + F.length(written(p))).alias("end"),
            F.when(p["own"] & p["target"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"),
        )

    return windows.select(
        "conv_id", "window", F.array_join(F.transform("parts", written), "").alias("text"),
        F.size(F.filter("parts", lambda p: ~p["own"])).alias("context"), F.aggregate("parts", start, add)["loss"].alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What windows say: conv_id, window, formatted_chars, ``turns`` (role and text of own turns, in order), ``targets``."""

    def turn(written: Column) -> Column:
        role, body = F.lit(None).cast("string"), F.lit(None).cast("string")
        head = F.substring_index(written, OTHER[1], 1)
        role = F.when(written.startswith(OTHER[0]), unescape(F.substr(head, F.lit(len(OTHER[0]) + 1))))
        body = F.substr(written, F.length(head) + len(OTHER[1]) + 1, F.length(written) - F.length(head) - len(OTHER[1]) - len(OTHER[2]))
        for name, a, b in MARKS:
            role = F.when(written.startswith(a), F.lit(name)).otherwise(role)
            body = F.when(written.startswith(a), F.substr(written, F.lit(len(a) + 1), F.length(written) - len(a) - len(b))).otherwise(body)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    own = F.expr("slice(turns, context + 1, greatest(size(turns) - context, 0))")
    cut = lambda s: unescape(F.substr(F.col("text"), s[0] + 1, s[1] - s[0]))
    return (
        windows.withColumn("turns", F.regexp_extract_all("text", F.lit(TURN), F.lit(0)))
        .select("conv_id", "window", F.length("text").cast("long").alias("formatted_chars"), F.transform(own, turn).alias("turns"), F.transform("loss", cut).alias("targets"))
    )


def digests(windows: DataFrame) -> DataFrame:
    """One row for each conversation, from its windows alone."""
    each = read_back(windows).select(
        "conv_id", "window", "formatted_chars", F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("targets", "").alias("targets"),
    )
    whole = each.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"),
    )
    turns, loss = F.array_join(F.transform("w", lambda x: x["turns"]), ""), F.array_join(F.transform("w", lambda x: x["targets"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
