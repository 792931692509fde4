r"""Operator 5: chat formatting with Spark expressions only.

Template: ``<s>``, then one block per stretch of turns of one role, the turns in it parted by ``<t>``:

    user        [INST]text[/INST]
    assistant   [OUT]text</s>
    other role  [ROLE]role[/ROLE]text[END]

A text may hold such strings itself. Escaping puts a backslash behind the opening bracket of each control
string, and of each that already has backslashes there; unescaping takes one away. So escaping is
reversible, and no escaped text holds a control string: one can't begin in a text and end in a marker
either, as each has a single bracket that opens it, its first character.

A conversation becomes one string, so its turns do meet in one row; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name

_CONTROL = r"/?s>|t>|/?INST\]|OUT\]|/?ROLE\]|END\]"
_BLOCK = r"(?s)(?:\[INST\]|\[OUT\]|\[ROLE\].*?\[/ROLE\]).*?(?:\[/INST\]|</s>|\[END\])"
_OPEN = r"^(?s)(?:\[INST\]|\[OUT\]|\[ROLE\].*?\[/ROLE\])"
#: An array has fewer than 2**31 elements.
_DOUBLINGS = 31
_CLOSE = r"(?:\[/INST\]|</s>|\[END\])$"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_CONTROL})", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\(?={_CONTROL})", "$1$2")


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start, length in code points, from 0).

    Turns are sorted by turn, then role, then text; null turns come first, null roles and texts count as empty,
    repeated rows stay as turns of their own, null conv_ids form a conversation. Spans cover each assistant text as it
    stands in ``formatted`` (escaped). Other columns are left out, whatever their names; an empty table gives no rows; very long
    texts and conversations take time by their length.
    """
    blank = F.lit("")
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, blank).alias("role"), F.coalesce(text, blank).alias("text"))
    chats = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))

    opening = lambda r: F.when(r == "user", "[INST]").when(r == "assistant", "[OUT]").otherwise(F.concat(F.lit("[ROLE]"), escape(r), F.lit("[/ROLE]")))
    closing = lambda r: F.when(r == "user", "[/INST]").when(r == "assistant", "</s>").otherwise("[END]")
    # Each turn knows whether it begins or ends a stretch of its role.
    n, at = F.size("turns"), lambda i: F.get("turns", i)["role"]
    part = lambda t, i: F.struct(
        t["role"].alias("role"), escape(t["text"]).alias("body"), ((i == 0) | (at(i - 1) != t["role"])).alias("first"), ((i == n - 1) | (at(i + 1) != t["role"])).alias("last")
    )
    chats = chats.select("conv_id", F.transform("turns", part).alias("parts"))
    # Adjacent turns of one role merge: a stretch is a slice of the turns, aggregated to one string.
    places = F.transform("parts", lambda p, i: F.when(p["first"], i))
    chats = chats.select("conv_id", "parts", F.array_compact(places).alias("starts"))
    stretch = lambda s, k: F.slice("parts", s + 1, F.coalesce(F.get("starts", k + 1), F.size("parts")) - s)
    merged = lambda r: F.concat(opening(r[0]["role"]), F.array_join(F.transform(r, lambda p: p["body"]), "<t>"), closing(r[0]["role"]))
    chats = chats.select("conv_id", "parts", F.transform("starts", stretch).alias("stretches"))
    formatted = F.concat(F.lit("<s>"), F.array_join(F.transform("stretches", merged), ""))

    # Where each turn ends: sums of lengths over 1, 2, 4, ... turns back, so that long conversations take little more time than their length.
    tail = lambda p: F.when(p["last"], F.length(closing(p["role"]))).otherwise(3)
    length = lambda p: F.when(p["first"], F.length(opening(p["role"]))).otherwise(0) + F.length(p["body"]) + tail(p)
    chats = chats.select("conv_id", "parts", formatted.alias("formatted"), F.transform("parts", length).alias("ends"))
    for k in range(_DOUBLINGS):
        further = F.transform("ends", lambda x, i: x + F.coalesce(F.get("ends", i - (1 << k)), F.lit(0)))  # noqa: B023
        chats = chats.withColumn("ends", F.when(F.size("ends") > (1 << k), further).otherwise(F.col("ends")))
    span = lambda p, i: F.when(p["role"] == "assistant", F.struct((3 + F.get("ends", i) - tail(p) - F.length(p["body"])).alias("start"), F.length(p["body"]).alias("length")))
    return chats.select("conv_id", "formatted", F.array_compact(F.transform("parts", span)).alias("loss_spans"))


def read_chats(chats: DataFrame) -> DataFrame:
    """``chats`` with turns (array of role, text) and loss_texts (array), read back from the strings and spans.

    A null string has null turns; repeated rows are read each; an empty table gives no rows; other columns pass through, whatever their names; very long
    conversations take time by their length.
    """
    found = free_name(chats, "__blocks")
    blocks = chats.withColumn(found, F.regexp_extract_all("formatted", F.lit(_BLOCK), F.lit(0)))
    body = lambda b: F.regexp_replace(F.regexp_replace(b, _OPEN, ""), _CLOSE, "")
    named = lambda b: F.when(b.startswith("[INST]"), "user").when(b.startswith("[OUT]"), "assistant").otherwise(unescape(F.regexp_extract(b, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)))
    turns = F.flatten(F.transform(found, lambda b: F.transform(F.split(body(b), "<t>", -1), lambda t: F.struct(named(b).alias("role"), unescape(t).alias("text")))))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return blocks.select(*chats.columns, turns.alias("turns"), loss.alias("loss_texts"))


def digests(read: DataFrame) -> DataFrame:
    """The digest columns of what read_chats() gives."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
