r"""Chat formatting checked by a grammar round trip, in DataFrame functions only.

Grammar of the rendered text::

    conversation = turn*
    turn         = "### " role ": " text " </turn>" newline

Inside roles and texts a backslash starts an escape: ``\b`` is a backslash,
``\h`` is ``###``, ``\e`` is ``</turn>`` and ``\c`` is a colon (written in roles
only). Escaped content holds none of the control strings, so the parser splits
on them without looking at context, and undoes the escapes in the opposite
order to that in which they were made.

No text may hold a control string, or it is not a turn of the grammar.

A conversation is rendered as it stands and parsed again. Where the recovered
turns differ from the source, its conflicting turns are escaped (those that do
not survive a round trip on their own), then all of them; what is still not
identical after that raises an error.

The loss mask of a conversation is the list of spans (start, length), in code
points of the rendered text, that hold assistant texts.

Defined results: null roles and texts count as empty; turns are ordered by
turn (null first), then role, then text, so ties give one result; repeated rows
are repeated turns; a null conv_id is a conversation of its own; an empty table
gives an empty result; other columns are ignored. A conversation is one string
by nature, so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlake.llm.tables import named

# Control strings and what stands for them.
HEAD, COLON, TAIL = "### ", ": ", " </turn>\n"
CONTROLS = ("###", "</turn>")
_TEXT_ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
_ROLE_ESCAPES = (*_TEXT_ESCAPES, (":", "\\c"))
ASSISTANT = "assistant"

#: Four bytes for every code point.
_WIDE = "UTF-32"


def _swap(value: Column, found: str, put: str) -> Column:
    return F.replace(value, F.lit(found), F.lit(put))


def escape(value: Column, escapes: tuple[tuple[str, str], ...] = _TEXT_ESCAPES) -> Column:
    for plain, coded in escapes:
        value = _swap(value, plain, coded)
    return value


def unescape(value: Column, escapes: tuple[tuple[str, str], ...] = _TEXT_ESCAPES) -> Column:
    for plain, coded in reversed(escapes):
        value = _swap(value, coded, plain)
    return value


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(COLON), text, F.lit(TAIL))


def _escaped(role: Column, text: Column) -> Column:
    return _rendered(escape(role, _ROLE_ESCAPES), escape(text))


def _pieces(formatted: Column) -> Column:
    """The string cut behind every tail; what follows the last tail is not a turn."""
    pieces = F.split(formatted, TAIL)
    return F.slice(pieces, 1, F.size(pieces) - 1)


def _turn(piece: Column) -> Column:
    """(role, text, before, length): the recovered turn, and where its text stands in the piece."""
    colon = F.locate(COLON, piece)
    before = colon + F.lit(len(COLON) - 1)
    shown = piece.substr(before + 1, F.length(piece))
    role = piece.substr(F.lit(len(HEAD) + 1), colon - F.lit(len(HEAD) + 1))
    sound = piece.startswith(HEAD) & (colon > len(HEAD))
    for control in CONTROLS:
        sound = sound & ~role.contains(control) & ~shown.contains(control)
    return F.struct(
        F.when(sound, unescape(role, _ROLE_ESCAPES)).alias("role"),
        F.when(sound, unescape(shown)).alias("text"),
        before.alias("before"),
        F.length(shown).alias("length"),
        F.length(piece).alias("size"),
    )


def _with_parse(rows: DataFrame, formatted: str, parsed: str) -> DataFrame:
    """Adds the turns of a rendered column, as the grammar reads them."""
    rows = rows.withColumn("_pieces", _pieces(F.col(formatted)))
    return rows.withColumn(parsed, F.transform("_pieces", _turn)).drop("_pieces")


def _said(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(
    messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (as read back), mask (start, length)."""

    def filled(name: str) -> Column:
        return F.coalesce(named(name).cast("string"), F.lit(""))

    rows = messages.select(
        named(conv_id).alias("conv_id"), named(turn).alias("turn"), filled(role).alias("role"), filled(text).alias("text")
    )
    # A turn that does not survive on its own is the conflicting content of its conversation.
    rows = _with_parse(rows.withColumn("plain", _rendered(F.col("role"), F.col("text"))), "plain", "read")
    alone = F.array(F.struct(F.col("role"), F.col("text")))
    survives = F.coalesce(_said(F.col("read")) == alone, F.lit(False))
    rows = rows.withColumn("shown", F.when(survives, F.col("plain")).otherwise(_escaped(F.col("role"), F.col("text"))))
    # Where each turn begins, by running sums over the conversation; in either rendering.
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "shown").rowsBetween(Window.unboundedPreceding, -1)
    sizes = {"at": F.length("shown"), "full_at": F.length(_escaped(F.col("role"), F.col("text")))}
    rows = rows.withColumns({name: F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int") for name, size in sizes.items()})
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "shown", "at", "full_at"))).alias("source"))

    talks = talks.withColumn("formatted", F.array_join(F.transform("source", lambda t: t["shown"]), ""))
    talks = _with_parse(talks, "formatted", "turns")
    same = F.coalesce(_said(F.col("turns")) == _said(F.col("source")), F.lit(False))
    fully = F.array_join(F.transform("source", lambda t: _escaped(t["role"], t["text"])), "")
    talks = talks.withColumn("plainly", same)
    talks = talks.withColumn("formatted", F.when(F.col("plainly"), F.col("formatted")).otherwise(fully))
    talks = _with_parse(talks, "formatted", "turns")
    same = F.coalesce(_said(F.col("turns")) == _said(F.col("source")), F.lit(False))
    talks = talks.withColumn("turns", F.when(same, F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not survive formatting"))))

    starts = F.when(F.col("plainly"), F.transform("source", lambda t: t["at"])).otherwise(F.transform("source", lambda t: t["full_at"]))
    spans = F.zip_with(
        "turns", starts, lambda t, at: F.struct((at + t["before"]).alias("start"), t["length"].alias("length"), t["role"].alias("role"))
    )
    spoken = F.filter(spans, lambda s: s["role"] == ASSISTANT)
    mask = F.transform(spoken, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return talks.select("conv_id", "formatted", _said(F.col("turns")).alias("turns"), mask.alias("mask"))


def under_mask(formatted: DataFrame) -> DataFrame:
    """Adds ``masked``: the pieces of the rendered text that the spans of the mask hold, escapes undone.

    A place in code points is found at once in text of four bytes each. The
    generator keeps that form from being made anew for every span.
    """
    wide = formatted.select("*", F.explode(F.array(F.encode("formatted", _WIDE))).alias("_wide"))
    cut = lambda s: F.substring(F.col("_wide"), s["start"] * 4 + 1, s["length"] * 4)
    return wide.withColumn("masked", F.transform("mask", lambda s: unescape(F.decode(cut(s), _WIDE)))).drop("_wide")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what is read back from the rendered text and its loss mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = under_mask(formatted).withColumns({"_said": said, "_loss": F.array_join("masked", "")})
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("_said", 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
