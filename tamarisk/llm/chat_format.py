"""Chat formatting with Spark expressions only.

A formatted conversation is a sequence of ``### role: text</turn>`` blocks, one per run of
adjacent same-role turns; the texts of a run are divided by ``</part>``. Inside texts and roles
the characters that control strings need are written as escapes (``\\b`` for the backslash,
``\\l`` for <, ``\\h`` for #, ``\\c`` for a colon in a role), so that no text can hold a control
string and the original turns can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, PART, HEAD, COLON = "</turn>\n", "</part>", "### ", ": "
#: Code points of a block in which a formatted text is read, and runs of a group.
BLOCK, GROUP = 4096, 128
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    for old, new in _ESCAPES:
        c = _replace(c, old, new)
    return c


def unescape(c: Column) -> Column:
    for old, new in reversed(_ESCAPES):
        c = _replace(c, new, old)
    return c


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (runs of code points, in order).

    Turns are ordered by turn (null last), then role and text, so ties and repeated rows have a
    fixed place. Null text is empty; a null role is the empty role; rows with a null conv_id form
    one conversation. Extra columns are ignored. ``loss_mask`` covers ``formatted`` completely:
    each run says whether it counts towards the loss and how many code points it has.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").isNull().alias("last"),
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    packed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # starts of the runs of one role, then each run as a slice: linear in the number of turns
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.col("t")[i - 1]["role"] != F.col("t")[i]["role"]))
    packed = packed.withColumn("s", starts)
    runs = F.transform(
        "s",
        lambda s, k: F.struct(
            F.col("t")[s]["role"].alias("role"),
            F.transform(
                F.slice("t", s + 1, F.coalesce(F.get("s", k + 1), F.size("t")) - s), lambda x: escape(x["text"])
            ).alias("parts"),
        ),
    )
    packed = packed.select("conv_id", runs.alias("runs"))
    head = lambda r: F.concat(F.lit(HEAD), _replace(escape(r["role"]), ":", "\\c"), F.lit(COLON))
    block = lambda r: F.concat(head(r), F.array_join(r["parts"], PART), F.lit(END))
    piece = lambda loss, chars: F.struct(loss.alias("loss"), chars.cast("long").alias("chars"))
    mask = lambda r: F.concat(
        F.array(piece(F.lit(False), F.length(head(r)))),
        F.flatten(F.transform(r["parts"], lambda p: F.array(
            piece(r["role"] == loss_role, F.length(p)), piece(F.lit(False), F.lit(len(PART)))))),
        F.array(piece(F.lit(False), F.lit(len(END) - len(PART)))),
    )
    return packed.select(
        "conv_id",
        F.array_join(F.transform("runs", block), "").alias("formatted"),
        F.flatten(F.transform("runs", mask)).alias("loss_mask"),
    )


def read_back(formatted: Column) -> Column:
    """The turns in a formatted conversation: an array of (role, text)."""
    blocks = F.filter(F.split(formatted, END), lambda b: b != "")
    role = lambda b: F.substring_index(b, COLON, 1)
    parts = lambda b: F.split(F.substr(b, F.length(role(b)) + len(COLON) + 1), PART)
    name = lambda b: unescape(_replace(F.substr(role(b), F.lit(len(HEAD) + 1)), "\\c", ":"))
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(parts(b), lambda p: F.struct(name(b).alias("role"), unescape(p).alias("text"))),
        )
    )


def _cut(blocks: Column, at: Column, chars: Column) -> Column:
    """``chars`` code points from the ``at``-th on, counted from 0, of a text in blocks of BLOCK code points."""
    number = lambda x: F.floor(x / BLOCK).cast("int")
    first, last, end = number(at), number(at + chars - 1), at + chars
    inside = lambda x: (x - number(x) * BLOCK).cast("int")
    whole = F.array_join(F.slice(blocks, first + 2, last - first - 1), "")
    over = F.concat(F.substr(F.get(blocks, first), inside(at) + 1), whole, F.left(F.get(blocks, last), (end - last * BLOCK).cast("int")))
    return F.when(chars == 0, "").when(first == last, F.substr(F.get(blocks, first), inside(at) + 1, chars.cast("int"))).otherwise(over)


def _once(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def loss_text(formatted: Column, loss_mask: Column) -> Column:
    """What stands under the loss mask, unescaped, in order and with nothing between.

    The text is divided into blocks once, so that a run far down costs no more than one at the top,
    and the runs into groups, so that no long list is copied for each run.
    """
    none = F.array().cast("array<string>")
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.size(loss_mask) - 1, F.lit(0)), F.lit(GROUP)), lambda i: F.slice(loss_mask, i + 1, GROUP))
    length = lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda n, m: n + m["chars"])
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    starts = lambda g: F.aggregate(
        g, first, lambda a, x: F.struct((a["at"] + length(x)).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"]
    )

    def texts(blocks: Column, group: Column, start: Column) -> Column:
        step = lambda a, m: F.struct(
            (a["at"] + m["chars"]).alias("at"),
            F.when(m["loss"], F.concat(a["texts"], F.array(_cut(blocks, a["at"], m["chars"])))).otherwise(a["texts"]).alias("texts"),
        )
        return F.aggregate(group, F.struct(start.alias("at"), none.alias("texts")), step, lambda a: a["texts"])

    def read(blocks: Column) -> Column:
        found = _once(groups, lambda g: F.zip_with(g, starts(g), lambda x, s: texts(blocks, x, s)))
        return unescape(F.array_join(F.flatten(found), ""))

    return _once(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), read)


def chat_digest(formatted: DataFrame) -> DataFrame:
    """The contract's digest columns, all of them read from the formatted text and its mask."""
    turns = formatted.select(
        "conv_id",
        read_back(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
