"""Chat formatting into budgeted windows.

A conversation is rendered turn by turn and cut into windows of at most ``budget`` tokens at
turn boundaries. Prefix sums of turn tokens decide: with ``half`` being half of what history
and system turn leave of the budget, turns whose start falls into the same multiple of
``half`` share a window; each of them is at most ``half`` long, so together they fit. A longer
turn gets a window of its own, the only case in which a window can exceed the budget.

A window opens with the latest system turn before it and with the last turns before it that
fit in ``history`` tokens. Both are only repeated context: the loss mask of a window covers
the texts of its own assistant turns, so every assistant text is a target exactly once.

Template: ``<turn role="ROLE">TEXT</turn>`` and a line feed per turn. In roles and texts ``&``,
``<`` and ``"`` become ``&amp;``, ``&lt;`` and ``&quot;``, so no text can contain a control
string, and reading back is exact.

Only window functions are used; a conversation is never gathered as one value, only windows
are. Defined cases: null role or text is an empty string; turns are ordered by turn, role and
text, nulls first, and repeated rows are turns of their own; rows without a conversation id
form one conversation; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
#: Tokens that the template adds to a turn.
TURN_TOKENS = 6
TOKEN = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]"
TURN = r'<turn role="([^"<]*)">([^<]*)</turn>\n'


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit('"'), F.lit("&quot;"))


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("&quot;"), F.lit('"'))
    text = F.replace(text, F.lit("&lt;"), F.lit("<"))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def opening(role: Column) -> Column:
    return F.concat(F.lit('<turn role="'), escape(role), F.lit('">'))


CLOSING = "</turn>\n"


def turn_tokens(text: Column) -> Column:
    """Letters runs, digits and other signs, plus the template's share."""
    return (F.regexp_count(text, F.lit(TOKEN)) + TURN_TOKENS).cast("bigint")


def format_chats(df: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window from rows of ``conv_id, turn, role, text``.

    Columns: conv_id, window (from 0), text, own_start (code points before the window's own
    turns), loss (array of start and length in code points, in order), n_turns (own),
    n_repeated, n_tokens.
    """
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("body"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    system = F.col("role") == "system"
    rows = rows.select(
        "conv_id", "role", turn_tokens(F.col("body")).alias("tokens"),
        opening(F.col("role")).alias("open"), escape(F.col("body")).alias("inner"),
        F.row_number().over(in_order).alias("idx"))
    by_place = Window.partitionBy("conv_id").orderBy("idx")
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumns({
        "start": F.sum("tokens").over(by_place) - F.col("tokens"),
        "half": F.greatest(F.lit(1).cast("bigint"), F.floor(
            (F.lit(budget - history) - F.coalesce(
                F.max(F.when(system, F.col("tokens"))).over(whole), F.lit(0))) / 2)),
    })
    slot = F.floor(F.col("start") / F.col("half"))
    long = F.col("tokens") > F.col("half")
    rows = rows.withColumns({"slot": slot, "long": long})
    first = F.coalesce(
        F.col("long") | F.lag("long").over(by_place)
        | (F.lag("slot").over(by_place) != F.col("slot")), F.lit(True))
    rows = rows.withColumn("first", first)
    rows = rows.withColumn("window", F.sum(F.col("first").cast("int")).over(by_place) - 1)

    rendered = F.concat("open", "inner", F.lit(CLOSING))
    turn = F.struct("idx", "tokens", rendered.alias("text"))
    before = Window.partitionBy("conv_id").orderBy("start").rangeBetween(-history, -1)
    earlier = by_place.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "past": F.collect_list(F.when(~system, turn)).over(before),
        "system_turn": F.last(F.when(system, turn), ignorenulls=True).over(earlier)})
    context = F.concat(
        F.when(F.col("system_turn").isNull(), F.array().cast("array<struct<idx:int,tokens:bigint,text:string>>"))
        .otherwise(F.array("system_turn")), F.sort_array("past"))
    rows = rows.withColumn("context", F.when(F.col("first"), context))

    own = F.sort_array(F.collect_list(F.struct("idx", "role", "open", "inner", "tokens")))
    windows = rows.groupBy("conv_id", "window").agg(
        own.alias("own"), F.first("context", ignorenulls=True).alias("context"))
    windows = windows.select(
        "conv_id", "window", "own", "context",
        F.array_join(F.transform("context", lambda t: t["text"]), "").alias("head"))
    windows = windows.withColumn("own_start", F.length("head"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["open"])
        end = begin + F.length(t["inner"])
        span = F.struct(begin.alias("start"), F.length(t["inner"]).alias("length"))
        spans = F.when(t["role"] == "assistant", F.concat(state["spans"], F.array(span))) \
            .otherwise(state["spans"])
        return F.struct((end + len(CLOSING)).alias("at"), spans.alias("spans"))

    begin = F.struct(F.col("own_start").alias("at"),
                     F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return windows.select(
        "conv_id", F.col("window").cast("int").alias("window"),
        F.concat("head", F.array_join(F.transform("own", lambda t: F.concat(
            t["open"], t["inner"], F.lit(CLOSING))), "")).alias("text"),
        "own_start", F.aggregate("own", begin, step)["spans"].alias("loss"),
        F.size("own").alias("n_turns"), F.size("context").alias("n_repeated"),
        (F.aggregate("own", F.lit(0).cast("bigint"), lambda a, t: a + t["tokens"])
         + F.aggregate("context", F.lit(0).cast("bigint"), lambda a, t: a + t["tokens"]))
        .alias("n_tokens"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per window: its own turns (array of role and text) and its target texts, unescaped."""
    own = F.substring(F.col("text"), F.col("own_start") + 1, F.length("text"))
    roles = F.regexp_extract_all(own, F.lit(TURN), F.lit(1))
    texts = F.regexp_extract_all(own, F.lit(TURN), F.lit(2))
    turns = F.zip_with(roles, texts, lambda r, t: F.struct(
        unescape(r).alias("role"), unescape(t).alias("text")))
    targets = F.transform("loss", lambda s: unescape(
        F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", "text", turns.alias("turns"),
                          targets.alias("targets"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation hold, read back from their text."""
    back = read_back(windows).select(
        "conv_id", "window", F.size("turns").alias("n"), F.length("text").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(
            t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("targets", "").alias("loss"))
    parts = F.sort_array(F.collect_list(F.struct("window", "turns", "loss")))
    whole = back.groupBy("conv_id").agg(
        parts.alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    joined = whole.select(
        "conv_id", "n_turns", "formatted_chars", F.array_join("parts.turns", "").alias("turns"),
        F.array_join("parts.loss", "").alias("loss"))
    return joined.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars")
