"""Reply trees to chat texts: the best root-to-leaf paths of each conversation, each formatted as one conversation.

Messages point to the message they answer. Iterative self-joins double the stretch that each message has looked up along
its ancestors, so that a path of n messages takes log2(n) rounds; leaves are ranked by the score of their path and only
the chosen paths are enumerated. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """No `<|` is left: a backslash goes between `<` and `|`, one more where there are some already, so that it can be undone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role ends at its line's end: line ends inside it are written %0A, and % as %25."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def from_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, id, parent, role, text, score): each row of a linear conversation answers the row before it.

    Rows go by turn, equal turns by role and text, nulls first; repeated rows are turns of their own. A null
    conversation is one as any other.
    """
    src = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    src = src.withColumn("id", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long"))
    return src.select("conv", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _keyed(messages: DataFrame) -> DataFrame:
    """key names a message, up the one that it answers; rows that share an id are told apart, and the first of them gets the replies."""
    rep = F.row_number().over(Window.partitionBy("conv", "id").orderBy("role", "text", "score", "parent"))
    m = messages.select("conv", "id", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score")).withColumn("rep", rep)
    up = F.when(F.col("parent").isNotNull(), F.struct("conv", F.col("parent").alias("id"), F.lit(1).alias("rep")))
    return m.select(F.struct("conv", "id", "rep").alias("key"), up.alias("up"), "role", "text", "score")


def _climb(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(key, total, depth) of the path from each message to its root; and for each k the (key, up) that is 2**k messages above.

    Once under half of the rows still have something above them, the rows of finished conversations are set aside.
    """
    state = cut(links.select("key", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")))
    n, jumps, aside, first = state.count(), [], [], True
    most = n
    while True:
        open_ = state.where("up is not null")
        left, deepest = open_.agg(F.count("*"), F.max("depth")).first()
        if not left:
            whole = state
            for part in aside:
                whole = whole.union(part)
            return whole.select("key", "total", "depth"), jumps
        if deepest > most:
            raise ValueError("reply trees: some messages answer each other in a circle")
        jumps.append(open_.select("key", "up"))
        if left < n / 2 and not first:
            conv = open_.select(F.struct("key.conv").alias("_c")).distinct()
            aside.append(cut(state.withColumn("_c", F.struct("key.conv")).join(conv, "_c", "left_anti").drop("_c")))
            state = cut(state.withColumn("_c", F.struct("key.conv")).join(conv, "_c", "left_semi").drop("_c"))
            n = state.count()
        above = state.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("further"))
        state = cut(
            state.join(above, "up", "left").select(
                "key", F.col("next").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth")
            )
        )
        first = False


def _enumerated(chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(leaf, rank, score, depth, key, above): the messages of each leaf's path, `above` of them over the leaf.

    After the k-th step every message less than 2**k above its leaf is there; a step adds those 2**k above what is there.
    """
    found = chosen.select(F.col("key").alias("leaf"), "rank", "score", "depth", "key", F.lit(0).cast("long").alias("above"))
    for k, jump in enumerate(jumps):
        more = found.join(jump, "key").select("leaf", "rank", "score", "depth", F.col("up").alias("key"), (F.col("above") + 2**k).alias("above"))
        found = found.union(cut(more))
    return found


def best_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(conv, leaf, rank, score, place, role, text): the messages of the chosen paths, place 0 being the root's.

    messages: conv, id, parent, role, text, score. A path's score is the mean of its messages' (null: 0). The `best`
    paths of each conversation are kept, by falling score, equal ones by the leaf's id. A message whose parent is null or
    not there is a root; conversations may have several. Circles raise ValueError. Null roles and texts are empty.
    """
    m = _keyed(messages)
    known = m.select(F.col("key").alias("up"), F.lit(True).alias("there"))
    links = m.select("key", "up", "score").join(known, "up", "left").select("key", F.when(F.col("there"), F.col("up")).alias("up"), "score")
    paths, jumps = _climb(links)
    leaves = paths.join(m.where("up is not null").select(F.col("up").alias("key")).distinct(), "key", "left_anti")
    leaves = leaves.select("key", F.col("key.conv").alias("conv"), (F.col("total") / F.col("depth")).alias("score"), "depth")
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), "key.id", "key.rep"))
    chosen = cut(leaves.withColumn("rank", rank).where(F.col("rank") <= best))
    at = _enumerated(chosen, jumps)
    text = m.select("key", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return at.join(text, "key").select(F.col("leaf.conv").alias("conv"), "leaf", "rank", "score", (F.col("depth") - F.col("above") - 1).alias("place"), "role", "text")


def format_paths(paths: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """(conv, leaf, rank, score, n_turns, formatted, loss): each path as one text; loss has the spans to learn from.

    A turn is `<|im_start|>role`, a line end, the text, `<|im_end|>` and a line end, with control strings inside roles and
    texts escaped. loss: start and end (exclusive), in code points, of the texts whose role is learn_from. A path is one
    text and so one row: its turns meet in one task, sorted there on disk if they are many.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    t = paths.select("conv", "leaf", "rank", "score", "place", (F.col("role") == learn_from).alias("learn"), head.alias("head"), escape(F.col("text")).alias("body"))
    t = t.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    run = Window.partitionBy("conv", "leaf").orderBy("place")
    t = t.withColumn("start", F.sum(F.length("piece").cast("long")).over(run) - F.length("body") - len(END) - 1)
    span = F.when(F.col("learn"), F.struct("start", (F.col("start") + F.length("body")).alias("end")))
    g = t.groupBy("conv", "leaf").agg(F.first("rank").alias("rank"), F.first("score").alias("score"), F.sort_array(F.collect_list(F.struct("place", "piece", span.alias("span")))).alias("turns"))
    return g.select(
        "conv", "leaf", "rank", "score", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - F.lit(len(END) + 2))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != ""), turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted texts."""
    d = formatted.select("conv", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
