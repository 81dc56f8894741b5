"""Chat formatting: reply trees to conversations with a loss mask.

Messages (conv_id, id, parent, role, text, score) form trees. Pointer doubling, a self-join a round, gives every
message its depth and the score of its path from the root in as many rounds as the depth has binary digits; leaves
are ranked by that; the chosen leaves' paths are enumerated by the rounds' own jump tables; each path becomes one
conversation. Everything here is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, materialize, partitions, table

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of the common chat templates begin with one of these; their first character is escaped.
_CONTROL = [(r"<(?=\||/?s>|<SYS>>|</SYS>>)", "<", "&lt;"), (r"\[(?=/?INST\])", "[", "&#91;")]
LOSS_ROLE = "assistant"


# ---- template


def escaped(text: Column) -> Column:
    """Text in which no control string stands; ``unescaped`` gives it back."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    for pattern, _, mark in _CONTROL:
        out = F.regexp_replace(out, pattern, mark)
    return out


def unescaped(text: Column) -> Column:
    out = text
    for _, sign, mark in _CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(sign))
    return F.replace(F.replace(out, F.lit("&#10;"), F.lit("\n")), F.lit("&amp;"), F.lit("&"))


def _head(role: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))


# ---- trees


def _rooted(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv_id, id, depth, total, root) of each message that hangs on a root, and the jump tables by round.

    Round k's table has, for each message with one, its ancestor 2**k steps up. A round reads what has reached its root
    and moves, and writes, only what hasn't. No path is longer than the largest conversation has messages, which
    bounds the rounds; what is open after them lies in or under a cycle and is left out.
    """
    largest = nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    known = nodes.select(F.col("conv_id").alias("c"), F.col("id").alias("p"), F.lit(True).alias("there"))
    first = nodes.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("p")), "left")
    first = first.withColumn("up", F.when(F.col("there"), F.col("parent")))
    now = materialize(first.select("conv_id", "id", "up", F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"), F.col("id").alias("top")), "climb")
    done, jumps = [now.where("up is null")], []
    open_ = now.where("up is not null")
    while 1 << len(jumps) < largest and not open_.isEmpty():
        jumps.append(open_.select("conv_id", "id", "up"))
        above = open_
        for one in done:
            above = above.union(one)
        above = above.select(F.col("conv_id").alias("c"), F.col("id").alias("p"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("t2"), F.col("top").alias("top2"))
        moved = open_.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("p")))
        moved = moved.select("conv_id", "id", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("t2")).alias("total"), F.col("top2").alias("top"))
        moved = materialize(moved, "climb")
        done.append(moved.where("up is null"))
        open_ = moved.where("up is not null")
    rooted = done[0]
    for one in done[1:]:
        rooted = rooted.union(one)
    return rooted.select("conv_id", "id", "depth", "total", F.col("top").alias("root")), jumps


def _same(left: DataFrame, right: DataFrame, *more: Column) -> Column:
    """Rows of one conversation (null is one too) and message."""
    out = left["conv_id"].eqNullSafe(right["c"]) & (left["id"] == right["p"])
    for x in more:
        out = out & x
    return out


def reply_paths(messages: DataFrame, top_k: int = 1) -> DataFrame:
    """(conv_id, leaf, branch, path_score, back, id): the messages of the ``top_k`` best paths of each conv_id.

    ``messages`` are read several times and should be a written table without repeated ids. A path's score is the
    mean of its messages' scores (null counts as 0); ties go to the lesser leaf. ``back`` counts steps from the leaf.
    The rank is cut before the shuffle, so a tree of very many leaves is no hot task.
    """
    nodes = messages.select("conv_id", "id", "parent", "score")
    rooted, jumps = _rooted(nodes)
    inner = nodes.select(F.col("conv_id").alias("c"), F.col("parent").alias("p")).distinct()
    leaves = rooted.join(inner, _same(rooted, inner), "left_anti").withColumn("path_score", F.col("total") / F.col("depth"))
    rank = Window.partitionBy("conv_id").orderBy(F.desc("path_score"), "id")
    chosen = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= top_k)
    paths = materialize(chosen.select("conv_id", F.col("id").alias("leaf"), "branch", "path_score", F.lit(0).cast("long").alias("back"), "id"), "paths")
    for k, jump in enumerate(jumps):
        jump = jump.select(F.col("conv_id").alias("c"), F.col("id").alias("p"), "up")
        further = paths.join(jump, _same(paths, jump)).select("conv_id", "leaf", "branch", "path_score", (F.col("back") + (1 << k)).alias("back"), F.col("up").alias("id"))
        paths = materialize(paths.union(further), "paths") if k % 3 == 2 else paths.union(further)
    return paths


def format_conversations(messages: DataFrame, top_k: int = 1, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, leaf, branch, path_score, n_turns, formatted, loss): one row per chosen path.

    ``loss``: array of (start, end) code-point spans of ``formatted`` that hold exactly the texts of ``loss_role``,
    in order. A null text or role is empty; a message whose parent is null or missing is a root; of rows that repeat
    a (conv_id, id) the least by parent, role, text and score counts; a null conv_id is a conversation like any other;
    rows without an id, and messages in or under a cycle, are left out; an empty table gives an empty result; further
    columns are ignored. A conversation is one row, and its turns meet in one task.
    """
    least = F.min(F.struct("parent", "role", "text", "score")).alias("m")
    named = messages.where("id is not null").groupBy("conv_id", "id").agg(least)
    messages = materialize(named.select("conv_id", "id", "m.*"), "messages")
    paths = reply_paths(messages, top_k)
    # texts and places on paths meet by conversation, so that the texts are dealt once
    place = F.struct("leaf", "branch", "path_score", "back")
    texts = messages.select("conv_id", "id", F.struct("role", "text").alias("m"), F.lit(None).cast(paths.select(place.alias("p")).schema["p"].dataType).alias("p"))
    both = texts.unionByName(paths.select("conv_id", "id", F.lit(None).cast(texts.schema["m"].dataType).alias("m"), place.alias("p")))
    met = both.repartition(partitions(messages.sparkSession), "conv_id").groupBy("conv_id", "id").agg(F.first("m", ignorenulls=True).alias("m"), F.collect_list("p").alias("p"))
    turns = met.select("conv_id", F.inline("p"), "m.role", "m.text")
    turns = turns.select("conv_id", "leaf", "branch", "path_score", "back", _head(F.col("role")).alias("head"), escaped(F.col("text")).alias("body"), F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("own"))
    before = Window.partitionBy("conv_id", "leaf").orderBy(F.desc("back")).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END) + 1
    turns = turns.withColumn("at", (F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")).cast("int"))
    span = F.when(F.col("own"), F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    whole = F.concat("head", "body", F.lit(END + "\n"))
    grouped = turns.groupBy("conv_id", "leaf").agg(
        F.first("branch").alias("branch"),
        F.first("path_score").alias("path_score"),
        F.count(F.lit(1)).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("k"), whole.alias("s")))).alias("parts"),
        F.sort_array(F.collect_list(span)).alias("loss"),
    )
    return grouped.select("conv_id", "leaf", "branch", "path_score", "n_turns", F.array_join(F.col("parts.s"), "").alias("formatted"), "loss")


def _turn_parts(formatted: Column) -> Column:
    """What follows each start mark."""
    return let(F.split(formatted, START.replace("|", r"\|")), lambda parts: F.slice(parts, F.lit(2), F.size(parts)))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - (len(END) + 2))
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(_turn_parts(formatted), turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, one per span and in order.

    The conversation is cut into its turns once and each span is cut from its own turn, so that reading back doesn't
    cost the length of the whole for every span. A span that isn't a turn's text is an error.
    """

    def cut(parts: Column) -> Column:
        empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at"))
        starts = F.aggregate(parts, empty, lambda a, part: F.struct((a["end"] + F.length(part) + len(START)).alias("end"), F.array_append(a["at"], a["end"] + len(START)).alias("at")))["at"]

        def spans(at: Column) -> Column:
            ends = F.map_from_arrays(F.transform(loss, lambda s: s["start"]), F.transform(loss, lambda s: s["end"]))

            def of(ends: Column) -> Column:
                def text(part: Column, i: Column) -> Column:
                    head = F.length(F.substring_index(part, "\n", 1)) + 1
                    begin = F.get(at, i) + head
                    return F.when(F.element_at(ends, begin).isNotNull(), F.substring(part, head + 1, F.element_at(ends, begin) - begin))

                found = F.filter(F.transform(parts, text), lambda x: x.isNotNull())
                return let(found, lambda x: F.when(F.size(x) == F.size(loss), F.transform(x, unescaped)).otherwise(F.raise_error(F.lit("a loss span isn't a turn's text")).cast("array<string>")))

            return let(ends, of)

        return let(starts, spans)

    return let(_turn_parts(formatted), cut)


def chains(turns: DataFrame) -> DataFrame:
    """Conversations of rows (conv_id, turn, role, text) as trees without branches, in the order of their turns.

    Ties and null turns are ordered by role and text, nulls first.
    """
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    out = turns.select("conv_id", "role", "text", F.row_number().over(by).cast("long").alias("id"))
    return out.select("conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(PROBE).alias("text"))
    out = format_conversations(chains(turns.union(probe)))
    said = F.array_join(read_loss(F.col("formatted"), F.col("loss")), "")
    heard = let(read_turns(F.col("formatted")), lambda t: F.struct(F.size(t).cast("long").alias("n"), F.sha2(F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("h")))
    out = out.withColumns({"heard": heard, "said": said})
    return out.select("conv_id", F.col("heard.n").alias("n_turns"), F.col("heard.h").alias("turns_sha256"), F.length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
