"""Chat formatting (operator 12), in DataFrame functions only: root-to-leaf paths of reply trees as conversations.

A message replies to its parent. Self-joins double the stretch of ancestors that each message knows (1, 2, 4, ...), so a
thread of d messages takes log2(d) rounds; only messages that haven't met their root go on. A leaf then knows its depth and
its path's score, leaves are ranked in their tree, and the same stretches, from the longest down, name all messages of the
chosen paths. Only ids and scores take part in this; the texts are joined to the chosen paths once, at the end.

The template shows a turn as `### role: text</turn>` and a line feed. In texts and roles a backslash, the header's mark and
the end mark are broken by a backslash, so no text can end a turn or begin one, and the reading is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm._common import materialise

HEADER, CLOSING = "### ", "</turn>"
LEARNED = "assistant"
#: What a backslash is put into, and how it reads then; the backslash itself comes first.
ESCAPES = (("\\", "\\\\"), (CLOSING, "<\\/turn>"), (HEADER, "##\\# "))


def escaped(text: Column) -> Column:
    for plain, shown in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(shown))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def turn_links(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, score): each turn replies to the one before it. Rows that share a turn are one message in
    several parts, a null turn comes first, a null conv_id is a conversation of its own."""
    turns = conversations.select("conv_id", "turn").distinct()
    # a missing parent marks the first turn; a null turn may be a parent itself, so ids are structs
    before = F.lag(F.struct("turn")).over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()))
    return turns.select("conv_id", F.struct("turn").alias("turn"), before.alias("parent"), F.lit(1.0).alias("score"))


def _grown(spark: SparkSession, links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Ancestors at distances 1, 2, 4, ... of the messages that have them (id, ptr), and (id, depth, score) of the messages
    that reach a root. A message on a cycle, or below one, reaches none."""
    ids = links.select(F.col("id").alias("_p"))
    joined = links.join(ids, F.col("ptr") == F.col("_p"), "left")
    state = materialise(joined.select("id", F.col("_p").alias("ptr"), "score", F.when(F.col("_p").isNull(), 0).otherwise(1).cast("long").alias("depth")), "links")
    ends, jumps, rounds = [state.filter("ptr is null")], [], 0
    most = max(1, state.count()).bit_length() + 1
    open_ = state.filter("ptr is not null")
    while not open_.isEmpty() and rounds < most:
        jumps.append(open_.select("id", "ptr"))
        known = open_
        for more in ends:
            known = known.unionByName(more)
        up = known.select(F.col("id").alias("_i"), F.col("ptr").alias("_ptr"), F.col("score").alias("_score"), F.col("depth").alias("_depth"))
        step = open_.join(up, F.col("ptr") == F.col("_i")).select("id", F.col("_ptr").alias("ptr"), (F.col("score") + F.col("_score")).alias("score"), (F.col("depth") + F.col("_depth")).alias("depth"))
        state = materialise(step, "links")
        ends.append(state.filter("ptr is null"))
        open_ = state.filter("ptr is not null")
        rounds += 1
    done = ends[0]
    for more in ends[1:]:
        done = done.unionByName(more)
    return jumps, done.select("id", "depth", "score")


def reply_paths(links: DataFrame, tree: str, node: str, parent: str, score: str, top: int = 1) -> DataFrame:
    """(id, tree, rank, position): the messages of each tree's `top` best root-to-leaf paths.

    A path's score is the sum of its messages' scores (null: 0); the higher score comes first, ties go to the smaller leaf.
    id is the struct of tree and node. Rows that share both are one message, under the smallest of their parents, with the
    sum of their scores. A message whose parent is null or absent is a root, so a tree may have several. Messages on a cycle
    and below one have no root and are in no path. A null tree is a tree of its own, a null node a message like others. An
    empty table gives an empty one; further columns are ignored.
    """
    known = links.select(F.struct(F.col(tree).alias("tree"), F.col(node).alias("node")).alias("id"), F.struct(F.col(tree).alias("tree"), F.col(parent).alias("node")).alias("ptr"), F.col(parent).isNotNull().alias("_has"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))
    known = known.groupBy("id").agg(F.min(F.when(F.col("_has"), F.col("ptr"))).alias("ptr"), F.sum("score").alias("score"))
    spark = links.sparkSession
    jumps, done = _grown(spark, known)
    parents = jumps[0].select(F.col("ptr").alias("_p")).distinct() if jumps else None
    leaves = done.join(parents, F.col("id") == F.col("_p"), "left_anti") if parents is not None else done
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("id.tree").orderBy(F.desc("score"), "id.node"))).filter(F.col("rank") <= top)
    marked = materialise(ranked.select("id", F.col("rank").cast("long").alias("rank")), "paths")
    for jump in reversed(jumps):  # each round writes only the messages that it names first
        marked = marked.unionByName(materialise(marked.join(jump, "id").select(F.col("ptr").alias("id"), "rank"), "paths"))
    return marked.join(done.select("id", "depth"), "id").select("id", F.col("id.tree").alias("tree"), "rank", F.col("depth").alias("position"))


def _shown(role: Column, text: Column) -> Column:
    """The segments of a turn: a learned role's text stands alone, so that the loss covers it and nothing else."""
    head = F.concat(F.lit(HEADER), F.replace(escaped(role), F.lit(":"), F.lit("\\:")), F.lit(": "))
    end = F.lit(CLOSING + "\n")
    segment = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    return F.when(role == LEARNED, F.array(segment(head, False), segment(escaped(text), True), segment(end, False))).otherwise(F.array(segment(F.concat(head, escaped(text), end), False)))


def format_paths(messages: DataFrame, paths: DataFrame, tree: str, node: str, role: str = "role", text: str = "text") -> DataFrame:
    """(tree, rank, formatted, segments): a conversation for each chosen path. The segments (text, loss) joined are the
    formatted text; those with loss are what a model learns.

    Null roles and texts are empty. Rows of one message stand in order of role, then text; repeated rows all stay. A path is
    one row of the result and is held by one task, however the tree's other messages are spread.
    """
    id_ = F.struct(F.col(tree).alias("tree"), F.col(node).alias("node"))
    said = messages.select(id_.alias("id"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = said.join(paths, "id")
    turns = placed.groupBy("tree", "rank").agg(F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("turns"))
    shown = turns.select("tree", "rank", F.flatten(F.transform("turns", lambda t: _shown(t["role"], t["text"]))).alias("segments"))
    return shown.select("tree", "rank", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    pieces = F.filter(F.split(formatted, CLOSING + "\n"), lambda p: p != "")
    head = "^" + HEADER + r"((?:[^\\:]|\\.)*+): "
    return F.transform(pieces, lambda p: F.struct(unescaped(F.regexp_extract(p, "(?s)" + head, 1)).alias("role"), unescaped(F.regexp_replace(p, "(?s)" + head, "")).alias("text")))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """The rows of a conversation table, with struct ids as in turn_links."""
    return conversations.select("conv_id", F.struct("turn").alias("turn"), "role", "text")


def op12_reply_trees(conversations: DataFrame) -> DataFrame:
    """Every conversation, and one that says the template's own marks, formatted and read back from the output.

    A conversation's turns are a tree of one path, so all its rows are formatted; ties are settled as in turn_links and
    format_paths.
    """
    spark = conversations.sparkSession
    said = "\\### Assistant: </turn> ok"
    schema = conversations.select("conv_id", "turn", "role", "text").schema
    probe = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit(said).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe.select(*(F.col(f.name).cast(f.dataType) for f in schema)))
    paths = reply_paths(turn_links(rows), "conv_id", "turn", "parent", "score")
    made = format_paths(conversation_messages(rows), paths, "conv_id", "turn")
    read = made.select(F.col("tree").alias("conv_id"), "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shown AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# ') AS t,
         replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# '), ':', '\:') AS r
  FROM said)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ' || r || ': ' || t || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""
