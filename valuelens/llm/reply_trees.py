r"""Chat formatting [native]: reply trees, their root-to-leaf paths, and one conversation per chosen path.

A message names its parent.  Iterative self-joins double the reach of every message's
pointer to an ancestor, so a path of n messages is known after log2(n) joins, each written
before the next.  With these tables every leaf climbs to its root in as many joins,
adding up the scores of its branch; the branches of a tree are ranked by total score, then
length, then leaf id; the chosen ones are taken apart into their messages by halving, and
each is formatted as one conversation.

Format: ``<s>`` and then per message ``[INST] text [/INST]`` without the last space for users,
``[REPLY] text</s>`` for assistants and ``[TURN role] text[/TURN]`` for every other role.  In
texts a control string gets a backslash after its first character, and one more if it has
some: this is undone without loss, and no text holds a control string.  In role names ``%``, ``[``,
``]`` and ``<`` are percent-coded.  The loss mask lists the assistants' texts in the output, as
code points and as UTF-8 bytes.

Scale: the joins move keys only; texts move once, to the place of their tree, where they meet their
paths.  Trees of more than ``LARGE_TREE`` messages are joined by (tree, message) first, so
that a huge tree is spread over tasks and only its chosen branches meet.  A formatted conversation is
one value, so a chosen branch is held by one task.

Cases: null text is empty, a null role is ''; null tree ids are one tree; a parent that is not in the
tree makes its child a root; messages without an id, and those on a cycle, are on no path; of rows
that share tree and id the least (parent, score) and the least (role, text) count; a null score is 0;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valuelens.llm._shared import cut, sized_broadcast

BEGIN = "<s>"
CLOSINGS = ("</s>", "[/INST]", "[/TURN]")
#: the first characters of control strings, backslashes after them, and what follows
_CONTROL = r"([<\[])(\\*)(?=/?s>|/?INST\]|REPLY\]|/?TURN[ \]])"
_ESCAPED = r"([<\[])\\(\\*)(?=/?s>|/?INST\]|REPLY\]|/?TURN[ \]])"
#: a turn of the output; escaped texts hold none of the closings
_TURN = r"(?s)\[(?:INST|REPLY|TURN [^\]]*)\] .*?(?:</s>|\[/INST\]|\[/TURN\])"
_ROLE_CODES = [("%", "%25"), ("[", "%5B"), ("]", "%5D"), ("<", "%3C")]
LARGE_TREE = 100_000
MAX_BROADCAST_TREES = 100_000


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_CONTROL), F.lit(r"$1\\$2"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2"))


def piece(role: Column, text: Column) -> tuple[Column, Column]:
    """(formatted turn, its opening); the escaped text follows the opening."""
    name = role
    for plain, code in _ROLE_CODES:
        name = F.replace(name, F.lit(plain), F.lit(code))
    opening = F.when(role == "user", F.lit("[INST] ")).when(role == "assistant", F.lit("[REPLY] ")).otherwise(F.concat(F.lit("[TURN "), name, F.lit("] ")))
    closing = F.when(role == "user", F.lit("[/INST]")).when(role == "assistant", F.lit("</s>")).otherwise(F.lit("[/TURN]"))
    return F.concat(opening, escape(text), closing), opening


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""

    def turn(t: Column) -> Column:
        opening = F.substring_index(t, "] ", 1)  # without its end
        name = F.substr(opening, F.lit(7))
        for plain, code in reversed(_ROLE_CODES):
            name = F.replace(name, F.lit(code), F.lit(plain))
        role = F.when(opening == "[INST", F.lit("user")).when(opening == "[REPLY", F.lit("assistant")).otherwise(name)
        close = F.when(opening == "[REPLY", F.lit(4)).otherwise(F.lit(7))
        size = F.length(t) - F.length(opening) - F.lit(2) - close
        return F.struct(role.alias("role"), unescape(F.substr(t, F.length(opening) + F.lit(3), size)).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def masked_texts(formatted: Column, spans: Column) -> Column:
    """Array of the unescaped texts under the loss mask, cut out by its bytes."""
    data = F.array(formatted.cast("binary"))  # bound once, not per span
    cuts = F.transform(data, lambda b: F.transform(spans, lambda s: unescape(F.substr(b, s["byte_start"] + 1, s["byte_length"]).cast("string"))))
    return F.flatten(cuts)


def _same_tree(x: str, y: str) -> Column:
    return F.col(x).eqNullSafe(F.col(y))


def jump_tables(nodes: DataFrame) -> list[DataFrame]:
    """Table k: (tree, id, up, total) of the messages with an ancestor 2^k above; total: scores from the message to below it."""
    known = nodes.select(F.col("tree").alias("p_tree"), F.col("id").alias("p_id"))
    first = nodes.where("parent is not null").join(known, _same_tree("tree", "p_tree") & (F.col("parent") == F.col("p_id")))
    levels = [cut(first.select("tree", "id", F.col("parent").alias("up"), F.col("score").alias("total")), "jumps")]
    most = nodes.count()
    while levels[-1].limit(1).count():
        if len(levels) > math.log2(most) + 1:  # no path is so long: what is left runs in cycles
            break
        low = levels[-1]
        high = low.select(F.col("tree").alias("h_tree"), F.col("id").alias("h_id"), F.col("up").alias("h_up"), F.col("total").alias("h_total"))
        met = low.join(high, _same_tree("tree", "h_tree") & (F.col("up") == F.col("h_id")))
        levels.append(cut(met.select("tree", "id", F.col("h_up").alias("up"), (F.col("total") + F.col("h_total")).alias("total")), "jumps"))
    return levels


def branches(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, leaf, n, total): each root-to-leaf path by its leaf, with its length and the sum of its scores."""
    parents = levels[0].select(F.col("tree").alias("p_tree"), F.col("up").alias("p_id")).distinct()
    now = nodes.join(parents, _same_tree("tree", "p_tree") & (F.col("id") == F.col("p_id")), "left_anti").select(
        "tree", F.col("id").alias("leaf"), F.col("id").alias("at"), F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("total")
    )
    for k in range(len(levels) - 1, -1, -1):
        up = levels[k].select(F.col("tree").alias("u_tree"), F.col("id").alias("u_id"), "up", F.col("total").alias("u_total"))
        now = now.join(up, _same_tree("tree", "u_tree") & (F.col("at") == F.col("u_id")), "left").select(
            "tree",
            "leaf",
            F.coalesce("up", "at").alias("at"),
            (F.col("n") + F.when(F.col("up").isNotNull(), F.lit(2**k)).otherwise(0)).alias("n"),
            (F.col("total") + F.coalesce("u_total", F.lit(0.0))).alias("total"),
        )
        if k % 4 == 0:
            now = cut(now, "climb")
    below = levels[0].select(F.col("tree").alias("c_tree"), F.col("id").alias("c_id"))
    roots = nodes.join(below, _same_tree("tree", "c_tree") & (F.col("id") == F.col("c_id")), "left_anti")  # none of a cycle
    roots = roots.select(F.col("tree").alias("r_tree"), F.col("id").alias("r_id"), "score")
    return now.join(roots, _same_tree("tree", "r_tree") & (F.col("at") == F.col("r_id"))).select("tree", "leaf", "n", (F.col("total") + F.col("score")).alias("total"))


def best_branches(found: DataFrame, most: int) -> DataFrame:
    """(tree, branch, leaf, n, total): the ``most`` first branches of each tree, numbered from 1."""
    order = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("n"), "leaf")
    return found.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= most).select("tree", "branch", "leaf", "n", "total")


def members(chosen: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, branch, id, place): the messages of the chosen paths, placed from 1 at the root."""
    # a run: (tree, branch, at, n, place): n messages upwards from ``at``, which has that place
    now = chosen.select("tree", "branch", F.col("leaf").alias("at"), "n", F.col("n").alias("place"))
    for k in range(len(levels) - 1, -1, -1):
        up = levels[k].select(F.col("tree").alias("u_tree"), F.col("id").alias("u_id"), "up")
        cuts = F.col("n") > 2**k
        met = now.withColumn("key", F.when(cuts, F.col("at"))).join(up, _same_tree("tree", "u_tree") & (F.col("key") == F.col("u_id")), "left")
        halves = F.array(
            F.struct(F.col("at"), F.least("n", F.lit(2**k).cast("long")).alias("n"), "place"),
            F.struct(F.col("up").alias("at"), (F.col("n") - 2**k).alias("n"), (F.col("place") - 2**k).alias("place")),
        )
        now = met.select("tree", "branch", F.explode(F.filter(halves, lambda h: h["n"] > 0)).alias("h")).select("tree", "branch", "h.at", "h.n", "h.place")
        if k % 3 == 0:
            now = cut(now, "members")
    return now.select("tree", "branch", F.col("at").alias("id"), "place")


def _assembled(rows: DataFrame) -> DataFrame:
    """Conversations from (tree, branch, place, role, text)."""
    before = Window.partitionBy("tree", "branch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    formatted, opening = piece(F.col("role"), F.col("text"))
    pieces = rows.select("tree", "branch", "place", "role", formatted.alias("piece"), F.length(opening).alias("lead"), F.octet_length(opening).alias("byte_lead"))
    first = len(BEGIN)
    close = F.lit(len(CLOSINGS[0]))
    placed = pieces.select(
        "tree", "branch", "place", "role", "piece",
        (F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + first + F.col("lead")).alias("start"),
        (F.length("piece") - F.col("lead") - close).cast("long").alias("length"),
        (F.coalesce(F.sum(F.octet_length("piece")).over(before), F.lit(0)) + first + F.col("byte_lead")).cast("int").alias("byte_start"),
        (F.octet_length("piece") - F.col("byte_lead") - close).cast("int").alias("byte_length"),
    )
    turns = F.sort_array(F.collect_list(F.struct("place", "role", "piece", "start", "length", "byte_start", "byte_length")))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"], t["length"], t["byte_start"], t["byte_length"]))
    return (
        placed.groupBy("tree", "branch")
        .agg(turns.alias("turns"))
        .select("tree", "branch", F.concat(F.lit(BEGIN), F.array_join(F.col("turns.piece"), "")).alias("formatted"), spans.alias("loss_spans"))
    )


def _met_in_place(steps: DataFrame, texts: DataFrame) -> DataFrame:
    """Steps with their texts: both go to their tree's place once, and meet there by a window over (tree, key)."""
    none = F.lit(None)
    both = texts.select("tree", "key", none.cast("int").alias("branch"), none.cast("long").alias("place"), "role", "text").union(
        steps.select("tree", "key", "branch", "place", none.cast("string").alias("role"), none.cast("string").alias("text"))
    )
    # the texts of a key come first, so a running minimum carries the one that counts to its steps
    order = Window.partitionBy("tree", "key").orderBy(F.col("place").asc_nulls_first(), "branch")
    own = F.when(F.col("text").isNotNull(), F.struct("role", "text"))
    least = F.min(own).over(order)
    return both.repartition("tree").withColumn("own", least).where("place is not null and own is not null").select("tree", "branch", "place", "own.role", "own.text")


def _met_by_key(steps: DataFrame, texts: DataFrame) -> DataFrame:
    """The same by a join on (tree, key), for trees too large for one place."""
    single = texts.groupBy("tree", "key").agg(F.min(F.struct("role", "text")).alias("own")).select(F.col("tree").alias("t_tree"), F.col("key").alias("t_key"), "own")
    return steps.join(single, _same_tree("tree", "t_tree") & (F.col("key") == F.col("t_key"))).select("tree", "branch", "place", "own.role", "own.text")


def conversations(nodes: DataFrame, texts: DataFrame, most: int = 1) -> DataFrame:
    """tree, branch, formatted, loss_spans of the ``most`` best branches of each tree.

    ``nodes``: tree, id, parent, score (double), key; ``texts``: tree, key, role, text.  The key names a
    message's text; messages of a tree may share one.
    """
    nodes = cut(
        nodes.where("id is not null")
        .groupBy("tree", "id")
        .agg(F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).alias("score"), "key")).alias("x"))
        .select("tree", "id", "x.parent", "x.score", "x.key"),
        "nodes",
    )
    levels = jump_tables(nodes)
    chosen = best_branches(branches(nodes, levels), most)
    placed = members(chosen, levels)
    keys = nodes.select(F.col("tree").alias("n_tree"), F.col("id").alias("n_id"), "key")
    steps = cut(placed.join(keys, _same_tree("tree", "n_tree") & (F.col("id") == F.col("n_id"))).select("tree", "branch", "place", "key"), "steps")
    texts = texts.select("tree", "key", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    large = cut(nodes.groupBy(F.col("tree").alias("l_tree")).agg(F.count("*").alias("n")).where(F.col("n") > LARGE_TREE).select("l_tree"), "large")
    if not large.limit(1).count():
        return _assembled(_met_in_place(steps, texts))
    side = sized_broadcast(large, MAX_BROADCAST_TREES)
    on = _same_tree("tree", "l_tree")
    small = _met_in_place(steps.join(side, on, "left_anti"), texts.join(side, on, "left_anti"))
    return _assembled(small).union(_assembled(_met_by_key(steps.join(side, on, "left_semi"), texts.join(side, on, "left_semi"))))


def format_trees(messages: DataFrame, most: int = 1) -> DataFrame:
    """Conversations of ``messages``: tree, id, parent, role, text, score."""
    nodes = messages.select("tree", "id", "parent", F.col("score").cast("double").alias("score"), F.col("id").alias("key"))
    return conversations(nodes, messages.where("id is not null").select("tree", F.col("id").alias("key"), "role", "text"), most)


def format_turns(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations of ``rows`` in turn order: each row replies to the one before it, so a conversation is one path.

    Rows of one turn follow each other by role and a digest of their text; equal rows are turns of their own.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat_ws("\n", F.coalesce(F.col(turn).cast("string"), F.lit("")), role, text), 256)), 1, 16)
    given = rows.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), role.alias("role"), text.alias("text"), digest.alias("key"))
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "key")
    nodes = given.select("tree", "turn", "role", "key").withColumn("id", F.row_number().over(order).cast("long"))
    nodes = nodes.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), "key")
    return conversations(nodes, given.select("tree", "key", "role", "text"))
