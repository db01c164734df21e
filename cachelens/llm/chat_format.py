"""Chat formatting of reply trees, in DataFrame functions only.

Messages form trees by their parents. Self-joins with doubling jumps enumerate every root-to-leaf path, the
branches of a tree are ranked by score, and each chosen path is formatted as one conversation with a loss
mask over the assistant's texts. Control strings inside texts are escaped reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import stored, text_or_empty

START, END = "<|im_start|>", "<|im_end|>\n"
#: What is replaced, in this order: every backslash in the output begins one of these codes.
CODES = (("\\", "\\b"), ("<|", "<\\p"))
ROLE_CODES = (*CODES, ("\n", "\\n"))


def escape(text: Column, codes: tuple = CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes: tuple = CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def doubled(jumps: DataFrame) -> DataFrame:
    """Jumps (tree, node, up) of twice as many parents, where there are so many."""
    over = jumps.select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
    return stored(jumps.join(over, ["tree", "up"]).select("tree", "node", F.col("next").alias("up")), "jumps")


def rootless(nodes: DataFrame, jumps: DataFrame) -> DataFrame:
    """(tree, node) on a cycle or behind one: they still have jumps of more parents than their tree has nodes."""
    most, step = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0, 1
    while step <= most and not jumps.isEmpty():
        jumps, step = doubled(jumps), 2 * step
    return jumps.select("tree", "node")


def reply_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, back) for every node on the way from a leaf to its root; back is 0 at the leaf.

    ``messages`` (tree, node, parent) are the trees; a parent that isn't there makes a root. Each round joins
    the paths so far with jumps of 1, 2, 4, ... parents, so a path of n messages takes log2(n) rounds, for any n.
    A cycle has no root: its messages and the replies that hang on it give no path.
    """
    nodes = messages.select("tree", "node", "parent").filter("tree IS NOT NULL AND node IS NOT NULL").dropDuplicates(["tree", "node"])
    known = nodes.select("tree", F.col("node").alias("parent"))
    jumps = stored(nodes.filter("parent IS NOT NULL AND parent <> node").join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up")), "jumps")
    if not jumps.filter(F.col("up") >= F.col("node")).isEmpty():  # parents that all come before end at a root
        lost = rootless(nodes, jumps)
        nodes, jumps = (x.join(lost, ["tree", "node"], "left_anti") for x in (nodes, jumps))
    leaves = nodes.join(jumps.select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti")
    paths = stored(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back")), "paths")
    step = 1
    while not jumps.isEmpty():
        further = paths.join(jumps, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("back") + step).alias("back"))
        paths = stored(paths.unionByName(further), "paths")
        jumps, step = doubled(jumps), 2 * step
    return paths


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, branch, score, n_turns, formatted, mask) for the ``best`` branches of each tree.

    ``messages`` (tree, node, parent, role, text, score): a null role or text counts as empty, a null score
    as 0. A branch's score is the mean of its messages'; ties go to the smaller leaf. mask has (start,
    length) in code points of the assistant's texts in ``formatted``, as escaped there.
    """
    paths = reply_paths(messages)
    scores = messages.select("tree", "node", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).dropDuplicates(["tree", "node"])
    branches = paths.join(scores, ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    chosen = branches.withColumn("branch", rank).filter(F.col("branch") <= best)
    texts = messages.select("tree", "node", text_or_empty("role").alias("role"), text_or_empty("text").alias("text")).dropDuplicates(["tree", "node"])
    turns = paths.join(chosen, ["tree", "leaf"]).join(texts, ["tree", "node"])
    told = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("k"), "role", "text"))), lambda t: F.struct((t["role"] == "assistant").alias("own"), F.concat(F.lit(START), escape(t["role"], ROLE_CODES), F.lit("\n")).alias("head"), escape(t["text"]).alias("text")))
    rows = turns.groupBy("tree", "leaf", "branch", "score").agg(told.alias("turns"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        begin, size = state["at"] + F.length(t["head"]), F.length(t["text"]).cast("long")
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        return F.struct((begin + size + len(END)).alias("at"), F.when(t["own"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return rows.select(
        "tree", "leaf", "branch", "score", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", empty, add)["spans"].alias("mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) of each turn of a formatted conversation."""
    parts = F.split(formatted, START.replace("|", "\\|"), -1)

    def turn(part: Column) -> Column:
        cut = F.locate("\n", part)
        text = F.substring(part, cut + 1, F.length(part) - cut - len(END))
        return F.struct(unescape(F.substring(part, F.lit(1), cut - 1), ROLE_CODES).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, with nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def conversation_trees(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each replies to the one before.

    Rows go by turn; ties by role and text, nulls first. A null conv_id is a conversation of its own.
    """
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    return rows.withColumn("node", node.cast("long")).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted text."""
    made = format_trees(stored(conversation_trees(conversations), "messages"))
    read = made.select("tree", "formatted", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("mask")).alias("loss"))
    return read.select(
        F.when(F.col("tree") != "", F.col("tree").cast("long")).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def conversation_sql(table: str = "conversations") -> str:
    """The digests in DuckDB SQL, from the rows themselves."""

    def coded(text: str, codes: tuple) -> str:
        for plain, code in codes:
            text = f"replace({text}, {quoted(plain)}, {quoted(code)})"
        return text

    def quoted(s: str) -> str:
        return " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in s)

    return f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {table}
        UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum({len(START) + 1 + len(END)} + length({coded("role", ROLE_CODES)}) + length({coded("text", CODES)}))::BIGINT AS formatted_chars
    FROM turns GROUP BY conv_id"""
