"""Reply trees as conversations.

Messages form trees by their parents. Every leaf ends a branch, the path from the root
to it; branches of a tree are ranked by the mean score of their messages, and the best
are formatted, each as one conversation with a template that marks turns and tells which
text is under the loss (assistant turns).

Paths are found by iterative self-joins with doubling: after k rounds a message knows
its ancestor 2**k steps up and the sum of scores on the way, so a thread of depth d
takes log2(d) rounds. First all leaves are ranked by these sums, then only the paths of
the chosen leaves are spelled out, with the joins kept from before.

How it runs: each round is a written table joined to itself on message numbers, which
are unique, so no key is hot. Numbers and parents come from one sort by (conversation,
turn, role, text) that deals a long conversation over many tasks. The formatted output is
one row per turn, in order, so no conversation is ever one string or one group; reading
back streams the turns of a conversation through a digest. Only that last digest is bound
to be made by one task for each conversation, turn by turn, without holding them.

Template: ``<|im_start|>role`` line break, text, ``<|im_end|>`` line break. In texts and
roles a backslash is doubled, and one is put after the first character of every control
string of common templates, which can be undone.

Defined results: a null text or role is empty. Repeated rows are turns of their own; ties
of turn are ordered by role and text. A null conversation id is a conversation, a null turn
comes first. Messages whose parent is missing are roots; rings of parents, which no
root reaches, are left out with all that answers them: a round of doubling closes a message
wherever one can be closed, so the rounds end with the first that closes none. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import cut_lineage, ready_for_python

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings by which common chat templates mark turns.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
_CONTROL = "|".join(re.escape(c[1:]) for c in CONTROL)
_HEADS = r"([<\[])(?=" + _CONTROL + ")"
_ESCAPED = re.compile(r"\\(.)", re.S)
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, _HEADS, r"$1\\")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def reply_chain(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages (tree, message, parent, role, text, score) of conversations whose rows follow by turn.

    Each row answers the one before it. The score of a message is its length.
    """
    order = [F.col(c).asc_nulls_first() for c in ("tree", "turn", "role", "text")]
    given = rows.select(
        F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        given.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("mono", F.monotonically_increasing_id())
    )
    # one row per partition goes through this window
    part, local = F.shiftright("mono", 33), F.col("mono").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("start"))
    numbered = cut_lineage(
        placed.withColumn("part", part).join(starts, "part").withColumn("message", F.col("start") + local)
        .select("tree", "message", "turn", "role", "text")
    )
    last = numbered.select((F.col("message") + 1).alias("after"), F.col("tree").alias("t"), F.col("message").alias("parent"))
    answers = numbered.join(last, (F.col("message") == F.col("after")) & F.col("tree").eqNullSafe(F.col("t")), "left")
    return answers.select(
        "tree", "message", "parent", "role", "text", F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score")
    )


def best_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, path, rank, place, message): the messages of the ``keep`` best branches of each tree, root first.

    ``messages`` has tree, message (unique), parent (null or missing: a root) and score.
    """
    base = messages.select("tree", "message", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    parents = base.select(F.col("parent").alias("p")).where("p is not null").distinct()
    real = base.join(base.select(F.col("message").alias("p")), F.col("parent") == F.col("p"), "left").select(
        "tree", "message", F.col("p").alias("up"), "score"
    )
    ups = [cut_lineage(real.select("tree", "message", "up", F.lit(1).cast("long").alias("n"), F.col("score").alias("sum")))]
    # messages that are open after a round that closed none come from a ring
    closed, still_open = -1, ups[0].where("up is not null").count()
    while still_open and closed:
        now = ups[-1]
        above = now.select(F.col("message").alias("m"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("sum").alias("sum2"))
        ups.append(
            cut_lineage(
                now.join(above, F.col("up") == F.col("m"), "left").select(
                    "tree", "message", F.col("up2").alias("up"),
                    (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), (F.col("sum") + F.coalesce("sum2", F.lit(0.0))).alias("sum"),
                )
            )
        )
        before, still_open = still_open, ups[-1].where("up is not null").count()
        closed = before - still_open
    leaves = ups[-1].where("up is null").join(parents, F.col("message") == F.col("p"), "left_anti")
    ranked = Window.partitionBy("tree").orderBy((F.col("sum") / F.col("n")).desc(), F.col("message"))
    chosen = leaves.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= keep)
    paths = chosen.select("tree", F.col("message").alias("path"), "rank", (F.col("n") - 1).alias("place"), "message")
    for k, jump in enumerate(ups[:-1]):
        step = jump.where("up is not null").select(F.col("message").alias("m"), "up")
        further = paths.join(step, F.col("message") == F.col("m")).select(
            "tree", "path", "rank", (F.col("place") - (1 << k)).alias("place"), F.col("up").alias("message")
        )
        paths = cut_lineage(paths.unionByName(further))
    return paths


def formatted_turns(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per turn: tree, path, place, segment, and the code points of it under the loss (from, to)."""
    texts = messages.select("message", "role", "text")
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    learned = F.coalesce(F.col("role") == LEARNED, F.lit(False))
    start = F.length(head).cast("long")
    return paths.join(texts, "message").select(
        "tree", "path", "place",
        F.concat(head, text, F.lit(END)).alias("segment"),
        F.when(learned, start).alias("loss_from"),
        F.when(learned, start + F.length(text)).alias("loss_to"),
    )


def read_back(turns: DataFrame) -> DataFrame:
    """tree, path, n_turns, digests and lengths of each conversation, from its formatted turns alone."""
    ready_for_python(turns.sparkSession)
    kind = turns.schema["tree"].dataType.simpleString()
    fields = [("path", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64())]
    fields += [("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, schema = None, [], None

        def result(s: dict) -> dict:
            return {
                "tree": s["tree"], "path": s["path"], "n_turns": s["n"], "turns_sha256": s["turns"].hexdigest(), "loss_chars": s["chars"],
                "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["size"],
            }

        for batch in batches:
            schema = schema or pa.schema([("tree", batch.column("tree").type), *fields])
            for row in batch.to_pylist():
                if now is None or now["path"] != row["path"]:
                    if now is not None:
                        done.append(result(now))
                    now = {"tree": row["tree"], "path": row["path"], "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0}
                segment = row["segment"]
                role, _, text = segment[len(START) : -len(END)].partition("\n")
                now["n"] += 1
                now["size"] += len(segment)
                now["turns"].update(f"{unescaped(role)}\n{unescaped(text)}\n".encode())
                if row["loss_from"] is not None:
                    learned = unescaped(segment[row["loss_from"] : row["loss_to"]])
                    now["chars"] += len(learned)
                    now["loss"].update(learned.encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([result(now)], schema)

    dealt = turns.repartition("path").sortWithinPartitions("path", "place")
    return dealt.mapInArrow(
        read, f"tree {kind}, path long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def format_conversations(rows: DataFrame, out_dir: str, keep: int = 1, **columns: str) -> DataFrame:
    """Format conversations given as rows by turn into ``out_dir``; the written turns."""
    messages = cut_lineage(reply_chain(rows, **columns))
    formatted_turns(best_paths(messages, keep), messages).write.parquet(out_dir)
    return rows.sparkSession.read.parquet(out_dir)
