"""Conversations told once from the side of each participant.

For every speaker of a conversation the dialogue is rendered with that speaker as the
assistant and all others as users with their names; the mask holds the spans that the
speaker says, which are what a model is trained on. System turns are context for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bound, kept, steps

SYSTEM = "system"
NOBODY = "unknown"
#: Turns are rendered in blocks, by their place, so that a row has a bounded number of
#: them; a conversation of fewer turns is one row for each participant.
BLOCK_TURNS = 256
#: Blocks of a conversation that meet one copy of its speakers.
SHARE_BLOCKS = 64
END = "<|end|>\n"


def opening(role: Column, speaker: Column) -> Column:
    return (
        F.when(role == speaker, F.lit("<|assistant|>\n"))
        .when(role == SYSTEM, F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    )


def rendered(turns: Column, speaker: Column) -> Column:
    """text, mask (start:end of what the speaker says and its end mark) and n_targets."""
    parts = F.transform(
        turns,
        lambda t: F.struct(
            opening(t["role"], speaker).alias("opening"),
            F.concat(t["text"], F.lit(END)).alias("said"),
            (t["role"] == speaker).alias("target"),
        ),
    )

    def laid_out(p: Column) -> Column:
        lengths = F.transform(
            p, lambda x: F.char_length(x["opening"]) + F.char_length(x["said"])
        )
        none = F.array().cast("array<int>")
        ends = bound(
            lengths,
            lambda n: F.aggregate(
                n,
                none,
                lambda done, x: F.concat(
                    done, F.array(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + x)
                ),
            ),
        )

        def masked(end: Column) -> Column:
            spans = F.transform(
                F.filter(steps(F.size(p)), lambda i: F.get(p, i)["target"]),
                lambda i: F.concat_ws(
                    ":",
                    (F.get(end, i) - F.char_length(F.get(p, i)["said"])).cast("string"),
                    F.get(end, i).cast("string"),
                ),
            )
            return F.struct(
                F.array_join(
                    F.transform(p, lambda x: F.concat(x["opening"], x["said"])), ""
                ).alias("rendered"),
                F.array_join(spans, ",").alias("mask"),
                F.size(spans).cast("long").alias("n_targets"),
            )

        return bound(ends, masked)

    return bound(parts, laid_out)


def placed(rows: DataFrame) -> DataFrame:
    """Adds `place`, a turn's number in its conversation from 0.

    Rows are sorted over all tasks, equal ones too, so no conversation has to fit into
    one; a place is the number in the task and the turns of the tasks before.
    """
    order = ["conv_id", "turn", "role", "digest", "given"]
    keyed = rows.withColumn("digest", F.md5("text")).withColumn("given", F.monotonically_increasing_id())
    ordered = kept(
        rows.sparkSession,
        keyed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*rows.columns, "digest", F.monotonically_increasing_id().alias("id")),
        "turns",
    )
    ordered = ordered.withColumn("task", F.shiftright("id", 33))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ordered.groupBy("conv_id", "task")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .select(
            F.col("conv_id").alias("of"), F.col("task").alias("in"),
            (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        )
    )
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("task") == F.col("in"))
    return ordered.join(starts, same).withColumn("place", F.col("id") + F.col("shift"))


def perspectives(conversations: DataFrame) -> DataFrame:
    """A row for each conversation, speaker and block: conv_id, speaker, block, n_turns,
    rendered, mask, n_targets.

    A block has `BLOCK_TURNS` turns, the last one of a conversation what is left. A NULL
    role is a speaker called `unknown`; a NULL text says nothing, a NULL turn comes first.
    Turns with one number are ordered by role, then by the text's digest; repeated rows
    are repeated turns. A conversation of system turns alone has no speaker and no row. A
    speaker who is silent in a block still has its row, with an empty mask. Rows without
    conv_id are one conversation. Other columns are not read.
    """
    rows = placed(
        conversations.select(
            "conv_id",
            F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
            F.coalesce("role", F.lit(NOBODY)).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
    ).withColumn("block", F.floor(F.col("place") / BLOCK_TURNS).cast("long"))
    blocks = rows.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns")
    )
    # A long conversation's speakers come in copies, so that its blocks don't all meet in
    # one task.
    last = Window.partitionBy("speaks_in")
    shares = F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / SHARE_BLOCKS))
    speakers = (
        rows.groupBy(F.col("conv_id").alias("speaks_in"), F.col("role").alias("speaker"))
        .agg(F.max("block").alias("last"))
        .withColumn("last", F.max("last").over(last))
        .where(F.col("speaker") != SYSTEM)
        .select("speaks_in", "speaker", F.explode(shares).alias("share"))
    )
    meet = F.col("conv_id").eqNullSafe(F.col("speaks_in")) & (
        F.floor(F.col("block") / SHARE_BLOCKS) == F.col("share")
    )
    return (
        blocks.join(speakers, meet)
        .select(
            "conv_id", "speaker", "block",
            F.size("turns").cast("long").alias("n_turns"),
            rendered(F.col("turns"), F.col("speaker")).alias("x"),
        )
        .select("conv_id", "speaker", "block", "n_turns", "x.*")
    )


ORACLE_SQL = """
WITH given AS (
    SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role,
           coalesce(text, '') AS text
    FROM conversations
), turns AS (
    SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) - 1) // 256 AS block
    FROM given
), speakers AS (
    SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'
), parts AS (
    SELECT t.conv_id, s.speaker, t.block, t.role = s.speaker AS target,
           CASE WHEN t.role = s.speaker THEN '<|assistant|>' WHEN t.role = 'system' THEN '<|system|>'
                ELSE '<|user name=' || t.role || '|>' END || chr(10) AS opening,
           t.text || '<|end|>' || chr(10) AS said,
           row_number() OVER (PARTITION BY t.conv_id, s.speaker, t.block
                              ORDER BY t.turn, t.role, md5(t.text)) AS place
    FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), laid_out AS (
    SELECT *, sum(length(opening) + length(said)) OVER (
        PARTITION BY conv_id, speaker, block ORDER BY place) AS last FROM parts
)
SELECT conv_id, speaker, block, count(*) AS n_turns,
       string_agg(opening || said, '' ORDER BY place) AS rendered,
       coalesce(string_agg(CAST(last - length(said) AS BIGINT) || ':' || CAST(last AS BIGINT), ','
                           ORDER BY place) FILTER (WHERE target), '') AS mask,
       count(*) FILTER (WHERE target) AS n_targets
FROM laid_out GROUP BY conv_id, speaker, block
"""
