"""Chat rendering from every participant's perspective.

For each participant of a dialogue (every role but ``system``) the whole dialogue is rendered with
that participant as the assistant and the others as named users; the mask holds the character spans
the assistant is to learn, text and end mark of its own turns.

Dialogues are rendered in parts of ``PART`` turns, so that no task ever holds more of one, however
long it is; ``offset`` says where a part begins in the whole rendering and mask spans count from
the rendering's start. Ordinary dialogues have one part. Turn numbers need not be dense; positions
come from ranks inside cells of turn numbers, so a dialogue that holds a third of all rows is
spread over many tasks. Everything is DataFrame functions.

Turns of equal number are ordered by role and text, repeated rows are turns of their own. A null
turn number comes first, a null role is ``unknown``, a null text is empty. Rows without dialogue id
belong to no dialogue; a dialogue of system turns alone has no participant; both give no row. Marks
inside a text are broken by a space, so that only rendered marks are marks.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figmill.operators.positions import dense_position

PART = 256
SYSTEM = "system"
BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Stands for a null turn number, before all others.
NO_TURN = -(1 << 62)


def _header(role, speaker):
    name = F.regexp_replace(role, "[\\s<|>]+", "_")
    return F.concat(
        F.lit(BEGIN),
        F.when(role == SYSTEM, F.lit("system"))
        .when(role == speaker, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), name)),
        F.lit("\n"),
    )


def rotations(
    turns: DataFrame,
    dialogue: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``dialogue, speaker, part, n_turns, offset, rendered, mask``; mask is an array of spans."""
    rows = turns.filter(F.col(dialogue).isNotNull()).select(
        F.col(dialogue).alias("dialogue"),
        F.coalesce(F.col(turn).cast("long"), F.lit(NO_TURN)).alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
        F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "<\\|", "< |").alias("text"),
    )
    placed = dense_position(rows, F.col("turn"), ("role", "text"), ("dialogue",))
    parts = (
        placed.withColumn("part", F.floor(F.col("position") / PART))
        .groupBy("dialogue", "part")
        .agg(F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("turns"))
    )
    speakers = (
        rows.filter(F.col("role") != SYSTEM)
        .select("dialogue", F.col("role").alias("speaker"))
        .distinct()
    )
    speaker = F.col("speaker")
    own = parts.join(speakers, "dialogue").withColumn(
        "pieces",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == speaker).alias("own"),
                _header(t["role"], speaker).alias("header"),
                F.concat(t["text"], F.lit(END + "\n")).alias("body"),
            ),
        ),
    )
    starts = F.aggregate(
        "pieces",
        F.array(F.lit(0).cast("long")),
        lambda ends, p: F.concat(
            ends,
            F.array(F.element_at(ends, -1) + F.length(p["header"]) + F.length(p["body"])),
        ),
    )
    measured = own.withColumns(
        {
            "starts": starts,
            "rendered": F.array_join(
                F.transform("pieces", lambda p: F.concat(p["header"], p["body"])), ""
            ),
        }
    ).withColumn("size", F.element_at("starts", -1))
    before = W.partitionBy("dialogue", "speaker").orderBy("part").rowsBetween(
        W.unboundedPreceding, -1
    )
    offset = F.coalesce(F.sum("size").over(before), F.lit(0))
    spans = F.filter(
        F.transform(
            "pieces",
            lambda p, i: F.when(
                p["own"],
                F.struct(
                    (F.col("offset") + F.get("starts", i) + F.length(p["header"])).alias("first"),
                    (F.col("offset") + F.get("starts", i + 1) - 1).alias("end"),
                ),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    return measured.withColumn("offset", offset).select(
        F.col("dialogue").alias(dialogue),
        "speaker",
        F.col("part").cast("long").alias("part"),
        F.size("pieces").cast("long").alias("n_turns"),
        F.col("offset").cast("long").alias("offset"),
        "rendered",
        spans.alias("mask"),
    )


def mask_text(mask: str) -> Column:
    """Spans as text: ``first-end`` joined by commas."""
    shown = F.transform(mask, lambda s: F.concat_ws("-", s["first"], s["end"]))
    return F.array_join(shown, ",")


def rotations_sql() -> str:
    """The rotations of ``conversations`` as DuckDB SQL."""
    return f"""
    WITH turns AS (
      SELECT conv_id, coalesce(role, 'unknown') AS role,
        replace(coalesce(text, ''), '<|', '< |') AS text,
        row_number() OVER (
          PARTITION BY conv_id
          ORDER BY coalesce(turn, {NO_TURN}), coalesce(role, 'unknown'),
            replace(coalesce(text, ''), '<|', '< |')) - 1 AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
    speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> '{SYSTEM}'),
    pieces AS (
      SELECT conv_id, speaker, pos, role = speaker AS own,
        '{BEGIN}' || CASE WHEN role = '{SYSTEM}' THEN 'system' WHEN role = speaker THEN 'assistant'
          ELSE 'user name=' || regexp_replace(role, '[\\s<|>]+', '_', 'g') END || chr(10) AS head,
        text || '{END}' || chr(10) AS body
      FROM turns JOIN speakers USING (conv_id)),
    placed AS (
      SELECT *, sum(length(head) + length(body)) OVER (
        PARTITION BY conv_id, speaker ORDER BY pos) - length(head) - length(body) AS first
      FROM pieces)
    SELECT conv_id, speaker, (pos // {PART})::BIGINT AS part, count(*)::BIGINT AS n_turns,
      min(first)::BIGINT AS "offset", string_agg(head || body, '' ORDER BY pos) AS rendered,
      coalesce(string_agg(
        CASE WHEN own THEN (first + length(head))::BIGINT || '-'
          || (first + length(head) + length(body) - 1)::BIGINT END, ',' ORDER BY pos), '') AS mask
    FROM placed GROUP BY conv_id, speaker, pos // {PART}
    """
