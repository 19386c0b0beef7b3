"""Multi-party perspective rotation of conversations (operator 6), DataFrame operations only.

For every participant the dialogue is rendered with that speaker as the assistant and all others as
named users; the mask lists the character ranges that the speaker says, each with its end mark. System turns
belong to nobody and are rendered the same for all.

A conversation may hold most rows. Turns are numbered by a range sort, and a rendering comes in parts of at
most `part_turns` turns with offsets of their own, so no text grows with a conversation and nothing is cut off.

A participant is a role as it stands in the table. Names are shown with an underscore for blanks and marks; where several roles
of a conversation would be shown alike, the second one (in the order of the roles) is shown with ` #2` behind its name, and so on. No
role can be shown like that by itself.

Defined results: turns come in the order of turn (null last), role, text; repeated rows are repeated turns. A null
text is empty. A null or empty role speaks as `unknown`, before a participant of that name, and gets no rendering of its own. A null
conv_id is one conversation. Marks inside texts and names are broken up, so only real marks remain. A
conversation of system turns alone gives no row. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidweave.llm.common import sorted_positions, stored

END = "<|end|>\n"


def rotate(turns: DataFrame, system_roles: tuple[str, ...] = ("system",), part_turns: int = 256) -> DataFrame:
    """Per (conversation, participant, part): (conv_id, speaker, part, first_turn, n_turns, text, mask).

    mask: array of (start, end) in characters of the part, end excluded. first_turn: 0-based place in the conversation.
    """
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = turns.select("conv_id", "turn", F.col("role").alias("raw"), F.coalesce("role", F.lit("")).alias("role"), safe(F.col("text")).alias("said"),
                        F.col("role").isin(*system_roles).alias("system"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("raw"), F.col("said"), F.col("tie")]
    placed = sorted_positions(rows, order, "place")
    first = placed.groupBy("conv_id").agg(F.min("place").alias("first")).withColumnRenamed("conv_id", "conv")
    numbered = (placed.join(first, F.col("conv_id").eqNullSafe(F.col("conv"))).withColumn("at", F.col("place") - F.col("first"))
                .select("conv_id", "at", F.floor(F.col("at") / part_turns).cast("long").alias("part"), "role", "said",
                        F.coalesce("system", F.lit(False)).alias("system")))
    # the participants of a conversation, each with a name of its own
    clean = F.when(F.col("role") == "", F.lit("unknown")).otherwise(F.regexp_replace("role", r"[<|>\s]+", "_"))
    roles = numbered.filter("not system").select("conv_id", "role").distinct().withColumn("clean", clean)
    place = F.row_number().over(Window.partitionBy("conv_id", "clean").orderBy("role"))
    shown_as = F.when(place == 1, F.col("clean")).otherwise(F.concat("clean", F.lit(" #"), place.cast("string")))
    people = stored(roles.select(F.col("conv_id").alias("conv"), F.col("role").alias("who"), shown_as.alias("name"), (place > 1).alias("alike")), "people")
    same = lambda a: F.col("conv_id").eqNullSafe(F.col(a))
    # few roles need a number; as a table of its own their size is known, and the turns need not move for them
    alike = stored(people.filter("alike").select("conv", "who", F.col("name").alias("other")), "alike")
    named = (numbered.join(alike, same("conv") & (F.col("role") == F.col("who")) & ~F.col("system"), "left")
             .withColumn("name", F.coalesce("other", clean)).drop("conv", "who", "other"))
    speakers = people.filter("who <> ''").select(F.col("conv").alias("of"), F.col("who").alias("speaking"), F.col("name").alias("speaker"))
    seen = named.join(speakers, same("of")).drop("of")
    own = ~F.col("system") & (F.col("role") == F.col("speaking"))
    head = (F.when(F.col("system"), F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit("<|user name="), F.col("name"), F.lit("|>\n"))))
    shown = seen.withColumn("own", own).withColumn("head", head).withColumn("piece", F.concat("head", "said", F.lit(END)))
    before = Window.partitionBy("conv_id", "speaker", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    shown = shown.withColumn("start", F.coalesce(F.sum(F.char_length("piece").cast("long")).over(before), F.lit(0)))
    span = F.struct((F.col("start") + F.char_length("head")).alias("start"), (F.col("start") + F.char_length("piece") - 1).alias("end"))
    parts = shown.groupBy("conv_id", "speaker", "part").agg(
        F.min("at").alias("first_turn"), F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("own"), span))).alias("mask"))
    return parts.select("conv_id", "speaker", "part", "first_turn", "n_turns",
                        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"), "mask")


SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text) - 1 AS k,
    coalesce(role, '') AS role, replace(coalesce(text, ''), '<|', '< |') AS said, coalesce(role = 'system', false) AS system FROM conversations),
c AS (SELECT DISTINCT conv_id, role, CASE WHEN role = '' THEN 'unknown' ELSE regexp_replace(role, '[<|>\s]+', '_', 'g') END AS clean FROM t WHERE NOT system),
n AS (SELECT conv_id, role, clean || CASE row_number() OVER (PARTITION BY conv_id, clean ORDER BY role) WHEN 1 THEN ''
    ELSE ' #' || row_number() OVER (PARTITION BY conv_id, clean ORDER BY role) END AS name FROM c),
s AS (SELECT t.conv_id, p.name AS speaker, k, k // 256 AS part, NOT system AND t.role = p.role AS own,
    CASE WHEN system THEN '<|system|>' || chr(10) WHEN t.role = p.role THEN '<|assistant|>' || chr(10)
      ELSE '<|user name=' || n.name || '|>' || chr(10) END AS head, said
  FROM t JOIN n p ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND p.role <> ''
  LEFT JOIN n ON t.conv_id IS NOT DISTINCT FROM n.conv_id AND t.role = n.role AND NOT t.system),
x AS (SELECT *, head || said || '<|end|>' || chr(10) AS piece FROM s),
y AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, speaker, part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM x)
SELECT conv_id, speaker, CAST(part AS BIGINT) AS part, CAST(min(k) AS BIGINT) AS first_turn, count(*) AS n_turns, string_agg(piece, '' ORDER BY k) AS text,
  coalesce(string_agg(CASE WHEN own THEN (b + length(head)) || '-' || (b + length(piece) - 1) END, ';' ORDER BY k), '') AS mask
FROM y GROUP BY conv_id, speaker, part"""
