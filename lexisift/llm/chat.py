"""Preference formatting of paired conversations.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once, as the prompt; what
follows in each is its completion. In a completion only the assistant's words are trained on: they are the spans of
its mask; headers and other roles' turns are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns of each conversation in order, of rows of (conv_id, turn, role, text).

    Rows of equal turn number are ordered by role and text, exact repeats of a row count once, and turns without a
    number come first. Null roles and texts count as empty; rows without conv_id are left out.
    """
    one = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    lists = one.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return lists.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def paired(convs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, chosen, rejected): conversations that open with the same turn, two by two.

    Within an opening, conversations are ordered by their longest assistant answer: of neighbours, the one with more
    to say is the chosen one. The opening may be common to very many conversations: they are first dealt by hash into
    buckets of the opening, 256 or one for each 4,096 conversations, so no task holds all of them; each conversation is
    in at most one pair. One that has no partner is compared with its own beginning: the rejected side lacks the last
    turn. Rows without conv_id or with null or no turns are left out; of rows that repeat a conv_id the one with the
    greatest list of turns counts. An empty table gives no rows; other columns are ignored.
    """
    convs = convs.where("conv_id is not null and size(turns) > 0").groupBy("conv_id").agg(F.max("turns").alias("turns"))
    buckets = max(256, -(-convs.select("conv_id").count() // 4096))
    n = F.aggregate(F.filter("turns", lambda t: t["role"] == "assistant"), F.lit(0).cast("bigint"), lambda a, t: F.greatest(a, F.length(t["text"]).cast("bigint")))
    keyed = convs.select("conv_id", "turns", F.md5(F.concat_ws("|", F.element_at("turns", 1)["role"], F.element_at("turns", 1)["text"])).alias("opening"), (F.conv(F.substring(F.md5(F.col("conv_id").cast("string")), 1, 8), 16, 10).cast("bigint") % buckets).alias("bucket"), n.alias("said"))
    order = Window.partitionBy("opening", "bucket").orderBy(F.desc("said"), "conv_id")
    slim = keyed.select("conv_id", "opening", "bucket", "said").withColumn("at", F.row_number().over(order) - 1)
    # Each opening's buckets hold an even number of partners but for the last, which stays alone.
    couples = slim.groupBy("opening", "bucket", F.floor(F.col("at") / 2).alias("couple")).agg(F.max(F.when(F.col("at") % 2 == 0, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(F.col("at") % 2 == 1, F.col("conv_id"))).alias("rejected_id"))
    single = couples.where("rejected_id is null")
    again = single.withColumn("at", F.row_number().over(Window.partitionBy("opening").orderBy("bucket")) - 1)
    rest = again.groupBy("opening", F.floor(F.col("at") / 2).alias("couple")).agg(F.max(F.when(F.col("at") % 2 == 0, F.col("chosen_id"))).alias("chosen_id"), F.max(F.when(F.col("at") % 2 == 1, F.col("chosen_id"))).alias("rejected_id"))
    both = couples.where("rejected_id is not null").select("chosen_id", "rejected_id").union(rest.select("chosen_id", "rejected_id"))
    text = convs.select("conv_id", "turns")
    out = both.join(text.withColumnsRenamed({"conv_id": "chosen_id", "turns": "chosen"}), "chosen_id")
    # Those without partner stay out of the second join: their null keys would all meet in one task.
    two = out.where("rejected_id is not null").join(text.withColumnsRenamed({"conv_id": "rejected_id", "turns": "rejected"}), "rejected_id")
    alone = out.where("rejected_id is null").select("chosen_id", F.col("chosen_id").alias("rejected_id"), "chosen", F.expr("slice(chosen, 1, size(chosen) - 1)").alias("rejected"))
    return two.select("chosen_id", "rejected_id", "chosen", "rejected").union(alone)


def common_turns(a: Column, b: Column) -> Column:
    """How many turns both start with."""
    differs = F.filter(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda i: ~F.try_element_at(a, i).eqNullSafe(F.try_element_at(b, i)))
    return F.coalesce(F.element_at(F.concat(differs, F.array(F.size(a) + 1)), 1) - 1, F.lit(0))


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    """Each turn as its header, its text and an end mark."""
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t["role"]), t["text"], F.lit("<|end|>\n"))), "")


def trained_spans(turns: Column) -> Column:
    """[start, end) in characters of the rendered turns of each assistant text with its end mark."""
    step = lambda s, t: F.struct(
        (s["at"] + F.length(header(t["role"])) + F.length(t["text"]) + 8).alias("at"),
        F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(F.array(s["at"] + F.length(header(t["role"])), s["at"] + F.length(header(t["role"])) + F.length(t["text"]) + 7)))).otherwise(s["spans"]).alias("spans"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("spans"))
    return F.aggregate(turns, start, step, lambda s: s["spans"])


def preferences(pairs: DataFrame) -> DataFrame:
    """``pairs`` (chosen_id, rejected_id, chosen, rejected) formatted.

    prompt is the common beginning, chosen_text and rejected_text the completions, chosen_spans and rejected_spans
    where these are trained on, prompt_turns the number of common turns. If one conversation is the beginning of the
    other, its completion is empty. A null list of turns counts as empty; repeated pairs are formatted each on its own.
    Texts are rendered as they are: one that holds an end mark itself keeps it, and spans, which follow from lengths,
    are right all the same.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    safe = pairs.withColumn("chosen", F.coalesce("chosen", empty)).withColumn("rejected", F.coalesce("rejected", empty)).withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")).cast("bigint"))
    rest = lambda c: F.filter(c, lambda t, i: i >= F.col("prompt_turns"))
    return safe.select(
        "chosen_id",
        "rejected_id",
        "prompt_turns",
        rendered(F.filter("chosen", lambda t, i: i < F.col("prompt_turns"))).alias("prompt"),
        rendered(rest("chosen")).alias("chosen_text"),
        rendered(rest("rejected")).alias("rejected_text"),
        trained_spans(rest("chosen")).alias("chosen_spans"),
        trained_spans(rest("rejected")).alias("rejected_spans"),
    )


#: The same rows; texts of a side are built from numbered turns.
SQL = """
WITH turn_rows AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM turn_rows),
convs AS (SELECT conv_id, count(*) AS n, max(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS said,
  md5(max(CASE WHEN pos = 1 THEN role || '|' || text END)) AS opening, CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 8) AS BIGINT) % greatest(256, (count(*) OVER () + 4095) // 4096) AS bucket FROM numbered GROUP BY conv_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY opening, bucket ORDER BY said DESC, conv_id) - 1 AS place FROM convs),
couples AS (SELECT opening, bucket, place // 2 AS couple, max(CASE WHEN place % 2 = 0 THEN conv_id END) AS c, max(CASE WHEN place % 2 = 1 THEN conv_id END) AS r FROM placed GROUP BY ALL),
again AS (SELECT opening, c, row_number() OVER (PARTITION BY opening ORDER BY bucket) - 1 AS place FROM couples WHERE r IS NULL),
rest AS (SELECT max(CASE WHEN place % 2 = 0 THEN c END) AS c, max(CASE WHEN place % 2 = 1 THEN c END) AS r FROM again GROUP BY opening, place // 2),
pairs AS (SELECT c, r FROM couples WHERE r IS NOT NULL UNION ALL SELECT c, r FROM rest),
sized AS (SELECT c, r, a.n AS cn, coalesce(b.n, a.n - 1) AS rn FROM pairs JOIN convs a ON a.conv_id = c LEFT JOIN convs b ON b.conv_id = r),
same AS (SELECT s.c, count(*) FILTER (WHERE ok) AS prompt_turns FROM (
  SELECT s.c, min(CASE WHEN y.pos IS NULL OR x.role <> y.role OR x.text <> y.text THEN 0 ELSE 1 END) OVER (PARTITION BY s.c ORDER BY x.pos) = 1 AS ok
  FROM sized s JOIN numbered x ON x.conv_id = s.c LEFT JOIN numbered y ON y.conv_id = coalesce(s.r, s.c) AND y.pos = x.pos AND y.pos <= s.rn) s GROUP BY s.c),
sides AS (SELECT p.c, m.prompt_turns, 'c' AS side, t.* FROM sized p JOIN same m USING (c) JOIN numbered t ON t.conv_id = p.c
  UNION ALL SELECT p.c, m.prompt_turns, 'r', t.* FROM sized p JOIN same m USING (c) JOIN numbered t ON t.conv_id = coalesce(p.r, p.c) AND t.pos <= p.rn),
texts AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece, pos > prompt_turns AS after FROM sides),
spans AS (SELECT *, sum(length(piece)) FILTER (WHERE after) OVER (PARTITION BY c, side ORDER BY pos) - length(piece) + length(role) + 5 AS first FROM texts),
built AS (SELECT c, side, max(prompt_turns) AS prompt_turns, coalesce(string_agg(piece, '' ORDER BY pos) FILTER (WHERE NOT after), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY pos) FILTER (WHERE after), '') AS completion,
  coalesce(list([CAST(first AS INTEGER), CAST(first + length(text) + 7 AS INTEGER)] ORDER BY pos) FILTER (WHERE after AND role = 'assistant'), []) AS spans FROM spans GROUP BY c, side)
SELECT s.c AS chosen_id, coalesce(s.r, s.c) AS rejected_id, a.prompt_turns, a.prompt, a.completion AS chosen_text, coalesce(b.completion, '') AS rejected_text, a.spans AS chosen_spans, coalesce(b.spans, []) AS rejected_spans
FROM sized s JOIN built a ON a.c = s.c AND a.side = 'c' LEFT JOIN built b ON b.c = s.c AND b.side = 'r'
"""
