"""Preference formatting of conversations, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")


def _spans(turns: Column, trained: str) -> Column:
    """begin-end of the text of each trained turn in what _render makes of turns, joined by commas."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["role"]) + 5
        end = begin + F.length(t["text"])
        own = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == trained, F.concat(state["spans"], F.array(own))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: F.array_join(s["spans"], ","))


def preference_pairs(turns: DataFrame, pair: Column | None = None, rejected: Column | None = None, trained: str = "assistant") -> DataFrame:
    """One row for each pair: (pair_id, chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected,
    chosen_spans, rejected_spans).

    turns: (conv_id, turn, role, text).  pair names the pair of a conversation, rejected tells whether it is
    the rejected one; unless given, conversations 2n and 2n+1 are a pair, the even one chosen.  The prompt is
    the longest common prefix of turns, rendered once; the completions are what follows, and spans
    are the characters of a completion that a loss would count, those of `trained` turns.

    Turns are compared by number, so nothing is ordered to find the prefix: one aggregation puts equal turns side
    by side, another takes the first that differ.  A conversation without a partner is paired with
    null and has no prompt.  Null role or text: empty.  Null turn: before all others.  Of turns with one
    number the least (role, text) counts, so repeated rows change nothing.  Rows without a conv_id belong to
    no conversation and are left out.  An empty table gives no rows.  A very long conversation is rendered in one
    row.  Other columns are not read, so their names do not matter."""
    pair = F.floor(F.col("conv_id") / 2) if pair is None else pair
    rejected = F.pmod(F.col("conv_id"), F.lit(2)) == 1 if rejected is None else rejected
    said = turns.where("conv_id is not null").select(
        pair.cast("long").alias("pair_id"), rejected.alias("no"), F.col("conv_id").alias("id"), F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"),
        F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("own"),
    )
    side = lambda no, c: F.min(F.when(F.col("no") == no, F.col(c)))
    beside = said.groupBy("pair_id", "turn").agg(
        side(False, "own").alias("c"), side(True, "own").alias("r"), side(False, "id").alias("chosen_id"), side(True, "id").alias("rejected_id")
    )
    same = F.coalesce(F.col("c") == F.col("r"), F.lit(False))
    heads = beside.groupBy("pair_id").agg(F.min(F.when(~same, F.col("turn"))).alias("cut"), F.min("chosen_id").alias("chosen_id"), F.min("rejected_id").alias("rejected_id"))
    parts = beside.select("pair_id", "turn", "c", "r").join(heads, "pair_id")
    common = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    listed = lambda which, c: F.transform(F.array_sort(F.collect_list(F.when(which & F.col(c).isNotNull(), F.struct("turn", F.col(c).alias("own"))))), lambda t: t["own"])
    rows = parts.groupBy("pair_id", "chosen_id", "rejected_id").agg(listed(common, "c").alias("p"), listed(~common, "c").alias("c"), listed(~common, "r").alias("r"))
    only = lambda of, value: F.when(F.col(of).isNotNull(), value)
    return rows.select(
        "pair_id", "chosen_id", "rejected_id", F.size("p").cast("long").alias("prompt_turns"), _render(F.col("p")).alias("prompt"),
        only("chosen_id", _render(F.col("c"))).alias("chosen"), only("rejected_id", _render(F.col("r"))).alias("rejected"),
        only("chosen_id", _spans(F.col("c"), trained)).alias("chosen_spans"), only("rejected_id", _spans(F.col("r"), trained)).alias("rejected_spans"),
    )


#: The same for conversations 2n and 2n+1, in DuckDB.
SQL = """
WITH said AS (
  SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, conv_id % 2 <> 0 AS rej, conv_id AS id, coalesce(turn, -1) AS turn,
         coalesce(role, '') AS role, coalesce(text, '') AS body
  FROM conversations WHERE conv_id IS NOT NULL),
one AS (
  SELECT pair_id, rej, id, turn, min({'role': role, 'body': body}) AS own FROM said GROUP BY ALL),
beside AS (
  SELECT pair_id, turn, min(own) FILTER (NOT rej) AS c, min(own) FILTER (rej) AS r,
         min(id) FILTER (NOT rej) AS cid, min(id) FILTER (rej) AS rid FROM one GROUP BY pair_id, turn),
heads AS (
  SELECT pair_id, min(turn) FILTER (NOT coalesce(c = r, false)) AS cut, min(cid) AS chosen_id, min(rid) AS rejected_id
  FROM beside GROUP BY pair_id),
flat AS (
  SELECT b.pair_id, b.turn, 'p' AS side, b.c AS own FROM beside b JOIN heads USING (pair_id) WHERE cut IS NULL OR turn < cut
  UNION ALL SELECT b.pair_id, b.turn, 'c', b.c FROM beside b JOIN heads USING (pair_id) WHERE turn >= cut AND b.c IS NOT NULL
  UNION ALL SELECT b.pair_id, b.turn, 'r', b.r FROM beside b JOIN heads USING (pair_id) WHERE turn >= cut AND b.r IS NOT NULL),
placed AS (
  SELECT pair_id, side, turn, own.role AS role, '<|' || own.role || '|>' || chr(10) || own.body || chr(10) AS shown, length(own.body) AS long,
         sum(length(own.role) + 6 + length(own.body)) OVER (PARTITION BY pair_id, side ORDER BY turn) - 1 AS stop
  FROM flat),
made AS (
  SELECT pair_id, side, count(*) AS n, string_agg(shown, '' ORDER BY turn) AS shown,
         coalesce(string_agg(CAST(CAST(stop - long AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY turn) FILTER (role = 'assistant'), '') AS spans
  FROM placed GROUP BY pair_id, side)
SELECT h.pair_id, h.chosen_id, h.rejected_id, CAST(coalesce(p.n, 0) AS BIGINT) AS prompt_turns, coalesce(p.shown, '') AS prompt,
       CASE WHEN h.chosen_id IS NOT NULL THEN coalesce(c.shown, '') END AS chosen,
       CASE WHEN h.rejected_id IS NOT NULL THEN coalesce(r.shown, '') END AS rejected,
       CASE WHEN h.chosen_id IS NOT NULL THEN coalesce(c.spans, '') END AS chosen_spans,
       CASE WHEN h.rejected_id IS NOT NULL THEN coalesce(r.spans, '') END AS rejected_spans
FROM heads h LEFT JOIN made p ON p.pair_id = h.pair_id AND p.side = 'p' LEFT JOIN made c ON c.pair_id = h.pair_id AND c.side = 'c'
LEFT JOIN made r ON r.pair_id = h.pair_id AND r.side = 'r'
"""
