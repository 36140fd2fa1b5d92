"""Chat formatting in budgeted windows [native].

A conversation becomes one or more windows of at most `budget` tokens, cut between turns. Every
window opens with the conversation's system turn, repeats at most `history_turns` earlier turns
of at most `history` tokens as context, then holds new turns. Prefix sums of the turns' tokens
say how many fit; repeated history gives way to the first new turn. Only assistant texts among the new turns are under the loss mask, so a text
that is repeated as history is masked and each one is trained on once.

The template: `<turn K>role\\ntext</turn>\\n`, K being n (new), h (history), s (system, repeated).
Inside role and text a backslash becomes `\\b` and `<` becomes `\\l` (in a role a line feed `\\n`),
so no text can hold a mark; undoing `\\n`, `\\l` and then `\\b` gives the text back.

Turns are grouped by conversation and EPISODE turn numbers, so one endless conversation is many
groups of bounded size; the last turns of an episode are dealt to the next one too, as history.

Defined cases: null text or role is empty; null turn comes first, as a turn of its own episode; null conv_id is a
conversation; equal (conv_id, turn) rows are kept, in order of role and text, and share a group; a turn that is above the
budget together with the system turn has a window of its own, whole, with over_budget true; empty tables give no windows. A
conversation's system turn is its first row, if its role is system. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import null_safe, table

EPISODE = 256
#: Tokens that a turn's marks and role cost beside its text.
MARKS = 4


def escape(x: str) -> str:
    return rf"replace(replace({x}, '\\', '\\b'), '<', '\\l')"


def unescape(x: str) -> str:
    return rf"replace(replace({x}, '\\l', '<'), '\\b', '\\')"


def escape_role(x: str) -> str:
    return rf"replace({escape(x)}, '\n', '\\n')"


def unescape_role(x: str) -> str:
    return unescape(rf"replace({x}, '\\n', '\n')")


def token_estimate(text: Column) -> Column:
    """Tokens of a text where no count is given: a quarter of its bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def windows(conversations: DataFrame, budget: int = 512, history: int = 128, history_turns: int = 2, tokens: str | None = None) -> DataFrame:
    """conv_id, episode, window, n_new, tokens, over_budget, formatted, loss (array of start, length; code points).

    conversations: conv_id, turn, role, text, and a column of token counts if `tokens` names one.
    """
    c = conversations.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        (F.coalesce(F.col(tokens), F.lit(0)).cast("long") if tokens else token_estimate(F.coalesce("text", F.lit("")))).alias("tok"),
    )
    turn = F.struct("turn", "role", "text", (F.col("tok") + MARKS).alias("tok")).alias("t")
    rows = c.select("conv_id", turn, F.coalesce(F.floor(F.col("turn") / EPISODE), F.lit(-(2**62))).cast("long").alias("ep"))
    first = rows.groupBy(F.col("conv_id").alias("conv_1")).agg(F.min("t").alias("first"))
    late = F.pmod("t.turn", F.lit(EPISODE)) >= EPISODE - history_turns
    dealt = rows.select("conv_id", "t", "ep", F.explode(F.when(late, F.array("ep", F.col("ep") + 1)).otherwise(F.array("ep"))).alias("to"))
    groups = dealt.groupBy("conv_id", "to").agg(
        F.sort_array(F.collect_list(F.when(F.col("ep") == F.col("to"), F.col("t")))).alias("own"),
        F.sort_array(F.collect_list(F.when(F.col("ep") != F.col("to"), F.col("t")))).alias("old"),
    )
    groups = null_safe(groups.where("size(own) > 0"), first, [("conv_id", "conv_1")])
    system = "if(first.role = 'system', array(first), array())"
    groups = groups.selectExpr("conv_id", "to AS episode", f"{system} AS sys", "size(old) AS n_old", "concat(old, own) AS t").selectExpr(
        "*",
        "coalesce(get(sys, 0).tok, 0L) AS sys_tok",
        "aggregate(t, array(0L), (p, x) -> concat(p, array(element_at(p, -1) + x.tok))) AS p",  # p[i]: tokens of the first i turns
    )
    # how many of the turns before place i a window starting there repeats: fewer where turn i needs the room
    fits = f"c <= i AND p[i] - p[greatest(i - c, 0)] <= {history} AND sys_tok + p[least(i + 1, size(t))] - p[greatest(i - c, 0)] <= {budget}"
    back = f"size(filter(sequence(1, {history_turns}), c -> {fits}))" if history_turns else "0"
    groups = groups.selectExpr("*", f"transform(sequence(0, size(t)), i -> {back}) AS back")
    # places where windows start: the next one where the turns since the last start no longer fit
    room = f"({budget} - sys_tok - (p[element_at(s, -1)] - p[element_at(s, -1) - back[element_at(s, -1)]]))"
    starts = f"aggregate(sequence(n_old, size(t) - 1), array(n_old), (s, i) -> if(i > element_at(s, -1) AND p[i + 1] - p[element_at(s, -1)] > {room}, concat(s, array(i)), s))"
    # each window takes its own slice of the turns before rows are made of windows, so rows stay small
    hi = "coalesce(get(s, w + 1), size(t))"
    cut = f"transform(s, (lo, w) -> named_struct('window', w, 'n_new', {hi} - lo, 'h', back[lo], 'x', slice(t, lo - back[lo] + 1, {hi} - lo + back[lo])))"
    wins = groups.selectExpr("*", f"{starts} AS s").selectExpr("conv_id", "episode", "sys", f"explode({cut}) AS w")
    wins = wins.selectExpr("conv_id", "episode", "w.window AS window", "w.n_new AS n_new", "w.h AS h", "w.x AS x", "sys")
    # the system turn is not repeated where the window holds it anyway
    held = "if(size(sys) > 0 AND NOT exists(x, y -> y = get(sys, 0)), sys, filter(sys, y -> false))"
    parts = f"concat(transform({held}, y -> named_struct('k', 's', 't', y)), transform(x, (y, i) -> named_struct('k', if(i < h, 'h', 'n'), 't', y)))"
    head = f"concat('<turn ', x.k, '>', {escape_role('x.t.role')}, '\\n')"
    wins = wins.selectExpr("conv_id", "episode", "window", "n_new", f"transform({parts}, x -> named_struct('head', {head}, 'body', {escape('x.t.text')}, 'target', x.k = 'n' AND x.t.role = 'assistant', 'tok', x.t.tok)) AS parts")
    place = (
        "aggregate(parts, named_struct('at', 0L, 'loss', cast(array() AS array<struct<start:bigint,length:bigint>>)), (a, x) -> named_struct("
        "'at', a.at + length(x.head) + length(x.body) + 8, "
        "'loss', if(x.target, concat(a.loss, array(named_struct('start', a.at + length(x.head), 'length', cast(length(x.body) AS bigint)))), a.loss)), a -> a.loss)"
    )
    return wins.selectExpr(
        "conv_id",
        "episode",
        "window",
        "n_new",
        "aggregate(parts, 0L, (a, x) -> a + x.tok) AS tokens",
        f"aggregate(parts, 0L, (a, x) -> a + x.tok) > {budget} AS over_budget",
        "array_join(transform(parts, x -> concat(x.head, x.body, '</turn>\\n')), '') AS formatted",
        f"{place} AS loss",
    )


def read_back(wins: DataFrame) -> DataFrame:
    """Per window, from its formatted text and loss mask alone: turns array(role, text), targets array of text."""
    pieces = "filter(split(formatted, '</turn>\\n', -1), x -> x LIKE '<turn n>%')"
    body = "substring(x, 9)"
    cut = f"substring_index({body}, '\\n', 1)"
    rest = f"substring({body}, length({cut}) + 2)"
    return wins.selectExpr(
        "*",
        f"transform({pieces}, x -> named_struct('role', {unescape_role(cut)}, 'text', {unescape(rest)})) AS turns",
        f"transform(loss, x -> {unescape('substring(formatted, cast(x.start + 1 AS int), cast(x.length AS int))')}) AS targets",
    )


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.lit("\\### Assistant: </turn> ok")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), marks.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    read = read_back(windows(rows)).selectExpr(
        "conv_id",
        "named_struct('episode', episode, 'window', window, 'turns', array_join(transform(turns, x -> concat(x.role, '\\n', x.text, '\\n')), ''), 'loss', array_join(targets, '')) AS w",
        "size(turns) AS n",
        "length(formatted) AS chars",
    )
    per = read.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.sort_array(F.collect_list("w")).alias("w"))
    whole = per.selectExpr("conv_id", "n_turns", "formatted_chars", "array_join(w.turns, '') AS turns", "array_join(w.loss, '') AS loss")
    return whole.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: The digests straight from the turns; windows by a fold over each conversation's turns.
ORACLE = r"""
WITH RECURSIVE c0 AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
c1 AS (SELECT *, ceil(strlen(text) / 4.0)::BIGINT + 4 AS tok, floor(turn / 256.0)::BIGINT AS ep, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
  9 + length(role) + length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', '')) + 8 AS chars FROM c0),
s AS (SELECT conv_id, tok AS stok, chars AS schars FROM c1 WHERE i = 1 AND role = 'system'),
c AS (SELECT c1.*, coalesce(s.stok, 0) AS stok, coalesce(s.schars, 0) AS schars, lag(tok, 1, 1000000) OVER w AS t1, lag(tok, 2, 1000000) OVER w AS t2, lag(chars, 1, 0) OVER w AS h1, lag(chars, 2, 0) OVER w AS h2,
   turn % 256 AS m, lag(turn) OVER w AS p1, lag(turn, 2) OVER w AS p2
  FROM c1 LEFT JOIN s USING (conv_id) WINDOW w AS (PARTITION BY c1.conv_id ORDER BY i)),
b AS (SELECT *, CASE WHEN t1 > 128 OR stok + tok + t1 > 512 THEN 0 WHEN t1 + t2 > 128 OR stok + tok + t1 + t2 > 512 THEN 1 ELSE 2 END AS back FROM c),
f AS (
  SELECT conv_id, i, ep, tok AS used, 512 - stok - CASE back WHEN 0 THEN 0 WHEN 1 THEN t1 ELSE t1 + t2 END AS room, true AS start FROM b WHERE i = 1
  UNION ALL
  SELECT b.conv_id, b.i, b.ep, CASE WHEN b.ep <> f.ep OR f.used + b.tok > f.room THEN b.tok ELSE f.used + b.tok END,
         CASE WHEN b.ep <> f.ep OR f.used + b.tok > f.room THEN 512 - b.stok - CASE b.back WHEN 0 THEN 0 WHEN 1 THEN b.t1 ELSE b.t1 + b.t2 END ELSE f.room END,
         b.ep <> f.ep OR f.used + b.tok > f.room
  FROM f JOIN b ON b.conv_id = f.conv_id AND b.i = f.i + 1),
g AS (SELECT b.conv_id, sum(b.chars + CASE WHEN NOT f.start THEN 0 ELSE CASE b.back WHEN 0 THEN 0 WHEN 1 THEN b.h1 ELSE b.h1 + b.h2 END + CASE WHEN b.i - b.back > 1 THEN b.schars ELSE 0 END END)::BIGINT AS formatted_chars
  FROM f JOIN b ON b.conv_id = f.conv_id AND b.i = f.i GROUP BY b.conv_id),
d AS (SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss FROM c0 GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM d JOIN g USING (conv_id)
"""
