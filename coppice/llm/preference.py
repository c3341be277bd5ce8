"""Chat formatting for preference pairs: one prompt, two masked completions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.llm.common import maybe_broadcast, stage, table

TRAINED_ROLE = "assistant"
HEAD, BREAK, END = "<|", "|>\n", "<|end|>\n"


def _role() -> Column:
    return F.coalesce(F.col("role"), F.lit("unknown"))


def _segments(turns: DataFrame, part: Column) -> DataFrame:
    head = F.concat(F.lit(HEAD), _role(), F.lit(BREAK))
    body = F.concat(F.coalesce(F.col("text"), F.lit("")), F.lit(END))
    train = (part != "prompt") & (_role() == TRAINED_ROLE)
    return turns.select(
        "pair_id", part.alias("part"), "turn", "role", F.concat(head, body).alias("rendered"),
        F.when(train, F.char_length(head)).otherwise(0).cast("long").alias("train_from"),
        F.when(train, F.char_length(head) + F.char_length(body)).otherwise(0).cast("long").alias("train_to"),
    )


def preference_segments(chosen: DataFrame, rejected: DataFrame, repeats: bool = True) -> DataFrame:
    """pair_id, part (prompt, chosen, rejected), turn, role, rendered, train_from, train_to: a row a turn.

    Both inputs have pair_id, turn, role, text. The prompt is the longest run of leading turns
    on which both agree in role and text, and comes once; the turns after it are the two
    completions. Joined by turn, the segments of a part are its text. Characters train_from to
    train_to of a segment bear loss: those of assistant turns in completions, from the text to
    the end mark; elsewhere both are 0.

    Rows that share a pair and a turn make up one turn and are compared as a set, with counts
    unless repeats is false.
    A null turn comes before all others, null role renders as `unknown`, null text as empty
    (but a null text and an empty one differ). Equal conversations are all prompt. A pair
    with one side only has an empty prompt. Rows with a null pair_id belong to no pair and are
    left out. A very long text is one segment, whole. Other columns are ignored; empty tables
    give no rows.

    Scale: what is shuffled for comparison is a digest a turn, pre-aggregated; a pair with
    very many turns is never gathered. Texts move only where pairs exceed the broadcast bound.
    """
    cols = ["pair_id", "turn", "role", "text"]
    chosen, rejected = (d.select(*cols).withColumn("turn", F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long"))).filter("pair_id is not null") for d in (chosen, rejected))
    marks = [d.select("pair_id", "turn", "role", F.sha2("text", 256).alias("digest"), F.lit(s).alias("side")) for d, s in ((chosen, 1), (rejected, -1))]
    marks = marks if repeats else [m.distinct() for m in marks]
    differ = marks[0].union(marks[1]).groupBy("pair_id", "turn", "role", "digest").agg(F.sum("side").alias("n")).filter("n <> 0")
    first = stage(differ.groupBy("pair_id").agg(F.min("turn").alias("first")))
    first, _ = maybe_broadcast(first)
    after = F.col("turn") >= F.col("first")
    kept = chosen.join(first, "pair_id", "left")
    other = rejected.join(first, "pair_id").filter(after)
    out = _segments(kept, F.when(after, "chosen").otherwise("prompt")).unionByName(_segments(other, F.lit("rejected")))
    return out.withColumn("turn", F.when(F.col("turn") >= 0, F.col("turn")))


#: Turns of a pair that go on one page.
PAGE_TURNS = 64


def preference_pairs(chosen: DataFrame, rejected: DataFrame, page_turns: int = PAGE_TURNS) -> DataFrame:
    """pair_id, page, sub, prompt, chosen, rejected, chosen_spans, rejected_spans: a pair's prompt, once, beside its two completions.

    Inputs and prompt are those of preference_segments, but rows that repeat a pair, a turn, a
    role and a text are one. Spans are (from, to) ranges of characters of the completion that
    bear loss: its assistant turns, each from the text to the end mark. A part that a pair
    lacks is empty. Turns of a part are in order, rows of one turn by role and text.

    A pair of up to 64 turns is one row, page 0. A longer one has a row for each 64 turn
    numbers, and its texts are the pages' texts one after the other; so no conversation, however
    many rows it has, is gathered whole. A turn with more than 64 different rows has pages of
    its own (sub from 1) behind those of its block of turns.
    """
    segments = preference_segments(chosen, rejected, repeats=False)
    at = F.coalesce("turn", F.lit(-1).cast("long"))
    rows = segments.select("pair_id", "part", at.alias("at"), F.floor(F.greatest(at, F.lit(0)) / page_turns).alias("page"), "rendered", "train_from", "train_to", _role().alias("role"))
    # how many different rows a turn has at most, by digests
    marks = [d.select("pair_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long")).alias("at"), "role", F.sha2("text", 256).alias("digest")).filter("pair_id is not null").distinct() for d in (chosen, rejected)]
    many = marks[0].unionByName(marks[1]).groupBy("pair_id", "at").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * page_turns)
    many, _ = maybe_broadcast(stage(many))
    split = F.pmod(F.xxhash64("role", "rendered"), F.ceil(F.col("n") / page_turns))
    rows = rows.join(many, ["pair_id", "at"], "left")
    sub = F.when(F.col("n").isNotNull(), 1 + F.pmod(F.greatest("at", F.lit(0)), F.lit(page_turns)) * F.lit(1 << 32) + split).otherwise(0)
    entry = F.struct("at", "role", "rendered", "train_from", "train_to")
    parts = [F.array_sort(F.collect_set(F.when(F.col("part") == p, entry))).alias(p) for p in ("prompt", "chosen", "rejected")]  # at most a page's turns
    pages = rows.groupBy("pair_id", "page", sub.cast("long").alias("sub")).agg(*parts)
    return pages.select("pair_id", "page", "sub", *[_text(p).alias(p) for p in ("prompt", "chosen", "rejected")], _spans("chosen").alias("chosen_spans"), _spans("rejected").alias("rejected_spans"))


def _text(part: str) -> Column:
    return F.array_join(F.transform(part, lambda x: x["rendered"]), "")


def _spans(part: str) -> Column:
    """Ranges that bear loss, from the start of the joined text."""
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    span = lambda s, x: F.struct((s["at"] + x["train_from"]).alias("from"), (s["at"] + x["train_to"]).alias("to"))
    step = lambda s, x: F.struct(
        (s["at"] + F.char_length(x["rendered"])).alias("at"), F.when(x["train_to"] > 0, F.concat(s["spans"], F.array(span(s, x)))).otherwise(s["spans"]).alias("spans"))
    return F.aggregate(part, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda s: s["spans"])


def next_ids(ids: DataFrame) -> DataFrame:
    """pair_id, after: each distinct non-null id but the last with the next larger one. Ids are dealt by range and numbered by their part, so no task sees them all."""
    parts = stage(ids.select("pair_id").filter("pair_id is not null").distinct().repartitionByRange("pair_id").select("pair_id", F.spark_partition_id().alias("part")))
    inside = parts.withColumn("after", F.lead("pair_id").over(Window.partitionBy("part").orderBy("pair_id")))
    starts = parts.groupBy("part").agg(F.min("pair_id").alias("least"))
    beyond = starts.select("part", F.lead("least").over(Window.orderBy("part")).alias("beyond"))  # a row a part
    return inside.join(beyond, "part").select("pair_id", F.coalesce("after", "beyond").alias("after")).filter("after is not null")


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Rejected conversations: each last assistant reply gives way to that of the next conversation that has one, in the order of ids.

    Where there is none, the conversation ends before the reply. Conversations without an
    assistant turn stay as they are. Where the reply is several rows, all of them make way for
    all rows of the other reply.
    """
    last = stage(turns.filter((F.col("role") == TRAINED_ROLE) & F.col("pair_id").isNotNull()).groupBy("pair_id").agg(F.max("turn").alias("last")))
    ends, _ = maybe_broadcast(last)
    marked = turns.join(ends, "pair_id", "left")
    at_end = F.coalesce((F.col("role") == TRAINED_ROLE) & F.col("turn").eqNullSafe(F.col("last")) & F.col("last").isNotNull(), F.lit(False))
    slots = next_ids(last).join(last, "pair_id").select(F.col("after").alias("pair_id"), F.col("pair_id").alias("to_pair"), F.col("last").alias("to_turn"))
    slots, _ = maybe_broadcast(stage(slots))  # a row a conversation
    replies = marked.filter(at_end).join(slots, "pair_id").select(F.col("to_pair").alias("pair_id"), F.col("to_turn").alias("turn"), "role", "text")
    return marked.filter(~at_end).select("pair_id", "turn", "role", "text").union(replies)


def _mask(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws("-", x["from"].cast("string"), x["to"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    pairs = preference_pairs(turns, swapped_replies(turns))
    return pairs.select("pair_id", "page", "sub", "prompt", "chosen", "rejected", _mask("chosen_spans").alias("chosen_mask"), _mask("rejected_spans").alias("rejected_mask"))


_PART = "coalesce(string_agg(rendered, '' ORDER BY turn, role, rendered) FILTER (WHERE part = '{0}'), '') AS {0}"
_SPANS = "coalesce(string_agg((start_at + head) || '-' || (start_at + length(rendered)), ',' ORDER BY turn, role, rendered) FILTER (WHERE part = '{0}' AND role = '" + TRAINED_ROLE + "'), '') AS {0}_mask"
#: Turns of the table are numbers and no turn has more than 64 rows, so every sub is 0.
SQL = f"""
WITH t AS (SELECT DISTINCT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT pair_id, max(turn) AS last, lead(pair_id) OVER (ORDER BY pair_id) AS after FROM t WHERE role = '{TRAINED_ROLE}' GROUP BY pair_id),
m AS (SELECT t.*, last, after, coalesce(role = '{TRAINED_ROLE}' AND turn = last, false) AS at_end FROM t LEFT JOIN last USING (pair_id)),
r AS (
  SELECT pair_id, turn, role, text FROM m WHERE NOT at_end
  UNION SELECT a.pair_id, a.last, b.role, b.text FROM last a JOIN m b ON a.after = b.pair_id AND b.at_end),
differ AS (
  SELECT pair_id, turn FROM (SELECT *, 1 AS s FROM t UNION ALL SELECT *, -1 AS s FROM r)
  GROUP BY pair_id, turn, role, text HAVING sum(s) <> 0),
f AS (SELECT pair_id, min(turn) AS first FROM differ GROUP BY pair_id),
seg AS (
  SELECT t.*, CASE WHEN turn >= first THEN 'chosen' ELSE 'prompt' END AS part FROM t LEFT JOIN f USING (pair_id)
  UNION ALL
  SELECT r.*, 'rejected' AS part FROM r JOIN f USING (pair_id) WHERE turn >= first),
rows AS (
  SELECT DISTINCT pair_id, turn // {PAGE_TURNS} AS page, part, turn, coalesce(role, 'unknown') AS role, length(coalesce(role, 'unknown')) + 5 AS head,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered FROM seg),
placed AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, page, part ORDER BY turn, role, rendered ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at FROM rows)
SELECT pair_id, page, 0::BIGINT AS sub, {_PART.format("prompt")}, {_PART.format("chosen")}, {_PART.format("rejected")}, {_SPANS.format("chosen")}, {_SPANS.format("rejected")}
FROM placed GROUP BY pair_id, page
"""
