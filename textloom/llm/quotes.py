"""Quotation linking of chat messages.

Lines of a message carry a quote level (leading `>`). Runs of lines of one level are
passages; their normalised words are hashed and joined to the messages that wrote them:
as a whole message, as a line, or, from ANCHOR words on, as any run of words, whatever
the line breaks. Runs of words are found by anchors: the first ANCHOR words of a passage
are hashed and joined to all windows of ANCHOR words of the messages, and only there the
run of the passage's length is hashed. The original is looked for in the same
conversation before the quoting turn, else anywhere, the earliest first. A message
replies to the latest message of its conversation that it quotes, else to the turn
before. Conversations come out in reply order (after the message replied to, then by
turn) and without quotes.

Originals are summed to one row a hash (and conversation) before the join, so a common
passage meets one row; passages quoted very often meet it by a broadcast of at most
1 / HOT_SHARE rows, apart from the others. Neighbours and positions are found in blocks of
turns, and blocks of the replies to one turn, so one huge conversation, or one turn that
everybody answers, is spread over tasks.

Defined cases: null text is empty; null ids or turns form a conversation or turn of
their own that nothing links to; repeated rows are kept, each with its own position
(ties by role and text); a message that only quotes becomes empty; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Turns of a block; words of an anchor; share, and least number, of the passages that makes one common.
BLOCK, ANCHOR, HOT_SHARE, HOT = 1024, 4, 1e-3, 1000
_PREFIX = r"^((?:[ \t]*>)+)[ \t]?"
_ATTRIBUTION = r"(?i)^[ \t]*on .+ wrote:[ \t]*$"


def _normal(text: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _PREFIX, 1), "[^>]", ""))


def parse(messages: DataFrame) -> DataFrame:
    """The messages with `clean` (without quotes) and `lines` (quoted lines with place and level)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", text.alias("text"))
    split = base.withColumn("all", F.split("text", "\n"))
    plain = F.filter("all", lambda x: (_level(x) == 0) & ~x.rlike(_ATTRIBUTION))
    quoted = F.filter(F.transform("all", lambda x, i: F.struct(i.alias("place"), _level(x).alias("level"), F.regexp_replace(x, _PREFIX, "").alias("body"))), lambda q: q["level"] > 0)
    clean = F.when(F.col("text").contains(">") | F.col("text").rlike(r"(?im)^[ \t]*on .+ wrote:"), F.btrim(F.array_join(plain, "\n"), F.lit(common.WS))).otherwise(F.col("text"))
    return split.select("conv_id", "turn", "role", "text", clean.alias("clean"), F.when(F.col("text").contains(">"), quoted).otherwise(F.array()).alias("lines"))


def passages(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, level, hash, words (their number), anchor: quoted passages that hold a
    letter or digit."""
    lines = parsed.where(F.size("lines") > 0).select("conv_id", "turn", F.md5(F.concat_ws("\x01", "role", "text")).alias("row"), F.explode("lines").alias("q")).select("conv_id", "turn", "row", "q.*")
    own = W.partitionBy("conv_id", "turn", "row", "level").orderBy("place")
    runs = lines.distinct().withColumn("run", F.col("place") - F.row_number().over(own))
    body = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("place", "body"))), lambda x: x["body"]))
    found = runs.groupBy("conv_id", "turn", "row", "level", "run").agg(_normal(body).alias("normal"))
    words = F.split("normal", " ")
    return found.where("normal <> ''").select("conv_id", "turn", "level", F.md5("normal").alias("hash"), F.size(words).alias("words"), F.xxhash64(F.slice(words, 1, ANCHOR)).alias("anchor"))


def quoted_runs(parsed: DataFrame, quotes: DataFrame) -> DataFrame:
    """conv_id, turn, hash: runs of words of the messages that have the anchor and the
    length of a quoted passage."""
    wanted = quotes.where(F.col("words") >= ANCHOR).select("anchor", "words").distinct()
    words = F.split(_normal(F.col("clean")), " ")
    texts = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.md5("clean").alias("text"), words.alias("own")).where(F.size("own") >= ANCHOR)
    anchors = F.transform(F.sequence(F.lit(1), F.size("own") - (ANCHOR - 1)), lambda i: F.xxhash64(F.slice("own", i, ANCHOR)))
    windows = texts.select("conv_id", "turn", "text", F.posexplode(anchors).alias("at", "anchor"))
    hits = windows.join(wanted, "anchor").groupBy("conv_id", "turn", "text").agg(F.collect_set(F.struct("at", "words")).alias("hits"))  # one message
    runs = F.transform("hits", lambda h: F.md5(F.array_join(F.slice("own", h["at"] + 1, h["words"]), " ")))
    return texts.join(hits, ["conv_id", "turn", "text"]).select("conv_id", "turn", F.explode(F.array_distinct(runs)).alias("hash"))


def _anywhere(quotes: DataFrame, first: DataFrame) -> DataFrame:
    """`quotes` with o, the earliest message that wrote the passage."""
    earliest = first.groupBy("hash").agg(F.min(F.struct("conv_id", "o_turn")).alias("o"))
    number = quotes.count()
    common_ = quotes.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > max(HOT, int(number * HOT_SHARE))).select("hash")
    hot = F.broadcast(common_.join(earliest, "hash", "left"))  # at most 1 / HOT_SHARE rows
    often = quotes.join(hot, "hash")
    seldom = quotes.join(F.broadcast(common_), "hash", "left_anti").join(earliest, "hash", "left")
    return often.unionByName(seldom)


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, n_linked, reply_to (-1: a
    first message) and position in the conversation of every message."""
    parsed = parse(messages)
    quotes = common.materialize(passages(parsed), "quotes")
    written = parsed.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(F.array("clean"), F.split("clean", "\n")))).alias("t")).select("conv_id", "turn", _normal(F.col("t")).alias("t")).where("t <> '' and conv_id is not null and turn is not null")
    written = written.select("conv_id", "turn", F.md5("t").alias("hash")).unionByName(quoted_runs(parsed, quotes))
    written = written.join(quotes.select("hash").distinct(), "hash", "left_semi")
    first = common.materialize(written.groupBy("hash", "conv_id").agg(F.min("turn").alias("o_turn")), "quote-originals")
    linked = _anywhere(quotes, first).join(first, ["hash", "conv_id"], "left")
    inside = F.when(F.col("o_turn") < F.col("turn"), F.col("o_turn"))
    outside = F.when(F.col("o.conv_id") != F.col("conv_id"), F.col("o.o_turn"))
    by_message = linked.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count(F.coalesce(inside, outside)).alias("n_linked"), F.max(inside).alias("quoted"))
    rows = parsed.withColumnRenamed("text", "raw").select("conv_id", "turn", "role", F.col("clean").alias("text"), F.floor(F.col("turn") / BLOCK).alias("b"), F.md5(F.concat_ws("\x01", "role", "raw")).alias("tie"))
    # the turn before, by blocks of turns
    turns = rows.select("conv_id", "turn", "b").where("turn is not null").distinct()
    blocks = turns.groupBy("conv_id", "b").agg(F.max("turn").alias("top"))
    earlier = blocks.select("conv_id", "b", F.max("top").over(W.partitionBy("conv_id").orderBy("b").rowsBetween(W.unboundedPreceding, -1)).alias("above"))
    before = turns.withColumn("near", F.lag("turn").over(W.partitionBy("conv_id", "b").orderBy("turn"))).join(earlier, ["conv_id", "b"], "left")
    before = before.select("conv_id", "turn", F.coalesce("near", "above").alias("previous"))
    rows = rows.join(before, ["conv_id", "turn"], "left").join(by_message, ["conv_id", "turn"], "left").withColumn("reply_to", F.coalesce("quoted", "previous"))
    # position by (reply_to, turn, tie): blocks of reply_to, and in them blocks of the
    # replies to one turn (by tie, where they have no turn)
    rows = rows.withColumn("c", F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))).withColumn("p", F.coalesce("reply_to", F.lit(-1))).withColumn("pb", F.floor(F.col("p") / BLOCK))
    rows = rows.withColumn("tb", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62)))).withColumn("x", F.when(F.col("turn").isNull(), F.substring("tie", 1, 2)).otherwise(""))
    sizes = rows.groupBy("c", "pb", "p", "tb", "x").agg(F.count("*").alias("n"))
    large = sizes.groupBy("c", "pb").agg(F.sum("n").alias("n"))
    large = large.select("c", "pb", F.coalesce(F.sum("n").over(W.partitionBy("c").orderBy("pb").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    small = sizes.select("c", "pb", "p", "tb", "x", F.coalesce(F.sum("n").over(W.partitionBy("c", "pb").orderBy("p", "tb", "x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("inside"))
    offsets = small.join(large, ["c", "pb"]).select("c", "p", "tb", "x", (F.col("before") + F.col("inside")).alias("before"))
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("c", "p", "tb", "x").orderBy("turn", "tie"))).join(offsets, ["c", "p", "tb", "x"])
    return rows.select("conv_id", "turn", "role", "text", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("reply_to", F.lit(-1)).cast("long").alias("reply_to"), (F.col("before") + F.col("k")).cast("long").alias("position"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and reply order of all messages. Null texts are empty; rows without a
    conversation or turn are kept and linked with nothing; repeated rows have positions of
    their own; an empty table gives an empty result; other columns are not read."""
    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_NORMAL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"
OP9_SQL = rf"""
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT conv_id, turn, role, text, i, x, length(regexp_replace(regexp_extract(x, '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level
      FROM (SELECT *, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM m)),
c AS (SELECT conv_id, turn, role, text, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (level = 0 AND NOT regexp_matches(x, '(?i)^[ \t]*on .+ wrote:[ \t]*$')), '') AS plain,
      max(level) > 0 OR bool_or(regexp_matches(x, '(?i)^[ \t]*on .+ wrote:')) AS cut FROM l GROUP BY ALL),
k AS (SELECT conv_id, turn, role, text AS raw, CASE WHEN cut OR contains(text, '>') THEN trim(plain, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ') ELSE text END AS text FROM c),
q AS (SELECT conv_id, turn, level, md5({_NORMAL.format("string_agg(regexp_replace(x, '^((?:[ \t]*>)+)[ \t]?', ''), ' ' ORDER BY i)")}) AS hash, {_NORMAL.format("string_agg(regexp_replace(x, '^((?:[ \t]*>)+)[ \t]?', ''), ' ' ORDER BY i)")} AS normal
      FROM (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, role, text, level ORDER BY i) AS run FROM l WHERE level > 0) GROUP BY conv_id, turn, role, text, level, run),
w AS (SELECT DISTINCT conv_id, turn, md5({_NORMAL.format("t")}) AS hash FROM (SELECT conv_id, turn, unnest(list_append(string_split(text, chr(10)), text)) AS t FROM k) WHERE {_NORMAL.format("t")} <> ''),
v AS (SELECT conv_id, turn, hash FROM (SELECT conv_id, turn, {_NORMAL.format("text")} AS n FROM k) JOIN (SELECT DISTINCT hash, normal FROM q WHERE len(string_split(normal, ' ')) >= 4) ON contains(' ' || n || ' ', ' ' || normal || ' ')),
f AS (SELECT hash, conv_id, min(turn) AS o_turn FROM (SELECT * FROM w UNION ALL SELECT * FROM v) GROUP BY hash, conv_id),
a AS (SELECT hash, min({{'c': conv_id, 't': o_turn}}) AS o FROM f GROUP BY hash),
j AS (SELECT q.conv_id, q.turn, CASE WHEN f.o_turn < q.turn THEN f.o_turn END AS inside, CASE WHEN a.o.c <> q.conv_id THEN a.o.t END AS outside
      FROM q LEFT JOIN f ON f.hash = q.hash AND f.conv_id = q.conv_id LEFT JOIN a ON a.hash = q.hash WHERE normal <> ''),
b AS (SELECT conv_id, turn, count(*) AS n_quotes, count(coalesce(inside, outside)) AS n_linked, max(inside) AS quoted FROM j GROUP BY conv_id, turn),
p AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (SELECT DISTINCT conv_id, turn FROM m)),
r AS (SELECT k.*, n_quotes, n_linked, coalesce(quoted, previous) AS reply_to FROM k JOIN p USING (conv_id, turn) LEFT JOIN b USING (conv_id, turn))
SELECT conv_id, turn, role, text, coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked, coalesce(reply_to, -1) AS reply_to,
       row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(reply_to, -1), turn, md5(concat_ws(chr(1), role, raw))) AS position FROM r"""
