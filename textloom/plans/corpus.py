"""Corpus queries: scan, crop, budget, split, shards, packing and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import packing, select, tokens
from textloom.operators.evaluation import byte_table
from textloom.session import shared_folder
from textloom.sources import readers, sinks


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tok_compression_by_lang(spark, sf_dir, cap: int = 10_000, budget: int = 2_000_000_000):
    docs = select.char_budget(select.crop(_table(spark, sf_dir, "documents"), cap), budget)
    per = docs.select("lang", F.octet_length("text").cast("long").alias("b"), F.length("text").cast("long").alias("c"))
    grouped = per.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("c").alias("chars"), F.sum("b").alias("bytes"), F.sum(F.col("b") + 1).alias("tokens"))
    return grouped.select("lang", "docs", "chars", "bytes", "tokens", F.round(F.col("bytes") / F.col("tokens"), 6).alias("ratio"))


def _files(spark, sf_dir):
    """Documents as shards of 100 rows each."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", F.format_string("shard_%05d.parquet", F.floor(F.col("doc_id") / 100)).alias("file"), (F.col("doc_id") % 100).alias("row"))


def shard_listing(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("file").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


def split_counts(spark, sf_dir):
    files = _files(spark, sf_dir)
    parts = [readers.split_shards(files, s).select(F.lit(s).alias("split"), F.pmod(F.floor(F.col("row") / 10), F.lit(4)).alias("rank"), "text") for s in ("train", "val")]
    return parts[0].unionByName(parts[1]).groupBy("split", "rank").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


def stripe_scan(spark, sf_dir):
    """Rank 1 of 3 over row groups of 16, two passes, resumed after a position."""
    rows = readers.epochs(readers.stripe_groups(_files(spark, sf_dir), 1, 3, 16), 2)
    left = readers.resume(rows, "shard_00003.parquet", 1, 1)
    return left.groupBy("epoch", "file", "group").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


def shard_assignment(spark, sf_dir):
    plan = sinks.shard_plan(_table(spark, sf_dir, "documents"), 200_000, 32)
    return plan.groupBy("shard", "full").agg(F.count("*").alias("groups"), F.sum("chars").alias("chars"), F.sum("n").alias("docs"))


def shard_files(spark, sf_dir):
    """Full shards written as files and scanned again, with the positions the files have."""
    path = f"{shared_folder(spark)}/textloom-shards-{uuid.uuid4().hex}"
    sinks.write_shards(_table(spark, sf_dir, "documents"), path, 200_000, 32)
    rows = readers.shards(spark, path, "shard")
    return rows.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.countDistinct("file").alias("files"), F.count("*").alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"), F.max("row").alias("last"), F.md5(F.max_by("text", -F.col("row"))).alias("head"))


def shuffle_order(spark, sf_dir):
    return select.shuffled(_table(spark, sf_dir, "documents").select("doc_id"), 42, "doc_id")


def task_slice(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "idx")
    rows = select.slice_view(items, 3, 35, 4)
    return rows.select(((F.col("idx") - 3) / 4).cast("long").alias("i"), "idx", F.pmod("idx", F.lit(3)).alias("rank"), F.floor(F.col("idx") / 8).cast("long").alias("batch"), F.length("text").alias("chars"))


def limit_per_source(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return select.first_k(docs.where("lang = 'de'"), 20, "doc_id").select("doc_id", "n_chars")


def byte_stats(spark, sf_dir):
    rows = byte_table()(spark).where("n_bytes > 0")
    return rows.agg(F.min("n_bytes").alias("lo"), F.max("n_bytes").alias("hi"), F.avg("n_bytes").alias("mean"), F.round(F.stddev_samp("n_bytes"), 9).alias("sd"), F.count("*").alias("n"))


def special_lookup(spark, sf_dir):
    ids = tokens.special_ids(spark)
    vocab = spark.range(265).select(F.col("id").cast("int").alias("token_id"))
    semi = vocab.join(F.broadcast(ids), "token_id", "left_semi").agg(F.count("*").alias("specials"))
    anti = vocab.join(F.broadcast(ids), "token_id", "left_anti").agg(F.count("*").alias("ordinary"))
    bos = ids.where("token = '<|bos|>'").agg(F.max("token_id").alias("bos"))
    return semi.crossJoin(anti).crossJoin(bos)


def byte_encode(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", T.byte_ids(F.col("text"), 256).alias("ids"))
    return rows.select("doc_id", F.size("ids").alias("n"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("digest"))


def conv_violations(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    broken = turns.withColumn("role", F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 2), "user").otherwise(F.col("role"))).withColumn("text", F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), " \n").otherwise(F.col("text")))
    return tokens.violations(broken)


def conv_render(spark, sf_dir):
    rows = tokens.render(_table(spark, sf_dir, "conversations"), 2048)
    learned = F.aggregate("mask", F.lit(0), lambda a, x: a + x)
    return rows.select("conv_id", F.size("ids").alias("n"), learned.alias("learned"), F.get("ids", F.lit(0)).alias("head"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("digest"))


def conv_completion(spark, sf_dir):
    rows = tokens.render_for_completion(_table(spark, sf_dir, "conversations"), 4096)
    return rows.select("conv_id", F.size("ids").alias("n"), F.element_at("ids", -1).alias("last"))


def conv_web(spark, sf_dir):
    rows = tokens.render_web(_table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", F.size("ids").alias("n"))


def conv_targets(spark, sf_dir):
    rows = tokens.with_targets(tokens.render(_table(spark, sf_dir, "conversations"), 513), 512)
    return rows.select("conv_id", F.size("inputs").alias("n_inputs"), F.size("targets").alias("n_targets"), F.size(F.filter("targets", lambda t: t >= 0)).alias("n_learned"))


def pack_bestfit(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.octet_length("text") + 1).alias("length"))
    return packing.pack(docs, 2049, packing.stripes_for(docs, 4))


def pack_pad(spark, sf_dir):
    turns = tokens.render(_table(spark, sf_dir, "conversations"), 4097)
    items = turns.select(F.col("conv_id").alias("id"), F.size("ids").alias("length"))
    return packing.pack(items, 4097, packing.stripes_for(items, 2), "bestfit_pad", 100)


def pack_statistics(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.octet_length("text") + 1).alias("length"))
    rows, stripes = None, packing.stripes_for(docs, 4)
    for s in packing.STRATEGIES:
        one = packing.statistics(packing.pack(docs, 2049, stripes, s), 2049).withColumn("strategy", F.lit(s))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("strategy", "rows", *[F.round(c, 9).alias(c) for c in ("utilisation", "cropped", "padded")])


def bos_positions(spark, sf_dir):
    """Each document as two sequences, of one half of the text each."""
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.concat(T.byte_ids(F.substr("text", F.lit(1), half), 256), T.byte_ids(F.substr("text", half + 1), 256))
    rows = packing.boundaries(_table(spark, sf_dir, "documents").select("doc_id", parts.alias("tokens")), 256)
    return rows.select("doc_id", F.array_join(F.transform("starts", lambda x: x.cast("string")), ",").alias("starts"))


def token_lookup(spark, sf_dir):
    """Byte ids looked up in a vocabulary of hexadecimal names, and shown with a mask."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", T.byte_ids(F.col("text")).alias("ids"))
    vocab = spark.range(256).select(F.col("id").cast("int").alias("token_id"), F.lower(F.lpad(F.hex("id"), 2, "0")).alias("token"))
    rows = tokens.lookup(docs, vocab)
    mask = F.transform("tokens", lambda t, i: (i % 2).cast("int"))
    return rows.select("doc_id", F.md5(F.array_join("tokens", "")).alias("hex"), F.length(tokens.visualize(F.col("tokens"), mask)).alias("shown"))


def environment(spark, sf_dir):
    return readers.environment(spark)


def bpe_vocab(spark, sf_dir):
    merges = tokens.train(_table(spark, sf_dir, "documents"), 200)
    return spark.createDataFrame([(i, t.hex(), len(t)) for i, t in enumerate(tokens.vocabulary(merges))], "token_id int, bytes string, n int")


def bpe_round_trip(spark, sf_dir):
    """Documents whose decoded tokens differ from the text: none."""
    docs = _table(spark, sf_dir, "documents")
    merges = tokens.train(docs, 200)
    back = tokens.decode(tokens.encode(docs, merges), merges).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").where(~F.col("text").eqNullSafe(F.col("back"))).select("doc_id")


def bpe_compression(spark, sf_dir):
    """Bytes a token by language: a vocabulary trained here beside public ones."""
    import public_tokenizers as P

    docs = _table(spark, sf_dir, "documents")
    encoders = {"own": tokens.piece_counter(tokens.train(docs, 200))}
    encoders |= {name: tokens.rank_counter(P.path(f"{name}.tiktoken"), P.PATTERN) for name in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    return tokens.side_by_side(docs, "lang", encoders)


_SHARDS = """WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, length(text) AS c FROM documents),
g AS (SELECT pos // 32 AS g, sum(c)::BIGINT AS chars, count(*)::BIGINT AS n FROM o GROUP BY 1),
s AS (SELECT g, chars, n, 0::BIGINT AS shard, chars AS acc FROM g WHERE g = 0
 UNION ALL SELECT g.g, g.chars, g.n, CASE WHEN s.n = 32 AND s.acc >= 200000 THEN s.shard + 1 ELSE s.shard END, CASE WHEN s.n = 32 AND s.acc >= 200000 THEN g.chars ELSE s.acc + g.chars END FROM s JOIN g ON g.g = s.g + 1),
c AS (SELECT count(*) AS closed FROM s WHERE n = 32 AND acc >= 200000)"""
_W = "ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
_MERGED = """n AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS pr, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS pt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM {src}),
r AS (SELECT conv_id, turn, role, CASE WHEN k = 2 AND pr = 'system' THEN pt || chr(10) || chr(10) || text ELSE text END AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM n WHERE NOT (k = 1 AND role = 'system'))"""
_BYTES = "list_transform(range(0, strlen({0})), lambda j: ('0x' || substr(hex(encode({0})), 2 * j + 1, 2))::INT)"
_IDS = f"""ids AS (SELECT conv_id, i, CASE WHEN role = 'user' THEN list_concat([257], {_BYTES.format('text')}, [258]) ELSE list_concat([259], {_BYTES.format('text')}, [260]) END AS ids, role = 'user' AS u FROM r)"""



def best_fit(items: str, capacity: int, buffer: int, least: int, crop: bool) -> str:
    """Best-fit packing of `items` (id, length), one placement a step of a recursion."""
    cut = "coalesce(fit, short)" if crop else "fit"
    return f"""
WITH RECURSIVE {items},
s AS (SELECT *, id % (SELECT greatest({least}, ceil(count(*) / {packing.STRIPE_ITEMS}))::BIGINT FROM i) AS stripe FROM i),
a AS (SELECT stripe, list({{'n': length::BIGINT, 'k': k, 'id': id}} ORDER BY k) AS items FROM (SELECT *, row_number() OVER (PARTITION BY stripe ORDER BY id) AS k FROM s{"" if crop else f" WHERE length <= {capacity}"}) GROUP BY stripe),
r AS (SELECT stripe, items[:{buffer}] AS buffer, {buffer + 1}::BIGINT AS nxt, 0::BIGINT AS row, 0::BIGINT AS slot, 0::BIGINT AS pos, -9::BIGINT AS o_row, 0::BIGINT AS o_slot, 0::BIGINT AS o_start, NULL::BIGINT AS id, 0::BIGINT AS taken, 0::BIGINT AS dropped FROM a
 UNION ALL SELECT stripe, CASE WHEN c IS NULL THEN buffer ELSE list_concat(list_filter(buffer, lambda x: x.k <> c.k), items[nxt:nxt]) END, CASE WHEN c IS NULL THEN nxt ELSE nxt + 1 END,
  CASE WHEN c IS NULL OR pos + took = {capacity} THEN row + 1 ELSE row END, CASE WHEN c IS NULL OR pos + took = {capacity} THEN 0 ELSE slot + 1 END, CASE WHEN c IS NULL OR pos + took = {capacity} THEN 0 ELSE pos + took END,
  row, slot, pos, c.id, took, abs(c.n) - took
 FROM (SELECT *, least(abs(c.n), {capacity} - pos) AS took FROM (SELECT *, {cut} AS c FROM (SELECT r.*, items, list_sort(list_transform(list_filter(buffer, lambda x: x.n <= {capacity} - pos), lambda x: {{'n': -x.n, 'k': x.k, 'id': x.id}}))[1] AS fit, list_sort(buffer)[1] AS short FROM r JOIN a USING (stripe) WHERE len(buffer) > 0))))
SELECT stripe::BIGINT AS stripe, CASE WHEN o_row = last THEN -2 ELSE o_row END::BIGINT AS row, o_slot::INT AS slot, o_start::INT AS start, id, taken::INT AS taken, dropped::INT AS dropped
FROM (SELECT *, max(row) OVER (PARTITION BY stripe) AS last FROM r) WHERE id IS NOT NULL"""


def _in_order(capacity: int, crop: bool) -> str:
    """Greedy packing of a (stripe, items), one item a step; the placements are g."""
    at = "pos" if crop else f"CASE WHEN pos > 0 AND pos + items[k].n > {capacity} THEN 0 ELSE pos END"
    row = "row" if crop else f"CASE WHEN pos > 0 AND pos + items[k].n > {capacity} THEN row + 1 ELSE row END"
    return f"""g AS (SELECT stripe, 1::BIGINT AS k, 0::BIGINT AS row, 0::BIGINT AS pos, -1::BIGINT AS o_row, 0::BIGINT AS taken, 0::BIGINT AS dropped FROM a
 UNION ALL SELECT stripe, k + 1, CASE WHEN p + took = {capacity} THEN w + 1 ELSE w END, CASE WHEN p + took = {capacity} THEN 0 ELSE p + took END, w, took, n - took
 FROM (SELECT *, least(n, {capacity} - p) AS took FROM (SELECT stripe, k, items[k].n AS n, {at} AS p, {row} AS w FROM g JOIN a USING (stripe) WHERE k <= len(items))))"""


def _decreasing(capacity: int) -> str:
    """First-fit-decreasing packing of a (stripe, items), one item a step; the placements are g."""
    return f"""g AS (SELECT stripe, 1::BIGINT AS k, []::BIGINT[] AS room, -1::BIGINT AS o_row, 0::BIGINT AS taken, 0::BIGINT AS dropped FROM a
 UNION ALL SELECT stripe, k + 1, CASE WHEN f > 0 THEN list_transform(range(1, len(room) + 1), lambda j: CASE WHEN j = f THEN room[j] - took ELSE room[j] END) ELSE list_append(room, {capacity} - took) END, CASE WHEN f > 0 THEN f - 1 ELSE len(room) END, took, n - took
 FROM (SELECT *, coalesce(list_position(list_transform(room, lambda x: x >= took), true), 0) AS f FROM (SELECT stripe, k, room, d[k].n AS n, least(d[k].n, {capacity}) AS took FROM g JOIN (SELECT stripe, list_sort(list_transform(items, lambda x: {{'m': -x.n, 'id': x.id, 'n': x.n}})) AS d FROM a) USING (stripe) WHERE k <= len(d))))"""


def _statistics(name: str, capacity: int, placed: str) -> str:
    return f"""SELECT '{name}' AS strategy, r AS rows, round(t / (r * {capacity}), 9)::DOUBLE AS utilisation, round(d / (t + d), 9)::DOUBLE AS cropped, round(1 - t / (r * {capacity}), 9)::DOUBLE AS padded
FROM (SELECT count(DISTINCT (stripe, row)) AS r, sum(taken) AS t, sum(dropped) AS d FROM ({placed}) WHERE row >= 0)"""


_LENGTHS = "i AS (SELECT doc_id AS id, strlen(text) + 1 AS length FROM documents)"
_STRIPED = f"""{_LENGTHS}, s AS (SELECT *, id % (SELECT greatest(4, ceil(count(*) / {packing.STRIPE_ITEMS}))::BIGINT FROM i) AS stripe FROM i),
a AS (SELECT stripe, list({{'n': length::BIGINT, 'id': id}} ORDER BY id) AS items FROM s GROUP BY stripe)"""
_PACKINGS = " UNION ALL ".join(
    f"({_statistics(name, 2049, placed)})"
    for name, placed in {
        "bestfit_crop": best_fit(_LENGTHS, 2049, 1000, 4, True),
        "bestfit_pad": best_fit(_LENGTHS, 2049, 1000, 4, False),
        "greedy_crop": f"WITH RECURSIVE {_STRIPED}, {_in_order(2049, True)} SELECT stripe, o_row AS row, taken, dropped FROM g",
        "greedy_pad": f"WITH RECURSIVE {_STRIPED}, {_in_order(2049, False)} SELECT stripe, o_row AS row, taken, dropped FROM g",
        "ffd": f"WITH RECURSIVE {_STRIPED}, {_decreasing(2049)} SELECT stripe, o_row AS row, taken, dropped FROM g",
    }.items()
)

QUERIES = {
    "tok_compression_by_lang": (
        tok_compression_by_lang,
        """
WITH c AS (SELECT doc_id, lang, substring(text, 1, 10000) AS text FROM documents),
b AS (SELECT *, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT lang, count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes,
       (sum(strlen(text)) + count(*))::BIGINT AS tokens, round(sum(strlen(text)) / (sum(strlen(text)) + count(*)), 6)::DOUBLE AS ratio
FROM b WHERE before <= 2000000000 GROUP BY lang""",
    ),
    "shard_listing": (shard_listing, "SELECT printf('shard_%05d.parquet', doc_id // 100) AS file, count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1"),
    "split_counts": (
        split_counts,
        """SELECT CASE WHEN doc_id // 100 = (SELECT max(doc_id) // 100 FROM documents) THEN 'val' ELSE 'train' END AS split, ((doc_id % 100 // 10) % 4)::BIGINT AS rank,
count(*)::BIGINT AS docs, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1, 2""",
    ),
    "stripe_scan": (
        stripe_scan,
        """SELECT epoch::INT AS epoch, file, "group"::BIGINT AS "group", count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars
FROM (SELECT *, printf('shard_%05d.parquet', doc_id // 100) AS file, (doc_id % 100) // 16 AS "group" FROM documents), (SELECT unnest([1, 2]) AS epoch)
WHERE "group" % 3 = 1 AND (epoch > 1 OR file > 'shard_00003.parquet' OR file = 'shard_00003.parquet' AND "group" > 1) GROUP BY 1, 2, 3""",
    ),
    "shard_assignment": (
        shard_assignment,
        f"""{_SHARDS}
SELECT shard, shard < (SELECT closed FROM c) AS "full", count(*)::BIGINT AS groups, sum(chars)::BIGINT AS chars, sum(n)::BIGINT AS docs FROM s GROUP BY 1, 2""",
    ),
    "shard_files": (
        shard_files,
        f"""{_SHARDS}, d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, text FROM documents)
SELECT shard, 1::BIGINT AS files, count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars, (count(*) - 1)::BIGINT AS last, md5(arg_min(text, pos)) AS head FROM d JOIN s ON s.g = d.pos // 32 WHERE shard < (SELECT closed FROM c) GROUP BY shard""",
    ),
    "shuffle_order": (shuffle_order, "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents"),
    "task_slice": (task_slice, "SELECT ((item_id - 3) // 4)::BIGINT AS i, item_id AS idx, item_id % 3 AS rank, (item_id // 8)::BIGINT AS batch, length(text)::INT AS chars FROM benchmark WHERE item_id >= 3 AND item_id < 35 AND (item_id - 3) % 4 = 0"),
    "limit_per_source": (limit_per_source, "SELECT doc_id, n_chars FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 20"),
    "byte_stats": (byte_stats, "SELECT min(n)::INT AS lo, max(n)::INT AS hi, avg(n)::DOUBLE AS mean, round(stddev_samp(n), 9)::DOUBLE AS sd, count(*)::BIGINT AS n FROM (SELECT CASE WHEN i < 128 THEN 1 ELSE 3 END AS n FROM range(256) t(i))"),
    "special_lookup": (special_lookup, "SELECT 9::BIGINT AS specials, 256::BIGINT AS ordinary, 256::INT AS bos"),
    "byte_encode": (byte_encode, f"SELECT doc_id, (strlen(t) + 1)::INT AS n, md5(array_to_string(list_concat([256], {_BYTES.format('t')}), ',')) AS digest FROM (SELECT doc_id, text AS t FROM documents)"),
    "conv_violations": (
        conv_violations,
        f"""
WITH x AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 AND turn = 2 THEN 'user' ELSE role END AS role, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN ' ' || chr(10) ELSE text END AS text FROM conversations),
{_MERGED.format(src='x')}
SELECT DISTINCT conv_id, 'role' AS code FROM r WHERE role <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END
UNION ALL SELECT DISTINCT conv_id, 'blank' FROM r WHERE trim(text, ' ' || chr(9) || chr(13) || chr(10)) = ''
UNION ALL SELECT conv_id, 'short' FROM r GROUP BY conv_id HAVING count(*) < 2
UNION ALL SELECT conv_id, 'system' FROM (SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM x) WHERE k = 1 AND role = 'system' AND (nx IS NULL OR nx <> 'user')""",
    ),
    "conv_render": (
        conv_render,
        f"""
WITH {_MERGED.format(src='conversations')}, {_IDS},
f AS (SELECT conv_id, list_concat([256], flatten(list(ids ORDER BY i))) AS ids, list_concat([0], flatten(list(CASE WHEN u THEN list_transform(ids, lambda x: 0) ELSE list_concat([0], list_transform(ids[2:], lambda x: 1)) END ORDER BY i))) AS mask FROM ids GROUP BY conv_id)
SELECT conv_id, len(ids[:2048])::INT AS n, list_sum(mask[:2048])::INT AS learned, ids[1]::INT AS head, md5(array_to_string(ids[:2048], ',')) AS digest FROM f""",
    ),
    "conv_completion": (
        conv_completion,
        f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS q, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS lr FROM conversations),
x AS (SELECT conv_id, turn, role, text FROM e WHERE lr = 'assistant' AND q > 1), {_MERGED.format(src='x')}
SELECT conv_id, (least(1 + sum(strlen(text) + 2), 4096) + 1)::INT AS n, 259::INT AS last FROM r GROUP BY conv_id""",
    ),
    "conv_web": (conv_web, "SELECT conv_id, (2 + sum(strlen(text) + 2))::INT AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id"),
    "conv_targets": (
        conv_targets,
        f"""
WITH {_MERGED.format(src='conversations')}, {_IDS},
f AS (SELECT conv_id, (1 + sum(len(ids))) AS n, list_concat([0], flatten(list(CASE WHEN u THEN list_transform(ids, lambda x: 0) ELSE list_concat([0], list_transform(ids[2:], lambda x: 1)) END ORDER BY i))) AS mask FROM ids GROUP BY conv_id)
SELECT conv_id, least(least(n, 513), 512)::INT AS n_inputs, (least(n, 513) - 1)::INT AS n_targets, list_sum(mask[2:513])::INT AS n_learned FROM f""",
    ),
    "pack_bestfit": (pack_bestfit, best_fit("i AS (SELECT doc_id AS id, strlen(text) + 1 AS length FROM documents)", 2049, 1000, 4, True)),
    "pack_pad": (pack_pad, best_fit(f"{_MERGED.format(src='conversations')}, i AS (SELECT conv_id AS id, least(4097, 1 + sum(strlen(text) + 2)) AS length FROM r0 GROUP BY conv_id)".replace("r AS", "r0 AS", 1), 4097, 100, 2, False)),
    "pack_statistics": (pack_statistics, _PACKINGS),
    "bos_positions": (bos_positions, "SELECT doc_id, '0,' || (1 + strlen(substring(text, 1, (length(text) // 2)::INT))) AS starts FROM documents"),
    "token_lookup": (token_lookup, "SELECT doc_id, md5(lower(hex(encode(text)))) AS hex, (12 * strlen(text) - 1)::INT AS shown FROM documents WHERE text <> ''"),
    "environment": (environment, None),
    "bpe_vocab": (bpe_vocab, None),
    "bpe_round_trip": (bpe_round_trip, "SELECT doc_id FROM documents WHERE false"),
    "bpe_compression": (bpe_compression, None),
}
