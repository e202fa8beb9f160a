"""Packing, byte pairs, tools, sinks and streams against plain models."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import tools
from textloom.operators import evaluation, packing, runs, select, tasks, tokens
from textloom.sources import readers, sinks
from textloom.streaming import streams


def slow_best_fit(items, capacity, size, crop):
    """Linear scans over a list, as the definition says."""
    feed, buffer, out, row, pos, slot = list(items), [], [], 0, 0, 0
    while True:
        while len(buffer) < size and feed:
            buffer.append(feed.pop(0))
        if not buffer:
            break
        best = -1
        for i, (_, n) in enumerate(buffer):
            if n <= capacity - pos and (best < 0 or n > buffer[best][1]):
                best = i
        if best >= 0:
            key, n = buffer.pop(best)
            out.append((row, slot, pos, key, n, 0))
            pos, slot = pos + n, slot + 1
        elif crop:
            i = min(range(len(buffer)), key=lambda k: buffer[k][1])
            key, n = buffer.pop(i)
            out.append((row, slot, pos, key, capacity - pos, n - capacity + pos))
            pos = capacity
        else:
            pos = capacity
        if pos == capacity:
            row, slot, pos = row + 1, 0, 0
    return [(-2, *x[1:]) if x[0] == row else x for x in out] if slot else out


@pytest.mark.parametrize("crop", [True, False])
def test_place(crop):
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.randint(5, 40)
        items = [(i, rng.randint(1, capacity if not crop else 2 * capacity)) for i in range(rng.randint(0, 60))]
        size = rng.randint(1, 12)
        got = packing.place(items, capacity, size, crop)
        assert got == slow_best_fit(items, capacity, size, crop)
        by_row = {}
        for row, _, _, _, taken, _ in got:
            by_row[row] = by_row.get(row, 0) + taken
        assert all(n == capacity for r, n in by_row.items() if r >= 0) if crop else all(n <= capacity for n in by_row.values())
        assert sum(x[4] + x[5] for x in got) == sum(n for _, n in items)
        assert len({x[3] for x in got}) == len(got) == len(items)


def test_pack_does_not_depend_on_partitions(spark):
    items = spark.range(300).select("id", ((F.col("id") * 37) % 90 + 1).cast("int").alias("length"))
    found = [sorted(packing.pack(items.repartition(n), 64, 3, buffer_size=20).collect()) for n in (1, 4, 8)]
    assert found[0] == found[1] == found[2]


def test_assemble_and_tail(spark):
    rows = spark.createDataFrame([(i, [i] * (i % 5 + 1)) for i in range(20)], "id long, ids array<int>")
    placed = packing.pack(rows.select("id", F.size("ids").alias("length")), 8, 1, "bestfit_pad", 5)
    full = packing.ignore_tail(packing.assemble(placed, rows, 8, pad=99), 8).collect()
    assert full
    for r in full:
        assert len(r["tokens"]) == 8 and r["tokens"][r["content_len"] :] == [99] * (8 - r["content_len"])
        assert r["content_len"] == 8 or set(r["targets"][r["content_len"] - 1 :]) == {-1}


def test_stream_packing_equals_batch(spark, tmp_path):
    schema = "id long, length int"
    items = spark.createDataFrame([(i, (i * 37) % 30 + 1) for i in range(120)], schema)
    for k in range(3):
        items.where(F.floor(F.col("id") / 40) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = streams.run_once(streams.pack_stream(stream, 32, 2, 10), str(tmp_path / "cp"), "packed").collect()
    want = [r for r in packing.pack(items, 32, 2, buffer_size=10).collect()]
    for stripe in (0, 1):
        a = sorted((r["row"], r["slot"], r["id"], r["taken"]) for r in got if r["stripe"] == stripe)
        b = sorted((r["row"], r["slot"], r["id"], r["taken"]) for r in want if r["stripe"] == stripe and r["row"] >= 0)
        assert len(a) == 51 and a == b[:51]


def test_event_windows_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = streams.event_windows(stream, "1 day").writeStream.format("memory").queryName("ev").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r["start"], r["event_type"], r["n"])
    assert sorted(map(key, spark.table("ev").collect())) == sorted(map(key, streams.event_windows(events, "1 day").collect()))


def plain_merges(counts, n):
    """Pairs counted anew before every merge."""
    words, merges = [(list(c), m) for c, m in counts], []
    for new in range(256, 256 + n):
        pairs = {}
        for ids, m in words:
            for p in zip(ids, ids[1:]):
                pairs[p] = pairs.get(p, 0) + m
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append(best)
        for k, (ids, m) in enumerate(words):
            out, i = [], 0
            while i < len(ids):
                hit = tuple(ids[i : i + 2]) == best
                out.append(new if hit else ids[i])
                i += 2 if hit else 1
            words[k] = (out, m)
    return merges


def test_merges_on_the_driver_and_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 25")
    counts = [(r["chunk"].encode(), r["n"]) for r in tokens.chunk_counts(docs).collect()]
    want = plain_merges(counts, 60)
    assert tokens.learn_merges(counts, 60) == want and tokens.train(docs, 60, driver_chunks=10) == want
    assert tokens.learn_merges([], 5) == [] == tokens.learn_merges([(b"a", 3)], 5)
    few = [(b"aaaa", 3), (b"abab", 2), (b"ba", 2)]
    table = spark.createDataFrame([(c.decode(), n) for c, n in few], "chunk string, n long")
    assert tokens.learn_merges(few, 9) == plain_merges(few, 9) == tokens.learn_merges_apart(table, 9) == tokens.learn_merges_apart(table, 9, batch=2)


def test_encoding_equals_the_library(spark):
    """The same merges as ranks of a public library give the same ids."""
    import tiktoken

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    merges = tokens.train(docs, 300)
    ranks = {t: i for i, t in enumerate(tokens.vocabulary(merges))}
    library = tiktoken.Encoding("own", pat_str=T.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in tokens.encode(docs, merges).collect():
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]])
    sizes = {r["lang"]: r["tokens"] for r in tokens.side_by_side(docs, "lang", {"own": tokens.piece_counter(merges)}).collect()}
    assert sum(sizes.values()) == sum(len(library.encode_ordinary(t)) for t in texts.values())


def test_first_fit_decreasing():
    rng = random.Random(9)
    for _ in range(50):
        capacity, items = rng.randint(5, 30), [(i, rng.randint(1, 40)) for i in range(rng.randint(0, 60))]
        room, slots, want = [], [], []
        for key, n in sorted(items, key=lambda x: (-x[1], x[0])):
            taken = min(n, capacity)
            row = next((r for r, free in enumerate(room) if free >= taken), len(room))
            if row == len(room):
                room.append(capacity)
                slots.append(0)
            want.append((row, slots[row], capacity - room[row], key, taken, n - taken))
            room[row] -= taken
            slots[row] += 1
        assert packing.first_fit_decreasing(items, capacity) == want


@pytest.mark.parametrize("beta", [0.5, 0.999])
def test_moving_average_over_blocks(spark, monkeypatch, beta):
    monkeypatch.setattr(runs, "EMA_BLOCK", 7)
    rows = [(r, i, (i * 37 % 11) / 3) for r, n in ((0, 50), (1, 3), (2, 7), (3, 14)) for i in range(n)]
    got = {(r["run"], r["step"]): r["ema"] for r in runs.ema(spark.createDataFrame(rows, "run int, step int, x double"), "x", beta, by=("run",)).collect()}
    for run in range(4):
        acc = 0.0
        for i, x in ((i, x) for r, i, x in rows if r == run):
            acc = beta * acc + (1 - beta) * x
            assert abs(got[run, i] - acc / (1 - beta ** (i + 1))) < 1e-9


def test_byte_pairs(spark):
    docs = spark.createDataFrame([(0, "low lower lowest"), (1, "newer wider é🌍 12345"), (2, ""), (3, None)], "doc_id long, text string")
    merges = tokens.train(docs, 40)
    assert merges == tokens.train(docs.repartition(3), 40)
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(docs, merges), merges).collect()}
    assert back == {0: "low lower lowest", 1: "newer wider é🌍 12345", 2: "", 3: ""}
    sizes = {r["doc_id"]: len(r["ids"]) for r in tokens.encode(docs, merges, bos=True).collect()}
    assert sizes[2] == 1 and sizes[0] < 17


def test_pretokens_are_lossless(spark):
    import regex

    texts = ["Hello  world's 1234 \n\n x", "né🌍 don't", " \t\n", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.pretokens(F.col("t")).alias("p"))
    for r in df.collect():
        assert r["p"] == regex.findall(T.SPLIT_PATTERN, r["t"])


def test_parts_mask(spark):
    parts = spark.createDataFrame([([("text", "ab"), ("python", "1+1"), ("python_output", "2")],)], "p array<struct<type:string,text:string>>")
    ids, mask = tokens.render_parts(F.col("p"))
    r = parts.select(ids.alias("i"), mask.alias("m")).first()
    assert len(r["i"]) == len(r["m"]) == 2 + 5 + 3 and r["m"] == [1] * 7 + [0] * 3


def test_calculator():
    assert tools.calculate("1,000+1") == "1001" and tools.calculate("2**3") is None and tools.calculate("'aab'.count('a')") == "2"
    assert tools.calculate("__import__('os').count('a')") is None and tools.calculate("1/0") is None and tools.calculate("(") is None


def test_programs(spark):
    rows = spark.createDataFrame([(0, "print(1)"), (1, "raise ValueError('x')"), (2, "while True: pass"), (3, "x = 'a' * (1 << 31)")], "idx long, program string")
    with pytest.raises(PermissionError):
        tools.execute(rows)
    out = {r["idx"]: r for r in tools.execute(rows, enabled=True, seconds=2).collect()}
    assert out[0]["success"] and out[0]["stdout"] == "1\n"
    assert not out[1]["success"] and "ValueError" in out[1]["error"]
    assert out[2]["timeout"] and out[3]["memory_exceeded"]


def test_streamed_text():
    assert tools.utf8_chunks([b"a", b"\xc3", b"\xa9", b"b"]) == ["a", "", "é", "b"]


def test_shards_round_trip(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    sinks.write_shards(docs, str(tmp_path / "s"), shard_chars=60, group_rows=8)
    plan = sinks.shard_plan(docs, 60, 8).collect()
    written = spark.read.parquet(str(tmp_path / "s")).count()
    assert written == sum(r["n"] for r in plan if r["full"]) and written % 8 == 0 and written < 100
    got = readers.shards(spark, str(tmp_path / "s" / "shard=0"))
    assert got.count() == 24 and set(got.columns) == {"text", "file", "row"}


def test_readers(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('[{"role":"user","content":"a"}]\n\n[{"role":"user","content":"b"},{"role":"assistant","content":"c"}]\n')
    assert [len(r["messages"]) for r in readers.json_conversations(spark, str(path)).collect()] == [1, 2]
    assert readers.json_conversations(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "r.log").write_text("wte : 1,000\nx\nwte : 2,000\n")
    assert runs.scrape(readers.log_lines(spark, str(tmp_path / "*.log")), {"wte": r"^wte : ([\d,]+)$"}).first()["wte"] == "2000"


def test_running_sum_has_no_single_partition_sort(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(3).alias("v"))
    out = {r["doc_id"]: r["b"] for r in select.running_before(df, F.col("v"), "doc_id", "b").collect()}
    assert out == {i: 3 * i for i in range(1000)}


def test_bits_per_byte_is_infinite_without_bytes(spark):
    from textloom.operators.evaluation import bits_per_byte, byte_table

    losses = spark.createDataFrame([("a", -1, 2.0), ("b", 65, math.log(2))], "s string, target int, loss double")
    got = {r["s"]: r["bpb"] for r in bits_per_byte(losses, byte_table()(spark), "s").collect()}
    assert got["a"] == math.inf and abs(got["b"] - 1) < 1e-12


def test_metrics_byte_table_and_inferred_csv(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "loss", 2.5), ("b", 1, "loss", 2.0)], "run string, step int, key string, value double")
    sinks.append_metrics(rows, str(tmp_path / "m"))
    sinks.append_metrics(rows.where("run = 'a'").withColumn("step", F.lit(2)), str(tmp_path / "m"))
    assert sorted((r["run"], r["step"], r["value"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [("a", 1, 2.5), ("a", 2, 2.5), ("b", 1, 2.0)]
    sinks.write_byte_table(evaluation.byte_table()(spark), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("n_bytes = 0").count() == 9
    rows.coalesce(1).write.option("header", True).csv(str(tmp_path / "c"))
    assert dict(readers.header_csv(spark, str(tmp_path / "c")).dtypes) == {"run": "string", "step": "int", "key": "string", "value": "double"}


def test_registered_tasks_and_samples(spark):
    items = spark.createDataFrame([(0, "anna", "n", 2, "count")], "idx long, word string, letter string, n int, user string")
    got = tasks.build("SpellingBee", items).first()["messages"][1]["parts"]
    assert got[0]["text"].endswith("1:a\n2:n hit! count=1\n3:n hit! count=2\n4:a\n\nThis gives us 2.") and got[4]["text"].endswith("#### 2")
    with pytest.raises(ValueError):
        tasks.build("unknown", items)
    samples = spark.createDataFrame([(0, [1, 2, 9, 3], 1), (1, [1, 2], 1), (2, [1], 1), (3, [1, 8, 2, 9], 0)], "idx long, ids array<int>, prompt_len int")
    assert {r["idx"]: r["sampled"] for r in evaluation.sampled_text(samples, [8, 9]).collect()} == {0: [2], 1: [2], 2: [], 3: [1]}


def test_few_shot_picks_are_distinct(spark):
    for n, k in ((1, 3), (2, 3), (7, 3), (50, 5)):
        found = {}
        for r in tasks.few_shot_pick(spark.range(n).withColumnRenamed("id", "idx"), k).collect():
            found.setdefault(r["idx"], []).append(r["other"])
        assert all(i not in x and len(set(x)) == len(x) == min(k, n - 1) for i, x in found.items()) and len(found) == (n if n > 1 else 0)


def test_order_blocks(spark):
    rows = spark.range(500).select(((F.col("id") * 77) % 500).alias("o"), F.lit(2).alias("v"))
    for blocks in (1, 2, 5, 64, 300):
        assert all(r["b"] == 2 * r["o"] for r in select.running_before(rows, F.col("v"), "o", "b", blocks=blocks).collect())


def test_shard_plan_by_plain_scan(spark):
    rng = random.Random(13)
    for n, size, group in ((0, 5, 2), (57, 30, 4), (64, 30, 4), (40, 1, 3), (40, 10_000, 3)):
        texts = ["x" * rng.choice([0, 0, 3, 9, 40]) for _ in range(n)]
        shard, held, want = 0, 0, []
        for g in range(0, n, group):
            part = texts[g : g + group]
            want.append((g // group, shard, sum(map(len, part)), len(part)))
            held += want[-1][2]
            if len(part) == group and held >= size:
                shard, held = shard + 1, 0
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
        got = sorted(tuple(r) for r in sinks.shard_plan(docs, size, group).collect())
        assert got == [(*x, x[1] < shard) for x in want]
