"""Task queries: conversations from sources, mixtures, generators, readers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import select, tasks
from textloom.plans import derived as D
from textloom.plans import fixtures as X
from textloom.sources import readers


def _messages(rows: DataFrame) -> DataFrame:
    """idx, i, role, parts, digest: messages in long form."""
    m = rows.select("idx", F.posexplode("messages").alias("i", "m"))
    text = F.coalesce(F.col("m.content"), F.array_join(F.transform("m.parts", lambda p: F.concat(p["type"], F.lit("="), p["text"])), "|"))
    return m.select("idx", "i", F.col("m.role").alias("role"), text.alias("text"))


def mc_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(tasks.mmlu(D.mc.df(spark, sf_dir)))


def arc_render(spark, sf_dir):
    return _messages(tasks.arc(D.arc.df(spark, sf_dir)))


def gsm_parts(spark, sf_dir):
    rows = tasks.gsm8k(D.gsm.df(spark, sf_dir))
    parts = rows.select("idx", F.posexplode(F.element_at("messages", 2)["parts"]).alias("i", "p"))
    return parts.select("idx", "i", F.col("p.type").alias("type"), F.col("p.text").alias("text"))


def gsm_self_check(spark, sf_dir):
    """The reference answer of each source row against itself: always equal."""
    rows = tasks.gsm8k(D.gsm.df(spark, sf_dir)).join(D.gsm.df(spark, sf_dir), "idx")
    return rows.select("idx", tasks.answers_equal(F.col("answer"), tasks.last_text(F.col("messages"))).alias("ok"))


def program_assembly(spark, sf_dir):
    return tasks.program(X.programs.df(spark, sf_dir))


def chat_validation(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = turns.groupBy(F.col("conv_id").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))
    loose, strict = tasks.chat_rows(rows), tasks.chat_rows(rows, allow_system=False)
    return loose.select("idx", F.lit("smoltalk").alias("rule")).unionByName(strict.select("idx", F.lit("custom").alias("rule")))


def mixture_order(spark, sf_dir):
    """Two conversation sources, one of them twice: place in the shuffled order."""
    a = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn = 0").select(F.col("conv_id").alias("idx"))
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("idx"))
    rows = tasks.sequence(a, b, b)
    return select.shuffled(rows, 42, "task_idx", "idx").select("task_idx", "idx", "k")


def task_sequence(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("idx"))
    b = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("idx")).distinct()
    return tasks.sequence(a, b).select("task_idx", "idx")


def fewshot_pick(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("idx"))
    return tasks.few_shot_pick(items, 5)


def _words(spark, sf_dir):
    return readers.distinct_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def spelling_items(spark, sf_dir):
    return tasks.spelling_items(spark, _words(spark, sf_dir), 60)


def spelling_trace(spark, sf_dir):
    rows = tasks.spelling_conversations(tasks.spelling_items(spark, _words(spark, sf_dir), 30, "test"))
    return rows.select("idx", F.md5(F.get(F.element_at("messages", 2)["parts"], F.lit(0))["text"]).alias("manual"), tasks.last_text(F.col("messages")).alias("final"))


def simple_spelling(spark, sf_dir):
    return tasks.simple_spelling(spark, _words(spark, sf_dir), 40)


def diverse_picks(spark, sf_dir):
    return tasks.diverse_picks(spark, 50, {"topic": ["math", "art", "code", "food"], "tone": ["dry", "warm", "curt"], "length": ["short", "long"]})


def custom_json(spark, sf_dir):
    """Conversations as lines of JSON arrays, parsed with an explicit schema; blank lines go."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    lines = turns.groupBy(F.col("conv_id").alias("idx")).agg(F.when(F.col("idx") % 10 == 3, "  ").otherwise(F.to_json(messages)).alias("value"))
    rows = lines.where(F.btrim("value") != "").select("idx", F.from_json("value", readers.MESSAGES).alias("messages"))
    valid = tasks.chat_rows(rows, allow_system=False).select("idx", F.lit(True).alias("valid"))
    return rows.select("idx", F.size("messages").alias("n")).join(valid, "idx", "left").select("idx", "n", F.coalesce("valid", F.lit(False)).alias("valid"))


def padded_results(spark, sf_dir):
    return readers.padded_csv(D.core_csv.df(spark, sf_dir))


def latest_checkpoint(spark, sf_dir):
    return readers.latest_checkpoint(D.checkpoints.df(spark, sf_dir))


def wanted_shards(spark, sf_dir):
    return readers.wanted_shards(spark, 6, 6542, spark.range(2, 4))


def yaml_tasks(spark, sf_dir):
    text = "icl_tasks:\n- label: copa\n  icl_task_type: schema\n  dataset_uri: a/copa.jsonl\n  num_fewshot: [0]\n- label: lambada\n  icl_task_type: language_modeling\n  dataset_uri: b/lambada.jsonl\n  num_fewshot:\n  - 0\n  - 10\n  continuation_delimiter: \"\\nAnswer: \"\n"
    rows = readers.yaml_tasks(spark, text)
    return rows.select("label", "icl_task_type", "dataset_uri", F.array_join(F.transform("num_fewshot", lambda x: x.cast("string")), ",").alias("shots"), "continuation_delimiter")


def pretoken_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = docs.select("doc_id", "text", T.pretokens(F.col("text")).alias("p"))
    return p.select("doc_id", (F.array_join("p", "") == F.col("text")).alias("lossless"), F.octet_length(F.array_join("p", "")).alias("bytes"))


_LET = "['A', 'B', 'C', 'D']"
_MC = "'Multiple Choice question: ' || question || chr(10) || list_aggregate(list_transform(range(1, least(len({l}), len({c})) + 1), lambda k: '- ' || {c}[k] || '=' || {l}[k] || chr(10)), 'string_agg', '') || chr(10) || 'Respond only with the letter of the correct answer.'"
_PICK = "(('0x' || substr(md5({seed} || ':{salt}'), 1, 8))::BIGINT % {n})"
_WORDS = "v AS (SELECT row_number() OVER (ORDER BY word) - 1 AS r, word FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents))"


def _filled(template: str, **values: str) -> str:
    """A template as an SQL expression."""
    pieces = re.split(r"\{(\w+)\}", template)
    text = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return " || ".join(values[x] if i % 2 else text(x) for i, x in enumerate(pieces) if i % 2 or x)


def few_shot_sql(k: int) -> str:
    """p (idx, shot, other): few-shot picks of the items of a relation s."""
    pick = lambda salt, n: _PICK.format(seed="a.idx", salt=salt, n=n)
    take = f"least({k}, a.n - 1)"
    return f"""ring AS (SELECT idx, row_number() OVER (ORDER BY md5('1234:' || idx), idx) - 1 AS r, count(*) OVER () AS n FROM s),
p AS (SELECT a.idx, k::INT AS shot, b.idx AS other FROM ring a, (SELECT unnest(range(1, {k + 1})) AS k), ring b
 WHERE k <= {take} AND b.r = (a.r + 1 + ({pick("start", "(a.n - 1)")} + (k - 1) * ({pick("stride", f"greatest(1, (a.n - 1) // {take})")} + 1)) % (a.n - 1)) % a.n)"""


def _spelling(size: int, offset: int) -> str:
    p = lambda salt, n: _PICK.format(seed="seed", salt=salt, n=n)
    templates = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in tasks.TEMPLATES) + "]"
    return f"""{_WORDS}, b AS (SELECT i AS idx, i + {offset} AS seed FROM range({size}) t(i)),
w AS (SELECT idx, seed, word FROM b JOIN v ON r = {p('word', '(SELECT count(*) FROM v)')}),
l AS (SELECT *, CASE WHEN {p('own', 10)} < 9 THEN substr(word, ({p('place', 'length(word)')} + 1)::INT, 1) ELSE substr('{tasks.LETTERS}', ({p('letter', 26)} + 1)::INT, 1) END AS letter FROM w),
t AS (SELECT *, ['', '''', '"'][{p('lq', 3)} + 1] AS lq, ['', '''', '"'][{p('wq', 3)} + 1] AS wq, {templates}[{p('template', len(tasks.TEMPLATES))} + 1] AS tpl FROM l),
s AS (SELECT idx, word, letter, (length(word) - length(replace(word, letter, '')))::INT AS n, replace(replace(CASE WHEN {p('lower', 10)} < 3 THEN lower(tpl) ELSE tpl END, '{{letter}}', lq || letter || lq), '{{word}}', wq || word || wq) || CASE WHEN {p('mark', 2)} = 0 THEN '?' ELSE '' END AS "user" FROM t)"""


_CHAT = """m AS (SELECT conv_id AS idx, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id),
x AS (SELECT idx, 'smoltalk' AS rule, CASE WHEN roles[1] = 'system' THEN roles[2:] ELSE roles END AS q FROM m UNION ALL SELECT idx, 'custom', roles FROM m)"""

QUERIES = {
    "mc_render": (mc_render, f"WITH {D.mc.cte('s')} SELECT idx, 0::INT AS i, 'user' AS role, {_MC.format(l=_LET, c='choices')} AS text FROM s UNION ALL SELECT idx, 1, 'assistant', {_LET}[answer + 1] FROM s"),
    "arc_render": (arc_render, f"WITH {D.arc.cte('s')} SELECT idx, 0::INT AS i, 'user' AS role, {_MC.format(l='labels', c='texts')} AS text FROM s UNION ALL SELECT idx, 1, 'assistant', answer FROM s"),
    "gsm_parts": (
        gsm_parts,
        f"""WITH {D.gsm.cte('s')}, p AS (SELECT idx, string_split_regex(answer, '<<[^>]+>>') AS t, regexp_extract_all(answer, '<<([^>]+)>>', 1) AS g FROM s),
e AS (SELECT idx, k, t[k + 1] AS text, g[k] AS tag FROM (SELECT *, unnest(range(0, len(t))) AS k FROM p))
SELECT idx, (3 * k)::INT AS i, 'text' AS type, text FROM e
UNION ALL SELECT idx, (3 * k - 2)::INT, 'python', CASE WHEN contains(tag, '=') THEN regexp_extract(tag, '(?s)^(.*)=[^=]*$', 1) ELSE tag END FROM e WHERE k > 0
UNION ALL SELECT idx, (3 * k - 1)::INT, 'python_output', CASE WHEN contains(tag, '=') THEN regexp_extract(tag, '(?s)=([^=]*)$', 1) ELSE '' END FROM e WHERE k > 0""",
    ),
    "gsm_self_check": (gsm_self_check, f"WITH {D.gsm.cte('s')} SELECT idx, true AS ok FROM s"),
    "program_assembly": (
        program_assembly,
        "SELECT * FROM (VALUES (0::BIGINT, 'import os' || chr(10) || 'from math import pi' || chr(10) || chr(10) || 'def f(x):' || chr(10) || '    return x + 1' || chr(10) || chr(10) || 'def check(g):' || chr(10) || '    assert g(1) == 2' || chr(10) || 'check(f)'), (1, chr(10) || chr(10) || 'def g():' || chr(10) || '    return 3' || chr(10) || chr(10) || 'def check(g):' || chr(10) || '    assert g() == 3' || chr(10) || 'check(g)')) t(idx, program)",
    ),
    "chat_validation": (chat_validation, f"WITH {_CHAT} SELECT idx, rule FROM x WHERE len(q) >= 2 AND len(list_filter(range(1, len(q) + 1), lambda k: q[k] <> CASE WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END)) = 0"),
    "mixture_order": (
        mixture_order,
        """WITH m AS (SELECT 0 AS task_idx, conv_id AS idx FROM conversations WHERE turn = 0 UNION ALL SELECT 1, item_id FROM benchmark UNION ALL SELECT 2, item_id FROM benchmark),
h AS (SELECT *, md5('42:' || task_idx || ':' || idx) AS h FROM m) SELECT task_idx, idx, row_number() OVER (ORDER BY h, task_idx, idx) AS k FROM h""",
    ),
    "task_sequence": (task_sequence, "SELECT 0 AS task_idx, item_id AS idx FROM benchmark UNION ALL SELECT DISTINCT 1, conv_id FROM conversations"),
    "fewshot_pick": (fewshot_pick, f"WITH s AS (SELECT item_id AS idx FROM benchmark), {few_shot_sql(5)} SELECT idx, shot, other FROM p"),
    "spelling_items": (spelling_items, f"WITH {_spelling(60, 0)} SELECT * FROM s"),
    "spelling_trace": (
        spelling_trace,
        f"""WITH {_spelling(30, tasks.TEST_OFFSET)}, c AS (SELECT idx, word, letter, n, k, substr(word, k::INT, 1) AS ch FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM s)),
h AS (SELECT *, sum(CASE WHEN ch = letter THEN 1 ELSE 0 END) OVER (PARTITION BY idx ORDER BY k) AS hits FROM c),
g AS (SELECT idx, word, letter, n, string_agg(ch, ',' ORDER BY k) AS spelled, string_agg(k || ':' || ch || CASE WHEN ch = letter THEN ' hit! count=' || hits ELSE '' END, chr(10) ORDER BY k) AS lines FROM h GROUP BY ALL)
SELECT idx, md5({_filled(tasks.MANUAL, letter='letter', word='word', spelled='spelled', trace='lines', n='n')}) AS manual, {_filled(tasks.FINAL, n='n')} AS final FROM g""",
    ),
    "simple_spelling": (simple_spelling, f"WITH {_WORDS} SELECT i AS idx, word, {_filled(tasks.SPELL, word='word')} AS \"user\", word || ':' || array_to_string(regexp_extract_all(word, '.'), ',') AS assistant FROM range(40) t(i) JOIN v ON r = {_PICK.format(seed='i', salt='simple', n='(SELECT count(*) FROM v)')}"),
    "diverse_picks": (diverse_picks, "SELECT i AS idx, " + ", ".join(f"{v}[{_PICK.format(seed='i', salt=k, n=n)} + 1] AS {k}" for k, v, n in (("topic", "['math', 'art', 'code', 'food']", 4), ("tone", "['dry', 'warm', 'curt']", 3), ("length", "['short', 'long']", 2))) + " FROM range(50) t(i)"),
    "custom_json": (custom_json, f"WITH {_CHAT} SELECT idx, len(q)::INT AS n, len(q) >= 2 AND len(list_filter(range(1, len(q) + 1), lambda k: q[k] <> CASE WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END)) = 0 AS valid FROM x WHERE rule = 'custom' AND idx % 10 <> 3"),
    "padded_results": (
        padded_results,
        f"""WITH {D.core_csv.cte('s')}, p AS (SELECT list_transform(string_split(line, ','), lambda x: trim(x, ' ')) AS p FROM s)
SELECT p[1] AS task, try_cast(nullif(p[2], '') AS DOUBLE) AS accuracy, try_cast(nullif(p[3], '') AS DOUBLE) AS centered FROM p WHERE len(p) >= 3 AND p[1] <> 'Task' AND (p[2] = '' OR try_cast(p[2] AS DOUBLE) IS NOT NULL) AND (p[3] = '' OR try_cast(p[3] AS DOUBLE) IS NOT NULL)""",
    ),
    "latest_checkpoint": (latest_checkpoint, f"WITH {D.checkpoints.cte('s')}, b AS (SELECT tag FROM s WHERE regexp_matches(tag, '^d[0-9]+') ORDER BY regexp_extract(tag, '^d([0-9]+)', 1)::INT DESC LIMIT 1) SELECT tag, max(regexp_extract(file, '_([^_.]*)\\.', 1))::BIGINT AS step FROM s JOIN b USING (tag) GROUP BY tag"),
    "wanted_shards": (wanted_shards, "SELECT id FROM (SELECT i AS id FROM range(6) t(i) UNION SELECT 6542) WHERE id NOT IN (2, 3)"),
    "yaml_tasks": (yaml_tasks, "SELECT * FROM (VALUES ('copa', 'schema', 'a/copa.jsonl', '0', ' '), ('lambada', 'language_modeling', 'b/lambada.jsonl', '0,10', chr(10) || 'Answer: ')) t(label, icl_task_type, dataset_uri, shots, continuation_delimiter)"),
    "pretoken_counts": (pretoken_counts, "SELECT doc_id, true AS lossless, strlen(text)::INT AS bytes FROM documents"),
}
