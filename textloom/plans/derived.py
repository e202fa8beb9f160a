"""Run, score, item and request tables derived from the whole base tables.

Each is one SQL text in the dialect that both engines share, so a query and its oracle
read the same rows at every size. `{array}` is the array constructor of the engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Fixture, _type


class Derived(Fixture):
    def __init__(self, schema: str, sql: str, duck: str | None = None) -> None:
        """sql: for both engines, or for Spark alone if there is another text for DuckDB."""
        super().__init__(schema, [])
        self.sql, self.duck = sql, duck or sql
        self.tables = sorted(set(re.findall(r"\{(\w+)\}", sql)) - {"array"})

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        views = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in self.tables}
        rows = spark.sql(self.sql.replace("{array}", "array"), **views)
        return rows.selectExpr(*[f"CAST({n} AS {t}) AS {n}" for n, t in self.columns])

    def cte(self, name: str) -> str:
        casts = ", ".join(f"CAST({n} AS {_type(t)}) AS {n}" for n, t in self.columns)
        return f"{name} AS (SELECT {casts} FROM ({self.duck.format(array='list_value', **{t: t for t in self.tables})}) AS t)"


# -- items and answers ------------------------------------------------------------

mc = Derived(
    "idx long; question string; choices array<string>; answer int; subject string",
    "SELECT p_partkey AS idx, p_name AS question, {array}(p_brand, p_type, concat('size ', p_size), concat('ü', p_partkey % 9)) AS choices, p_partkey % 4 AS answer, p_brand AS subject FROM {part}",
)
arc = Derived(
    "idx long; question string; texts array<string>; labels array<string>; answer string",
    """SELECT p_partkey AS idx, concat('Which is ', p_name, '?') AS question, {array}(p_type, p_brand, concat(p_size, ' mm'), 'none', 'all') AS texts,
CASE WHEN p_partkey % 2 = 0 THEN {array}('A', 'B', 'C', 'D') ELSE {array}('1', '2', '3', '4', '5') END AS labels, CASE WHEN p_partkey % 2 = 0 THEN 'B' ELSE '3' END AS answer FROM {part}""",
)
gsm = Derived(
    "idx long; question string; answer string",
    """SELECT o_orderkey AS idx, concat('Order ', o_orderkey, ' of customer ', o_custkey) AS question, CASE o_orderkey % 6
WHEN 0 THEN concat('He has <<', o_custkey, '+4=', o_custkey + 4, '>>', o_custkey + 4, ' parts.', chr(10), '#### ', o_custkey + 4)
WHEN 1 THEN concat('<<2*', o_custkey, '=', 2 * o_custkey, '>>', 2 * o_custkey, ' is the result', chr(10), '#### ', 2 * o_custkey)
WHEN 2 THEN concat('a<<1+1=2>><<', o_custkey, '+2=', o_custkey + 2, '>>b', chr(10), '#### 1,', 100 + o_custkey % 900)
WHEN 3 THEN concat('see <<', o_custkey, '>> of them', chr(10), '#### ', o_custkey, '.')
WHEN 4 THEN concat('plain', chr(10), '#### -', o_custkey)
ELSE concat('nothing here <<', o_custkey, '=', o_custkey, '=2>> end') END AS answer FROM {orders}""",
)
completions = Derived(
    "task string; idx long; sample_idx int; text string; reference string",
    """SELECT CASE WHEN o_custkey % 3 = 0 THEN 'SpellingBee' ELSE 'GSM8K' END AS task, o_custkey AS idx, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS sample_idx,
CASE WHEN o_orderkey % 7 = 0 THEN 'no marker' WHEN o_orderkey % 7 = 1 THEN concat('####', o_custkey) ELSE concat('so #### ', CASE WHEN o_orderkey % 2 = 0 THEN '1,' ELSE '1' END, 100 + (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 900) END AS text,
CASE WHEN o_custkey % 11 = 0 THEN 'also none' ELSE concat('x #### 1', 100 + o_custkey % 900) END AS reference FROM {orders}""",
)
icl_mc = Derived(
    "idx long; query string; choices array<string>; gold int",
    "SELECT s_suppkey AS idx, s_name AS query, {array}(concat('in nation ', s_nationkey), concat('in nation ', (s_nationkey + 7) % 25), concat('é', s_suppkey % 5)) AS choices, s_suppkey % 3 AS gold FROM {supplier}",
)
icl_schema = Derived(
    "idx long; context_options array<string>; continuation string; gold int",
    "SELECT c_custkey AS idx, {array}(concat(c_name, ' came so ', c_name), concat(c_name, ' came so ', c_mktsegment)) AS context_options, concat('paid ', c_nationkey) AS continuation, c_custkey % 2 AS gold FROM {customer}",
)
icl_lm = Derived(
    "idx long; context string; continuation string",
    "SELECT c_custkey AS idx, concat(CASE WHEN c_custkey % 3 = 0 THEN chr(9) ELSE '' END, c_name, CASE WHEN c_custkey % 2 = 0 THEN chr(10) ELSE ' ' END) AS context, c_mktsegment AS continuation FROM {customer}",
)
scores = Derived(
    "task string; kind string; idx long; option int; pos int; token int; loss double; pred int; start int; stop int; gold int",
    """SELECT CASE l_returnflag WHEN 'A' THEN 'arc_easy' WHEN 'N' THEN 'copa' ELSE 'lambada' END AS task, CASE l_returnflag WHEN 'A' THEN 'multiple_choice' WHEN 'N' THEN 'schema' ELSE 'language_modeling' END AS kind,
l_orderkey AS idx, l_linenumber AS option, p AS pos, (l_partkey + p) % 50 AS token, CASE WHEN p < 4 THEN CAST((l_partkey * (p + 3)) % 97 AS DOUBLE) / 16 END AS loss,
CASE WHEN (l_partkey + p) % 9 = 0 THEN 99 ELSE (l_partkey + p + 1) % 50 END AS pred, 2 AS start, 5 AS stop, l_orderkey % 4 + 1 AS gold
FROM {lineitem} CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS n""",
)
loss_tokens = Derived(
    "split string; pos long; target int; loss double",
    "SELECT event_type AS split, event_id AS pos, CASE WHEN event_id % 7 = 3 THEN -1 WHEN event_id % 11 = 5 THEN 256 ELSE (event_id * 37) % 256 END AS target, CAST(user_id % 64 AS DOUBLE) / 16 AS loss FROM {events} UNION ALL SELECT 'empty', event_id, -1, 1 FROM {events} WHERE event_type = 'click'",
)

# -- logits and rollouts ----------------------------------------------------------

_EMBEDDINGS = "SELECT vec_id AS row, i AS token, v AS logit, label FROM {embeddings} LATERAL VIEW posexplode(embedding) AS i, v"
_EMBEDDINGS_DUCK = "SELECT vec_id AS row, i AS token, embedding[i + 1] AS logit, label FROM (SELECT *, unnest(range(0, len(embedding))) AS i FROM {embeddings})"
logits = Derived("row long; token int; logit double", _EMBEDDINGS, _EMBEDDINGS_DUCK)
_LETTERS = "SELECT row AS idx, substr('ABC', CAST(token AS INT) + 1, 1) AS letter, logit, substr('ABC', CAST(label % 3 AS INT) + 1, 1) AS gold FROM ({}) AS e WHERE token < 3"
letter_logits = Derived("idx long; letter string; logit double; gold string", _LETTERS.replace("{}", _EMBEDDINGS), _LETTERS.replace("{}", _EMBEDDINGS_DUCK))
rollouts = Derived(
    "rank int; idx long; sample_idx int; reward double; length int",
    "SELECT user_id % 4 AS rank, user_id AS idx, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sample_idx, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS reward, 10 + event_id % 23 AS length FROM {events}",
)

# -- runs and logs ----------------------------------------------------------------

runs = Derived(
    "flops_budget double; depth int; params_lm_head long; params_transformer long; tokens_trained long; val_bpb double; core_score double",
    """SELECT CASE b WHEN 0 THEN 1e18 WHEN 1 THEN 2.15e18 WHEN 2 THEN 4.64e18 ELSE 1e19 END AS flops_budget, depth, 16777216 + 2097152 * depth AS params_lm_head, 786432 * depth * depth AS params_transformer,
CAST(floor(CASE b WHEN 0 THEN 1e18 WHEN 1 THEN 2.15e18 WHEN 2 THEN 4.64e18 ELSE 1e19 END / (6e0 * 786432 * depth * depth)) AS BIGINT) AS tokens_trained,
CASE WHEN b = 1 AND depth = 14 THEN NULL ELSE 9e-1 - 3e-2 * b + (CASE WHEN b < 3 THEN 4e-3 ELSE -2e-3 END) * (depth - 10 - b) * (depth - 10 - b) + 1e-3 * depth + 1e-6 * parts END AS val_bpb, 1e-1 + 1e-2 * depth AS core_score
FROM (SELECT p_size % 4 AS b, 8 + 2 * CAST(floor((p_size % 20) / 4) AS INT) AS depth, CAST(count(*) AS DOUBLE) AS parts FROM {part} GROUP BY 1, 2) AS g""",
)
step_log = Derived(
    "run long; step long; train_loss double; dt double; tokens long",
    "SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, 2e0 + CAST(event_id % 31 AS DOUBLE) / 32 AS train_loss, 5e-1 + CAST(event_id % 4 AS DOUBLE) / 64 AS dt, 524288 AS tokens FROM {events}",
)
val_log = Derived("run long; step long; val_bpb double", "SELECT user_id AS run, event_id AS step, 1e0 + CAST((event_id * 7919) % 1000 AS DOUBLE) / 1024 AS val_bpb FROM {events}")
log_lines = Derived(
    "run string; line_no long; line string",
    """SELECT concat('d', o_custkey) AS run, o_orderkey AS line_no, CASE o_orderkey % 6
WHEN 0 THEN concat('wte                     : ', o_custkey % 90 + 10, ',165,824') WHEN 1 THEN concat('Calculated number of iterations from target FLOPs: 1,', o_custkey % 900 + 100)
WHEN 2 THEN 'Total batch size 524,288 => steps' WHEN 3 THEN concat('Validation bpb: 0.', o_orderkey % 9000 + 1000) WHEN 4 THEN concat('step ', o_orderkey) ELSE concat('CORE metric: 0.1', o_orderkey % 90 + 10) END AS line FROM {orders}""",
)
calibration = Derived(
    "name string; x1 double; x2 double; x3 double; x4 double; x5 double; x6 double; core double",
    """SELECT s_name AS name, x1, x2, x3, x4, x5, x6, 3e-1 * x1 + 2e-1 * x3 + 1e-1 * x6 + CAST(s_suppkey % 3 AS DOUBLE) / 100 AS core
FROM (SELECT s_suppkey, s_name, CAST(s_suppkey % 17 AS DOUBLE) / 32 AS x1, CAST(s_suppkey % 13 AS DOUBLE) / 32 AS x2, CAST(s_nationkey AS DOUBLE) / 32 AS x3, CAST(s_suppkey % 7 AS DOUBLE) / 16 AS x4, CAST(s_suppkey % 5 AS DOUBLE) / 8 AS x5, CAST(s_suppkey % 11 AS DOUBLE) / 16 AS x6 FROM {supplier}) AS s""",
)
report_metrics = Derived(
    "stage string; section string; key string; kind string; text string; number double",
    """SELECT stage, concat('Chat evaluation ', stage) AS section, key, kind, CASE WHEN kind = 'text' THEN key END AS text, CASE WHEN kind <> 'text' THEN number END AS number
FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'sft' ELSE 'rl' END AS stage, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CORE' WHEN '2' THEN 'ChatCORE' ELSE o_orderpriority END AS key, 'float' AS kind, CAST(max(o_orderkey) AS DOUBLE) / 16 AS number FROM {orders} GROUP BY 1, 2
UNION ALL SELECT CASE o_orderkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'sft' ELSE 'rl' END, concat('n of ', o_orderstatus), 'int', CAST(count(*) AS DOUBLE) FROM {orders} GROUP BY 1, 2
UNION ALL SELECT 'base', c_mktsegment, 'text', CAST(count(*) AS DOUBLE) FROM {customer} GROUP BY 1, 2) AS m""",
)

# -- requests, listings, lines ----------------------------------------------------

_REQUEST = "SELECT conv_id AS req, {} AS messages, CASE conv_id % 4 WHEN 0 THEN 8e-1 WHEN 1 THEN CAST(conv_id % 60 AS DOUBLE) / 25 END AS temperature, CASE conv_id % 3 WHEN 0 THEN conv_id % 5000 END AS max_tokens, CASE conv_id % 5 WHEN 0 THEN conv_id % 250 - 10 END AS top_k FROM {conversations} GROUP BY conv_id"
_CONTENT = "CASE WHEN conv_id % 13 = 0 AND turn = 1 THEN '' WHEN conv_id % 17 = 0 AND turn = 0 THEN repeat(text, 30) ELSE text END"
chat_requests = Derived(
    "req long; messages array<struct<role:string,content:string>>; temperature double; max_tokens int; top_k int",
    _REQUEST.replace("{}", f"transform(array_sort(collect_list(struct(turn, role, {_CONTENT} AS content))), x -> struct(x.role AS role, x.content AS content))", 1),
    _REQUEST.replace("{}", f"list(struct_pack(role := role, content := {_CONTENT}) ORDER BY turn)", 1),
)
checkpoints = Derived(
    "tag string; file string; mtime long",
    "SELECT CASE WHEN s_nationkey % 5 = 0 THEN concat('zeta', s_nationkey) ELSE concat('d', s_nationkey) END AS tag, concat('model_', lpad(CAST(s_suppkey AS VARCHAR(20)), 6, '0'), '.pt') AS file, s_suppkey * 7 % 1000 AS mtime FROM {supplier}",
)
core_csv = Derived(
    "line_no long; line string",
    """SELECT p_partkey AS line_no, CASE p_partkey % 6 WHEN 0 THEN 'Task                               , Accuracy  , Centered  ' WHEN 1 THEN 'short, 1' WHEN 2 THEN concat(rpad(p_name, 35, ' '), ', abc       , 0.1       ')
WHEN 3 THEN concat(rpad(p_name, 35, ' '), ',           , 0.', p_size, '       ') ELSE concat(rpad(p_name, 35, ' '), ', 0.', p_size + 10, '    , -0.', p_size, '  ') END AS line FROM {part}""",
)
expressions = Derived(
    "idx long; expr string",
    """SELECT o_orderkey AS idx, CASE o_orderkey % 8 WHEN 0 THEN concat('1,', 100 + o_custkey % 900, '+1') WHEN 1 THEN concat(o_custkey, '**2') WHEN 2 THEN concat('''', 'strawberry', o_custkey, '''', '.count(''r'')') WHEN 3 THEN '__import__(''os'')'
WHEN 4 THEN concat('(', o_custkey, '+2)*3 - 4') WHEN 5 THEN concat(o_custkey, '/0') WHEN 6 THEN '''aab''.upper()' ELSE concat(o_custkey, ' +') END AS expr FROM {orders}""",
)
