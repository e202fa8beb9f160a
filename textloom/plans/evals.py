"""Evaluation queries over score, completion and rollout tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import tools
from textloom.operators import evaluation as E
from textloom.operators import packing, tasks, tokens
from textloom.plans import derived as D
from textloom.plans import fixtures as X
from textloom.plans.tasks import few_shot_sql


def unigram_bpb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits per byte of an add-one unigram byte model learned on the train documents,
    by split: the scorer seam with a model that SQL can check."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"), "text")
    counts = E.byte_counts(docs, "split")
    train = counts.where("split = 'train'").select("target", F.col("n").alias("c"))
    total = train.agg(F.sum("c").alias("total"))
    scored = counts.join(F.broadcast(train), "target", "left").crossJoin(F.broadcast(total))  # 256 rows, one row
    loss = -F.log((F.coalesce("c", F.lit(0)) + 1) / (F.col("total") + 256))
    return scored.groupBy("split").agg(F.round(F.sum(loss * F.col("n")) / (F.log(F.lit(2.0)) * F.sum("n")), 9).alias("bpb"), F.sum("n").alias("bytes"))


def masked_bpb(spark, sf_dir):
    rows = E.bits_per_byte(D.loss_tokens.df(spark, sf_dir), E.byte_table()(spark), "split")
    return rows.select("split", "bytes", F.round("nats", 9).alias("nats"), F.round("bpb", 9).alias("bpb"))


def mean_outcome(spark, sf_dir):
    """Per-rank sums reduced to one accuracy, and any success of a problem."""
    rows = D.completions.df(spark, sf_dir).withColumn("is_correct", tasks.answers_equal(F.col("text"), F.col("reference")))
    any_ = rows.groupBy("task", "idx").agg(F.bool_or("is_correct").alias("is_correct"))
    return E.accuracy(any_, "task")


def generative_eval(spark, sf_dir):
    """Items with a reference joined to their completions: passed if any of them is right."""
    done = D.completions.df(spark, sf_dir)
    items = done.groupBy("task", "idx").agg(F.min("reference").alias("reference"))
    return E.generative_accuracy(items, done.select("task", "idx", "sample_idx", "text"), tasks.answers_equal)


def sampled_ids(spark, sf_dir):
    """Sampled rows of conversations: the first turns are the prompt, the end mark is terminal."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ids = tokens.render(turns, 1 << 20).select("conv_id", "ids")
    rows = ids.withColumn("prompt_len", F.array_position("ids", tokens.special("assistant_start")).cast("int"))
    found = E.sampled_text(rows.where("prompt_len > 0"), [tokens.special("assistant_end"), tokens.special("bos")])
    return found.select("conv_id", "prompt_len", F.size("sampled").alias("n_sampled"))


def gsm_answer_match(spark, sf_dir):
    rows = D.completions.df(spark, sf_dir)
    return rows.select("task", "idx", "sample_idx", T.answer_number(F.col("text")).alias("got"), tasks.answers_equal(F.col("text"), F.col("reference")).alias("is_correct"), F.when(tasks.answers_equal(F.col("text"), F.col("reference")), 1.0).otherwise(0.0).alias("reward"))


def icl_accuracy(spark, sf_dir):
    outcomes = E.example_outcomes(E.option_losses(D.scores.df(spark, sf_dir)))
    return E.accuracy(outcomes, "task")


def span_losses(spark, sf_dir):
    rows = E.option_losses(D.scores.df(spark, sf_dir))
    return rows.select("task", "idx", "option", F.round("mean_loss", 9).alias("mean_loss"), "exact")


def core_metric(spark, sf_dir):
    rows = E.core_metric(E.accuracy(E.example_outcomes(E.option_losses(D.scores.df(spark, sf_dir))), "task"), X.eval_meta.df(spark, sf_dir))
    total = rows.agg(F.lit("CORE").alias("task"), F.avg("centered").alias("centered"))
    return rows.select("task", F.round("centered", 9).alias("centered")).unionByName(total.select("task", F.round("centered", 9).alias("centered")))


def missing_baselines(spark, sf_dir):
    done = D.scores.df(spark, sf_dir).select("task").distinct()
    return X.eval_meta.df(spark, sf_dir).join(done, "task", "left_anti").select("task")


def chat_core(spark, sf_dir):
    rows = X.chat_results.df(spark, sf_dir).join(F.broadcast(X.chat_meta.df(spark, sf_dir)), "task", "left")
    return rows.agg(F.round(F.when(F.countDistinct("task") == 6, F.avg(E.centered(F.col("accuracy"), F.coalesce("baseline", F.lit(0.0))))), 9).alias("chatcore"), F.round(F.avg(F.when(F.col("task").isin("ARC-Easy", "ARC-Challenge", "MMLU"), E.centered(F.col("accuracy"), F.coalesce("baseline", F.lit(0.0))))), 9).alias("chatcore_cat"))


def pass_at_k(spark, sf_dir):
    rows = D.rollouts.df(spark, sf_dir).select("idx", "sample_idx", (F.col("reward") > 0).alias("is_correct"))
    return E.pass_at_k(rows)


def advantages(spark, sf_dir):
    return E.advantages(D.rollouts.df(spark, sf_dir)).select("idx", "sample_idx", F.round("advantage", 9).alias("advantage"))


def rank_means(spark, sf_dir):
    """Mean of per-rank means, not the mean over rows."""
    per = D.rollouts.df(spark, sf_dir).groupBy("rank").agg(F.avg("reward").alias("r"), F.avg("length").alias("n"))
    return per.agg(F.round(F.avg("r"), 9).alias("reward"), F.round(F.avg("n"), 9).alias("length"))


def policy_objective(spark, sf_dir):
    rows = E.advantages(D.rollouts.df(spark, sf_dir)).select((F.col("length") % 5 - 1).alias("target"), (-0.1 * F.col("length")).alias("logp"), "advantage")
    return E.policy_objective(rows).select(F.round("objective", 9).alias("objective"))


def letter_argmax(spark, sf_dir):
    best = E.argmax(D.letter_logits.df(spark, sf_dir), ["idx", "gold"], "letter", "logit")
    return best.select("idx", F.col("best").alias("letter"), (F.col("best") == F.col("gold")).alias("is_correct"))


def topk_softmax(spark, sf_dir):
    return E.top_k_softmax(D.logits.df(spark, sf_dir), "row", 4, 0.8).select("row", "token", F.round("p", 9).alias("p"))


def topk_with_ties(spark, sf_dir):
    return E.top_k_softmax(D.logits.df(spark, sf_dir), "row", 4, keep_ties=True).select("row", "token", F.round("p", 9).alias("p"))


def greedy_token(spark, sf_dir):
    return E.argmax(D.logits.df(spark, sf_dir), ["row"], "token", "logit").select("row", F.col("best").alias("token"))


def mc_prompt(spark, sf_dir):
    items = D.icl_mc.df(spark, sf_dir)
    shots = tasks.few_shot_pick(items, 2).join(items.select(F.col("idx").alias("other"), F.concat("query", F.lit(": "), F.get("choices", F.col("gold"))).alias("shown")), "other")
    grouped = shots.groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("shot", "shown"))), lambda x: x["shown"]).alias("shots"))  # k rows an item
    rows = items.join(grouped, "idx").select("idx", "shots", "query", F.posexplode("choices").alias("option", "choice"))
    return rows.select("idx", "option", F.md5(T.few_shot(F.col("shots"), F.concat("query", F.lit(": "), "choice"))).alias("digest"))


def schema_prompt(spark, sf_dir):
    rows = D.icl_schema.df(spark, sf_dir).select("idx", "continuation", F.posexplode("context_options").alias("option", "context"))
    return rows.select("idx", "option", T.few_shot(F.array(F.lit("A b"), F.lit("C d")), F.concat_ws(" ", "context", "continuation")).alias("prompt"))


def lm_prompt(spark, sf_dir):
    context = T.py_strip(F.col("context"))
    shot = F.array(F.lit("Shot one"))
    rows = D.icl_lm.df(spark, sf_dir)
    return rows.select("idx", T.py_strip(T.few_shot(shot, F.concat(context, F.lit(" ")))).alias("without"), T.few_shot(shot, F.concat(context, F.lit(" "), "continuation")).alias("with"))


def span_bounds(spark, sf_dir):
    """Start and end of the scored span: common prefix (choices), common suffix (schema),
    prefix length (language modelling), over byte tokens."""
    ids = T.byte_ids
    mc = D.icl_mc.df(spark, sf_dir).select("idx", F.transform("choices", lambda c: ids(F.concat("query", F.lit(" "), c), 256)).alias("t"))
    mc = mc.select("idx", F.lit("mc").alias("kind"), T.common_length(F.col("t")).alias("start"), F.posexplode(F.transform("t", F.size)).alias("option", "stop"))
    sc = D.icl_schema.df(spark, sf_dir).select("idx", F.transform("context_options", lambda c: ids(F.concat(c, F.lit(" "), "continuation"), 256)).alias("t"))
    sc = sc.select("idx", F.lit("schema").alias("kind"), T.common_length(F.col("t"), suffix=True).alias("n"), F.posexplode(F.transform("t", F.size)).alias("option", "stop")).select("idx", "kind", (F.col("stop") - F.col("n")).alias("start"), "option", "stop")
    lm = D.icl_lm.df(spark, sf_dir).select("idx", ids(T.py_strip(F.col("context")), 256).alias("a"), ids(F.concat(T.py_strip(F.col("context")), F.lit(" "), "continuation"), 256).alias("b"))
    lm = lm.where(F.slice("b", F.lit(1), F.size("a")) == F.col("a")).select("idx", F.lit("lm").alias("kind"), F.size("a").alias("start"), F.lit(0).alias("option"), F.size("b").alias("stop"))
    return mc.unionByName(sc).unionByName(lm)


def crop_spans(spark, sf_dir):
    """Keep the last n tokens and shift the span."""
    n = 12
    rows = D.icl_lm.df(spark, sf_dir).select("idx", T.byte_ids(F.concat_ws(" ", "context", "continuation"), 256).alias("t"), F.length("context").alias("start"))
    drop = F.greatest(F.size("t") - n, F.lit(0))
    return rows.select("idx", F.size(F.slice("t", drop + 1, F.lit(n))).alias("kept"), (F.col("start") - drop).alias("start"), F.get("t", drop).alias("head"))


def pad_stack(spark, sf_dir):
    rows = D.icl_lm.df(spark, sf_dir).select("idx", T.byte_ids(F.col("continuation"), 256).alias("ids"))
    return packing.pad_right(rows, 260).select("idx", F.size("ids").alias("n"), F.size(F.filter("ids", lambda x: x == 260)).alias("padded"))


def calculator(spark, sf_dir):
    return D.expressions.df(spark, sf_dir).select("idx", tools.calculator("expr").alias("value"))


def calculator_gate(spark, sf_dir):
    return D.expressions.df(spark, sf_dir).select("idx", tools.gate(F.col("expr")).alias("rule"))


def tool_replay(spark, sf_dir):
    ids = F.concat(T.byte_ids(F.lit("x")), F.array(F.lit(261)), T.byte_ids(F.lit("2*3")), F.array(F.lit(262)), T.byte_ids(F.lit("y")), F.array(F.lit(260)), T.byte_ids(F.lit("never")))
    rows = tools.tool_machine(spark.range(2).select(F.col("id").alias("idx"), ids.alias("ids")), {"python_start": 261, "python_end": 262, "output_start": 263, "output_end": 264, "assistant_end": 260, "bos": 256})
    return rows.select("idx", F.array_join(F.transform("tokens", lambda x: x.cast("string")), ",").alias("tokens"), F.array_join(F.transform("mask", lambda x: x.cast("string")), "").alias("mask"))


_BYTES = "list_transform(range(0, strlen({0})), lambda j: ('0x' || substr(hex(encode({0})), 2 * j + 1, 2))::INT)"
_NUM = "replace(nullif(regexp_extract({0}, '#### (\\-?[0-9\\.\\,]+)', 1), ''), ',', '')"
_OPT = f"""WITH {D.scores.cte('s')}, n AS (SELECT *, lead(token) OVER (PARTITION BY task, idx, option ORDER BY pos) AS nx FROM s),
o AS (SELECT task, kind, idx, option, gold, avg(loss) AS mean_loss, bool_and(pred = nx) AS exact FROM n WHERE pos >= start - 1 AND pos < stop - 1 GROUP BY ALL),
x AS (SELECT task, idx, CASE WHEN any_value(kind) = 'language_modeling' THEN bool_and(exact) ELSE arg_min(option, (mean_loss, option)) = any_value(gold) END AS ok FROM o GROUP BY task, idx),
a AS (SELECT task, avg(ok::DOUBLE) AS accuracy, count(*) AS n FROM x GROUP BY task)"""
_PY = "||".join(f"chr({ord(c)})" for c in T.PY_SPACE)
_COMMON = "coalesce(list_min(list_filter(range(0, list_min(list_transform({0}, lambda y: len(y)))), lambda k: len(list_distinct(list_transform({0}, lambda y: y[k + 1]))) > 1)), list_min(list_transform({0}, lambda y: len(y))))"

QUERIES = {
    "unigram_bpb": (
        unigram_bpb,
        f"""
WITH d AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, text AS t FROM documents),
b AS (SELECT split, unnest({_BYTES.format('t')}) AS x FROM d), c AS (SELECT split, x, count(*) AS n FROM b GROUP BY ALL),
t AS (SELECT x, n AS c FROM c WHERE split = 'train'), m AS (SELECT sum(c) AS total FROM t)
SELECT split, round(sum(-ln((coalesce(t.c, 0) + 1) / (total + 256)) * n) / (ln(2) * sum(n)), 9)::DOUBLE AS bpb, sum(n)::BIGINT AS bytes FROM c LEFT JOIN t USING (x), m GROUP BY split""",
    ),
    "masked_bpb": (
        masked_bpb,
        f"""WITH {D.loss_tokens.cte('s')}, b AS (SELECT *, CASE WHEN target < 0 OR target >= 256 THEN 0 WHEN target < 128 THEN 1 ELSE 3 END AS n FROM s),
g AS (SELECT split, sum(n)::BIGINT AS bytes, sum(CASE WHEN n > 0 THEN loss ELSE 0 END) AS nats FROM b GROUP BY split)
SELECT split, bytes, round(nats, 9)::DOUBLE AS nats, CASE WHEN bytes > 0 THEN round(nats / (ln(2) * bytes), 9) ELSE 'infinity'::DOUBLE END::DOUBLE AS bpb FROM g""",
    ),
    "mean_outcome": (mean_outcome, f"WITH {D.completions.cte('s')}, o AS (SELECT task, idx, bool_or({_NUM.format('text')} IS NOT DISTINCT FROM {_NUM.format('reference')}) AS ok FROM s GROUP BY task, idx) SELECT task, avg(ok::DOUBLE)::DOUBLE AS accuracy, count(*)::BIGINT AS n FROM o GROUP BY task"),
    "generative_eval": (generative_eval, f"WITH {D.completions.cte('s')}, i AS (SELECT task, idx, min(reference) AS reference FROM s GROUP BY ALL), o AS (SELECT task, idx, bool_or({_NUM.format('s.text')} IS NOT DISTINCT FROM {_NUM.format('i.reference')}) AS ok FROM i JOIN s USING (task, idx) GROUP BY task, idx) SELECT task, avg(ok::DOUBLE)::DOUBLE AS accuracy, count(*)::BIGINT AS n FROM o GROUP BY task"),
    "sampled_ids": (
        sampled_ids,
        """WITH n AS (SELECT *, lag(role) OVER w AS pr, lag(text) OVER w AS pt, row_number() OVER w AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT conv_id, turn, role, strlen(CASE WHEN k = 2 AND pr = 'system' THEN pt || chr(10) || chr(10) || text ELSE text END) AS b FROM n WHERE NOT (k = 1 AND role = 'system')),
f AS (SELECT conv_id, min(turn) FILTER (role <> 'user') AS t FROM r GROUP BY conv_id)
SELECT conv_id, (2 + coalesce(sum(b + 2) FILTER (turn < t), 0))::INT AS prompt_len, any_value(b) FILTER (turn = t)::INT AS n_sampled FROM r JOIN f USING (conv_id) WHERE t IS NOT NULL GROUP BY conv_id""",
    ),
    "gsm_answer_match": (gsm_answer_match, f"WITH {D.completions.cte('s')} SELECT task, idx, sample_idx, {_NUM.format('text')} AS got, {_NUM.format('text')} IS NOT DISTINCT FROM {_NUM.format('reference')} AS is_correct, CASE WHEN {_NUM.format('text')} IS NOT DISTINCT FROM {_NUM.format('reference')} THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM s"),
    "icl_accuracy": (icl_accuracy, f"{_OPT} SELECT task, accuracy::DOUBLE AS accuracy, n::BIGINT AS n FROM a"),
    "span_losses": (span_losses, f"{_OPT} SELECT task, idx, option, round(mean_loss, 9)::DOUBLE AS mean_loss, exact FROM o"),
    "core_metric": (core_metric, f"{_OPT}, {X.eval_meta.cte('m')}, c AS (SELECT task, (accuracy - 0.01 * random_baseline) / (1 - 0.01 * random_baseline) AS c FROM a JOIN m USING (task)) SELECT task, round(c, 9)::DOUBLE AS centered FROM c UNION ALL SELECT 'CORE', round(avg(c), 9)::DOUBLE FROM c"),
    "missing_baselines": (missing_baselines, f"WITH {D.scores.cte('s')}, {X.eval_meta.cte('m')} SELECT task FROM m WHERE task NOT IN (SELECT task FROM s)"),
    "chat_core": (
        chat_core,
        f"""WITH {X.chat_results.cte('r')}, {X.chat_meta.cte('m')}, c AS (SELECT task, (accuracy - coalesce(baseline, 0)) / (1 - coalesce(baseline, 0)) AS c FROM r LEFT JOIN m USING (task))
SELECT CASE WHEN count(DISTINCT task) = 6 THEN round(avg(c), 9) END::DOUBLE AS chatcore, round(avg(c) FILTER (task IN ('ARC-Easy', 'ARC-Challenge', 'MMLU')), 9)::DOUBLE AS chatcore_cat FROM c""",
    ),
    "pass_at_k": (pass_at_k, f"WITH {D.rollouts.cte('s')}, p AS (SELECT sample_idx + 1 AS k, bool_or(reward > 0) OVER (PARTITION BY idx ORDER BY sample_idx) AS hit FROM s) SELECT k::INT AS k, avg(hit::DOUBLE)::DOUBLE AS pass_at_k FROM p GROUP BY k"),
    "advantages": (advantages, f"WITH {D.rollouts.cte('s')} SELECT idx, sample_idx, round(reward - avg(reward) OVER (PARTITION BY idx), 9)::DOUBLE AS advantage FROM s"),
    "rank_means": (rank_means, f"WITH {D.rollouts.cte('s')}, p AS (SELECT rank, avg(reward) AS r, avg(length) AS n FROM s GROUP BY rank) SELECT round(avg(r), 9)::DOUBLE AS reward, round(avg(n), 9)::DOUBLE AS length FROM p"),
    "policy_objective": (policy_objective, f"WITH {D.rollouts.cte('s')}, a AS (SELECT length % 5 - 1 AS t, -0.1 * length AS lp, reward - avg(reward) OVER (PARTITION BY idx) AS adv FROM s) SELECT round(sum(CASE WHEN t <> -1 THEN lp * adv ELSE 0 END) / greatest(count(*) FILTER (t <> -1), 1), 9)::DOUBLE AS objective FROM a"),
    "letter_argmax": (letter_argmax, f"WITH {D.letter_logits.cte('s')}, k AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY logit DESC, letter) AS r FROM s) SELECT idx, letter, letter = gold AS is_correct FROM k WHERE r = 1"),
    "topk_softmax": (topk_softmax, f"WITH {D.logits.cte('s')}, k AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY logit DESC, token) AS r FROM s), e AS (SELECT row, token, exp((logit - max(logit) OVER (PARTITION BY row)) / 0.8) AS e FROM k WHERE r <= 4) SELECT row, token, round(e / sum(e) OVER (PARTITION BY row), 9)::DOUBLE AS p FROM e"),
    "topk_with_ties": (topk_with_ties, f"WITH {D.logits.cte('s')}, k AS (SELECT *, rank() OVER (PARTITION BY row ORDER BY logit DESC) AS r FROM s), e AS (SELECT row, token, exp(logit - max(logit) OVER (PARTITION BY row)) AS e FROM k WHERE r <= 4) SELECT row, token, round(e / sum(e) OVER (PARTITION BY row), 9)::DOUBLE AS p FROM e"),
    "greedy_token": (greedy_token, f"WITH {D.logits.cte('s')}, k AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY logit DESC, token) AS r FROM s) SELECT row, token FROM k WHERE r = 1"),
    "mc_prompt": (
        mc_prompt,
        f"""WITH {D.icl_mc.cte('s')}, {few_shot_sql(2)},
h AS (SELECT p.idx, string_agg(s.query || ': ' || s.choices[s.gold + 1] || chr(10) || chr(10), '' ORDER BY shot) AS shots FROM p JOIN s ON s.idx = p.other GROUP BY p.idx),
c AS (SELECT idx, query, unnest(choices) AS choice, unnest(range(0, len(choices))) AS option FROM s)
SELECT idx, option::INT AS option, md5(shots || query || ': ' || choice) AS digest FROM c JOIN h USING (idx)""",
    ),
    "schema_prompt": (schema_prompt, f"WITH {D.icl_schema.cte('s')} SELECT idx, option::INT AS option, 'A b' || chr(10) || chr(10) || 'C d' || chr(10) || chr(10) || context || ' ' || continuation AS prompt FROM (SELECT idx, continuation, unnest(context_options) AS context, unnest(range(0, len(context_options))) AS option FROM s)"),
    "lm_prompt": (lm_prompt, f"WITH {D.icl_lm.cte('s')}, c AS (SELECT idx, 'Shot one' || chr(10) || chr(10) || trim(context, {_PY}) AS c, continuation FROM s) SELECT idx, trim(c, {_PY}) AS without, c || ' ' || continuation AS \"with\" FROM c"),
    "span_bounds": (
        span_bounds,
        f"""WITH {D.icl_mc.cte('m')}, {D.icl_schema.cte('c')}, {D.icl_lm.cte('l')},
mt AS (SELECT idx, list_transform(choices, lambda x: list_concat([256], {_BYTES.format("(query || ' ' || x)")})) AS t FROM m),
ct AS (SELECT idx, list_transform(context_options, lambda x: list_concat([256], {_BYTES.format("(x || ' ' || continuation)")})) AS t FROM c),
cr AS (SELECT idx, t, list_transform(t, lambda x: list_reverse(x)) AS v FROM ct),
mo AS (SELECT idx, {_COMMON.format('t')} AS n, unnest(t) AS x, unnest(range(0, len(t))) AS option FROM mt),
co AS (SELECT idx, {_COMMON.format('v')} AS n, unnest(t) AS x, unnest(range(0, len(t))) AS option FROM cr)
SELECT idx, 'mc' AS kind, n::INT AS start, option::INT AS option, len(x)::INT AS stop FROM mo
UNION ALL SELECT idx, 'schema', (len(x) - n)::INT, option::INT, len(x)::INT FROM co
UNION ALL SELECT idx, 'lm', (1 + strlen(trim(context, {_PY})))::INT, 0, (2 + strlen(trim(context, {_PY})) + strlen(continuation))::INT FROM l""",
    ),
    "crop_spans": (crop_spans, f"WITH {D.icl_lm.cte('s')}, t AS (SELECT idx, list_concat([256], {_BYTES.format('x')}) AS t, n FROM (SELECT idx, context || ' ' || continuation AS x, length(context) AS n FROM s)) SELECT idx, least(len(t), 12)::INT AS kept, (n - greatest(len(t) - 12, 0))::INT AS start, t[greatest(len(t) - 12, 0) + 1]::INT AS head FROM t"),
    "pad_stack": (pad_stack, f"WITH {D.icl_lm.cte('s')}, n AS (SELECT idx, strlen(continuation) + 1 AS n FROM s) SELECT idx, (SELECT max(n) FROM n)::INT AS n, ((SELECT max(n) FROM n) - n)::INT AS padded FROM n"),
    "calculator": (
        calculator,
        f"""WITH {D.expressions.cte('s')}, p AS (SELECT idx, expr, idx % 8 AS k, try_cast(regexp_extract(replace(expr, ',', ''), '[0-9]+') AS BIGINT) AS n FROM s)
SELECT idx, CASE k WHEN 0 THEN (n + 1)::VARCHAR WHEN 2 THEN '3' WHEN 4 THEN ((n + 2) * 3 - 4)::VARCHAR END AS value FROM p""",
    ),
    "calculator_gate": (
        calculator_gate,
        f"""WITH {D.expressions.cte('s')}, e AS (SELECT idx, replace(expr, ',', '') AS e FROM s), g AS (SELECT idx, e, regexp_full_match(e, '[0-9*+\\-/.() ]*') AS a FROM e)
SELECT idx, CASE WHEN a AND NOT contains(e, '**') THEN 'arithmetic' WHEN NOT a AND regexp_full_match(e, '[A-Za-z0-9''"()._ ]*') AND NOT regexp_matches(lower(e), '__|import|exec|eval|compile|open|file|input|globals|locals|vars|dir|getattr|setattr|delattr|hasattr') AND contains(e, '.count(') THEN 'count' ELSE 'none' END AS rule FROM g""",
    ),
    "tool_replay": (tool_replay, "SELECT i::BIGINT AS idx, '120,261,50,42,51,262,263,54,264,121' AS tokens, '1111110001' AS mask FROM range(2) t(i)"),
}
