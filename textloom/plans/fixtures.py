"""Small inline relations, as DataFrames and as SQL for the oracle.

One Python list of rows serves both engines, so a query and its oracle cannot drift.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SQL = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(_literal(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"'{k}': {_literal(v)}" for k, v in value.items()) + "}"
    return repr(value)


def _type(kind: str) -> str:
    if kind.startswith("array<"):
        return _type(kind[6:-1]) + "[]"
    if kind.startswith("struct<"):
        return "STRUCT(" + ", ".join(f"{n} {_type(t)}" for n, t in (x.split(":") for x in kind[7:-1].split(","))) + ")"
    return _SQL[kind]


class Fixture:
    def __init__(self, schema: str, rows: list[tuple]) -> None:
        self.columns = [c.split(" ", 1) for c in schema.split("; ")]
        self.rows = rows

    def df(self, spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
        return spark.createDataFrame(self.rows, ", ".join(f"{n} {t}" for n, t in self.columns))

    def cte(self, name: str) -> str:
        """`name AS (...)` for a WITH clause."""
        casts = ", ".join(f"CAST({n} AS {_type(t)}) AS {n}" for n, t in self.columns)
        values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in self.rows)
        return f"{name} AS (SELECT {casts} FROM (VALUES {values}) AS t({', '.join(n for n, _ in self.columns)}))"


eval_meta = Fixture("task string; random_baseline double", [("arc_easy", 25.0), ("copa", 50.0), ("lambada", 0.0), ("unused", 10.0)])
chat_meta = Fixture("task string; baseline double", [("ARC-Easy", 0.25), ("ARC-Challenge", 0.25), ("MMLU", 0.25), ("GSM8K", 0.0), ("HumanEval", 0.0), ("SpellingBee", 0.0)])
chat_results = Fixture("task string; accuracy double", [("ARC-Easy", 0.61), ("ARC-Challenge", 0.47), ("MMLU", 0.36), ("GSM8K", 0.08), ("HumanEval", 0.1), ("SpellingBee", 0.98)])
sections = Fixture("file string; body string", [("base-model-evaluation.md", "## Base model evaluation\ntimestamp: 2025-10-13 18:00:00\n\n- CORE metric: 0.2219\n- CORE: 0.2220\n"), ("chat-evaluation-sft.md", "## Chat\ntimestamp: 2025-10-13 20:14:30\n\n- MMLU: 0.3512\n- GSM8K: 0.0765\n- ChatCORE metric: 0.27\n"), ("chat-evaluation-rl.md", "timestamp: 2025-10-13 23:00:00\n- GSM8K: 0.1523\n"), ("header.md", "Run started: 2025-10-13 16:30:15\n")])
devices = Fixture("device string; count int", [("NVIDIA H100 80GB HBM3", 8), ("NVIDIA H100 NVL", 2), ("NVIDIA A100-SXM4-40GB", 4), ("AMD MI300X", 8), ("GeForce RTX 4090", 1), ("Tesla V100", 2), ("NVIDIA L40S", 1), ("Mystery", 3)])
# Fixed table: name patterns (all must occur) and peak FLOP/s, first match wins.
peak_flops = Fixture(
    "ord int; patterns array<string>; flops double",
    [
        (i, p, f)
        for i, (p, f) in enumerate(
            [
                (["gb200"], 2.5e15), (["grace blackwell"], 2.5e15), (["b200"], 2.25e15), (["b100"], 1.8e15), (["h200", "nvl"], 836e12), (["h200", "pcie"], 836e12), (["h200"], 989e12), (["h100", "nvl"], 835e12), (["h100", "pcie"], 756e12), (["h100"], 989e12), (["h800", "nvl"], 989e12), (["h800"], 756e12),
                (["a100"], 312e12), (["a800"], 312e12), (["a40"], 149.7e12), (["a30"], 165e12), (["l40s"], 362e12), (["l40-s"], 362e12), (["l40 s"], 362e12), (["l4"], 121e12), (["mi355"], 2.5e15), (["mi325"], 1.3074e15), (["mi300x"], 1.3074e15), (["mi300a"], 980.6e12), (["mi250x"], 383e12), (["mi250"], 362.1e12),
                (["5090"], 209.5e12), (["4090"], 165.2e12), (["3090"], 71e12),
            ]
        )
    ],
)
# Fixed table: price of an hour by device name, first match wins.
hourly_rates = Fixture("ord int; name string; rate double", [(0, "H100", 3.0), (1, "A100", 1.79), (2, "V100", 0.55)])
programs = Fixture("idx long; prompt string; completion string; test string; entry_point string", [(0, "import os\n# note\nfrom math import pi\n\ndef f(x):\n", "Sure:\n```python\ndef f(x):\n    return x + 1\n```\ndone", "def check(g):\n    assert g(1) == 2", "f"), (1, "def g():\n  pass\nimport late\n", "  def g():\n    return 3\n", "def check(g):\n    assert g() == 3", "g")])
