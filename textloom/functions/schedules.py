"""Training horizon, schedules and throughput as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reference batch size and exponent of the batch-size law (fixed values).
B_REF, BATCH_POWER = 2**19, 0.383


def lr_base(step: Column, n: int, warmup: int, warmdown_ratio: float, final: float) -> Column:
    """Linear warmup, constant, linear warmdown over absolute steps."""
    down = round(warmdown_ratio * n)
    progress = (F.lit(n) - step) / F.lit(float(max(down, 1)))
    return F.when(step < warmup, (step + 1) / float(max(warmup, 1))).when(step <= n - down, 1.0).otherwise(progress + (1 - progress) * final)


def lr_sft(progress: Column, warmup: float, warmdown: float, final: float) -> Column:
    decay = (progress - (1.0 - warmdown)) / warmdown
    return F.when(progress < warmup, (progress + 1e-8) / warmup).when(progress <= 1.0 - warmdown, 1.0).otherwise((1 - decay) + decay * final)


def lr_rl(step: Column, n: int) -> Column:
    return 1.0 - step / float(n)


def momentum_base(step: Column, n: int, warmdown_ratio: float) -> Column:
    down = round(warmdown_ratio * n)
    up, fall = step / 400.0, (step - (n - down)) / float(max(down, 1))
    return F.when(step < 400, (1 - up) * 0.85 + up * 0.97).when(step >= n - down, 0.97 * (1 - fall) + 0.90 * fall).otherwise(0.97)


def momentum_sft(step: Column) -> Column:
    up = F.least(step / 300.0, F.lit(1.0))
    return (1 - up) * 0.85 + up * 0.95


def weight_decay(step: Column, n: int, base: float) -> Column:
    return base * 0.5 * (1 + F.cos(F.lit(math.pi) * step / float(n)))


def horizon(params: Column, ratio: Column, reference_params: Column, decay: Column) -> dict[str, Column]:
    """Target tokens, batch size (a power of two, half-even), scales and iterations."""
    target = F.floor(ratio * params)
    reference = ratio * reference_params
    batch = F.pow(F.lit(2.0), F.bround(F.log2(B_REF * F.pow(target / reference, F.lit(BATCH_POWER))), 0))
    return {"target_tokens": target.cast("long"), "batch_size": batch.cast("long"), "lr_scale": F.sqrt(batch / B_REF), "decay_scaled": decay * F.sqrt(batch / B_REF) * reference / target, "iterations": F.floor(target / batch).cast("long")}


def window_sizes(layers: int, pattern: str, context: int) -> list[int]:
    """Attention window of each layer: the pattern repeats, S is a quarter rounded up to
    128, the last layer sees all."""
    short = -(-context // 4 // 128) * 128
    return [context if pattern[i % len(pattern)].upper() == "L" or i == layers - 1 else short for i in range(layers)]
