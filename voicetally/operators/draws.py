"""Random draws by counter: the number of a draw and a key give its value, so draws need no order, no state and no partitions, and
any engine with whole numbers of 64 bits can make the same ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE = 1 << 32
STEP, MIX = 0x9E3779B1, 0x45D9F3B


def base(*key: Column | str) -> Column:
    """32 bits of the key's MD5, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key])), 1, 8), 16, 10).cast("long")


def uniform(of: str, draw: str) -> Column:
    """A whole number below 2**32 from two columns, base and draw: a step by draw, mixed three times (the last one only folds)."""
    x = f"(({of} + {draw} * {STEP}L) % {SIZE}L)"
    for _ in range(2):
        x = f"((({x} ^ shiftright({x}, 16)) * {MIX}L) % {SIZE}L)"
    return F.expr(f"({x} ^ shiftright({x}, 16))")


def block(of: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """uniform() of each of the bases (rows) and draws (columns), whose steps, draw * STEP, are given; 32 bits wrap by themselves."""
    x = of[:, None] + steps[None, :]
    for _ in range(2):
        x ^= x >> np.uint32(16)
        x *= np.uint32(MIX)
    x ^= x >> np.uint32(16)
    return x


def base_sql(key: str) -> str:
    return f"('0x' || md5({key})[1:8])::BIGINT"


def uniform_sql(of: str, draw: str) -> str:
    x = f"(({of} + {draw} * {STEP}) % {SIZE})"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * {MIX}) % {SIZE})"
    return f"xor({x}, {x} >> 16)"
