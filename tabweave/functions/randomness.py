"""Counter-based randomness.

Every random number is a hash of (seed, tag, key), where the key is a row id
or a block number.  Nothing depends on partitioning, task order or retries: a
lost executor recomputes exactly the rows it lost.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from tabweave.functions.text import Sql, double, sql, string

TWO_52 = float(1 << 52)


@dataclass(frozen=True)
class Rng:
    """Uniform and normal draws as SQL text.

    ``portable=True`` hashes with MD5, which any SQL engine can reproduce;
    the default uses xxhash64 and is several times faster.
    """

    seed: int = 42
    portable: bool = False

    def uniform(self, key: Sql, tag: str) -> Sql:
        """A double strictly inside (0, 1), independent for each (seed, tag, key)."""
        if self.portable:
            text = f"concat({string(f'{self.seed}:{tag}:')}, cast({key} as string))"
            bits = f"cast(cast(conv(substring(md5({text}), 1, 13), 16, 10) as bigint) as double)"
        else:
            salt = hashlib.md5(f"{self.seed}:{tag}".encode()).digest()[:8]
            salt = int.from_bytes(salt, "big", signed=True)
            bits = f"shiftrightunsigned(xxhash64({salt}L, {key}), 12)"
            if salt == -(1 << 63):  # has no literal of its own
                bits = bits.replace(f"{salt}L", f"({salt + 1}L - 1L)")
        return f"(({bits} + 0.5D) * {double(1.0 / TWO_52)})"

    def polar(self, key: Sql, tag: str) -> tuple[Sql, Sql]:
        """Radius and angle of a bivariate standard normal (Box-Muller).

        ``radius * cos(angle)`` and ``radius * sin(angle)`` are two independent
        standard normals, so d columns cost d uniforms.
        """
        # ln of a number in (0, 1) is never null; coalesce says so and keeps
        # null checks out of the generated code
        radius = f"sqrt(-2.0D * coalesce(ln({self.uniform(key, tag + '/r')}), 0.0D))"
        return radius, f"{self.uniform(key, tag + '/a')} * {double(2.0 * math.pi)}"

    def normal(self, key: Sql, tag: str) -> Sql:
        """One standard normal."""
        radius, angle = self.polar(key, tag)
        return f"({radius} * cos({angle}))"


def between(u: Sql, low: float | Sql, high: float | Sql) -> Sql:
    """Rescale a (0, 1) uniform to (low, high)."""
    low, high = sql(low), sql(high)
    return f"({low} + ({high} - {low}) * {u})"
