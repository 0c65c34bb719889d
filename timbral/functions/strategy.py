"""Augmentation strategies: named mixes, validated when registered, and any {int}x on demand."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The corpus' shares of types, noises, rooms and ranges of SNR in dB.
TYPE_MIX = {"rir": 0.6, "codec": 0.3, "rawboost": 0.1}
NOISE_MIX = {"noise": 0.5, "speech": 0.3, "music": 0.2}
ROOM_MIX = {"smallroom": 0.3, "mediumroom": 0.5, "largeroom": 0.2}
SNR_RANGES = ((0.0, 5.0, 0.1), (5.0, 30.0, 0.8), (30.0, 35.0, 0.1))


@dataclass(frozen=True)
class Strategy:
    """factor counts extra copies in planned sizes, and rows with the original in a fan-out."""

    name: str
    factor: int
    types: dict[str, float] = field(default_factory=lambda: dict(TYPE_MIX))
    noises: dict[str, float] = field(default_factory=lambda: dict(NOISE_MIX))
    rooms: dict[str, float] = field(default_factory=lambda: dict(ROOM_MIX))
    snr: tuple[tuple[float, float, float], ...] = SNR_RANGES

    def validate(self) -> None:
        for what, total in (("types", sum(self.types.values())), ("noises", sum(self.noises.values())), ("rooms", sum(self.rooms.values())), ("snr", sum(p for *_, p in self.snr))):
            if abs(total - 1) >= 0.01:
                raise ValueError(f"{self.name}: the shares of {what} sum to {total}")

    def rows(self) -> dict[str, list[tuple]]:
        """Choices with running totals of their shares; a total's rounding error is cut off."""
        out, ranges, total = {}, [], 0.0
        for what, mix in (("types", self.types), ("rooms", self.rooms), ("noises", self.noises)):
            upto, out[what] = 0.0, []
            for value, share in mix.items():
                upto = round(upto + share, 9)
                out[what].append((value, upto))
        for low, high, share in self.snr:
            total = round(total + share, 9)
            ranges.append((float(low), float(high), total))
        return out | {"snr": ranges}

    def planned(self, n: int) -> dict[str, int]:
        extra = n * self.factor
        return {"originals": n, "total": n + extra} | {k: int(extra * p) for k, p in self.types.items()}


#: Strategies that one table may hold: they come from the driver and are broadcast.
MOST = 10_000
CHOICES = "array<struct<value: string, upto: double>>"
SCHEMA = f"strategy string, extra long, types {CHOICES}, rooms {CHOICES}, noises {CHOICES}, snr array<struct<low: double, high: double, upto: double>>"


class Mixes:
    """The choices of augmented rows, of one strategy for all or of a table of strategies by name."""

    def __init__(self, spark: SparkSession | None = None, strategies: list[Strategy] | None = None) -> None:
        known = strategies or [Strategy("default", 3)]
        for s in known:
            s.validate()
        if len(known) > MOST or len({s.name for s in known}) < len(known):
            raise ValueError(f"at most {MOST} strategies, each with a name of its own")
        rows = [s.rows() for s in known]
        self.sizes = {what: max(len(r[what]) for r in rows) for what in rows[0]}
        self.one = rows[0] if strategies is None else None
        self.table = None if strategies is None else spark.createDataFrame([(s.name, s.factor, *r.values()) for s, r in zip(known, rows, strict=True)], SCHEMA)

    def attach(self, rows: DataFrame) -> DataFrame:
        """rows with their strategy's choices as `_mix`; a strategy that isn't in the table is an error. rows of one strategy stay as they are."""
        if self.table is None:
            return rows
        side = F.broadcast(self.table.select(F.col("strategy").alias("_s"), F.struct("types", "rooms", "noises", "snr").alias("_mix")))
        met = rows.join(side, rows["strategy"] == side["_s"], "left").drop("_s")
        return met.withColumn("_mix", F.coalesce("_mix", F.raise_error(F.concat(F.lit("unknown strategy "), F.coalesce("strategy", F.lit("null")))).cast(met.schema["_mix"].dataType)))

    def _pick(self, u: Column, what: str, of: callable) -> Column:
        """of(entry) of the first entry whose running total is above u; the last one takes the rest."""
        if self.one is not None:
            entries, last = self.one[what][:-1], of(self.one[what][-1])
            out = None
            for e in entries:
                out = F.when(u < e[-1], of(e)) if out is None else out.when(u < e[-1], of(e))
            return last if out is None else out.otherwise(last)
        listed = F.col(f"_mix.{what}")
        last, out = of(F.element_at(listed, -1)), None
        for i in range(self.sizes[what] - 1):  # a shorter list has nulls here, which are never above u
            e = F.get(listed, F.lit(i))
            out = F.when(u < e["upto"], of(e)) if out is None else out.when(u < e["upto"], of(e))
        return last if out is None else out.otherwise(last)

    def choose(self, u: Column, what: str) -> Column:
        return self._pick(u, what, lambda e: F.lit(e[0]) if isinstance(e, tuple) else e["value"])

    def snr(self, u: Column, v: Column) -> Column:
        """A mixture of uniforms: u chooses the range, v the place in it."""
        return self._pick(u, "snr", lambda e: F.lit(e[0]) + v * F.lit(e[1] - e[0]) if isinstance(e, tuple) else e["low"] + v * (e["high"] - e["low"]))


class Registry:
    def __init__(self) -> None:
        self.known: dict[str, Strategy] = {}
        for k in (3, 5, 10):
            self.register(f"{k}x", Strategy(f"{k}x", k))

    def register(self, name: str, strategy: Strategy) -> None:
        strategy.validate()
        self.known[name] = strategy

    def get(self, name: str) -> Strategy:
        """A registered strategy, or one made for {int}x; a factor that isn't a number is a ValueError, another name a KeyError."""
        if name in self.known:
            return self.known[name]
        if not name.endswith("x"):
            raise KeyError(name)
        if not re.fullmatch(r"[+-]?[0-9]+x", name):
            raise ValueError(f"not a factor: {name}")
        return Strategy(name, int(name[:-1]))


    def mixes(self, spark: SparkSession, names: list[str]) -> Mixes:
        """The table of these strategies, for a run that mixes them."""
        return Mixes(spark, [self.get(n) for n in names])


def check_arguments(ratio: float, factors: list[str]) -> list[str]:
    """What is wrong with a batch's arguments; nothing if all is well."""
    wrong = [] if 0 < ratio < 1 else [f"ratio {ratio} isn't between 0 and 1"]
    return wrong + [f"factor {f} isn't {{int}}x" for f in factors if not re.fullmatch(r"[0-9]+x", f)]
