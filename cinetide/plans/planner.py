"""The cost model and the choice of a plan (L10, L11, F11, H5): expressions over video, device and benchmark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinetide.functions import scalars as S

LONGEST_CLOUD_MS = 12 * 60_000
BUDGET_S = 30 * 60.0


def ms_per_tile(tile: Column, model: Column, gpu: Column, high_end: Column, measured: Column | None = None) -> Column:
    """The measured time of a tile, else 45 ms at 128 x 128 and cost 1, four times that without a GPU, 1.6 times at the low end."""
    guess = F.lit(45.0) * (tile * tile) / (128.0 * 128.0) * S.relative_cost(model)
    guess = guess * F.when(gpu, 1.0).otherwise(4.0) * F.when(high_end, 1.0).otherwise(1.6)
    return guess if measured is None else F.coalesce(measured, guess)


def tile_milliseconds(runs: DataFrame, keys: list[str], run: str = "run", ms: str = "ms", tiles: str = "tiles", timed: int = 2) -> DataFrame:
    """F16: the mean time of a tile: run 0 warms up, and the next `timed` runs count."""
    rows = runs.where((F.col(run) >= 1) & (F.col(run) <= timed))
    return rows.groupBy(*keys).agg((F.avg(ms) / F.max(tiles)).alias("ms_per_tile"))


def with_measured(rows: DataFrame, bench: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `measured`, the benchmark's ms_per_tile for the row's model and device, null if there is none."""
    return rows.join(bench.select(*keys, F.col("ms_per_tile").alias("measured")), keys, "left")


def estimated_seconds(v: dict[str, Column], preset: Column, model: Column, compute: Column) -> Column:
    """L11 for columns width, height, fps, duration_ms, tile, gpu, high_end, cloud_up and measured (or none).

    Tiles are those that the model really runs on, and a second pass counts only if there is one.
    """
    seconds = v["duration_ms"] / 1000.0
    tile = S.effective_tile(v["tile"], model)
    cost = ms_per_tile(tile, model, v["gpu"], v["high_end"], v.get("measured"))
    frames = seconds * v["fps"] * F.when(preset == "BALANCED", 0.75).otherwise(1.0)
    first = S.tiles(v["width"], v["height"], tile)
    second = F.when((preset == "ULTRA") & (S.passes(preset, v["width"], v["height"]) == 2), S.tiles(v["width"] * 4, v["height"] * 4, tile)).otherwise(0)
    total = frames * (first + second) * cost / 1000.0
    return (
        F.when(preset == "FAST", F.greatest(seconds * 0.15, F.lit(2.0)))
        .when((compute == "HYBRID") & v["cloud_up"], total * 0.6 + 8)
        .when((compute == "CLOUD") & v["cloud_up"], seconds * F.when(model == "ULTRA_PLUS", 3.0).otherwise(1.2) + 40)
        .otherwise(total * 1.1 + 5)
    )


def target_for(reach: Column) -> Column:
    """H5: the smallest target that reaches the short side, else the largest."""
    out = F.lit("P2160")
    for name, height in sorted(S.TARGETS.items(), key=lambda x: -x[1]):
        if 0 < height < 2160:
            out = F.when(reach <= height, name).otherwise(out)
    return out


def plan(v: dict[str, Column], recommended: Column, heavy_ready: Column) -> Column:
    """Struct compute, preset, model, target.

    Cloud if it is up and the clip short; else two passes if they fit in 4K and
    the budget; else the heavy model if it is there and fits; else one pass.
    """
    short, long = F.least(v["width"], v["height"]), F.greatest(v["width"], v["height"])
    option = lambda compute, preset, model, reach: F.struct(
        F.lit(compute).alias("compute"), F.lit(preset).alias("preset"), model.alias("model"), target_for(reach).alias("target")
    )
    heavy = F.lit("ULTRA_PLUS")
    seconds = lambda preset, model: estimated_seconds(v, F.lit(preset), model, F.lit("DEVICE"))
    return (
        F.when(v["cloud_up"] & (v["duration_ms"] <= LONGEST_CLOUD_MS), option("CLOUD", "HIGH", F.when(heavy_ready, heavy).otherwise(recommended), short * 4))
        .when((long * 16 <= S.LONGEST_SIDE) & (seconds("ULTRA", recommended) <= BUDGET_S), option("DEVICE", "ULTRA", recommended, short * 16))
        .when(heavy_ready & (seconds("HIGH", heavy) <= BUDGET_S), option("DEVICE", "HIGH", heavy, short * 4))
        .otherwise(option("DEVICE", "HIGH", recommended, short * 4))
    )


def selection_seconds(items: DataFrame, keys: list[str], seconds: str = "seconds") -> DataFrame:
    """the time of each selection in whole seconds; the items' durations are those of scalars.trimmed_ms()."""
    return items.groupBy(*keys).agg(F.floor(F.round(F.sum(seconds), 3)).cast("long").alias("seconds"))  # sums in another order agree
