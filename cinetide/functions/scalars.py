"""Scalar expressions over frame, job and text columns: built-in functions only.

Every function takes and returns columns, so Catalyst folds, prunes and compiles
them with whatever they stand in.  The names follow the inventory: luma and
colour (C5-C10), geometry and sizes (B2, C15-C19, C23-C31), progress and names
(C20-C22, C36), decoding with defaults (C28-C30, C33, C35, C37, C38).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enumerations and their defaults.
MODELS = ("NATURAL", "GENERAL", "GENERAL_DENOISE", "ANIME", "ULTRA_PLUS")
TARGETS = {"AUTO": 0, "P480": 480, "P720": 720, "P1080": 1080, "P1440": 1440, "P2160": 2160}
PRESETS = ("ULTRA", "HIGH", "BALANCED", "FAST")
COLOURS = ("OFF", "AUTO", "VIVID")
COMPUTES = ("DEVICE", "HYBRID", "CLOUD")
DEFAULTS = {"model": "NATURAL", "target": "AUTO", "preset": "BALANCED", "color": "OFF", "compute": "DEVICE"}
# Relative cost of a model's tile, its remote name, and limits.
RELATIVE_COST = {"NATURAL": 1.0, "GENERAL": 1.0, "GENERAL_DENOISE": 1.0, "ANIME": 0.25, "ULTRA_PLUS": 8.0}
REMOTE_NAME = {"NATURAL": "natural", "GENERAL": "general", "GENERAL_DENOISE": "denoise", "ANIME": "anime", "ULTRA_PLUS": "heavy"}
LONGEST_SIDE = 4096
OVERLAP = 8


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x: Column, low, high) -> Column:
    """Nulls stay null, unlike with greatest() and least() alone."""
    x = _col(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high) if not isinstance(high, Column) else high), F.lit(low) if not isinstance(low, Column) else low))


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = clamp((_col(x) - low) / (high - low), 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


# ---- luma and colour ----


def luma_fast(r, g, b) -> Column:
    """(2 R + 5 G + B) / 8, floored."""
    return F.shiftright(_col(r) * 2 + _col(g) * 5 + _col(b), 3)


def luma_exact(r, g, b) -> Column:
    """Thousandths of .299, .587, .114."""
    return (_col(r) * 299 + _col(g) * 587 + _col(b) * 114) / F.lit(1000.0)


def luma_256(r, g, b) -> Column:
    """(77 R + 150 G + 29 B) / 256, floored."""
    return F.shiftright(_col(r) * 77 + _col(g) * 150 + _col(b) * 29, 8)


def luma_unit(r, g, b) -> Column:
    """Of channels in 0 to 1."""
    return _col(r) * 0.299 + _col(g) * 0.587 + _col(b) * 0.114


def saturation(r, g, b) -> Column:
    """(max - min) / max; 0 for black."""
    top, bottom = F.greatest(_col(r), _col(g), _col(b)), F.least(_col(r), _col(g), _col(b))
    return F.when(top == 0, F.lit(0.0)).otherwise((top - bottom) / top)


def colour_bin(r, g, b) -> Column:
    """Three high bits of each channel, 0 to 511."""
    part = lambda c, n: F.shiftleft(F.shiftright(_col(c), 5), n)
    return part(r, 6).bitwiseOR(part(g, 3)).bitwiseOR(part(b, 0))


def swizzle(argb: Column | str) -> Column:
    """C4: exchanges the red and blue bytes of a packed 32-bit pixel (as a non-negative long)."""
    p = _col(argb).cast("long")
    kept = p.bitwiseAND(F.lit(0xFF00FF00))
    return kept.bitwiseOR(F.shiftleft(p.bitwiseAND(F.lit(0xFF)), 16)).bitwiseOR(F.shiftright(p, 16).bitwiseAND(F.lit(0xFF)))


# ---- geometry ----


def even(x: Column) -> Column:
    return F.floor(x / 2).cast("int") * 2


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def passes(preset, width, height) -> Column:
    """Two passes for ULTRA while sixteen times the size fits; the cost model uses the same."""
    fits = (_col(width) * 16 <= LONGEST_SIDE) & (_col(height) * 16 <= LONGEST_SIDE)
    return F.when((_col(preset) == "ULTRA") & fits, 2).otherwise(1)


def ai_scale(preset, width, height) -> Column:
    """1 without a network, else 4, or 16 in two passes."""
    return F.when(_col(preset) == "FAST", 1).when(passes(preset, width, height) == 2, 16).otherwise(4)


def target_height(target) -> Column:
    pairs = [F.lit(x) for name, height in TARGETS.items() for x in (name, height)]
    return F.coalesce(F.create_map(*pairs)[_col(target)], F.lit(0))


def display_size(width, height, rotation) -> tuple[Column, Column]:
    turned = _col(rotation).isin(90, 270)
    return F.when(turned, _col(height)).otherwise(_col(width)), F.when(turned, _col(width)).otherwise(_col(height))


def output_size(width, height, rotation, preset, target) -> Column:
    """C17: struct of width and height as coded: the target's short side, even, no side over LONGEST_SIDE."""
    scale = F.when(_col(preset) == "FAST", 4).otherwise(ai_scale(preset, width, height))
    tall = target_height(target)
    shown_w, shown_h = display_size(width, height, rotation)
    aspect = shown_w / shown_h
    wide = shown_w >= shown_h
    w = F.when(wide, half_up(tall * aspect)).otherwise(tall)
    h = F.when(wide, tall).otherwise(half_up(tall / aspect))
    turned = _col(rotation).isin(90, 270)
    coded_w = F.when(tall == 0, _col(width) * scale).when(turned, h).otherwise(w)
    coded_h = F.when(tall == 0, _col(height) * scale).when(turned, w).otherwise(h)
    coded_w, coded_h = even(coded_w), even(coded_h)
    longest = F.greatest(coded_w, coded_h)
    fit = lambda x: F.when(longest > LONGEST_SIDE, even(half_up(x * (F.lit(float(LONGEST_SIDE)) / longest)))).otherwise(x).cast("int")
    return F.struct(fit(coded_w).alias("width"), fit(coded_h).alias("height"))


def trim(start_ms, end_ms, duration_ms) -> Column:
    """Struct start_ms, end_ms (null: open), duration_ms; an end not after the start is open."""
    start = F.greatest(F.coalesce(_col(start_ms), F.lit(0)), F.lit(0))
    end = F.when((_col(end_ms) > 0) & (_col(end_ms) > start), _col(end_ms))
    length = F.greatest(F.least(F.coalesce(end, _col(duration_ms)), _col(duration_ms)) - start, F.lit(0))
    return F.struct(start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), length.cast("long").alias("duration_ms"))


def snapped_end(end_ms, duration_ms) -> Column:
    """An end within 200 ms of the duration means open (0)."""
    return F.when(_col(end_ms) >= _col(duration_ms) - 200, F.lit(0)).otherwise(_col(end_ms)).cast("long")


def total_frames(duration_ms, fps) -> Column:
    """C19."""
    return F.greatest(F.floor(_col(duration_ms) / 1000.0 * _col(fps)), F.lit(1)).cast("long")


def bitrate(width, height, fps) -> Column:
    """B2: bits a pixel by size, within 2 and 60 Mbit/s."""
    area = _col(width).cast("long") * _col(height)
    per_pixel = F.when(area >= 3840 * 2160, 0.06).when(area >= 1920 * 1080, 0.09).otherwise(0.12)
    return clamp(F.floor(area * _col(fps) * per_pixel), 2_000_000, 60_000_000).cast("long")


def tiles(width, height, tile) -> Column:
    """Tiles of a frame, each advancing by its size less the overlap on both sides."""
    step = _col(tile) - 2 * OVERLAP
    return (F.ceil(_col(width) / step) * F.ceil(_col(height) / step)).cast("long")


def effective_tile(tile, model) -> Column:
    """Heavy models run on half tiles."""
    heavy = [m for m, c in RELATIVE_COST.items() if c >= 4]
    return F.when(_col(model).isin(heavy), F.greatest(F.floor(_col(tile) / 2), F.lit(64))).otherwise(_col(tile)).cast("int")


def relative_cost(model) -> Column:
    pairs = [F.lit(x) for name, cost in RELATIVE_COST.items() for x in (name, cost)]
    return F.create_map(*pairs)[_col(model)]


def device_plan(ram_mb, cores) -> Column:
    """Struct tile, threads, high_end."""
    tile = F.when(_col(ram_mb) >= 8000, 256).when(_col(ram_mb) >= 6000, 192).when(_col(ram_mb) >= 4000, 160).otherwise(128)
    return F.struct(
        tile.alias("tile"), clamp(_col(cores) - 1, 2, 6).cast("int").alias("threads"), ((_col(ram_mb) >= 6000) & (_col(cores) >= 8)).alias("high_end")
    )


def remote_scale(target, width, height) -> Column:
    """2 if 2.2 times the short side is enough, else 4."""
    need = F.when(target_height(target) == 0, 4.0).otherwise(target_height(target) / F.least(_col(width), _col(height)))
    return F.when(need <= 2.2, 2).otherwise(4)


def known_scale(text) -> Column:
    """2, 4 or 8; anything else is 4."""
    n = F.expr("null").cast("int") if text is None else _col(text).try_cast("int")
    return F.when(n.isin(2, 4, 8), n).otherwise(4)


def natural(x) -> Column:
    """Within 0 and 1; what is no number is 0.5."""
    n = _col(x).try_cast("double")
    return F.when(n.isNull() | F.isnan(n), 0.5).otherwise(clamp(n, 0.0, 1.0))


def auto_target(height) -> Column:
    """C31."""
    return F.when(_col(height) <= 360, "P1080").when(_col(height) <= 540, "P2160").otherwise("AUTO")


def sharpen_amount(preset, sharpen) -> Column:
    """Without a network a base amount is added."""
    return F.when(_col(preset) == "FAST", 0.35 + 0.6 * _col(sharpen)).otherwise(0.6 * _col(sharpen))


# ---- names, times, decoding ----


def enum(x, kind: str) -> Column:
    """Total decoding; unknown or null names become the default."""
    names = {"model": MODELS, "target": tuple(TARGETS), "preset": PRESETS, "color": COLOURS, "compute": COMPUTES}[kind]
    return F.when(_col(x).isin(*names), _col(x)).otherwise(DEFAULTS[kind])


def extension(mime) -> Column:
    """Of an image type."""
    return F.when(_col(mime).contains("webp"), "webp").when(_col(mime).contains("jpeg"), "jpg").otherwise("png")


def remote_name(model) -> Column:
    """The name under which a backend knows a model."""
    pairs = [F.lit(x) for name, remote in REMOTE_NAME.items() for x in (name, remote)]
    return F.coalesce(F.create_map(*pairs)[_col(model)], F.lit(REMOTE_NAME["NATURAL"]))


def localised(lang, texts: dict[str, Column | str], default: str) -> Column:
    """The text of the language, else of the default one."""
    out = F.lit(None).cast("string")
    for name, text in texts.items():
        out = F.when(_col(lang) == name, text if isinstance(text, Column) else F.lit(text)).otherwise(out)
    base = texts[default]
    return F.coalesce(out, base if isinstance(base, Column) else F.lit(base))


def host_label(host, labels: dict[str, str], other: str) -> Column:
    """The label of the first mark that the host holds."""
    out = F.lit(other)
    for mark, label in reversed(labels.items()):
        out = F.when(_col(host).contains(mark), label).otherwise(out)
    return F.when(_col(host).isNotNull(), out)


def output_name(name, width, height, at) -> Column:
    """Base name of at most 40 characters ("video" if blank), short side, time."""
    base = F.substring(F.regexp_replace(_col(name), r"\.[^.]*$", ""), 1, 40)
    base = F.when(F.trim(F.coalesce(base, F.lit(""))) == "", "video").otherwise(base)
    short = F.least(_col(width), _col(height)).cast("string")
    return F.concat(base, F.lit("_"), short, F.lit("p_AI_"), F.date_format(_col(at), "yyyyMMdd_HHmmss"), F.lit(".mp4"))


def clock(seconds) -> Column:
    """H:mm:ss, or m:ss below an hour."""
    s = _col(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(rest))).otherwise(
        F.concat(minutes.cast("string"), F.lit(":"), two(rest))
    )


def spoken(seconds) -> Column:
    """Hours and minutes, minutes and seconds, or seconds."""
    s = _col(seconds).cast("long")
    hours, minutes, rest = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string"), (s % 60).cast("string")
    return (
        F.when(s >= 3600, F.concat(hours, F.lit("h "), minutes, F.lit("m"))).when(s >= 60, F.concat(minutes, F.lit("m "), rest, F.lit("s"))).otherwise(F.concat(rest, F.lit("s")))
    )


def progress(processed, total, elapsed_s, paused_s) -> Column:
    """C20: struct fps, eta_s (null without speed), progress in 0 to .999."""
    active = F.greatest(_col(elapsed_s) - _col(paused_s), F.lit(0.001))
    fps = _col(processed) / active
    eta = F.when(fps > 0, (_col(total) - _col(processed)) / fps)
    return F.struct(fps.alias("fps"), eta.alias("eta_s"), clamp(_col(processed) / _col(total), 0.0, 0.999).alias("progress"))


def plan_label(target, preset, compute) -> Column:
    """Target, preset and place of work, joined by dashes."""
    height = target_height(target)
    return F.concat_ws(" - ", F.when(height == 0, F.lit("x4")).otherwise(F.concat(height.cast("string"), F.lit("p"))), F.lower(_col(preset)), F.lower(_col(compute)))


SETTINGS = "model string, target string, preset string, color string, compute string, natural double, sharpen double, anti_flicker boolean, hevc boolean, gpu boolean, max_mode boolean"
#: Defaults of settings that are not enumerations.
SETTING_DEFAULTS = {"natural": 1.0, "sharpen": 0.3, "anti_flicker": True, "hevc": True, "gpu": True, "max_mode": True}


def settings(json) -> Column:
    """Settings from JSON, each missing or unknown field its default; bad JSON gives all defaults."""
    raw = F.from_json(_col(json), SETTINGS)
    decoded = [enum(raw[k], k).alias(k) for k in DEFAULTS]
    return F.struct(*decoded, *(F.coalesce(raw[k], F.lit(v)).alias(k) for k, v in SETTING_DEFAULTS.items()))


def settings_json(value) -> Column:
    """Settings as the JSON text that settings() reads."""
    return F.to_json(_col(value))


def preview_us(start_ms, duration_ms) -> Column:
    """A5: the time of a preview: three seconds after the trim's start, within the clip."""
    return F.least(_col(start_ms) + F.least(_col(duration_ms), F.lit(3000)), _col(duration_ms) - 1) * 1000


def thumbnail_us(duration_ms) -> Column:
    """A5: the time of a thumbnail."""
    return F.least(_col(duration_ms), F.lit(2000)) * 1000


def trimmed_ms(pos, duration_ms, start_ms, end_ms) -> Column:
    """what of a clip is processed: the trim holds for the first of a selection only."""
    return F.when((_col(pos) == 0) & (_col(end_ms) > _col(start_ms)), _col(end_ms) - _col(start_ms)).otherwise(_col(duration_ms))
