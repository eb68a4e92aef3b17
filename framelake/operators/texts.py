"""Prompt text, frame grids, durations, manifests and sheet metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE, STEP, REST = 24, 17, 5  # fixed values: frames a second, and frame counts of the form 17 k + 5


def snap_frames(seconds: Column, how: str = "up") -> Column:
    """Frames of a clip on the 17 k + 5 grid: up, down (5 at least) or nearest (down of two equally near)."""
    n = F.greatest(F.lit(REST), F.rint(seconds * RATE).cast("int"))
    up = n + F.pmod(F.lit(REST) - n, F.lit(STEP))
    down = F.greatest(F.lit(REST), n - F.pmod(n - REST, F.lit(STEP)))
    return {"up": up, "down": down, "nearest": F.when(n - down <= up - n, down).otherwise(up)}[how]


def duration_ms(frames: Column, fps: float, least: int = 1) -> Column:
    return F.greatest(F.lit(least), F.rint(1000 * frames / F.lit(float(fps))).cast("int"))


def sentence(text: Column) -> Column:
    """Trimmed, without full stops at the end."""
    return F.regexp_replace(F.trim(text), r"\.+$", "")


def build_prompt(lead: Column, subject: Column, action: Column, view: Column, clauses: list[Column], loop: Column, notes: Column) -> Column:
    """The parts of a prompt in order, joined by spaces; the loop sentence and the notes only where wanted."""
    looped = F.when(loop, F.lit("The motion is a perfect seamless loop: the animation ends exactly in the pose it started in."))
    extra = F.when(F.trim(notes) != "", F.trim(notes))
    return F.concat_ws(" ", lead, F.concat(sentence(subject), F.lit(", "), view, F.lit(".")), F.concat(F.lit("The character "), sentence(action), F.lit(".")), *clauses, looped, extra)


def bind_tags(prompt: Column, tags: Column, lead: str) -> Column:
    """Appends the tags (an array) that the prompt doesn't name yet, after a lead."""
    missing = F.filter(tags, lambda t: ~F.contains(prompt, t))
    return F.when(F.size(missing) > 0, F.concat(F.rtrim(prompt), F.lit(f" {lead} "), F.array_join(missing, ", "), F.lit("."))).otherwise(prompt)


def manifests(frames: DataFrame, fps: float, tag: str, width: int, height: int) -> DataFrame:
    """(run, json): tag, fps, frame size, and file and duration of each frame (run, frame, duration in frames)."""
    item = F.struct("frame", F.format_string("frame_%03d.png", "frame").alias("file"), duration_ms(F.col("duration"), fps).alias("duration_ms"))
    lists = frames.groupBy("run_id").agg(F.sort_array(F.collect_list(item)).alias("l"))
    body = F.struct(F.lit(tag).alias("tag"), F.lit(float(fps)).alias("fps"), F.array(F.lit(width), F.lit(height)).alias("frame_size"), F.transform("l", lambda e: F.struct(e["file"].alias("file"), e["duration_ms"].alias("duration_ms"))).alias("frames"))
    return lists.select("run_id", F.to_json(body).alias("json"))


MANIFEST = "tag string, fps double, frame_size array<int>, frames array<struct<file:string,duration_ms:int>>"


def read_manifests(df: DataFrame, column: str = "json") -> DataFrame:
    """(run, tag, fps, file, duration_s) of manifests; defaults for what is missing, no rows for bad JSON."""
    m = df.select("run_id", F.from_json(column, MANIFEST).alias("m"))
    rows = m.select("run_id", F.coalesce("m.tag", F.lit("run")).alias("tag"), F.coalesce("m.fps", F.lit(12.0)).alias("fps"), F.explode("m.frames").alias("f"))
    return rows.select("run_id", "tag", "fps", "f.file", (F.coalesce("f.duration_ms", F.lit(100)) / 1000).alias("duration_s"))


def sheet_json(layout: DataFrame, width: int, height: int) -> DataFrame:
    """(run, json): frame rectangles keyed frame_000 and on, and the sheet's size."""
    size = F.struct(F.lit(width).alias("w"), F.lit(height).alias("h"))
    entry = F.struct(
        F.struct("x", "y", F.lit(width).alias("w"), F.lit(height).alias("h")).alias("frame"),
        F.lit(False).alias("rotated"),
        F.lit(False).alias("trimmed"),
        F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(width).alias("w"), F.lit(height).alias("h")).alias("spriteSourceSize"),
        size.alias("sourceSize"),
    )
    lists = layout.groupBy("run_id", "sheet_w", "sheet_h").agg(F.sort_array(F.collect_list(F.struct("frame", F.format_string("frame_%03d", "frame").alias("key"), entry.alias("e")))).alias("l"))
    frames = F.map_from_entries(F.transform("l", lambda e: F.struct(e["key"], e["e"])))
    body = F.struct(frames.alias("frames"), F.struct(F.struct(F.col("sheet_w").alias("w"), F.col("sheet_h").alias("h")).alias("size"), F.lit("1").alias("scale")).alias("meta"))
    return lists.select("run_id", F.to_json(body).alias("json"))


def build_script(frames: DataFrame) -> DataFrame:
    """(run, script): one line a frame, in order (file and seconds)."""
    line = F.format_string("frame(%d, %s, %.3f)", F.col("frame") + 1, F.format_string("'frame_%03d.png'", "frame"), F.col("duration") / F.lit(12.0))
    lists = frames.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("frame", line.alias("line")))).alias("l"))
    return lists.select("run_id", F.array_join(F.transform("l", lambda e: e["line"]), "\n").alias("script"))


def sigma_warp(sigma: Column, top: Column, compress: float) -> Column:
    """A power warp of a falling schedule; 0 and the top stay."""
    return F.when(sigma <= 0, sigma).otherwise(top * F.pow(sigma / top, F.lit(1 - 0.7 * compress)))


def split_latent(flat: Column, video: int) -> tuple[Column, Column]:
    """The leading video part of a flat array, and the tail."""
    return F.slice(flat, 1, video), F.slice(flat, video + 1, F.greatest(F.size(flat) - video, F.lit(0)))


def pick(value: Column, default: Column) -> Column:
    """The default where a knob is at its -1 mark."""
    return F.when(value == -1, default).otherwise(value)


def tri_state(value: Column, default: Column) -> Column:
    """A switch of preset, on or off."""
    return F.when(value == "preset", default).otherwise(value == "on")


def flat_hex(background: Column, custom: Column, known: dict[str, str]) -> Column:
    """The colour that a reference is flattened on: a known backdrop's own if that is a hex, else the custom one, or green where that is missing."""
    own = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[background] if known else F.lit(None).cast("string")
    return F.when(own.startswith("#"), own).otherwise(F.coalesce(custom, F.lit("#00FF00")))


def backdrop_clause(hex_: Column, known: dict[str, str], template: str) -> Column:
    """The clause of a known colour, or the template (with a %s for each mention) filled with the colour; '#' and capitals are put right."""
    h = F.upper(F.trim(F.coalesce(hex_, F.lit(""))))
    h = F.when(F.startswith(h, F.lit("#")), h).otherwise(F.concat(F.lit("#"), h))
    out = F.format_string(template, *[h] * template.count("%s"))
    for colour, clause in known.items():
        out = F.when(h == colour, clause).otherwise(out)
    return out


def _joined(parts: list[Column], notes: Column) -> list[Column]:
    """Prompt, length in frames and rate: a still is a clip of the least length."""
    return [F.concat_ws(" ", *parts, F.when(F.trim(notes) != "", F.trim(notes))).alias("prompt"), F.lit(REST).alias("length"), F.lit(RATE).alias("fps")]


def still_prompt(style: Column, subject: Column, view: Column, pose: Column, backdrop: Column, clauses: list[Column], notes: Column) -> list[Column]:
    """prompt, length, fps of one still: style; subject, view and pose; the first two clauses; the backdrop; the other clauses; notes."""
    who = F.concat(F.concat_ws(", ", sentence(subject), view, sentence(pose)), F.lit("."))
    return _joined([style, who, *clauses[:2], F.concat(backdrop, F.lit(".")), *clauses[2:]], notes)


def edit_prompt(lead: Column, instruction: Column, lock: Column, keep_palette: Column, palette_clause: Column, still: Column, backdrop: Column, finish: Column, notes: Column) -> list[Column]:
    """prompt, length, fps of an edit: lead and instruction; what stays; the palette clause where wanted; stillness; backdrop; finish; notes."""
    what = F.concat(lead, F.lit(": "), sentence(instruction), F.lit("."))
    return _joined([what, lock, F.when(keep_palette, palette_clause), still, F.concat(backdrop, F.lit(".")), finish], notes)


def clamped_duration_ms(durations: Column, frame: Column, fps: float) -> Column:
    """Milliseconds of a frame by a list of durations in frames, whose last entry holds for later frames; null without a list."""
    return F.when(F.size(durations) > 0, duration_ms(F.element_at(durations, F.least(frame + 1, F.size(durations))), fps))


STAGES = ("source", "keyed", "grid", "look", "motion")  # fixed values: the debug stages, in order


def result_payload(files: DataFrame, width: int, height: int, report: Column) -> DataFrame:
    """(run, json) of the stage files (run, stage, frame, filename): the default layer of the final stage, its frame count, the other stages that have files, and the report."""
    item = F.struct("frame", F.struct("filename", F.lit("").alias("subfolder"), F.lit("temp").alias("type")).alias("f"))
    lists = files.groupBy("run_id", "stage").agg(F.transform(F.sort_array(F.collect_list(item)), lambda e: e["f"]).alias("frames"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")), F.lit(0))
    debug = F.when(rank > 0, F.struct(rank.alias("rank"), F.struct("stage", "frames").alias("s")))
    runs = lists.groupBy("run_id").agg(F.first(F.when(F.col("stage") == "final", F.col("frames")), ignorenulls=True).alias("final"), F.sort_array(F.collect_list(debug)).alias("debug"))
    n = F.coalesce(F.size("final"), F.lit(0))
    final = F.coalesce("final", F.array().cast(dict(lists.dtypes)["frames"]))
    layer = F.struct(F.lit("gen_default").alias("id"), F.lit("Generated").alias("name"), final.alias("frames"), F.lit("forge").alias("source"), F.struct(F.lit(width).alias("w"), F.lit(height).alias("h"), n.alias("frameCount")).alias("meta"))
    body = F.struct(F.array(layer).alias("layers"), n.alias("frame_count"), F.transform("debug", lambda e: e["s"]).alias("debug_stages"), report.alias("report"))
    return runs.select("run_id", F.to_json(body).alias("json"))


def export_report(parts: dict[str, tuple[Column, Column]]) -> Column:
    """The reports (wanted, text) of the exports that are switched on, in order, with bars between."""
    return F.concat_ws(" | ", *[F.when(wanted, text) for wanted, text in parts.values()])
