"""Cleanup edits and the interaction log: debounce, latest wins, undo and redo, strokes, marks, geometry."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import svg as svgs
from ..functions.numbers import fixed, half_up, shortest
from ..functions.udfs import vectorized
from ..schema import POINT, with_id

ACTION = f"struct<seq:bigint,mode:string,type:string,color:string,diameter:double,points:array<{POINT}>,x:double,y:double,width:double,height:double,cx:double,cy:double,rx:double,ry:double>"
MASK = "pixelweft-erase"


def debounced(events: DataFrame, key: str, ts: str, gap: str, value: str) -> DataFrame:
    """The last change of each burst: key, first and last time of the burst, changes, value. A burst ends after a pause of gap."""
    w = F.session_window(ts, gap)
    out = events.groupBy(key, w.alias("w")).agg(F.max_by(value, F.struct(ts, value)).alias(value), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("changes"))
    return out.select(key, "first_ts", "last_ts", "changes", value)


def latest_wins(requests: DataFrame, key: str, request: str, ts: str, kill_after_ms: int = 1000) -> DataFrame:
    """requests with outcome: done for the newest of its key, else superseded (the worker lives on) or terminated (the oldest waiting one was older than kill_after_ms when the next came)."""
    w = Window.partitionBy(key).orderBy(request)
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    wait = F.lead(at).over(w) - at
    outcome = F.when(F.lead(request).over(w).isNull(), "done").when(wait > kill_after_ms, "terminated").otherwise("superseded")
    return requests.withColumn("outcome", outcome)


def latest_progress(stages: DataFrame, key: str, request: str) -> DataFrame:
    """Progress rows of the newest request of their key; those of older ones are not shown."""
    newest = stages.groupBy(key).agg(F.max(request).alias(request))
    return stages.join(newest, [key, request], "left_semi")


def raster_reuse(traces: DataFrame) -> DataFrame:
    """traces (image_id, seq, scale, nearest) with reused: whether the raster of the trace before, the only one that is kept, serves again."""
    w = Window.partitionBy("image_id").orderBy("seq")
    same = [F.lag(c).over(w).eqNullSafe(F.col(c)) for c in ("scale", "nearest")]
    return traces.withColumn("reused", F.lag("seq").over(w).isNotNull() & same[0] & same[1])


def current_only(results: DataFrame, state: DataFrame) -> DataFrame:
    """Results whose (token, revision) are still the current ones of their key."""
    return results.join(state, ["key", "token", "revision"], "left_semi")


def replay_turns(log: DataFrame) -> DataFrame:
    """log (image_id, op in cw, ccw, invert, other) -> image_id, quarter_turns (0 to 3, clockwise), inverted."""
    turn = F.when(F.col("op") == "cw", 1).when(F.col("op") == "ccw", -1).otherwise(0)
    return log.groupBy("image_id").agg(F.pmod(F.sum(turn), F.lit(4)).cast("int").alias("quarter_turns"), (F.count_if(F.col("op") == "invert") % 2 == 1).alias("inverted"))


def stand(done: list[int], undone: list[int], steps: Iterable[tuple[str, int]]) -> tuple[list[int], list[int]]:
    """What is done and what may be redone after steps (op, action)."""
    for op, action in steps:
        if op == "add":
            done, undone = [*done, action], []
        elif op == "undo" and done:
            done, undone = done[:-1], [*undone, done[-1]]
        elif op == "redo" and undone:
            done, undone = [*done, undone[-1]], undone[:-1]
        elif op == "clear":
            done, undone = [], []
    return done, undone


def edit_log(log: DataFrame) -> DataFrame:
    """log (image_id, seq, op in add, undo, redo, clear, action long) -> image_id, pos, action: what stands at the end.

    A new action empties what may be redone; undo and redo without anything to take do nothing.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done, _ = stand([], [], pdf.sort_values("seq")[["op", "action"]].itertuples(index=False))
        return pd.DataFrame({"image_id": [pdf.image_id.iloc[0]] * len(done), "pos": range(len(done)), "action": done}).astype({"pos": "int32", "action": "int64"})

    return log.groupBy("image_id").applyInPandas(run, with_id(log, "pos int, action long"))


def strokes(moves: DataFrame, least: float = 0.001) -> DataFrame:
    """moves (image_id, seq, op in down, move, undo, up, x, y) -> image_id, stroke, pos, x, y of the points kept.

    A move counts if it is least or more from the last point kept; a stroke that is
    undone while it is drawn takes no more points, and an undo takes the last stroke.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done: list[list[tuple[float, float]]] = []
        own: list[tuple[float, float]] | None = None
        for op, x, y in pdf.sort_values("seq")[["op", "x", "y"]].itertuples(index=False):
            if op == "down":
                own = [(x, y)]
                done.append(own)
            elif op == "undo" and done:
                if done.pop() is own:
                    own = None
            elif op == "up":
                own = None
            elif op == "move" and own is not None and math.dist(own[-1], (x, y)) >= least:
                own.append((x, y))
        rows = [(pdf.image_id.iloc[0], s, k, x, y) for s, pts in enumerate(done) for k, (x, y) in enumerate(pts)]
        return pd.DataFrame(rows, columns=["image_id", "stroke", "pos", "x", "y"]).astype({"stroke": "int32", "pos": "int32", "x": "float64", "y": "float64"})

    return moves.groupBy("image_id").applyInPandas(run, with_id(moves, "stroke int, pos int, x double, y double"))


def _n(v: float) -> str:
    return shortest(float(fixed(v, 3)))


def mark(action: dict, box: dict, pixel_exact: bool = False) -> str:
    """The mark of an action in black."""
    bx, by, bw, bh = (box[k] for k in ("x", "y", "width", "height"))
    kind = action.get("type")
    at = lambda p: (bx + p["x"] * bw, by + p["y"] * bh)
    tag = lambda name, **a: f"<{name} " + " ".join(f'{k.replace("_", "-")}="{v}"' for k, v in a.items()) + "/>"
    if kind == "rect":
        x, y = at(action)
        return tag("rect", x=_n(x), y=_n(y), width=_n(action["width"] * bw), height=_n(action["height"] * bh), fill="#000")
    if kind == "ellipse":
        return tag("ellipse", cx=_n(bx + action["cx"] * bw), cy=_n(by + action["cy"] * bh), rx=_n(action["rx"] * bw), ry=_n(action["ry"] * bh), fill="#000")
    pts = [at(p) for p in action["points"]]
    if kind == "polygon":
        return tag("polygon", points=" ".join(f"{_n(x)},{_n(y)}" for x, y in pts), fill="#000")
    size = action["diameter"] * min(bw, bh)
    if pixel_exact:
        # an odd number of pixels around pixel centres
        pts = [(bx + math.floor(x - bx) + 0.5, by + math.floor(y - by) + 0.5) for x, y in pts]
        d = max(1, 2 * math.floor((max(1.0, size) - 1) / 2 + 0.5) + 1)
        if len(pts) == 1:
            return tag("rect", x=_n(pts[0][0] - d / 2), y=_n(pts[0][1] - d / 2), width=d, height=d, fill="#000", shape_rendering="crispEdges")
        route = f"M{_n(pts[0][0])} {_n(pts[0][1])}" + "".join(f"H{_n(x)}V{_n(y)}" for x, y in pts[1:])
        return tag("path", d=route, fill="none", stroke="#000", stroke_width=d, stroke_linecap="square", stroke_linejoin="miter", shape_rendering="crispEdges")
    size = max(0.01, size)
    if len(pts) == 1:
        return tag("circle", cx=_n(pts[0][0]), cy=_n(pts[0][1]), r=_n(size / 2), fill="#000")
    route = " ".join(f"{'L' if i else 'M'}{_n(x)} {_n(y)}" for i, (x, y) in enumerate(pts))
    return tag("path", d=route, fill="none", stroke="#000", stroke_width=_n(size), stroke_linecap="round", stroke_linejoin="round")


def colored(text: str, color: str) -> str:
    return text.replace('fill="#000"', f'fill="{color}"').replace('stroke="#000"', f'stroke="{color}"')


def mask(name: str, box: dict, marks: str) -> str:
    place = " ".join(f'{k}="{_n(box[k])}"' for k in ("x", "y", "width", "height"))
    return f'<mask id="{name}" maskUnits="userSpaceOnUse" {place} mask-type="luminance" style="mask-type:luminance" color-interpolation="sRGB"><rect {place} fill="#fff"/>{marks}</mask>'


def with_marks(actions: DataFrame, drawings: DataFrame, pixel_exact: bool = False) -> DataFrame:
    """actions (image_id, action) with box and mark."""
    boxes = drawings.select("image_id", svgs.view_box(F.col("svg")).alias("box")).where("box is not null")
    rows = actions.join(boxes, "image_id")
    row = rows.select("image_id", "action", "box")
    fields = [f for f in row.schema["action"].dataType.fieldNames()]
    flat = row.select("image_id", "action", "box", F.to_json("action").alias("j"), F.to_json("box").alias("b"))
    return flat.select("image_id", *[F.col(f"action.{f}").alias(f) for f in fields], F.col("box"), _mark_json("j", "b", F.lit(pixel_exact)).alias("mark"))


@vectorized("string")
def _mark_json(action: pd.Series, box: pd.Series, exact: pd.Series) -> pd.Series:
    import json

    out = []
    for a, b, e in zip(action, box, exact):
        d = json.loads(a)
        text = mark(d, json.loads(b), bool(e))
        out.append(colored(text, d["color"]) if d.get("mode") == "fill" else text)
    return pd.Series(out)


def apply_actions(drawings: DataFrame, actions: DataFrame, pixel_exact: bool = False) -> DataFrame:
    """drawings (image_id, svg) after their actions in order: an erasure masks all that was there before it, a fill lies on top."""
    marked = with_marks(actions, drawings, pixel_exact)
    each = marked.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("seq", (F.coalesce("mode", F.lit("erase")) == "fill").alias("fill"), "mark"))).alias("acts"), F.first("box").alias("box"))
    rows = drawings.join(each, "image_id", "left").withColumn("p", svgs.parts(F.col("svg")))
    n3 = lambda c: _short(c)
    place = F.concat(*[x for k in ("x", "y", "width", "height") for x in (F.lit(f'{k}="'), n3(F.col(f"box.{k}")), F.lit('" '))])
    head = F.concat(F.lit(' maskUnits="userSpaceOnUse" '), place, F.lit('mask-type="luminance" style="mask-type:luminance" color-interpolation="sRGB"><rect '), place, F.lit('fill="#fff"/>'))
    rows = rows.withColumn("head", head)
    zero = F.struct(F.lit(0).alias("n"), F.lit("").alias("defs"), F.col("p.content").alias("content"))

    def step(s: Column, a: Column) -> Column:
        name = F.concat(F.lit(f"{MASK}-"), s["n"].cast("string"))
        erased = F.struct(
            (s["n"] + 1).alias("n"),
            F.concat(s["defs"], F.lit('<mask id="'), name, F.lit('"'), F.col("head"), a["mark"], F.lit("</mask>")).alias("defs"),
            F.concat(F.lit('<g mask="url(#'), name, F.lit(')">'), s["content"], F.lit("</g>")).alias("content"),
        )
        filled = F.struct(s["n"].alias("n"), s["defs"].alias("defs"), F.concat(s["content"], a["mark"]).alias("content"))
        return F.when(a["fill"], filled).otherwise(erased)

    rows = rows.withColumn("s", F.aggregate("acts", zero, step))
    defs = F.when(F.col("s.defs") == "", "").otherwise(F.concat(F.lit("<defs>"), F.col("s.defs"), F.lit("</defs>")))
    done = F.concat(F.col("p.before"), defs, F.col("s.content"), F.col("p.after"))
    return rows.select("image_id", F.when(F.col("acts").isNull() | F.col("p").isNull() | F.col("box").isNull(), F.col("svg")).otherwise(done).alias("svg"))


@vectorized("string")
def _short(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if pd.isna(x) else _n(float(x)))


def eraser_mask(drawings: DataFrame, actions: DataFrame, pixel_exact: bool = False) -> DataFrame:
    """drawings under one mask of all their strokes."""
    marked = with_marks(actions, drawings, pixel_exact)
    each = marked.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "mark"))), lambda s: s["mark"]), "").alias("marks"), F.first("box").alias("box"))
    rows = drawings.join(each, "image_id", "left").withColumn("p", svgs.parts(F.col("svg")))
    place = F.concat(*[x for k in ("x", "y", "width", "height") for x in (F.lit(f'{k}="'), _short(F.col(f"box.{k}")), F.lit('" '))])
    one = F.concat(F.lit(f'<defs><mask id="{MASK}" maskUnits="userSpaceOnUse" '), place, F.lit('mask-type="luminance" style="mask-type:luminance" color-interpolation="sRGB"><rect '), place, F.lit('fill="#fff"/>'), F.col("marks"), F.lit(f'</mask></defs><g mask="url(#{MASK})">'))
    done = F.concat(F.col("p.before"), one, F.col("p.content"), F.lit("</g>"), F.col("p.after"))
    return rows.select("image_id", F.when(F.col("marks").isNull() | F.col("p").isNull(), F.col("svg")).otherwise(done).alias("svg"))


def snapped_point(ax: Column, ay: Column, px: Column, py: Column, w: Column, h: Column, step: float = math.pi / 4) -> tuple[Column, Column]:
    """The point turned about the anchor to the nearest multiple of step, as seen in the image; its distance stays."""
    dx, dy = (px - ax) * w, (py - ay) * h
    far = F.hypot(dx, dy)
    angle = half_up(F.atan2(dy, dx) / F.lit(step)) * F.lit(step)
    ok = (w > 0) & (h > 0) & (far > 0)
    return F.when(ok, ax + F.cos(angle) * far / w).otherwise(px), F.when(ok, ay + F.sin(angle) * far / h).otherwise(py)


def brush_size(value: Column, larger: Column, least: int, most: int) -> Column:
    """A step of a fifth up or down, by one at least."""
    up = F.greatest(value + 1, half_up(value * 1.2))
    down = F.least(value - 1, half_up(value * F.lit(1 / 1.2)))
    return F.least(F.lit(most), F.greatest(F.lit(least), F.when(larger, up).otherwise(down))).cast("int")


def marquee(x0: Column, y0: Column, x1: Column, y1: Column, constrain: Column, center: Column, w: Column, h: Column) -> Column:
    """The rectangle of a drag: square in the image if constrained, about its start if from the centre."""
    dx, dy = x1 - x0, y1 - y0
    side = F.greatest(F.abs(dx * w), F.abs(dy * h))
    sign = lambda v: F.when(v < 0, -1).otherwise(1)
    dx, dy = F.when(constrain, sign(dx) * side / w).otherwise(dx), F.when(constrain, sign(dy) * side / h).otherwise(dy)
    from_center = F.struct((x0 - F.abs(dx)).alias("x"), (y0 - F.abs(dy)).alias("y"), (F.abs(dx) * 2).alias("width"), (F.abs(dy) * 2).alias("height"))
    plain = F.struct(F.least(x0, x0 + dx).alias("x"), F.least(y0, y0 + dy).alias("y"), F.abs(dx).alias("width"), F.abs(dy).alias("height"))
    return F.when(center, from_center).otherwise(plain)


def touches_image(x: Column, y: Column, w: Column, h: Column) -> Column:
    return (x < 1) & (y < 1) & (x + w > 0) & (y + h > 0)


def polygon_bounds(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"))


def selection_point(x: Column, y: Column, left: Column, top: Column, w: Column, h: Column, mode: Column) -> Column:
    """A pointer in the view as 0 to 1: strict ones outside are null, free ones stay, the others are clamped."""
    nx, ny = (x - left) / w, (y - top) / h
    inside = nx.between(0, 1) & ny.between(0, 1)
    clamp = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    pair = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.when((w == 0) | (h == 0), None).when((mode == "strict") & ~inside, None).when(mode == "free", pair(nx, ny)).otherwise(pair(clamp(nx), clamp(ny)))


def committed(rows: DataFrame) -> DataFrame:
    """rows (image_id, seq, type, geometry, mode, color) -> actions: ellipses by centre and radii, rectangles as they are."""
    g, oval = F.col("geometry"), F.col("type") == "ellipse"
    when = lambda c, v: F.when(c, v)
    return rows.select(
        "image_id", "seq", "mode", "type", F.when(F.col("mode") == "fill", F.col("color")).alias("color"),
        *[when(~oval, g[k]).alias(k) for k in ("x", "y", "width", "height")],
        when(oval, g["x"] + g["width"] / 2).alias("cx"), when(oval, g["y"] + g["height"] / 2).alias("cy"), when(oval, g["width"] / 2).alias("rx"), when(oval, g["height"] / 2).alias("ry"),
    )


def pixel_stroke_size(diameter: Column, w: Column, h: Column) -> Column:
    wanted = F.greatest(F.lit(1.0), diameter * F.least(w, h))
    return F.greatest(F.lit(1), 2 * half_up((wanted - 1) / 2) + 1).cast("int")


def pixel_center(v: Column, origin: Column) -> Column:
    return origin + F.floor(v - origin) + F.lit(0.5)

