"""SVG text: grouping, sizes, titles, inks, parsing. Column functions where a pattern says it all, Arrow UDFs where order matters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SUBPATHS
from . import path as paths
from .numbers import fixed, shortest
from .udfs import vectorized

# What an element, an attribute and a box look like in a traced drawing.
PATH = r"<path\b[^>]*/>"
FILL = r'\sfill="([^"]*)"'
DATA = r'\sd="([^"]*)"'
SHIFT = r"translate\((-?[\d.]+)[, ](-?[\d.]+)\)"
BOX = r'viewBox="0 0 ([\d.]+) ([\d.]+)"'
ILLEGAL_XML = "[^\\u0009\\u000A\\u000D\\u0020-\\uD7FF\\uE000-\\uFFFD\\x{10000}-\\x{10FFFF}]"
STALE = r"(?i)importing binding|does not provide an export|SyntaxError|import.* module"


def count_paths(svg: Column) -> Column:
    return F.regexp_count(svg, F.lit(r"<path\b")).cast("long")


def strip_illegal(text: Column) -> Column:
    return F.regexp_replace(text, ILLEGAL_XML, "")


def escape_xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def is_stale_error(message: Column) -> Column:
    return F.coalesce(message, F.lit("")).rlike(STALE)


def _first(text: Column, pattern: str, new: Column) -> Column:
    """text with the first match replaced; regexp_replace would take all."""
    whole = F.regexp_substr(text, F.lit(pattern))
    at = F.instr(text, whole)
    return F.when(whole.isNotNull(), F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(whole), F.length(text)))).otherwise(text)


def stencil_ink(svg: Column, ink: Column) -> Column:
    """White ink: black fills turn white, on a black rectangle of the drawing's box."""
    white = F.replace(svg, F.lit('fill="#000000"'), F.lit('fill="#ffffff"'))
    w, h = F.regexp_extract(white, BOX, 1), F.regexp_extract(white, BOX, 2)
    root = F.regexp_substr(white, F.lit("<svg[^>]*>"))
    backed = _first(white, "<svg[^>]*>", F.concat(root, F.lit('<rect width="'), w, F.lit('" height="'), h, F.lit('" fill="#000000"/>')))
    return F.when(ink != "white", svg).when((w == "") | (h == ""), white).otherwise(backed)


def sized_root(svg: Column, width: Column, height: Column) -> Column:
    """The root with the source's size and the traced size as its box; other roots stay."""
    pattern = r'(<svg[^>]*?) width="(\d+)" height="(\d+)">'
    part = lambda k: F.regexp_extract(svg, pattern, k)
    new = F.concat(part(1), F.lit(' width="'), width.cast("string"), F.lit('" height="'), height.cast("string"), F.lit('" viewBox="0 0 '), part(2), F.lit(" "), part(3), F.lit('">'))
    return _first(svg, pattern, new)


def titled(svg: Column, title: Column) -> Column:
    root = F.regexp_extract(svg, "(<svg[^>]*)>", 1)
    new = F.concat(root, F.lit(' role="img">\n<title>'), escape_xml(strip_illegal(title)), F.lit("</title>"))
    return F.when(F.coalesce(title, F.lit("")) == "", svg).otherwise(_first(svg, "<svg[^>]*>", new))


@vectorized("string")
def physical_size(svg: pd.Series, width: pd.Series, unit: pd.Series) -> pd.Series:
    """The root with its width in unit, and the height that the aspect ratio gives."""
    pattern = re.compile(r'(<svg[^>]*?) width="(\d+)" height="(\d+)"( viewBox="[^"]*")')

    def one(text: str | None, w: float | None, u: str | None) -> str | None:
        if text is None or w is None or not w > 0 or not u:
            return text

        def new(m: re.Match) -> str:
            h = shortest(float(fixed(w * (int(m[3]) / int(m[2])), 2))) if int(m[2]) else "0"
            return f'{m[1]} width="{shortest(w)}{u}" height="{h}{u}"{m[4]}'

        return pattern.sub(new, text, count=1)

    return pd.Series([one(*v) for v in zip(svg, width, unit)])


def without_prolog(svg: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(svg, r"^<\?xml[^?]*\?>\s*", ""), r"(?s)^<!--.*?-->\s*", "")


def _short_tag(m: re.Match) -> str:
    """A path's tag with its data in short form, its translation taken in; other tags stay."""
    tag = m[0]
    data, shift = re.search(DATA, tag), re.search(r'\s+transform="([^"]*)"', tag)
    move = re.fullmatch(SHIFT, shift[1]) if shift else None
    if not data or bool(shift) != bool(move):
        return tag
    short = paths.compress(data[1], *(map(float, move.groups()) if move else ())) if data[1] else None
    if short is None:
        return tag
    spans = sorted([(data.span(1), short), *([(shift.span(), "")] if shift else [])])
    ends = [0, *(e for (_, e), _ in spans)]
    return "".join(tag[at:first] + new for at, ((first, _), new) in zip(ends, spans)) + tag[ends[-1] :]


def _joins(svg: str, a: re.Match, b: re.Match) -> bool:
    """Two path tags of one fill with nothing between them."""
    fills = [f and f[1] for f in (re.search(FILL, a[0]), re.search(FILL, b[0]))]
    return bool(fills[0]) and fills[0] == fills[1] and svg[a.end() : b.start()].isspace() | (a.end() == b.start())


def _grouped(svg: str) -> str:
    """Neighbouring paths of one fill in a shared group: a run begins at each path that doesn't join the one before, as in fill_runs()."""
    tags = list(re.finditer(PATH, svg))
    begins = [i for i, m in enumerate(tags) if not i or not _joins(svg, tags[i - 1], m)]
    runs = [(tags[a], tags[b - 1]) for a, b in zip(begins, [*begins[1:], len(tags)])]
    out, at = [], 0
    for first, last in runs:
        if first is not last:
            inner = re.sub(PATH, lambda m: re.sub(r'\s+fill="[^"]*"', "", m[0], count=1), svg[first.start() : last.end()])
            out += [svg[at : first.start()], f'<g fill="{re.search(FILL, first[0])[1]}">\n{inner}\n</g>']
            at = last.end()
    return "".join(out) + svg[at:]


def _straight(svg: str, tolerance: float) -> str:
    return re.sub(r'(<path\b[^>]*?\sd=")([^"]*)(")', lambda m: m[1] + paths.straighten(m[2], tolerance) + m[3], svg) if tolerance > 0 else svg


@vectorized("double")
def off_chord(x: pd.Series, y: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    """Distance of (x, y) to the line through (x0, y0) and (x1, y1), as straightening and flattening take it."""
    return pd.Series([paths.off_chord(v[:2], v[2:4], v[4:]) for v in zip(x, y, x0, y0, x1, y1)], dtype=float)


@vectorized("string")
def compress_paths(svg: pd.Series) -> pd.Series:
    return svg.map(lambda s: re.sub(PATH, _short_tag, s), na_action="ignore")


@vectorized("string")
def group_fills(svg: pd.Series) -> pd.Series:
    return svg.map(_grouped, na_action="ignore")


@vectorized("string")
def straighten_paths(svg: pd.Series, tolerance: pd.Series) -> pd.Series:
    return pd.Series([s if s is None else _straight(s, t) for s, t in zip(svg, tolerance)])


TAGS = r"<g\b[^>]*>|</g>|<path\b[^>]*>"


def fills_of(tags: list[str]) -> list[str | None]:
    """The fill that holds for each tag of a drawing: its own, else that of the innermost group around it which has one."""
    out, open_ = [], [None]
    for tag in tags:
        fill = f[1] if (f := re.search(FILL, tag)) else open_[-1]
        if tag.startswith("</"):
            del open_[max(1, len(open_) - 1) :]
        elif tag.startswith("<g"):
            open_.append(fill)
        out.append(fill)
    return out


@vectorized("array<string>")
def tag_fills(tags: pd.Series) -> pd.Series:
    return tags.map(lambda t: fills_of(list(t)), na_action="ignore")


def parse_svg(svg: str) -> dict:
    """{width, height, paths: [{fill, subpaths}], error}: paths in order with the fill of their group where they have none."""
    box, size = re.search(BOX, svg), re.search(r'<svg[^>]*? width="([\d.]+)"[^>]*? height="([\d.]+)"', svg)
    found, error = [], None
    tags = re.findall(TAGS, svg)
    for tag, fill in zip(tags, fills_of(tags)):
        if tag.startswith("<path") and (data := re.search(DATA, tag)) and data[1]:
            move = re.search(SHIFT, tag)
            try:
                found.append({"fill": "#000000" if fill is None else fill, "subpaths": paths.subpaths(data[1], *(map(float, move.groups()) if move else (0.0, 0.0)))})
            except paths.UnsupportedPath as e:
                error = error or str(e)
    w, h = (box or size or [0, 0, 0])[1], (box or size or [0, 0, 0])[2]
    return {"width": float(w), "height": float(h), "paths": found, "error": error}


@vectorized(f"width double, height double, paths array<struct<fill:string,subpaths:{SUBPATHS}>>, error string")
def parsed(svg: pd.Series) -> pd.DataFrame:
    rows = [parse_svg(s or "") for s in svg]
    return pd.DataFrame({k: [r[k] for r in rows] for k in ("width", "height", "paths", "error")})


def tokens(rows: DataFrame, data: str = "d") -> DataFrame:
    """rows with ord, token and cmd, the command that each number belongs to; pairs after a move are lines."""
    key = [c for c in rows.columns if c != data]
    found = F.regexp_extract_all(F.col(data), F.lit(paths.TOKEN.pattern), F.lit(0))
    t = rows.select(*key, F.posexplode(found).alias("ord", "token"))
    w = Window.partitionBy(*key).orderBy("ord")
    letter = F.when(F.col("token").rlike("^[A-Za-z]$"), F.struct(F.col("ord").alias("at"), F.col("token").alias("t")))
    t = t.withColumn("l_", F.last(letter, ignorenulls=True).over(w))
    cmd = F.when((F.col("l_.t") == "M") & (F.col("ord") - F.col("l_.at") > 2), "L").otherwise(F.col("l_.t"))
    return t.select(*key, "ord", "token", cmd.alias("cmd"))


def path_rows(drawings: DataFrame) -> DataFrame:
    """drawings (image_id, svg) -> image_id, path_ord, fill, d, dx, dy; groups may be nested."""
    tags = drawings.select("image_id", F.regexp_extract_all("svg", F.lit(TAGS), F.lit(0)).alias("tags"))
    each = F.posexplode(F.arrays_zip("tags", F.col("fills"))).alias("ord", "t")
    own = lambda p, k=1: F.nullif(F.regexp_extract("tag", p, k), F.lit(""))
    rows = tags.withColumn("fills", tag_fills("tags")).select("image_id", each).select("image_id", "ord", F.col("t.tags").alias("tag"), F.col("t.fills").alias("fill"))
    rows = rows.where(F.col("tag").startswith("<path")).withColumn("d", own(DATA)).where(F.col("d").isNotNull())
    w = Window.partitionBy("image_id").orderBy("ord")
    number = lambda k: F.coalesce(own(SHIFT, k).cast("double"), F.lit(0.0))
    return rows.select("image_id", (F.row_number().over(w) - 1).cast("int").alias("path_ord"), F.coalesce("fill", F.lit("#000000")).alias("fill"), "d", number(1).alias("dx"), number(2).alias("dy"))


def fill_runs(rows: DataFrame) -> DataFrame:
    """image_id, path_ord, fill (null: none) -> with run, which neighbours of one fill share, and its size."""
    w = Window.partitionBy("image_id").orderBy("path_ord")
    new = F.when(F.col("fill") == F.lag("fill").over(w), 0).otherwise(1)
    rows = rows.withColumn("new_", new).withColumn("run", F.sum("new_").over(w).cast("int")).drop("new_")
    return rows.withColumn("run_size", F.count("*").over(Window.partitionBy("image_id", "run")))


def view_box(svg: Column) -> Column:
    """x, y, width and height of the box, null unless all are finite and the size is above zero."""
    pattern = r"""(?i)\bviewBox\s*=\s*["']\s*([-+\d.eE]+)[ ,]+([-+\d.eE]+)[ ,]+([-+\d.eE]+)[ ,]+([-+\d.eE]+)\s*["']"""
    x, y, w, h = (F.regexp_extract(svg, pattern, k).try_cast("double") for k in (1, 2, 3, 4))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(fine(x) & fine(y) & fine(w) & fine(h) & (w > 0) & (h > 0), F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height")))


def parts(svg: Column) -> Column:
    """before (with the root's opening tag), content and after; null without a root and its end."""
    pattern = r"(?s)^(.*?<[sS][vV][gG]\b[^>]*>)(.*)(</svg>.*?)$"
    # the greedy middle ends at the last closing tag
    return F.when(svg.rlike(pattern), F.struct(*[F.regexp_extract(svg, pattern, k).alias(n) for k, n in ((1, "before"), (2, "content"), (3, "after"))]))


def export_options(drawings: DataFrame) -> DataFrame:
    """drawings with svg rewritten by its columns minify, physical_width, physical_unit and title, in that order of steps."""
    svg = F.when(F.col("minify"), compress_paths(without_prolog(F.col("svg")))).otherwise(F.col("svg"))
    out = drawings.withColumn("svg", svg)
    out = out.withColumn("svg", physical_size("svg", F.col("physical_width").cast("double"), "physical_unit"))
    return out.withColumn("svg", titled(F.col("svg"), F.col("title")))
