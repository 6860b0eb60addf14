"""Golden cases, sequential models and properties of the pixel operators."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelweft.functions import groups
from pixelweft.operators import color, neighbourhood, outline, pixel, region, stats, tiles
from pixelweft.operators.trace import TraceOptions
from pixelweft.plans import pipeline
from pixelweft.schema import PIXEL, PIXELS, presets
from pixelweft.sources import raster
from pixelweft.sources.store import stored


def image(spark, rows, image_id=1):
    """rows of pixels, each (r, g, b) or (r, g, b, a)."""
    return spark.createDataFrame([(image_id, x, y, *p, *([255] if len(p) == 3 else [])) for y, row in enumerate(rows) for x, p in enumerate(row)], PIXELS)


def grid(px, *names):
    rows = px.toPandas()
    out = np.zeros((rows.y.max() + 1, rows.x.max() + 1, len(names)), int)
    out[rows.y, rows.x] = rows[list(names)]
    return out


def noisy(spark, seed=5, w=9, h=8):
    r = np.random.default_rng(seed)
    return image(spark, [[(int(r.integers(0, 3)) * 100, int(r.integers(0, 2)) * 90, 7, 0 if r.random() < 0.25 else 255) for _ in range(w)] for _ in range(h)])


def test_hex_and_sampling(spark):
    df = spark.createDataFrame([(t,) for t in ("#FFAA00", "ffaa00", "notacolor", "#FFF", None)], "t string")
    assert [r[0] for r in df.select(pixel.parse_hex(F.col("t"))).collect()] == [0xFFAA00, 0xFFAA00, None, None, None]
    px = image(spark, [[(1, 1, 1), (2, 2, 2)], [(3, 3, 3), (4, 4, 4)]])
    pts = spark.createDataFrame([(1, i, *p) for i, p in enumerate([(0.1, 0.1), (0.9, 0.1), (0.1, 0.9), (1.0, 1.0)])], "image_id int, point_id int, nx double, ny double")
    assert [r.r for r in pixel.sample_points(px, pts).orderBy("point_id").collect()] == [1, 2, 3, 4]


def test_point_operators(spark):
    px = image(spark, [[(200, 0, 0), (100, 0, 0), (128, 128, 128, 127)]])
    assert grid(pixel.threshold(px, 128), "r")[0, :, 0].tolist() == [255, 0, 255]
    assert grid(pixel.binarize_alpha(px), "a")[0, :, 0].tolist() == [255, 255, 0]
    one = image(spark, [[(0, 128, 255, 200)]])
    assert grid(pixel.invert(one), "r", "g", "b", "a").ravel().tolist() == [255, 127, 0, 200]
    assert sorted(map(tuple, pixel.invert(pixel.invert(px)).collect())) == sorted(map(tuple, px.collect()))


def test_turns_and_packing(spark):
    px = noisy(spark)
    four = px
    for _ in range(4):
        four = raster.rotate(four)
    same = lambda a, b: sorted(map(tuple, a.select(*PIXELS_ORDER).collect())) == sorted(map(tuple, b.select(*PIXELS_ORDER).collect()))
    assert same(four, px) and same(raster.rotate(raster.rotate(px), clockwise=False), px)
    assert same(raster.unpack(raster.pack(px)), px)


PIXELS_ORDER = ["image_id", "x", "y", "r", "g", "b", "a"]


def test_background(spark):
    white, odd = (255, 255, 255), (9, 9, 9)
    px = image(spark, [[odd] + [white] * 3] + [[white] * 4] * 3)
    assert tuple(stats.background_color(px).first())[1:] == white
    clear = [[(0, 0, 0, 0)] * 10 for _ in range(10)]
    for y in range(3):
        for x in range(3):
            clear[y][x] = (5, 5, 5, 255)
    assert tuple(stats.background_color(image(spark, clear)).first())[1:] == (None, None, None)


def test_knock_out_fuzz(spark):
    px = image(spark, [[(100, 100, 100), (130, 100, 100), (255, 255, 255), (235, 235, 235)]])
    hit = lambda rgb: grid(color.knock_out(px, spark.createDataFrame([(1, rgb)], "image_id int, rgb int"), 16.0), "a")[0, :, 0].tolist()
    assert hit(0x646464)[:2] == [0, 255]
    assert hit(0xFFFFFF)[2:] == [0, 0]


def test_oklab_round_trip():
    rgb = np.random.default_rng(0).integers(0, 256, (500, 3))
    assert np.abs(color.srgb_array(color.oklab_array(rgb)) - rgb).max() <= 1


def test_quantize(spark):
    colors = [(0, 0, 0), (0, 64, 0), (0, 56, 0), (0, 0, 0), (0, 0, 57), (0, 64, 0), (0, 0, 0), (0, 0, 56)]
    out = [tuple(map(int, p)) for p in grid(color.quantize(image(spark, [colors]), 4), "r", "g", "b")[0]]
    assert len(set(out)) <= 4 and out[1] == (0, 64, 0) and out[2] == (0, 56, 0) and out[4] == out[7]
    two = image(spark, [[(1, 2, 3), (1, 2, 3)]])
    assert grid(color.quantize(two, 8), "r", "g", "b").tolist() == [[[1, 2, 3]] * 2]
    r = np.random.default_rng(3)
    many = image(spark, [[tuple(map(int, r.integers(0, 256, 3))) for _ in range(12)] for _ in range(12)])
    assert len({tuple(p) for p in grid(color.quantize(many, 5), "r", "g", "b").reshape(-1, 3)}) <= 5


def around(g, y, x):
    h, w = g.shape[:2]
    return [g[j, i] for j in range(max(0, y - 1), min(h, y + 2)) for i in range(max(0, x - 1), min(w, x + 2))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_filters_against_a_sequential_model(spark, seed):
    px = noisy(spark, seed)
    g = grid(px, "r", "g", "b", "a")
    median, mode = g.copy(), g.copy()
    for y in range(g.shape[0]):
        for x in range(g.shape[1]):
            if g[y, x, 3] < 128:
                continue
            near = [p for p in around(g, y, x) if p[3] >= 128]
            for c in range(3):
                median[y, x, c] = sorted(p[c] for p in near)[len(near) // 2]
            keys = [tuple(p[:3]) for p in near]
            best = max(set(keys), key=keys.count)
            if keys.count(best) >= 5:
                mode[y, x, :3] = best
    assert (grid(neighbourhood.median_filter(px), "r", "g", "b", "a") == median).all()
    assert (grid(neighbourhood.mode_filter(px), "r", "g", "b", "a") == mode).all()


@pytest.mark.parametrize("seed", [4, 5])
def test_erode_and_defringe_against_a_sequential_model(spark, seed):
    px = noisy(spark, seed, 12, 11)
    g = grid(px, "r", "g", "b", "a")
    h, w = g.shape[:2]
    beside = lambda y, x: [(j, i) for j, i in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= j < h and 0 <= i < w]
    e = g.copy()
    for _ in range(2):
        peel = [(y, x) for y in range(h) for x in range(w) if e[y, x, 3] >= 128 and any(e[q][3] < 128 for q in beside(y, x))]
        for q in peel:
            e[q][3] = 0
    assert (grid(neighbourhood.erode(px, 2), "a")[:, :, 0] == e[:, :, 3]).all()
    depth = {(y, x): 0 for y in range(h) for x in range(w) if g[y, x, 3] < 128}
    front = list(depth)
    for k in (1, 2):
        front = [q for q in {q for p in front for q in beside(*p)} if q not in depth]
        depth |= dict.fromkeys(front, k)
    d = g.copy()
    for k in (2, 1):
        new = {}
        for (y, x), v in depth.items():
            if v == k:
                near = [d[j, i][:3] for j in range(max(0, y - 1), min(h, y + 2)) for i in range(max(0, x - 1), min(w, x + 2)) if depth.get((j, i), 99) > k]
                if near:
                    new[y, x] = np.round(np.mean(near, axis=0))  # half to even
        for q, v in new.items():
            d[q][:3] = v
    assert (grid(neighbourhood.defringe(px, 2), "r", "g", "b", "a") == d).all()


def test_flood_fill(spark):
    rows = [[(255, 255, 255)] * 10 for _ in range(10)]
    for y in range(2, 8):
        for x in range(2, 8):
            if not (4 <= y <= 5 and 4 <= x <= 5):
                rows[y][x] = (0, 0, 0)
    a = grid(region.knock_out_edges(image(spark, rows), 16.0), "a")[:, :, 0]
    assert a[0, 0] == 0 and a[4, 4] == 255 and a[2, 2] == 255 and (a == 0).sum() == 64
    assert (grid(region.knock_out_edges(image(spark, rows), 16.0, tile=3), "a")[:, :, 0] == a).all()


def test_tiles_change_nothing(spark):
    """Labels, flood fill and loops of images that are cut into small tiles, with ids of 64 bits and two values, so that components wind through many tiles."""
    r = np.random.default_rng(4)
    rows = [((1 << 50) + i, x, y, int(v), 0, 0, 255 if r.random() > 0.08 * i else 0) for i in range(2) for (y, x), v in np.ndenumerate(r.integers(0, 2, (23, 29)) * 90)]
    px = spark.createDataFrame(rows, f"image_id long, {PIXEL}")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    cells = region.regions(px)
    assert same(cells, region.regions(px, tile=6))
    assert {r.image_id for r in cells.select("image_id").distinct().collect()} == {1 << 50, (1 << 50) + 1}
    assert same(region.knock_out_edges(px, 12.0), region.knock_out_edges(px, 12.0, tile=6))
    before = cells.withColumn("before", F.lit(0).cast("long"))
    assert same(outline.loops(before), outline.loops(before, tile=6))


def test_depth_is_a_distance(spark):
    """Rings by steps from transparency, against growing them one by one, however deep."""
    r = np.random.default_rng(8)
    a = np.where(r.random((40, 33)) < 0.004, 0, 255)
    a[20, 16] = 0
    px = spark.createDataFrame([(1, x, y, 1, 2, 3, int(v)) for (y, x), v in np.ndenumerate(a)], PIXELS)
    d, front = np.where(a < 128, 0, -1), a < 128
    for k in range(1, 65):
        near = np.zeros_like(front)
        near[1:] |= front[:-1]
        near[:-1] |= front[1:]
        near[:, 1:] |= front[:, :-1]
        near[:, :-1] |= front[:, 1:]
        front = near & (d < 0)
        d[front] = k
    for depth in (2, 64):
        got = neighbourhood.rings(px, depth).toPandas()
        assert (got.d.fillna(-1).to_numpy() == np.where(d <= depth, d, -1)[got.y, got.x]).all()
        gone = neighbourhood.erode(px, depth).toPandas()
        assert ((gone.a == 0).to_numpy() == (d <= depth)[gone.y, gone.x]).all()
    plan = [neighbourhood.rings(px, n)._jdf.queryExecution().executedPlan().toString().count("Window") for n in (2, 64)]
    assert plan[0] == plan[1]
    assert neighbourhood.rings(px.where("a > 0"), 3).where("d is not null").count() == 0


def test_palette_rounds_hold_blocks(monkeypatch):
    """Bounds and blocks change neither palette nor assignment."""
    r = np.random.default_rng(0)
    for n, k in ((60, 3), (3000, 16), (800, 64), (4, 4)):
        lab = color.oklab_array(r.integers(0, 256, (n, 3)))
        weight, seeds = r.integers(1, 50, n).astype(float), lab[r.choice(n, k, replace=False)].copy()
        seeds[-1] = seeds[0]
        palette, to = seeds, np.zeros(n, int)
        for i in range(10):
            new = ((lab[:, None] - palette[None]) ** 2).sum(axis=2).argmin(axis=1)
            if i and (new == to).all():
                break
            to = new
            palette = np.array([np.bincount(to, lab[:, c] * weight, k) for c in range(3)]).T / np.maximum(np.bincount(to, weight, k), 1)[:, None] * (np.bincount(to, minlength=k) > 0)[:, None] + palette * (np.bincount(to, minlength=k) == 0)[:, None]
        monkeypatch.setattr(color, "BLOCK", 1000)
        found, own = color.refined(lab, weight, seeds)
        assert (own == to).all() and np.allclose(found, palette, atol=1e-12)


def test_palette_search_is_bounded_in_memory():
    r = np.random.default_rng(0)
    lab = color.oklab_array(r.integers(0, 256, (400_000, 3)))
    tracemalloc.start()
    color.refined(lab, np.ones(len(lab)), lab[:128].copy(), 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6


def test_flatness(spark):
    two = image(spark, [[(10, 10, 10) if x < 5 else (200, 0, 0) for x in range(10)] for _ in range(10)])
    assert tuple(stats.flatness(two).first())[1:] == (True, 2)
    ramp = image(spark, [[(x * 8, y * 8, (x * y) % 256) for x in range(30)] for y in range(30)])
    assert stats.flatness(ramp).first().flat is False
    clear = image(spark, [[(0, 0, 0, 0)] * 4] * 4)
    assert tuple(stats.flatness(clear).first())[1:] == (False, 256)
    need = spark.createDataFrame([(1, 5), (2, 300)], "id int, n int")
    assert {r.id: r.preset for r in stats.nearest_preset(need, "n", presets(spark)).collect()} == {1: 6, 2: None}


def test_snap(spark):
    px = image(spark, [[(250, 250, 245), (10, 10, 10)]])
    aim = lambda rgb, most: stats.snap(px, spark.createDataFrame([(1, rgb)], "image_id int, rgb int"), most).first().rgb
    assert aim(0xFFFFFF, 48) == 250 * 65536 + 250 * 256 + 245
    assert aim(0xFF0000, 3) is None


def test_regions_against_flood(spark):
    px = noisy(spark, 9, 10, 10)
    g = grid(px, "r", "g", "b", "a")
    got = {(r.y, r.x): r.region for r in region.regions(px).collect()}
    seen = {}
    for y in range(10):
        for x in range(10):
            if g[y, x, 3] >= 128 and (y, x) not in seen:
                todo = [(y, x)]
                while todo:
                    j, i = todo.pop()
                    if (j, i) not in seen:
                        seen[j, i] = y * 10 + x
                        todo += [(b, c) for b, c in ((j - 1, i), (j + 1, i), (j, i - 1), (j, i + 1)) if 0 <= b < 10 and 0 <= c < 10 and (g[b, c] == g[j, i]).all()]
    assert got == seen


def test_resampling_by_any_factor(spark):
    """Against weights written out: area shares on a shorter axis, linear ones on a longer axis."""

    def axis(n, to, nearest):
        w = np.zeros((to, n))
        for t in range(to):
            if to > n:
                at = min(max((t + 0.5) * n / to - 0.5, 0), n - 1)
                for x, share in ((int((t + 0.5) * n / to), 1),) if nearest else ((int(at), 1 - at % 1), (min(int(at) + 1, n - 1), at % 1)):
                    w[t, x] += share
            else:
                for x in range(n):
                    w[t, x] = max(0, min((x + 1) / n, (t + 1) / to) - max(x / n, t / to))
        return w / w.sum(axis=1, keepdims=True)

    r = np.random.default_rng(3)
    image = r.integers(0, 256, size=(20, 25, 4))
    image[:6, :6, 3] = 0
    rows = [(1, x, y, *map(int, image[y, x])) for y in range(20) for x in range(25)]
    px = spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int, a int")
    for scale, nearest in ((0.4, False), (0.37, False), (1.0, False), (1.5, False), (2.3, True), (0.2, True), (0.01, False)):
        w, h = max(1, int(25 * scale + 0.5)), max(1, int(20 * scale + 0.5))
        ax, ay = axis(25, w, nearest), axis(20, h, nearest)
        alpha = np.einsum("ty,yx,sx->ts", ay, image[..., 3].astype(float), ax)
        colour = np.einsum("ty,yxc,sx->tsc", ay, image[..., :3] * image[..., 3:].astype(float), ax) / np.maximum(alpha, 1e-9)[..., None]
        got = np.full((h, w, 4), -1)
        for p in raster.resample(px, scale, nearest).collect():
            got[p.y, p.x] = p.r, p.g, p.b, p.a
        assert got.min() >= 0 and np.abs(got[..., 3] - alpha).max() <= 0.501
        if scale == 1:
            assert (got == image).all()
        else:
            assert np.abs(got[..., :3] - np.where(alpha[..., None] > 1e-6, colour, 0)).max() <= 0.501
    sized = lambda df: {(x.w, x.h) for x in raster.sizes(df).collect()}
    assert sized(raster.fit(px, 10)) == {(10, 8)} and sized(raster.fit(px, 24)) == {(24, 19)} and sized(raster.fit(px, 25)) == {(25, 20)}
    assert sorted(raster.resample(px, 0.2).collect()) == sorted(raster.downscale(px, 5).collect())


def test_images_above_the_budget_are_refused(spark):
    px = image(spark, [[(1, 2, 3)] * 4] * 3)
    assert raster.within_budget(px, 12).count() == 12
    with pytest.raises(Exception, match="12 pixels are more than 11"):
        raster.within_budget(px, 11).collect()


def test_upscaled_drawings_keep_the_source_size(spark):
    px = image(spark, [[(255, 0, 0)] * 6] * 4)
    for upscale, box in (("1", "6 4"), ("3", "18 12")):
        (row,) = pipeline.drawings(px, pipeline.Settings(upscale=upscale), TraceOptions(filter_speckle=1)).collect()
        assert f'width="6" height="4" viewBox="0 0 {box}"' in row.svg
    large = pipeline.scaled(px, "auto", nearest=True)
    assert large.agg(F.max("x"), F.max("y")).first() == (2047, 1364)


def test_profiles_drive_the_plans(spark):
    px = image(spark, [[(255, 255, 255)] * 9] * 3 + [[(255, 255, 255)] * 3 + [(0, 0, 0)] * 6] * 8)
    px = px.union(px.withColumn("image_id", F.lit(2))).union(px.withColumn("image_id", F.lit(3)))
    s, o = pipeline.of_profile("detail")
    assert (s.colors, s.upscale, o.mode, o.filter_speckle, o.corner_threshold, o.splice_threshold) == (64, "auto", "spline", 2, 45.0, 30.0)
    assert pipeline.of_profile("pixelExact")[1].mode == "none" and pipeline.of_profile("monoWhite")[0].stencil_ink == "white"
    chosen = spark.createDataFrame([(1, "balanced"), (2, "web"), (3, "no such profile")], "image_id int, profile string")
    got = {r.image_id: r for r in pipeline.drawings_by_profile(px, chosen).collect()}
    assert {k: (r.profile, r.width) for k, r in got.items()} == {1: ("balanced", 18), 2: ("web", 18)}
    alone = pipeline.drawings(px.where("image_id = 1"), *pipeline.of_profile("balanced")).first()
    assert got[1].svg == alone.svg


def test_kept_tables_do_not_carry_on_reckoned_sizes(spark, capsys):
    """Exploded rows are not taken for a small table, and rounds of joins do not multiply sizes."""
    t = stored(spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(9_999))).alias("k")))
    t.groupBy("k").count().join(t, "k").explain()
    assert "Broadcast" not in capsys.readouterr().out
    for _ in range(4):
        t = stored(t.join(t.select("k"), "k"))
    t.explain(mode="cost")
    assert "E+" not in capsys.readouterr().out
    assert t.count() == 10_000


def test_groups_come_whole_and_spread(spark, monkeypatch):
    """Every group in one call and in its order, whatever the batches; small tables are not joined into one partition."""
    monkeypatch.setattr(groups, "BATCH", 50)
    rows = spark.range(400).select(F.expr("if(id % 20 = 0, null, id % 20)").alias("g"), (F.lit(400) - F.col("id")).alias("v"))

    def kernel(t, starts):
        g, v = t.column("g").to_pylist(), t.column("v").to_pylist()
        for a, b in zip(starts, [*starts[1:], len(g)]):
            yield pa.record_batch({"g": pa.array([g[a]], pa.int64()), "n": [b - a], "sorted": [v[a:b] == sorted(v[a:b])]})

    out = groups.over_groups(rows, ["g"], ["v"], kernel, "g long, n long, sorted boolean")
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r.g or 0, r.n, r.sorted) for r in out.collect()) == [(g, 20, True) for g in range(20)]


def test_many_tiles_in_a_call():
    """Labels and pieces of many tiles at once, against a search and a walk through each."""
    r = np.random.default_rng(3)
    cells = sorted((g, y, x, int(r.integers(0, 2))) for g in range(40) for y in range(5) for x in range(5) if r.random() < 0.9)
    group, y, x, value = (np.array(c) for c in zip(*cells))
    at = {c[:3]: i for i, c in enumerate(cells)}
    want = np.full(len(cells), -1)
    for i in range(len(cells)):
        todo = [i] if want[i] < 0 else []
        while todo:
            j = todo.pop()
            want[j] = i
            g, v, u, c = cells[j]
            near = [at.get((g, v + dv, u + du)) for dv, du in ((0, 1), (1, 0), (0, -1), (-1, 0))]
            todo += [k for k in near if k is not None and want[k] < 0 and cells[k][3] == c]
    assert (tiles.label(x, y, value, group, 5) == want).all()
    links = []
    for g in range(60):
        keys = r.permutation(30)[:12].tolist()
        cut = int(r.integers(0, 12))
        ring, rest = keys[:cut], keys[cut:]
        to = dict(zip(ring, ring[1:] + ring[:1])) | dict(zip(rest, rest[1:] + [99]))
        links += sorted((g, k, n) for k, n in to.items())
    g, key, to = (np.array(c) for c in zip(*links))
    piece, place, leaves = tiles.walked(key, to, np.flatnonzero(np.diff(g, prepend=-1)))
    for i in range(len(key)):
        own = dict(zip(key[g == g[i]].tolist(), to[g == g[i]].tolist()))
        k, n = int(key[piece[i]]), 0
        while k != key[i]:
            k, n = own[k], n + 1
        assert g[piece[i]] == g[i] and n == place[i]
        end = leaves[piece[i]]
        ring = [int(key[i])]
        while own.get(ring[-1]) not in (None, 99, ring[0]):
            ring.append(own[ring[-1]])
        assert (end < 0) == (own[ring[-1]] == ring[0]) and (to[end] == 99 if end >= 0 else key[piece[i]] == min(ring))


def test_border_seeds_write_no_distance_into_filters(spark, capsys):
    """Colours' distances are found once; pushed below their projections they would outgrow generated code."""
    px = image(spark, [[(9, 9, 9), (9, 9, 9), (9, 9, 9, 0)], [(9, 9, 9), (9, 9, 9), (200, 9, 9)], [(9, 9, 9), (9, 9, 9), (9, 9, 9)]])
    out = region.border_seeds(px, 12.0)
    assert sorted((r.x, r.y) for r in out.collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 2)]
    out.explain()
    assert "POWER" not in capsys.readouterr().out
