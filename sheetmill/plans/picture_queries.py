"""Queries on whole pictures and on a training run's draws, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import epochs as E
from ..operators import layout as Y
from ..operators import networks as N
from ..operators import pictures as P
from ..operators import samples as X
from ..operators import training as L
from ..functions import scalars as S
from . import bindings as B
from . import detail_queries as D
from . import vision_queries as V

STRENGTH = 1.3


def network_inputs(spark, sf):
    """Every picture shrunk to 5 x 3 by area, as a network takes it."""
    values = P.network_input(B.pictures(spark, sf), 5, 3).select("image_id", F.posexplode("values").alias("place", "value"))
    return values.select("image_id", "place", F.round("value", 6).alias("value"))


def lanczos_pictures(spark, sf):
    """Every picture to 12 x 6 by windowed sinc: wider across, narrower down."""
    return P.resized(B.pictures(spark, sf), 12, 6, "lanczos").select("image_id", "width", "height", F.hex("gray").alias("gray"))


def elastic_pictures(spark, sf):
    """Every picture and sixteen points on it, moved by its own elastic field."""
    points = F.array(*[F.struct(F.lit(2 * j + 0.25).alias("x"), F.lit(2 * i + 0.25).alias("y")) for i in range(4) for j in range(4)])
    moved = P.elastic(B.pictures(spark, sf).withColumn("points", points), F.col("image_id"), STRENGTH)
    rows = moved.select("image_id", F.hex("gray").alias("gray"), F.posexplode("points").alias("id", "p"))
    return rows.select("image_id", "gray", "id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def painted_masks(spark, sf):
    """The masks of every picture: page, spots by kind, and the page's outline as a grid's."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero, seven, label = F.lit(0), F.lit(7), F.col("label")
    page = F.array(corner(zero, zero), corner(7 - label % 3, zero), corner(seven, seven), corner(label % 2, F.lit(6)))
    spot = lambda k: F.struct(
        F.lit("bubble" if k % 4 else "marker").alias("kind"), F.lit(float(k % 4 * 2)).alias("x"), F.lit(float(k // 4 * 2)).alias("y"), F.lit(k % 3 > 0).alias("visible")
    )
    samples = B.pictures(spark, sf).select("image_id", page.alias("page"), F.array(*map(spot, range(16))).alias("spots"), F.array(page).alias("grids"))
    return P.painted_masks(samples, 8, 8, {"marker": 1.0, "bubble": 0.5}).select("image_id", "mask", F.hex("gray").alias("gray"))


def epoch_draws(spark, sf):
    """An epoch of as many draws as there are labelled rows, each label as likely."""
    rows = L.balanced_weights(B.manifest(spark, sf).where("gt_label is not null")).select("image_id", "gt_label", "weight")
    return L.epoch_draws(rows, rows.count(), seed=7, epoch=2)


EPOCHS, STEPS, RATE, LEAST_RATE, DECAY = 4, 2, 0.05, 0.001, 0.01
TAUGHT = ("size", "spaces", "vowels")


def training_history(spark, sf):
    """The epochs of a classifier of labelled documents, by three numbers of each whole text; the best one is marked."""
    text, n = F.coalesce("text", F.lit("")), F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("double")
    without = lambda letters: F.length(F.translate(text, letters, "")) / n
    numbers = B.table(spark, sf, "documents").select(
        F.col("doc_id").alias("_id"), F.least(F.lit(1.0), n / 4000.0).alias("size"), (1 - without(" ")).alias("spaces"), (1 - without("aeiou")).alias("vowels")
    )
    rows = L.balanced_weights(B.manifest(spark, sf).where("gt_label is not null")).withColumn("split", S.hash_split(F.col("image_id")))
    rows = rows.join(numbers, rows["image_id"] == numbers["_id"])
    found = E.train(rows, TAUGHT, ["blank", "filled"], epochs=EPOCHS, steps=STEPS, rate=RATE, least_rate=LEAST_RATE, decay=DECAY, seed=7)
    history = spark.createDataFrame([tuple(h.values()) for h in found.history], "epoch int, rate double, train_loss double, train_accuracy double, val_loss double, val_accuracy double")
    numbers = [F.round(c, 6).alias(c) for c in history.columns[1:]]
    return history.select("epoch", *numbers, (F.col("epoch") == found.epoch).alias("best"))


def network_layout(spark, sf):
    """A small network of seeded weights over every picture, grown to 16 x 16, and its peaks."""
    weights = N.seeded_weights(base=4, n_out=4, seed=3)
    found = N.predict_layout(B.pictures(spark, sf), weights, 16, 16, page=0.5, marker=0.5, bubble=0.5, radius=1, most=6)
    peaks = lambda c: F.transform(c, lambda p: F.concat_ws(":", p["rank"], F.round(p["x"], 3), F.round(p["y"], 3), F.round(p["score"], 3)))
    return found.select("image_id", "n_markers", "n_bubbles", F.array_join(peaks("markers"), " ").alias("markers"), F.array_join(peaks("bubbles"), " ").alias("bubbles"), F.concat_ws(",", F.transform("page", lambda v: v.cast("string"))).alias("page"))


POINTS = [("marker", "m0", 1, 1), ("marker", "m1", 6, 1), ("marker", "m2", 6, 6), ("marker", "m3", 1, 6), ("bubble", "b0", 2, 3), ("bubble", "b1", 5, 4)]


def sample_pictures(spark, sf):
    """Two training samples of every picture, a clean one and a moved one with covered marks, and the marks that can be seen."""
    pictures = B.pictures(spark, sf)
    points = spark.createDataFrame([(kind, name, float(x), float(y)) for kind, name, x, y in POINTS], "kind string, id string, x double, y double")
    geometry = Y.training_geometry(pictures, 8, 8, 24, 24, augmented=1, seed=5, shift=4.0, bend=0.0)
    labels = X.with_covers(Y.training_labels(geometry, points, 24, 24, occluded=0.6, seed=6), 7, radii=(1, 3), least_half=1, room=2)
    samples = X.described(geometry, labels, pictures.select("image_id", F.lit("train").alias("split")))
    met = samples.join(pictures.select(F.col("image_id").alias("base_image_id"), "width", "height", "gray"), "base_image_id")
    seen = lambda c: F.size(F.filter(c, lambda p: p["visible"]))
    painted = X.warped_samples(met, 24, 24).select("sample_id", F.hex("gray").alias("gray"))
    counts = samples.select("sample_id", F.size("covers").alias("covers"), seen("markers").alias("visible_markers"), seen("bubbles").alias("visible_bubbles"))
    return painted.join(counts, "sample_id")


QUERIES = {f.__name__: f for f in (network_inputs, lanczos_pictures, elastic_pictures, painted_masks, epoch_draws, training_history, network_layout, sample_pictures)}

# How much of each cell out (j of m) a cell in (i of 8) covers.
_COVER = "greatest(0, least(i + 1, (j + 1) * 8.0::DOUBLE / {m}) - greatest(i, j * 8.0::DOUBLE / {m})) * {m} / 8.0::DOUBLE"
_LOBES = """SELECT j, i, v / sum(v) OVER (PARTITION BY j) AS w FROM (
  SELECT j, i, CASE WHEN t = 0 THEN 1.0::DOUBLE WHEN abs(t) < 3 THEN sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) ELSE 0.0::DOUBLE END AS v
  FROM (SELECT j, i, (i + 0.5::DOUBLE - (j + 0.5::DOUBLE) * 8 / {m}) / greatest(8.0::DOUBLE / {m}, 1) AS t FROM range(0, {m}) a(j), range(0, 8) b(i)))"""
_DRAW = "((CAST(concat('0x', substr(sha1({seed}), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
_SEED = "CAST(image_id AS VARCHAR) || ':' || "
_CELL = _DRAW.format(seed=_SEED + "c || CAST(k AS VARCHAR) || ':{part}'")
_BEND = _DRAW.format(seed=_SEED + "'bend_{axis}'")
_TWO_PI = "(2 * pi())"
_AT = "CASE WHEN {x} BETWEEN 0 AND 7 AND {y} BETWEEN 0 AND 7 THEN g[CAST({y} * 8 + {x} + 1 AS BIGINT)] ELSE 255 END"



def _samples_sql() -> str:
    unit = lambda text: f"(CAST(concat('0x', substr(sha1({text}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"
    shift = lambda axis: f"CASE s WHEN 0 THEN 0.0::DOUBLE ELSE ({unit(f"'5:' || CAST(image_id AS VARCHAR) || ':1:{axis}'")} * 2 - 1) * 4.0::DOUBLE END AS d{axis}"
    chance = lambda what: _DRAW.format(seed=f"'7:' || sample_id || ':' || id || ':{what}'")
    whole = lambda what, low, high: f"(CAST(floor({chance(what)} * ({high} - ({low}) + 1)) AS INTEGER) + {low})"
    middle = lambda axis: f"CAST(round_even({axis}, 0) AS INTEGER) + CASE WHEN f THEN 0 ELSE {whole(f'at_{axis}', '-r', 'r')} END AS m{axis}"
    reach = lambda axis: f"CASE WHEN f THEN r ELSE {whole(f'half_{axis}', 'greatest(1, r // 2)', '(r + 1)')} END AS h{axis}"
    return f"""WITH {V.PIXELS_SQL}, pic AS (SELECT image_id, list(gray ORDER BY y, x) AS g FROM px GROUP BY image_id),
gm AS (SELECT *, CAST(image_id AS VARCHAR) || CASE s WHEN 0 THEN '_clean' ELSE '_aug001' END AS sample_id, {shift("x")}, {shift("y")} FROM pic, range(0, 2) a(s)),
lb AS (SELECT sample_id, s, kind, id, round(px * 3 + dx, 3) AS x, round(py * 3 + dy, 3) AS y FROM gm, (VALUES {", ".join(map(str, POINTS))}) v(kind, id, px, py)),
fr AS (SELECT *, x >= 0 AND x < 24 AND y >= 0 AND y < 24 AS inside, kind = 'marker' AND s > 0 AND {unit("'6:' || sample_id || ':' || id")} < 0.6::DOUBLE AS occluded,
  {chance("full")} < 0.45::DOUBLE AS f, {whole("radius", "1", "3")} AS r FROM lb),
cv AS (SELECT sample_id, id, {middle("x")}, {middle("y")}, {reach("x")}, {reach("y")}, {whole("shade", "190", "255")} AS shade FROM fr WHERE occluded AND inside),
nc AS (SELECT sample_id, CAST(count(*) FILTER (occluded AND inside) AS INTEGER) AS covers, CAST(count(*) FILTER (kind = 'marker' AND inside AND NOT (occluded AND f)) AS INTEGER) AS visible_markers,
  CAST(count(*) FILTER (kind = 'bubble' AND inside) AS INTEGER) AS visible_bubbles FROM fr GROUP BY sample_id),
sr AS (SELECT sample_id, g, x, y, floor((x - dx) / 3) AS l, floor((y - dy) / 3) AS t, (x - dx) / 3 - floor((x - dx) / 3) AS fx, (y - dy) / 3 - floor((y - dy) / 3) AS fy FROM gm, range(0, 24) a(x), range(0, 24) b(y)),
sm AS (SELECT sample_id, x, y, CAST(round_even(({_AT.format(x="l", y="t")} * (1 - fx) + {_AT.format(x="(l + 1)", y="t")} * fx) * (1 - fy)
  + ({_AT.format(x="l", y="(t + 1)")} * (1 - fx) + {_AT.format(x="(l + 1)", y="(t + 1)")} * fx) * fy, 0) AS INTEGER) AS gray FROM sr),
hd AS (SELECT sample_id, x, y, arg_max(shade, id) AS shade FROM cv JOIN (SELECT x, y FROM range(0, 24) a(x), range(0, 24) b(y)) ON abs(x - mx) <= hx AND abs(y - my) <= hy GROUP BY ALL)
SELECT sample_id, string_agg(printf('%02X', coalesce(shade, gray)), '' ORDER BY y, x) AS gray, any_value(covers) AS covers, any_value(visible_markers) AS visible_markers, any_value(visible_bubbles) AS visible_bubbles
FROM sm LEFT JOIN hd USING (sample_id, x, y) JOIN nc USING (sample_id) GROUP BY sample_id"""


def _training_sql() -> str:
    """Each step's sums and moved weights as relations of one row: ``w`` weights, ``m`` and ``v`` their moments."""
    classes, inputs = ("blank", "filled"), (*TAUGHT, "1.0::DOUBLE")
    places = [(k, i) for k in range(len(classes)) for i in range(len(inputs))]
    z = [" + ".join(f"w{k}{i} * {x}" for i, x in enumerate(inputs)) for k in range(len(classes))]
    scored = f"SELECT *, exp(z0) / (exp(z0) + exp(z1)) AS p0, exp(z1) / (exp(z0) + exp(z1)) AS p1 FROM (SELECT *, {z[0]} AS z0, {z[1]} AS z1 FROM ft, {{state}} WHERE split = '{{split}}' {{more}})"
    measured = "sum(-w * ln(CASE WHEN gt_label = 'blank' THEN p0 ELSE p1 END)) AS loss, sum(w) AS w, count(*) FILTER ((z0 >= z1) = (gt_label = 'blank')) AS good, count(*) AS n"
    slopes = ", ".join(f"sum(w * (p{k} - CASE WHEN gt_label = '{classes[k]}' THEN 1 ELSE 0 END) * {inputs[i]}) / sum(w) AS g{k}{i}" for k, i in places)
    parts = ["s0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS {name}{k}{i}" for name in "wmv" for k, i in places) + ")"]
    t = 0
    for epoch in range(1, EPOCHS + 1):
        rate = f"({LEAST_RATE}::DOUBLE + ({RATE}::DOUBLE - {LEAST_RATE}::DOUBLE) * (1 + cos(pi() * {epoch - 1} / {EPOCHS})) / 2)"
        place = _DRAW.format(seed=f"'7:{epoch}:' || CAST(image_id AS VARCHAR)")
        for step in range(STEPS):
            t += 1
            parts.append(f"g{t} AS MATERIALIZED (SELECT {slopes}, {measured} FROM ({scored.format(state=f's{t - 1}', split='train', more=f'AND floor({place} * {STEPS}) = {step}')}))")
            mean, square = (lambda a: f"(0.9::DOUBLE * m{a} + 0.1::DOUBLE * g{a})"), (lambda a: f"(0.999::DOUBLE * v{a} + 0.001::DOUBLE * g{a} * g{a})")
            move = lambda a: f"{rate} * {mean(a)} / (1 - 0.9::DOUBLE ** {t}) / (sqrt({square(a)} / (1 - 0.999::DOUBLE ** {t})) + 1e-8::DOUBLE)"  # noqa: B023, E731
            cells = [c for k, i in places for c in (f"w{k}{i} * (1 - {rate} * {DECAY}::DOUBLE) - {move(f'{k}{i}')} AS w{k}{i}", f"{mean(f'{k}{i}')} AS m{k}{i}", f"{square(f'{k}{i}')} AS v{k}{i}")]
            parts.append(f"s{t} AS MATERIALIZED (SELECT {', '.join(cells)} FROM s{t - 1}, g{t})")
        seen = " UNION ALL ".join(f"SELECT loss, w, good, n FROM g{k}" for k in range(t - STEPS + 1, t + 1))
        parts.append(f"h{epoch} AS (SELECT {epoch} AS epoch, {rate} AS rate, a.*, b.* FROM (SELECT sum(loss) / sum(w) AS train_loss, sum(good) / sum(n) AS train_accuracy FROM ({seen})) a, "
                     f"(SELECT loss / w AS val_loss, good / n AS val_accuracy FROM (SELECT {measured} FROM ({scored.format(state=f's{t}', split='val', more='')}))) b)")  # fmt: skip
    history = " UNION ALL ".join(f"SELECT * FROM h{e}" for e in range(1, EPOCHS + 1))
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in ("rate", "train_loss", "train_accuracy", "val_loss", "val_accuracy"))
    return f"""WITH {V.SPLIT_SQL}, nm AS (SELECT doc_id AS image_id, coalesce(text, '') AS t, CAST(greatest(1, length(coalesce(text, ''))) AS DOUBLE) AS n FROM documents),
ft AS MATERIALIZED (SELECT image_id, gt_label, split, 1.0::DOUBLE / count(*) OVER (PARTITION BY gt_label) AS w, least(1.0::DOUBLE, n / 4000) AS size,
  1 - length(replace(t, ' ', '')) / n AS spaces, 1 - length(translate(t, 'aeiou', '')) / n AS vowels FROM mf JOIN nm USING (image_id) WHERE gt_label IS NOT NULL),
{", ".join(parts)}, hs AS (SELECT * FROM ({history}))
SELECT epoch, {rounded}, epoch = (SELECT epoch FROM hs ORDER BY val_accuracy DESC, epoch LIMIT 1) AS best FROM hs"""


ORACLES = {
    "training_history": _training_sql(),
    "sample_pictures": _samples_sql(),
    "network_inputs": f"""WITH {V.PIXELS_SQL}, wx AS (SELECT j, i, {_COVER.format(m=5)} AS w FROM range(0, 5) a(j), range(0, 8) b(i)),
wy AS (SELECT j, i, {_COVER.format(m=3)} AS w FROM range(0, 3) a(j), range(0, 8) b(i)),
r AS (SELECT image_id, y, j, sum(gray * w) AS v FROM px JOIN wx ON x = i AND w > 0 GROUP BY ALL)
SELECT image_id, CAST(wy.j * 5 + r.j AS INTEGER) AS place, round((sum(v * w) / 255 - 0.5::DOUBLE) / 0.5::DOUBLE, 6) + 0.0::DOUBLE AS value FROM r JOIN wy ON y = i AND w > 0 GROUP BY image_id, wy.j, r.j""",
    "lanczos_pictures": f"""WITH {V.PIXELS_SQL}, wx AS ({_LOBES.format(m=12)}), wy AS ({_LOBES.format(m=6)}),
r AS (SELECT image_id, y, j, sum(gray * w) AS v FROM px JOIN wx ON x = i GROUP BY ALL),
o AS (SELECT image_id, wy.j AS y, r.j AS x, greatest(0, least(255, CAST(round_even(sum(v * w), 0) AS INTEGER))) AS gray FROM r JOIN wy ON y = i GROUP BY image_id, wy.j, r.j)
SELECT image_id, 12 AS width, 6 AS height, string_agg(printf('%02X', gray), '' ORDER BY y, x) AS gray FROM o GROUP BY image_id""",
    "elastic_pictures": f"""WITH {V.PIXELS_SQL}, pic AS (SELECT image_id, list(gray ORDER BY y, x) AS g FROM px GROUP BY image_id),
co AS (SELECT image_id, c, k // 6 AS y, k % 6 AS i, sqrt(-2 * ln({_CELL.format(part="r")})) * cos({_TWO_PI} * {_CELL.format(part="a")}) * ({STRENGTH}::DOUBLE / 2.5::DOUBLE) AS z
  FROM pic, (VALUES ('x'), ('y')) v(c), range(0, 48) a(k)),
wt AS (SELECT x, greatest(0, least(5, a)) AS i, CASE WHEN abs(a - m) <= 1 THEN 1.25::DOUBLE * abs(a - m) ** 3 - 2.25::DOUBLE * abs(a - m) ** 2 + 1
    ELSE -0.75::DOUBLE * abs(a - m) ** 3 + 3.75::DOUBLE * abs(a - m) ** 2 - 6 * abs(a - m) + 3 END AS w
  FROM (SELECT x, (x + 0.5::DOUBLE) * 0.75::DOUBLE - 0.5::DOUBLE AS m, CAST(floor((x + 0.5::DOUBLE) * 0.75::DOUBLE - 0.5::DOUBLE) AS BIGINT) + t AS a FROM range(0, 8) p(x), range(-1, 3) q(t))),
up AS (SELECT image_id, y, x, sum(z * w) FILTER (c = 'x') AS dx, sum(z * w) FILTER (c = 'y') AS dy FROM co JOIN wt USING (i) GROUP BY ALL),
mv AS (SELECT image_id, y, x,
  greatest(-{STRENGTH}::DOUBLE, least({STRENGTH}::DOUBLE, dx + {STRENGTH}::DOUBLE * 0.35::DOUBLE * sin({_TWO_PI} * {_BEND.format(axis="x")}) * sin(y * {_TWO_PI} / 7))) AS dx,
  greatest(-{STRENGTH}::DOUBLE, least({STRENGTH}::DOUBLE, dy + {STRENGTH}::DOUBLE * 0.35::DOUBLE * cos({_TWO_PI} * {_BEND.format(axis="y")}) * sin(x * {_TWO_PI} / 7))) AS dy FROM up),
fr AS (SELECT mv.image_id, y, x, g, floor(x - dx) AS l, floor(y - dy) AS t, x - dx - floor(x - dx) AS fx, y - dy - floor(y - dy) AS fy FROM mv JOIN pic USING (image_id)),
sm AS (SELECT image_id, y, x, round_even(({_AT.format(x="l", y="t")} * (1 - fx) + {_AT.format(x="(l + 1)", y="t")} * fx) * (1 - fy)
  + ({_AT.format(x="l", y="(t + 1)")} * (1 - fx) + {_AT.format(x="(l + 1)", y="(t + 1)")} * fx) * fy, 0) AS gray FROM fr),
nw AS (SELECT image_id, string_agg(printf('%02X', CAST(gray AS INTEGER)), '' ORDER BY y, x) AS gray FROM sm GROUP BY image_id)
SELECT image_id, gray, CAST(y // 2 * 4 + x // 2 AS INTEGER) AS id, round(x + 0.25::DOUBLE + dx, 6) + 0.0::DOUBLE AS x, round(y + 0.25::DOUBLE + dy, 6) + 0.0::DOUBLE AS y
FROM mv JOIN nw USING (image_id) WHERE y % 2 = 0 AND x % 2 = 0""",
    "painted_masks": D.ORACLES["layout_masks"].rpartition("SELECT image_id, mask, count(*)")[0].rstrip()
    + """,
ln AS (SELECT *, greatest(0, least(1, CASE WHEN (qx - ax) * (qx - ax) + (qy - ay) * (qy - ay) = 0 THEN 0.0::DOUBLE
    ELSE ((x - ax) * (qx - ax) + (y - ay) * (qy - ay)) / ((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)) END)) AS u FROM eg, range(0, 8) a(y), range(0, 8) b(x)),
gd AS (SELECT image_id, y, x, CAST(max(round_even(255 * greatest(0, least(1, 1.5::DOUBLE - sqrt((x - ax - u * (qx - ax)) * (x - ax - u * (qx - ax)) + (y - ay - u * (qy - ay)) * (y - ay - u * (qy - ay))))), 0)) AS INTEGER) AS gray
  FROM ln GROUP BY ALL),
ev AS (SELECT image_id, mask, y, x FROM lb, (VALUES ('page'), ('marker'), ('bubble'), ('grid')) v(mask), range(0, 8) a(y), range(0, 8) b(x)),
pt2 AS (SELECT * FROM al UNION ALL SELECT image_id, 'grid', y, x, gray FROM gd)
SELECT image_id, mask, string_agg(printf('%02X', CAST(coalesce(gray, 0) AS INTEGER)), '' ORDER BY y, x) AS gray FROM ev LEFT JOIN pt2 USING (image_id, mask, y, x) GROUP BY image_id, mask""",
    "epoch_draws": f"""WITH {V.SPLIT_SQL}, b AS (SELECT image_id, CAST(round_even(1.0::DOUBLE / count(*) OVER (PARTITION BY gt_label) * 1e12::DOUBLE, 0) AS HUGEINT) AS u FROM mf WHERE gt_label IS NOT NULL),
l AS (SELECT image_id, sum(u) OVER (ORDER BY sha1(CAST(image_id AS VARCHAR)), image_id) - u AS at FROM b),
n AS (SELECT CAST(sum(u) AS HUGEINT) AS total, count(*) AS n FROM b),
d AS (SELECT i AS place, least(total - 1, CAST(round_even(CAST(concat('0x', substr(sha1('7:2:' || CAST(i AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE * CAST(total AS DOUBLE), 0) AS HUGEINT)) AS p
  FROM n, range(0, (SELECT count(*) FROM b)) r(i))
SELECT place, image_id FROM d ASOF JOIN l ON d.p >= l.at""",
}
