"""Column functions: thresholds, orders of choices, names and paths, and the confidence algebra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK_THRESHOLD, FILLED_THRESHOLD, MARGIN_THRESHOLD = 0.025, 0.08, 0.025
LOW_CONFIDENCE = 0.45


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def safe_double(x: Column, default: float | None = None) -> Column:
    """A number, or ``default`` for null and for what can't be read as one."""
    return F.coalesce(x.cast("string").try_cast("double"), F.lit(default).cast("double"))


def prelabel(score: Column, blank: float = BLANK_THRESHOLD, filled: float = FILLED_THRESHOLD) -> Column:
    """Both thresholds are inclusive; blank is asked first."""
    return F.when(score <= F.lit(blank), "blank").when(score >= F.lit(filled), "filled").otherwise("ambiguous")


def choice_rank(choice: Column) -> Column:
    """Place of a choice among those of its item: digits, then T/F, sign and comma places; others 99."""
    after = F.regexp_extract(choice, r"^after_(\d+)", 1)
    return (
        F.when(choice.rlike(r"^\d$"), choice.try_cast("int"))
        .when(choice == "T", 0)
        .when(choice == "F", 1)
        .when(choice == "-", 0)
        .when(after != "", after.try_cast("int"))
        .otherwise(99)
    )


def letter_rank(choice: Column, letters: Sequence[str] = ("A", "B", "C", "D")) -> Column:
    place = F.array_position(F.array(*[F.lit(x) for x in letters]), choice)
    return F.when(place == 0, len(letters)).otherwise(place - 1).cast("int")


def record_score(columns: Sequence[str], key: str = "group_score_key") -> Column:
    """The first of: the column that ``key`` names, filled_probability, fill_score, darkness_score, 0."""
    known = [c for c in ("filled_probability", "fill_score", "darkness_score") if c in columns]
    parts = []
    if key in columns:
        named = F.lit(None).cast("double")
        for c in known:
            named = F.when(F.col(key) == c, F.col(c)).otherwise(named)
        parts.append(named)
    return F.coalesce(*parts, *[F.col(c) for c in known], F.lit(0.0)).cast("double")


def normalized(x: Column) -> Column:
    """Null and the empty text are one value in comparisons."""
    return F.coalesce(x.cast("string"), F.lit(""))


def item_key(section: Column, item: Column) -> Column:
    return F.concat_ws(":", section, item)


def section_of(key: Column) -> Column:
    return F.split_part(key, F.lit(":"), F.lit(1))


def item_of(key: Column) -> Column:
    return F.regexp_replace(key, "^[^:]*:", "")


def block_key(block: Column, section: Column) -> Column:
    """The block that a spec belongs to, with the section as fallback."""
    return F.coalesce(
        F.nullif(block, F.lit("")), F.when(section == "identity", F.lit("identity")), F.nullif(section, F.lit("")), F.lit("unknown")
    )


def relative_path(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def image_id(path: Column, root: str) -> Column:
    """An id from a path: relative to the root (else its base name), no suffix, runs of other
    characters than letters and digits as one underscore."""
    inside = path.startswith(root.rstrip("/") + "/")
    shown = F.when(inside, relative_path(path, root)).otherwise(F.regexp_extract(path, r"([^/]*)$", 1))
    bare = F.regexp_replace(shown, r"(?<=[^/])\.[^./]*$", "")
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(bare, "[^A-Za-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("sheet"))


def base_id(path: Column) -> Column:
    """The base name without its suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def safe_name(x: Column) -> Column:
    """Other characters than letters, digits, - and _ as one underscore each."""
    return F.regexp_replace(x, r"[^\p{L}\p{N}_-]", "_")


def hash_share(identity: Column) -> Column:
    """A number in [0, 1] from the first eight hex digits of sha1."""
    return F.conv(F.substring(F.sha1(identity.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))


def hash_split(identity: Column, validation: float = 0.10, test: float = 0.10) -> Column:
    share = hash_share(identity)
    return F.when(share < F.lit(test), "test").when(share < F.lit(test + validation), "val").otherwise("train")


def compact_value(sign: Column, comma: Column, digits: Column) -> tuple[Column, Column]:
    """A signed decimal from its parts: as marked (``_`` for an empty digit) and without empty places.

    ``digits`` is an array of text; the comma stands behind the digit its choice names, inside the
    number; what has no digit left is null."""
    shown = F.transform(digits, lambda d: F.coalesce(d, F.lit("_")))
    place = F.greatest(F.lit(1), F.least(F.size(digits), F.regexp_extract(comma, r"^after_(\d+)", 1).try_cast("int")))
    with_comma = F.when(
        comma.startswith("after_"),
        F.concat(F.slice(shown, F.lit(1), place), F.array(F.lit(",")), F.slice(shown, place + 1, F.size(shown))),
    ).otherwise(shown)
    raw = F.concat(F.when(F.coalesce(sign, F.lit("")) != "", "-").otherwise(""), F.array_join(with_comma, ""))
    bare = F.replace(raw, F.lit("_"), F.lit(""))
    return raw, F.when(bare.isin("", "-", ",", "-,"), None).otherwise(bare)


def value_choices(section: Column, value: Column) -> Column:
    """The choices that make up a value: of a number the sign, the comma's place and the digits."""
    signs = F.transform(
        F.split(value, ""),
        lambda c, i: F.when(c == ",", F.concat(F.lit("after_"), F.greatest(F.lit(1), i).cast("string"))).when(
            (c == "-") | c.rlike(r"^\d$"), c
        ),
    )
    return (
        F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>"))
        .when(section.isin("part1", "part2"), F.array(value))
        .when(section == "part3", F.filter(signs, lambda c: c.isNotNull()))
        .otherwise(F.array().cast("array<string>"))
    )


def crop_name(path: Column, label_dir: str) -> dict[str, Column]:
    """What a crop's path below its label's folder tells: section, image_id, group_id, choice, field."""
    inner = relative_path(path, label_dir)
    stem = base_id(inner)
    image = F.split_part(stem, F.lit("__"), F.lit(1))
    tail = F.when(F.contains(stem, F.lit("__")), F.regexp_replace(stem, "^.*?__", "")).otherwise("")
    parts = F.split(tail, "_")
    section = F.when(F.contains(inner, F.lit("/")), F.split_part(inner, F.lit("/"), F.lit(1))).otherwise("")
    field = (
        F.when(section == "identity", F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 2)), "_"))
        .when(section.isin("part1", "part2"), F.lit("answer"))
        .when((section == "part3") & (F.size(parts) >= 3), F.get(parts, 2))
        .otherwise("")
    )
    return {
        "section": section,
        "image_id": image,
        "group_id": F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1)), "_"),
        "choice": F.element_at(parts, -1),
        "field": field,
    }


def mark_glyph(correct: Column) -> Column:
    return F.when(correct == "True", "✓").when(correct == "False", "✗").otherwise("")


def section_rank(section: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(x) for x in ("identity", "part1", "part2", "part3")]), section)
    return F.when(F.coalesce(place, F.lit(0)) == 0, 99).otherwise(place - 1).cast("int")


# -- confidence -------------------------------------------------------------------------------


def or_default(x: Column, default: float) -> Column:
    """Null and zero thresholds fall back to the default."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(default))


def score_confidence(score: Column, margin: Column, filled: Column, margin_threshold: Column) -> Column:
    by_margin = margin / F.greatest(or_default(margin_threshold, MARGIN_THRESHOLD) * 2, F.lit(1e-6))
    by_score = score / F.greatest(or_default(filled, FILLED_THRESHOLD) * 2, F.lit(1e-6))
    return F.when(margin.isNotNull(), clamp(by_margin)).otherwise(clamp(by_score))


def metadata_confidence(*known: Column) -> Column:
    """The least of the confidences that are known, else 1."""
    values = [clamp(x) for x in known]
    return F.coalesce(F.least(*values) if len(values) > 1 else values[0], F.lit(1.0))


def blank_confidence(top: Column, filled: Column) -> Column:
    return F.round(clamp(1 - top / F.greatest(or_default(filled, FILLED_THRESHOLD), F.lit(1e-6))), 6)


def residual_status(rms: Column, review: float = 6.0, fail: float = 10.0) -> Column:
    return F.when(rms > F.lit(fail), "alignment_failed").when(rms > F.lit(review), "need_review").otherwise("ok")


def needs_review(alignment: Column, grid: Column) -> Column:
    """A known grid status hides the alignment status."""
    return F.when(grid.isNotNull(), grid != "ok").otherwise(F.coalesce(alignment != "ok", F.lit(False)))


def hard_failure(alignment: Column, grid: Column, decode_allowed: Column) -> Column:
    return F.when(
        grid.isNotNull(), (grid == "alignment_failed") | F.coalesce(~decode_allowed, F.lit(False))
    ).otherwise(F.coalesce(alignment == "alignment_failed", F.lit(False)))


def f_measure(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return precision, recall, F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def rate(x: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(x / total, 6)).otherwise(0.0)


def resolved_path(path: Column, base: str) -> Column:
    """An absolute path as it is, another one below ``base``."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def float_list(text: str, expected: int) -> tuple[float, ...]:
    """An option of comma-separated numbers; blanks between commas do not count."""
    found = tuple(float(x) for x in text.split(",") if x.strip())
    if len(found) != expected:
        raise ValueError(f"{expected} numbers are expected: {text!r}")
    return found
