"""Bubble specifications generated from a template document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = """
    canonical struct<width:int,height:int>, bubble array<int>, padding int, tolerance double,
    marks array<struct<name:string,x:int,y:int>>, regions array<struct<name:string,bbox:array<int>>>,
    part1 struct<choices:array<string>,columns:array<struct<question_start:int,question_count:int,choice_x:array<double>,row_y_start:double,row_y_step:double,bbox:array<int>>>>,
    sbd struct<digits:array<string>,column_x:array<double>,row_y_start:double,row_y_step:double,bbox:array<int>>,
    exam_code struct<digits:array<string>,column_x:array<double>,row_y_start:double,row_y_step:double,bbox:array<int>>,
    part2 struct<choices:array<string>,choice_labels:map<string,string>,statements:array<string>,row_y_start:double,row_y_step:double,
        questions:array<struct<question_number:int,choice_x:array<double>,bbox:array<int>>>>,
    part3 struct<digit_choices:array<string>,row_minus_y:double,row_comma_y:double,digit_row_y_start:double,digit_row_y_step:double,
        questions:array<struct<question_number:int,column_x:array<double>,minus_x:double,comma_x:array<double>,bbox:array<int>>>>
"""
COLUMNS = (
    "spec_ord section field part spec_id item_id question_id question_number statement choice label role slot alignment_block grid_block center bbox"
).split()


def pixel(x: Column) -> Column:
    """Halves round to even."""
    return F.rint(x).cast("int")


def bubble_box(x: Column, y: Column, size: Column) -> Column:
    w, h = (F.floor(F.element_at(size, k) / 2).cast("int") for k in (1, 2))
    return F.array(x - w, y - h, x + w, y + h)


def same_length(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias("name"), b.alias("x"))).otherwise(
        F.raise_error(F.lit("choices and their columns differ in number")).cast("array<struct<name:string,x:double>>")
    )


def _finish(rows: DataFrame, x: Column, y: Column, **columns: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    columns = {"field": none, "part": none, "statement": none, "slot": F.lit(None).cast("int")} | columns
    return rows.select(
        *[v.alias(k) for k, v in columns.items()], F.array(pixel(x), pixel(y)).alias("center"), bubble_box(pixel(x), pixel(y), F.col("bubble")).alias("bbox"), "order"
    )


def part1_specs(template: DataFrame) -> DataFrame:
    rows = (
        template.select("bubble", F.col("part1.choices").alias("choices"), F.posexplode("part1.columns").alias("c", "col"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("col.question_count") - 1)).alias("i"))
        .select("*", F.posexplode(same_length(F.col("choices"), F.col("col.choice_x"))).alias("k", "choice"))
        .withColumn("number", F.col("col.question_start") + F.col("i"))
        .withColumn("order", F.array("c", "i", "k"))
    )
    name = F.format_string("I_%03d", "number")
    block = F.format_string("part1:q%03d-%03d", "col.question_start", F.col("col.question_start") + F.col("col.question_count") - 1)
    return _finish(
        rows,
        F.col("choice.x"),
        F.col("col.row_y_start") + F.col("i") * F.col("col.row_y_step"),
        section=F.lit("part1"),
        part=F.lit("I"),
        spec_id=F.concat_ws("_", name, "choice.name"),
        item_id=name,
        question_id=name,
        question_number=F.col("number"),
        choice=F.col("choice.name"),
        label=F.col("choice.name"),
        role=F.lit("multiple_choice"),
        alignment_block=F.lit("part1"),
        grid_block=block,
    )


def identity_specs(template: DataFrame, field: str) -> DataFrame:
    rows = (
        template.select("bubble", F.col(field).alias("grid"))
        .select("*", F.posexplode("grid.column_x").alias("c", "x"))
        .select("*", F.posexplode("grid.digits").alias("d", "digit"))
        .withColumn("order", F.array("c", "d"))
    )
    name = F.format_string(field + "_%02d", F.col("c") + 1)
    return _finish(
        rows,
        F.col("x"),
        F.col("grid.row_y_start") + F.col("d") * F.col("grid.row_y_step"),
        section=F.lit("identity"),
        field=F.lit(field),
        spec_id=F.concat_ws("_", name, "digit"),
        item_id=name,
        question_id=name,
        question_number=F.col("c") + 1,
        choice=F.col("digit"),
        label=F.col("digit"),
        role=F.lit("digit"),
        slot=F.col("c") + 1,
        alignment_block=F.lit("identity"),
        grid_block=F.lit(field),
    )


def part2_specs(template: DataFrame) -> DataFrame:
    rows = (
        template.select("bubble", F.col("part2").alias("grid"))
        .select("*", F.posexplode("grid.questions").alias("q", "question"))
        .select("*", F.posexplode("grid.statements").alias("s", "statement"))
        .select("*", F.posexplode(same_length(F.col("grid.choices"), F.col("question.choice_x"))).alias("k", "choice"))
        .withColumn("order", F.array("q", "s", "k"))
    )
    name = F.format_string("II_%03d_%s", "question.question_number", "statement")
    return _finish(
        rows,
        F.col("choice.x"),
        F.col("grid.row_y_start") + F.col("s") * F.col("grid.row_y_step"),
        section=F.lit("part2"),
        spec_id=F.concat_ws("_", name, "choice.name"),
        item_id=name,
        question_id=name,
        question_number=F.col("question.question_number"),
        statement=F.col("statement"),
        choice=F.col("choice.name"),
        label=F.coalesce(F.element_at("grid.choice_labels", F.col("choice.name")), F.col("choice.name")),
        role=F.lit("true_false"),
        slot=F.col("s") + 1,
        alignment_block=F.lit("part2"),
        grid_block=F.format_string("part2:q%03d", "question.question_number"),
    )


def part3_specs(template: DataFrame) -> DataFrame:
    base = template.select("bubble", F.col("part3").alias("g"), F.posexplode("part3.questions").alias("q", "question"))
    mark = lambda role, choice, label, suffix, slot, x, y: F.struct(
        role.alias("role"), choice.alias("choice"), label.alias("label"), suffix.alias("suffix"), slot.cast("int").alias("slot"), x.alias("x"), y.alias("y")
    )
    sign = F.array(mark(F.lit("sign"), F.lit("-"), F.lit("-"), F.lit("sign_minus"), F.lit(0), F.col("question.minus_x"), F.col("g.row_minus_y")))
    comma = F.transform(
        "question.comma_x",
        lambda x, i: mark(
            F.lit("comma"), F.concat(F.lit("after_"), (i + 1).cast("string")), F.lit(","), F.concat(F.lit("comma_"), (i + 1).cast("string")), i + 1, x, F.col("g.row_comma_y")
        ),
    )
    digit = F.flatten(
        F.transform(
            "question.column_x",
            lambda x, i: F.transform(
                "g.digit_choices",
                lambda d, k: mark(
                    F.lit("digit"), d, d, F.concat(F.lit("digit_"), (i + 1).cast("string"), F.lit("_"), d), i + 1, x, F.col("g.digit_row_y_start") + k * F.col("g.digit_row_y_step")
                ),
            ),
        )
    )
    rows = base.select("bubble", "q", "question", F.posexplode(F.concat(sign, comma, digit)).alias("k", "m")).withColumn("order", F.array("q", "k"))
    name = F.format_string("III_%03d", "question.question_number")
    item = F.when(F.col("m.role") == "digit", F.concat(F.lit("digit_"), F.col("m.slot").cast("string"))).otherwise(F.col("m.role"))
    return _finish(
        rows,
        F.col("m.x"),
        F.col("m.y"),
        section=F.lit("part3"),
        spec_id=F.concat_ws("_", name, "m.suffix"),
        item_id=F.concat_ws("_", name, item),
        question_id=name,
        question_number=F.col("question.question_number"),
        choice=F.col("m.choice"),
        label=F.col("m.label"),
        role=F.col("m.role"),
        slot=F.col("m.slot"),
        alignment_block=F.lit("part3"),
        grid_block=F.format_string("part3:q%03d", "question.question_number"),
    )


def all_specs(template: DataFrame) -> DataFrame:
    """All bubbles of a template in their order.  One row a bubble: bounded by the template."""
    from pyspark.sql import Window

    parts = [part1_specs(template), identity_specs(template, "sbd"), identity_specs(template, "exam_code"), part2_specs(template), part3_specs(template)]
    rows = None
    for k, part in enumerate(parts):
        part = part.withColumn("branch", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("spec_ord", F.row_number().over(Window.orderBy("branch", "order"))).select(*COLUMNS)


def block_boxes(specs: DataFrame, width: int, height: int, margin: int = 0) -> DataFrame:
    """The box around each grid block, widened by the margin and clipped to the page."""
    x1, y1, x2, y2 = (F.element_at("bbox", k) for k in (1, 2, 3, 4))
    return specs.groupBy("grid_block").agg(
        F.greatest(F.lit(0), F.min(x1) - margin).alias("x1"),
        F.greatest(F.lit(0), F.min(y1) - margin).alias("y1"),
        F.least(F.lit(width), F.max(x2) + margin).alias("x2"),
        F.least(F.lit(height), F.max(y2) + margin).alias("y2"),
    )


def polyline(points: Column, per_edge: int = 32) -> Column:
    """Points along a closed polyline of ``x, y`` structs, ``per_edge`` on each edge from its start."""
    steps = F.sequence(F.lit(0), F.lit(per_edge - 1))

    def edge(p: Column, i: Column) -> Column:
        q = F.get(points, (i + 1) % F.size(points))
        return F.transform(
            steps,
            lambda k: F.struct((p.x + (q.x - p.x) * k / F.lit(float(per_edge))).alias("x"), (p.y + (q.y - p.y) * k / F.lit(float(per_edge))).alias("y")),
        )

    return F.flatten(F.transform(points, edge))


def _box_points(box: Column) -> Column:
    """A box's corners, clockwise from its upper left one."""
    at = lambda i, j: F.struct(F.element_at(box, i).cast("double").alias("x"), F.element_at(box, j).cast("double").alias("y"))
    return F.array(at(1, 2), at(3, 2), at(3, 4), at(1, 4))


def label_points(template: DataFrame) -> DataFrame:
    """``place, id, group, x, y``: bubbles as a layout model's labels, with centres that are not rounded."""
    digits = lambda g: (
        template.select(F.col(g).alias("g"))
        .select("g", F.posexplode("g.column_x").alias("c", "x"))
        .select("*", F.posexplode("g.digits").alias("d", "digit"))
        .select(
            F.array("c", "d").alias("o"),
            F.concat(F.format_string(g + "_c%02d_d", F.col("c") + 1), "digit").alias("id"),
            F.lit(g).alias("group"),
            "x",
            (F.col("g.row_y_start") + F.col("d") * F.col("g.row_y_step")).alias("y"),
        )
    )
    one = (
        template.select(F.col("part1.choices").alias("choices"), F.posexplode("part1.columns").alias("c", "col"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("col.question_count") - 1)).alias("i"))
        .select("*", F.posexplode(same_length(F.col("choices"), F.col("col.choice_x"))).alias("k", "choice"))
        .select(
            F.array("c", "i", "k").alias("o"),
            F.format_string("part1_q%03d_%s", F.col("col.question_start") + F.col("i"), "choice.name").alias("id"),
            F.lit("part1").alias("group"),
            F.col("choice.x").alias("x"),
            (F.col("col.row_y_start") + F.col("i") * F.col("col.row_y_step")).alias("y"),
        )
    )
    two = (
        template.select(F.col("part2").alias("g"), F.posexplode("part2.questions").alias("q", "question"))
        .select("*", F.posexplode("g.statements").alias("s", "statement"))
        .select("*", F.posexplode(same_length(F.col("g.choices"), F.col("question.choice_x"))).alias("k", "choice"))
        .select(
            F.array("q", "s", "k").alias("o"),
            F.format_string("part2_q%02d_%s_%s", "question.question_number", "statement", "choice.name").alias("id"),
            F.lit("part2").alias("group"),
            F.col("choice.x").alias("x"),
            (F.col("g.row_y_start") + F.col("s") * F.col("g.row_y_step")).alias("y"),
        )
    )
    point = lambda name, x, y: F.struct(name.alias("name"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    number = lambda i: (i + 1).cast("string")
    parts = F.concat(
        F.array(point(F.lit("minus"), F.col("question.minus_x"), F.col("g.row_minus_y"))),
        F.transform("question.comma_x", lambda x, i: point(F.concat(F.lit("comma"), number(i)), x, F.col("g.row_comma_y"))),
        F.flatten(
            F.transform(
                "question.column_x",
                lambda x, i: F.transform("g.digit_choices", lambda d, k: point(F.concat(F.lit("s"), number(i), F.lit("_d"), d), x, F.col("g.digit_row_y_start") + k * F.col("g.digit_row_y_step"))),
            )
        ),
    )
    three = template.select(F.col("part3").alias("g"), F.posexplode("part3.questions").alias("q", "question")).select("q", "question", F.posexplode(parts).alias("k", "p"))
    three = three.select(F.array("q", "k").alias("o"), F.format_string("part3_q%02d_%s", "question.question_number", "p.name").alias("id"), F.lit("part3").alias("group"), "p.x", "p.y")
    rows = None
    for k, part in enumerate((digits("sbd"), digits("exam_code"), one, two, three)):
        part = part.withColumn("branch", F.lit(k))
        rows = part if rows is None else rows.union(part)
    from pyspark.sql import Window

    return rows.select(F.row_number().over(Window.orderBy("branch", "o")).alias("place"), "id", "group", "x", "y")  # bounded by the template


def region_polygons(template: DataFrame) -> DataFrame:
    """``name, points`` of a template's regions."""
    return template.select(F.explode("regions").alias("r")).select(F.col("r.name").alias("name"), _box_points(F.col("r.bbox")).alias("points"))


def grid_polylines(template: DataFrame) -> DataFrame:
    """``place, points``: the closed lines of a page: its border, then regions, columns, fields and questions."""
    w, h = F.col("canonical.width") - 1.0, F.col("canonical.height") - 1.0
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    border = F.array(at(F.lit(0.0), F.lit(0.0)), at(w, F.lit(0.0)), at(w, h), at(F.lit(0.0), h))
    boxes = F.concat(
        F.transform("regions", lambda r: r.bbox), F.transform("part1.columns", lambda c: c.bbox), F.array("sbd.bbox", "exam_code.bbox"),
        F.transform("part2.questions", lambda q: q.bbox), F.transform("part3.questions", lambda q: q.bbox),
    )
    return template.select(F.posexplode(F.concat(F.array(border), F.transform(boxes, _box_points))).alias("place", "points"))


def item_index(specs: DataFrame) -> DataFrame:
    """``key, spec_id``: specs by ``section:item``, those of part III by their question, too."""
    whole = F.when((F.col("section") == "part3") & F.col("question_id").isNotNull(), F.concat_ws(":", "section", "question_id"))
    return specs.select(F.explode(F.array_compact(F.array(F.concat_ws(":", "section", "item_id"), whole))).alias("key"), "spec_id", "spec_ord")


def choice_index(specs: DataFrame) -> DataFrame:
    """``key, spec_id, center, bbox``: one spec by ``section:item:choice``; of several the last in order."""
    whole = F.when((F.col("section") == "part3") & F.col("question_id").isNotNull(), F.concat_ws(":", "section", "question_id", "choice"))
    keyed = specs.select(F.explode(F.array_compact(F.array(F.concat_ws(":", "section", "item_id", "choice"), whole))).alias("key"), "spec_ord", "spec_id", "center", "bbox")
    return keyed.groupBy("key").agg(F.max_by(F.struct("spec_id", "center", "bbox"), "spec_ord").alias("s")).select("key", "s.*")


def selected_specs(rows: DataFrame, index: DataFrame, value: str = "value") -> DataFrame:
    """The specs that a row's value marks (``section, item_id``, value); a template's index is small."""
    from ..functions.scalars import value_choices

    key = F.concat_ws(":", "section", "item_id", "choice")
    asked = rows.withColumn("choice", F.explode(value_choices(F.col("section"), F.col(value)))).withColumn("key", key)
    return asked.join(F.broadcast(index), "key").drop("key")


def field_region(template: DataFrame) -> DataFrame:
    """``item_id, bbox`` of the identity fields, which have a region instead of bubbles of their own."""
    return template.select(F.explode("regions").alias("r")).where(F.col("r.name").isin("sbd", "exam_code")).select(F.col("r.name").alias("item_id"), F.col("r.bbox").alias("bbox"))
