"""Seeded figure templates as column expressions.

Coordinates are held as integer hundredths and written from those, so the text
never depends on how an engine rounds a binary fraction. Slot numbers are part of
the contract: the same ``(seed, key)`` always yields the same figure. The draws of a
figure are made once into an array that the template reads.
"""

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from figmill import constants as C
from figmill.functions.hashing import Draws, bound, draws, pick_weighted, uniform, uniforms


def scalar_text(hundredths: Column) -> Column:
    """``-123`` becomes ``-1.23``."""
    return (hundredths.cast("decimal(9,0)") * F.lit(Decimal("0.01"))).cast("string")


def point_text(x: Column, y: Column) -> Column:
    return F.concat(F.lit("("), scalar_text(x), F.lit(", "), scalar_text(y), F.lit(")"))


def wrap_picture(body: Column) -> Column:
    return F.concat(F.lit(C.BEGIN_PICTURE + "\n"), body, F.lit("\n" + C.END_PICTURE))


def picture_body(markup: Column) -> Column:
    """Text between the first and the last newline."""
    return F.regexp_extract(markup, r"(?s)^[^\n]*\n(.*)\n[^\n]*$", 1)


def _chain(xs: Column, ys: Column) -> Column:
    return F.array_join(F.zip_with(xs, ys, point_text), " -- ")


def _nearest(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("long")


def line_segment(d: Draws) -> Column:
    """Slots: 0-3 ends, 4 width, 5 color, 6 style."""

    def apart(start: Column, end: Column) -> Column:
        nudge = F.when(end <= 0, F.lit(50)).otherwise(F.lit(-50))
        return F.when(F.abs(end - start) < 10, end + nudge).otherwise(end)

    x0, y0, x1, y1 = (d.integer(slot, -500, 500) for slot in range(4))
    return F.concat(
        F.lit("\\draw["), d.choice(4, C.LINE_WIDTHS), F.lit(", "), d.choice(5, C.COLORS),
        F.lit(", "), d.choice(6, C.LINE_STYLES), F.lit("] "),
        point_text(x0, y0), F.lit(" -- "), point_text(apart(x0, x1), apart(y0, y1)), F.lit(";"),
    )


def polyline(d: Draws) -> Column:
    """Slots: 0 vertex count, 1 width, 2 color, 3-8 x, 9-14 y."""
    count = d.integer(0, 3, 6)

    def axis(first_slot: int) -> Column:
        drawn = F.transform(
            F.sequence(F.lit(0), count.cast("int") - 1),
            lambda i: d.integer(i + first_slot, -500, 500),
        )

        def spread(values: Column) -> Column:
            zero = F.lit(0).cast("long")
            total = F.aggregate(values, zero, lambda acc, v: acc + v)
            squares = F.aggregate(values, zero, lambda acc, v: acc + v * v)
            # Population standard deviation under 5 hundredths, kept in integers.
            flat = count * squares - total * total < 25 * count * count
            return F.transform(values, lambda v, i: F.when(flat & (i == 0), v + 50).otherwise(v))

        return bound(drawn, spread)

    return F.concat(
        F.lit("\\draw["), d.choice(1, C.LINE_WIDTHS), F.lit(", "), d.choice(2, C.COLORS),
        F.lit("] "), _chain(axis(3), axis(9)), F.lit(";"),
    )


def polygon(d: Draws) -> Column:
    """Slots: 0 sides, 1-2 center, 3 radius, 4 width, 5 color, 6 rotation."""
    sides = d.integer(0, 3, 8)
    radius, rotation = d.integer(3, 50, 300), d.u(6) * F.lit(2.0 * math.pi)

    def vertices(center: Column, wave) -> Column:
        return F.transform(
            F.sequence(F.lit(0), (sides - 1).cast("int")),
            lambda i: _nearest(
                center + radius * wave(rotation + F.lit(2.0 * math.pi) * i / sides)
            ),
        )

    xs = vertices(d.integer(1, -500, 500), F.cos)
    ys = vertices(d.integer(2, -500, 500), F.sin)
    return F.concat(
        F.lit("\\draw["), d.choice(4, C.LINE_WIDTHS), F.lit(", "), d.choice(5, C.COLORS),
        F.lit("] "), _chain(xs, ys), F.lit(" -- cycle;"),
    )


def _arc(start: Column, sweep: Column, radius: Column) -> Column:
    return F.concat(
        F.lit("arc ("), scalar_text(start), F.lit(":"), scalar_text(start + sweep), F.lit(":"),
        scalar_text(radius), F.lit(")"),
    )


def circle_arc(d: Draws) -> Column:
    """Slots: 0-1 center, 2 variant, 3 radius, 4 width, 5 color, 6 second radius,
    7 start angle, 8 sweep."""
    variant, radius = d.integer(2, 0, 2), d.integer(3, 50, 350)
    shape = (
        F.when(variant == 0, F.concat(F.lit("circle ("), scalar_text(radius), F.lit(")")))
        .when(
            variant == 1,
            F.concat(
                F.lit("ellipse ("), scalar_text(radius), F.lit(" and "),
                scalar_text(d.integer(6, 50, 350)), F.lit(")"),
            ),
        )
        .otherwise(_arc(d.integer(7, 0, 35999), d.integer(8, 3000, 33000), radius))
    )
    return F.concat(
        F.lit("\\draw["), d.choice(4, C.LINE_WIDTHS), F.lit(", "), d.choice(5, C.COLORS),
        F.lit("] "), point_text(d.integer(0, -500, 500), d.integer(1, -500, 500)), F.lit(" "),
        shape, F.lit(";"),
    )


def grid_axes(d: Draws) -> Column:
    """Slots: 0 step, 1 bound."""
    step, edge = d.integer(0, 50, 200), d.integer(1, 300, 500)
    return F.concat(
        F.lit("\\draw[step="), scalar_text(step), F.lit(", gray, thin] "),
        point_text(-edge, -edge), F.lit(" grid "), point_text(edge, edge), F.lit(";\n"),
        F.lit("\\draw[->, thick] (-5.00, 0.00) -- (5.00, 0.00);\n"),
        F.lit("\\draw[->, thick] (0.00, -5.00) -- (0.00, 5.00);"),
    )


def plot_expression(basis: Column, amplitude: Column, frequency: Column) -> Column:
    wave = F.concat(
        scalar_text(amplitude), F.lit("*"), basis, F.lit("("), scalar_text(frequency),
        F.lit("*\\x r)"),
    )
    fifth = F.floor((2 * amplitude + 5) / 10).cast("long")
    return (
        F.when(basis.isin("sin", "cos"), wave)
        .when(basis == "quadratic", F.concat(scalar_text(fifth), F.lit("*(\\x)^2")))
        .otherwise(F.concat(scalar_text(amplitude), F.lit("*\\x")))
    )


def function_plot(d: Draws) -> Column:
    """Slots: 0 amplitude, 1 frequency, 2 bound, 3 basis, 4 width, 5 color."""
    edge = d.integer(2, 300, 500)
    basis = d.choice(3, tuple(name for name, _ in C.PLOT_BASES))
    return F.concat(
        F.lit("\\draw[domain="), scalar_text(-edge), F.lit(":"), scalar_text(edge),
        F.lit(", smooth, "), d.choice(4, C.LINE_WIDTHS), F.lit(", "), d.choice(5, C.COLORS),
        F.lit("] plot (\\x, {"),
        plot_expression(basis, d.integer(0, 50, 300), d.integer(1, 50, 300)), F.lit("});"),
    )


def node_arrow(d: Draws) -> Column:
    """Slots: 0 node count, 1-4 x, 5-8 y, 9-12 label, 13-15 edge color."""
    count = d.integer(0, 2, 4).cast("int")
    names = F.array(*[F.lit(name) for name in C.NODE_IDS])
    nodes = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.concat(
            F.lit("\\node[circle, draw=black] ("), F.get(names, i), F.lit(") at "),
            point_text(d.integer(i + 1, -500, 500), d.integer(i + 5, -500, 500)),
            F.lit(" {"), d.choice(i + 9, C.NODE_LABELS), F.lit("};"),
        ),
    )
    edges = F.transform(
        F.sequence(F.lit(0), count - 2),
        lambda i: F.concat(
            F.lit("\\draw[->, thick, "), d.choice(i + 13, C.COLORS), F.lit("] ("),
            F.get(names, i), F.lit(") -- ("), F.get(names, i + 1), F.lit(");"),
        ),
    )
    return F.array_join(F.concat(nodes, edges), "\n")


def composed(d: Draws) -> Column:
    """Slots: 0 part count, 1-3 part kinds, then nine slots per part from 4 on."""

    def part(j: Column) -> Column:
        kind, inner = d.integer(j + 1, 0, 2), d.shifted(j * 9 + 4)
        return (
            F.when(kind == 0, line_segment(inner))
            .when(kind == 1, polygon(inner))
            .otherwise(circle_arc(inner))
        )

    last = d.integer(0, 2, 3).cast("int") - 1
    return F.array_join(F.transform(F.sequence(F.lit(0), last), part), "\n")


# Template and number of draw slots per family.
TEMPLATES = {
    "line_segment": (line_segment, 7),
    "polyline": (polyline, 15),
    "polygon": (polygon, 7),
    "circle_arc": (circle_arc, 9),
    "grid_axes": (grid_axes, 2),
    "function_plot": (function_plot, 6),
    "node_arrow": (node_arrow, 16),
    "composed": (composed, 31),
}


def family_markup(name: str, seed, key) -> Column:
    """Complete picture of one family."""
    if name not in TEMPLATES:
        raise ValueError(f"Unknown family '{name}'. Known families: {C.FAMILIES}.")
    template, slots = TEMPLATES[name]
    return bound(draws(seed, key, slots), lambda values: wrap_picture(template(Draws(values))))


def _by_family(family: Column, value_of) -> Column:
    branches = None
    for name in C.FAMILIES:
        value = value_of(*TEMPLATES[name])
        branches = (
            F.when(family == name, value)
            if branches is None
            else branches.when(family == name, value)
        )
    return branches


def procedural_markup(family: Column, seed, key) -> Column:
    """Complete picture whose family is chosen per row; null for unknown families."""
    slots = _by_family(family, lambda _, count: F.lit(count))
    return bound(
        draws(seed, key, slots),
        lambda values: wrap_picture(
            _by_family(family, lambda template, _: template(Draws(values)))
        ),
    )


# --- Compositional grammar -------------------------------------------------------------------


def _coordinate(d: Draws, x, y, relative) -> Column:
    prefix = F.when(d.u(relative) < 0.5, F.lit("")).otherwise(F.lit("++"))
    return F.concat(prefix, point_text(d.integer(x, -500, 500), d.integer(y, -500, 500)))


def _path(d: Draws) -> Column:
    """Slots: 10 coordinate count, 11 has arc, 12-14 arc, 15-20 x, 21-26 y, 27-32 relative,
    33-38 connector."""
    steps = F.transform(
        F.sequence(F.lit(0), d.integer(10, 2, 6).cast("int") - 1),
        lambda i: F.concat(
            F.when(i == 0, F.lit("")).otherwise(
                F.concat(F.lit(" "), d.weighted(i + 33, C.CONNECTORS), F.lit(" "))
            ),
            _coordinate(d, i + 15, i + 21, i + 27),
        ),
    )
    arc = _arc(d.integer(12, 0, 35999), d.integer(13, 3000, 33000), d.integer(14, 50, 350))
    tail = F.when(d.u(11) < 0.25, F.concat(F.lit(" "), arc)).otherwise(F.lit(""))
    return F.concat(F.array_join(steps, ""), tail)


def _draw_scope(d: Draws) -> Column:
    """Slots: 1 color, 2-3 width, 4-5 style, 6-7 arrow, 8 corners, 9 command, path."""
    arrow = d.weighted(7, C.ARROWS)
    styles = F.concat_ws(
        ", ",
        d.choice(1, C.COLORS),
        F.when(d.u(2) < 0.7, d.choice(3, C.LINE_WIDTHS)),
        F.when(d.u(4) < 0.5, d.choice(5, C.LINE_STYLES)),
        F.when((d.u(6) < 0.4) & (arrow != ""), arrow),
        F.when(d.u(8) < 0.2, F.lit("rounded corners")),
    )
    command = F.when(d.u(9) < 0.2, F.lit("\\path[draw, ")).otherwise(F.lit("\\draw["))
    return F.concat(command, styles, F.lit("] "), _path(d), F.lit(";"))


def _fill_scope(d: Draws) -> Column:
    """Slots: 1 color, 2 opacity, 3 pattern, path."""
    pattern = d.weighted(3, C.FILL_PATTERNS)
    styles = F.concat_ws(
        ", ",
        d.choice(1, C.COLORS),
        F.concat(F.lit("fill opacity="), scalar_text(d.integer(2, 20, 90))),
        F.when(pattern != "none", F.concat(F.lit("pattern="), pattern)),
    )
    return F.concat(F.lit("\\fill["), styles, F.lit("] "), _path(d), F.lit(" -- cycle;"))


def _node_scope(d: Draws) -> Column:
    """Slots: 1 border color, 2 shape, 3-4 fill, 5-6 width, 7 label, 8-10 coordinate."""
    styles = F.concat_ws(
        ", ",
        d.weighted(2, C.NODE_SHAPES),
        F.concat(F.lit("draw="), d.choice(1, C.COLORS)),
        F.when(d.u(3) < 0.6, F.concat(F.lit("fill="), d.choice(4, C.COLORS))),
        F.when(d.u(5) < 0.4, d.choice(6, C.LINE_WIDTHS)),
    )
    return F.concat(
        F.lit("\\node["), styles, F.lit("] at "), _coordinate(d, 8, 9, 10), F.lit(" {"),
        d.choice(7, C.SCOPE_LABELS), F.lit("};"),
    )


def _plot_scope(d: Draws) -> Column:
    """Slots: 1 color, 2 amplitude, 3 frequency, 4 bound, 5 basis."""
    edge = d.integer(4, 300, 500)
    return F.concat(
        F.lit("\\draw[domain="), scalar_text(-edge), F.lit(":"), scalar_text(edge),
        F.lit(", smooth, "), d.choice(1, C.COLORS), F.lit("] plot (\\x, {"),
        plot_expression(
            d.weighted(5, C.PLOT_BASES), d.integer(2, 50, 300), d.integer(3, 50, 300)
        ),
        F.lit("});"),
    )


_SCOPES = {
    "draw": (_draw_scope, 39),
    "node": (_node_scope, 11),
    "fill": (_fill_scope, 39),
    "plot": (_plot_scope, 6),
}
SCOPE_SLOTS = 64


def compositional_markup(seed, key, depth_range=C.DEPTH_RANGE) -> Column:
    """Figure of 5 to 20 grammar scopes. The grammar is not recursive, so a figure is a
    bounded array of scopes built inside its own row: no explode, no shuffle.

    Slot 0 is the scope count; scope ``s`` owns the 64 slots from ``64 * s``, the first of
    which is its kind.
    """
    low, high = depth_range
    if low < 1 or high < low:
        raise ValueError(f"Invalid depth range {depth_range}; expected 1 <= low <= high.")

    # Number and kinds come first; then one look-up draws the slots of all scopes.
    count = (F.lit(low) + F.floor(uniform(seed, key, 0) * F.lit(high - low + 1))).cast("int")
    numbers = F.sequence(F.lit(1), count)
    kinds = F.transform(
        numbers, lambda s: pick_weighted(uniform(seed, key, s * SCOPE_SLOTS), C.SCOPE_KINDS)
    )
    longest = max(slots for _, slots in _SCOPES.values())
    places = F.flatten(
        F.transform(
            numbers, lambda s: F.sequence(s * SCOPE_SLOTS, s * SCOPE_SLOTS + (longest - 1))
        )
    )

    def written(kind: Column, values: Draws) -> Column:
        text = None
        for name, (scope, _) in _SCOPES.items():
            text = (F if text is None else text).when(kind == name, scope(values))
        return text

    def scopes(drawn: Column) -> Column:
        return F.transform(
            drawn["kinds"], lambda kind, n: written(kind, Draws(drawn["values"], n * longest))
        )

    drawn = F.struct(kinds.alias("kinds"), uniforms(seed, key, places).alias("values"))
    return wrap_picture(F.array_join(bound(drawn, scopes), "\n"))
