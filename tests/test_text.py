import pytest
from pyspark.sql import functions as F

from figmill.functions import templates as G
from figmill.functions import text as X

TWO = "x \\begin{tikzpicture}\\draw (0,0) -- (1,1);\\end{tikzpicture} y\n\\begin{tikzpicture}\n\\node {A};\n\\end{tikzpicture}"


def test_budget_is_inclusive(one):
    assert one(X.within_budget("t"), t="a" * 4000) is True
    assert one(X.within_budget("t"), t="a" * 4001) is False
    with pytest.raises(ValueError):
        X.within_budget("t", 0)


def test_blocks_in_order(one):
    blocks = one(X.picture_blocks("t"), t=TWO)
    assert len(blocks) == 2 and "\\draw" in blocks[0] and "\\node" in blocks[1]
    assert one(X.picture_blocks("t"), t="nothing") == []
    assert one(X.first_picture("t"), t="nothing") is None


def test_markup_violation(one):
    assert one(X.markup_violation(F.col("t")), t=" \n") == "blank"
    assert one(X.markup_violation(F.col("t")), t="\\draw;") == "no_root_environment"
    assert one(X.markup_violation(F.col("t")), t="\\begin{axis}") is None


@pytest.mark.parametrize(
    "text, expected",
    [
        ("\\begin{axis}\\addplot x; \\draw (0,0) to[R, l=1] (1,0);", ["pgfplots", "circuitikz"]),
        ("\\draw (0,0) -- (1,1);", []),
        ("\\begin{tikzcd} a \\arrow[r] b", ["tikz-cd"]),
    ],
)
def test_required_packages(one, text, expected):
    assert one(X.required_packages(F.col("t")), t=text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("\\usepackage{pgfplots}\\usepackage{foo}", ["pgfplots"]),
        ("\\usetikzlibrary{arrows.meta}", ["tikz"]),
        ("\\usepackage[x]{xcolor}", []),
        ("\\usepackage{xcolor, amsmath}", ["amsmath", "xcolor"]),
    ],
)
def test_declared_packages(one, text, expected):
    assert one(X.declared_packages("t"), t=text) == expected


def test_preamble(one):
    packages = F.array(F.lit("tikz"), F.lit("tikz"), F.lit("pgfplots"))
    none = F.array().cast("array<string>")
    text = one(X.preamble(packages, none), x=1)
    assert text.count("\\usepackage{tikz}") == 1 and text.count("\\usepackage{pgfplots}") == 1
    assert text.endswith("\n")
    libraries = F.array(F.lit("arrows.meta"), F.lit("positioning"))
    assert "\\usetikzlibrary{arrows.meta,positioning}\n" in one(
        X.preamble(F.array(F.lit("tikz")), libraries), x=1
    )
    assert one(X.preamble(F.array(F.lit("nope")), none), x=1) is None
    only = one(X.preamble(F.array(F.lit("amsmath")), none), x=1)
    assert only.index("{tikz}") < only.index("{amsmath}")


def test_build_log(one):
    assert one(X.missing_package("t"), t="! File `pgfplots.sty' not found.") == "pgfplots"
    assert one(X.missing_package("t"), t="File `standalone.cls' not found") == "standalone.cls"
    assert one(X.failure_kind("t"), t="Undefined control sequence") == "syntax_error"


def test_sanitize(one):
    body = "\\begin{tikzpicture} \\draw (0,0); junk \\end{tikzpicture}"
    assert one(X.sanitized("t"), t=body) == "\\begin{tikzpicture} \\draw (0,0); \\end{tikzpicture}"
    assert one(X.sanitized("t"), t=" a ") == "a \\end{tikzpicture}"
    bare = "\\begin{tikzpicture}x\\end{tikzpicture}"
    assert one(X.sanitized("t"), t=bare) == "\\begin{tikzpicture} x ; \\end{tikzpicture}"


def test_clean(one):
    text = "\\begin{tikzpicture} \\draw [ thick , red = x ] ( 1.0 , 2 ) -- ( a ) circle ( 3 ) { A } {  } ; \\end{tikzpicture}"
    assert one(X.cleaned("t"), t=text) == (
        "\\begin{tikzpicture} \\draw [thick, red=x] (1.0, 2) -- (a) circle (3) {A} {} ; \\end{tikzpicture}"
    )


def test_delimiters_and_keywords(one):
    assert one(X.unbalanced_delimiters(F.col("t")), t="((]{") == {"()": 2, "[]": 1, "{}": 1}
    assert one(X.keywords_present(F.col("t"), ("draw", "--", "arc")), t="\\draw -- search") == ["draw", "--"]
    assert one(X.emitted_commands("t"), t="\\draw \\node \\drawx \\filldraw") == ["draw", "node", "filldraw"]


@pytest.mark.parametrize(
    "text, family",
    [("step=1 node", "grid_axes"), ("NODE plot", "node_arrow"), ("domain", "function_plot"),
     ("arc", "circle_arc"), ("-- cycle", "polygon"), ("a -- b", "line_segment"), ("", "unknown")],
)
def test_structural_family(one, text, family):
    assert one(X.structural_family(F.col("t")), t=text) == family


def test_primitives_skip_comments_and_boilerplate(one):
    text = "\\begin{tikzpicture}\n\\draw (0,0) -- (1, -2.5); % \\fill (9,9);\n ; no command ; \\Node at (1,1)\n\\end{tikzpicture}"
    found = one(X.primitives("t"), t=text)
    assert [(p["kind"], [(c["x"], c["y"]) for c in p["coords"]]) for p in found] == [
        ("draw", [(0.0, 0.0), (1.0, -2.5)]),
        ("node", [(1.0, 1.0)]),
    ]


def test_body_round_trip(one):
    assert one(G.picture_body(G.wrap_picture(F.col("t"))), t="a;\nb;") == "a;\nb;"
