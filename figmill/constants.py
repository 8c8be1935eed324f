"""Fixed values of the markup domain.

Everything in this module is data: word lists, patterns, formats and numeric
constants that results depend on. No logic lives here.
"""

import math

# --- Fixed values: figure families, in index order -------------------------------------------
FAMILIES = (
    "line_segment",
    "polyline",
    "polygon",
    "circle_arc",
    "grid_axes",
    "function_plot",
    "node_arrow",
    "composed",
)
EXTERNAL_STRATUM = 8
COMPOSITIONAL_STRATUM = 9
OOD_FAMILY = "ood_composed"

# --- Fixed values: palettes of the procedural templates --------------------------------------
COLORS = (
    "red", "blue", "green", "black", "orange", "purple", "brown", "cyan", "magenta", "gray",
)
LINE_STYLES = ("solid", "dashed", "dotted")
LINE_WIDTHS = ("thin", "thick", "very thick")
NODE_LABELS = ("A", "B", "C", "P", "Q", "x", "y", "z")
NODE_IDS = ("a", "b", "c", "d")

# --- Fixed values: weighted productions of the compositional grammar -------------------------
SCOPE_KINDS = (("draw", 0.5), ("node", 0.2), ("fill", 0.2), ("plot", 0.1))
ARROWS = (("", 0.5), ("->", 0.2), ("->>", 0.1), ("<->", 0.1), ("-stealth", 0.1))
CONNECTORS = (("--", 0.8), ("|-", 0.1), ("-|", 0.1))
NODE_SHAPES = (("circle", 0.4), ("rectangle", 0.3), ("diamond", 0.15), ("ellipse", 0.15))
FILL_PATTERNS = (("none", 0.7), ("north east lines", 0.15), ("crosshatch", 0.1), ("dots", 0.05))
PLOT_BASES = (("sin", 0.3), ("cos", 0.3), ("quadratic", 0.2), ("linear", 0.2))
SCOPE_LABELS = ("A", "B", "C", "P", "Q", "x", "y", "z", "m", "n")
DEPTH_RANGE = (5, 20)

# --- Fixed values: markup environments and length budget -------------------------------------
ROOT_ENVIRONMENTS = ("tikzpicture", "tikzcd", "axis")
BEGIN_PICTURE = "\\begin{tikzpicture}"
END_PICTURE = "\\end{tikzpicture}"
MAX_MARKUP_CHARS = 4000

# --- Fixed values: package catalog (name, preamble lines), in catalog order ------------------
PACKAGES = (
    ("tikz", ("\\usepackage{tikz}",)),
    ("pgfplots", ("\\usepackage{pgfplots}", "\\pgfplotsset{compat=1.18}")),
    ("circuitikz", ("\\usepackage{circuitikz}",)),
    ("tikz-cd", ("\\usepackage{tikz-cd}",)),
    ("tikz-3dplot", ("\\usepackage{tikz-3dplot}",)),
    ("amsmath", ("\\usepackage{amsmath}",)),
    ("siunitx", ("\\usepackage{siunitx}",)),
    ("xcolor", ("\\usepackage{xcolor}",)),
)
PACKAGE_NAMES = tuple(name for name, _ in PACKAGES)
TIKZ_LIBRARIES = (
    "arrows.meta",
    "positioning",
    "calc",
    "patterns",
    "decorations.pathmorphing",
    "shapes.geometric",
)

# --- Fixed values: command fingerprints that imply a package ---------------------------------
PACKAGE_HINTS = (
    (r"\\addplot", "pgfplots"),
    (r"\\begin\{axis\}", "pgfplots"),
    (r"\\begin\{tikzcd\}", "tikz-cd"),
    (r"\\arrow\b", "tikz-cd"),
    (r"\\tdplotsetmaincoords", "tikz-3dplot"),
    (r"\\tdplotsetrotatedcoords", "tikz-3dplot"),
    (r"to\s*\[\s*(?:R|C|L|V|I|battery|short|open|ammeter|voltmeter|european)\b", "circuitikz"),
    (r"\\num\b", "siunitx"),
    (r"\\si\b", "siunitx"),
    (r"\\definecolor", "xcolor"),
    (r"\\color\b", "xcolor"),
)

# --- Fixed values: text patterns -------------------------------------------------------------
PICTURE_PATTERN = r"(?s)\\begin\{tikzpicture\}.*?\\end\{tikzpicture\}"
COLOR_DEFINITION_PATTERN = r"\\definecolor\{[^}]*\}\{[^}]*\}\{[^}]*\}"
SCALE_DEFINITION_PATTERN = r"\\def\s*\\globalscale\s*\{[^}]*\}"
USEPACKAGE_PATTERN = r"\\usepackage\s*\{([^}]*)\}"
USELIBRARY_PATTERN = r"\\usetikzlibrary\s*\{([^}]*)\}"
MISSING_FILE_PATTERN = r"File `([^`']+)' not found"
POINT_PATTERN = r"\(\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\)"
NUMBER_PATTERN = r"^-?\d+(?:\.\d+)?$"
FLOAT_PATTERN = r"^-?\d+\.\d+$"
COMMENT_PATTERN = r"%[^\n]*"
BOILERPLATE_PATTERN = (
    r"\\(?:begin|end)\{[^}]*\}|\\documentclass(?:\[[^\]]*\])?\{[^}]*\}|"
    r"\\usepackage(?:\[[^\]]*\])?\{[^}]*\}|\\usetikzlibrary\{[^}]*\}|\\pgfplotsset\{[^}]*\}"
)
COMMAND_PATTERN = r"\\([a-zA-Z]+)"
DRAWING_COMMAND_PATTERN = r"\\(draw|fill|path|node|coordinate|clip|shade|filldraw)\b"
# Spacing of a cleaned markup, each pattern with its replacement.
SPACING_BEFORE_POINTS = (r"\(\s*([a-zA-Z0-9_-]+)\s*\)", "($1)")
SPACING_AFTER_POINTS = (
    (r"circle\s*\(\s*(-?\d+(?:\.\d+)?)\s*\)", "circle ($1)"),
    (r"\{\s+\}", "{}"),
    (r"\{\s*([^{}]+?)\s*\}", "{$1}"),
)
OPTIONS_PATTERN = r"\[\s*([^\[\]]+?)\s*\]"
# Words of a figure and the family they stand for; the first hit counts.
FAMILY_WORDS = (
    (("grid", "step="), "grid_axes"),
    (("node",), "node_arrow"),
    (("plot", "domain"), "function_plot"),
    (("circle", "arc"), "circle_arc"),
    (("cycle",), "polygon"),
    (("--",), "line_segment"),
)
# The last alternative is any non-blank character; blanks are the Unicode ones.
TOKEN_PATTERN = (
    r"<FAM:[a-zA-Z0-9_]+>"
    r"|\\begin\{[a-zA-Z*]+\}"
    r"|\\end\{[a-zA-Z*]+\}"
    r"|\\[a-zA-Z]+"
    r"|--|->|<-|<->|\|-|-\||\.\.|\+\+|->>|-stealth"
    r"|-?\d+(?:\.\d+)?"
    r"|[a-zA-Z_][a-zA-Z0-9_-]*"
    r"|(?U:[^\s\x1c-\x1f])"
)

# --- Fixed values: structural keywords -------------------------------------------------------
EVALUATION_KEYWORDS = (
    "draw", "circle", "arc", "grid", "plot", "node", "fill", "--", "->", "cycle",
)
DIAGNOSTIC_KEYWORDS = (
    "draw", "circle", "arc", "grid", "plot", "node", "fill", "--", "->", "<-", "<->", "cycle",
    "step", "domain",
)

# --- Fixed values: canvas and quantization ---------------------------------------------------
CANVAS_MIN = -5.0
CANVAS_MAX = 5.0
COORDINATE_STEP = 0.1
FINE_COORDINATE_STEP = 0.05
CANVAS_DIAGONAL = 10.0 * math.sqrt(2.0)

# --- Fixed values: vocabulary ----------------------------------------------------------------
PAD, BOS, EOS, UNK = 0, 1, 2, 3
RESERVED_TOKENS = ("<PAD>", "<BOS>", "<EOS>", "<UNK>")
FAMILY_TOKENS = tuple(f"<FAM:{name}>" for name in FAMILIES)
MAX_SEQUENCE = 512

# --- Fixed values: token classes and their loss weights --------------------------------------
NUMERIC_TOKEN_PATTERN = r"(?i)^(?:-?\d+(?:\.\d+)?|nan|inf|infinity)$"
GEOMETRIC_TOKENS = (
    "--", "->", "<-", "<->", "|-", "-|", "circle", "arc", "plot", "grid", "node", "fill",
    "rectangle", "draw", "dashed", "thick", "thin", "very", "ultra", "smooth", "red", "blue",
    "cyan", "magenta", "orange", "green", "black", "gray", "brown", "domain", "step", "scale",
    "rotate", "at", "cos", "sin", "exp", "tan", "\\x",
)
BOILERPLATE_TOKENS = ("\\begin{tikzpicture}", "\\end{tikzpicture}", ";", "\\draw")
CLASS_WEIGHTS = (("numeric", 6.0), ("geometric", 2.5), ("boilerplate", 0.3), ("other", 1.0))
ORDINAL_SIGMA = 0.2
WORD_DROPOUT = 0.35

# --- Fixed values: visual metrics ------------------------------------------------------------
SSIM_WINDOW = 11
SSIM_SIGMA = 1.5
SSIM_K1 = 0.01
SSIM_K2 = 0.03
BLUR_KERNEL = (0.25, 0.5, 0.25)
BLANK_STD = 1e-4

# --- Fixed values: curriculum ----------------------------------------------------------------
RETRY_STRIDE = 1000003
MAX_RETRIES = 10
PLANNED_SAMPLES = 120000
# (stage, epochs, learning rate, weight per family in FAMILIES order, augmentation)
STAGES = (
    (1, 10, 3.0e-4, (0.25, 0.075, 0.075, 0.25, 0.075, 0.075, 0.10, 0.10), False),
    (2, 15, 2.0e-4, (0.15, 0.075, 0.075, 0.15, 0.075, 0.075, 0.20, 0.20), False),
    (3, 15, 1.0e-4, (0.125, 0.125, 0.125, 0.125, 0.125, 0.125, 0.125, 0.125), True),
)
# Families whose points carry no order, so they are matched instead of zipped.
UNORDERED_FAMILIES = ("node_arrow", "composed")

# --- Fixed values: report metrics, in table order --------------------------------------------
TIER_METRICS = (
    "corpus_bleu",
    "mean_geometric_edit_distance",
    "mean_graph_edit_distance",
    "compilation_rate",
    "mean_ssim",
)
