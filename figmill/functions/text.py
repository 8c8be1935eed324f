"""Markup text as column expressions: validation, extraction, repair, structure."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from figmill import constants as C


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(column) -> Column:
    """Trim every kind of blank, line ends included."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def contains_text(column: Column, part: str) -> Column:
    return column.contains(F.lit(part))


# --- Validation ------------------------------------------------------------------------------


def within_budget(column, max_chars: int = C.MAX_MARKUP_CHARS) -> Column:
    """Inclusive character budget."""
    if max_chars <= 0:
        raise ValueError(f"A budget of {max_chars} characters lets no text through.")
    return F.length(column) <= max_chars


def markup_violation(column: Column) -> Column:
    """``blank``, ``no_root_environment`` or null when the markup is valid; null text is blank."""
    column = F.coalesce(column, F.lit(""))
    rooted = None
    for name in C.ROOT_ENVIRONMENTS:
        test = contains_text(column, f"\\begin{{{name}}}")
        rooted = test if rooted is None else rooted | test
    return F.when(strip(column) == "", F.lit("blank")).when(
        ~rooted, F.lit("no_root_environment")
    )


def unknown_packages(packages: Column) -> Column:
    return F.array_except(packages, _texts(C.PACKAGE_NAMES))


def tags_present(column: Column) -> Column:
    """Cheap stand-in for a compiler: both picture tags occur."""
    return contains_text(column, C.BEGIN_PICTURE) & contains_text(column, C.END_PICTURE)


# --- Extraction ------------------------------------------------------------------------------


def picture_blocks(column) -> Column:
    """All pictures of a document, in order."""
    return F.regexp_extract_all(column, F.lit(C.PICTURE_PATTERN), F.lit(0))


def first_picture(column) -> Column:
    """First picture or null."""
    return F.nullif(F.regexp_extract(column, C.PICTURE_PATTERN, 0), F.lit(""))


def self_contained_figure(column) -> Column:
    """Color and scale definitions plus the first picture, one per line."""
    definitions = F.concat(
        F.regexp_extract_all(column, F.lit(C.COLOR_DEFINITION_PATTERN), F.lit(0)),
        F.regexp_extract_all(column, F.lit(C.SCALE_DEFINITION_PATTERN), F.lit(0)),
    )
    # concat is null when there is no picture; the line break stays even without definitions.
    return F.concat(F.array_join(definitions, "\n"), F.lit("\n"), first_picture(column))


def declared_names(column, pattern: str) -> Column:
    """Trimmed entries of every brace list the pattern captures."""
    lists = F.regexp_extract_all(column, F.lit(pattern), F.lit(1))
    return F.flatten(
        F.transform(lists, lambda names: F.transform(F.split(names, ","), strip))
    )


def declared_packages(column) -> Column:
    """Packages named by the preamble, in catalog order."""
    declared = declared_names(column, C.USEPACKAGE_PATTERN)
    libraries = F.array_remove(declared_names(column, C.USELIBRARY_PATTERN), "")
    return F.filter(
        _texts(C.PACKAGE_NAMES),
        lambda name: F.array_contains(declared, name)
        | ((name == "tikz") & (F.size(libraries) > 0)),
    )


def required_packages(column: Column) -> Column:
    """Packages implied by the commands used, in catalog order."""
    marks = []
    for name in C.PACKAGE_NAMES:
        hints = [pattern for pattern, package in C.PACKAGE_HINTS if package == name]
        if hints:
            test = column.rlike("|".join(f"(?:{h})" for h in hints))
            marks.append(F.when(test, F.lit(name)))
    return F.array_compact(F.array(*marks))


def preamble(packages: Column, libraries: Column) -> Column:
    """Standalone preamble; null when a package is not in the catalog."""
    distinct = F.array_distinct(packages)
    resolved = F.when(F.array_contains(distinct, "tikz"), distinct).otherwise(
        F.concat(_texts(("tikz",)), distinct)
    )
    lines_of = F.create_map(
        *[part for name, lines in C.PACKAGES for part in (F.lit(name), _texts(lines))]
    )
    lines = F.array_distinct(
        F.flatten(F.transform(resolved, lambda name: F.try_element_at(lines_of, name)))
    )
    extra = F.array_distinct(libraries)
    library_line = F.when(
        F.size(extra) > 0,
        F.concat(F.lit("\\usetikzlibrary{"), F.array_join(extra, ","), F.lit("}\n")),
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("\\documentclass{standalone}\n"), F.array_join(lines, "\n"), F.lit("\n"),
        library_line,
    )


def standalone_document(markup: Column, packages: Column, libraries: Column) -> Column:
    """Wrap markup into a document unless it already is one."""
    wrapped = F.concat(
        preamble(packages, libraries), F.lit("\\begin{document}\n"), markup,
        F.lit("\n\\end{document}\n"),
    )
    return F.when(contains_text(markup, "\\documentclass"), markup).otherwise(wrapped)


def missing_package(log) -> Column:
    """Name of the file a build log reports as missing, without ``.sty``; else null."""
    name = F.nullif(F.regexp_extract(log, C.MISSING_FILE_PATTERN, 1), F.lit(""))
    return F.regexp_replace(name, r"\.sty$", "")


def failure_kind(log) -> Column:
    return F.when(missing_package(log).isNotNull(), F.lit("missing_package")).otherwise(
        F.lit("syntax_error")
    )


# --- Repair ----------------------------------------------------------------------------------


def _close_picture(text: Column) -> Column:
    inner = strip(
        F.replace(F.replace(text, F.lit(C.BEGIN_PICTURE), F.lit("")), F.lit(C.END_PICTURE), F.lit(""))
    )
    terminated = F.when(
        inner.contains(";"),
        F.substring(inner, F.lit(1), F.length(inner) - F.length(F.substring_index(inner, ";", -1))),
    ).otherwise(F.concat(inner, F.lit(" ;")))
    return F.when(
        contains_text(text, C.END_PICTURE),
        F.concat(F.lit(C.BEGIN_PICTURE + " "), terminated, F.lit(" " + C.END_PICTURE)),
    ).otherwise(F.concat(text, F.lit(" " + C.END_PICTURE)))


def sanitized(column) -> Column:
    """Complete the picture tags and end on a semicolon."""
    return _close_picture(strip(column))


def cleaned(column) -> Column:
    """Normalize token spacing, then close the picture like :func:`sanitized`."""
    text = strip(column)
    text = F.regexp_replace(text, *C.SPACING_BEFORE_POINTS)
    text = F.regexp_replace(text, C.POINT_PATTERN, "($1, $2)")
    for pattern, replacement in C.SPACING_AFTER_POINTS:
        text = F.regexp_replace(text, pattern, replacement)
    brackets = C.OPTIONS_PATTERN
    options = F.transform(
        F.regexp_extract_all(text, F.lit(brackets), F.lit(1)),
        lambda inner: F.concat(
            F.lit("["),
            F.regexp_replace(
                strip(F.replace(F.replace(inner, F.lit(" ,"), F.lit(",")), F.lit(" = "), F.lit("="))),
                r"\s+", " ",
            ),
            F.lit("]"),
        ),
    )
    pieces = F.zip_with(
        F.split(text, brackets), options,
        lambda gap, option: F.concat(gap, F.coalesce(option, F.lit(""))),
    )
    return _close_picture(F.array_join(pieces, ""))


# --- Structure -------------------------------------------------------------------------------


def occurrences(column: Column, part: str) -> Column:
    return F.length(column) - F.length(F.replace(column, F.lit(part), F.lit("")))


def unbalanced_delimiters(column: Column) -> Column:
    """Map of delimiter pair to ``|open - close|``."""
    entries = []
    for left, right in (("(", ")"), ("[", "]"), ("{", "}")):
        gap = F.abs(occurrences(column, left) - occurrences(column, right))
        entries += [F.lit(left + right), gap]
    return F.create_map(*entries)


def keywords_present(column: Column, keywords) -> Column:
    """Structural keywords found, in list order. Only texts that hold a word are matched."""

    def found(word: str) -> Column:
        held = contains_text(column, word)
        return held & column.rlike(rf"\b{word}\b") if word.isalnum() else held

    marks = [F.when(found(word), F.lit(word)) for word in keywords]
    return F.array_compact(F.array(*marks))


def emitted_commands(column) -> Column:
    """Drawing commands in statement order."""
    return F.transform(
        F.regexp_extract_all(column, F.lit(C.DRAWING_COMMAND_PATTERN), F.lit(1)), F.lower
    )


def structural_family(column: Column) -> Column:
    """First match of a keyword cascade. ``polyline`` and ``composed`` never come out."""
    text = F.lower(column)
    found = []
    for parts, family in C.FAMILY_WORDS:
        test = F.lit(False)
        for part in parts:
            test = test | text.contains(part)
        found.append(F.when(test, family))
    return F.coalesce(*found, F.lit("unknown"))


def points(column) -> Column:
    """Coordinate literals in order, as ``array<struct<x: double, y: double>>``."""
    xs = F.regexp_extract_all(column, F.lit(C.POINT_PATTERN), F.lit(1))
    ys = F.regexp_extract_all(column, F.lit(C.POINT_PATTERN), F.lit(2))
    return F.zip_with(
        xs, ys, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    )


def primitives(column) -> Column:
    """Statements with a command, in order: ``array<struct<kind, coords>>``."""
    text = F.regexp_replace(column, C.COMMENT_PATTERN, "")
    text = F.regexp_replace(text, C.BOILERPLATE_PATTERN, "")
    statements = F.filter(F.split(text, ";"), lambda s: s.rlike(C.COMMAND_PATTERN))
    return F.transform(
        statements,
        lambda s: F.struct(
            F.lower(F.regexp_extract(s, C.COMMAND_PATTERN, 1)).alias("kind"),
            points(s).alias("coords"),
        ),
    )
