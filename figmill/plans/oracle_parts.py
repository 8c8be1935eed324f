"""SQL fragments from which the oracle statements are put together.

The dialect is DuckDB's. Nothing here is shared with the jobs apart from fixed values, so
an error on one side shows up as a difference.
"""

import math

from figmill import constants as C


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


# --- Draws -----------------------------------------------------------------------------------


def h32(seed, key, slot) -> str:
    return f"('0x'||substr(md5(concat_ws(':',{seed},{key},{slot})),1,8))::BIGINT"


def u(seed, key, slot) -> str:
    return f"({h32(seed, key, slot)}/4294967296.0::DOUBLE)"


def integer(seed, key, slot, low, high) -> str:
    return f"(floor({u(seed, key, slot)}*{high - low + 1})::BIGINT+({low}))"


def pick(seed, key, slot, options) -> str:
    return f"({strings(options)})[floor({u(seed, key, slot)}*{len(options)})::BIGINT+1]"


def pick_weighted(draw: str, options) -> str:
    reached, text = 0.0, "CASE"
    for value, weight in options[:-1]:
        reached += weight
        text += f" WHEN {draw} < {round(reached, 12)}::DOUBLE THEN {q(value)}"
    return f"({text} ELSE {q(options[-1][0])} END)"


# --- Figures ---------------------------------------------------------------------------------


def num(h: str) -> str:
    return f"((({h})::DECIMAL(9,0)*0.01)::DECIMAL(12,2)::VARCHAR)"


def pt(x: str, y: str) -> str:
    return f"('('||{num(x)}||', '||{num(y)}||')')"


class Slots:
    """Draws of one figure part: ``base`` is an integer or an SQL expression."""

    def __init__(self, seed, key, base="0"):
        self.seed, self.key, self.base = seed, key, base

    def at(self, slot):
        return f"({self.base}+{slot})"

    def u(self, slot):
        return u(self.seed, self.key, self.at(slot))

    def int(self, slot, low, high):
        return integer(self.seed, self.key, self.at(slot), low, high)

    def pick(self, slot, options):
        return pick(self.seed, self.key, self.at(slot), options)

    def weighted(self, slot, options):
        return pick_weighted(self.u(slot), options)


def sql_line(s: Slots) -> str:
    def apart(a, b):
        return (f"(CASE WHEN abs({b}-{a})<10 THEN {b}+CASE WHEN {b}<=0 THEN 50 ELSE -50 END "
                f"ELSE {b} END)")

    x0, y0, x1, y1 = (s.int(i, -500, 500) for i in range(4))
    return (f"('\\draw['||{s.pick(4, C.LINE_WIDTHS)}||', '||{s.pick(5, C.COLORS)}||', '||"
            f"{s.pick(6, C.LINE_STYLES)}||'] '||{pt(x0, y0)}||' -- '||{pt(apart(x0, x1), apart(y0, y1))}||';')")


def sql_polyline(s: Slots) -> str:
    n = s.int(0, 3, 6)

    def axis(first):
        raw = f"list_transform(range(0,{n}), lambda i: {s.int(f'{first}+i', -500, 500)})"
        total = f"list_sum({raw})"
        squares = f"list_sum(list_transform({raw}, lambda v: v*v))"
        flat = f"({n}*{squares}-{total}*{total} < 25*{n}*{n})"
        return raw, flat

    (xs, fx), (ys, fy) = axis(3), axis(9)
    x = f"(({xs})[j]+CASE WHEN j=1 AND {fx} THEN 50 ELSE 0 END)"
    y = f"(({ys})[j]+CASE WHEN j=1 AND {fy} THEN 50 ELSE 0 END)"
    chain = f"array_to_string(list_transform(range(1,{n}+1), lambda j: {pt(x, y)}), ' -- ')"
    return f"('\\draw['||{s.pick(1, C.LINE_WIDTHS)}||', '||{s.pick(2, C.COLORS)}||'] '||{chain}||';')"


def sql_polygon(s: Slots) -> str:
    n, r = s.int(0, 3, 8), s.int(3, 50, 300)
    turn = f"({s.u(6)}*{2.0 * math.pi!r}::DOUBLE)"

    def vertex(center, wave):
        return (f"floor({center}+{r}*{wave}({turn}+{2.0 * math.pi!r}::DOUBLE*i/{n}::DOUBLE)"
                f"+0.5::DOUBLE)::BIGINT")

    corner = pt(vertex(s.int(1, -500, 500), "cos"), vertex(s.int(2, -500, 500), "sin"))
    chain = f"array_to_string(list_transform(range(0,{n}), lambda i: {corner}), ' -- ')"
    return (f"('\\draw['||{s.pick(4, C.LINE_WIDTHS)}||', '||{s.pick(5, C.COLORS)}||'] '||{chain}"
            f"||' -- cycle;')")


def sql_arc(start, sweep, radius):
    return f"('arc ('||{num(start)}||':'||{num(f'{start}+{sweep}')}||':'||{num(radius)}||')')"


def sql_circle_arc(s: Slots) -> str:
    r, kind = s.int(3, 50, 350), s.int(2, 0, 2)
    shape = (f"CASE {kind} WHEN 0 THEN 'circle ('||{num(r)}||')' "
             f"WHEN 1 THEN 'ellipse ('||{num(r)}||' and '||{num(s.int(6, 50, 350))}||')' "
             f"ELSE {sql_arc(s.int(7, 0, 35999), s.int(8, 3000, 33000), r)} END")
    return (f"('\\draw['||{s.pick(4, C.LINE_WIDTHS)}||', '||{s.pick(5, C.COLORS)}||'] '||"
            f"{pt(s.int(0, -500, 500), s.int(1, -500, 500))}||' '||{shape}||';')")


def sql_grid(s: Slots) -> str:
    b = s.int(1, 300, 500)
    return (f"('\\draw[step='||{num(s.int(0, 50, 200))}||', gray, thin] '||{pt(f'-{b}', f'-{b}')}||' grid '"
            f"||{pt(b, b)}||';'||chr(10)||'\\draw[->, thick] (-5.00, 0.00) -- (5.00, 0.00);'||chr(10)"
            f"||'\\draw[->, thick] (0.00, -5.00) -- (0.00, 5.00);')")


def sql_expression(basis, amp, freq):
    return (f"(CASE WHEN {basis} IN ('sin','cos') THEN {num(amp)}||'*'||{basis}||'('||{num(freq)}||'*\\x r)' "
            f"WHEN {basis}='quadratic' THEN {num(f'(2*{amp}+5)//10')}||'*(\\x)^2' "
            f"ELSE {num(amp)}||'*\\x' END)")


def sql_plot(s: Slots) -> str:
    b, basis = s.int(2, 300, 500), s.pick(3, [n for n, _ in C.PLOT_BASES])
    return (f"('\\draw[domain='||{num(f'-{b}')}||':'||{num(b)}||', smooth, '||{s.pick(4, C.LINE_WIDTHS)}"
            f"||', '||{s.pick(5, C.COLORS)}||'] plot (\\x, {{'||"
            f"{sql_expression(basis, s.int(0, 50, 300), s.int(1, 50, 300))}||'}});')")


def sql_nodes(s: Slots) -> str:
    n, ids = s.int(0, 2, 4), strings(C.NODE_IDS)
    node = (f"'\\node[circle, draw=black] ('||({ids})[i+1]||') at '||"
            f"{pt(s.int('1+i', -500, 500), s.int('5+i', -500, 500))}||' {{'||{s.pick('9+i', C.NODE_LABELS)}||'}};'")
    edge = (f"'\\draw[->, thick, '||{s.pick('13+i', C.COLORS)}||'] ('||({ids})[i+1]||') -- ('||({ids})[i+2]||');'")
    return (f"array_to_string(list_concat(list_transform(range(0,{n}), lambda i: {node}), "
            f"list_transform(range(0,{n}-1), lambda i: {edge})), chr(10))")


def sql_composed(s: Slots) -> str:
    inner = Slots(s.seed, s.key, "(4+9*p)")
    part = (f"CASE {s.int('1+p', 0, 2)} WHEN 0 THEN {sql_line(inner)} WHEN 1 THEN {sql_polygon(inner)} "
            f"ELSE {sql_circle_arc(inner)} END")
    return f"array_to_string(list_transform(range(0,{s.int(0, 2, 3)}), lambda p: {part}), chr(10))"


BODIES = dict(zip(C.FAMILIES, (sql_line, sql_polyline, sql_polygon, sql_circle_arc, sql_grid,
                               sql_plot, sql_nodes, sql_composed)))


def wrap(body: str) -> str:
    return f"('\\begin{{tikzpicture}}'||chr(10)||{body}||chr(10)||'\\end{{tikzpicture}}')"


def family_figure(name, seed, key) -> str:
    return wrap(BODIES[name](Slots(seed, key)))


def procedural(family, seed, key) -> str:
    cases = " ".join(f"WHEN {q(n)} THEN {b(Slots(seed, key))}" for n, b in BODIES.items())
    return wrap(f"(CASE {family} {cases} END)")


def sql_coordinate(s: Slots, x, y, rel) -> str:
    return f"(CASE WHEN {s.u(rel)}<0.5 THEN '' ELSE '++' END||{pt(s.int(x, -500, 500), s.int(y, -500, 500))})"


def sql_path(s: Slots) -> str:
    step = (f"CASE WHEN i=0 THEN '' ELSE ' '||{s.weighted('33+i', C.CONNECTORS)}||' ' END||"
            f"{sql_coordinate(s, '15+i', '21+i', '27+i')}")
    arc = sql_arc(s.int(12, 0, 35999), s.int(13, 3000, 33000), s.int(14, 50, 350))
    return (f"(array_to_string(list_transform(range(0,{s.int(10, 2, 6)}), lambda i: {step}), '')"
            f"||CASE WHEN {s.u(11)}<0.25 THEN ' '||{arc} ELSE '' END)")


def compositional(seed, key) -> str:
    s = Slots(seed, key, "(64*s)")
    arrow, pattern = s.weighted(7, C.ARROWS), s.weighted(3, C.FILL_PATTERNS)
    draw = (f"CASE WHEN {s.u(9)}<0.2 THEN '\\path[draw, ' ELSE '\\draw[' END||concat_ws(', ',"
            f"{s.pick(1, C.COLORS)}, CASE WHEN {s.u(2)}<0.7 THEN {s.pick(3, C.LINE_WIDTHS)} END,"
            f"CASE WHEN {s.u(4)}<0.5 THEN {s.pick(5, C.LINE_STYLES)} END,"
            f"CASE WHEN {s.u(6)}<0.4 AND {arrow}<>'' THEN {arrow} END,"
            f"CASE WHEN {s.u(8)}<0.2 THEN 'rounded corners' END)||'] '||{sql_path(s)}||';'")
    fill = (f"'\\fill['||concat_ws(', ',{s.pick(1, C.COLORS)}, 'fill opacity='||{num(s.int(2, 20, 90))},"
            f"CASE WHEN {pattern}<>'none' THEN 'pattern='||{pattern} END)||'] '||{sql_path(s)}||' -- cycle;'")
    node = (f"'\\node['||concat_ws(', ',{s.weighted(2, C.NODE_SHAPES)}, 'draw='||{s.pick(1, C.COLORS)},"
            f"CASE WHEN {s.u(3)}<0.6 THEN 'fill='||{s.pick(4, C.COLORS)} END,"
            f"CASE WHEN {s.u(5)}<0.4 THEN {s.pick(6, C.LINE_WIDTHS)} END)||'] at '||"
            f"{sql_coordinate(s, 8, 9, 10)}||' {{'||{s.pick(7, C.SCOPE_LABELS)}||'}};'")
    b = s.int(4, 300, 500)
    plot = (f"'\\draw[domain='||{num(f'-{b}')}||':'||{num(b)}||', smooth, '||{s.pick(1, C.COLORS)}||"
            f"'] plot (\\x, {{'||{sql_expression(s.weighted(5, C.PLOT_BASES), s.int(2, 50, 300), s.int(3, 50, 300))}||'}});'")
    scope = (f"CASE {s.weighted(0, C.SCOPE_KINDS)} WHEN 'draw' THEN {draw} WHEN 'node' THEN {node} "
             f"WHEN 'fill' THEN {fill} ELSE {plot} END")
    count = integer(seed, key, 0, 5, 20)
    return wrap(f"array_to_string(list_transform(range(1,{count}+1), lambda s: {scope}), chr(10))")


# --- Text ------------------------------------------------------------------------------------

TOKENS_RE = C.TOKEN_PATTERN.rpartition("|")[0] + r"|[^\s]"


def quantized(value, step=0.1) -> str:
    return (f"((-5.0)::DOUBLE+round_even((greatest((-5.0)::DOUBLE,least(5.0::DOUBLE,{value}))+5.0::DOUBLE)"
            f"/{step}::DOUBLE,0)*{step}::DOUBLE)::DECIMAL(12,4)")


def number_text(value) -> str:
    return f"rtrim(rtrim(({value})::DECIMAL(12,4)::VARCHAR,'0'),'.')"


def raw_tokens(text) -> str:
    return f"regexp_extract_all({text}, {q(TOKENS_RE)}, 0)"


def tokens(text, step=0.1) -> str:
    return (f"list_transform({raw_tokens(text)}, lambda t: CASE WHEN regexp_matches(t, '^-?\\d+\\.\\d+$') "
            f"THEN {number_text(quantized('TRY_CAST(t AS DOUBLE)', step))} ELSE t END)")


def words(text) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w<>'')"


def strip(text) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def point_lists(text) -> tuple[str, str]:
    return tuple(
        f"list_transform(regexp_extract_all({text}, {q(C.POINT_PATTERN)}, {g}), lambda v: v::DOUBLE)"
        for g in (1, 2)
    )


def statements(text) -> str:
    cleaned = (f"regexp_replace(regexp_replace({text}, {q(C.COMMENT_PATTERN)}, '', 'g'), "
               f"{q(C.BOILERPLATE_PATTERN)}, '', 'g')")
    return (f"list_filter(string_split({cleaned}, ';'), "
            f"lambda s: regexp_matches(s, {q(C.COMMAND_PATTERN)}))")


def sanitized(text) -> str:
    s = strip(text)
    inner = strip(f"replace(replace({s}, {q(C.BEGIN_PICTURE)}, ''), {q(C.END_PICTURE)}, '')")
    return (f"(CASE WHEN contains({s}, {q(C.END_PICTURE)}) THEN {q(C.BEGIN_PICTURE + ' ')}||"
            f"CASE WHEN contains({inner}, ';') THEN regexp_extract({inner}, '(?s)^(.*;)', 1) "
            f"ELSE {inner}||' ;' END||{q(' ' + C.END_PICTURE)} ELSE {s}||{q(' ' + C.END_PICTURE)} END)")


def family_of(text) -> str:
    rules = (("grid_axes", ("grid", "step=")), ("node_arrow", ("node",)),
             ("function_plot", ("plot", "domain")), ("circle_arc", ("circle", "arc")),
             ("polygon", ("cycle",)), ("line_segment", ("--",)))
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), {q(p)})" for p in parts) + f" THEN {q(name)}"
        for name, parts in rules
    )
    return f"(CASE {cases} ELSE 'unknown' END)"


def keywords(text, names) -> str:
    """Found keywords in list order."""
    tests = ", ".join(
        "CASE WHEN " + (f"regexp_matches({text}, {q(chr(92) + 'b' + w + chr(92) + 'b')})" if w.isalnum()
                        else f"contains({text}, {q(w)})") + f" THEN {q(w)} END"
        for w in names
    )
    return f"list_filter([{tests}], lambda w: w IS NOT NULL)"


def jaccard(a, b, empty) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    shared = f"len(list_intersect(list_distinct({a}), list_distinct({b})))"
    return f"(CASE WHEN {union}=0 THEN {empty} ELSE {shared}/{union}::DOUBLE END)"


def packages(test_of) -> str:
    marks = ", ".join(f"CASE WHEN {test_of(n)} THEN {q(n)} END" for n in C.PACKAGE_NAMES)
    return f"list_filter([{marks}], lambda p: p IS NOT NULL)"


def required_packages(text) -> str:
    def test(name):
        hints = [p for p, n in C.PACKAGE_HINTS if n == name]
        return " OR ".join(f"regexp_matches({text}, {q(h)})" for h in hints) or "false"

    return packages(test)


def declared_names(text, pattern) -> str:
    lists = f"regexp_extract_all({text}, {q(pattern)}, 1)"
    return (f"flatten(list_transform({lists}, lambda names: list_transform("
            f"string_split(names, ','), lambda n: {strip('n')})))")


def declared_packages(text) -> str:
    names = declared_names(text, C.USEPACKAGE_PATTERN)
    libs = declared_names(text, C.USELIBRARY_PATTERN)

    def test(name):
        own = f"list_contains({names}, {q(name)})"
        return own if name != "tikz" else f"{own} OR len(list_filter({libs}, lambda x: x<>''))>0"

    return packages(test)


# --- Tables ----------------------------------------------------------------------------------

FAMILY_LIST = strings(C.FAMILIES)

ORD = """ord AS (SELECT o_orderkey AS sample_id, o_custkey AS custkey, o_orderstatus AS status,
 o_orderpriority AS priority, floor(o_totalprice*100+0.5::DOUBLE)::BIGINT AS cents FROM orders)"""

FIG_BASE = f"""fig_base AS (SELECT *, sample_id%8 AS family_idx, ({FAMILY_LIST})[sample_id%8+1] AS family,
 ({FAMILY_LIST})[(sample_id%8+1)%8+1] AS next_family FROM ord)"""

FIGURES = f"""figures AS MATERIALIZED (SELECT *, {procedural('family', 42, 'sample_id')} AS markup FROM fig_base)"""

POLICY = ("CASE priority WHEN '1-URGENT' THEN 'greedy' WHEN '2-HIGH' THEN 'grammar_greedy' "
          "WHEN '3-MEDIUM' THEN 'beam' WHEN '4-NOT SPECIFIED' THEN 'nucleus' WHEN '5-LOW' THEN 'best_of_4' END")
TIER = "CASE status WHEN 'O' THEN 'tier1' WHEN 'F' THEN 'tier2' WHEN 'P' THEN 'tier3' END"

OUTCOME_COLUMNS = """(cents%4<>0) AS is_successful,
 CASE WHEN cents%8=0 THEN '! LaTeX Error: File `pkg'||(cents%13)||CASE WHEN cents%3=0 THEN '.cls' ELSE '.sty' END||''' not found.'
      WHEN cents%4=0 THEN '! Undefined control sequence.'||chr(10)||'l.'||(cents%17) ELSE '' END AS log,
 (cents%10007)/10006.0::DOUBLE AS ssim"""

PAIRS = f"""moved AS (SELECT *, regexp_replace(markup, '(\\.\\d)\\d', '\\1'||(custkey%10), 'g') AS shifted FROM figures),
pairs AS MATERIALIZED (SELECT sample_id, family, {POLICY} AS policy, {TIER} AS tier, cents AS seed, markup AS reference,
 CASE status WHEN 'P' THEN {procedural('next_family', 43, 'sample_id')}
  WHEN 'F' THEN replace(shifted, chr(10)||{q(C.END_PICTURE)}, '') ELSE shifted END AS candidate,
 {OUTCOME_COLUMNS} FROM moved)"""

OUTCOMES = f"""outcomes AS (SELECT sample_id, custkey AS image_id, {POLICY} AS policy, {TIER} AS tier,
 {OUTCOME_COLUMNS} FROM ord)"""

HEADS = (
    "\\usepackage{pgfplots, amsmath}\n\\usepackage{foo}\n",
    "\\usepackage[x11names]{xcolor}\n\\usetikzlibrary{arrows.meta,calc}\n",
    "\\definecolor{ink}{rgb}{0,0,0.5}\n\\def\\globalscale {1.0}\n\\usepackage {siunitx}\n",
    "\\begin{axis}\\addplot {x};\\end{axis} \\draw (0,0) to[R, l=1] (2,0);\n",
    "",
)

TEX_DOCS = f"""tex_docs AS MATERIALIZED (SELECT doc_id, lang, source, ({strings(HEADS)})[doc_id%5+1]||text||
 CASE WHEN doc_id%4>0 THEN chr(10)||{family_figure('line_segment', 42, '(doc_id%50)')} ELSE '' END||
 CASE WHEN doc_id%4>1 THEN chr(10)||'more'||chr(10)||{family_figure('node_arrow', 42, 'doc_id')} ELSE '' END AS code
 FROM documents)"""

SPLIT = "CASE WHEN family='node_arrow' OR custkey%10=0 THEN 'val' ELSE 'train' END"
SPLIT_FIGURES = f"sf AS (SELECT *, {SPLIT} AS split FROM figures)"

RESERVED = "('<PAD>',0),('<BOS>',1),('<EOS>',2),('<UNK>',3)"


def grid_tokens(step) -> str:
    return (f"SELECT {number_text(f'(-5.0)::DOUBLE+b*{step}::DOUBLE')} AS token "
            f"FROM range({round(10 / step) + 1}) r(b)")


def vocabulary(source: str, step=0.1, name="vocab") -> str:
    """CTE over ``source``, a query that yields one ``token`` column."""
    fams = " UNION ".join(f"SELECT {q(t)}" for t in C.FAMILY_TOKENS)
    return f"""{name} AS MATERIALIZED (SELECT token, 3+row_number() OVER (ORDER BY token) AS idx FROM
 (SELECT DISTINCT token FROM ({source} UNION {grid_tokens(step)} UNION {fams}) WHERE token NOT IN
  {in_list(C.RESERVED_TOKENS)}) UNION ALL SELECT * FROM (VALUES {RESERVED}) v(token, idx))"""


TOKS = f"""toks AS MATERIALIZED (SELECT sample_id, split, family, {tokens("'<FAM:'||family||'> '||markup")} AS tokens FROM sf)"""

VOCAB = vocabulary("SELECT unnest(tokens) AS token FROM toks WHERE split='train'")


def framed(ids, length) -> str:
    return (f"list_slice(list_concat([1], {ids}, [2], list_transform(range(0,greatest(0,{length}-len({ids})-2)), "
            f"lambda x: 0)), 1, {length})")


def encoded(length, source="toks", keep="sample_id, split", name="enc") -> str:
    return f"""{name}_ids AS (SELECT {keep}, list(coalesce(v.idx,3) ORDER BY pos) AS raw FROM
 (SELECT {keep}, unnest(tokens) AS token, generate_subscripts(tokens,1) AS pos FROM {source}) t
 LEFT JOIN vocab v USING (token) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {keep}, {framed('raw', length)} AS ids FROM {name}_ids)"""


def with_(*ctes: str, recursive=False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


FIG = (ORD, FIG_BASE, FIGURES)
PAIR = (*FIG, PAIRS)
SPL = (*FIG, SPLIT_FIGURES)
TOK = (*SPL, TOKS)
VOC = (*TOK, VOCAB)
ENC = (*VOC, encoded(C.MAX_SEQUENCE))
ENC_SHORT = (*VOC, encoded(48))
