"""Oracle statements: the same results in DuckDB SQL over the same tables."""

import math

from figmill import constants as C
from figmill.operators.report import TABLE_FEET, TABLE_HEADS
from figmill.plans.oracle_parts import (
    ENC, ENC_SHORT, FAMILY_LIST, FIG, FIG_BASE, ORD, OUTCOMES, PAIR, SPL, TEX_DOCS, TOK, VOC, BODIES, POLICY,
    Slots, compositional, declared_names, declared_packages, encoded, family_figure, family_of,
    grid_tokens, h32, in_list, jaccard, keywords, number_text, point_lists, procedural, q,
    quantized, raw_tokens, required_packages, sanitized, statements, strings, strip, tokens, u,
    vocabulary, with_, words, wrap,
)

ORACLES: dict[str, str] = {}

DIAGONAL = repr(C.CANVAS_DIAGONAL) + "::DOUBLE"
DOC_OUTCOMES = "doc_outcomes AS (SELECT doc_id AS sample_id, quality=1 AS is_successful FROM labels)"
FIRST_BLOCK = f"nullif(regexp_extract(code, {q(C.PICTURE_PATTERN)}, 0), '')"
GATED = f"""gated AS (SELECT doc_id, code, {FIRST_BLOCK} AS markup FROM tex_docs
 WHERE contains(code, {q(C.BEGIN_PICTURE)}) AND length(code)<=4000
 AND {FIRST_BLOCK} IS NOT NULL AND length({FIRST_BLOCK})<=4000)"""
SECONDS = "floor(epoch(ts))::BIGINT"
HOURS = f"({SECONDS}//3600)"

# === Sources and sinks =======================================================================

ORACLES["a1_shard_scan"] = """SELECT doc_id, scan_pos FROM (SELECT doc_id,
 row_number() OVER (ORDER BY doc_id)-1 AS scan_pos FROM documents) WHERE scan_pos<700"""
ORACLES["a2_markup_file_scan"] = with_(TEX_DOCS) + f"""SELECT markup, count(*) AS n FROM
 (SELECT unnest(regexp_extract_all(code, {q(C.PICTURE_PATTERN)}, 0)) AS markup FROM tex_docs) GROUP BY markup"""
ORACLES["a3_pair_reconciliation"] = with_(*SPL) + """SELECT split,
 count(*) FILTER (cents%9<>0 AND cents%4<>0) AS matched,
 count(*) FILTER (cents%9<>0 AND cents%4=0) AS markup_only,
 count(*) FILTER (cents%9=0 AND cents%4<>0) AS image_only
 FROM sf WHERE cents%9<>0 OR cents%4<>0 GROUP BY split"""


def char_gap(text, left, right):
    def count(ch):
        return f"(length({text})-length(replace({text}, {q(ch)}, '')))"

    return f"abs({count(left)}-{count(right)})"


COMMANDS = f"list_transform(regexp_extract_all(candidate, {q(C.DRAWING_COMMAND_PATTERN)}, 1), lambda c: lower(c))"
ORACLES["a4_evaluation_record_scan"] = with_(*PAIR) + f"""SELECT family, policy AS path_policy,
 CASE WHEN length(candidate)%2=0 THEN 2 ELSE 1 END::BIGINT AS record_version, count(*) AS n,
 count(*) FILTER (is_successful) AS compiled, sum({char_gap('candidate', '{', '}')})::BIGINT AS unbalanced_braces,
 sum(len({COMMANDS}))::BIGINT AS commands, 0::BIGINT AS policy_conflicts, round(sum(ssim),6) AS ssim_total
 FROM pairs GROUP BY ALL"""
POSITIONS = "row_number() OVER (PARTITION BY split ORDER BY sample_id)-1"
ORACLES["a5_split_positions"] = with_(*SPL) + f"""SELECT split, sample_id, position,
 printf('sample_%05d', position) AS sample_name FROM (SELECT split, sample_id, {POSITIONS} AS position FROM sf)"""
SHARDS = f"shards AS (SELECT *, position//500 AS shard_id FROM (SELECT *, {POSITIONS} AS position FROM sf))"
PACKED = f"""shards AS (SELECT *, position//500 AS shard_id FROM (SELECT sf.*, ids, {POSITIONS.replace('split', 'sf.split').replace('BY sample_id', 'BY sf.sample_id')} AS position
 FROM sf JOIN (SELECT sample_id, ids FROM enc) e ON e.sample_id=sf.sample_id))"""
ORACLES["a6_shard_packing"] = with_(*ENC, PACKED) + """SELECT split, shard_id, count(*) AS num_samples,
 min(sample_id) AS first_sample, max(sample_id) AS last_sample, sum(length(markup))::BIGINT AS chars, sum(list_sum(ids))::BIGINT AS id_sum,
 sum(list_sum(list_transform(range(64), lambda x: (cents+x*37)%256)))::BIGINT AS pixel_sum, sum(family_idx)::BIGINT AS label_sum
 FROM shards GROUP BY ALL"""
FAMILY_COUNTS = ", ".join(f"count(*) FILTER (family={q(f)}) AS {f}" for f in C.FAMILIES)
ORACLES["a7_shard_manifest"] = with_(*SPL, SHARDS) + f"""SELECT split, shard_id,
 split||'/'||split||'_shard_'||printf('%04d', shard_id) AS file_name, count(*) AS num_samples, {FAMILY_COUNTS}
 FROM shards GROUP BY split, shard_id"""
ORACLES["a7_master_manifest"] = with_(*SPL, SHARDS, """sized AS (SELECT split, shard_id, count(*) AS n FROM shards GROUP BY ALL),
 scopes AS (SELECT split, n FROM sized UNION ALL SELECT 'all', n FROM sized)""") + f"""SELECT split, 'v4' AS version, 256 AS image_size,
 {C.MAX_SEQUENCE} AS max_length, sum(n)::BIGINT AS total_samples, count(*) AS total_shards,
 CASE split WHEN 'all' THEN count(*) END AS listed_shards, CASE split WHEN 'all' THEN sum(n)::BIGINT END AS listed_samples FROM scopes GROUP BY split"""
ORACLES["a8_shard_lookup"] = with_(
    *SPL, SHARDS,
    "sizes AS (SELECT split, shard_id, count(*) AS n FROM shards GROUP BY ALL)",
    """bounds AS (SELECT split, shard_id, sum(n) OVER w::BIGINT AS hi, (sum(n) OVER w - n)::BIGINT AS lo FROM sizes
 WINDOW w AS (ORDER BY split, shard_id))""",
    'asked AS (SELECT o_orderkey*2-100 AS "index", unnest(range((o_orderkey%3=0)::INT+1)) AS client FROM orders)',
) + """SELECT a."index", a.client, b.split, b.shard_id, a."index"-b.lo AS "offset", b.lo IS NULL AS out_of_range
 FROM asked a LEFT JOIN bounds b ON a."index">=b.lo AND a."index"<b.hi"""

ORACLES["a7_manifest_files"] = with_(
    *SPL, SHARDS, "sizes AS (SELECT split, shard_id, count(*) AS n FROM shards GROUP BY ALL)",
    """docs AS (SELECT 'manifest_'||split||'.json' AS file, * FROM sizes UNION ALL SELECT 'manifest_v4.json', * FROM sizes)""",
) + """SELECT file, 'v4' AS version, sum(n) OVER (PARTITION BY file)::BIGINT AS total_samples,
 row_number() OVER (PARTITION BY file ORDER BY split, shard_id)-1 AS "at",
 split||'/'||split||'_shard_'||printf('%04d', shard_id) AS file_name, n AS num_samples, n AS family_total FROM docs"""
ORACLES["a8_fetched_samples"] = with_(
    *SPL, SHARDS, "placed AS (SELECT *, row_number() OVER (ORDER BY split, shard_id, position)-1 AS at FROM shards)",
) + """SELECT o_orderkey*2-100 AS "index", p.split, p.shard_id, p.position%500 AS "offset", p.at IS NULL AS out_of_range,
 p.sample_id, p.family, sha256(p.markup) AS fingerprint FROM orders LEFT JOIN placed p ON p.at=o_orderkey*2-100"""

FIRST_TEXTS = "kept AS (SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents WHERE length(text)<=4000 GROUP BY text)"


def rank_split(source, key, group=None):
    """CTE ``ranked`` with the hashed rank and the group size."""
    part = f"PARTITION BY {group}" if group else ""
    return f"""ranked AS (SELECT *, row_number() OVER ({part} ORDER BY {h32(42, key, q('split'))}, {key}) AS rk,
 count(*) OVER ({part}) AS size FROM {source})"""


ORACLES["a9_dataset_manifest"] = with_(FIRST_TEXTS, rank_split("kept", "doc_id", "lang")) + """SELECT lang,
 count(*) FILTER (rk>floor(size*0.1::DOUBLE)) AS train, count(*) FILTER (rk<=floor(size*0.1::DOUBLE)) AS val FROM ranked GROUP BY lang"""
ORACLES["a9_manifest_document"] = with_(
    *SPL, "built AS (SELECT *, CASE WHEN cents%10=0 THEN 'external' ELSE family END AS stratum FROM sf WHERE cents%4<>0)",
) + """SELECT 42::BIGINT AS seed, 0.1::DOUBLE AS val_ratio, 20000::BIGINT AS procedural, 2500::BIGINT AS "external", (SELECT count(*) FROM built) AS total,
 true AS showcase_rendered, (SELECT string_agg(f, ',' ORDER BY sample_id) FROM (SELECT sample_id, sha256(markup) AS f FROM built ORDER BY sample_id LIMIT 8)) AS fingerprints,
 stratum, count(*) FILTER (split='train') AS train, count(*) FILTER (split='val') AS val FROM built GROUP BY stratum"""
ORACLES["a9_manifest_totals"] = with_(*SPL) + """SELECT (SELECT count(*) FROM orders) AS requested, count(*) AS kept,
 count(*) FILTER (split='train') AS train, count(*) FILTER (split='val') AS val,
 round(count(*)/(SELECT count(*) FROM orders)::DOUBLE,6) AS compile_rate FROM sf WHERE cents%4<>0"""
ORACLES["a9_fingerprint_sample"] = with_(*FIG) + """SELECT sample_id, sha256(markup) AS fingerprint
 FROM figures ORDER BY sample_id LIMIT 8"""
ORACLES["a10_sample_manifest"] = with_(*FIG) + """SELECT printf('stage1_sample_%06d', sample_id) AS sample_id, family,
 cents AS seed, markup, round(cents/1000.0::DOUBLE,6) AS tensor_std, sha256(markup) AS image_sha256,
 CASE WHEN cents%4<>0 THEN 'SUCCESS' ELSE 'FAILED' END AS compilation_status FROM figures"""
ORACLES["a11_vocabulary_object"] = with_(*VOC) + "SELECT token, idx::BIGINT AS idx FROM vocab"
ORACLES["a11_vocabulary_round_trip"] = with_(*VOC) + "SELECT token, idx::BIGINT AS idx FROM vocab"

# === Predicates and gates ====================================================================

ORACLES["b1_length_budget"] = "SELECT doc_id, length(text) AS chars FROM documents WHERE length(text)<=4000"
ROOTED = " OR ".join(f"contains(code, {q(chr(92) + 'begin{' + e + '}')})" for e in C.ROOT_ENVIRONMENTS)
VIOLATION = f"CASE WHEN {strip('code')}='' THEN 'blank' WHEN NOT ({ROOTED}) THEN 'no_root_environment' ELSE 'valid' END"
ORACLES["b2_root_environment"] = with_(TEX_DOCS) + f"""SELECT doc_id, {VIOLATION} AS violation FROM
 (SELECT doc_id, CASE WHEN doc_id%11<>0 THEN code ELSE '' END AS code FROM tex_docs)"""
ORACLES["b3_package_whitelist"] = with_(TEX_DOCS, f"""named AS (SELECT doc_id, list_filter(
 {declared_names('code', C.USEPACKAGE_PATTERN)}, lambda p: NOT list_contains({strings(C.PACKAGE_NAMES)}, p)) AS unknown FROM tex_docs)""") + """
SELECT doc_id, array_to_string(unknown, '|') AS unknown FROM named WHERE len(unknown)>0"""
ORACLES["b4_candidate_gates"] = with_(TEX_DOCS, GATED) + "SELECT doc_id, markup FROM gated"
ORACLES["b4_candidate_funnel"] = with_(TEX_DOCS, f"""g AS (SELECT code<>'' AS g1, contains(code, {q(C.BEGIN_PICTURE)}) AS g2,
 length(code)<=4000 AS g3, {FIRST_BLOCK} IS NOT NULL AS g4, coalesce(length({FIRST_BLOCK})<=4000, false) AS g5 FROM tex_docs)""") + """
SELECT count(*) AS scanned, count(*) FILTER (g1) AS has_code, count(*) FILTER (g1 AND g2) AS has_begin_tag,
 count(*) FILTER (g1 AND g2 AND g3) AS code_in_budget, count(*) FILTER (g1 AND g2 AND g3 AND g4) AS has_block,
 count(*) FILTER (g1 AND g2 AND g3 AND g4 AND g5) AS block_in_budget FROM g"""
ORACLES["b5_successful_renders"] = with_(ORD, FIG_BASE) + """SELECT sample_id, family, family_idx FROM fig_base WHERE cents%4<>0"""

PX = """px AS MATERIALIZED (SELECT vec_id//16 AS image_id, vec_id%16 AS y, x-1 AS x, label,
 greatest(0, least(255, floor((v::DOUBLE+1.0::DOUBLE)*127.5::DOUBLE)))::DOUBLE AS p
 FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding,1) AS x FROM embeddings))"""
ORACLES["b6_degenerate_images"] = with_(PX) + """SELECT image_id, count(*) AS pixel_count, round(stddev_samp(p),6) AS pixel_std,
 (count(*)=1024 AND stddev_samp(p)>=0.0001) AS usable FROM px GROUP BY image_id"""
ORACLES["b7_shard_alignment"] = with_(*ENC, f"""shards AS (SELECT *, position//500 AS shard_id FROM
 (SELECT *, {POSITIONS} AS position FROM enc))""") + """SELECT split, shard_id, count(*) AS num_samples, count(*) AS num_images, count(ids) AS num_ids,
 count(*) AS num_labels, 64 AS min_pixels, 64 AS max_pixels, min(len(ids)) AS min_length, max(len(ids)) AS max_length, true AS aligned
 FROM shards GROUP BY split, shard_id"""
ORACLES["b8_vocabulary_invariants"] = with_(*VOC) + """SELECT count(*) AS entries, count(DISTINCT token) AS distinct_tokens,
 count(DISTINCT idx) AS distinct_ids, count(*) FILTER ((token,idx) IN (('<PAD>',0),('<BOS>',1),('<EOS>',2),('<UNK>',3))) AS reserved_in_place,
 count(*) FILTER (token='') AS empty_tokens,
 (count(*)=count(DISTINCT token) AND count(*)=count(DISTINCT idx)) AS valid FROM vocab"""
STAGE_PLAN = """plan AS (SELECT priority AS stage, CASE WHEN custkey%97=0 THEN 'freeform' ELSE family END AS family, count(*) AS samples
 FROM fig_base GROUP BY ALL)"""
ORACLES["b9_unknown_stage_families"] = with_(ORD, FIG_BASE, STAGE_PLAN) + f"SELECT * FROM plan WHERE family NOT IN {in_list(C.FAMILIES)}"
ORACLES["b9_planned_total"] = with_(ORD, FIG_BASE, STAGE_PLAN) + """SELECT sum(samples)::BIGINT AS total_samples,
 sum(samples)=120000 AS matches_plan FROM plan"""
ORACLES["b10_run_audit"] = with_(ORD, OUTCOMES, """ev AS (SELECT image_id AS run_id, sum(length(log)) AS bytes,
 count(*) FILTER (is_successful)>5 AS there, max(ssim)>0.9 AS sound, count(*) FILTER (tier='tier3') AS tests FROM outcomes GROUP BY image_id)""",
 """why AS (SELECT run_id, list_filter([CASE WHEN bytes=0 THEN 'empty_log' END, CASE WHEN NOT there THEN 'missing_checkpoint' END,
 CASE WHEN there AND NOT sound THEN 'corrupt_checkpoint' END, CASE WHEN tests=0 THEN 'missing_test_split' END], lambda r: r IS NOT NULL) AS r FROM ev)""") + """
SELECT run_id, CASE WHEN len(r)=0 THEN 'ready' ELSE 'blocked' END AS status, array_to_string(r, ',') AS blocking_reasons FROM why"""
TAGS = f"(contains(candidate, {q(C.BEGIN_PICTURE)}) AND contains(candidate, {q(C.END_PICTURE)}))"
ORACLES["b11_tags_present"] = with_(*PAIR) + f"""SELECT policy, count(*) FILTER ({TAGS}) AS complete,
 round(avg({TAGS}::INT),6) AS rate FROM pairs GROUP BY policy"""

# === Extraction and text =====================================================================

ORACLES["c1_picture_blocks"] = with_(TEX_DOCS) + f"""SELECT doc_id, unnest(range(len(b))) AS block_no, unnest(b) AS markup
 FROM (SELECT doc_id, regexp_extract_all(code, {q(C.PICTURE_PATTERN)}, 0) AS b FROM tex_docs)"""
ORACLES["c2_first_picture"] = with_(TEX_DOCS) + f"SELECT doc_id, {FIRST_BLOCK} AS markup FROM tex_docs"
ORACLES["c3_self_contained_figure"] = with_(TEX_DOCS) + f"""SELECT doc_id, array_to_string(list_concat(
 regexp_extract_all(code, {q(C.COLOR_DEFINITION_PATTERN)}, 0), regexp_extract_all(code, {q(C.SCALE_DEFINITION_PATTERN)}, 0)), chr(10))
 ||chr(10)||{FIRST_BLOCK} AS figure FROM tex_docs"""
ORACLES["c4_declared_packages"] = with_(TEX_DOCS) + f"SELECT doc_id, array_to_string({declared_packages('code')}, '|') AS packages FROM tex_docs"
ORACLES["c5_required_packages"] = with_(TEX_DOCS) + f"SELECT doc_id, array_to_string({required_packages('code')}, '|') AS packages FROM tex_docs"
LINES_OF = "CASE p " + " ".join(f"WHEN {q(n)} THEN {q(chr(10).join(ls))}" for n, ls in C.PACKAGES) + " END"


def preamble(pk):
    resolved = f"CASE WHEN list_contains({pk}, 'tikz') THEN {pk} ELSE list_concat(['tikz'], {pk}) END"
    return (f"('\\documentclass{{standalone}}'||chr(10)||array_to_string(list_transform({resolved}, lambda p: {LINES_OF}), chr(10))"
            f"||chr(10)||CASE WHEN doc_id%2=0 THEN '\\usetikzlibrary{{{','.join(C.TIKZ_LIBRARIES)}}}'||chr(10) ELSE '' END)")


ORACLES["c6_preamble"] = with_(TEX_DOCS, f"pk AS (SELECT doc_id, {declared_packages('code')} AS pks FROM tex_docs)") + f"""
SELECT doc_id, {preamble('pks')} AS preamble FROM pk"""
ORACLES["c7_standalone_document"] = with_(TEX_DOCS, f"pk AS (SELECT doc_id, code, {required_packages('code')} AS pks FROM tex_docs)",
 f"""whole AS (SELECT doc_id, CASE WHEN contains(code, '\\documentclass') THEN code ELSE {preamble('pks')}||'\\begin{{document}}'||chr(10)||code
 ||chr(10)||'\\end{{document}}'||chr(10) END AS t FROM pk)""") + "SELECT doc_id, length(t) AS chars, sha256(t) AS fingerprint FROM whole"
ORACLES["c8_build_log_triage"] = with_(ORD, OUTCOMES, f"""named AS (SELECT nullif(regexp_extract(log, {q(C.MISSING_FILE_PATTERN)}, 1), '') AS f
 FROM outcomes WHERE NOT is_successful)""") + """SELECT CASE WHEN f IS NULL THEN 'syntax_error' ELSE 'missing_package' END AS failure_kind,
 coalesce(CASE WHEN f LIKE '%.sty' THEN f[:-5] ELSE f END, '-') AS package, count(*) AS failures FROM named GROUP BY ALL"""
ORACLES["c9_fingerprints"] = "SELECT doc_id, sha256(text) AS fingerprint FROM documents"
ORACLES["c10_sanitized"] = with_(*PAIR) + f"SELECT sample_id, {sanitized('candidate')} AS markup FROM pairs"
BRACKETS = r"\[\s*([^\[\]]+?)\s*\]"
INNER = strip("replace(replace(inner_text, ' ,', ','), ' = ', '=')")
ORACLES["c11_cleaned"] = with_(
    *PAIR,
    f"s0 AS (SELECT sample_id, array_to_string({tokens('candidate')}, '  ') AS t FROM pairs)",
    r"s1 AS (SELECT sample_id, regexp_replace(t, '\(\s*([a-zA-Z0-9_-]+)\s*\)', '(\1)', 'g') AS t FROM s0)",
    f"s2 AS (SELECT sample_id, regexp_replace(t, {q(C.POINT_PATTERN)}, '(\\1, \\2)', 'g') AS t FROM s1)",
    r"s3 AS (SELECT sample_id, regexp_replace(t, 'circle\s*\(\s*(-?\d+(?:\.\d+)?)\s*\)', 'circle (\1)', 'g') AS t FROM s2)",
    r"s4 AS (SELECT sample_id, regexp_replace(regexp_replace(t, '\{\s+\}', '{}', 'g'), '\{\s*([^{}]+?)\s*\}', '{\1}', 'g') AS t FROM s3)",
    f"""s5 AS (SELECT sample_id, regexp_split_to_array(t, {q(BRACKETS)}) AS gaps, list_transform(regexp_extract_all(t, {q(BRACKETS)}, 1),
 lambda inner_text: '['||regexp_replace({INNER}, '\\s+', ' ', 'g')||']') AS opts FROM s4)""",
    """s6 AS (SELECT sample_id, array_to_string(list_transform(range(1, len(gaps)+1), lambda i: gaps[i]||coalesce(opts[i], '')), '') AS t FROM s5)""",
) + f"SELECT sample_id, {sanitized('t')} AS markup FROM s6"
ORACLES["c12_unbalanced_delimiters"] = with_(*PAIR) + f"""SELECT sample_id, {char_gap('candidate', '(', ')')} AS parens,
 {char_gap('candidate', '[', ']')} AS brackets, {char_gap('candidate', '{', '}')} AS braces FROM pairs"""
ORACLES["c13_keywords"] = with_(*PAIR) + f"""SELECT sample_id, array_to_string({keywords('candidate', C.EVALUATION_KEYWORDS)}, ' ') AS evaluation,
 array_to_string({keywords('candidate', C.DIAGNOSTIC_KEYWORDS)}, ' ') AS diagnostic FROM pairs"""
ORACLES["c14_emitted_commands"] = with_(*PAIR) + f"SELECT sample_id, array_to_string({COMMANDS}, '|') AS commands FROM pairs"
ORACLES["c15_structural_family"] = with_(*PAIR) + f"SELECT family, {family_of('candidate')} AS predicted, count(*) AS n FROM pairs GROUP BY ALL"
XS, YS = point_lists("markup")
ORACLES["c16_points"] = with_(*FIG) + f"""SELECT sample_id, unnest(range(len(xs))) AS pos, unnest(xs) AS x, unnest(ys) AS y
 FROM (SELECT sample_id, {XS} AS xs, {YS} AS ys FROM figures)"""
SX, SY = point_lists("stmt")
ORACLES["c17_primitives"] = with_(*PAIR, f"st AS (SELECT sample_id, {statements('candidate')} AS ss FROM pairs)",
 "ex AS (SELECT sample_id, unnest(range(len(ss))) AS pos, unnest(ss) AS stmt FROM st)") + f"""SELECT sample_id, pos,
 kind, unnest(CASE WHEN len(xs)=0 THEN [NULL] ELSE range(len(xs)) END) AS point, unnest(CASE WHEN len(xs)=0 THEN [NULL] ELSE xs END) AS x,
 unnest(CASE WHEN len(ys)=0 THEN [NULL] ELSE ys END) AS y
 FROM (SELECT sample_id, pos, lower(regexp_extract(stmt, {q(C.COMMAND_PATTERN)}, 1)) AS kind, {SX} AS xs, {SY} AS ys FROM ex)"""
ORACLES["c18_picture_wrap_and_body"] = with_(ORD, FIG_BASE) + f"""SELECT sample_id, CASE family {' '.join(
    f"WHEN {q(n)} THEN {b(Slots(42, 'sample_id'))}" for n, b in BODIES.items())} END AS body, true AS round_trip FROM fig_base"""

# === Tokens and encoding =====================================================================

MEASURES = """m AS (SELECT l_quantity/4.0::DOUBLE-6.0::DOUBLE-l_discount AS x, l_tax*100.0::DOUBLE-l_quantity/5.0::DOUBLE AS y FROM lineitem)"""
ORACLES["d1_quantized_scalars"] = with_(MEASURES) + f"""SELECT {number_text(quantized('x'))} AS coarse,
 {number_text(quantized('x', 0.05))} AS fine, count(*) AS n FROM m GROUP BY ALL"""
ORACLES["d2_quantized_points"] = with_(MEASURES) + f"""SELECT {quantized('x')}::DOUBLE AS qx, {quantized('y')}::DOUBLE AS qy, count(*) AS n
 FROM m GROUP BY ALL"""
ORACLES["d3_grid_coverage"] = with_(*TOK, "c AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM toks) GROUP BY token)") + f"""
SELECT b AS bin, g.token, coalesce(n, 0) AS occurrences FROM (SELECT b, {number_text('(-5.0)::DOUBLE+b*0.1::DOUBLE')} AS token FROM range(101) r(b)) g
 LEFT JOIN c ON c.token=g.token"""
ORACLES["d3_fine_grid_coverage"] = with_(*PAIR, f"c AS (SELECT token, count(*) AS n FROM (SELECT unnest({tokens('candidate', 0.05)}) AS token FROM pairs) GROUP BY token)") + f"""
SELECT b AS bin, g.token, coalesce(n, 0) AS occurrences FROM (SELECT b, {number_text('(-5.0)::DOUBLE+b*0.05::DOUBLE')} AS token FROM range(201) r(b)) g
 LEFT JOIN c ON c.token=g.token"""
ORACLES["d4_tokens"] = with_(*PAIR) + f"""SELECT sample_id, array_to_string({tokens('candidate')}, ' ') AS quantized,
 len({raw_tokens('candidate')}) AS raw_tokens FROM pairs"""
ORACLES["d5_vocabulary"] = ORACLES["a11_vocabulary_round_trip"]
ORACLES["d6_encoded"] = with_(*ENC) + "SELECT sample_id, array_to_string(ids, ' ') AS ids FROM enc"
ORACLES["d6_truncated"] = with_(*ENC_SHORT) + """SELECT sample_id, array_to_string(ids, ' ') AS ids,
 NOT list_contains(ids, 2) AS truncated FROM enc"""
ORACLES["d7_split_encoding"] = with_(*ENC) + """SELECT split, count(*) AS samples,
 sum(len(list_filter(ids, lambda t: t=3)))::BIGINT AS unknown_ids, max(len(ids)) AS length FROM enc GROUP BY split"""


def decoded(dropped, default):
    return f"""dec AS (SELECT e.sample_id, list({default} ORDER BY pos) FILTER (e.id NOT IN {dropped} AND {default} IS NOT NULL) AS toks FROM
 (SELECT sample_id, unnest(ids) AS id, generate_subscripts(ids,1) AS pos FROM enc) e LEFT JOIN vocab v ON v.idx=e.id GROUP BY e.sample_id)"""


ORACLES["d8_decoded"] = with_(*ENC, decoded("(0,1,2)", "coalesce(token,'<UNK>')")) + "SELECT sample_id, array_to_string(toks, ' ') AS markup FROM dec"
ROOTS = strings([f"\\begin{{{e}}}" for e in C.ROOT_ENVIRONMENTS])
ORACLES["d9_predicted_markup"] = with_(
    *ENC, decoded("(0,1,2,3)", "token"),
    "body AS (SELECT sample_id, list_filter(toks, lambda t: NOT (t LIKE '<FAM:%>')) AS b FROM dec)",
    f"root AS (SELECT *, list_filter(b, lambda t: list_contains({ROOTS}, t))[1] AS r FROM body)",
    "opened AS (SELECT *, replace(r, '\\begin', '\\end') AS e, CASE WHEN b[1]=r THEN b ELSE list_concat([r], list_filter(b, lambda t: t<>r)) END AS o FROM root)",
    f"""done AS (SELECT sample_id, array_to_string(CASE WHEN r IS NULL THEN list_concat([{q(C.BEGIN_PICTURE)}], list_filter(b, lambda t: t NOT IN ({q(C.BEGIN_PICTURE)},{q(C.END_PICTURE)})), [{q(C.END_PICTURE)}])
 WHEN o[-1]=e THEN o ELSE list_concat(list_filter(o, lambda t: t<>e), [e]) END, ' ') AS markup FROM opened)""",
) + f"SELECT sample_id, markup, array_to_string({required_packages('markup')}, '|') AS packages FROM done"
ORACLES["d10_family_tagged"] = with_(*FIG) + "SELECT sample_id, '<FAM:'||family||'> '||markup AS markup FROM figures"
ORACLES["d11_teacher_forcing"] = with_(*ENC) + "SELECT sample_id, array_to_string(ids[:-2], ' ') AS inputs, array_to_string(ids[2:], ' ') AS targets FROM enc"
ORACLES["d12_word_dropout"] = with_(*ENC) + f"""SELECT sample_id, array_to_string(list_transform(ids[:-2], lambda t, i:
 CASE WHEN t<>1 AND {u(42, 'sample_id', '(i-1)')}<0.35::DOUBLE THEN 3 ELSE t END), ' ') AS inputs FROM enc"""
CLASS = f"""CASE WHEN regexp_matches(token, {q(C.NUMERIC_TOKEN_PATTERN)}) THEN 'numeric' WHEN token IN {in_list(C.GEOMETRIC_TOKENS)} THEN 'geometric'
 WHEN token IN {in_list(C.BOILERPLATE_TOKENS)} THEN 'boilerplate' ELSE 'other' END"""
WEIGHT = "CASE class " + " ".join(f"WHEN {q(n)} THEN {w}::DOUBLE" for n, w in C.CLASS_WEIGHTS) + " END"
ORACLES["d13_token_class_mass"] = with_(*TOK, "c AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM toks) GROUP BY token)",
 f"k AS (SELECT {CLASS} AS class, n FROM c)") + f"""SELECT class, count(*) AS distinct_tokens, sum(n)::BIGINT AS occurrences,
 round(sum(n*{WEIGHT}),6) AS weight_mass FROM k GROUP BY class"""
ORACLES["d14_ordinal_targets"] = with_(*VOC, f"nums AS (SELECT token, token::DOUBLE AS v FROM vocab WHERE regexp_matches(token, {q(C.NUMBER_PATTERN)}))",
 "w AS (SELECT a.token AS target, b.v, exp(-0.5::DOUBLE*((a.v-b.v)/0.2::DOUBLE)**2) AS m FROM nums a CROSS JOIN nums b)",
 "n AS (SELECT target, v, m/sum(m) OVER (PARTITION BY target) AS w FROM w)") + """SELECT target, count(*) FILTER (w>1e-12) AS support,
 round(max(w),6) AS peak, round(sum(w*v),6)+0.0 AS mean_value FROM n GROUP BY target"""
ORACLES["d15_sequence_audit"] = with_(*ENC, "a AS (SELECT sample_id, ids, list_position(ids, 2) AS e FROM enc)") + """SELECT sample_id, len(ids) AS total_length,
 list_contains(ids, 1) AS has_bos, coalesce(e,0)>0 AS has_eos, CASE WHEN e>0 THEN (e-1)::BIGINT END AS eos_position,
 CASE WHEN e>0 THEN e::BIGINT ELSE len(ids) END AS length_to_eos, len(list_filter(ids, lambda t: t=3)) AS unk_count,
 len(list_filter(ids, lambda t: t=0)) AS pad_count FROM a"""

OPEN_TAGS = in_list([f"\\begin{{{e}}}" for e in C.ROOT_ENVIRONMENTS])
END_TAGS = in_list([f"\\end{{{e}}}" for e in C.ROOT_ENVIRONMENTS])
EMITTED = f"""em AS (SELECT sample_id, unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM
 (SELECT sample_id, list_concat({tokens("'<FAM:'||family||'> '||candidate")}, ['<EOS>']) AS ts FROM pairs))"""


def _depth(left, right):
    return f"CASE token WHEN {q(left)} THEN 1 WHEN {q(right)} THEN -1 ELSE 0 END"


RULES = (
    EMITTED,
    f"""st AS (SELECT *, coalesce(count(*) OVER b,0) AS k, first_value(token) OVER f AS t1, lag(token) OVER o AS tp,
 coalesce(max((starts_with(token,'\\end{{'))::INT) OVER b,0) AS closed, coalesce(sum((token=';')::INT) OVER b,0) AS semis,
 coalesce(max(CASE WHEN token=';' THEN pos END) OVER b,-1) AS lastsemi,
 coalesce(max(CASE WHEN starts_with(token,'\\') AND NOT starts_with(token,'\\end{{') AND token<>'\\x' AND token NOT IN {OPEN_TAGS} THEN pos END) OVER b,-1) AS lastcmd,
 sum({_depth('(', ')')}) OVER i AS sp, sum({_depth('[', ']')}) OVER i AS sb, sum({_depth('{', '}')}) OVER i AS sc FROM em
 WINDOW o AS (PARTITION BY sample_id ORDER BY pos), f AS (PARTITION BY sample_id ORDER BY pos ROWS UNBOUNDED PRECEDING),
 i AS (PARTITION BY sample_id ORDER BY pos ROWS UNBOUNDED PRECEDING),
 b AS (PARTITION BY sample_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    """dp AS (SELECT *, coalesce(lag(sp) OVER o,0)-least(0,coalesce(min(sp) OVER b,0)) AS p, coalesce(lag(sb) OVER o,0)-least(0,coalesce(min(sb) OVER b,0)) AS br,
 coalesce(lag(sc) OVER o,0)-least(0,coalesce(min(sc) OVER b,0)) AS c FROM st
 WINDOW o AS (PARTITION BY sample_id ORDER BY pos), b AS (PARTITION BY sample_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    f"""ru AS (SELECT sample_id, pos, token, CASE WHEN token IN ('<PAD>','<UNK>') THEN 'reserved_token'
 WHEN k=0 THEN CASE WHEN token NOT IN {OPEN_TAGS} AND token NOT IN {in_list(C.FAMILY_TOKENS)} THEN 'opener_first' END
 WHEN k=1 AND starts_with(t1,'<FAM:') THEN CASE WHEN token NOT IN {OPEN_TAGS} THEN 'opener_after_family' END
 WHEN closed=1 THEN CASE WHEN token<>'<EOS>' THEN 'only_eos_after_end' END
 WHEN token='<EOS>' THEN 'eos_before_end' WHEN token IN {OPEN_TAGS} THEN 'repeated_opener'
 WHEN (token=')' AND p=0) OR (token=']' AND br=0) OR (token='}}' AND c=0) THEN 'close_at_depth_zero'
 WHEN token IN ('(','[') AND p>0 THEN 'opened_inside_paren' WHEN token='[' AND br>0 THEN 'opened_inside_bracket'
 WHEN token=';' AND (p>0 OR br>0 OR c>0) THEN 'semicolon_inside_delimiters' WHEN token=';' AND tp=';' THEN 'empty_statement'
 WHEN token IN {END_TAGS} AND NOT (p=0 AND br=0 AND c=0 AND semis>0 AND lastcmd<=lastsemi) THEN 'end_not_allowed' END AS rule FROM dp)""",
)
ORACLES["d16_grammar_audit"] = with_(*PAIR, *RULES) + "SELECT sample_id, pos, token, rule FROM ru WHERE rule IS NOT NULL"
ORACLES["d16_grammar_violations"] = with_(*PAIR, *RULES) + """SELECT rule, count(*) AS tokens, count(DISTINCT sample_id) AS samples
 FROM ru WHERE rule IS NOT NULL GROUP BY rule"""
ORACLES["d17_batch_bounds"] = """SELECT p//64 AS batch, min(p) AS "start", max(p)+1 AS "end" FROM
 (SELECT row_number() OVER (ORDER BY doc_id)-1 AS p FROM documents) GROUP BY batch"""
ORACLES["d18_reference_round_trip"] = with_(*ENC, decoded("(0,1,2)", "coalesce(token,'<UNK>')")) + f"""SELECT sample_id,
 array_to_string({tokens("array_to_string(toks, ' ')")}, ' ') AS tokens FROM dec"""

# === Dedup, splits, sampling =================================================================

ORACLES["e1_deduplicated"] = "SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text"
ORACLES["e2_deduplicated_by_block"] = with_(TEX_DOCS, f"b AS (SELECT doc_id, code, {FIRST_BLOCK} AS m FROM tex_docs)") + """
SELECT min(doc_id) AS doc_id, sha256(arg_min(code, doc_id)) AS fingerprint FROM b WHERE m IS NOT NULL GROUP BY m"""
CANDIDATES = """cand AS (SELECT min(doc_id) AS doc_id, markup FROM gated WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5000)
 GROUP BY markup ORDER BY doc_id LIMIT 300)"""
ORACLES["e3_candidate_scan"] = with_(TEX_DOCS, GATED, CANDIDATES) + "SELECT doc_id, markup FROM cand"
ORACLES["e4_successful_head"] = with_(TEX_DOCS, GATED, CANDIDATES, DOC_OUTCOMES) + """SELECT doc_id, markup FROM cand
 WHERE doc_id IN (SELECT sample_id FROM doc_outcomes WHERE is_successful) ORDER BY doc_id LIMIT 100"""
DOC_RANK = rank_split("documents", "doc_id")
ORACLES["e5_random_split"] = with_(DOC_RANK) + """SELECT doc_id, CASE WHEN rk<=greatest(1, least(round_even(size*0.1::DOUBLE,0), size-1))
 THEN 'val' ELSE 'train' END AS split FROM ranked"""
ORACLES["e6_stratified_split"] = with_(rank_split("documents", "doc_id", "lang")) + """SELECT doc_id, lang,
 CASE WHEN rk<=floor(size*0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM ranked"""
ORACLES["e7_tenth_split"] = with_(DOC_RANK) + "SELECT doc_id, CASE WHEN rk<=floor(size*0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM ranked"
ORACLES["e7_stage_split"] = with_(DOC_RANK) + """SELECT doc_id, CASE WHEN rk<=CASE WHEN size<=100 THEN greatest(1, floor(size*0.2::DOUBLE))
 ELSE least(greatest(100, floor(size*0.1::DOUBLE)), size-1) END THEN 'val' ELSE 'train' END AS split FROM ranked"""
ORACLES["e8_banded_split"] = with_(ORD, FIG_BASE, rank_split("fig_base", "sample_id", "family")) + """SELECT sample_id, family,
 CASE WHEN rk<=900 THEN 'train' WHEN rk<=950 THEN 'val' ELSE 'test' END AS split FROM ranked WHERE rk<=1000"""
QUOTA = f"""tried AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY sample_id) AS a FROM fig_base) WHERE a<=1500),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY sample_id) AS b FROM tried WHERE cents%4=0 AND family<>'{C.FAMILIES[2]}') WHERE b<=500)"""
ORACLES["e9_quota_fill"] = with_(ORD, FIG_BASE, QUOTA) + "SELECT sample_id, family FROM kept"
ORACLES["e9_quota_shortfall"] = with_(ORD, FIG_BASE, QUOTA) + "SELECT f.family, count(k.family) AS collected, 500-count(k.family) AS shortfall FROM (SELECT unnest({names}) AS family) f LEFT JOIN kept k USING (family) GROUP BY f.family".format(names=list(C.FAMILIES))
ORACLES["e10_first_valid_attempt"] = with_(ORD, f"""tries AS (SELECT sample_id, cents, (SELECT min(k) FROM range(10) r(k)
 WHERE {u(42, 'sample_id', "'try'||k")}>=0.4) AS a FROM ord)""") + """SELECT sample_id, a AS attempt, cents+a*1000003 AS final_seed, a IS NULL AS failed FROM tries"""
CUMULATIVE = [round(sum(C.STAGES[0][3][: i + 1]), 12) for i in range(8)]
DRAWN = "CASE " + " ".join(f"WHEN d<{c}::DOUBLE THEN {q(f)}" for f, c in list(zip(C.FAMILIES, CUMULATIVE))[:-1]) + f" ELSE {q(C.FAMILIES[-1])} END"
ORACLES["e11_curriculum_draws"] = with_(
    ORD, FIG_BASE, f"pool AS (SELECT sample_id, family FROM fig_base WHERE family<>{q(C.FAMILIES[1])})",
    f"dr AS (SELECT draw_id, {DRAWN} AS family FROM (SELECT draw_id, {u(42, 'draw_id', q('family'))} AS d FROM (SELECT sample_id*3+unnest(range(3)) AS draw_id FROM ord)))",
    "ps AS (SELECT family, count(*) AS size FROM pool GROUP BY family)",
    "nu AS (SELECT draw_id, dr.family, row_number() OVER (PARTITION BY dr.family ORDER BY draw_id)-1 AS k, size FROM dr LEFT JOIN ps USING (family))",
    "li AS (SELECT sample_id, family, row_number() OVER (PARTITION BY family ORDER BY sample_id)-1 AS place FROM pool)",
    "pk AS (SELECT *, k//size AS pass, family||'/'||(k//size) AS own FROM nu)",
    f"""ks AS (SELECT own, size, list_transform(range(24), lambda i: {h32(42, 'own', "('swap'||i)")} % size) AS ks FROM (SELECT DISTINCT own, size FROM pk WHERE size IS NOT NULL))""",
    """mv AS (SELECT pk.*, list_reduce(list_concat([pk.k%pk.size], range(24)), lambda x, i: CASE WHEN
 substring(md5('42:'||pk.own||':'||i||':'||greatest(x, ((ks[i+1]-x)%pk.size+pk.size)%pk.size)), 1, 1)<'8' THEN ((ks[i+1]-x)%pk.size+pk.size)%pk.size ELSE x END) AS place
 FROM pk LEFT JOIN ks USING (own))""",
) + """SELECT draw_id, mv.family, pass, li.sample_id, CASE WHEN size IS NULL THEN 'empty_pool' END AS reason FROM mv LEFT JOIN li ON li.family=mv.family AND li.place=mv.place"""
ORACLES["e12_round_robin"] = f"""SELECT doc_id, ({FAMILY_LIST})[p%5+1] AS family, {h32(42, 'p', q('seed'))}%2000000000 AS seed FROM
 (SELECT doc_id, row_number() OVER (ORDER BY doc_id)-1 AS p FROM documents)"""
TIER2 = f"tier2 AS MATERIALIZED (SELECT c_custkey AS sample_id, {compositional(42, 'c_custkey')} AS markup FROM customer)"
ORACLES["e13_mixed_tiers"] = with_(*FIG, TIER2) + """SELECT 'tier1' AS tier, count(*) AS samples, sum(length(markup))::BIGINT AS chars FROM figures
 UNION ALL SELECT 'tier2', count(*), sum(length(markup))::BIGINT FROM tier2"""
LANG_SPLIT = rank_split("documents", "doc_id", "lang")
TEST_TRAIN = "te AS (SELECT * FROM ranked WHERE rk<=floor(size*0.1::DOUBLE)), tr AS (SELECT * FROM ranked WHERE rk>floor(size*0.1::DOUBLE))"
ORACLES["e14_leaked_rows"] = with_(LANG_SPLIT, TEST_TRAIN) + "SELECT doc_id FROM te WHERE text IN (SELECT text FROM tr)"
ORACLES["e14_independent_rows"] = with_(LANG_SPLIT, TEST_TRAIN) + "SELECT doc_id FROM te WHERE text NOT IN (SELECT text FROM tr)"
ORACLES["e15_replicated"] = "SELECT k AS copy, count(*) AS rows, sum(doc_id)::BIGINT AS doc_sum FROM documents CROSS JOIN range(3) r(k) GROUP BY k"
ORACLES["e16_evaluation_head"] = with_(ORD, FIG_BASE) + "SELECT sample_id, family FROM fig_base ORDER BY sample_id LIMIT 200"

# === Generation ==============================================================================

for _n, _name in enumerate(C.FAMILIES, start=1):
    ORACLES[f"g{_n}_{_name}"] = f"SELECT o_orderkey AS sample_id, {family_figure(_name, 42, 'o_orderkey')} AS markup FROM orders"
ORACLES["g9_procedural_corpus"] = with_(*FIG) + "SELECT sample_id, family_idx, family, markup FROM figures"
ORACLES["g10_grammar_scopes"] = with_(TIER2) + """SELECT sample_id, unnest(range(len(l)-2)) AS scope_no, unnest(l[2:-2]) AS scope FROM
 (SELECT sample_id, string_split(markup, chr(10)) AS l FROM tier2)"""
ORACLES["g11_compositional_figures"] = with_(TIER2) + "SELECT sample_id, markup, length(markup)<=4000 AS in_budget FROM tier2"
SALT = "('test/'||family||'/'||copy||'/'||sample_id)"
ORACLES["g12_independent_test_split"] = with_(*FIG, f"""te AS (SELECT sample_id, family, copy, CASE WHEN family IN ('composed','ood_composed') THEN {compositional(42, SALT)}
 ELSE {procedural('family', 42, SALT)} END AS markup FROM (SELECT s_suppkey AS sample_id, unnest({strings(C.FAMILIES)}) AS family, 0 AS copy FROM supplier
 UNION ALL SELECT s_suppkey, {q(C.OOD_FAMILY)}, unnest(range(3)) FROM supplier))""") + """SELECT sample_id, family, copy, markup FROM te
 WHERE markup NOT IN (SELECT markup FROM figures)"""
ORACLES["g13_seed_vocabulary"] = with_(
    f"k AS (SELECT c_custkey AS sample_id, unnest({FAMILY_LIST}) AS family FROM customer)",
    f"s AS MATERIALIZED (SELECT '<FAM:'||family||'> '||{procedural('family', 42, 'sample_id')} AS t FROM k)",
    vocabulary(f"SELECT unnest({tokens('t', 0.05)}) AS token FROM s", 0.05),
) + "SELECT token, idx::BIGINT AS idx FROM vocab"
ORACLES["g14_tier_assembly"] = with_(
    *FIG, TIER2, TEX_DOCS, GATED,
    f"r1 AS (SELECT *, row_number() OVER (PARTITION BY family_idx ORDER BY {h32(42, 'sample_id', q('split'))}, sample_id) AS rk, count(*) OVER (PARTITION BY family_idx) AS size FROM figures)",
    f"r2 AS (SELECT *, row_number() OVER (ORDER BY {h32(42, 'sample_id', q('split'))}, sample_id) AS rk, count(*) OVER () AS size FROM tier2)",
    """mixed AS (SELECT 'tier1' AS tier, CASE WHEN rk<=floor(size*0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split, sample_id, markup FROM r1 UNION ALL
 SELECT 'tier2', CASE WHEN rk<=floor(size*0.1::DOUBLE) THEN 'val' ELSE 'train' END, sample_id, markup FROM r2 UNION ALL
 SELECT 'tier3', 'test', doc_id, markup FROM gated)""",
    f"toks AS MATERIALIZED (SELECT tier, split, sample_id, {tokens('markup')} AS tokens FROM mixed)",
    vocabulary("SELECT unnest(tokens) AS token FROM toks WHERE split='train'"),
    encoded(512, keep="tier, split, sample_id"),
) + """SELECT tier, split, count(*) AS samples, sum(list_sum(ids))::BIGINT AS id_sum, sum(len(list_filter(ids, lambda t: t=3)))::BIGINT AS unknown_ids
 FROM enc GROUP BY ALL"""
ORACLES["g14_corpus_build"] = with_(
    ORD, FIG_BASE, TEX_DOCS, GATED, DOC_OUTCOMES,
    """alls AS (SELECT sample_id, family_idx AS stratum FROM fig_base WHERE cents%4<>0 UNION ALL
 SELECT doc_id+1000000000000, 8 FROM gated WHERE doc_id IN (SELECT sample_id FROM doc_outcomes WHERE is_successful))""",
    rank_split("alls", "sample_id", "stratum"),
) + """SELECT stratum, count(*) FILTER (rk>floor(size*0.1::DOUBLE)) AS train, count(*) FILTER (rk<=floor(size*0.1::DOUBLE)) AS val FROM ranked GROUP BY stratum"""

# === Metrics =================================================================================


def bleu(source, group, sample, order):
    """Statement over ``source(group, sample, r, c)`` with token lists."""
    grams = " UNION ALL ".join(
        f"SELECT {group}, {sample}, {n} AS o, {side} AS side, unnest(list_transform(range(1, greatest(1, len({side}c)-{n}+2)), "
        f"lambda i: array_to_string(list_slice({side}c, i, i+{n}-1), chr(1)))) AS g FROM toked"
        for n in range(1, order + 1) for side in ("1", "2")
    ).replace("1c)", "r)").replace("1c,", "r,").replace("2c)", "c)").replace("2c,", "c,")
    sums = ", ".join(f"sum(least(a,b)) FILTER (o={n}) AS m{n}, sum(b) FILTER (o={n}) AS t{n}" for n in range(1, order + 1))
    zero = " OR ".join(f"coalesce(m{n},0)=0" for n in range(1, order + 1))
    logs = "+".join(f"ln(nullif(m{n},0)/t{n}::DOUBLE)" for n in range(1, order + 1))
    return (
        f"toked AS MATERIALIZED ({source})",
        f"grams AS (SELECT {group}, {sample}, o, g, count(*) FILTER (side=1) AS a, count(*) FILTER (side=2) AS b FROM ({grams}) GROUP BY ALL)",
        f"sums AS (SELECT {group}, {sums} FROM grams GROUP BY {group})",
        f"lens AS (SELECT {group}, count(*) AS pairs, sum(len(r)) AS rl, sum(len(c)) AS cl FROM toked GROUP BY {group})",
        f"""bl AS (SELECT l.{group}, pairs, CASE WHEN {zero} OR cl=0 THEN 0.0::DOUBLE ELSE
 CASE WHEN cl>rl THEN 1.0::DOUBLE ELSE exp(1.0::DOUBLE-rl/cl::DOUBLE) END*exp(({logs})/{order}) END AS score FROM lens l LEFT JOIN sums s USING ({group}))""",
    )


PAIR_TOKENS = f"SELECT policy, tier, sample_id, {tokens('reference')} AS r, {tokens('candidate')} AS c FROM pairs"
ORACLES["m1_corpus_bleu"] = with_(*PAIR, *bleu(PAIR_TOKENS, "policy", "sample_id", 4)) + "SELECT policy, pairs, round(score,6) AS corpus_bleu FROM bl"
CHATS = """chats AS (SELECT a.conv_id, a.turn, a.text AS reference, b.text AS candidate FROM conversations a JOIN conversations b
 ON a.conv_id=b.conv_id AND b.turn=a.turn+1 WHERE a.role='user' AND b.role='assistant')"""
ORACLES["m1_corpus_bleu_text"] = with_(CHATS, *bleu(
    f"SELECT turn>1 AS long_turn, conv_id||'-'||turn AS sample, {words('reference')} AS r, {words('candidate')} AS c FROM chats",
    "long_turn", "sample", 2)) + "SELECT long_turn, pairs, round(score,6) AS corpus_bleu FROM bl"

# Edit distance by anti-diagonals: entry i of step t is the cell (i, t-i), so a step needs only
# the two before it and no cell waits for another of its own step.
EDIT = (
    f"""tk AS (SELECT sample_id, policy, tier, family, {tokens('reference')} AS r, {tokens('candidate')} AS c FROM pairs)""",
    """pts AS (SELECT *, list_transform(range(1, len(r)+1), lambda i: CASE WHEN r[i]='(' AND r[i+2]=',' AND r[i+4]=')'
  AND TRY_CAST(r[i+1] AS DOUBLE) IS NOT NULL AND TRY_CAST(r[i+3] AS DOUBLE) IS NOT NULL THEN i END) AS rs,
 list_transform(range(1, len(c)+1), lambda i: CASE WHEN c[i]='(' AND c[i+2]=',' AND c[i+4]=')'
  AND TRY_CAST(c[i+1] AS DOUBLE) IS NOT NULL AND TRY_CAST(c[i+3] AS DOUBLE) IS NOT NULL THEN i END) AS cs FROM tk)""",
    """own AS (SELECT *, list_transform(range(1, len(r)+1), lambda i: coalesce(rs[i], CASE WHEN i>1 THEN rs[i-1] END, CASE WHEN i>3 THEN rs[i-3] END)) AS ro,
 list_transform(range(1, len(c)+1), lambda i: coalesce(cs[i], CASE WHEN i>1 THEN cs[i-1] END, CASE WHEN i>3 THEN cs[i-3] END)) AS co FROM pts)""",
    """flat AS MATERIALIZED (SELECT sample_id, policy, tier, family, r, c, len(r) AS m, len(c) AS n,
 list_transform(ro, lambda s: TRY_CAST(r[s+1] AS DOUBLE)) AS rx, list_transform(ro, lambda s: TRY_CAST(r[s+3] AS DOUBLE)) AS ry,
 list_transform(co, lambda s: TRY_CAST(c[s+1] AS DOUBLE)) AS cx, list_transform(co, lambda s: TRY_CAST(c[s+3] AS DOUBLE)) AS cy FROM own)""",
    f"""sweep AS (SELECT sample_id, 0 AS t, list_transform(range(0, m+1), lambda i: CASE WHEN i=0 THEN 0.0::DOUBLE END) AS d1,
 list_transform(range(0, m+1), lambda i: NULL::DOUBLE) AS d0 FROM flat
 UNION ALL SELECT s.sample_id, s.t+1, list_transform(range(0, f.m+1), lambda i: CASE WHEN s.t+1-i<0 OR s.t+1-i>f.n THEN NULL
  WHEN i=0 THEN (s.t+1)::DOUBLE WHEN i=s.t+1 THEN i::DOUBLE ELSE least(s.d1[i]+1.0::DOUBLE, s.d1[i+1]+1.0::DOUBLE,
  s.d0[i]+CASE WHEN f.rx[i] IS NOT NULL AND f.cx[s.t+1-i] IS NOT NULL
   THEN least(1.0::DOUBLE, sqrt((f.rx[i]-f.cx[s.t+1-i])*(f.rx[i]-f.cx[s.t+1-i])+(f.ry[i]-f.cy[s.t+1-i])*(f.ry[i]-f.cy[s.t+1-i]))/{DIAGONAL})
   WHEN f.r[i]=f.c[s.t+1-i] THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) END), s.d1
 FROM sweep s JOIN flat f USING (sample_id) WHERE s.t<f.m+f.n)""",
    """ed AS MATERIALIZED (SELECT s.sample_id, f.policy, f.tier, f.family, s.d1[f.m+1]/greatest(f.m, f.n, 1) AS d FROM sweep s JOIN flat f USING (sample_id) WHERE s.t=f.m+f.n)""",
)
ORACLES["m2_token_edit_distance"] = with_(*PAIR, *EDIT, recursive=True) + "SELECT sample_id, round(d,6) AS token_distance FROM ed"
ORACLES["m2_letter_edit_distance"] = """SELECT p_partkey, round(levenshtein(p_name, lower(p_type)||' '||p_name)/greatest(length(p_name),
 length(lower(p_type)||' '||p_name))::DOUBLE,6) AS token_distance FROM part"""
ORACLES["m3_batch_evaluation"] = with_(*PAIR, *EDIT, *bleu(PAIR_TOKENS, "policy", "sample_id", 4), recursive=True) + """SELECT bl.policy, pairs,
 round(score,6) AS corpus_bleu, round(avg(d),6) AS mean_token_distance, 0::BIGINT AS out_of_range FROM bl JOIN ed ON ed.policy=bl.policy GROUP BY ALL"""

RX, RY = point_lists("reference")
CX, CY = point_lists("candidate")
PT_PAIRS = f"pp AS MATERIALIZED (SELECT *, {RX} AS rx, {RY} AS ry, {CX} AS cx, {CY} AS cy FROM pairs)"
GAPS = "list_transform(range(1, least(len(rx),len(cx))+1), lambda i: sqrt((rx[i]-cx[i])*(rx[i]-cx[i])+(ry[i]-cy[i])*(ry[i]-cy[i])))"
ORDERED = f"""(CASE WHEN greatest(len(rx),len(cx))=0 THEN 0.0::DOUBLE ELSE (coalesce(list_sum(list_transform({GAPS}, lambda d: least(d/{DIAGONAL}, 1.0::DOUBLE))),0)
 +abs(len(rx)-len(cx)))/greatest(len(rx),len(cx)) END)"""
MEAN_POINT = f"""(CASE WHEN least(len(rx),len(cx))=0 THEN {DIAGONAL} ELSE list_sum({GAPS})/least(len(rx),len(cx))+abs(len(rx)-len(cx)) END)"""
ORACLES["m4_ordered_coordinate_error"] = with_(*PAIR, PT_PAIRS) + f"""SELECT sample_id, least(len(rx),len(cx)) AS compared,
 round({ORDERED},6) AS coordinate_error FROM pp"""
# Nodes: matching by enumeration, reference points one by one, each taking an unused candidate
# point or none, with the used ones as a bit mask; the figures hold at most four points.
# Compositions: the candidate has the same points but those of one statement, so the best
# matching costs nothing beyond the missing points.
ORACLES["m5_unordered_coordinate_error"] = with_(
    f"""nodes AS (SELECT o_orderkey AS sample_id, {family_figure('node_arrow', 42, 'o_orderkey')} AS reference,
 {family_figure('node_arrow', 42, "('m5/'||o_orderkey)")} AS candidate FROM orders)""",
    f"np AS MATERIALIZED (SELECT sample_id, {RX} AS rx, {RY} AS ry, {CX} AS cx, {CY} AS cy FROM nodes)",
    f"""drawn AS (SELECT o_orderkey AS sample_id, {family_figure('composed', 42, 'o_orderkey')} AS whole FROM orders)""",
    f"""parts AS (SELECT sample_id, whole AS reference, string_split(whole, chr(10))[2] AS candidate FROM drawn)""",
    f"cp AS (SELECT sample_id, len({RX}) AS n, len({RX})-len({CX}) AS kept FROM parts)",
    """fm AS (SELECT sample_id, 0 AS i, 0::BIGINT AS used, 0 AS n, 0.0::DOUBLE AS cost FROM np UNION ALL
 SELECT f.sample_id, f.i+1, f.used+CASE WHEN j=0 THEN 0 ELSE 1::BIGINT<<(j-1) END, f.n+(j>0)::INT,
 f.cost+CASE WHEN j=0 THEN 0 ELSE sqrt((rx[f.i+1]-cx[j])*(rx[f.i+1]-cx[j])+(ry[f.i+1]-cy[j])*(ry[f.i+1]-cy[j])) END
 FROM (SELECT fm.*, rx, ry, cx, cy, unnest(range(len(cx)+1)) AS j FROM fm JOIN np USING (sample_id) WHERE i<len(rx)) f
 WHERE j=0 OR (used & (1::BIGINT<<(j-1)))=0)""", recursive=True) + f"""SELECT sample_id, 'node_arrow' AS family, 'assigned' AS matching, least(len(rx),len(cx)) AS compared_points,
 round(CASE WHEN greatest(len(rx),len(cx))=0 THEN 0.0::DOUBLE WHEN least(len(rx),len(cx))=0 THEN 1.0::DOUBLE ELSE
 (min(cost)/{DIAGONAL}+abs(len(rx)-len(cx)))/greatest(len(rx),len(cx)) END,6) AS coordinate_error
 FROM fm JOIN np USING (sample_id) WHERE i=len(rx) AND n=least(len(rx),len(cx)) GROUP BY sample_id, rx, cx
 UNION ALL SELECT sample_id, 'composed', 'assigned', kept, round((n-kept)/n::DOUBLE,6) FROM cp"""
ORACLES["m6_mean_point_distance"] = with_(*PAIR, PT_PAIRS) + f"SELECT sample_id, round({MEAN_POINT},6) AS coord_mean_error FROM pp"


def prims(side, name):
    x, y = point_lists("stmt")
    return (f"{name}_s AS (SELECT sample_id, {statements(side)} AS ss FROM pairs)",
            f"""{name} AS MATERIALIZED (SELECT sample_id, unnest(list_transform(ss, lambda stmt: {{'kind': lower(regexp_extract(stmt, {q(C.COMMAND_PATTERN)}, 1)),
 'xs': {x}, 'ys': {y}}})) AS p, unnest(range(len(ss))) AS pos FROM {name}_s)""")


# Assignment by enumeration: references of a block one by one, each taking an unused candidate
# or none, with the used ones as a bit mask. Blocks here hold at most four primitives.
GRAPH = (
    *prims("reference", "rp"), *prims("candidate", "cp"),
    "rb AS (SELECT sample_id, p.kind AS kind, p.xs AS xs, p.ys AS ys, row_number() OVER (PARTITION BY sample_id, p.kind ORDER BY pos) AS i FROM rp)",
    "cb AS (SELECT sample_id, p.kind AS kind, p.xs AS xs, p.ys AS ys, row_number() OVER (PARTITION BY sample_id, p.kind ORDER BY pos) AS j FROM cp)",
    f"""edges AS MATERIALIZED (SELECT a.sample_id, a.kind, i, j, 1.0::DOUBLE-CASE WHEN greatest(len(a.xs),len(b.xs))=0 THEN 0.0::DOUBLE ELSE
 (coalesce(list_sum(list_transform(range(1, least(len(a.xs),len(b.xs))+1), lambda k: least(sqrt((a.xs[k]-b.xs[k])*(a.xs[k]-b.xs[k])+(a.ys[k]-b.ys[k])*(a.ys[k]-b.ys[k]))/{DIAGONAL}, 1.0::DOUBLE))),0)
 +abs(len(a.xs)-len(b.xs)))/greatest(len(a.xs),len(b.xs)) END AS saved FROM rb a JOIN cb b ON a.sample_id=b.sample_id AND a.kind=b.kind)""",
    "blocks AS (SELECT sample_id, kind, max(i) AS m FROM edges GROUP BY ALL)",
    """walk AS (SELECT sample_id, kind, 0::BIGINT AS i, 0::BIGINT AS used, 0.0::DOUBLE AS total FROM blocks UNION ALL
 SELECT w.sample_id, w.kind, w.i+1, w.used+coalesce(e.bit,0), w.total+coalesce(e.saved,0) FROM walk w JOIN blocks b ON b.sample_id=w.sample_id AND b.kind=w.kind AND w.i<b.m
 JOIN (SELECT sample_id, kind, i, (1::BIGINT<<(j-1)) AS bit, saved FROM edges UNION ALL SELECT DISTINCT sample_id, kind, i, 0::BIGINT, 0.0::DOUBLE FROM edges) e
 ON e.sample_id=w.sample_id AND e.kind=w.kind AND e.i=w.i+1 AND (w.used & e.bit)=0)""",
    "best AS (SELECT sample_id, sum(t) AS saved FROM (SELECT sample_id, kind, max(total) AS t FROM walk GROUP BY ALL) GROUP BY sample_id)",
    "rn AS (SELECT sample_id, count(*) AS n FROM rp GROUP BY ALL), cn AS (SELECT sample_id, count(*) AS n FROM cp GROUP BY ALL)",
    """gd AS MATERIALIZED (SELECT p.sample_id, p.family, p.policy, p.tier, CASE WHEN coalesce(rn.n,0)=0 AND coalesce(cn.n,0)=0 THEN 0.0::DOUBLE
 WHEN coalesce(rn.n,0)=0 OR coalesce(cn.n,0)=0 THEN 1.0::DOUBLE ELSE (greatest(rn.n,cn.n)-coalesce(saved,0))/greatest(rn.n,cn.n) END AS d
 FROM pairs p LEFT JOIN rn ON rn.sample_id=p.sample_id LEFT JOIN cn ON cn.sample_id=p.sample_id LEFT JOIN best b ON b.sample_id=p.sample_id)""",
)
ORACLES["m7_graph_edit_distance"] = with_(*PAIR, *GRAPH, recursive=True) + "SELECT sample_id, round(d,6) AS graph_distance FROM gd"
ORACLES["m8_mean_graph_distance"] = with_(*PAIR, *GRAPH, recursive=True) + """SELECT family, count(*) AS samples, round(avg(d),6) AS mean_graph_distance
 FROM gd GROUP BY family"""
ORACLES["m9_token_overlap"] = with_(CHATS, f"w AS (SELECT conv_id, turn, {words('reference')} AS r, {words('candidate')} AS c FROM chats)") + f"""
SELECT conv_id, turn, round({jaccard('r', 'c', '1.0::DOUBLE')},6) AS token_overlap FROM w"""
KEYS = f"kw AS (SELECT *, {keywords('reference', C.EVALUATION_KEYWORDS)} AS rk, {keywords('candidate', C.EVALUATION_KEYWORDS)} AS ck, {family_of('candidate')} AS predicted FROM pairs)"
ORACLES["m10_primitive_accuracy"] = with_(*PAIR, KEYS) + f"SELECT sample_id, round({jaccard('rk', 'ck', '0.0::DOUBLE')},6) AS primitive_accuracy FROM kw"
ORACLES["m11_family_accuracy"] = with_(*PAIR, KEYS, "o AS (SELECT CASE WHEN sample_id%5=0 THEN 'ood_composed' ELSE family END AS family, predicted FROM kw)") + """
SELECT family, round(avg((predicted=family OR (family='ood_composed' AND predicted<>'unknown'))::INT),6) AS family_accuracy FROM o GROUP BY family"""
COLLAPSED = "(predicted='line_segment' AND family<>'line_segment')"
ORACLES["m12_collapse_rate"] = with_(*PAIR, KEYS) + f"""SELECT policy, count(*) FILTER ({COLLAPSED}) AS collapsed,
 round(count(*) FILTER ({COLLAPSED})/greatest(1, count(*) FILTER (family<>'line_segment'))::DOUBLE,6) AS collapse_rate FROM kw GROUP BY policy"""
ORACLES["m13_compilation_rate"] = with_(ORD, OUTCOMES) + """SELECT policy, count(*) FILTER (is_successful) AS successes, count(*) AS total,
 round(avg(is_successful::INT),6) AS compilation_rate FROM outcomes GROUP BY policy"""
_RAW = [math.exp(-((i - 5) ** 2) / (2 * 1.5 * 1.5)) for i in range(11)]
KERNEL = ", ".join(f"({i},{w / sum(_RAW)!r}::DOUBLE)" for i, w in enumerate(_RAW))
ORACLES["m14_ssim"] = with_(
    PX, "ab AS (SELECT image_id, y, x, p/255.0::DOUBLE AS a, p/255.0::DOUBLE*0.9::DOUBLE+label/100.0::DOUBLE AS b FROM px"
    " WHERE x<CASE WHEN image_id%7=3 THEN 8 WHEN image_id%2=1 THEN 40 ELSE 64 END)",
    f"k AS (SELECT * FROM (VALUES {KERNEL}) v(i, w))",
    "win AS (SELECT k1.i AS dy, k2.i AS dx, k1.w*k2.w AS w FROM k k1 CROSS JOIN k k2)",
    """mo AS (SELECT image_id, y-dy AS y0, x-dx AS x0, count(*) AS n, sum(w*a) AS ma, sum(w*b) AS mb, sum(w*a*a) AS aa, sum(w*b*b) AS bb, sum(w*a*b) AS ab
 FROM ab CROSS JOIN win WHERE y-dy>=0 AND x-dx>=0 GROUP BY ALL HAVING count(*)=121)""",
    """sc AS (SELECT image_id, (2*ma*mb+0.0001::DOUBLE)*(2*(ab-ma*mb)+0.0009::DOUBLE)/((ma*ma+mb*mb+0.0001::DOUBLE)*((aa-ma*ma)+(bb-mb*mb)+0.0009::DOUBLE)) AS s FROM mo)""",
) + "SELECT image_id, round(avg(s),6) AS ssim FROM (SELECT DISTINCT image_id FROM ab) LEFT JOIN sc USING (image_id) GROUP BY image_id"
ORACLES["m15_mean_ssim"] = with_(ORD, OUTCOMES) + """SELECT policy, count(*) FILTER (is_successful) AS ssim_samples,
 round(coalesce(avg(ssim) FILTER (is_successful),0),6) AS mean_ssim_compiled, round(avg(CASE WHEN is_successful THEN ssim ELSE 0 END),6) AS mean_ssim_all
 FROM outcomes GROUP BY policy"""
ORACLES["m16_ssim_proxy"] = with_(*PAIR, *GRAPH, recursive=True) + "SELECT policy, round(greatest(0,least(1,1-avg(d))),6) AS mean_ssim FROM gd GROUP BY policy"
ORACLES["m17_best_of_n"] = with_(ORD, OUTCOMES, """rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ssim DESC, sample_id) AS r
 FROM outcomes WHERE is_successful AND ssim>0)""") + """SELECT i.image_id, coalesce(rk.sample_id, 0) AS candidate_no, round(coalesce(rk.ssim, 0.0::DOUBLE),6) AS best_ssim
 FROM (SELECT DISTINCT image_id FROM outcomes) i LEFT JOIN rk ON rk.image_id=i.image_id AND r=1"""
ORACLES["m18_policy_comparison"] = with_(ORD, OUTCOMES, """t AS (SELECT policy, count(*) AS samples, avg(ssim) AS s, avg(is_successful::INT)*100 AS c
 FROM outcomes GROUP BY policy)""") + """SELECT policy, samples, round(s,6) AS mean_ssim, round(c,6) AS compile_percent,
 round(s-(SELECT s FROM t WHERE policy='greedy'),6) AS delta_ssim FROM t"""
ORACLES["m19_tier_summary"] = with_(*PAIR, *EDIT, *GRAPH, *bleu(PAIR_TOKENS, "tier", "sample_id", 4), recursive=True) + """SELECT bl.tier, pairs AS samples,
 round(score,6) AS corpus_bleu, (SELECT round(avg(d),6) FROM ed WHERE ed.tier=bl.tier) AS mean_geometric_edit_distance,
 (SELECT round(avg(d),6) FROM gd WHERE gd.tier=bl.tier) AS mean_graph_edit_distance, o.successes, o.total, o.compilation_rate, o.ssim_samples, o.mean_ssim
 FROM bl JOIN (SELECT tier, count(*) FILTER (is_successful) AS successes, count(*) AS total, round(avg(is_successful::INT),6) AS compilation_rate,
 count(*) FILTER (is_successful) AS ssim_samples, round(avg(ssim) FILTER (is_successful),6) AS mean_ssim FROM pairs GROUP BY tier) o ON o.tier=bl.tier"""

# === Reports =================================================================================

SCORED = f"""scored AS MATERIALIZED (SELECT family, policy, is_successful, ssim AS raw_ssim, candidate, rx, cx, is_successful::INT::DOUBLE AS compilation_rate, CASE WHEN is_successful THEN ssim ELSE 0.0::DOUBLE END AS ssim,
 {jaccard('rk', 'ck', '0.0::DOUBLE')} AS primitive_accuracy, (predicted=family)::INT::DOUBLE AS family_accuracy, predicted, {MEAN_POINT} AS coord_mean_error,
 {ORDERED} AS coordinate_error, {jaccard('rw', 'cw', '1.0::DOUBLE')} AS overlap, len(cw) AS n_words, sample_id FROM (SELECT *, {keywords('reference', C.EVALUATION_KEYWORDS)} AS rk,
 {keywords('candidate', C.EVALUATION_KEYWORDS)} AS ck, {family_of('candidate')} AS predicted, {words('reference')} AS rw, {words('candidate')} AS cw FROM pp))"""


def family_report(token_distance, source="scored"):
    return f"""SELECT coalesce(family,'overall') AS family, count(*) AS samples, avg(compilation_rate) AS mean_compilation_rate, avg(ssim) AS mean_ssim,
 avg(primitive_accuracy) AS mean_primitive_accuracy, avg(family_accuracy) AS mean_family_accuracy, avg(coord_mean_error) AS mean_coord_mean_error,
 avg({token_distance}) AS mean_token_distance FROM {source} GROUP BY ROLLUP (family)"""


REPORT_COLUMNS = ("mean_compilation_rate", "mean_ssim", "mean_primitive_accuracy", "mean_family_accuracy",
                  "mean_coord_mean_error", "mean_token_distance")
ROUNDED = ", ".join(f"round({c},6) AS {c}" for c in REPORT_COLUMNS)
MEASURED = with_(*PAIR, PT_PAIRS, SCORED, *EDIT, "sd AS (SELECT scored.*, ed.d FROM scored JOIN ed USING (sample_id))", recursive=True)
FAMILY_REPORT = family_report('d', '(SELECT * EXCLUDE (policy) FROM sd)')
ORACLES["h1_evaluation_report"] = MEASURED + f"SELECT family, samples, {ROUNDED} FROM ({FAMILY_REPORT})"
ORACLES["h1_family_report"] = ORACLES["h1_evaluation_report"]
ORACLES["a14_markdown_table"] = MEASURED + f"""SELECT family, printf('| `%s` | %d | %.1f%% | %.3f | %.1f%% | %.1f%% | %.3f | %.3f |', family, samples,
 mean_compilation_rate*100, mean_ssim, mean_primitive_accuracy*100, mean_family_accuracy*100, mean_coord_mean_error, mean_token_distance) AS line
 FROM ({FAMILY_REPORT}) WHERE family<>'overall'"""

DIAG_COLUMNS = ("compilation_rate", "ssim_mean", "coordinate_error_mean", "token_distance_mean", "graph_distance_mean", "ssim_std",
                "coordinate_error_std", "token_distance_std", "graph_distance_std", "token_overlap_mean", "family_accuracy",
                "collapse_rate", "eos_rate", "unk_rate", "mean_length")
# The detailed records: candidates are sanitized before they are scored, token distances run over
# words, and ids come from the raw candidate.
SANE = f"""pairs AS MATERIALIZED (SELECT * REPLACE ({sanitized('candidate')} AS candidate), candidate AS raw_candidate FROM raw)"""
WORD_EDIT = (EDIT[0].replace(tokens("reference"), words("reference")).replace(tokens("candidate"), words("candidate")), *EDIT[1:])
EMITTED = f"""em AS (SELECT r.sample_id, contains(raw_candidate, {q(C.END_PICTURE)}) AS ended, {tokens('raw_candidate')} AS t FROM pairs r)"""
IDS = """un2 AS (SELECT sample_id, count(*) FILTER (idx IS NULL) AS unk FROM (SELECT sample_id, unnest(t[:510]) AS token FROM em) LEFT JOIN vocab USING (token) GROUP BY ALL)"""
RECORDS = (*PAIR[:-1], PAIR[-1].replace("pairs AS", "raw AS", 1), *(c for c in VOC if c not in PAIR), SANE, PT_PAIRS, SCORED,
           *WORD_EDIT, *GRAPH, EMITTED, IDS,
           f"""rec AS MATERIALIZED (SELECT s.family, s.sample_id, p.seed, s.policy, s.is_successful, s.ssim, s.coordinate_error, least(len(s.rx),len(s.cx)) AS compared,
 ed.d AS token_ged, gd.d AS graph_ged, s.overlap, s.predicted, (s.predicted='line_segment' AND s.family<>'line_segment') AS collapsed, s.family_accuracy,
 len(em.t)+1+ended::INT AS total_length, ended, coalesce(unk,0) AS unk, p.raw_candidate, p.candidate AS sane, p.log FROM scored s
 JOIN ed USING (sample_id) JOIN gd USING (sample_id) JOIN em USING (sample_id) LEFT JOIN un2 USING (sample_id) JOIN pairs p ON p.sample_id=s.sample_id)""")


def parens(text):
    return f"abs((length({text})-length(replace({text}, '(', '')))-(length({text})-length(replace({text}, ')', ''))))"


ORACLES["a12_detailed_csv"] = with_(*RECORDS, recursive=True) + f"""SELECT family, sample_id AS sample_index, seed, policy,
 is_successful AS compilation_successful, printf('%.4f', ssim) AS ssim, printf('%.4f', coordinate_error) AS coordinate_error, compared AS coordinate_points_compared,
 array_to_string({COMMANDS.replace('candidate', 'sane')}, '|') AS emitted_primitives, printf('%.4f', token_ged) AS token_ged, printf('%.4f', graph_ged) AS graph_ged,
 printf('%.4f', overlap) AS token_overlap, predicted AS predicted_family, collapsed AS is_line_segment_collapsed, total_length, total_length AS length_to_eos,
 ended AS has_eos, unk AS unk_count, {parens('raw_candidate')} AS raw_unbalanced_parens, {parens('sane')} AS san_unbalanced_parens,
 nullif(left(replace(log, chr(10), ' '), 100), '') AS tex_error FROM rec"""
MOMENTS = (("ssim", "ssim"), ("coord_error", "coordinate_error"), ("token_ged", "token_ged"), ("graph_ged", "graph_ged"))
ORACLES["a13_family_summary"] = with_(*RECORDS, recursive=True) + f"""SELECT family, policy, count(*) AS samples, printf('%.4f', avg(is_successful::INT)) AS compilation_rate_mean,
 {', '.join(f"printf('%.4f', avg({c})) AS {n}_mean, printf('%.4f', stddev_pop({c})) AS {n}_std" for n, c in MOMENTS)},
 printf('%.4f', avg(overlap)) AS token_overlap_mean, printf('%.4f', avg(family_accuracy)) AS family_accuracy,
 printf('%.4f', count(*) FILTER (collapsed)/greatest(1, count(*) FILTER (family<>'line_segment'))::DOUBLE) AS collapse_rate,
 printf('%.4f', avg(ended::INT)) AS eos_rate, printf('%.4f', sum(unk)/sum(total_length)::DOUBLE) AS unk_rate, printf('%.2f', avg(total_length)) AS mean_length
 FROM rec GROUP BY family, policy"""
DIAGNOSTICS = """diag AS (SELECT policy, coalesce(family,'overall') AS family, count(*) AS samples, avg(is_successful::INT) AS compilation_rate,
 avg(ssim) AS ssim_mean, avg(coordinate_error) AS coordinate_error_mean, avg(token_ged) AS token_distance_mean, avg(graph_ged) AS graph_distance_mean,
 stddev_pop(ssim) AS ssim_std, stddev_pop(coordinate_error) AS coordinate_error_std, stddev_pop(token_ged) AS token_distance_std,
 stddev_pop(graph_ged) AS graph_distance_std, avg(overlap) AS token_overlap_mean, avg(family_accuracy) AS family_accuracy,
 count(*) FILTER (collapsed)/greatest(1, count(*) FILTER (family<>'line_segment'))::DOUBLE AS collapse_rate,
 avg(ended::INT) AS eos_rate, sum(unk)/sum(total_length)::DOUBLE AS unk_rate, avg(total_length) AS mean_length,
 sum(compared)::BIGINT AS points_compared FROM rec GROUP BY GROUPING SETS ((policy),(policy,family)))"""
ORACLES["h2_diagnostics_report"] = with_(*RECORDS, DIAGNOSTICS, recursive=True) + f"""SELECT policy, family, samples, points_compared,
 {', '.join(f'round({c},6) AS {c}' for c in DIAG_COLUMNS)} FROM diag"""
ORACLES["a13_summary_json"] = with_(*RECORDS, DIAGNOSTICS, recursive=True) + """SELECT policy, family, samples AS sample_count, round(ssim_mean,6) AS ssim_mean,
 round(ssim_std,6) AS ssim_std, round(token_distance_mean,6) AS token_ged_mean, round(token_distance_std,6) AS token_ged_std,
 round(graph_distance_mean,6) AS graph_ged_mean, round(graph_distance_std,6) AS graph_ged_std, round(compilation_rate,6) AS compilation_rate,
 round(eos_rate,6) AS eos_rate, round(unk_rate,6) AS unk_rate, round(mean_length,6) AS mean_length_to_eos FROM diag"""
RUNS = f"""runs AS (SELECT {POLICY} AS model, CASE status WHEN 'O' THEN 'tier1' WHEN 'F' THEN 'tier2' ELSE 'tier3' END AS tier, custkey%3 AS seed,
 avg(cents%1009/1008.0::DOUBLE) AS corpus_bleu, avg(cents%2003/2002.0::DOUBLE) AS mean_geometric_edit_distance, avg(cents%3001/3000.0::DOUBLE) AS mean_graph_edit_distance,
 avg((cents%4<>0)::INT) AS compilation_rate, avg(cents%10007/10006.0::DOUBLE) AS mean_ssim FROM ord GROUP BY ALL)"""
LONG = f"long AS (UNPIVOT runs ON {', '.join(C.TIER_METRICS)} INTO NAME metric VALUE value)"
STATS = "stats AS (SELECT model, tier, metric, avg(value) AS mean, coalesce(stddev_samp(value),0) AS std FROM long GROUP BY ALL)"
RUN = (ORD, RUNS, LONG)
ORACLES["h3_seed_statistics"] = with_(*RUN, STATS) + "SELECT model, tier, metric, round(mean,6) AS mean, round(std,6) AS std FROM stats"
ORACLES["h4_mean_std_text"] = with_(*RUN, STATS) + "SELECT model, tier, metric, printf('%.3f \\pm %.3f', mean, std) AS text FROM stats"
ORACLES["h5_generalization_gap"] = with_(*RUN, "m AS (SELECT tier, metric, coalesce(avg(value) FILTER (NOT (tier='tier2' AND metric='mean_ssim')),0) AS v FROM long GROUP BY ALL)") + """SELECT a.tier, a.metric,
 round(b.v-a.v,6) AS gap FROM m a JOIN m b ON b.metric=a.metric AND b.tier='tier1' WHERE a.tier<>'tier1'"""
ORACLES["h6_baseline_deltas"] = with_(*RUN, "b AS (SELECT metric, avg(value) AS v FROM long WHERE tier='tier1' AND model='greedy' GROUP BY metric)",
 "m AS (SELECT tier, metric, avg(value) AS v FROM long WHERE model='beam' GROUP BY ALL)") + """SELECT m.tier, m.metric,
 round(CASE WHEN m.tier='tier1' THEN m.v-b.v ELSE b.v-m.v END,6) AS delta FROM m JOIN b USING (metric)"""
VARIANT_METRICS = ("corpus_bleu", "mean_graph_edit_distance", "compilation_rate", "mean_ssim")
VARIANTS = f"""va AS (SELECT CASE WHEN model='greedy' THEN 'Full' ELSE 'No '||model END AS variant, {', '.join(f'avg({m}) AS {m}' for m in VARIANT_METRICS)}
 FROM runs WHERE tier='tier3' GROUP BY ALL)"""
DELTAS = f"""de AS (SELECT v.*, {', '.join(f"(v.{m}-f.{m})*{100 if m == 'compilation_rate' else 1} AS delta_{m}" for m in VARIANT_METRICS)}
 FROM va v CROSS JOIN (SELECT * FROM va WHERE variant='Full') f)"""
ORACLES["h7_ablation_deltas"] = with_(ORD, RUNS, VARIANTS, DELTAS) + f"""SELECT variant, {', '.join(f'round({m},6) AS {m}, round(delta_{m},6) AS delta_{m}' for m in VARIANT_METRICS)} FROM de"""


def signed(metric, digits):
    return f"CASE WHEN variant='Full' THEN '' ELSE printf(' (%+.{digits}f)', delta_{metric}) END"


def whole_table(kind, body):
    """A numbered body between the table's head and foot."""
    head, foot = TABLE_HEADS[kind], TABLE_FEET[kind]
    fixed = [f"({n - len(head) + 1}, {q(t)})" for n, t in enumerate(head)]
    fixed += [f"({(1 << 40) + n}, {q(t)})" for n, t in enumerate(foot)]
    return f"SELECT line_no::BIGINT AS line_no, line FROM ({body}) UNION ALL SELECT * FROM (VALUES {', '.join(fixed)}) v(line_no, line)"


ORACLES["a14_ablation_table"] = with_(ORD, RUNS, VARIANTS, DELTAS) + whole_table("ablation", f"""SELECT row_number() OVER (ORDER BY variant<>'Full', variant) AS line_no, '\\textbf{{'||variant||'}} & '||printf('%.3f', corpus_bleu)||{signed('corpus_bleu', 3)}||' & '
 ||printf('%.3f', mean_graph_edit_distance)||{signed('mean_graph_edit_distance', 3)}||' & '||printf('%.1f', compilation_rate*100)||'\\%'||{signed('compilation_rate', 1)}||' & '
 ||printf('%.3f', mean_ssim)||{signed('mean_ssim', 3)}||' \\\\' AS line FROM de""")


def cell(metric, factor=1, digits=3):
    return (f"printf('%.{digits}f \\pm %.{digits}f', max(mean) FILTER (metric={q(metric)})*{factor}, max(std) FILTER (metric={q(metric)})*{factor})")


ORACLES["a14_multitier_table"] = with_(*RUN, STATS, f"""body AS (SELECT model, tier, {cell('corpus_bleu')}||' & '||{cell('mean_geometric_edit_distance')}||' & '
 ||{cell('mean_graph_edit_distance')}||' & '||{cell('compilation_rate', 100, 1)}||' & '||{cell('mean_ssim')} AS cells FROM stats GROUP BY ALL)""",
 """rows AS (SELECT model, tier, 0 AS part, CASE WHEN tier=min(tier) OVER (PARTITION BY model) THEN '\\textbf{'||upper(model[1])||model[2:]||'}' ELSE '' END
 ||' & '||upper(tier)||' & '||cells||' \\\\' AS line FROM body UNION ALL
 SELECT model, max(tier), 1, '\\midrule' FROM body GROUP BY model HAVING model<>(SELECT max(model) FROM body))""") + whole_table("multitier", "SELECT row_number() OVER (ORDER BY model, tier, part) AS line_no, line FROM rows")

TELEMETRY = f"""te AS (SELECT event_type AS stage, {HOURS} AS epoch, count(*) AS samples, sum(floor(value*100+0.5::DOUBLE)::BIGINT)::BIGINT/100.0::DOUBLE/count(*) AS val_loss,
 max({SECONDS})-min({SECONDS}) AS elapsed_seconds FROM events GROUP BY ALL)"""
ORACLES["h8_best_epochs"] = with_(TELEMETRY) + """SELECT stage, epoch, round(val_loss,6) AS val_loss, coalesce(val_loss<min(val_loss) OVER (PARTITION BY stage ORDER BY epoch
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM te"""
ORACLES["h9_stage_summary"] = with_(TELEMETRY, "rk AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY val_loss, epoch) AS r FROM te)") + """SELECT stage,
 sum(samples)::BIGINT AS samples, count(*) AS epochs, round(min(val_loss),6) AS best_val_loss, max(epoch) FILTER (r=1) AS best_epoch,
 sum(elapsed_seconds)::BIGINT AS elapsed_seconds FROM rk GROUP BY stage"""
ORACLES["h10_progress"] = f"""SELECT family, hour, added, sum(added) OVER (PARTITION BY family ORDER BY hour)::BIGINT AS collected FROM
 (SELECT event_type AS family, {HOURS} AS hour, count(*) AS added FROM events GROUP BY ALL)"""
ORACLES["h10_throughput"] = f"""SELECT event_type AS family, count(*) AS collected, 2000::BIGINT AS target,
 round(count(*)/greatest(1, max({SECONDS})-min({SECONDS}))::DOUBLE,6) AS samples_per_sec FROM events GROUP BY event_type"""
ORACLES["h11_telemetry_changes"] = with_(TELEMETRY) + """SELECT stage, epoch, samples-lag(samples) OVER w AS samples_change,
 round(val_loss-lag(val_loss) OVER w,6) AS val_loss_change FROM te WINDOW w AS (PARTITION BY stage ORDER BY epoch)"""
ORACLES["h12_contingency"] = with_(*SPL) + """SELECT family, count(*) FILTER (split='train') AS train, count(*) FILTER (split='val') AS val,
 count(*) FILTER (split='test') AS test FROM sf GROUP BY family"""
ORACLES["h13_epoch_losses"] = f"SELECT {HOURS} AS epoch, count(*) AS steps, round(avg(value),6) AS mean_loss FROM events GROUP BY epoch"

# === Images ==================================================================================


def flat(source, decimals=6, channel="0"):
    return f"""SELECT image_id, {channel}::BIGINT AS channel, y, count(*) AS width, round(sum(p),{decimals}) AS total, round(sum(p*(x+1)),{decimals}) AS weighted
 FROM {source} GROUP BY ALL"""


UNIT = "un AS MATERIALIZED (SELECT image_id, y, x, label, image_id//4 AS batch_id, p/255.0::DOUBLE AS p FROM px)"
ORACLES["i1_normalized"] = with_(PX, UNIT) + flat("un")
ORACLES["i2_three_channels"] = with_(PX, "rgb AS (SELECT px.*, c FROM px CROSS JOIN range(3) r(c))") + """SELECT image_id, c AS channel, y, count(*) AS width, round(sum(p),6) AS total,
 round(sum(p*(x+1)),6) AS weighted FROM rgb GROUP BY ALL"""


def resize(source, height, width, to_bytes=False):
    value = "sum(p*wy*wx)"
    if to_bytes:
        value = f"floor(greatest(0,least(255,{value}+1e-9::DOUBLE)))"
    return (
        f"dims AS (SELECT image_id, max(y)+1 AS h, max(x)+1 AS w FROM {source} GROUP BY image_id)",
        f"""ty AS (SELECT image_id, h, t AS oy, greatest(0.0::DOUBLE, (t+0.5::DOUBLE)*(h/{height}::DOUBLE)-0.5::DOUBLE) AS s FROM dims CROSS JOIN range({height}) r(t))""",
        f"""tx AS (SELECT image_id, w, t AS ox, greatest(0.0::DOUBLE, (t+0.5::DOUBLE)*(w/{width}::DOUBLE)-0.5::DOUBLE) AS s FROM dims CROSS JOIN range({width}) r(t))""",
        """yy AS (SELECT image_id, oy, least(floor(s), h-1) AS y, 1-(s-least(floor(s), h-1)) AS wy FROM ty UNION ALL
 SELECT image_id, oy, least(least(floor(s), h-1)+1, h-1), s-least(floor(s), h-1) FROM ty)""",
        """xx AS (SELECT image_id, ox, least(floor(s), w-1) AS x, 1-(s-least(floor(s), w-1)) AS wx FROM tx UNION ALL
 SELECT image_id, ox, least(least(floor(s), w-1)+1, w-1), s-least(floor(s), w-1) FROM tx)""",
        f"""rz AS (SELECT yy.image_id, oy AS y, ox AS x, {value} AS p FROM yy JOIN xx USING (image_id) JOIN {source} s
 ON s.image_id=yy.image_id AND s.y=yy.y AND s.x=xx.x GROUP BY ALL)""",
    )


ORACLES["i3_resized"] = with_(PX, *resize("px", 24, 48)) + flat("rz")
ORACLES["i3_resized_bytes"] = with_(PX, *resize("px", 8, 100, True)) + flat("rz")
ORACLES["i4_encoder_input"] = with_(PX, UNIT, *resize("un", 8, 32)) + flat("rz")
PIXEL_KEY = "image_id||'/0/'||y"


def noise(source, name="noi"):
    return f"""{name} AS MATERIALIZED (SELECT * REPLACE (greatest(0.0::DOUBLE, least(1.0::DOUBLE, p+0.03::DOUBLE*sqrt(-2.0::DOUBLE*ln(1.0::DOUBLE-{u(42, PIXEL_KEY, '2*x')}))
 *cos({2.0 * math.pi!r}::DOUBLE*{u(42, PIXEL_KEY, '(2*x+1)')}))) AS p) FROM {source})"""


def contrast(source, alpha, name="con"):
    return f"""{name} AS MATERIALIZED (SELECT s.* REPLACE (greatest(0.0::DOUBLE, least(1.0::DOUBLE, {alpha}::DOUBLE*p+(1.0::DOUBLE-{alpha}::DOUBLE)*mean)) AS p)
 FROM {source} s JOIN (SELECT batch_id, avg(p) AS mean FROM {source} GROUP BY batch_id) USING (batch_id))"""


def blur(source, name="blu"):
    return (f"""{name}_h AS (SELECT * REPLACE (coalesce(lag(p) OVER w,0)*0.25::DOUBLE+p*0.5::DOUBLE+coalesce(lead(p) OVER w,0)*0.25::DOUBLE AS p) FROM {source}
 WINDOW w AS (PARTITION BY image_id, y ORDER BY x))""",
            f"""{name} AS MATERIALIZED (SELECT * REPLACE (greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(lag(p) OVER w,0)*0.25::DOUBLE+p*0.5::DOUBLE+coalesce(lead(p) OVER w,0)*0.25::DOUBLE)) AS p)
 FROM {name}_h WINDOW w AS (PARTITION BY image_id, x ORDER BY y))""")


ORACLES["i5_noisy"] = with_(PX, UNIT, noise("un")) + flat("noi", 5)
ORACLES["i6_contrasted"] = with_(PX, UNIT, contrast("un", 1.3)) + flat("con")
ORACLES["i7_blurred"] = with_(PX, UNIT, *blur("un")) + flat("blu")


def tossed(step, before, after, name):
    """Pixels after a step where the batch's coin for it falls so, else those before."""
    return f"""{name} AS MATERIALIZED (SELECT b.* REPLACE (CASE WHEN {u(42, 'b.batch_id', q(step))}<0.5 THEN a.p ELSE b.p END AS p)
 FROM {before} b JOIN {after} a USING (image_id, y, x))"""


ORACLES["i8_augmented"] = with_(PX, UNIT, noise("un"), tossed("noise", "un", "noi", "t1"), contrast("t1", 0.8), tossed("contrast", "t1", "con", "t2"),
 *blur("t2"), tossed("blur", "t2", "blu", "t3")) + flat("t3", 5)

# === Streams =================================================================================

ORACLES["s1_incremental_curation"] = with_(TEX_DOCS, GATED) + "SELECT DISTINCT sha256(markup) AS fingerprint FROM gated"
ORACLES["s1_watermarked_curation"] = ORACLES["s1_incremental_curation"]
ORACLES["s2_live_progress"] = with_(ORD, FIG_BASE) + """SELECT family, count(*) AS collected, 1500::BIGINT AS target, count(*)>=1500 AS done FROM fig_base GROUP BY family"""

# === Ingestion ===============================================================================

ORACLES["a15_ingestion_funnel"] = with_(TEX_DOCS, DOC_OUTCOMES) + f"""SELECT count(*) AS documents, count(*) FILTER ({VIOLATION}='valid') AS valid,
 count(*) FILTER ({VIOLATION}='valid' AND coalesce(is_successful,false)) AS built FROM tex_docs LEFT JOIN doc_outcomes ON sample_id=doc_id"""
ORACLES["a15_ingested_pairs"] = with_(TEX_DOCS, DOC_OUTCOMES, f"""k AS (SELECT doc_id AS sample_id, code FROM tex_docs WHERE {VIOLATION}='valid'
 AND doc_id IN (SELECT sample_id FROM doc_outcomes WHERE is_successful))""") + """SELECT sample_id, position, printf('sample_%05d', position) AS sample_name, sha256(code) AS fingerprint
 FROM (SELECT *, row_number() OVER (ORDER BY sample_id)-1 AS position FROM k)"""

# Rounded columns carry the same nudge off exact halves as the jobs.
ORACLES = {
    name: statement.replace(",6)", "+1e-9::DOUBLE,6)").replace(",5)", "+1e-9::DOUBLE,5)")
    for name, statement in ORACLES.items()
}
